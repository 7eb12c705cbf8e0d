"""Salience: entropy, lexical and entity density, penalties and boosts, as columns. Entropy is counted in Arrow batches,
all else stays in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import byte_size, is_blank, java_pattern, trim

#: Words that carry little by themselves.
STOPWORDS = (
    "a an the and or but if then else when at from by on off for in out over to into with about against between "
    "through during before after above below up down is are was were be been being have has had do does did will would shall should "
    "can could may might must it its this that these those i you he she we they"
).split()

#: A text with one of these asks for action.
ALERT_TERMS = (
    "CRITICAL", "ALERT", "ERROR", "PANIC", "FATAL", "WARNING", "EXCEPTION", "FAIL", "FAILURE", "OOM", "TASK DIRECTIVE", "INSTRUCTION", "THROTTLE", "THROTTLING",
)

#: What counts as a number, a key with a value, and an identifier (RE2 syntax).
NUMBER_PATTERN = r"\b\d+(\.\d+)?(ms|s|%|MB|GB|KB|kbps|Mbps|°C|C|F|V|A|Hz|MHz|GHz)?\b"
KEY_VALUE_PATTERN = r"[a-zA-Z0-9_\-\.]+\s*[:=]\s*[^\s]+"
IDENTIFIER_PATTERN = r"\b[A-Z0-9_]{3,}\b|\b[A-Z][a-z]+[A-Z][a-z]+\b|/[a-zA-Z0-9_\-\./]+"
TOKEN_PATTERN = r"[\p{L}\p{Nd}_-]+"

#: Boilerplate families. A text is boilerplate if it has, for some family, one of the first and one of the
#: second terms; "^" in front: at its start.
BOILERPLATE = [
    (("ping ",), ("icmp_seq=", "bytes from", "ttl=")),
    (("heartbeat",), ("status=ok", "load=", "probe", "seq=")),
    (("get /health", "/healthz", "get /metrics"), ("200", "ok")),
    (("link up",), ("full-duplex",)),
    (("^[debug]",), ("probe", "ping", "ok", "heartbeat", "status=")),
]


def _any(text: Column, terms: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for t in terms:
        found = found | (text.startswith(t[1:]) if t[0] == "^" else text.contains(t))
    return found


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN_PATTERN), F.lit(0))


def entropies(texts: list[str]) -> np.ndarray:
    """Shannon entropy over code points, in bits, of each text: all texts' code points are counted in one sort."""
    raw = [t.encode("utf-32-le", "surrogatepass") for t in texts]
    sizes = np.array([len(x) // 4 for x in raw], np.int64)
    row = np.repeat(np.arange(len(raw), dtype=np.int64), sizes)
    key, n = np.unique(row << 21 | np.frombuffer(b"".join(raw), "<u4"), return_counts=True)
    share = n / sizes[key >> 21]
    return np.abs(np.bincount(key >> 21, share * np.log2(share), len(raw)))


#: Code points that are counted at once, which bounds memory.
_BLOCK = 1 << 20


@F.pandas_udf(T.DoubleType())
def _entropy(texts: pd.Series) -> pd.Series:
    found, some, held = [np.zeros(0)], [], 0
    for t in texts:
        some.append(t or "")
        held += len(some[-1])
        if held >= _BLOCK:
            found.append(entropies(some))
            some, held = [], 0
    return pd.Series(np.concatenate([*found, entropies(some)]))


def entropy(text: Column) -> Column:
    return _entropy(text)


def entropy_norm(bits: Column) -> Column:
    return F.least(F.lit(1.0), bits / 4.5)


def with_metrics(df: DataFrame, text: str, task: str | None, threshold: float) -> DataFrame:
    """Adds the struct column metrics: entropy, entropy_norm, lexical_density, entity_density, task_relevance,
    repetition_penalty, salience_score (rounded to 3 places), is_salient, discard_reason. task is a literal directive
    or null. The gate looks at the score before rounding."""
    t = F.col("__t")
    has_task = bool(task and task.strip())
    s = df.withColumn("__t", trim(F.coalesce(F.col(text), F.lit("")))).withColumn("__w", F.transform(tokens(t), lambda w: F.lower(w)))
    s = s.withColumn("__n", F.size("__w").cast("double")).withColumn("__u", F.array_distinct("__w")).withColumn("__h", entropy(t))
    s = s.withColumn("__hn", entropy_norm(F.col("__h")))
    unique = F.size("__u") / F.col("__n")
    content = F.size(F.filter("__w", lambda w: ~w.isin(*STOPWORDS))) / F.col("__n")
    s = s.withColumn("__uq", F.when(F.col("__n") > 0, unique)).withColumn("__lex", F.when(F.col("__n") > 0, F.least(F.lit(1.0), unique * 0.6 + content * 0.4)))
    count = lambda p: F.regexp_count(t, F.lit(java_pattern(p)))
    features = count(NUMBER_PATTERN) * 2 + count(KEY_VALUE_PATTERN) * 3 + count(IDENTIFIER_PATTERN) * 2
    s = s.withColumn("__ent", F.least(F.lit(1.0), features.cast("double") / (F.col("__n") * 0.5 + 5.0)))
    s = s.withColumn("__up", F.upper(t)).withColumn("__act", _any(F.col("__up"), ALERT_TERMS))
    s = s.withColumn("__low", F.lower(t))
    plain = F.lit(False)
    for first, second in BOILERPLATE:
        plain = plain | (_any(F.col("__low"), first) & _any(F.col("__low"), second))
    prose = (byte_size(t) >= 70) & (F.col("__n") >= 10) & (F.col("__lex") >= 0.5) & t.rlike("[.,;:]")
    s = s.withColumn("__plain", F.when(plain & ~F.col("__act"), 0.60).otherwise(0.0)).withColumn("__prose", F.coalesce(prose, F.lit(False)))
    repeated = F.when((byte_size(t) >= 5) & t.rlike(r"(?s)(.)\1{4}"), 0.35).otherwise(0.0) + F.when((F.col("__uq") < 0.35) & (F.col("__n") >= 6), 0.35).otherwise(0.0)
    s = s.withColumn("__rep", F.when(F.col("__act"), 0.0).otherwise(repeated))
    s = s.withColumn("__rel", relevance(F.col("__u"), task))
    boosts = F.when(F.col("__prose"), 0.20).otherwise(0.0) + F.when(F.col("__act"), 0.30).otherwise(0.0)
    weights = (0.20, 0.25, 0.20, 0.25) if has_task else (0.35, 0.35, 0.30, 0.0)
    parts = F.col("__hn") * weights[0] + F.col("__lex") * weights[1] + F.col("__ent") * weights[2]
    if has_task:
        parts = parts + F.col("__rel") * weights[3]
    s = s.withColumn("__score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), parts + boosts - F.col("__rep") - F.col("__plain"))))
    few = F.when(is_blank(t), "empty_text").when(F.col("__n") == 0, "no_alphanumeric_tokens")
    reason = (
        F.when(F.col("__score") >= threshold, F.lit(None).cast("string"))
        .when(F.col("__plain") > 0, "boilerplate_system_log")
        .when(F.col("__rep") > 0.2, "high_repetition_low_entropy")
        .when(F.col("__hn") < 0.4, "low_shannon_entropy")
    )
    if has_task:
        reason = reason.when((F.col("__rel") < 0.2) & ~F.col("__prose"), "low_task_relevance")
    reason = reason.when(F.col("__lex") < 0.3, "low_lexical_density_boilerplate").otherwise("below_salience_threshold")
    scored = few.isNull()
    zero = lambda c: F.when(scored, c).otherwise(0.0)
    metrics = F.struct(
        F.when(is_blank(t), 0.0).otherwise(F.col("__h")).alias("entropy"),
        F.when(is_blank(t), 0.0).otherwise(F.col("__hn")).alias("entropy_norm"),
        zero(F.col("__lex")).alias("lexical_density"),
        zero(F.col("__ent")).alias("entity_density"),
        zero(F.col("__rel")).alias("task_relevance"),
        zero(F.col("__rep") + F.col("__plain")).alias("repetition_penalty"),
        zero(F.round("__score", 3)).alias("salience_score"),
        F.coalesce(scored & (F.col("__score") >= threshold), F.lit(False)).alias("is_salient"),
        F.coalesce(few, reason).alias("discard_reason"),
    )
    names = [c for c in s.columns if c.startswith("__")]
    return s.withColumn("metrics", metrics).drop(*names)


def task_words(task: str | None) -> list[str]:
    """The words of a directive that count: no stopwords, more than two bytes, in lower case, each once."""
    import regex

    found = (w.lower() for w in regex.findall(TOKEN_PATTERN, task or ""))
    return sorted({w for w in found if w not in STOPWORDS and len(w.encode()) > 2})


def relevance(unique_words: Column, task: str | None) -> Column:
    words = task_words(task) if task and task.strip() else []
    if not words:
        return F.lit(0.5)
    shared = F.size(F.array_intersect(unique_words, F.array(*[F.lit(w) for w in words])))
    return F.least(F.lit(1.0), shared / F.lit(min(2.0, float(len(words)))))
