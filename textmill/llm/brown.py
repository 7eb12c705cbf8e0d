"""Language-model scores from a class-based bigram model whose classes come from exchange clustering.

    P(text) = product of P(class of token | class of the token before) * P(token | its class)

1. Vocabulary: counts of every token of all learning texts, merged in each task and summed by Spark.
2. Texts as numbers: one scan writes each text's words as places among the HEAD most frequent words, whose table of at
   most HEAD words of 64 bytes each task has. A word that is not among them becomes one of FORM_UNITS groups by its last
   bytes. All later steps read these numbers, not the texts.
3. Exchange clustering of the most frequent words: the driver moves END, WORD_UNITS words and the groups between CLASSES
   classes while the likelihood of the class bigrams grows, on (WORD_UNITS + FORM_UNITS + 1)**2 counts at most.
4. Exchange of all other words up to the CLUSTERED most frequent: each goes to the class that makes the likelihood
   largest, given all its own contexts in the corpus (classes before and behind it). Counts are summed, and words placed,
   in tasks that hold a range of words each. Only words beyond those take the class of their group.
5. Transitions between the classes so found are counted again over all learning texts.
6. Scores: transitions and frequent words are summed up per text; the words that are not among the HEAD are joined with
   the whole vocabulary by Spark, once per document and word. So every count is exact, however large the vocabulary.

Transitions are smoothed towards the classes' shares, emissions by ADD with one slot for all unknown words of a class,
so that the probabilities of a class sum to one.

Defined cases: null text counts as empty (one end token); without learning rows all counts are 0 and the model is the
smoothed uniform one; null ids and repeated rows are rows of their own; an empty table: an empty result; further columns
are ignored. Texts are read whole.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc32_mod, worker_cache, written

END = "\n"  # no word holds white space
HEAD, HEAD_BYTES, CLUSTERED = 200_000, 64, 1 << 15
WORD_UNITS, FORM_UNITS, CLASSES = 1023, 512, 128
UNITS = 1 + WORD_UNITS + FORM_UNITS
ADD, BASE_ADD, PULL, PASSES = 0.1, 0.1, 1.0, 6
HELD_OUT_FOLDS = 10

#: Distinct words that a task counts before it hands them on, and forms that it remembers.
_FLUSH = 300_000
#: Rows of a batch that a task hands on.
_ROWS = 20_000


def tokens(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()  # bytes: A-Z only, and the six white-space characters of ASCII


def form_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % FORM_UNITS


def count_words(texts: DataFrame) -> DataFrame:
    """texts: text (binary). word, c; the end token once per text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            rows = iter(seen.items())
            while some := list(islice(rows, _ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array([w.decode("utf-8", "replace") for w, _ in some], pa.string()), pa.array([c for _, c in some], pa.int64())], ["word", "c"])
            seen.clear()

        for b in batches:
            for text in b["text"]:
                seen.update(tokens(text.as_py()))
                seen[END.encode()] += 1
                if len(seen) > _FLUSH:
                    yield from out()
        yield from out()

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """The words above the lowest count that at most so many words reach; counts go by steps of a twelfth of an octave.
    Only the sizes of the steps are gathered, so no task and not the driver sorts words."""
    step = F.floor(F.log2("c") * 12).cast("int")
    short = vocabulary.filter(F.octet_length("word") <= HEAD_BYTES)
    held, lowest = 0, None
    for r in short.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("step").desc()).collect():  # 12 * 63 rows at most
        held += r["n"]
        if held > most:
            break
        lowest = r["step"]
    return short.filter(step >= lowest) if lowest is not None else short.limit(0)


def exchange(bigrams: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """The class of each unit. bigrams[u, v]: how often v follows u. Unit 0 keeps class 0 to itself. Each unit in turn
    goes to the class that makes the likelihood of the class bigrams largest."""
    n = len(bigrams)
    of = np.zeros(n, np.int64)
    order = np.argsort(-bigrams.sum(1), kind="stable")
    order = order[order != 0]
    of[order] = 1 + np.arange(len(order)) % (classes - 1)
    member = np.zeros((n, classes))
    member[np.arange(n), of] = 1
    m = member.T @ bigrams @ member
    f = lambda x: x * np.log(np.maximum(x, 1))
    diag = np.arange(classes)
    for _ in range(passes):
        moved = 0
        for u in order:
            a, own = of[u], bigrams[u, u]
            leaving = np.bincount(of, bigrams[u], classes)
            entering = np.bincount(of, bigrams[:, u], classes)
            m[a] -= leaving
            m[:, a] -= entering
            m[a, a] += own
            leaving[a] -= own
            entering[a] -= own
            total_out, total_in = leaving.sum() + own, entering.sum() + own
            fm, rows, cols = f(m), m.sum(1), m.sum(0)
            gain = (f(m + leaving) - fm).sum(1) + (f(m + entering[:, None]) - fm).sum(0)
            d = m[diag, diag]
            gain += f(d + leaving + entering + own) + f(d) - f(d + leaving) - f(d + entering)
            gain -= f(rows + total_out) - f(rows) + f(cols + total_in) - f(cols)
            gain[0] = -np.inf
            b = a if gain[a] >= gain.max() - 1e-9 else int(np.argmax(gain))
            m[b] += leaving
            m[:, b] += entering
            m[b, b] += own
            of[u], moved = b, moved + (b != a)
        if not moved:
            break
    return of


class Head:
    """The most frequent words: their places and counts. A word's number is its place, or for all others the number of
    places plus its form; END has a place as well, but no text has it."""

    def __init__(self, words: list[bytes], counts: np.ndarray):
        self.place = {w: k for k, w in enumerate(words)}
        self.counts, self.size = counts, len(words)
        units = [0 if w == END.encode() else 1 + k if k < WORD_UNITS else 1 + WORD_UNITS + form_of(w) for k, w in enumerate(words)]
        self.units = np.array([*units, *range(1 + WORD_UNITS, UNITS)], np.int32)  # by number

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of words, and where those are that have no place."""
        at = np.fromiter(map(self.place.get, words, [-1] * len(words)), np.int32, len(words))
        rare = np.flatnonzero(at < 0)
        at[rare] = [self.size + form_of(words[k]) for k in rare]
        return at, rare


class SharedHead:
    """A Head in every worker: plain bytes are broadcast, and each worker makes the Head of them once."""

    def __init__(self, spark: SparkSession, words: list[str], counts: list[int]):
        # a space parts the words: the end token is a line feed, and no other holds white space
        self.shared = spark.sparkContext.broadcast((" ".join(words).encode(), np.array(counts, np.int64).tobytes()))
        self.token = uuid.uuid4().hex

    @property
    def value(self) -> Head:
        cache = worker_cache()
        if cache.get("head_token") != self.token:
            words, counts = self.shared.value
            cache["head"] = Head(words.split(b" ") if words else [], np.frombuffer(counts, np.int64))
            cache["head_token"] = self.token
        return cache["head"]


_ENCODED = [pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]


def encode(docs: DataFrame, head: SharedHead) -> DataFrame:
    """row, doc_id, learn, numbers (32-bit, one a word), rare (words without a place, each once), times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = head.value
        for b in batches:
            numbers, rare, times = [], [], []
            for text in b["text"]:
                words = tokens(text.as_py())
                at, odd = known.look_up(words)
                numbers.append(at.astype("<i4").tobytes())
                seen = Counter(words[k] for k in odd.tolist())
                rare.append([w.decode("utf-8", "replace") for w in seen])
                times.append(list(seen.values()))
            columns = [b["row"], b["doc_id"], b["learn"], *[pa.array(c, t) for c, t in zip((numbers, rare, times), _ENCODED[3:], strict=True)]]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "learn", "numbers", "rare", "times"])

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("string").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("learn"), F.col("text").cast("binary").alias("text"))
    return written(numbered.mapInArrow(run, "row long, doc_id string, learn boolean, numbers binary, rare array<string>, times array<long>"), "brown-encoded")


def _bigrams(encoded: DataFrame, classes: SharedArray, kinds: int) -> np.ndarray:
    """How often each class follows each other, over all learning texts. classes: by a word's number; END is 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, table = classes.value, np.zeros(kinds * kinds, np.int64)
        for b in batches:
            codes = []
            for x in b["numbers"]:
                c = of[np.frombuffer(x, "<i4")].astype(np.int64)
                codes.append(np.append(0, c) * kinds + np.append(c, 0))
            if codes:
                table += np.bincount(np.concatenate(codes), minlength=kinds * kinds)
        yield packed(table, _SLICE)

    def add(b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"part": b["part"].iloc[:1], "counts": [unpacked(b["counts"]).tobytes()]})

    parts = encoded.filter("learn").select("numbers").mapInPandas(run, "part int, counts binary").groupBy("part").applyInPandas(add, "part int, counts binary")
    out = np.zeros(kinds * kinds)
    for r in parts.collect():  # kinds**2 numbers at most
        mine = np.frombuffer(r["counts"], np.int64)
        out[r["part"] * _SLICE : r["part"] * _SLICE + len(mine)] = mine
    return out.reshape(kinds, kinds)


#: Numbers of a table that are summed up in one task.
_SLICE = 1 << 15


def packed(table: np.ndarray, step: int) -> pd.DataFrame:
    """part, counts: the parts of a task's table that are not all zero, compressed."""
    some = [k for k in range(0, len(table), step) if table[k : k + step].any()]
    return pd.DataFrame({"part": np.array(some, np.int32) // step, "counts": [zlib.compress(table[k : k + step].tobytes(), 1) for k in some]})


def unpacked(counts: pd.Series, kind=np.int64) -> np.ndarray:
    """The sum of one part of all tasks' tables."""
    total = 0
    for x in counts:
        total = total + np.frombuffer(zlib.decompress(x), kind).astype(np.int64)
    return total


class SharedArray:
    """An array that tasks read; plain bytes are broadcast."""

    def __init__(self, spark: SparkSession, values: np.ndarray):
        self.shared = spark.sparkContext.broadcast(values.astype(np.int32).tobytes())

    @property
    def value(self) -> np.ndarray:
        return np.frombuffer(self.shared.value, np.int32)


#: Words whose contexts are summed up and which are placed in one task; counts that a task collects before it adds them up.
_RANGE, _CODES = 256, 1 << 21


def best_classes(before: np.ndarray, behind: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The class of each word (row) that makes the likelihood largest, given how often each class stands before and
    behind it, and pairs of classes. Class 0 is END's own."""
    m = pairs + PULL / len(pairs)
    n = before.sum(1, keepdims=True)
    gain = behind @ np.log(m / m.sum(1, keepdims=True)).T + before @ np.log(m) - n * np.log(m.sum(0))
    gain[:, 0] = -np.inf
    return np.argmax(gain, axis=1)


def place_words(encoded: DataFrame, classes: np.ndarray, pairs: np.ndarray, n_words: int) -> np.ndarray:
    """Classes of the words with places up to n_words, by their contexts in all learning texts."""
    shared = SharedArray(encoded.sparkSession, classes)
    width = 2 * CLASSES

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, table = shared.value, np.zeros(n_words * width, np.uint32)
        held: list[np.ndarray] = []

        def add() -> None:
            if held:
                code, n = np.unique(np.concatenate(held), return_counts=True)
                table[code] += n.astype(np.uint32)
                held.clear()

        for b in batches:
            for x in b["numbers"]:
                at = np.frombuffer(x, "<i4").astype(np.int64)
                c = np.concatenate(([0], of[at], [0]))
                mine = np.flatnonzero(at < n_words)
                held += [at[mine] * width + c[mine], at[mine] * width + CLASSES + c[mine + 2]]
                if sum(map(len, held)) > _CODES:
                    add()
        add()
        yield packed(table, _RANGE * width)

    def place(b: pd.DataFrame) -> pd.DataFrame:
        first = int(b["part"].iloc[0]) * _RANGE
        total = unpacked(b["counts"], np.uint32).astype(float).reshape(-1, 2, CLASSES)
        met = np.flatnonzero(total[:, 0].sum(1))
        return pd.DataFrame({"place": first + met, "class": best_classes(total[met, 0], total[met, 1], pairs)})

    parts = encoded.filter("learn").select("numbers").mapInPandas(run, "part int, counts binary")
    rows = parts.groupBy("part").applyInPandas(place, "place int, class int").toArrow().to_pandas()  # n_words rows at most
    out = classes[:n_words].copy()
    out[rows["place"].to_numpy(np.int64)] = rows["class"].to_numpy(np.int64)
    return out


def cluster(encoded: DataFrame, known: Head, clustered: int = CLUSTERED) -> tuple[np.ndarray, np.ndarray]:
    """The class of each number, and how often each class follows each other."""
    spark = encoded.sparkSession
    bigrams = _bigrams(encoded, SharedArray(spark, known.units), UNITS)
    of = exchange(bigrams)
    classes = of[known.units]
    n_words = min(clustered, known.size)
    if n_words > WORD_UNITS:
        member = np.zeros((UNITS, CLASSES))
        member[np.arange(UNITS), of] = 1
        placed = place_words(encoded, classes, member.T @ bigrams @ member, n_words)
        mine = np.arange(WORD_UNITS, n_words)
        mine = mine[known.units[mine] != 0]
        classes[mine] = placed[mine]
    return classes, _bigrams(encoded, SharedArray(spark, classes), CLASSES)


class Model:
    """Logs (base 10) of transitions between classes, and what emissions need of each class."""

    def __init__(self, pairs: np.ndarray, distinct: np.ndarray, n: int, v: int):
        """pairs: of classes; distinct: words of the vocabulary in each class."""
        self.n, self.v = n, v
        size = pairs.sum(0)
        share = (size + 1) / (size.sum() + CLASSES)
        self.transitions = np.log10((pairs + PULL * share) / (pairs.sum(1, keepdims=True) + PULL))
        self.room = size + ADD * (distinct + 1)  # by class
        self.base_room = n + BASE_ADD * (v + 1)

    def emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((counts + ADD) / self.room[classes])

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + BASE_ADD) / self.base_room)


def vocabulary_by_class(vocabulary: DataFrame, head: SharedHead, classes: SharedArray) -> np.ndarray:
    """How many distinct words each class has."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, known, of = np.zeros(CLASSES, np.int64), head.value, classes.value
        for b in batches:
            n += np.bincount(of[known.look_up([w.encode() for w in b["word"]])[0]], minlength=CLASSES)
        yield pd.DataFrame({"class": np.arange(CLASSES), "n": n})

    rows = vocabulary.select("word").mapInPandas(run, "class long, n long").groupBy("class").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(CLASSES)
    out[rows["class"].to_numpy(np.int64)] = rows["n"].to_numpy(float)
    return out


def held_out(doc_id):
    return crc32_mod(doc_id, HELD_OUT_FOLDS) == 0


def score_texts(docs: DataFrame, head_size: int = HEAD, clustered: int = CLUSTERED) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    learning = docs.filter(~held_out(F.col("doc_id"))).select(F.col("text").cast("binary").alias("text"))
    vocabulary = written(count_words(learning), "brown-vocabulary")
    totals = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    n, v = int(totals["n"]), int(totals["v"])
    top = frequent(vocabulary, head_size).toArrow().to_pandas().sort_values(["c", "word"], ascending=[False, True])
    head = SharedHead(spark, top["word"].tolist(), top["c"].tolist())  # head_size words of HEAD_BYTES at most
    known = Head([w.encode() for w in top["word"]], top["c"].to_numpy(np.int64))
    del top
    encoded = encode(docs, head)
    classes, pairs = cluster(encoded, known, clustered)
    shared = SharedArray(spark, classes)
    model = Model(pairs, vocabulary_by_class(vocabulary, head, shared), n, v)
    counts = SharedArray(spark, np.minimum(known.counts, 2**31 - 1)) if known.size and known.counts.max() < 2**31 else None
    large = None if counts else known.counts
    end_count = known.counts[known.place[END.encode()]] if END.encode() in known.place else 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = shared.value
        held = counts.value.astype(np.int64) if counts else large
        emission, base = model.emission(held, of[: len(held)]), model.base(held)
        # words without a place are added by the join
        emission, base = (np.append(x, np.zeros(FORM_UNITS)) for x in (emission, base))
        is_known = np.append(held > 0, np.zeros(FORM_UNITS, bool))
        end = np.array([end_count])
        end_emission, end_base = float(model.emission(end, np.zeros(1, np.int64))[0]), float(model.base(end)[0])
        for b in batches:
            sums = []
            for x in b["numbers"]:
                at = np.frombuffer(x, "<i4")
                c = np.concatenate(([0], of[at], [0]))
                sums.append((len(at) + 1, int(is_known[at].sum()) + int(end_count > 0), float(base[at].sum()) + end_base, float(model.transitions[c[:-1], c[1:]].sum() + emission[at].sum()) + end_emission))
            yield pd.concat([b[["row", "doc_id"]].reset_index(drop=True), pd.DataFrame(sums, columns=["n_tokens", "n_known", "base", "score"])], axis=1)

    whole = encoded.select("row", "doc_id", "numbers").mapInPandas(run, "row long, doc_id string, n_tokens long, n_known long, base double, score double")
    rare = encoded.filter(F.size("rare") > 0).select("row", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("row", F.col("w.rare").alias("word"), F.col("w.times").alias("times"))
    met = rare.join(vocabulary.withColumnRenamed("word", "known_word"), F.col("word") == F.col("known_word"), "left")
    form = F.crc32(F.expr("substring(CAST(word AS BINARY), greatest(octet_length(word) - 2, 1), 3)")) % FORM_UNITS
    room = F.element_at(F.array(*[F.lit(float(x)) for x in model.room[classes[known.size :]]]), (form + 1).cast("int"))
    c, times = F.coalesce("c", F.lit(0)), F.col("times")
    none = F.lit(None).cast("string")
    found = met.select(
        "row", none.alias("doc_id"), F.lit(0).cast("long").alias("n_tokens"), F.when(c > 0, times).otherwise(0).alias("n_known"),
        (times * F.log10((c + F.lit(BASE_ADD)) / F.lit(float(model.base_room)))).alias("base"), (times * F.log10((c + F.lit(ADD)) / room)).alias("score"),
    )
    out = whole.unionByName(found).groupBy("row").agg(F.max("doc_id").alias("doc_id"), *[F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base", "score")])
    doc_id = F.col("doc_id").cast(docs.schema["doc_id"].dataType)
    return out.select(doc_id.alias("doc_id"), held_out(doc_id).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), "score")
