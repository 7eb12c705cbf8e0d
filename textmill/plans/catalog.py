"""Queries by name, each over its whole table, and SQL that gives the same rows.

The SQL is written for DuckDB, whose patterns are RE2's, so the default patterns stand in it as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import HEARTBEAT_EXCLUDE_PATTERN, HEARTBEAT_PATTERN, SEPARATOR_PATTERN, EngineConfig
from ..engine import Engine
from ..functions import salience
from ..functions.text import SPACE, content_id, is_blank
from ..operators import chunking, filtering, floor, log, scoring
from ..sources import requests as sources
from ..storage import shared_root
from ..streaming.ingest import ingest_stream, json_stream
from . import ingest as plan
from . import samples
from .samples import NOISY_SQL, SALIENCE_SQL, sql_text, table

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    from . import engine_queries  # noqa: F401  adds its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from . import engine_queries  # noqa: F401

    return dict(_SQL)


CONFIG = EngineConfig()
_BLANK = f"NOT regexp_matches(%s, '[^{SPACE}]')"
_FIRST_TS = "timestamp_ntz"


def _blank(c: str) -> str:
    return _BLANK % c


def _trim(c: str) -> str:
    return f"regexp_replace({c}, '^[{SPACE}]+|[{SPACE}]+$', '', 'g')"


def _entries(source: str, key: str) -> str:
    """CTEs that end in entries(key, pos, text): log entries of a table with a key and a text."""
    return f"""
src AS (SELECT * FROM {source}),
ls AS (SELECT {key}, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT {key}, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS l FROM src)),
ln AS (SELECT {key}, i, regexp_replace(l[i], '\\r$', '') AS line, CASE WHEN i > 1 THEN regexp_replace(l[i - 1], '\\r$', '') END AS above FROM ls),
st AS (SELECT {key}, i, line, CASE WHEN i = 1 OR {_blank('line')} OR NOT regexp_matches(line, '^[ \\t]') OR {_blank('above')} THEN 1 ELSE 0 END AS begins FROM ln),
gr AS (SELECT {key}, i, line, sum(begins) OVER (PARTITION BY {key} ORDER BY i) AS entry FROM st),
entries AS (SELECT {key}, (entry - 1)::INTEGER AS pos, string_agg(line, chr(10) ORDER BY i) AS text FROM gr GROUP BY {key}, entry)"""


def _reasons(kind: str = "log") -> str:
    """CTEs from entries(doc_id, pos, text) to reasons(doc_id, pos, text, reason)."""
    beat = f"len(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, {sql_text(HEARTBEAT_PATTERN)}) OR regexp_matches(x, {sql_text(HEARTBEAT_EXCLUDE_PATTERN)}))) = 0"
    return f"""
fl AS (SELECT *, CASE WHEN {_blank('text')} THEN 'blank' WHEN regexp_matches(text, {sql_text(SEPARATOR_PATTERN)}) THEN 'separator' WHEN {'true' if kind == 'log' else 'false'} AND {beat} THEN 'heartbeat' END AS early FROM entries),
reasons AS (SELECT doc_id, pos, text, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY doc_id, early IS NULL, text ORDER BY pos) > 1 THEN 'duplicate' END) AS reason FROM fl)"""


# chunking ------------------------------------------------------------------------------------------------------------


def _as_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(*samples.request("log", F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")))


def _key(name: str) -> F.Column:
    return F.col("ingest_id").cast("long").alias(name)


@query(f"WITH {_entries('documents', 'doc_id')} SELECT doc_id, pos, text FROM entries")
def chunk_log_lines(spark, sf_dir):
    return chunking.units(_as_logs(spark, sf_dir)).select(_key("doc_id"), "pos", "text")


@query(f"WITH {_entries(samples.EVENT_SQL, 'batch')} SELECT batch, pos, text FROM entries")
def chunk_log_continuation(spark, sf_dir):
    return chunking.units(samples.event_logs(spark, sf_dir)).select(_key("batch"), "pos", "text")


@query("SELECT conv_id, (row_number() OVER w - 1)::INTEGER AS pos, role AS speaker, 't' || row_number() OVER w AS turn_id, text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)")
def chunk_dialogue_turns(spark, sf_dir):
    return chunking.units(samples.dialogues(spark, sf_dir)).select(_key("conv_id"), "pos", "speaker", "turn_id", "text")


_PARAGRAPH_SQL = rf"""
WITH p AS (SELECT doc_id, string_split_regex(regexp_replace(text, '\n([^\n]*)\n', chr(10) || ' ' || chr(10) || '\1' || chr(10) || chr(10), 'g'), '\r?\n[ \t]*\r?\n') AS l FROM documents),
i AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS n, l FROM p),
t AS (SELECT doc_id, n, regexp_replace(l[n], '^[\r\n]+|[\r\n]+$', '', 'g') AS text FROM i)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1)::INTEGER AS pos, text FROM t WHERE NOT ({_blank('text')})
"""


@query(_PARAGRAPH_SQL)
def chunk_paragraphs(spark, sf_dir):
    """Every other line break of a document becomes a blank line."""
    text = F.regexp_replace("text", r"\n([^\n]*)\n", "\n \n$1\n\n")
    docs = table(spark, sf_dir, "documents").select(*samples.request("document", F.col("doc_id"), F.col("source"), F.col("lang"), text, fmt=F.lit("txt")))
    return chunking.units(docs).select(_key("doc_id"), "pos", "text")


@query()
def bound_parts_lineage(spark, sf_dir):
    """Documents as one unit each, bounded: lineage of the parts (a greedy loop over bytes: tested against a model)."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ingest_id"), F.lit(0).alias("pos"), "text")
    out = chunking.bound(docs, CONFIG.chunk_max_bytes)
    return out.select(_key("doc_id"), "parent_id", "part", "parts", F.octet_length("text").alias("bytes"), content_id(F.col("text")).alias("id"))


def _markdown(text: F.Column) -> F.Column:
    """Some lines become headings, some a fenced block with a blank line in it."""
    rows = F.transform(
        F.split(text, "\n", -1),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.lit("\n"), F.element_at(F.array(F.lit("# "), F.lit("## "), F.lit("### ")), (i / 5 % 3).cast("int") + 1), x, F.lit("\n")))
        .when(i % 7 == 0, F.concat(F.lit("```\n"), x, F.lit("\n\nend\n```\n")))
        .otherwise(x),
    )
    return F.array_join(rows, "\n")


@query()
def markdown_headings(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*samples.request("document", F.col("doc_id"), F.col("source"), F.col("lang"), _markdown(F.col("text")), fmt=F.lit("md")))
    return chunking.units(docs).select(_key("doc_id"), "pos", "heading", "text")


@query("SELECT doc_id, substr(sha256(text), 1, 32) AS id FROM documents")
def content_ids(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", content_id(F.col("text")).alias("id"))


# floor ---------------------------------------------------------------------------------------------------------------


def _floored(spark, sf_dir) -> DataFrame:
    wide = 1 << 30  # units as they are
    return floor.floored(chunking.candidates(samples.noisy_logs(spark, sf_dir), wide), CONFIG)


@query(f"WITH {_entries(NOISY_SQL, 'doc_id')}, {_reasons()} SELECT doc_id, pos, reason, substr(sha256(text), 1, 32) AS id FROM reasons")
def floor_reasons(spark, sf_dir):
    return _floored(spark, sf_dir).select(_key("doc_id"), "pos", "reason", content_id(F.col("text")).alias("id"))


_COUNTS = ", ".join(f"count(*) FILTER (WHERE reason = '{r}') AS {r}" for r in ("blank", "separator", "heartbeat", "duplicate")) + ", count(*) FILTER (WHERE reason IS NULL) AS kept"


@query(f"WITH {_entries(NOISY_SQL, 'doc_id')}, {_reasons()} SELECT doc_id, {_COUNTS} FROM reasons GROUP BY doc_id")
def floor_counts(spark, sf_dir):
    return floor.counts(_floored(spark, sf_dir), "ingest_id").select(_key("doc_id"), "blank", "separator", "heartbeat", "duplicate", "kept")


_BY_SOURCE = "(SELECT source || ':' || doc_id // 200 AS doc_id, string_agg(text, chr(10) ORDER BY doc_id) AS text FROM documents GROUP BY 1)"


@query(f"WITH {_entries(_BY_SOURCE, 'doc_id')}, {_reasons()} SELECT doc_id AS log, {_COUNTS} FROM reasons GROUP BY doc_id")
def floor_dedup_log(spark, sf_dir):
    """The documents of a source as logs of at most 200 documents each."""
    name = F.concat(F.col("source"), F.lit(":"), F.floor(F.col("doc_id") / 200).cast("string"))
    docs = table(spark, sf_dir, "documents").groupBy(name.alias("log")).agg(F.sort_array(F.collect_list(F.struct("doc_id", "text"))).alias("rows"))
    text = F.array_join(F.transform("rows", lambda r: r["text"]), "\n")
    logs = docs.select(*samples.request("log", F.col("log"), F.lit("docs"), F.lit("s"), text))
    rows = floor.floored(chunking.candidates(logs, 1 << 30), CONFIG)
    return floor.counts(rows, "ingest_id").withColumnRenamed("ingest_id", "log")


_QUESTION_SQL = f"""
t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, speaker, text) - 1)::INTEGER AS pos, speaker, text FROM @source),
u AS (SELECT *, CASE WHEN NOT ({_blank('text')}) THEN substr(sha256(text), 1, 32) END AS uid FROM t),
q AS (SELECT a.conv_id, a.pos, a.speaker, a.text, coalesce(arg_max(b.uid, b.pos), '') AS question
  FROM u a LEFT JOIN u b ON a.conv_id = b.conv_id AND b.pos < a.pos AND b.uid IS NOT NULL AND b.speaker <> a.speaker GROUP BY ALL)"""


@query(f"WITH {_QUESTION_SQL.replace('@source', '(SELECT conv_id, turn, role AS speaker, text FROM conversations)')} SELECT conv_id, pos, speaker, question FROM q")
def dialogue_question_context(spark, sf_dir):
    rows = floor.with_question(chunking.candidates(samples.dialogues(spark, sf_dir), 1 << 30))
    return rows.select(_key("conv_id"), "pos", "speaker", "question")


@query(
    f"WITH {_QUESTION_SQL.replace('@source', samples.REPEATED_SQL)}, f AS (SELECT *, CASE WHEN {_blank('text')} THEN 'blank' END AS early FROM q)"
    " SELECT conv_id, pos, speaker, coalesce(early, CASE WHEN row_number() OVER (PARTITION BY conv_id, early IS NULL, speaker, question, text ORDER BY pos) > 1 THEN 'duplicate' END) AS reason FROM f"
)
def dialogue_dedup(spark, sf_dir):
    rows = floor.floored(chunking.candidates(samples.dialogues(spark, sf_dir, repeat=True), 1 << 30), CONFIG)
    return rows.select(_key("conv_id"), "pos", "speaker", "reason")


# sources -------------------------------------------------------------------------------------------------------------

_LABELS = {
    "type": "CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN 'chat' WHEN 2 THEN ' log ' WHEN 3 THEN 'document' WHEN 4 THEN 'dialogue' ELSE 'log' END",
    "source": "CASE WHEN event_id % 7 = 0 THEN '  ' ELSE event_type END",
    "session": "CASE WHEN event_id % 11 = 0 THEN NULL ELSE 's' || CAST(user_id AS STRING) END",
    "text": "CASE WHEN event_id % 13 = 0 THEN '  ' ELSE props END",
    "speaker": "CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 17 = 0 THEN 'bob' ELSE NULL END",
    "format": "CASE WHEN event_id % 19 = 0 THEN 'doc' WHEN event_id % 23 = 0 THEN 'pdf' ELSE '' END",
}


@query(
    f"""WITH r AS (SELECT event_id, {', '.join(f'{v} AS {k}' for k, v in _LABELS.items())} FROM events),
t AS (SELECT event_id, trim(type) AS type, trim(source) AS source, trim(coalesce(session, '')) AS session, coalesce(text, '') AS text, coalesce(speaker, '') AS speaker, format FROM r),
e AS (SELECT event_id, CASE WHEN type = 'document' AND format = 'pdf' THEN 'invalid_label:format'
  WHEN type = '' THEN 'missing_label:type' WHEN type NOT IN ('dialogue', 'document', 'log') THEN 'invalid_label:type'
  WHEN source = '' THEN 'missing_label:source' WHEN session = '' THEN 'missing_label:session'
  WHEN type <> 'dialogue' AND speaker <> '' THEN 'invalid_label:turns'
  WHEN type = 'dialogue' AND trim(speaker) = '' THEN 'missing_label:speaker'
  WHEN type = 'document' AND format NOT IN ('', 'txt', 'md', 'csv', 'xml', 'json', 'pdf') THEN 'invalid_label:format'
  WHEN type <> 'dialogue' AND trim(text) = '' THEN 'empty_input:text' END AS error FROM t)
SELECT event_id, error FROM e""".replace("STRING", "VARCHAR")
)
def label_validation(spark, sf_dir):
    e = table(spark, sf_dir, "events").selectExpr("CAST(event_id AS STRING) AS ingest_id", *[f"{v} AS {k}" for k, v in _LABELS.items()])
    full = e.withColumns({"task": F.lit(""), "body": F.lit(None).cast("binary"), "filename": F.lit(None).cast("string"), "content_type": F.lit("application/json"), "turns": F.lit(None).cast("array<struct<speaker:string,text:string,turn_id:string,ts:timestamp>>")})
    return sources.validate(full, CONFIG).select(_key("event_id"), F.concat_ws(":", "error.code", "error.field").alias("error")).withColumn("error", F.when(F.col("error") != "", F.col("error")))


_NAMES = "CASE page_id % 9 WHEN 0 THEN 'a.TXT' WHEN 1 THEN 'b.pdf' WHEN 2 THEN 'dir.md/c.tsv' WHEN 3 THEN 'feed.rss' WHEN 4 THEN 'n.markdown' WHEN 5 THEN 'e.jsonl' ELSE '' END"
_MEDIA = "CASE page_id % 5 WHEN 0 THEN 'Text/Markdown; charset=utf-8' WHEN 1 THEN 'application/x-ndjson' WHEN 2 THEN ' text/csv ' ELSE 'application/octet-stream' END"


@query(
    f"""WITH p AS (SELECT page_id, {_NAMES} AS name, {_MEDIA} AS media, {_trim('html')} AS body FROM pages)
SELECT page_id, CASE page_id % 9 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'csv' WHEN 3 THEN 'xml' WHEN 4 THEN 'md' WHEN 5 THEN 'json' ELSE
  CASE page_id % 5 WHEN 0 THEN 'md' WHEN 1 THEN 'json' WHEN 2 THEN 'csv' ELSE
  CASE WHEN starts_with(body, '%PDF-') THEN 'pdf' WHEN starts_with(body, '<?xml') OR (starts_with(body, '<') AND ends_with(body, '>')) THEN 'xml'
  WHEN (starts_with(body, '{{') AND ends_with(body, '}}')) OR (starts_with(body, '[') AND ends_with(body, ']')) THEN 'json' ELSE 'txt' END END END AS format FROM p"""
)
def detect_format(spark, sf_dir):
    p = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_NAMES} AS name", f"{_MEDIA} AS media", "html")
    return p.select("page_id", sources.detect_format(F.col("name"), F.col("media"), F.col("html")).alias("format"))


def _csv_text(rows: F.Column) -> F.Column:
    return F.concat(F.lit("event_id,kind,,props\n"), F.array_join(rows, "\n"))


@query(
    """SELECT event_id // 50 AS batch, (row_number() OVER (PARTITION BY event_id // 50 ORDER BY event_id))::BIGINT AS item,
'event_id: ' || event_id || ' | kind: ' || event_type || CASE WHEN user_id % 2 = 0 THEN ' | col_3: ' || user_id ELSE '' END || ' | props: say "' || user_id || '", ok' AS text FROM events"""
)
def csv_rows(spark, sf_dir):
    """Fifty events as a CSV body with quotes, empty cells and a column without a name."""
    e = table(spark, sf_dir, "events")
    user = F.col("user_id").cast("string")
    row = F.concat(F.col("event_id").cast("string"), F.lit(", "), F.col("event_type"), F.lit(","), F.when(F.col("user_id") % 2 == 0, user).otherwise(""), F.lit(',"say ""'), user, F.lit('"", ok"'))
    bodies = e.groupBy(F.floor(F.col("event_id") / 50).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("event_id", row.alias("row")))).alias("rows"))
    body = _csv_text(F.transform("rows", lambda r: r["row"]))
    items = bodies.select("batch", F.posexplode(chunking.parsed_items(F.lit("csv"), body)).alias("item", "text"))
    return items.select("batch", (F.col("item") + 1).cast("long").alias("item"), "text")


@query("""SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT AS item, '{"key":' || n_nationkey || ',"name":"' || n_name || '"}' AS text FROM nation""")
def json_items(spark, sf_dir):
    """Nations of a region: an array, an object with items, or JSON lines, by region."""
    n = table(spark, sf_dir, "nation")
    one = F.concat(F.lit('{"name":"'), F.col("n_name"), F.lit('", "key": '), F.col("n_nationkey").cast("string"), F.lit("}"))
    tidy = F.concat(F.lit('{"key":'), F.col("n_nationkey").cast("string"), F.lit(',"name":"'), F.col("n_name"), F.lit('"}'))
    g = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", one.alias("x"), tidy.alias("y")))).alias("rows"))
    xs, ys = F.transform("rows", lambda r: r["x"]), F.transform("rows", lambda r: r["y"])
    kind = F.col("n_regionkey") % 3
    body = F.when(kind == 0, F.concat(F.lit("[ "), F.array_join(xs, " , "), F.lit("]"))).when(kind == 1, F.concat(F.lit('{"Items": ['), F.array_join(xs, ","), F.lit("]}"))).otherwise(F.array_join(ys, "\n\n"))
    items = g.select(F.col("n_regionkey").alias("region"), F.posexplode(chunking.parsed_items(F.lit("json"), body)).alias("item", "text"))
    return items.select("region", (F.col("item") + 1).cast("long").alias("item"), "text")


@query("""SELECT n_regionkey AS region, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey))::BIGINT AS item, 'name: ' || n_name || ' | code: <' || n_nationkey || '>' AS text FROM nation""")
def xml_records(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    one = F.concat(F.lit("<row id='1'>\n<name> "), F.col("n_name"), F.lit(" </name><!-- x --><code>&lt;"), F.col("n_nationkey").cast("string"), F.lit("&gt;</code></row>"))
    g = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", one.alias("x")))).alias("rows"))
    body = F.concat(F.lit('<?xml version="1.0"?>\n<nations>'), F.array_join(F.transform("rows", lambda r: r["x"]), "\n"), F.lit("</nations>"))
    items = g.select(F.col("n_regionkey").alias("region"), F.posexplode(chunking.parsed_items(F.lit("xml"), body)).alias("item", "text"))
    return items.select("region", (F.col("item") + 1).cast("long").alias("item"), "text")


@query("""SELECT n_nationkey::BIGINT AS nation, '--- PDF Section 1 ---' || chr(10) || 'Nation ' || n_name || ' (' || n_nationkey || ')' || chr(10) || 'end' AS text FROM nation""")
def pdf_text(spark, sf_dir):
    """A small PDF body per nation, with an uncompressed content stream."""
    n = table(spark, sf_dir, "nation")
    stream = F.concat(F.lit("BT\n/F1 12 Tf\n[(Na) 20 (tion) -250 ("), F.col("n_name"), F.lit(r")] TJ (\("), F.col("n_nationkey").cast("string"), F.lit(r"\)) Tj T* <656e64> Tj" + "\nET"))
    body = F.concat(F.lit("%PDF-1.4\n1 0 obj\n<< /Length 9 >>\nstream\n"), stream, F.lit("\nendstream\nendobj\n"))
    return n.select(F.col("n_nationkey").cast("long").alias("nation"), F.explode(chunking.parsed_items(F.lit("pdf"), body)).alias("text"))


# scoring -------------------------------------------------------------------------------------------------------------


def _scored(spark, sf_dir) -> DataFrame:
    """Every vector against that of the smallest vec_id, as chunks of one request per label; one label has no task."""
    e = table(spark, sf_dir, "embeddings")
    first = e.orderBy("vec_id").first()  # one row
    task = F.array(*[F.lit(float(x)) for x in first["embedding"]])
    has = F.when(F.col("label") == 9, "").otherwise("find")
    vector = F.when(F.col("vec_id") % 50 != 7, F.col("embedding").cast("array<double>"))
    chunks = e.select("vec_id", F.col("label").alias("ingest_id"), has.alias("task"), vector.alias("vector"), task.alias("task_vector"))
    return scoring.routed(chunks, CONFIG.strong_threshold)


_SCORED_SQL = """
t AS (SELECT embedding::DOUBLE[] AS v FROM embeddings ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, label, CASE WHEN label <> 9 AND vec_id % 50 <> 7 THEN round(list_cosine_similarity(embedding::DOUBLE[], t.v), 4) END AS task_score FROM embeddings, t),
scored AS (SELECT *, coalesce(task_score >= 0.30, false) AS strong, CASE WHEN label = 9 THEN 'no_task' WHEN task_score IS NULL THEN 'embedder_unavailable' ELSE 'scored' END AS score_status FROM s)"""


@query(f"WITH {_SCORED_SQL} SELECT vec_id, task_score FROM scored")
def task_scores(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "task_score")


@query(f"WITH {_SCORED_SQL} SELECT vec_id, strong, score_status FROM scored")
def routing_strong_weak(spark, sf_dir):
    return _scored(spark, sf_dir).select("vec_id", "strong", "score_status")


@query(
    f"""WITH {_SCORED_SQL}, g AS (SELECT label, count(*) AS chunks, count(*) FILTER (WHERE strong) AS strong, count(*) FILTER (WHERE score_status = 'embedder_unavailable') AS unscored FROM scored GROUP BY label)
SELECT label, chunks, strong, unscored, CASE WHEN label = 9 THEN 'no_task' WHEN unscored = chunks THEN 'embedder_unavailable' WHEN unscored > 0 THEN 'partial' ELSE 'scored' END AS score_status FROM g"""
)
def score_status_summary(spark, sf_dir):
    g = _scored(spark, sf_dir).groupBy(F.col("ingest_id").alias("label")).agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if("strong").alias("strong"), F.count_if(F.col("score_status") == "embedder_unavailable").alias("unscored")
    )
    return g.withColumn("score_status", scoring.request_status(F.col("label") != 9, True, F.col("chunks"), F.col("unscored")))


# salience ------------------------------------------------------------------------------------------------------------

_THRESHOLD = 0.45


def _salience_sql(task: str) -> str:
    words = salience.task_words(task)
    stop = "[" + ", ".join(map(sql_text, salience.STOPWORDS)) + "]"

    def any_of(terms) -> str:
        return "(" + " OR ".join(f"starts_with(lo, {sql_text(t[1:])})" if t[0] == "^" else f"contains(lo, {sql_text(t)})" for t in terms) + ")"

    plain = " OR ".join(f"({any_of(a)} AND {any_of(b)})" for a, b in salience.BOILERPLATE)
    count = lambda p: f"len(regexp_extract_all(t, {sql_text(p)}))"
    relevance = f"least(1.0, len(list_intersect(u, [{', '.join(map(sql_text, words))}])) / {min(2.0, float(len(words)))})" if words else "0.5"
    weights = (0.20, 0.25, 0.20, 0.25) if task else (0.35, 0.35, 0.30, 0.0)
    low_task = "WHEN rel < 0.2 AND NOT prose THEN 'low_task_relevance'" if task else ""
    return f"""
x0 AS (SELECT seq, is_noise, {_trim('data')} AS t FROM {SALIENCE_SQL}),
x1 AS (SELECT *, lower(t) AS lo, list_transform(regexp_extract_all(t, '{salience.TOKEN_PATTERN}'), lambda w: lower(w)) AS w, list_sort(list_distinct(regexp_extract_all(t, '(?s).'))) AS ch FROM x0),
x2 AS (SELECT *, len(w)::DOUBLE AS n, list_distinct(w) AS u, CASE WHEN length(t) > 0 THEN abs(list_sum(list_transform(ch, lambda c: (length(t) - length(replace(t, c, ''))) / length(t)::DOUBLE * log2((length(t) - length(replace(t, c, ''))) / length(t)::DOUBLE)))) ELSE 0.0 END AS h FROM x1),
x3 AS (SELECT *, least(1.0, h / 4.5) AS hn, len(u) / n AS uq, least(1.0, len(u) / n * 0.6 + len(list_filter(w, lambda z: NOT list_contains({stop}, z))) / n * 0.4) AS lex,
  least(1.0, ({count(salience.NUMBER_PATTERN)} * 2 + {count(salience.KEY_VALUE_PATTERN)} * 3 + {count(salience.IDENTIFIER_PATTERN)} * 2) / (n * 0.5 + 5.0)) AS ent,
  regexp_matches(upper(t), {sql_text('|'.join(salience.ALERT_TERMS))}) AS act, {relevance} AS rel FROM x2),
x4 AS (SELECT *, CASE WHEN ({plain}) AND NOT act THEN 0.60 ELSE 0.0 END AS plain, strlen(t) >= 70 AND n >= 10 AND lex >= 0.5 AND regexp_matches(t, '[.,;:]') AS prose,
  CASE WHEN act THEN 0.0 ELSE CASE WHEN strlen(t) >= 5 AND len(list_filter(ch, lambda c: contains(t, repeat(c, 5)))) > 0 THEN 0.35 ELSE 0.0 END + CASE WHEN uq < 0.35 AND n >= 6 THEN 0.35 ELSE 0.0 END END AS rep FROM x3),
x5 AS (SELECT *, greatest(0.0, least(1.0, {weights[0]}::DOUBLE * hn + {weights[1]}::DOUBLE * lex + {weights[2]}::DOUBLE * ent + {weights[3]}::DOUBLE * rel + CASE WHEN prose THEN 0.20 ELSE 0.0 END + CASE WHEN act THEN 0.30 ELSE 0.0 END - rep - plain)) AS score FROM x4),
metrics AS (SELECT seq, is_noise, h AS entropy, hn AS entropy_norm, CASE WHEN n > 0 THEN lex ELSE 0 END AS lexical_density, CASE WHEN n > 0 THEN ent ELSE 0 END AS entity_density, CASE WHEN n > 0 THEN rel ELSE 0 END AS task_relevance,
  CASE WHEN n > 0 THEN round(score, 3) ELSE 0 END AS salience_score, n > 0 AND score >= {_THRESHOLD} AS is_salient,
  CASE WHEN t = '' THEN 'empty_text' WHEN n = 0 THEN 'no_alphanumeric_tokens' WHEN score >= {_THRESHOLD} THEN NULL WHEN plain > 0 THEN 'boilerplate_system_log' WHEN rep > 0.2 THEN 'high_repetition_low_entropy'
  WHEN hn < 0.4 THEN 'low_shannon_entropy' {low_task} WHEN lex < 0.3 THEN 'low_lexical_density_boilerplate' ELSE 'below_salience_threshold' END AS discard_reason FROM x5)"""


def _salience(spark, sf_dir, task: str = "") -> DataFrame:
    options = filtering.FilterOptions(task=task, threshold=_THRESHOLD, include_discarded=True)
    return filtering.filter_chunks(samples.salience_lines(spark, sf_dir), options)


def _metric(name: str, task: str = "") -> None:
    def run(spark, sf_dir):
        return _salience(spark, sf_dir, task).select("seq", F.round(f"metrics.{name}", 6).alias(name))

    run.__name__ = name
    query(f"WITH {_salience_sql(task)} SELECT seq, round({name}, 6) AS {name} FROM metrics")(run)


for _name in ("entropy", "lexical_density", "entity_density"):
    _metric(_name)
for _name in ("task_relevance", "salience_score"):
    _metric(_name, samples.TASK)


@query(f"WITH {_salience_sql('')} SELECT seq, is_salient, discard_reason FROM metrics")
def salience_reason(spark, sf_dir):
    return _salience(spark, sf_dir).select("seq", "metrics.is_salient", "metrics.discard_reason")


@query(f"WITH {_salience_sql(samples.TASK)} SELECT count(*) AS total_evaluated, count(*) FILTER (WHERE is_salient) AS salient_count, count(*) FILTER (WHERE NOT is_salient) AS discarded_count, round(count(*) FILTER (WHERE NOT is_salient) / count(*), 3) AS noise_reduction_ratio FROM metrics")
def filter_summary(spark, sf_dir):
    return filtering.summary(_salience(spark, sf_dir, samples.TASK))


@query(
    f"""WITH {_salience_sql('')}, c AS (SELECT count(*) FILTER (WHERE is_noise AND NOT is_salient) AS noise_discarded, count(*) FILTER (WHERE is_noise AND is_salient) AS noise_kept,
count(*) FILTER (WHERE NOT is_noise AND is_salient) AS signal_kept, count(*) FILTER (WHERE NOT is_noise AND NOT is_salient) AS signal_discarded FROM metrics)
SELECT *, round(noise_discarded / (noise_discarded + noise_kept), 4) AS tnr, round(signal_kept / (signal_kept + signal_discarded), 4) AS tpr FROM c"""
)
def confusion_matrix(spark, sf_dir):
    return filtering.confusion(_salience(spark, sf_dir), F.col("is_noise"))


@query(
    """WITH l AS (SELECT list_sort(list(value)) AS v, len(list(value)) AS n FROM events WHERE value IS NOT NULL)
SELECT p AS percent, v[n * p // 100 + 1] AS value FROM l, (VALUES (50), (90), (95), (99)) AS t(p)"""
)
def latency_percentiles(spark, sf_dir):
    return filtering.distributed_percentiles(table(spark, sf_dir, "events"), "value", (50, 90, 95, 99))


# the log -------------------------------------------------------------------------------------------------------------


def _event_records(spark, sf_dir) -> DataFrame:
    """Events as sequenced records."""
    e = table(spark, sf_dir, "events")
    text = F.concat(F.col("event_type"), F.lit(" "), F.col("props"))
    rows = e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), text.alias("text"), F.lit("log").alias("type"), F.col("user_id").cast("string").alias("session"), F.lit("events").alias("source"))
    rows = rows.withColumn("id", content_id(F.col("text")))
    return log.sequenced(rows.withColumn("size", log.record_size(rows.columns)), ["event_id"])


_RECORDS_SQL = """
records AS (SELECT row_number() OVER (ORDER BY event_id) AS seq, event_id, ts, event_type || ' ' || props AS text,
  280 + strlen(event_type || ' ' || props) + 3 + strlen(user_id::VARCHAR) + 6 + 32 AS size FROM events)"""


@query(
    """SELECT doc_id, 280 + strlen(text) + 32 + 8 + strlen(source) + strlen(lang) + 3 + CASE WHEN doc_id % 2 = 0 THEN 8 ELSE 0 END AS size FROM documents"""
)
def record_sizes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(
        "doc_id", "text", "source", F.col("lang").alias("session"), F.lit("document").alias("type"), F.lit("txt").alias("format"), F.when(F.col("doc_id") % 2 == 0, 0.5).alias("task_score")
    )
    d = d.withColumn("id", content_id(F.col("text")))
    return d.select("doc_id", log.record_size(d.columns).alias("size"))


@query(f"WITH {_RECORDS_SQL} SELECT event_id, seq FROM records")
def buffer_sequence(spark, sf_dir):
    return _event_records(spark, sf_dir).select("event_id", "seq")


_CURSOR = log.Cursor("e0", acked_up_to=0, next_seq=1 << 60)
_ACKED = log.Cursor("e0", acked_up_to=120, next_seq=1 << 60)


@query(f"WITH {_RECORDS_SQL} SELECT seq, text FROM records WHERE seq > 10 ORDER BY seq LIMIT 256")
def drain_page(spark, sf_dir):
    return log.drain(_event_records(spark, sf_dir), _CURSOR, 10, 256).select("seq", "text")


@query(
    f"""WITH {_RECORDS_SQL}, p AS (SELECT seq FROM records WHERE seq > 120 ORDER BY seq LIMIT 256)
SELECT 'e0' AS epoch, (SELECT count(*) FROM p) AS chunks, (SELECT max(seq) FROM p) AS last_seq, (SELECT count(*) FROM records WHERE seq > 120) AS pending, (SELECT count(*) FROM records WHERE seq > 120) > 256 AS more"""
)
def drain_after_ack(spark, sf_dir):
    return log.page_summary(_event_records(spark, sf_dir), _ACKED, 10, 256)


@query(f"WITH {_RECORDS_SQL} SELECT seq, text FROM (SELECT * FROM records WHERE seq > 500 ORDER BY seq DESC LIMIT 300)")
def query_since_seq(spark, sf_dir):
    return log.query(_event_records(spark, sf_dir), 300, None, 500).select("seq", "text")


@query(
    f"""WITH {_RECORDS_SQL}, m AS (SELECT quantile_disc(ts, 0.9) AS cutoff FROM events)
SELECT seq FROM (SELECT seq FROM records WHERE seq > coalesce((SELECT max(seq) FROM records, m WHERE ts < cutoff), 0) ORDER BY seq DESC LIMIT 100)"""
)
def query_suffix_ts(spark, sf_dir):
    cutoff = table(spark, sf_dir, "events").selectExpr("percentile_disc(0.9) WITHIN GROUP (ORDER BY unix_micros(CAST(ts AS TIMESTAMP))) AS c").first()[0]
    return log.query(_event_records(spark, sf_dir), 100, F.timestamp_micros(F.lit(int(cutoff)))).select("seq")


@query(
    f"""WITH {_RECORDS_SQL} SELECT count(*) AS chunks, count(*) FILTER (WHERE seq > 120) AS pending_chunks, count(*) FILTER (WHERE seq <= 120) AS acked_chunks, sum(size)::BIGINT AS used_bytes,
sum(size) FILTER (WHERE seq > 120)::BIGINT AS pending_bytes, sum(size) FILTER (WHERE seq <= 120)::BIGINT AS reclaimable_bytes, min(seq) AS oldest_seq, max(seq) AS newest_seq,
67108864::BIGINT AS capacity_bytes, (67108864 - sum(size))::BIGINT AS free_bytes, round(sum(size) / 67108864.0::DOUBLE * 100, 2) AS utilization_percent FROM records"""
)
def buffer_stats(spark, sf_dir):
    return log.stats(_event_records(spark, sf_dir), _ACKED, CONFIG.capacity_bytes).drop("epoch", "acked_up_to", "next_seq")


@query(
    f"""WITH {_RECORDS_SQL}, s AS (SELECT epoch(date_trunc('second', ts))::BIGINT AS second, sum(size) AS bytes FROM records GROUP BY 1)
SELECT second, sum(bytes) OVER (ORDER BY second RANGE BETWEEN 4 PRECEDING AND CURRENT ROW)::DOUBLE / 5 / 1024.0 AS kbps FROM s"""
)
def ingest_rate(spark, sf_dir):
    return log.ingest_rate(_event_records(spark, sf_dir))


_SMALL = 20_000


def _admission(spark, sf_dir) -> DataFrame:
    """Documents as requests of one record each, one log per source, into logs of 20,000 bytes."""
    d = table(spark, sf_dir, "documents")
    return log.admit(d.select(F.col("source").alias("log"), F.col("doc_id").alias("ord"), F.array(F.octet_length("text").cast("long") + 280).alias("sizes")), _SMALL)


@query(
    f"""WITH RECURSIVE d AS (SELECT source, doc_id, strlen(text) + 280 AS need, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents),
f AS (SELECT source, doc_id, need, n, CASE WHEN need > {_SMALL} THEN 0 ELSE need END AS used, CASE WHEN need > {_SMALL} THEN 'too_large' ELSE 'stored' END AS outcome FROM d WHERE n = 1
UNION ALL SELECT d.source, d.doc_id, d.need, d.n, CASE WHEN f.used + d.need > {_SMALL} THEN f.used ELSE f.used + d.need END,
  CASE WHEN d.need > {_SMALL} THEN 'too_large' WHEN f.used + d.need > {_SMALL} THEN 'full' ELSE 'stored' END FROM f JOIN d ON d.source = f.source AND d.n = f.n + 1)
SELECT source, doc_id, outcome, used::BIGINT AS used FROM f"""
)
def admission_backpressure(spark, sf_dir):
    return _admission(spark, sf_dir).select(F.col("log").alias("source"), F.col("ord").alias("doc_id"), "outcome", "used")


# the whole plan ------------------------------------------------------------------------------------------------------


@query(
    f"""WITH {_entries(NOISY_SQL, 'doc_id')}, {_reasons()}, c AS (SELECT doc_id, {_COUNTS} FROM reasons GROUP BY doc_id)
SELECT c.doc_id, d.source, d.lang AS session, 'no_task' AS score_status, kept AS accepted, 0::BIGINT AS strong, kept AS weak, blank, separator, heartbeat, duplicate
FROM c JOIN documents d ON d.doc_id = c.doc_id"""
)
def ingest_response(spark, sf_dir):
    wide = EngineConfig(chunk_max_bytes=1 << 30)
    result = plan.ingest(samples.noisy_logs(spark, sf_dir), wide, None, ids=F.concat(F.lit("m"), F.col("ingest_id")))
    r = plan.responses(result, wide, enabled=False)
    return r.select(_key("doc_id"), "source", "session", "score_status", "accepted", "strong", "weak", "discarded.*")


@query()
def ingest_records(spark, sf_dir):
    """Documents as txt requests through the whole plan, parts and all: records with numbers in order of doc_id."""
    docs = table(spark, sf_dir, "documents").select(*samples.request("document", F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text"), fmt=F.lit("txt")))
    result = plan.ingest(docs, CONFIG, None, ids=F.concat(F.lit("m"), F.col("ingest_id")))
    records = result.records.withColumns({"doc_id": F.col("ingest_id").cast("long"), "part": F.coalesce("part", F.lit(0))})
    return log.sequenced(records, ["doc_id", "pos", "part"]).select("doc_id", "pos", "part", "seq", "id", "size")


@query(
    f"""WITH n AS (SELECT conv_id, count(*) FILTER (WHERE NOT ({_blank('text')})) AS chunks FROM conversations GROUP BY conv_id),
r AS (SELECT conv_id, chunks, unnest(range(0, CASE WHEN conv_id % 5 = 0 THEN 2 ELSE 1 END)) AS copy FROM n)
SELECT conv_id, chunks, (coalesce(sum(chunks) OVER (ORDER BY conv_id, copy ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1)::BIGINT AS first_seq FROM r"""
)
def stream_ingest(spark, sf_dir):
    """Conversations as JSON requests in the lines of files, every fifth one twice, streamed into a log: equal requests are
    stored each, in the order of lines, and a request's chunks have neighbouring numbers."""
    root = f"{shared_root(spark)}/textmill/stream-{uuid.uuid4().hex}"
    talks = samples.dialogues(spark, sf_dir).withColumn("n", F.col("ingest_id").cast("long"))
    talks = talks.withColumn("copy", F.explode(F.sequence(F.lit(0), F.when(F.col("n") % 5 == 0, 1).otherwise(0)))).orderBy("n", "copy")
    talks.select(F.to_json(F.struct("type", "source", F.col("ingest_id").alias("session"), "turns")).alias("value")).write.text(f"{root}/in")
    engine = Engine(spark, f"{root}/log", EngineConfig(embed_provider="none", chunk_max_bytes=1 << 30, capacity_mb=1 << 20))
    ingest_stream(json_stream(spark, f"{root}/in", 1 << 20), engine, f"{root}/checkpoint").awaitTermination()
    by_request = engine.records.groupBy("ingest_id", F.col("session").cast("long").alias("conv_id")).agg(F.count(F.lit(1)).alias("chunks"), F.min("seq").alias("first_seq"), (F.max("seq") - F.min("seq") + 1).alias("span"))
    return by_request.filter("span = chunks").select("conv_id", "chunks", "first_seq")


@query(f"SELECT doc_id, {_blank('text')} AS blank FROM documents")
def blank_texts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", is_blank(F.col("text")).alias("blank"))
