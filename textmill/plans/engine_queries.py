"""More queries of the catalogue: bounded parts, headings, requests, whole records, acknowledgement, eviction, filter inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import content_id
from ..operators import chunking, filtering, log, scoring
from ..sources import requests as sources
from . import ingest as plan
from . import samples
from .catalog import _ACKED, _COUNTS, _RECORDS_SQL, CONFIG, _entries, _event_records, _key, _reasons, _trim, query
from .samples import NOISY_SQL, table

LIMIT = CONFIG.chunk_max_bytes

# bounded parts -------------------------------------------------------------------------------------------------------


def _parts(spark, sf_dir, one: F.Column, times: F.Column):
    """Documents as one unit each, a repeated run of 32 digits, bounded."""
    units = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("ingest_id"), F.lit(0).alias("pos"), F.repeat(one, times.cast("int")).alias("text"))
    out = chunking.bound(units, LIMIT)
    return out.select(_key("doc_id"), "parent_id", "part", "parts", F.octet_length("text").alias("bytes"), content_id(F.col("text")).alias("id"))


_PART_ROWS = """
p AS (SELECT doc_id, t, CASE WHEN strlen(t) > {limit} THEN {parts} ELSE 1 END AS parts FROM u),
r AS (SELECT doc_id, t, parts, unnest(range(0, parts)) AS k FROM p),
x AS (SELECT doc_id, t, parts, k, CASE WHEN parts > 1 THEN {piece} ELSE t END AS piece FROM r)
SELECT doc_id, CASE WHEN parts > 1 THEN substr(sha256(t), 1, 32) END AS parent_id, CASE WHEN parts > 1 THEN k + 1 END::INTEGER AS part,
  CASE WHEN parts > 1 THEN parts END::INTEGER AS parts, strlen(piece)::INTEGER AS bytes, substr(sha256(piece), 1, 32) AS id FROM x"""


@query("WITH u AS (SELECT doc_id, repeat(md5(text), (20 + doc_id % 60)::INTEGER) AS t FROM documents)," + _PART_ROWS.format(limit=LIMIT, parts=f"ceil(strlen(t) / {LIMIT}.0)::INTEGER", piece=f"substr(t, k * {LIMIT} + 1, {LIMIT})"))
def bound_hard_cuts(spark, sf_dir):
    """Runs without any place to cut: pieces of the limit."""
    return _parts(spark, sf_dir, F.md5(F.col("text").cast("binary")), 20 + F.col("doc_id") % 60)


#: A sentence has 34 bytes, so 30 of them fit, less the blank at the end of a piece.
@query("WITH u AS (SELECT doc_id, repeat(md5(text) || '. ', (10 + doc_id % 90)::INTEGER) AS t FROM documents)," + _PART_ROWS.format(limit=LIMIT, parts="ceil(strlen(t) / (34 * 30.0))::INTEGER", piece="rtrim(substr(t, k * 34 * 30 + 1, 34 * 30))"))
def bound_sentences(spark, sf_dir):
    """Sentences: pieces end behind the last one that fits."""
    return _parts(spark, sf_dir, F.concat(F.md5(F.col("text").cast("binary")), F.lit(". ")), 10 + F.col("doc_id") % 90)


_TIDY = r"regexp_replace(l[i + 1], '\r$', '')"


@query(
    f"""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), r AS (SELECT doc_id, l, unnest(range(0, len(l))) AS i FROM d),
u AS (SELECT doc_id, l, i, i // 5 AS j, CASE WHEN i % 5 = 0 THEN repeat('#', (i // 5 % 3 + 1)::INTEGER) || ' L ' || {_TIDY} WHEN i % 7 = 0 THEN '```' || chr(10) || 'L ' || {_TIDY} || chr(10) || chr(10) || 'end' || chr(10) || '```' ELSE 'L ' || {_TIDY} END AS text FROM r),
h AS (SELECT doc_id, j, {_trim('text')} AS head FROM u WHERE i % 5 = 0),
p AS (SELECT u.doc_id, u.i, u.text, string_agg(h.head, ' > ' ORDER BY h.j) AS heading FROM u LEFT JOIN h ON h.doc_id = u.doc_id AND h.j >= u.j - u.j % 3 AND h.j <= u.j AND (u.i % 5 <> 0 OR h.j < u.j) GROUP BY ALL)
SELECT doc_id, i::INTEGER AS pos, heading, substr(sha256(text), 1, 32) AS id FROM p"""
)
def markdown_paths(spark, sf_dir):
    """Every line a unit: a heading of the first, second or third level by turns, a fenced block with a blank line in it,
    or a paragraph."""
    units = F.transform(
        F.split("text", "\n", -1),
        lambda x, i: F.when(i % 5 == 0, F.concat(F.element_at(F.array(F.lit("# L "), F.lit("## L "), F.lit("### L ")), (i / 5 % 3).cast("int") + 1), x))
        .when(i % 7 == 0, F.concat(F.lit("```\nL "), x, F.lit("\n\nend\n```")))
        .otherwise(F.concat(F.lit("L "), x)),
    )
    docs = table(spark, sf_dir, "documents").select(*samples.request("document", F.col("doc_id"), F.col("source"), F.col("lang"), F.array_join(units, "\n\n"), fmt=F.lit("md")))
    return chunking.units(docs).select(_key("doc_id"), "pos", "heading", content_id(F.col("text")).alias("id"))


@query(f"WITH {_entries('documents', 'doc_id')} SELECT doc_id, pos, substr(sha256(text), 1, 32) AS id FROM entries")
def raw_body_logs(spark, sf_dir):
    """Logs sent as raw bodies of plain text."""
    docs = table(spark, sf_dir, "documents").select(*samples.request("log", F.col("doc_id"), F.col("source"), F.col("lang"), F.lit(None).cast("string")), F.col("text").cast("binary").alias("raw"))
    sent = docs.withColumns({"body": F.col("raw"), "content_type": F.lit("text/plain; charset=utf-8")}).drop("raw")
    valid = sources.validate(sent, CONFIG).filter("error IS NULL").drop("error")
    return chunking.units(valid).select(_key("doc_id"), "pos", content_id(F.col("text")).alias("id"))


# requests ------------------------------------------------------------------------------------------------------------

_LABELS = '"type":"log","source":"s","session":"x"'
_BODIES = [
    f'{{{_LABELS},"text":"a"}}',
    "no json at all",
    f'{{{_LABELS},"text":"a","colour":"red"}}',
    f'{{{_LABELS},"text":7}}',
    f"[{{{_LABELS}}}]",
    f'{{{_LABELS},"text":" \\n "}}',
    '{"type":"dialogue","source":"s","session":"x","speaker":" ann ","text":"b"}',
    '{"type":"dialogue","source":"s","session":"x","turns":[{"speaker":"ann","text":"b","turn_id":"t"},{"speaker":"bob","text":"c","turn_id":"t"}]}',
    '{"type":"dialogue","source":"s","session":"x","turns":[{"speaker":"ann","text":"b"},{"speaker":" ","text":"c"}]}',
    '{"type":"dialogue","source":"s","session":"x","turns":[{"speaker":"ann","text":"b"}],"text":"c"}',
    '{"type":"document","source":"s","session":"x","format":"pdf","text":"c"}',
]
_ERRORS = [None, "invalid_json", "invalid_json", "invalid_json", "invalid_json", "empty_input:text", None, "invalid_label:turns[1].turn_id", "missing_label:turns[1].speaker", "invalid_label:turns", "invalid_label:format"]


@query(
    "SELECT event_id, CASE event_id % " + str(len(_BODIES)) + "".join(f" WHEN {k} THEN {'NULL' if e is None else samples.sql_text(e)}" for k, e in enumerate(_ERRORS))
    + f" END AS error, CASE WHEN event_id % {len(_BODIES)} = 6 THEN 'ann' END AS speaker FROM events"
)
def json_requests(spark, sf_dir):
    """Bodies of every kind, among them shorthand dialogues, whose one turn has a trimmed speaker."""
    body = F.element_at(F.array(*[F.lit(b) for b in _BODIES]), (F.col("event_id") % len(_BODIES) + 1).cast("int"))
    bodies = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("ingest_id"), body.alias("json"))
    checked = sources.validate(sources.read_json(bodies), CONFIG)
    error = F.concat_ws(":", "error.code", "error.field")
    one = F.when(F.col("error").isNull() & (F.col("type") == "dialogue"), F.col("turns")[0]["speaker"])
    return checked.select(_key("event_id"), F.when(error != "", error).alias("error"), one.alias("speaker"))


@query("SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN 413 END::INTEGER AS status, CASE WHEN strlen(text) > 2000 THEN 'payload_too_large' END AS code FROM documents")
def body_limits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(*samples.request("log", F.col("doc_id"), F.col("source"), F.col("lang"), F.col("text")))
    return sources.validate(docs, EngineConfig(max_body_bytes=2000)).select(_key("doc_id"), "error.status", "error.code")


@query("SELECT doc_id, true AS fine FROM documents")
def memory_ids(spark, sf_dir):
    """New ids have the form of a UUID of version 7, and no two are equal."""
    ids = table(spark, sf_dir, "documents").select("doc_id", plan.memory_id().alias("id"))
    form = F.col("id").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$")
    return ids.groupBy("id").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")).select("doc_id", (form & (F.col("n") == 1)).alias("fine"))


# records -------------------------------------------------------------------------------------------------------------


def _whole(spark, sf_dir):
    wide = EngineConfig(chunk_max_bytes=1 << 30)
    return plan.ingest(samples.noisy_logs(spark, sf_dir), wide, None, ids=F.concat(F.lit("m"), F.col("ingest_id"))), wide


@query(
    f"""WITH {_entries(NOISY_SQL, 'doc_id')}, {_reasons()}
SELECT r.doc_id, pos, substr(sha256(r.text), 1, 32) AS id, 'm' || r.doc_id AS memory_id, 'log' AS type, d.source, d.lang AS session, NULL::VARCHAR AS parent_id, NULL::INTEGER AS part, false AS strong, 'no_task' AS score_status,
  280 + 32 + strlen('m' || r.doc_id) + strlen(r.text) + 3 + strlen(d.source) + strlen(d.lang) + 7 AS size
FROM reasons r JOIN documents d ON d.doc_id = r.doc_id WHERE reason IS NULL"""
)
def record_fields(spark, sf_dir):
    r, _ = _whole(spark, sf_dir)
    return r.records.select(_key("doc_id"), "pos", "id", "memory_id", "type", "source", "session", "parent_id", "part", "strong", "score_status", "size")


@query(
    f"""WITH {_entries(NOISY_SQL, 'doc_id')}, {_reasons()}, c AS (SELECT {_COUNTS} FROM reasons)
SELECT (SELECT count(*) FROM documents) AS requests, kept AS chunks_accepted, 0::BIGINT AS chunks_strong, 0::BIGINT AS chunks_unscored, blank AS discarded_blank, separator AS discarded_separator,
  heartbeat AS discarded_heartbeat, duplicate AS discarded_duplicate FROM c"""
)
def telemetry_totals(spark, sf_dir):
    r, wide = _whole(spark, sf_dir)
    return plan.telemetry(plan.responses(r, wide, enabled=False))


class _Lengths:
    """Vectors (bytes, 1); refuses a batch that holds a text of a number of bytes that seven divides."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        sizes = [len(t.encode()) for t in texts]
        if any(n % 7 == 0 for n in sizes):
            raise scoring.EmbedError("a text is refused", rejected=True)
        return [[float(n), 1.0] for n in sizes]


@query(
    """WITH t AS (SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1)::INTEGER AS pos, strlen(text)::DOUBLE AS n FROM conversations),
s AS (SELECT conv_id, pos, CASE WHEN n % 7 <> 0 THEN round((n * 4 + 1) / (sqrt(n * n + 1) * sqrt(17.0::DOUBLE)), 4) END AS task_score FROM t)
SELECT conv_id, pos, task_score, coalesce(task_score >= 0.30, false) AS strong, CASE WHEN task_score IS NULL THEN 'embedder_unavailable' ELSE 'scored' END AS score_status FROM s"""
)
def embedder_fallback(spark, sf_dir):
    """Batches that the embedder refuses are tried text by text; only the refused texts stay without a score."""
    chunks = chunking.units(samples.dialogues(spark, sf_dir)).withColumn("task", F.lit("find"))
    return scoring.score(chunks, CONFIG, _Lengths()).select(_key("conv_id"), "pos", "task_score", "strong", "score_status")


# the log -------------------------------------------------------------------------------------------------------------

_ACKS = (120, 120, 40, 500)


@query(
    f"""WITH {_RECORDS_SQL}, a AS (SELECT * FROM (VALUES (0, 0, 120), (1, 120, 120), (2, 120, 120), (3, 120, 500)) AS v(step, before, after))
SELECT step::INTEGER AS step, after::BIGINT AS acked_up_to, (SELECT count(*) FROM records WHERE seq > before AND seq <= after) AS acked FROM a"""
)
def ack_counts(spark, sf_dir):
    """Cumulative acknowledgements, one of them old and one repeated."""
    records, cursor, out = _event_records(spark, sf_dir), log.Cursor("e0", 0, 1 << 60), None
    for step, up_to in enumerate(_ACKS):
        after = cursor.ack("e0", up_to)
        one = log.newly_acked(records, cursor, after).select(F.lit(step).alias("step"), F.lit(after.acked_up_to).cast("long").alias("acked_up_to"), "acked")
        out, cursor = one if out is None else out.unionByName(one), after
    return out


@query(f"WITH {_RECORDS_SQL}, s AS (SELECT seq, coalesce(sum(size) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS freed FROM records) SELECT seq FROM s WHERE seq > 120 OR freed >= 20000")
def evict_for_room(spark, sf_dir):
    """Acknowledged records go, oldest first, until 20,000 bytes are free."""
    return log.evict_until(_event_records(spark, sf_dir), _ACKED, 20000).select("seq")


@query(f"WITH {_RECORDS_SQL} SELECT seq FROM records WHERE seq > 120")
def evict_acked(spark, sf_dir):
    return log.evict_acked(_event_records(spark, sf_dir), _ACKED).select("seq")


# filtering -----------------------------------------------------------------------------------------------------------


@query(
    """WITH d AS (SELECT doc_id // 20 AS batch, row_number() OVER (PARTITION BY doc_id // 20 ORDER BY doc_id) AS seq, CASE WHEN doc_id % 3 = 0 THEN '' ELSE source END AS origin, lang || ' "' || doc_id || '"' AS data FROM documents)
SELECT batch, seq, CASE WHEN batch % 2 = 1 AND origin = '' THEN 'filter_stream' ELSE origin END AS origin, data FROM d"""
)
def filter_items(spark, sf_dir):
    """Filter bodies: objects with items (data in one of three fields), or arrays, whose items have a default origin."""
    data = F.concat(F.col("lang"), F.lit(' "'), F.col("doc_id").cast("string"), F.lit('"'))
    field = lambda k: F.when(F.col("doc_id") % 3 == k, data)
    item = F.struct(F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.col("source")).alias("origin"), field(0).alias("data"), field(1).alias("payload"), field(2).alias("text"))
    batches = table(spark, sf_dir, "documents").groupBy(F.floor(F.col("doc_id") / 20).alias("batch")).agg(F.sort_array(F.collect_list(F.struct("doc_id", item.alias("item")))).alias("rows"))
    items = F.to_json(F.transform("rows", lambda r: r["item"]))
    body = F.when(F.col("batch") % 2 == 1, items).otherwise(F.concat(F.lit('{"items":'), items, F.lit("}")))
    return filtering.body_items(batches.select("batch", body.alias("body")), filtering.FilterOptions()).select("batch", "seq", "origin", "data")


@query("SELECT doc_id AS seq, printf('chnk-%03d', doc_id) AS chunk_id, CASE WHEN doc_id % 4 = 0 THEN 'filter_stream' ELSE source END AS source FROM documents")
def filter_chunk_ids(spark, sf_dir):
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), F.when(F.col("doc_id") % 4 != 0, F.col("source")).alias("origin"), F.md5(F.col("text").cast("binary")).alias("data"))
    return filtering.filter_chunks(chunks, filtering.FilterOptions(include_discarded=True)).select("seq", "chunk_id", "source")


@query(
    """WITH u AS (SELECT doc_id, repeat(md5(text), (100 + doc_id % 60)::INTEGER) AS t FROM documents),
p AS (SELECT doc_id, t, ceil(strlen(t) / 4096.0)::INTEGER AS parts FROM u), r AS (SELECT doc_id, t, parts, unnest(range(0, parts)) AS k FROM p)
SELECT row_number() OVER (ORDER BY doc_id, k) AS seq, CASE WHEN parts > 1 THEN strlen(substr(t, k * 4096 + 1, 4096)) END::INTEGER AS size_bytes, substr(sha256(substr(t, k * 4096 + 1, 4096)), 1, 32) AS id FROM r"""
)
def oversized_chunks(spark, sf_dir):
    """Chunks over the size come as several, and all are numbered anew."""
    one = F.repeat(F.md5(F.col("text").cast("binary")), (100 + F.col("doc_id") % 60).cast("int"))
    chunks = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("seq"), one.alias("data"))
    return filtering.partition_oversized(chunks, filtering.FilterOptions()).select("seq", "size_bytes", content_id(F.col("data")).alias("id"))
