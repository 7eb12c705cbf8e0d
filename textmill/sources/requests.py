"""Requests: JSON bodies, files with labels, format detection, validation. Bad requests become rows, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema
from ..config import FORMATS, TYPES, EngineConfig
from ..functions.text import is_blank, let, nonempty, trim

#: Which extensions and media types mean which format.
EXTENSIONS = {
    "txt": ("txt", "text", "log"),
    "md": ("md", "markdown"),
    "csv": ("csv", "tsv"),
    "xml": ("xml", "rss", "atom", "svg"),
    "pdf": ("pdf",),
    "json": ("json", "ndjson", "jsonl"),
}
MEDIA_TYPES = {
    "txt": ("text/plain",),
    "md": ("text/markdown", "text/x-markdown"),
    "csv": ("text/csv", "application/csv"),
    "xml": ("application/xml", "text/xml"),
    "pdf": ("application/pdf",),
    "json": ("application/json", "application/x-ndjson"),
}


def _one_of(value: Column, table: dict[str, tuple[str, ...]]) -> Column:
    found = F.lit(None).cast("string")
    for fmt, names in table.items():
        found = F.when(value.isin(*names), F.lit(fmt)).otherwise(found)
    return found


def detect_format(filename: Column, content_type: Column, sample: Column) -> Column:
    """By extension, then media type, then the first and last characters of the body; txt if none of them tells."""
    base = F.regexp_extract(F.coalesce(filename, F.lit("")), r"([^/]*)\z", 1)
    extension = F.lower(F.regexp_extract(base, r"\.([^.]*)\z", 1))
    media = F.lower(trim(F.split_part(F.coalesce(content_type, F.lit("")), F.lit(";"), F.lit(1))))
    body = trim(F.coalesce(sample, F.lit("")))

    def wrapped(a: str, b: str) -> Column:
        return body.startswith(a) & body.endswith(b)

    sniffed = (
        F.when(body.startswith("%PDF-"), "pdf")
        .when(body.startswith("<?xml") | wrapped("<", ">"), "xml")
        .when(wrapped("{", "}") | wrapped("[", "]"), "json")
        .otherwise("txt")
    )
    return F.coalesce(_one_of(extension, EXTENSIONS), _one_of(media, MEDIA_TYPES), sniffed)


_JSON = T.StructType([f for f in schema.REQUEST.fields if f.name in schema.REQUEST_JSON])


def read_json(bodies: DataFrame) -> DataFrame:
    """bodies: ingest_id, json. Requests with the column error: invalid_json where a body is no JSON object, has an
    unknown key or a value of the wrong type. Keys are matched exactly."""
    parsed = F.from_json("json", _JSON, {"mode": "PERMISSIVE"})
    variant = F.try_parse_json("json")
    keys = F.json_object_keys("json")
    turn_keys = F.array(*[F.lit(f.name) for f in schema.TURN.fields])
    turns = F.from_json(F.get_json_object("json", "$.turns"), "array<map<string,string>>")
    odd_turn = F.exists(turns, lambda t: F.size(F.array_except(F.map_keys(t), turn_keys)) > 0)
    # from_json turns a value of another type into null, or into text: both show in the schema of the raw value
    kinds = F.array(*[F.schema_of_variant(F.try_variant_get(variant, f"$.{c}", "variant")) for c in schema.REQUEST_JSON if c != "turns"])
    odd_kind = F.exists(kinds, lambda k: ~k.isin("STRING", "VOID"))
    bad = (
        variant.isNull()
        | keys.isNull()
        | (F.size(F.array_except(keys, F.array(*[F.lit(c) for c in schema.REQUEST_JSON]))) > 0)
        | F.coalesce(odd_turn, F.lit(False))
        | F.coalesce(odd_kind, F.lit(False))
    )
    error = F.when(bad, _error(400, "invalid_json", None, "could not decode ingest request"))
    rows = bodies.select("ingest_id", "json", parsed.alias("p"), F.coalesce(error, _no_error()).alias("error"))
    return rows.select(
        "ingest_id",
        *[F.col(f"p.{c}").alias(c) for c in ("type", "source", "session", "task", "format", "text")],
        F.lit(None).cast("binary").alias("body"),
        F.lit(None).cast("string").alias("filename"),
        F.lit("application/json").alias("content_type"),
        F.col("p.speaker").alias("speaker"),
        F.col("p.turns").alias("turns"),
        "error",
    )


def read_files(spark: SparkSession, path: str, labels: dict[str, str], content_type: str | None = None) -> DataFrame:
    """Whole files as one request each; labels (type, source, session, task, format) hold for all of them."""
    label = lambda c: trim(F.lit(labels.get(c, ""))).alias(c)
    files = spark.read.format("binaryFile").load(path)
    return files.select(
        F.col("path").alias("ingest_id"),
        *[label(c) for c in ("type", "source", "session", "task", "format")],
        F.lit(None).cast("string").alias("text"),
        F.col("content").alias("body"),
        F.regexp_extract("path", r"([^/]*)\z", 1).alias("filename"),
        F.lit(content_type).cast("string").alias("content_type"),
        F.lit(None).cast("string").alias("speaker"),
        F.lit(None).cast(T.ArrayType(schema.TURN)).alias("turns"),
        _no_error().alias("error"),
    )


_ERROR_TYPE = "struct<status:int,code:string,field:string,message:string>"


def _no_error() -> Column:
    return F.lit(None).cast(_ERROR_TYPE)


def _error(status: int, code: str, field: str | Column | None, message: str) -> Column:
    field = field if isinstance(field, Column) else F.lit(field)
    return F.struct(F.lit(status).alias("status"), F.lit(code).alias("code"), field.cast("string").alias("field"), F.lit(message).alias("message")).cast(_ERROR_TYPE)


def validate(requests: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """requests (schema.REQUEST, maybe with error). Labels trimmed, shorthand dialogues as turns, formats resolved, and
    error: the first rule that a request breaks, or null. Labels are never guessed."""
    config = config or EngineConfig()
    r = requests if "error" in requests.columns else requests.withColumn("error", _no_error())
    is_json = F.lower(trim(F.split_part(F.coalesce("content_type", F.lit("application/json")), F.lit(";"), F.lit(1)))) == "application/json"
    r = r.withColumn("__json", is_json & F.col("body").isNull())
    for c in ("type", "source", "session", "task"):
        r = r.withColumn(c, trim(F.coalesce(F.col(c), F.lit(""))))
    for c in ("format", "text", "speaker"):
        r = r.withColumn(c, F.coalesce(F.col(c), F.lit("")))
    r = r.withColumn("__turns", F.greatest(F.size(F.coalesce("turns", F.array().cast(T.ArrayType(schema.TURN)))), F.lit(0)))
    talk = F.col("type") == "dialogue"
    single = talk & (F.col("__turns") == 0) & F.col("__json") & ~is_blank(F.col("speaker"))
    one = F.array(F.struct(trim(F.col("speaker")).alias("speaker"), F.col("text").alias("text"), F.lit(None).cast("string").alias("turn_id"), F.lit(None).cast("timestamp").alias("ts")))
    both = talk & (F.col("__turns") > 0) & ((F.col("text") != "") | (F.col("speaker") != ""))
    r = r.withColumn("__both", both).withColumn("__misplaced", ~talk & ((F.col("__turns") > 0) | (F.col("speaker") != "")))
    tidy = lambda t: F.struct(trim(F.coalesce(t["speaker"], F.lit(""))).alias("speaker"), F.coalesce(t["text"], F.lit("")).alias("text"), t["turn_id"].alias("turn_id"), t["ts"].alias("ts"))
    r = r.withColumn("turns", F.when(single, one).when(talk, F.transform("turns", tidy)))
    r = r.withColumn("__text", F.when(single, "").otherwise(F.col("text"))).withColumn("__none", talk & (F.col("__turns") == 0) & ~single)
    speakers, ids = F.transform("turns", lambda t: t["speaker"]), F.transform("turns", lambda t: nonempty(t["turn_id"]))
    repeats = let(ids, lambda all_ids: F.transform(all_ids, lambda x, i: F.when(x.isNotNull() & (F.array_position(all_ids, x) - 1 < i), i)))
    again = F.get(F.filter(repeats, lambda i: i.isNotNull()), 0)
    mute = F.array_position(speakers, "") - 1
    turn_error = (
        F.when((mute >= 0) & (again.isNull() | (mute <= again)), _error(400, "missing_label", F.concat(F.lit("turns["), mute.cast("string"), F.lit("].speaker")), "a turn has no speaker"))
        .when(again.isNotNull(), _error(400, "invalid_label", F.concat(F.lit("turns["), again.cast("string"), F.lit("].turn_id")), "a turn_id repeats"))
    )
    content = F.coalesce(F.col("body").cast("string"), F.col("__text"))
    r = r.withColumn("__detected", detect_format(F.col("filename"), F.when(F.col("body").isNotNull(), F.col("content_type")), content))
    known = F.when(F.col("format") != "", F.col("format")).otherwise(F.col("__detected"))
    doc = F.col("type") == "document"
    error = F.coalesce(
        F.when(F.octet_length(F.coalesce(F.col("body"), F.col("text").cast("binary"))) > config.max_body_bytes, _error(413, "payload_too_large", None, "request body exceeds MAX_BODY_BYTES")),
        F.col("error"),
        F.when(F.col("__json") & doc & (F.col("format") == "pdf"), _error(400, "invalid_label", "format", "pdf cannot be sent inside JSON")),
        F.when(F.col("type") == "", _error(400, "missing_label", "type", "'type' is required")),
        F.when(~F.col("type").isin(*TYPES), _error(400, "invalid_label", "type", "unknown type")),
        F.when(F.col("source") == "", _error(400, "missing_label", "source", "'source' is required")),
        F.when(F.col("session") == "", _error(400, "missing_label", "session", "'session' is required")),
        F.when(F.col("__misplaced"), _error(400, "invalid_label", "turns", "'turns' and 'speaker' are only valid for type dialogue")),
        F.when(talk & ~F.col("__json"), _error(400, "invalid_label", "type", "dialogue must be sent as JSON")),
        F.when(F.col("__both"), _error(400, "invalid_label", "turns", "send either 'turns' or 'speaker' + 'text'")),
        F.when(F.col("__none"), _error(400, "missing_label", "speaker", "dialogue needs 'turns', or 'speaker' + 'text'")),
        F.when(talk, turn_error),
        F.when(doc & ~known.isin(*FORMATS), _error(400, "invalid_label", "format", "unknown document format")),
        F.when(~talk & is_blank(content), _error(400, "empty_input", "text", "no content to ingest")),
        _no_error(),
    )
    out = r.withColumn("error", error).withColumn("format", F.when(doc, known)).withColumn("text", F.col("__text")).withColumn("speaker", F.when(~talk, F.col("speaker")))
    return out.drop(*[c for c in out.columns if c.startswith("__")])
