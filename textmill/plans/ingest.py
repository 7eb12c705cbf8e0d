"""The ingest plan: requests -> validated -> candidates -> floored -> scored -> records, responses, rejections."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISCARD_REASONS, EngineConfig
from ..functions.text import content_id, let
from ..operators import chunking, floor, scoring
from ..operators.log import record_size
from ..sources.requests import validate
from ..storage import written


def memory_id() -> Column:
    """A time-ordered UUID (version 7): milliseconds, then what a random one has at those places."""
    ms = F.lower(F.lpad(F.hex(F.unix_millis(F.current_timestamp())), 12, "0"))
    part = lambda at, n: F.substring(ms, at, n)
    return let(F.uuid(), lambda u: F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-7"), F.substring(u, 16, 3), F.lit("-"), F.substring(u, 20, 17)))


@dataclass
class Ingested:
    """rows: candidates of valid requests with their reasons; records: what is to be stored (before sequencing);
    requests: valid requests with memory_id; rejected: the others with their error."""

    rows: DataFrame
    records: DataFrame
    requests: DataFrame
    rejected: DataFrame


def _request_part(requests: DataFrame) -> DataFrame:
    return requests.select("ingest_id", "memory_id", "type", "format", "source", "session", "task")


def ingest(requests: DataFrame, config: EngineConfig | None = None, embedder: scoring.Embedder | None = None, ids: Column | None = None) -> Ingested:
    """ids: an expression for memory_id instead of new ones, for tests and replays. Requests with their ids and scored
    records are written to the shared folder, so that neither ids nor embeddings are made twice."""
    config = config or EngineConfig()
    checked = validate(requests, config)
    valid = checked.filter("error IS NULL").drop("error")
    valid = valid.withColumn("memory_id", memory_id() if ids is None else ids)
    valid = written(valid, "requests") if ids is None else valid
    rejected = checked.filter("error IS NOT NULL").select("ingest_id", "error.*")
    rows = floor.floored(chunking.candidates(valid, config.chunk_max_bytes), config)
    scored = scoring.score(floor.kept(rows), config, embedder)
    records = records_of(written(scored, "scored") if embedder is not None else scored)
    return Ingested(rows, records, valid, rejected)


def records_of(scored: DataFrame) -> DataFrame:
    """The record's fields, its size, and ingest_id, pos, part to order it by."""
    r = scored.withColumn("id", content_id(F.col("text")))
    return r.select(
        *"ingest_id pos id memory_id text type format source session speaker turn_id parent_id part parts heading ts task task_score strong score_status".split(),
        record_size(r.columns).alias("size"),
    )


def responses(result: Ingested, config: EngineConfig, enabled: bool) -> DataFrame:
    """One row per valid request: labels, status, accepted, strong, weak, unscored, discarded by reason. With seq among
    the records: first_seq and last_seq too."""
    counted = floor.counts(result.rows, "ingest_id").drop("kept").withColumnRenamed("ingest_id", "c_id")
    seqs = [F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")] if "seq" in result.records.columns else []
    stored = result.records.groupBy(F.col("ingest_id").alias("r_id")).agg(
        F.count(F.lit(1)).alias("accepted"), F.count_if("strong").alias("strong"), F.count_if(F.col("score_status") == "embedder_unavailable").alias("unscored"), *seqs
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = _request_part(result.requests).join(counted, F.col("ingest_id") == F.col("c_id"), "left").join(stored, F.col("ingest_id") == F.col("r_id"), "left")
    out = joined.select(
        *"ingest_id memory_id type format source session task".split(),
        *[zero(c) for c in ("accepted", "strong", "unscored")],
        *([zero("first_seq"), zero("last_seq")] if seqs else []),
        F.struct(*[zero(r) for r in DISCARD_REASONS]).alias("discarded"),
    )
    has_task = F.coalesce(F.col("task"), F.lit("")) != ""
    return out.withColumns(
        {
            "weak": F.col("accepted") - F.col("strong"),
            "strong_threshold": F.lit(config.strong_threshold),
            "score_status": scoring.request_status(has_task, enabled, F.col("accepted"), F.col("unscored")),
        }
    )


def telemetry(answers: DataFrame) -> DataFrame:
    """Cumulative counters over all responses."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return answers.agg(
        F.count(F.lit(1)).alias("requests"),
        total("accepted").alias("chunks_accepted"),
        total("strong").alias("chunks_strong"),
        total("unscored").alias("chunks_unscored"),
        *[total(f"discarded.{r}").alias(f"discarded_{r}") for r in DISCARD_REASONS],
    )


def in_order(records: DataFrame) -> Window:
    return Window.partitionBy("ingest_id").orderBy("pos", F.coalesce("part", F.lit(0)))
