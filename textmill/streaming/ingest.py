"""Streams of requests into the engine's log, and of the log to a sink."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.requests import read_json
from ..storage import written
from .push import Page, Transport


def json_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """Files of JSON lines, a request each: file, block (where the task's part of the file begins), json."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("json"))


def numbered(batch: DataFrame) -> DataFrame:
    """file, block, json in the order of lines within a block. ingest_id: the file, the block and the line's place in it,
    with zeros in front, so that ids stand in the order of lines; equal lines are requests of their own."""
    rows = written(batch.withColumn("__row", F.monotonically_increasing_id()), "lines")
    first = F.broadcast(rows.groupBy("file", "block").agg(F.min("__row").alias("__first")))  # a row per block of a batch's files
    digits = lambda c, n: F.lpad(c.cast("string"), n, "0")
    place = F.concat_ws(":", "file", digits(F.col("block"), 15), digits(F.col("__row") - F.col("__first"), 12))
    return rows.join(first, ["file", "block"]).filter(F.length(F.trim("json")) > 0).select(place.alias("ingest_id"), "json")


def ingest_stream(stream: DataFrame, engine: Engine, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame], None] | None = None) -> StreamingQuery:
    """Every micro-batch is one ingest: the log keeps the number of the last, so a batch that is run again after a crash is
    not stored twice. Within a batch, requests are ordered by ingest_id; see numbered() for those of files."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if batch_id <= engine.last_batch:
            return
        answers, errors = engine.ingest(read_json(batch if "ingest_id" in batch.columns else numbered(batch)), batch_id)
        if on_batch:
            on_batch(answers, errors)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def push_stream(stream: DataFrame, engine: Engine, checkpoint: str, send: Transport | None = None, sleep: Callable[[float], None] = time.sleep, most_failures: int | None = None) -> StreamingQuery:
    """Ingests every micro-batch and delivers the log to PUSH_URL before the next one. What is not delivered stays in the
    log, whose cursor says so, and goes out with a later batch or by engine.pusher() after a restart."""
    pusher = engine.pusher(send)
    return ingest_stream(stream, engine, checkpoint, lambda answers, errors: pusher.empty(sleep, most_failures))


def drain_all(engine: Engine, page_size: int, take: Callable[[Page], None]) -> int:
    """The pull consumer: drains, hands pages over, acknowledges. How many chunks went out."""
    n = 0
    while (page := engine.drain(0, page_size)).chunks:
        take(page)
        n += engine.ack(page.epoch, page.last_seq)
    return n
