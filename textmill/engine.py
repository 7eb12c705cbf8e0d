"""The engine: ingest, drain, ack, query, filter, stats over one ordered log kept as Parquet.

Records are appended in batches, a folder each, named by their first number. The cursor is a small table of its own, a row
per change, the latest of which counts: numbers from its next_seq on don't exist, whatever files there are. So a batch that
was cut off, or is run again, overwrites itself; and resume() goes on where an engine stopped.
"""

from __future__ import annotations

import json
import time
from collections import Counter
from collections.abc import Mapping
from dataclasses import replace
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .config import EngineConfig
from .operators import filtering, log, scoring
from .operators.log import Cursor
from .plans import ingest as plan
from .storage import written
from .streaming.push import Page, Pusher, Transport, http_transport

VERSION = "1.0"


class Conflict(RuntimeError):
    """drain and ack belong to the pusher while push is configured."""


class Engine:
    def __init__(self, spark: SparkSession, root: str, config: EngineConfig | None = None, embedder: scoring.Embedder | None = None):
        self.spark, self.root, self.config = spark, root.rstrip("/"), config or EngineConfig()
        self.embedder = embedder if embedder is not None or self.config.embed_provider == "none" else scoring.HttpEmbedder.of(self.config)
        self.cursor = Cursor.new()
        #: the highest number that is evicted, and of a stream's batch that is stored
        self.evicted, self.last_batch = 0, -1
        self._changes = 0
        self._counters: Counter = Counter()
        self._started = time.time()

    @classmethod
    def resume(cls, spark: SparkSession, root: str, epoch: str, config: EngineConfig | None = None, embedder: scoring.Embedder | None = None) -> Engine:
        """An engine over the log of an earlier one; counters of requests begin anew."""
        e = cls(spark, root, config, embedder)
        last = spark.read.schema(_CURSOR).json(f"{e.root}/{epoch}/cursor").orderBy(F.col("change").desc()).first()
        e.cursor = Cursor(epoch, last["acked_up_to"], last["next_seq"])
        e._changes, e.evicted, e.last_batch = last["change"], last["evicted"], last["last_batch"]
        return e

    def _save(self) -> None:
        self._changes += 1
        row = (self._changes, self.cursor.acked_up_to, self.cursor.next_seq, self.evicted, self.last_batch)
        self.spark.createDataFrame([row], _CURSOR).coalesce(1).write.mode("append").json(f"{self.root}/{self.cursor.epoch}/cursor")

    # the log

    @property
    def records(self) -> DataFrame:
        """Held records."""
        if self.cursor.next_seq == 1:
            return self.spark.createDataFrame([], _RECORD)
        files = self.spark.read.schema(_RECORD).option("recursiveFileLookup", "true").parquet(f"{self.root}/{self.cursor.epoch}/records")
        return files.filter((F.col("seq") > self.evicted) & (F.col("seq") < self.cursor.next_seq))

    def ingest(self, requests: DataFrame, batch_id: int | None = None, summary: bool = False) -> tuple[DataFrame, DataFrame]:
        """requests (schema.REQUEST; an ord column orders them, else ingest_id). Responses of stored requests and the
        errors of all others. A request is stored as a whole or not at all."""
        result = plan.ingest(requests, self.config, self.embedder)
        order = "ord" if "ord" in requests.columns else "ingest_id"
        records = written(result.records, "records")
        sizes = records.groupBy(F.col("ingest_id").alias("i")).agg(F.collect_list("size").alias("sizes"))
        valid = result.requests.join(sizes, F.col("ingest_id") == F.col("i"), "left")
        ranked = log.sequenced(valid.select("ingest_id", F.col(order).alias("o"), F.coalesce("sizes", F.array().cast("array<long>")).alias("sizes")), ["o", "ingest_id"])
        held = self.records.agg(F.coalesce(F.sum(F.when(F.col("seq") > self.cursor.acked_up_to, F.col("size"))), F.lit(0)), F.coalesce(F.sum("size"), F.lit(0))).first()
        capacity = self.config.capacity_bytes
        # no acknowledgement arrives within a batch, and all that is acknowledged can be reclaimed
        verdicts = log.admit(ranked.select(F.lit("log").alias("log"), F.col("seq").alias("ord"), "sizes"), capacity - held[0])
        verdicts = written(verdicts.join(ranked.select(F.col("seq").alias("q"), "ingest_id"), F.col("ord") == F.col("q")).drop("q"), "verdicts")
        stored = verdicts.filter("outcome = 'stored'").select(F.col("ingest_id").alias("v_id"), (F.col("first_seq") + (self.cursor.next_seq - 1)).alias("v_first"))
        place = F.row_number().over(plan.in_order(records)) - 1
        numbered = records.withColumn("__place", place).join(stored, F.col("ingest_id") == F.col("v_id")).withColumn("seq", F.col("v_first") + F.col("__place"))
        path = f"{self.root}/{self.cursor.epoch}/records/{self.cursor.next_seq:020d}"
        final = numbered.withColumns({"ts": F.coalesce("ts", F.current_timestamp()), "stored_at": F.current_timestamp()}).select(*[f.name for f in _RECORD.fields])
        final.write.mode("overwrite").parquet(path)
        last = verdicts.agg(F.coalesce(F.max("last_seq"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("outcome") == "stored", F.col("needed"))), F.lit(0))).first()
        self.cursor = replace(self.cursor, next_seq=self.cursor.next_seq + last[0])
        self._counters["ingested_bytes"] += int(last[1])
        if (excess := held[1] + last[1] - capacity) > 0:
            left = log.evict_until(self.records, self.cursor, excess).agg(F.min("seq")).first()[0]
            self.evicted = max(self.evicted, (left or self.cursor.next_seq) - 1)
        self.last_batch = self.last_batch if batch_id is None else batch_id
        self._save()
        back = self.spark.read.schema(_RECORD).parquet(path)
        done = replace(result, records=back, requests=result.requests.join(stored, F.col("ingest_id") == F.col("v_id"), "left_semi"))
        answers = plan.responses(done, self.config, self.embedder is not None).withColumn("epoch", F.lit(self.cursor.epoch))
        if not summary:
            chunks = back.groupBy(F.col("ingest_id").alias("b_id")).agg(F.sort_array(F.collect_list(F.struct("seq", "id", "text", "task_score", "strong", "score_status"))).alias("chunks"))
            answers = answers.join(chunks, F.col("ingest_id") == F.col("b_id"), "left").drop("b_id")
        answers = written(answers, "responses")
        self._counters.update(plan.telemetry(answers).first().asDict())
        full = F.col("outcome") == "full"
        too_large = F.col("needed") > capacity
        refused = verdicts.filter("outcome <> 'stored'").select(
            "ingest_id",
            F.when(full | ~too_large, 503).otherwise(413).alias("status"),
            F.when(too_large, "exceeds_buffer_capacity").otherwise("buffer_full").alias("code"),
            F.lit(None).cast("string").alias("field"),
            F.lit("nothing of this request was stored").alias("message"),
        )
        refused = written(refused, "refused")
        for r in refused.groupBy("code").count().collect():  # two codes
            self._counters["backpressure_hits"] += r["count"]
            self._counters[f"backpressure_{r['code']}"] += r["count"]
        # only a buffer that is full empties in time
        wait = F.when(F.col("status") == 503, self.config.backpressure_retry_after_s)
        return answers, result.rejected.unionByName(refused).withColumn("retry_after_s", wait)

    def _page(self, after: int, most: int) -> Page:
        rows = log.drain(self.records, self.cursor, after, most + 1).collect()  # a page
        pending = self.records.filter(F.col("seq") > self.cursor.acked_up_to).count()
        return Page(self.cursor.epoch, [r.asDict(recursive=True) for r in rows[:most]], pending, len(rows) > most)

    def _pulled(self) -> None:
        if self.config.push_url:
            raise Conflict("push is configured: the pusher drains and acknowledges")

    def drain(self, after_seq: int = 0, most: int | None = None) -> Page:
        self._pulled()
        most = self.config.drain_max_default if most is None else most
        if most < 1 or after_seq < 0:
            raise ValueError("max must be at least 1 and after_seq at least 0")
        return self._page(after_seq, min(most, self.config.drain_max_limit))

    def ack(self, epoch: str, up_to_seq: int) -> int:
        self._pulled()
        return self._ack(epoch, up_to_seq)

    def _ack(self, epoch: str, up_to_seq: int) -> int:
        after = self.cursor.ack(epoch, up_to_seq)
        n = log.newly_acked(self.records, self.cursor, after).first()[0] if after != self.cursor else 0
        self.cursor = after
        self._save()
        return n

    def evict_acked(self) -> int:
        n = self.records.filter(F.col("seq") <= self.cursor.acked_up_to).count()
        self.evicted = max(self.evicted, self.cursor.acked_up_to)
        self._save()
        return n

    def query(self, limit: int = 0, cutoff=None, since_seq: int = 0) -> DataFrame:
        """The legacy view of the newest records: seq, timestamp, origin, data, size_bytes."""
        found = log.query(self.records, limit, cutoff, since_seq)
        return found.select("seq", F.col("ts").alias("timestamp"), F.col("source").alias("origin"), F.col("text").alias("data"), F.octet_length("text").alias("size_bytes"))

    def pusher(self, send: Transport | None = None) -> Pusher:
        """send: another way out than HTTP to PUSH_URL."""
        c = self.config
        send = send or http_transport(c.push_url, c.push_api_key, c.push_timeout_ms / 1000)

        def ack(epoch: str, up_to: int) -> None:
            self._ack(epoch, up_to)
            self.evict_acked()

        return Pusher(lambda n: self._page(0, n), ack, send, c.push_batch, c.push_interval_ms / 1000, c.push_max_backoff_ms / 1000, c.push_max_body_bytes)

    # filtering

    def filter(self, chunks: DataFrame | None, query: Mapping[str, str] | None = None, body: str | bytes | None = None, content_type: str | None = None) -> tuple[DataFrame, DataFrame]:
        """chunks (seq, data, maybe origin), or the items of a body, or the newest records where from_buffer is set.
        Kept chunks, and a summary."""
        try:
            fields = json.loads(body) if body else {}
        except ValueError:
            fields = {}
        options = filtering.FilterOptions.resolve(query or {}, fields if isinstance(fields, dict) else {}, self.config.filter_threshold)
        if options.from_buffer:
            cutoff = datetime.now(UTC) - timedelta(milliseconds=options.since_ms) if options.since_ms > 0 else None
            chunks = self.query(options.limit, cutoff, options.since_seq).select("seq", "origin", "data")
        elif chunks is None and body is not None:
            raw = body.encode() if isinstance(body, str) else body
            bodies = self.spark.createDataFrame([(bytearray(raw), content_type)], "body binary, content_type string")
            chunks = filtering.body_items(bodies, options, "body", "content_type")
        elif chunks is None:
            raise ValueError("no chunks to filter")
        parted = filtering.partition_oversized(chunks, options)
        everything = written(filtering.filter_chunks(parted, options.with_(include_discarded=True)), "filtered")
        total = filtering.summary(everything)
        seen = total.first()
        if seen:
            self._counters.update({"filter_evaluated": seen["total_evaluated"], "filter_salient": seen["salient_count"], "filter_discarded": seen["discarded_count"]})
        return (everything if options.include_discarded else everything.filter("metrics.is_salient")), total

    # telemetry

    def stats(self) -> dict:
        out = log.stats(self.records, self.cursor, self.config.capacity_bytes).first().asDict()
        out |= {"backpressure_hits": 0, "backpressure_buffer_full": 0, "backpressure_exceeds_buffer_capacity": 0} | self._counters
        # of records that were never acknowledged none is dropped, by design
        out |= {"last_seq": self.cursor.next_seq - 1, "total_ingested_count": self.cursor.next_seq - 1, "total_ingested_bytes": self._counters["ingested_bytes"], "evicted_acked_count": self.evicted, "dropped_packets": 0, "dropped_bytes": 0}
        now = int(time.time())
        recent = self.records.filter(F.unix_seconds("stored_at") > now - log.RATE_SECONDS).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        out |= {"ingestion_rate_kbps": recent / log.RATE_SECONDS / 1024.0, "uptime_seconds": time.time() - self._started}
        if evaluated := self._counters["filter_evaluated"]:
            out["filter_noise_reduction_ratio"] = self._counters["filter_discarded"] / evaluated
        return out

    def health(self) -> dict:
        return {"status": "ok", "version": VERSION, "epoch": self.cursor.epoch, "push": bool(self.config.push_url), "embedder": "none" if self.embedder is None else self.config.embed_provider}


_CURSOR = T.StructType([T.StructField(c, T.LongType()) for c in ("change", "acked_up_to", "next_seq", "evicted", "last_batch")])

_RECORD = T.StructType(
    [
        T.StructField("ingest_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        *[T.StructField(c, T.StringType()) for c in "id memory_id text type format source session speaker turn_id parent_id".split()],
        T.StructField("part", T.IntegerType()),
        T.StructField("parts", T.IntegerType()),
        T.StructField("heading", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("task", T.StringType()),
        T.StructField("task_score", T.DoubleType()),
        T.StructField("strong", T.BooleanType()),
        T.StructField("score_status", T.StringType()),
        T.StructField("size", T.LongType()),
        T.StructField("stored_at", T.TimestampType()),
    ]
)
