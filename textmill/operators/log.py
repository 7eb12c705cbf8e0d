"""The ordered log: sequencing, admission, paging, acknowledgement and its statistics."""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema
from ..functions.text import byte_size
from ..storage import written

QUERY_DEFAULT, QUERY_MOST = 100, 10_000
RATE_SECONDS = 5


class EpochMismatch(ValueError):
    """The acknowledgement is for another epoch."""


class AckAhead(ValueError):
    """The acknowledgement names a number that was never given out."""


@dataclass(frozen=True)
class Cursor:
    epoch: str
    acked_up_to: int = 0
    next_seq: int = 1

    @classmethod
    def new(cls) -> Cursor:
        return cls(uuid.uuid4().hex[:16])

    def ack(self, epoch: str, up_to: int) -> Cursor:
        """Cumulative; an older number changes nothing."""
        if epoch != self.epoch:
            raise EpochMismatch(epoch)
        if up_to >= self.next_seq:
            raise AckAhead(up_to)
        return replace(self, acked_up_to=max(up_to, self.acked_up_to))


def record_size(columns: list[str]) -> Column:
    """Bytes of a stored record: a slot, its strings, and a score if it has one. columns: those that the table has."""
    size = F.lit(schema.RECORD_SLOT_BYTES).cast("long")
    for c in schema.SIZED_FIELDS:
        if c in columns:
            size = size + byte_size(F.col(c))
    return size + F.when(F.col("task_score").isNotNull(), schema.SCORE_BYTES).otherwise(0) if "task_score" in columns else size


def sequenced(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """Adds seq: first, first + 1, ... in the given order, which must tell rows apart. Rows are range-partitioned and
    numbered within partitions; only the partitions' sizes meet in one place."""
    placed = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()), "sequence")
    part = F.shiftright("__row", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.withColumn("__before", before))  # a row per partition
    joined = placed.withColumn("__part", part).join(starts, "__part")
    seq = F.col("__row") - F.col("__first") + F.col("__before") + first
    return joined.withColumn("seq", seq).drop("__row", "__part", "__first", "__n", "__before")


_ADMITTED = "log string, ord long, records long, needed long, outcome string, first_seq long, last_seq long, used long, evicted long, pending long"


def admit(requests: DataFrame, capacity: int) -> DataFrame:
    """requests: log, ord, sizes (bytes of each record), and maybe ack_up_to (a cumulative acknowledgement that arrives
    just before). Per log, in order, a request is stored as a whole or not at all: too_large if it exceeds the capacity,
    full if it exceeds what is free or reclaimable; else the oldest acknowledged records go until it fits. A rejected
    request takes no room, so this is a fold, not a running sum: a task goes through its sorted rows once, with the sizes
    of one log's held records (capacity / 280 at most) as its state."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        log, held, used, acked, evicted, next_seq = None, deque(), 0, 0, 0, 1
        for b in batches:
            rows = []
            for r in b.itertuples(index=False):
                if r.log != log:
                    log, held, used, acked, evicted, next_seq = r.log, deque(), 0, 0, 0, 1
                # the oldest held record has the number next_seq - len(held)
                acked = max(acked, min(len(held), int(r.ack_up_to) - (next_seq - len(held)) + 1))
                needed = sum(map(int, r.sizes))
                reclaimable = sum(islice(held, acked)) if needed > capacity - used else 0
                first = last = 0
                if needed > capacity:
                    outcome = "too_large"
                elif needed > capacity - used + reclaimable:
                    outcome = "full"
                else:
                    outcome = "stored"
                    while capacity - used < needed:
                        used -= held.popleft()
                        acked -= 1
                        evicted += 1
                    held.extend(map(int, r.sizes))
                    used += needed
                    if len(r.sizes):
                        first, last = next_seq, next_seq + len(r.sizes) - 1
                        next_seq = last + 1
                rows.append((r.log, r.ord, len(r.sizes), needed, outcome, first, last, used, evicted, len(held) - acked))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in _ADMITTED.split(", ")])

    ack = F.col("ack_up_to") if "ack_up_to" in requests.columns else F.lit(0)
    slim = requests.select(
        F.coalesce(F.col("log").cast("string"), F.lit("")).alias("log"),
        F.col("ord").cast("long").alias("ord"),
        F.coalesce(F.col("sizes").cast("array<long>"), F.array().cast("array<long>")).alias("sizes"),
        F.coalesce(ack.cast("long"), F.lit(0)).alias("ack_up_to"),
    )
    return slim.repartition("log").sortWithinPartitions("log", "ord").mapInPandas(run, _ADMITTED)


def drain(log: DataFrame, cursor: Cursor, after: int = 0, most: int = 256) -> DataFrame:
    """The page: unacknowledged records behind after, oldest first, at most so many."""
    return log.filter(F.col("seq") > max(after, cursor.acked_up_to)).orderBy("seq").limit(most)


def page_summary(log: DataFrame, cursor: Cursor, after: int = 0, most: int = 256) -> DataFrame:
    """One row: epoch, chunks on the page, last_seq (0 if none), pending (all unacknowledged), more."""
    page = drain(log, cursor, after, most + 1)
    order = Window.orderBy("seq")
    on_page = page.withColumn("n", F.row_number().over(order)).agg(
        F.count_if(F.col("n") <= most).alias("chunks"),
        F.coalesce(F.max(F.when(F.col("n") <= most, F.col("seq"))), F.lit(0)).alias("last_seq"),
        (F.count(F.lit(1)) > most).alias("more"),
    )
    pending = log.agg(F.count_if(F.col("seq") > cursor.acked_up_to)).scalar()
    return on_page.select(F.lit(cursor.epoch).alias("epoch"), "chunks", "last_seq", pending.alias("pending"), "more")


def newly_acked(log: DataFrame, before: Cursor, after: Cursor) -> DataFrame:
    return log.agg(F.count_if((F.col("seq") > before.acked_up_to) & (F.col("seq") <= after.acked_up_to)).alias("acked"))


def evict_acked(log: DataFrame, cursor: Cursor) -> DataFrame:
    return log.filter(F.col("seq") > cursor.acked_up_to)


def evict_until(log: DataFrame, cursor: Cursor, bytes_to_free: int) -> DataFrame:
    """The log without its oldest acknowledged records, as many as free so many bytes. The acknowledged part is summed up
    per range of numbers first, so the running sum works on few rows."""
    acked = log.filter(F.col("seq") <= cursor.acked_up_to)
    block = F.shiftright("seq", 12)
    blocks = acked.groupBy(block.alias("__block")).agg(F.sum("size").alias("__bytes"))
    freed = blocks.withColumn("__before", F.coalesce(F.sum("__bytes").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("__block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    marked = acked.withColumn("__block", block).join(freed.select("__block", "__before"), "__block")
    gone = marked.withColumn("__gone", F.col("__before") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    left = gone.filter(F.col("__gone") >= bytes_to_free).drop("__block", "__before", "__gone")
    return left.unionByName(log.filter(F.col("seq") > cursor.acked_up_to))


def query(log: DataFrame, limit: int = 0, cutoff=None, since_seq: int = 0) -> DataFrame:
    """The newest records, oldest first: behind since_seq and behind the newest record that is older than the cutoff
    (records may carry any time, so this is a suffix, not a filter). Limits outside 1..10000 mean 100."""
    if not 1 <= limit <= QUERY_MOST:
        limit = QUERY_DEFAULT
    rows = log.filter(F.col("seq") > since_seq)
    if cutoff is not None:
        stop = log.filter(F.col("ts") < F.lit(cutoff)).agg(F.coalesce(F.max("seq"), F.lit(0))).scalar()
        rows = rows.filter(F.col("seq") > stop)
    return rows.orderBy(F.col("seq").desc()).limit(limit).orderBy("seq")


def stats(log: DataFrame, cursor: Cursor, capacity: int) -> DataFrame:
    """One row of gauges over the records that are held."""
    acked = F.col("seq") <= cursor.acked_up_to
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    held = log.agg(
        F.count(F.lit(1)).alias("chunks"),
        F.count_if(~acked).alias("pending_chunks"),
        F.count_if(acked).alias("acked_chunks"),
        total(F.col("size")).alias("used_bytes"),
        total(F.when(~acked, F.col("size"))).alias("pending_bytes"),
        total(F.when(acked, F.col("size"))).alias("reclaimable_bytes"),
        F.coalesce(F.min("seq"), F.lit(0)).alias("oldest_seq"),
        F.coalesce(F.max("seq"), F.lit(0)).alias("newest_seq"),
    )
    return held.select(
        "*",
        F.lit(capacity).cast("long").alias("capacity_bytes"),
        (F.lit(capacity).cast("long") - F.col("used_bytes")).alias("free_bytes"),
        F.round(F.col("used_bytes") / F.lit(float(capacity)) * 100, 2).alias("utilization_percent"),
        F.lit(cursor.epoch).alias("epoch"),
        F.lit(cursor.acked_up_to).cast("long").alias("acked_up_to"),
        F.lit(cursor.next_seq).cast("long").alias("next_seq"),
    )


def ingest_rate(log: DataFrame) -> DataFrame:
    """second, kbps: bytes of the trailing five whole seconds, per second, in KiB. Summed up by second before the window."""
    by_second = log.groupBy(F.unix_seconds(F.col("ts").cast("timestamp")).alias("second")).agg(F.sum("size").alias("bytes"))
    # a second lies in at most two of these day-long frames, so windows stay apart by day
    day = F.floor(F.col("second") / 86400)
    spread = by_second.withColumn("day", F.explode(F.array_distinct(F.array(day, F.floor((F.col("second") + RATE_SECONDS - 1) / 86400)))))
    window = Window.partitionBy("day").orderBy("second").rangeBetween(-(RATE_SECONDS - 1), 0)
    rated = spread.withColumn("kbps", F.sum("bytes").over(window) / RATE_SECONDS / 1024.0)
    return rated.filter(F.col("day") == day).select("second", "kbps")
