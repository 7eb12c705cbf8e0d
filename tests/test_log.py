import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from textmill.operators import log
from textmill.operators.log import AckAhead, Cursor, EpochMismatch


def records(spark, n, size=1):
    return spark.range(1, n + 1).select(F.col("id").alias("seq"), F.lit(size).cast("long").alias("size"), F.timestamp_seconds(F.col("id")).alias("ts"))


def seqs(df):
    return [r.seq for r in df.collect()]


def test_sequence_is_gapless_and_ordered(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"))
    rows = sorted((r.k, r.seq) for r in log.sequenced(df, ["k"], first=11).collect())
    assert [s for _, s in rows] == list(range(11, 5011))
    assert log.sequenced(df.limit(0), ["k"]).count() == 0


def test_drain_pages(spark):
    held = records(spark, 5)
    c = Cursor("e", 0, 6)
    assert seqs(log.drain(held, c, 0, 3)) == [1, 2, 3] and seqs(log.drain(held, c, 3, 3)) == [4, 5]
    one = log.page_summary(held, c, 0, 3).first()
    assert (one.chunks, one.last_seq, one.pending, one.more) == (3, 3, 5, True)
    c = c.ack("e", 3)
    two = log.page_summary(held, c, 0, 10).first()
    assert (two.chunks, two.last_seq, two.pending, two.more) == (2, 5, 2, False)
    empty = log.page_summary(held, Cursor("e", 5, 6), 0, 10).first()
    assert (empty.chunks, empty.last_seq, empty.pending, empty.more) == (0, 0, 0, False)


def test_ack(spark):
    c = Cursor("e", 0, 4)
    with pytest.raises(EpochMismatch):
        c.ack("other", 1)
    with pytest.raises(AckAhead):
        c.ack("e", 4)
    after = c.ack("e", 3)
    assert after.acked_up_to == 3 and after.ack("e", 2) == after
    assert log.newly_acked(records(spark, 3), c, after).first().acked == 3
    assert seqs(log.evict_acked(records(spark, 5), after)) == [4, 5]


def test_query(spark):
    held = records(spark, 5)
    assert seqs(log.query(held, 2)) == [4, 5]
    assert seqs(log.query(held, 100, None, 3)) == [4, 5]
    assert len(seqs(log.query(records(spark, 200), 20000))) == 100
    # times out of order: the scan stops at the newest record that is older than the cutoff
    odd = held.withColumn("ts", F.when(F.col("seq") == 3, F.timestamp_seconds(F.lit(0))).otherwise(F.col("ts")))
    assert seqs(log.query(odd, 100, datetime(1970, 1, 1, 0, 0, 2))) == [4, 5]


def fold(requests, capacity):
    """The rule as one loop over records."""
    held, acked, out, nxt = [], 0, [], 1
    for sizes, ack in requests:
        acked = max(acked, min(len(held), ack - (nxt - len(held)) + 1))
        need, used = sum(sizes), sum(held)
        if need > capacity:
            out.append("too_large")
        elif need > capacity - used + sum(held[:acked]):
            out.append("full")
        else:
            while capacity - sum(held) < need:
                held.pop(0)
                acked -= 1
            held += sizes
            nxt += len(sizes)
            out.append("stored")
    return out


def test_admission_equals_loop(spark):
    rng = random.Random(2)
    logs = {}
    for name in "abc":
        seen, reqs = 0, []
        for _ in range(120):
            reqs.append(([rng.randrange(1, 9) for _ in range(rng.randrange(0, 5))], rng.choice([0, 0, seen // 2])))
            seen += 2
        logs[name] = reqs
    rows = [(name, k, sizes, ack) for name, reqs in logs.items() for k, (sizes, ack) in enumerate(reqs)]
    df = spark.createDataFrame(rows, "log string, ord long, sizes array<long>, ack_up_to long")
    got = log.admit(df, 30).collect()
    for name, reqs in logs.items():
        assert [r.outcome for r in sorted((r for r in got if r.log == name), key=lambda r: r.ord)] == fold(reqs, 30)
    assert {r.outcome for r in got} == {"stored", "full"}


def test_admission_goldens(spark):
    def run(requests, capacity):
        df = spark.createDataFrame([("l", k, s, a) for k, (s, a) in enumerate(requests)], "log string, ord long, sizes array<long>, ack_up_to long")
        return sorted(log.admit(df, capacity).collect(), key=lambda r: r.ord)

    full = run([([1] * 10, 0)] + [([1], 0)] * 5, 10)
    assert [r.outcome for r in full[1:]] == ["full"] * 5 and full[-1].pending == 10 and full[-1].evicted == 0
    assert run([([1] * 3, 0), ([1, 1], 0)], 4)[1].outcome == "full"
    reuse = run([([1] * 4, 0), ([1, 1], 2)], 4)[1]
    assert (reuse.outcome, reuse.first_seq, reuse.last_seq, reuse.evicted, reuse.pending) == ("stored", 5, 6, 2, 4)
    assert run([([5], 0)], 4)[0].outcome == "too_large"


def test_evict_until(spark):
    held = records(spark, 10000, 2)
    left = log.evict_until(held, Cursor("e", 9000, 10001), 10001)
    assert left.agg(F.min("seq"), F.count("seq")).first()[:] == (5002, 4999)


def test_stats_and_rate(spark):
    s = log.stats(records(spark, 10, 100), Cursor("e", 4, 11), 2000).first()
    assert (s.chunks, s.pending_chunks, s.acked_chunks, s.used_bytes, s.free_bytes, s.utilization_percent) == (10, 6, 4, 1000, 1000, 50.0)
    assert log.stats(records(spark, 10).limit(0), Cursor.new(), 5).first().used_bytes == 0
    rate = {r.second: r.kbps for r in log.ingest_rate(records(spark, 10, 1024)).collect()}
    assert rate[1] == pytest.approx(0.2) and rate[10] == pytest.approx(1.0)


def test_rate_across_days(spark):
    df = spark.createDataFrame([(86399, 1024), (86400, 1024), (86404, 5120)], "s long, size long").select(F.timestamp_seconds("s").alias("ts"), "size")
    rate = {r.second: r.kbps for r in log.ingest_rate(df).collect()}
    assert rate == {86399: pytest.approx(0.2), 86400: pytest.approx(0.4), 86404: pytest.approx(1.2)}
