"""Connected components of a graph whose edges don't fit in one task: alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: A graph of more edges is joined by sorting. Ids of few components are stored in next to no bytes, so that Spark would
#: broadcast more than a million rows by way of the driver.
BROADCAST_EDGES = 1 << 16


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _star(edges: DataFrame, small: bool, merge: bool) -> DataFrame:
    """Each node's neighbours are linked to the least node among them and itself. Minima are merged before the shuffle."""
    if small:
        seen = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    else:
        seen = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    # written, so that the join deals both sides itself and Spark can split a node with very many neighbours
    least = written(seen.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m")), "least")
    joined = seen.join(least.hint("merge") if merge else least, F.col("u") == F.col("w"))
    if small:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("w").alias("a"), F.col("m").alias("b")))
    else:
        out = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """edges: a, b (long). Gives node, root (the least node of its component) for every node that has an edge.
    Every round is written to the shared folder. Raises if the rounds don't end, rather than give part of the links."""
    now = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        merge = state[0] > BROADCAST_EDGES
        now = written(_star(_star(now, False, merge), True, merge), "edges")
        after = _state(now)
        if after == state:
            break
        state = after
    else:
        raise RuntimeError(f"components: no fixed point after {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
