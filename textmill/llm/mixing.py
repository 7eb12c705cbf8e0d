"""Mixing sources to target weights by systematic sampling (DataFrame expressions only).

Every document of a source expects target / source_size copies. Expected copies are summed up along the source, one
offset is added, and a document is emitted once per integer boundary that its share crosses. The offset is one draw from
the source's name. Within a source, documents stand in the order of their sizes, equal ones by a hash of their ids: so
words taken differ from the target by about one long document at most, whatever the offset (the sum of all deviations up
to any document is less than one copy).

Prefix sums need no source in one task: the slim rows are range-partitioned by source, size, hash and id, numbered
within partitions by monotonically_increasing_id, and only the counts per partition and source are summed up.

Defined cases: null text: size 0; null source: a source of its own, last in the order; a source of size 0 gets no
copies; null or repeated ids are separate rows, and each is taken as often as the mix says; an empty table gives an empty
result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, written
from .rows import CHARS, HASH, ROW_KEY, row_key

#: Bits of monotonically_increasing_id below the partition's number.
ROW_BITS = 33


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """sizes: source, source_size, a row per source. Adds weight and target. Targets are the weights' shares of all
    words; those above cap times their source's size stop there and the excess is reshared by weight. Sorted by the
    level at which they stop, the sources that do are a prefix, so running sums give the fixed point at once.
    One row per source meets in one task here, never documents."""
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_level = Window.orderBy("level", F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    s = sizes.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights)) + 1).cast("long"))
    s = s.withColumn("most", F.col("source_size") * cap).withColumn("level", F.col("most") / F.col("weight"))
    s = s.withColumn("total", F.sum("source_size").over(everything))
    s = s.withColumn("most_before", F.coalesce(F.sum("most").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("weight_from", F.sum("weight").over(by_level.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("stopped", F.col("level") <= (F.col("total") - F.col("most_before")) / F.col("weight_from"))
    s = s.withColumn("left", F.col("total") - F.sum(F.when(F.col("stopped"), F.col("most")).otherwise(0)).over(everything))
    s = s.withColumn("left_weight", F.sum(F.when(F.col("stopped"), 0).otherwise(F.col("weight"))).over(everything))
    share = F.try_divide(F.col("left").cast("double"), F.col("left_weight").cast("double")) * F.col("weight")
    return s.select("source", "source_size", "weight", F.when(F.col("stopped"), F.col("most").cast("double")).otherwise(share).alias("target"))


def place_of(doc_id: Column, seed: str) -> Column:
    """A number that depends on the id and the seed alone, for the order within a source."""
    return _md5_number(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 15).cast("long")


def _md5_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, digits), 16, 10)


def offset(source: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the source's name and the seed alone."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null")))
    return _md5_number(text, 8).cast("double") / F.lit(4294967296.0)


def _mix(docs: DataFrame, weights: Sequence[int], cap: int, seed: str) -> DataFrame:
    slim = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), place_of(F.col("doc_id"), seed).alias("place"), *row_key(F.col("doc_id"), F.col("text"))[1:]), "mix-sizes")
    place = ["source", "size", "place", "doc_id", HASH, CHARS]
    rows = written(slim.repartitionByRange(*place).sortWithinPartitions(*place).withColumn("row", F.monotonically_increasing_id()), "mix-rows")
    part = F.shiftright("row", ROW_BITS)
    parts = rows.groupBy("source", part.alias("part")).agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    parts = written(parts, "mix-parts")
    targets = source_targets(parts.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(targets.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s", "n", "words")
    parts = parts.withColumns({"u": offset(F.col("source"), seed), "each": F.coalesce(F.try_divide(F.col("target"), F.col("source_size").cast("double")), F.lit(0.0))})
    met = rows.join(parts.withColumnsRenamed({"source": "p_source"}), (part == F.col("part")) & F.col("source").eqNullSafe(F.col("p_source")))
    rank = F.col("before") + F.col("row") - F.col("first")
    n = F.floor(F.col("u") + F.col("each") * (rank + 1)) - F.floor(F.col("u") + F.col("each") * rank)
    return met.withColumn("copies", F.least(n, F.lit(cap)).cast("long"))


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs: doc_id, source, text. One row per document: doc_id, source, size, source_size, target, copies, taken."""
    return _mix(docs, weights, cap, seed).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), cap: int = 3, seed: str = "mix") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; columns as they were. Rows are known by id, source and
    text; of rows that are equal in all three, each takes its share of their copies."""
    key = ["__source", *ROW_KEY]
    taken = _mix(docs, weights, cap, seed).select(F.col("source").alias("__source"), F.col("doc_id").alias("__row_id"), HASH, CHARS, "copies")
    taken = written(taken.groupBy(*key).agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows")), "mix-copies")
    some = taken.filter("__copies > 0").withColumnsRenamed({c: f"{c}_taken" for c in key})
    keyed = docs.select("*", F.col("source").alias("__source"), *row_key(F.col("doc_id"), F.col("text")))
    same = [F.col(c).eqNullSafe(F.col(f"{c}_taken")) for c in key]
    met = keyed.join(some, same[0] & same[1] & same[2] & same[3])
    copies = F.col("__copies")
    if taken.filter("__rows > 1").limit(1).count():  # only then do equal rows have to be numbered
        met = met.withColumn("__k", F.row_number().over(Window.partitionBy(*key).orderBy(F.lit(0))))
        k = F.col("__k")
        copies = F.floor(F.col("__copies") * k / F.col("__rows")) - F.floor(F.col("__copies") * (k - 1) / F.col("__rows"))
    times = F.array_repeat(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), copies.cast("int"))
    return met.select(F.explode(times).alias("__row")).select("__row.*")
