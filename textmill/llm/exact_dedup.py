"""Exact dedup by an extendible-hash index on shared files (DataFrame expressions only).

Keys are 64-bit hashes of the normalised text. The steps:

1. entries: one scan normalises and hashes each text, once. What moves from here on are slim rows: the row's number, its
   key, SHA-256, length and id. Rows of one key and digest are one class.
2. directory: it has a cell for each key prefix of some depth. The depth doubles until no cell holds more than
   `capacity` classes; then a bucket is the shortest prefix, at that depth or above, that holds no more than that. Every
   cell names its bucket. `capacity` grows with the table, so that the directory has 2 * MOST_BUCKETS cells or so at any size.
3. index files: buckets are dealt to owner tasks by ranges. A class of one row needs no comparing. Of all others the
   texts come to the bucket's owner, equal ones merged in each task before they move, so that a large group of copies
   costs no more than a small one; the owner compares the bytes that share a key, counts, and chains them. A digest
   that stands for two texts stops the job.
4. probe: a document's key leads to its cell, the cell to the bucket, and the digest to the place in the chain. What is
   found there is the verdict. Spark splits the hot keys of this join.

Texts that are compared are found by a table of bits over hashes of the texts as they are (see rows.py), so that others
are neither normalised again nor moved.

Defined cases: null text counts as empty; a null doc_id comes last among ties; ties in length go to the smallest doc_id;
of rows that are equal in that as well, such as repeated rows, the first one read stays, and just that one; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from math import ceil, log2

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .rows import CHARS, HASH, bit_table, keep_rows, may_be_among, text_chars, text_hash

CAPACITY, MOST_BUCKETS = 4096, 1 << 15

#: A directory of more cells than this is joined as Spark sees fit, not broadcast.
_BROADCAST_CELLS = 1 << 18


def normalise(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def key_of(norm: Column, key_bits: int = 64) -> Column:
    return F.shiftleft(F.xxhash64(norm), 64 - key_bits) if key_bits < 64 else F.xxhash64(norm)


def digest_of(norm: Column) -> Column:
    return F.unhex(F.sha2(norm.cast("binary"), 256))


def build_entries(docs: DataFrame, key_bits: int = 64) -> DataFrame:
    """row, doc_id, key, digest, chars, and the hash and length of the text as it is."""
    text = F.col("text")
    once = docs.select("doc_id", F.coalesce(F.length(text), F.lit(0)).alias("chars"), text_hash(text).alias(HASH), text_chars(text).alias(CHARS), normalise(text).alias("norm"))
    slim = once.select(F.monotonically_increasing_id().alias("row"), "doc_id", key_of(F.col("norm"), key_bits).alias("key"), digest_of(F.col("norm")).alias("digest"), "chars", HASH, CHARS)
    return written(slim, "exact-entries")


def build_classes(entries: DataFrame) -> DataFrame:
    """key, digest, n, keep_row, keep_id: the row that stays has the most code points, then the smallest id, then row."""
    # ~x orders like -x, and has no overflow
    rank = F.struct("chars", F.col("doc_id").isNotNull().alias("known"), F.bitwise_not("doc_id").alias("id"), F.bitwise_not("row").alias("row"))
    classes = entries.groupBy("key", "digest").agg(F.count(F.lit(1)).alias("n"), F.max(rank).alias("best"))
    return written(classes.select("key", "digest", "n", F.bitwise_not("best.row").alias("keep_row"), F.bitwise_not("best.id").alias("keep_id")), "exact-classes")


def cell_of(key: Column, depth: int) -> Column:
    return F.shiftrightunsigned(key, 64 - depth) if depth else F.lit(0).cast("long")


class Directory:
    """cells: cell, depth (of its bucket), bucket (its first cell), a row for each cell in use; depth: of the cells."""

    def __init__(self, cells: DataFrame, depth: int, n_cells: int):
        self.cells, self.depth, self.n_cells = cells, depth, n_cells

    def route(self, rows: DataFrame) -> DataFrame:
        """rows (with key) with the bucket and depth that the directory names; keys without a cell have no bucket."""
        cells = F.broadcast(self.cells) if self.n_cells <= _BROADCAST_CELLS else self.cells
        return rows.withColumn("cell", cell_of(F.col("key"), self.depth)).join(cells, "cell").drop("cell")


def build_directory(classes: DataFrame, capacity: int | None = None) -> Directory:
    """Doubles until no cell is overfull. A cell of one key can't be split and is full whatever it holds."""
    keys = written(classes.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "exact-keys")
    total = keys.count()
    capacity = capacity or max(CAPACITY, ceil(total / MOST_BUCKETS))
    depth = min(64, max(0, ceil(log2(max(total, 1) / capacity))))
    while True:
        cells = keys.groupBy(cell_of(F.col("key"), depth).alias("cell")).agg(F.count(F.lit(1)).alias("held"))
        most, n_cells = cells.agg(F.max("held"), F.count(F.lit(1))).first()
        if depth == 64 or (most or 0) <= capacity:
            break
        depth += 1
    # each cell under all prefixes above it: the shortest that is not overfull is its bucket
    levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(0), F.lit(depth)))).withColumn("prefix", _prefix("cell", depth))
    sums = levels.groupBy("depth", "prefix").agg(F.sum("held").alias("total")).filter(F.col("total") <= capacity)
    best = levels.join(sums, ["depth", "prefix"]).groupBy("cell").agg(F.min("depth").alias("depth"))
    bucket = F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftleft", _prefix("cell", depth), F.lit(depth) - F.col("depth")))
    return Directory(written(best.withColumn("bucket", bucket), "exact-directory"), depth, n_cells)


def _prefix(cell: str, depth: int) -> Column:
    """The first bits of a cell of this depth, as many as its row's depth says."""
    return F.when(F.col("depth") == 0, F.lit(0).cast("long")).otherwise(F.call_function("shiftrightunsigned", F.col(cell), F.lit(depth) - F.col("depth")))


def compare_texts(docs: DataFrame, entries: DataFrame, classes: DataFrame, directory: Directory, key_bits: int = 64) -> DataFrame:
    """bucket, depth, key, digest, n: texts that share a key with another row, told apart by their bytes by the owner of
    their bucket. Further texts may come with them."""
    shared = entries.select("key", "digest", HASH).join(classes.filter("n > 1").select("key", "digest"), ["key", "digest"])
    table = written(bit_table(shared.select(F.col(HASH).alias("h"))), "exact-bits")
    suspects = may_be_among(docs.select("text"), text_hash(F.col("text")), table).filter("__maybe")
    texts = suspects.select(normalise(F.col("text")).alias("norm")).select(key_of(F.col("norm"), key_bits).alias("key"), "norm")
    merged = directory.route(texts.groupBy("key", "norm").agg(F.count(F.lit(1)).alias("n")))
    owned = merged.repartitionByRange("bucket").groupBy("bucket", "depth", "key", "norm").agg(F.sum("n").alias("n"))
    return owned.select("bucket", "depth", "key", digest_of(F.col("norm")).alias("digest"), "n")


def build_index(docs: DataFrame, entries: DataFrame, classes: DataFrame, directory: Directory, key_bits: int = 64) -> DataFrame:
    """bucket, depth, key, chain (place in the key's chain), digest, keep_row, keep_id, group_size."""
    single = directory.route(classes.filter("n = 1")).select("bucket", "depth", "key", "digest", F.col("n").alias("group_size"), "keep_row", "keep_id")
    compared = written(compare_texts(docs, entries, classes, directory, key_bits), "exact-compared")
    several = compared.join(classes.filter("n > 1").select("key", "digest", F.col("n").alias("rows"), "keep_row", "keep_id"), ["key", "digest"])
    counted = F.when(F.col("n") == F.col("rows"), F.col("n")).otherwise(F.raise_error(F.lit("one digest stands for different texts")).cast("long"))
    entered = single.unionByName(several.select("bucket", "depth", "key", "digest", counted.alias("group_size"), "keep_row", "keep_id"))
    chain = Window.partitionBy("bucket", "key").orderBy("digest")
    owned = entered.repartitionByRange("bucket").withColumn("chain", F.row_number().over(chain))
    return written(owned.select("bucket", "depth", "key", "chain", "digest", "keep_row", "keep_id", "group_size"), "exact-index")


def probe(entries: DataFrame, directory: Directory, index: DataFrame) -> DataFrame:
    """The entries with what the index says of them: keep_row, keep_id, group_size."""
    asked = directory.route(entries).drop("depth")
    return asked.join(index.select("bucket", "key", "digest", "keep_row", "keep_id", "group_size"), ["bucket", "key", "digest"])


def verdicts(docs: DataFrame, capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    entries = build_entries(docs, key_bits)
    classes = build_classes(entries)
    directory = build_directory(classes, capacity)
    return probe(entries, directory, build_index(docs, entries, classes, directory, key_bits))


def find_copies(docs: DataFrame, capacity: int | None = None, key_bits: int = 64) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    found = verdicts(docs, capacity, key_bits)
    return found.select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_copies(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows that are copies of a row that stays; columns as they were."""
    found = verdicts(docs.select("doc_id", "text"), **options)
    return keep_rows(docs, found.select(F.col("doc_id").alias("__row_id"), HASH, CHARS, (F.col("row") == F.col("keep_row")).alias("kept")))
