"""Verdicts on rows, brought back to the rows themselves without shuffling those that no verdict is against.

A row is known by its doc_id, a 64-bit hash of its text and the text's length. Those of rows that go (or are asked for)
set bits in a table of 2**BITS bits, which is broadcast: 2**BITS / 64 rows of two longs at most, however many documents
there are. A row whose bit is not set is none of them and passes where it stands; all others are looked up exactly. A
full table only means that more rows are looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BITS = 26

#: Names that no column of a document should have.
HASH, CHARS, ROW_KEY = "__text_hash", "__text_chars", ["__row_id", "__text_hash", "__text_chars"]


def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


def text_chars(text: Column) -> Column:
    return F.coalesce(F.length(text), F.lit(-1))


def row_key(doc_id: Column, text: Column) -> list[Column]:
    return [doc_id.alias("__row_id"), text_hash(text).alias(HASH), text_chars(text).alias(CHARS)]


def bit_table(hashes: DataFrame, bits: int = BITS) -> DataFrame:
    """hashes: h (long). word, held: the words of the table that have a bit set."""
    place = F.shiftrightunsigned("h", 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(place, F.lit(64)).cast("int"))
    return hashes.select(F.shiftright(place, 6).alias("word"), one.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("held"))


def may_be_among(rows: DataFrame, h: Column, table: DataFrame, bits: int = BITS) -> DataFrame:
    """rows with __maybe: whether the bit of h is set."""
    place = F.shiftrightunsigned(h, 64 - bits)
    table = F.broadcast(table.select(F.col("word").alias("__word"), F.col("held").alias("__held")))  # 2**bits / 64 rows at most
    met = rows.join(table, F.shiftright(place, 6) == F.col("__word"), "left")
    return met.withColumn("__maybe", F.coalesce(F.getbit("__held", F.pmod(place, F.lit(64)).cast("int")) == 1, F.lit(False))).drop("__word", "__held")


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that go; columns as they were. verdicts: the row key and kept (boolean), one for each row
    of docs. Of rows with one key (equal in id and text), one stays if any of them is kept."""
    slim = written(verdicts.groupBy(*ROW_KEY).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n")), "verdicts")
    asked = slim.filter(~F.col("kept") | (F.col("n") > 1))
    table = written(bit_table(asked.select(F.xxhash64("__row_id", HASH, CHARS).alias("h"))), "verdict-bits")
    columns = docs.columns
    keyed = docs.select("*", *row_key(F.col("doc_id"), F.col("text")))
    seen = may_be_among(keyed, F.xxhash64(*ROW_KEY), table)
    passed = seen.filter("not __maybe").select(*columns)
    looked = seen.filter("__maybe").groupBy(*ROW_KEY).agg(F.first(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__row"))
    gone = slim.filter(~F.col("kept")).select(*[F.col(c).alias(f"{c}_gone") for c in ROW_KEY])
    same = [F.col(c).eqNullSafe(F.col(f"{c}_gone")) for c in ROW_KEY]
    left = looked.join(gone, same[0] & same[1] & same[2], "left_anti")
    return passed.unionByName(left.select("__row.*"))
