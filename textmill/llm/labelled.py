"""Bounded samples of labelled rows, and what the two classifiers share on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let
from .common import SPACE_CLASS, crc32_mod, written

#: Rows of each class that a classifier learns from at most. Only fitting is bounded; every row is scored.
PER_CLASS = 4000

HELD_OUT_FOLDS = 5


def held_out(doc_id: Column) -> Column:
    return crc32_mod(doc_id, HELD_OUT_FOLDS) == 0


def draw_below(draw: Column, wanted: int, n: int) -> Column:
    """Whether a 64-bit hash is among the lowest, such that about one and a half times as many of n rows are as are
    wanted: what is sorted then does not grow with n."""
    share = 1.5 * wanted / max(n, 1) + 1e-9
    return F.lit(True) if share >= 1 else draw < F.lit(int(share * 2**64) - 2**63)


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = PER_CLASS, columns: tuple[str, ...] = ("text",)) -> tuple[DataFrame, float]:
    """Learning rows (y, fold, columns) of docs that have a label 0 or 1 and are not held out: per class, the first
    per_class by a hash of their id, of copies and most near copies just one, so that no large group of copies decides
    what is learned. Also the share of label 1 among all such labels, for calibration. columns: with text among them."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    sizes = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("y"), F.lit(0))).first()
    share = sizes[1] / sizes[0] if sizes[0] else None
    drawn = known.withColumn("draw", F.xxhash64("doc_id", F.lit(label)))

    def first(y: int, n: int) -> DataFrame:
        return drawn.filter(F.col("y") == y).filter(draw_below(F.col("draw"), per_class, n)).orderBy("draw").limit(per_class)

    picked = first(0, sizes[0] - sizes[1]).union(first(1, sizes[1]))
    picked = picked.select(F.col("doc_id").alias("__id"), "y", "draw")
    found = docs.join(F.broadcast(picked), docs["doc_id"] == picked["__id"])  # 2 * per_class rows at most
    alike = Window.partitionBy("y", "__sketch").orderBy("draw")
    rows = found.select("y", "draw", *columns).withColumn("__sketch", sketch(F.col("text"))).withColumn("__place", F.row_number().over(alike))
    once = rows.filter("__place = 1").select("y", F.pmod("draw", F.lit(2)).cast("int").alias("fold"), *columns)
    return written(once, f"sample-{label}"), float(0.5 if share is None else share)


def sketch(text: Column) -> Column:
    """The least hash of a text's five-word shingles: the same for copies, and for most near copies of a text."""
    size = 5

    def hashes(words: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(1)))
        return F.array_min(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice(words, i, F.lit(size)), " "))))

    return let(F.split(F.lower(F.coalesce(text, F.lit(""))), SPACE_CLASS + "+", -1), hashes)


def prior_shift(y: np.ndarray, share: float) -> float:
    """What to add to a logit that was fitted on y, where label 1 has this share of all rows."""
    mine, share = min(max(float(y.mean()), 1e-3), 1 - 1e-3), min(max(share, 1e-3), 1 - 1e-3)
    return float(np.log(share / (1 - share)) - np.log(mine / (1 - mine)))


def sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def adam(params: list[np.ndarray], gradients, steps: int, rate: float) -> None:
    """Changes params in place."""
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for t in range(1, steps + 1):
        for p, g, a, b in zip(params, gradients(), m, v, strict=True):
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            p -= rate * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.99**t)) + 1e-8)
