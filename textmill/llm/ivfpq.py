"""Approximate nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised
residuals, asymmetric distance tables, and exact reranking.

Coarse centroids and codebooks are fitted on a bounded sample (SAMPLE vectors, by a hash of their ids); every vector is
indexed. A query visits the cells whose centroids have the largest inner products with it, as large a share of them as
holds COVER of all near neighbours within the sample: few where vectors have clusters, most where they have none. (A whole
table has nearer neighbours than its sample, whose cells come earlier, so that share is enough.) In a cell, a
table of inner products of the query's parts with the codewords gives each vector's approximate score (cell part plus
residual part); the RERANKED best per cell are scored exactly in double precision, ties going to the smaller vec_id, and
so is every other vector whose approximate score plus the query's length times the vector's quantisation error reaches
the k-th of those: the rest of the cell can't be among the k nearest.
Cells are dealt to tasks in chunks of at most VECTOR_CHUNK vectors and QUERY_CHUNK queries, so a cell that holds a third
of all vectors is many tasks. Recall is measured against brute force in the tests.

Defined cases: vectors that are null, empty, zero, or hold a null or a non-finite component take no part; shorter ones
than the longest count as if zeros followed; a vector equal to the query's but under another id is a
candidate; rows that share an id are candidates each, but none of its own id's query, which has the least of their vectors; fewer candidates than k: all of them;
an empty table: an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written
from .labelled import draw_below

SAMPLE, MIN_CELLS, MAX_CELLS, COVER, ASKED = 8192, 64, 1024, 0.96, 512
PARTS, WORDS, RERANKED = 16, 256, 192
VECTOR_CHUNK, QUERY_CHUNK = 4096, 4096


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 11) -> np.ndarray:
    """Centroids of x, k at most; an empty one keeps its place."""
    rng = np.random.default_rng(seed)
    c = x[np.sort(rng.choice(len(x), min(k, len(x)), replace=False))].astype(float)
    for _ in range(rounds):
        at = nearest(x, c)
        n = np.bincount(at, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(at, x[:, d], len(c))
            c[n > 0, d] = s[n > 0] / n[n > 0]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (c**2).sum(1) / 2
    for at in range(0, len(x), 8192):
        out[at : at + 8192] = np.argmin(half - x[at : at + 8192] @ c.T, axis=1)
    return out


class Index:
    """Centroids and codebooks. Vectors are padded with zeros to a multiple of the parts' width."""

    def __init__(self, sample: np.ndarray, cells: int, parts: int = PARTS, words: int = WORDS):
        self.dim = sample.shape[1]
        self.parts = min(parts, self.dim)
        self.width = -(-self.dim // self.parts)
        centroids = kmeans(sample, cells)
        self.centroids = centroids[np.unique(nearest(sample, centroids))]  # equal ones would waste probes
        rest = self._pad(sample - self.centroids[nearest(sample, self.centroids)])
        self.books = [kmeans(rest[:, p], words, 6, p) for p in range(self.parts)]

    def _pad(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), self.parts * self.width))
        out[:, : self.dim] = x
        return out.reshape(len(x), self.parts, self.width)

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cells, codes, and the lengths of what the codes leave out."""
        cell = nearest(x, self.centroids)
        rest = self._pad(x - self.centroids[cell])
        codes = np.stack([nearest(rest[:, p], b) for p, b in enumerate(self.books)], axis=1)
        lost = sum(((rest[:, p] - b[codes[:, p]]) ** 2).sum(1) for p, b in enumerate(self.books))
        return cell, codes.astype(np.uint8), np.sqrt(lost)

    def probes(self, q: np.ndarray, share: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Cells by falling inner product: this share of them, and as many as hold so many vectors (or all)."""
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable").astype(np.int32)
        enough = (np.cumsum(sizes[order], axis=1) < least).sum(1) + 1
        n = np.maximum(enough, int(np.ceil(share * len(self.centroids))))
        return [cells[:m] for cells, m in zip(order, n, strict=True)]

    def share_to_probe(self, sample: np.ndarray, k: int, cover: float = COVER, asked: int = ASKED) -> float:
        """The share of the cells that holds so many of the k nearest neighbours, within the sample, of its first rows."""
        q, k = sample[:asked], min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        scores = q @ sample.T
        scores[np.arange(len(q)), np.arange(len(q))] = -np.inf
        top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        turn = np.empty_like(order)
        np.put_along_axis(turn, order, np.arange(order.shape[1])[None, :].repeat(len(q), 0), axis=1)
        turns = np.sort(np.take_along_axis(turn, nearest(sample, self.centroids)[top], axis=1).ravel())
        return float(turns[int(np.ceil(cover * len(turns))) - 1] + 1) / len(self.centroids)

    def approximate(self, q: np.ndarray, cell: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distance tables: one row per query, one column per code."""
        parts = self._pad(q)
        out = np.repeat((q @ self.centroids[cell])[:, None], len(codes), axis=1).astype(np.float32)
        for p, b in enumerate(self.books):
            out += (parts[:, p] @ b.T).astype(np.float32)[:, codes[:, p]]
        return out


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding of the rows that take part; components of single precision stay so, which halves what moves."""
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    return vectors.select("vec_id", e.cast(kind).alias("embedding")).filter(F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(fine, F.lit(False)))


def matrix(column: pd.Series, dim: int) -> np.ndarray:
    """In double precision, with zeros behind shorter vectors."""
    rows = column.to_list()
    if rows and all(len(x) == dim for x in rows):
        return np.stack(rows).astype(float)
    out = np.zeros((len(rows), dim))
    for at, x in zip(out, rows, strict=True):
        at[: len(x)] = x
    return out


def search(vectors: DataFrame, is_query: Column, k: int = 20, probed: float | None = None, reranked: int = RERANKED, cells: int | None = None) -> DataFrame:
    """vectors: vec_id, embedding; is_query: on vec_id. query_id, rank, vec_id, score: the k nearest found, nearest first."""
    rows = usable(vectors)
    n, dim = rows.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    kind = dict(rows.dtypes)["embedding"]
    if not n:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    cells = cells or int(min(max(n**0.5 / 8, MIN_CELLS), MAX_CELLS))
    drawn = rows.filter(draw_below(F.xxhash64("vec_id"), SAMPLE, n))
    sample = drawn.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toPandas()  # SAMPLE rows at most
    points = matrix(sample["embedding"], dim)
    index = Index(points, cells)
    share = index.share_to_probe(points, k) if probed is None else probed

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cell, codes, lost = index.encode(matrix(b["embedding"], index.dim))
                yield pd.DataFrame({"vec_id": b["vec_id"], "embedding": b["embedding"], "cell": cell, "codes": [c.tobytes() for c in codes], "lost": lost})

    indexed = written(rows.mapInPandas(encode, f"vec_id long, embedding {kind}, cell int, codes binary, lost double"), "ivf-index")

    sizes = np.zeros(len(index.centroids), np.int64)
    for r in indexed.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).collect():  # MAX_CELLS rows at most
        sizes[r["cell"]] = r["n"]

    def probe(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                cells = index.probes(matrix(b["embedding"], index.dim), share, sizes, 4 * k)
                yield pd.DataFrame({"query_id": b["vec_id"], "query": b["embedding"], "cells": cells})

    chosen = rows.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    queries = written(chosen.mapInPandas(probe, f"query_id long, query {kind}, cells array<int>"), "ivf-queries")
    asked = queries.select("query_id", "query", F.explode("cells").alias("cell"))
    held = indexed.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / VECTOR_CHUNK).cast("int").alias("v_parts"))
    wanted = queries.select(F.explode("cells").alias("cell")).groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_CHUNK).cast("int").alias("q_parts"))
    parts = F.broadcast(held.join(wanted, "cell"))  # MAX_CELLS rows at most
    all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = indexed.join(parts, "cell").withColumn("v", F.pmod(F.xxhash64("vec_id"), F.col("v_parts")).cast("int")).withColumn("q", all_of("q_parts"))
    right = asked.join(parts, "cell").withColumn("q", F.pmod(F.xxhash64("query_id"), F.col("q_parts")).cast("int")).withColumn("v", all_of("v_parts"))

    def meet(key: tuple, v: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(v) or not len(q):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        v = v.sort_values("vec_id", ignore_index=True)
        ids, x = v["vec_id"].to_numpy(), matrix(v["embedding"], index.dim)
        codes = np.frombuffer(b"".join(v["codes"]), np.uint8).reshape(len(v), -1)
        lost, lengths, out = v["lost"].to_numpy(), np.sqrt((x**2).sum(1)), []
        for at in range(0, len(q), 512):
            block = q.iloc[at : at + 512]
            y = matrix(block["query"], index.dim)
            near = index.approximate(y, int(key[0]), codes)
            for row, query_id in enumerate(block["query_id"]):
                near[row, ids == query_id] = -np.inf
                top = np.argsort(-near[row], kind="stable")[:reranked]  # equal codes: smaller ids first
                top = top[ids[top] != query_id]
                exact = x[top] @ y[row]
                if len(top) < len(ids):
                    length = np.sqrt((y[row] ** 2).sum())
                    kth = np.partition(exact, -k)[-k] if len(top) >= k else -np.inf
                    # approximate scores are of single precision
                    reach = near[row] + length * (lost * (1 + 1e-6) + 1e-4 * (lengths + lost))
                    top = np.flatnonzero((reach >= kth) & (ids != query_id))
                    exact = x[top] @ y[row]
                best = np.lexsort((ids[top], -exact))[:k]
                out.append(pd.DataFrame({"query_id": query_id, "vec_id": ids[top][best], "score": exact[best]}))
        return pd.concat(out, ignore_index=True)

    keys = ("cell", "v", "q")
    slim = left.select(*keys, "vec_id", "embedding", "codes", "lost").groupBy(*keys)
    met = slim.cogroup(right.select(*keys, "query_id", "query").groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
