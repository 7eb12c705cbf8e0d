"""SimHash near-dedup with pivot distance tables.

1. Fingerprints: bit counts over the XXH64 of all word shingles of a text, in numpy.
2. Equal fingerprints are merged (the smallest doc_id stands for them), so copies cost nothing further on.
3. Pivot table: the Hamming distances of each fingerprint to PIVOTS reference fingerprints, computed once.
4. Candidates: fingerprints within RADIUS bits agree on some choice of blocks of their bits; blocks are as many as keep
   a key's share of all fingerprints small. No pair is missed: RADIUS bits can't touch more than RADIUS blocks.
5. Within a key, fingerprints are ordered by their first pivot distance. By the triangle inequality a pair can only be
   near if no coordinate differs by more than RADIUS; what that leaves is verified on the fingerprints themselves.
   Only the links of a spanning forest leave a key, so a dense group of n gives n - 1 links, not their square.
   Keys with more than CHUNK members are cut into chunks and every pair of chunks is one key, in tasks of their own.
6. Links are joined into components by distributed star steps.

Defined cases: null or empty text, or one without words: fingerprint zero, linked like any other; fewer words than a
shingle: one shingle of them all; null doc_id: a row like others, but a component takes its least non-null id (null if it
has none); repeated rows: repeated results; an empty table: an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import jaccard
from .common import written
from .components import components
from .shingles import BITS, SEED, fingerprint_of, hashes, signed

SHINGLE, RADIUS = 4, 4
PIVOTS, CHUNK = 16, 16384

def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return fingerprint_of(hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """docs: doc_id, text. doc_id, fp (the 64 bits as a signed long)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": np.array([signed(fingerprint(t, shingle)) for t in b["text"]], np.int64)})

    # ids travel as text: pandas has no integers with nulls by default
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInPandas(run, "doc_id string, fp long").select(F.col("doc_id").cast("long").alias("doc_id"), "fp")


def pivot_values(n: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(n)], np.uint64)


def pivot_table(fps: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.bitwise_count(fps[:, None] ^ pivots[None, :])


def block_scheme(n: int, radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """Masks of bits, such that any two fingerprints within radius agree under one of them. More fingerprints, longer
    keys: blocks are added until the bits of a key outnumber log2(n), or 12 blocks are reached."""
    for blocks in range(radius + 1, radius + 9):
        agree = blocks - radius
        if agree * (bits // blocks) >= np.log2(max(n, 2)) + 1 or blocks == radius + 8:
            break
    cuts = [bits * k // blocks for k in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    out = [sum(c) for c in combinations(masks, agree)]
    assert len(out) == comb(blocks, agree)
    return out


def forest(fps: np.ndarray, table: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Links (positions) of a spanning forest of all pairs within radius. Each position leaves the list of those that
    aren't reached yet once; it is compared with those whose pivot distances differ by radius at most."""
    order = np.argsort(table[:, 0], kind="stable")
    fps, table = fps[order], table[order].astype(np.int16)
    left = np.arange(len(fps))  # not reached yet, by first pivot distance
    links = []
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            x = todo.pop()
            lo, hi = np.searchsorted(table[left, 0], (table[x, 0] - radius, table[x, 0] + radius + 1))
            near = left[lo:hi]
            near = near[np.abs(table[near] - table[x]).max(axis=1, initial=0) <= radius]  # pivots discard
            near = near[np.bitwise_count(fps[near] ^ fps[x]) <= radius]  # the bits decide
            if len(near):
                links += [(int(order[x]), int(order[y])) for y in near]
                todo += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return links


def near_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """distinct: fp (each once). Links a, b that connect all fingerprints within radius of each other."""
    pivots = pivot_values()

    def tabled(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if b.empty:
                continue
            t = pivot_table(b["fp"].to_numpy(np.int64).view(np.uint64), pivots).astype(np.uint8)
            yield pd.DataFrame({"fp": b["fp"], "pivots": [x.tobytes() for x in t]})

    points = written(distinct.mapInPandas(tabled, "fp long, pivots binary"), "simhash-pivots")
    masks = block_scheme(points.count(), radius)
    keys = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks)]))
    # a member of a key: xxhash64 may join two keys by chance, which only adds candidates
    sizes = points.select(keys.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # merged, as all joins here: Spark takes the keys to be as many as the fingerprints and would broadcast millions of them
    members = points.select("fp", "pivots", keys.alias("key")).join(sizes.hint("merge"), "key")
    parts = F.ceil(F.col("n") / F.lit(chunk)).cast("int")
    mine = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    members = members.withColumn("parts", parts).withColumn("mine", mine)
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.withColumn("other", other).select(
        F.when(F.col("parts") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("mine", "other"), F.greatest("mine", "other"))).alias("key"), "fp", "pivots"
    )

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by key; the last key of a batch is carried on, since the next may have more of it."""
        kept = None

        def links(b: pd.DataFrame) -> pd.DataFrame:
            keys, fps = b["key"].to_numpy(), b["fp"].to_numpy(np.int64)
            table = np.frombuffer(b"".join(b["pivots"]), np.uint8).reshape(len(b), len(pivots))
            cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            a, c = [], []
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi - lo == 2:  # by far the most
                    if np.abs(table[lo].astype(np.int16) - table[lo + 1]).max() <= radius and int(np.bitwise_count((fps[lo : lo + 1] ^ fps[lo + 1]).view(np.uint64))[0]) <= radius:
                        a.append(fps[lo])
                        c.append(fps[lo + 1])
                elif hi - lo > 2:
                    for x, y in forest(fps[lo:hi].view(np.uint64), table[lo:hi], radius):
                        a.append(fps[lo + x])
                        c.append(fps[lo + y])
            return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(c, np.int64)})

        for b in batches:
            b = b if kept is None else pd.concat([kept, b], ignore_index=True)
            if not len(b):
                continue
            at = int(np.argmax(b["key"].to_numpy() == b["key"].iloc[-1]))
            kept = b.iloc[at:]
            if at:
                yield links(b.iloc[:at])
        if kept is not None and len(kept):
            yield links(kept)

    dealt = members.repartition("key").sortWithinPartitions("key")
    return dealt.mapInPandas(link, "a long, b long")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """docs: doc_id, text. One row per document: doc_id, fingerprint, component_id."""
    rows = written(fingerprints(docs, shingle), "simhash-fingerprints")
    points = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = components(near_links(points.select("fp"), radius, chunk))
    placed = points.join(found.hint("merge"), points["fp"] == found["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    # written, so that Spark can split a group that holds very many fingerprints
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    named = placed.join(least.hint("merge"), "root").select(F.col("fp").alias("p_fp"), "component_id")
    out = rows.join(named.hint("merge"), rows["fp"] == named["p_fp"])
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def likely_pairs(nodes: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """nodes: node, fp. Pairs a, b of nodes: of each fingerprint the least node with all others, and with the least nodes
    of the fingerprints linked to it."""
    points = written(nodes.groupBy("fp").agg(F.min("node").alias("least")), "simhash-nodes")
    links = near_links(points.select("fp"), radius, chunk)
    ends = [points.select(F.col("fp").alias(f"{c}_fp"), F.col("least").alias(c)) for c in ("x", "y")]
    across = links.join(ends[0], links["a"] == F.col("x_fp")).join(ends[1], links["b"] == F.col("y_fp")).select(F.col("x").alias("a"), F.col("y").alias("b"))
    alike = nodes.join(points.withColumnRenamed("fp", "p_fp"), F.col("fp") == F.col("p_fp")).filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return across.union(alike)


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """docs with one row (the smallest doc_id) of each group of near copies: shingles of five words, Jaccard similarity of
    0.8 or more; columns as they were. Pairs that the fingerprints and pivots find come first and are verified on their
    shingles; pairs of that similarity differ by some ten bits, so the rest comes from an exact set-similarity join."""
    return jaccard.keep_one(docs, guess=likely_pairs, **options)
