import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from textmill.llm import jaccard, simhash

from ..conftest import DATA
from .helpers import no_docs, odd_docs, words


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def kept_by_hand(rows):
    """rows: doc_id, text. The least id of each component of all pairs of similarity 0.8."""
    rows = sorted(rows)
    sets, root = [shingle_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if 5 * len(a & b) >= 4 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[find(k)][0] for k in range(len(rows))}


def near_rows():
    """Copies with words changed, so that similarities lie on both sides of 0.8, and a passage that all of a group share."""
    rng, rows = random.Random(8), []
    for base in range(12):
        text = words(rng, rng.choice([12, 60, 150])).split()
        for _ in range(12):
            copy = list(text)
            for _ in range(rng.randrange(0, max(2, len(text) // 30) + 1)):
                copy[rng.randrange(len(copy))] = words(rng, 1)
            rows.append((len(rows), " ".join(copy)))
    passage = words(rng, 40)
    rows += [(1000 + k, passage + " " + words(rng, 12)) for k in range(60)]
    return rows + [(2000, "one two"), (2001, "One\ntwo"), (2002, ""), (2003, None)]


@pytest.mark.parametrize("chunk", [jaccard.CHUNK, 5])
def test_groups_equal_brute_force(spark, chunk):
    rows = near_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = kept_by_hand(rows)
    assert 20 < len(want) < len(rows) - 20
    assert {r.doc_id for r in jaccard.keep_one(docs, chunk=chunk).collect()} == want
    assert {r.doc_id for r in simhash.keep_one(docs, chunk=chunk).collect()} == want


def test_fingerprints_and_pivots_find_close_pairs(spark):
    rng = random.Random(3)
    texts = [words(rng, 400) for _ in range(8)]
    rows = [(10 * k + j, t.rsplit(" ", j)[0]) for k, t in enumerate(texts) for j in range(4)]
    nodes, _ = jaccard.nodes_and_counts(spark.createDataFrame(rows, "doc_id long, text string"))
    of = {r.node: r["__row_id"] for r in nodes.collect()}
    pairs = {(of[r.a] // 10, of[r.b] // 10) for r in simhash.likely_pairs(nodes.select("node", "fp").distinct()).collect()}
    assert {a for a, b in pairs if a == b} == set(range(8))


def test_repeated_and_null_ids_keep_one_row_of_a_group(spark):
    rng = random.Random(12)
    base, other = words(rng, 80), words(rng, 80)
    rows = [(1, base), (None, base), (None, other), (None, other + " tail"), (7, base + " end"), (7, base + " end"), (3, None), (None, ""), (8, words(rng, 50)), (8, words(rng, 50))]
    docs = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, lang long").repartition(3)
    kept = simhash.keep_one(docs).collect()
    assert sorted((str(r.doc_id), len(r.text or "") > 50) for r in kept) == sorted([("1", True), ("None", True), ("3", False), ("8", True), ("8", True)])


def test_stage_keeps_one_of_each_group_of_similar_documents(spark):
    sf = str(DATA / "sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = corpus_pipeline.drop_near_copies(spark, docs, sf)
    assert got.columns == docs.columns
    assert {r.doc_id for r in got.collect()} == kept_by_hand([(r.doc_id, r.text) for r in docs.collect()])


def test_pairs_of_busy_nodes_are_dealt_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 3)
    pairs = [(0, k) for k in range(1, 41)] + [(k, 50) for k in range(1, 11)] + [(60, 61)]
    table = jaccard.written(spark.createDataFrame(pairs, "a long, b long"), "pairs")
    busy = jaccard.busy_nodes(table)
    assert {(r["node"], r["parts"]) for r in busy.collect()} == {(0, 14), (50, 4)}
    things = spark.createDataFrame([(k, f"v{k}") for k in range(62)], "node long, v string")
    met = jaccard.with_both(table, jaccard.in_parts(things, busy), "v", busy)
    assert sorted(map(tuple, met.select("a", "b", "x", "y").collect())) == sorted((a, b, f"v{a}", f"v{b}") for a, b in pairs)


def test_groups_equal_brute_force_with_busy_nodes(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FEW", 2)
    test_groups_equal_brute_force(spark, jaccard.CHUNK)


def test_similar_at_the_threshold(spark):
    cases = [(n, m, both) for n in range(13) for m in range(13) for both in range(min(n, m) + 1)]
    sets = [(list(range(n)), list(range(n - both, n - both + m)), both / max(n + m - both, 1) >= 0.8) for n, m, both in cases]
    rows = spark.createDataFrame(sets, "a array<long>, b array<long>, want boolean")
    assert rows.filter(jaccard.similar(F.col("a"), F.col("b")) != F.col("want")).count() == 0


def test_pairs_of_sets_are_compared_without_python(spark):
    docs = spark.createDataFrame(near_rows(), "doc_id long, text string")
    nodes, _ = jaccard.nodes_and_counts(docs)
    ends = [r.node for r in nodes.select("node").distinct().orderBy("node").collect()]
    pairs = spark.createDataFrame([(a, b) for k, a in enumerate(ends) for b in ends[k + 1 :]], "a long, b long")
    met = jaccard.verified(pairs, docs, nodes, jaccard.SHINGLE, jaccard.SIMILARITY)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and not re.search("Pandas|Python|Arrow", plan.split("Join", 1)[0])  # what stands above the joins
    sets = {jaccard.node_of(jaccard.shingles((t or "").encode())): shingle_set(t) for _, t in near_rows()}
    want = {(a, b) for a, b in pairs.collect() if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) and (sets[a] or sets[b])}
    assert {(r.a, r.b) for r in met.collect()} == want and len(want) > 20


def group_on_the_threshold(rng, size):
    """Copies with one or two words changed: of two with two, the similarity is below 0.8, of all other pairs not."""
    base, rows = words(rng, 150).split(), []
    for k in range(size):
        copy = list(base)
        for at in rng.sample(range(5, 145), 1 if k % 8 == 0 else 2):
            copy[at] = words(rng, 1)
        rows.append((k, " ".join(copy)))
    return rows


@pytest.mark.parametrize("chunk", [jaccard.CHUNK, 60])
def test_links_are_linear_in_a_dense_group(spark, chunk):
    rows = group_on_the_threshold(random.Random(21), 240)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    nodes, counts = jaccard.nodes_and_counts(docs)
    links = jaccard.near_links(docs, nodes, counts, chunk=chunk).collect()
    chunks = -(-len(rows) // chunk)
    assert len(links) < len(rows) * (1 + chunks * (chunks + 1) // 2)
    kept = {r.doc_id for r in jaccard.keep_one(docs, chunk=chunk).collect()}
    assert kept == kept_by_hand(rows)


@pytest.mark.parametrize("parts", [1, 2])
def test_links_of_a_block_equal_brute_force(parts):
    rng = random.Random(5)
    sets = sorted(({t for t in range(60) if rng.random() < 0.93} | {100 + rng.randrange(40)} for _ in range(80)), key=len)
    root, part = [k // 2 for k in range(80)], [k % parts for k in range(80)]
    found = [np.sort(np.array([hash((t, 7)) % 2**64 for t in s], np.uint64)) for s in sets]
    pairs = [(i, j) for j in range(80) for i in range(j) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and (parts == 1 or part[i] != part[j])]
    links = jaccard.block_links(found, np.array(root), np.array(part), 0.8)

    def joined(links):
        of = list(root)
        for i, j in links:
            of = [min(of[i], of[j]) if r in (of[i], of[j]) else r for r in of]
        return of

    assert set(links) <= set(pairs) and joined(links) == joined(pairs)
    assert len(links) == len(set(root)) - len(set(joined(links))) > 5


def test_odd_cases(spark):
    got = jaccard.near_groups(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    assert {r.component_id for r in got if r.doc_id in (3, 4, 5)} == {3}
    assert len({r.component_id for r in got if r.doc_id in (1, 2, 6, 7)}) == 1
    assert jaccard.keep_one(odd_docs(spark)).columns == odd_docs(spark).columns
    assert jaccard.near_groups(no_docs(spark)).count() == 0
