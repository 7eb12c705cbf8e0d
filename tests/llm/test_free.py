import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textmill.llm import brown, components, ivfpq, license_scan, packing, quality, queries, shingles, simhash, toxicity

from ..conftest import DATA
from .helpers import no_docs, odd_docs, words

LOWER = {c: c + 32 for c in range(65, 91)}
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return SPLIT.findall((text or "").translate(LOWER))


# simhash


def plain_fingerprint(text):
    w = tokens(text)
    shingles = [" ".join(w[k : k + 4]) for k in range(max(1, len(w) - 3))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b c", "a b c d", "a b c d e", "É Ä x\x0by\x1fz q", "x " * 300])
def test_fingerprint(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == plain_fingerprint(text)


def test_hash_is_spark_s_too(spark):
    assert spark.sql("SELECT xxhash64('a b c d') AS h").first().h == shingles.signed(xxhash.xxh64_intdigest(b"a b c d", 42))


def components_by_hand(fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= radius:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(fps))]


def near_fingerprints(rng, n):
    out = [rng.getrandbits(64) for _ in range(n // 3)]
    while len(out) < n:
        x = rng.choice(out)
        for b in rng.sample(range(64), rng.randrange(1, 7)):
            x ^= 1 << b
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("n", "chunk"), [(300, 16384), (300, 8), (40, 3)])
def test_links_connect_what_is_near(spark, n, chunk):
    """Small chunks cut hot keys into pairs of chunks; nothing is lost."""
    fps = near_fingerprints(random.Random(n + chunk), n)
    df = spark.createDataFrame([(shingles.signed(f),) for f in fps], "fp long")
    got = {r.node: r.root for r in components.components(simhash.near_links(df, chunk=chunk)).collect()}
    want = components_by_hand(fps)
    mine = [got.get(shingles.signed(f), shingles.signed(f)) for f in fps]
    assert len(set(zip(mine, want, strict=True))) == len(set(mine)) == len(set(want))


def test_forest_is_linear_in_a_dense_group():
    rng = random.Random(1)
    fps = np.array(sorted({1 << 40 ^ 1 << rng.randrange(64) for _ in range(200)}), np.uint64)
    links = simhash.forest(fps, simhash.pivot_table(fps, simhash.pivot_values()))
    assert len(links) == len(fps) - 1


@pytest.mark.parametrize("n", [2, 1000, 10**6, 10**9])
def test_schemes_miss_no_pair(n):
    masks = simhash.block_scheme(n)
    rng = random.Random(n)
    for _ in range(200):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def test_pivots_never_discard_a_near_pair():
    rng = random.Random(3)
    a = np.array([rng.getrandbits(64) for _ in range(500)], np.uint64)
    b = a ^ np.array([sum(1 << k for k in rng.sample(range(64), 4)) for _ in a], np.uint64)
    p = simhash.pivot_values()
    assert np.abs(simhash.pivot_table(a, p).astype(int) - simhash.pivot_table(b, p)).max() <= 4


def test_near_groups_equal_brute_force(spark):
    rows = queries.op2_simhash(spark, str(DATA / "sf0.001")).orderBy("doc_id").collect()
    fps, ids = [int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows]
    assert [r.component_id for r in rows] == [ids[k] for k in components_by_hand(fps)]
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}
    assert all(int(r.fingerprint, 16) == plain_fingerprint(texts[r.doc_id]) for r in rows[:80])


def test_near_groups_odd_cases(spark):
    got = simhash.near_groups(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count()
    zero = [r for r in got if r.fingerprint == "0" * 16]
    assert {r.doc_id for r in zero} == {3, 4, 5, None} and {r.component_id for r in zero} == {3}
    assert len({r.component_id for r in got if r.doc_id in (1, 2, 6)}) == 1
    fps = [int(r.fingerprint, 16) for r in got]
    groups = {}
    for r, root in zip(got, components_by_hand(fps), strict=True):
        groups.setdefault(root, []).append(r)
    assert all(r.component_id == min((x.doc_id for x in g if x.doc_id is not None), default=None) for g in groups.values() for r in g)
    assert simhash.near_groups(no_docs(spark)).count() == 0
    kept = simhash.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns


def test_near_groups_broadcasts_nothing_that_grows(spark, monkeypatch):
    """Neither sizes of keys nor components nor documents go through the driver, however small Spark takes them to be."""
    plans, write = [], simhash.written

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(simhash, "written", noted)
    monkeypatch.setattr(components, "written", noted)
    monkeypatch.setattr(components, "BROADCAST_EDGES", 0, raising=False)
    noted(simhash.near_groups(spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))), "all")
    assert any("SortMergeJoin" in x for x in plans) and not any("Broadcast" in x for x in plans)


def test_components_of_a_long_path_and_a_star(spark):
    path = [(k, k + 1) for k in range(200)]
    star = [(1000, 1000 + k) for k in range(1, 50)] + [(5000, 5000)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(path + star, "a long, b long")).collect()}
    assert {got[k] for k in range(201)} == {0} and {got[1000 + k] for k in range(50)} == {1000} and 5000 not in got


# packing


@pytest.fixture(scope="module")
def encoder():
    return packing.Encoder(*packing.public_encoder_paths())


def test_encoder_equals_the_library(encoder):
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(packing.public_encoder_paths()[0])
    rng = random.Random(9)
    texts = ["", " ", "\n\n x", "a" * 9000, " " * 5000 + "x", "<|endoftext|>", "x<|endoftext|>y", "it's we'll 123 ½ ² 漢字 😀👍🏽 ​ 　 ñ́"]
    texts += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x2FFF), rng.randrange(0x1F300, 0x1F700), 10, 32])) for _ in range(200)) for _ in range(200)]
    for t in texts:
        assert encoder(t).tolist() == slow.encode(t, add_special_tokens=False).ids, t[:40]


def test_window_fills_sequences():
    rng = random.Random(8)
    for lengths in ([1], [2048], [2049, 5], [rng.randrange(1, 6000) for _ in range(300)], [1] * 3000, []):
        pieces = packing.pack_window(lengths)
        room, seen = Counter(), Counter()
        for d, start, n, seq, at in sorted(pieces, key=lambda p: (p[3], p[4])):
            assert at == room[seq] and n > 0
            room[seq] += n
            seen[d] += n
        assert [seen[d] for d in range(len(lengths))] == lengths
        assert all(v <= 2048 and v & (v - 1) == 0 for v in room.values())
        for d in range(len(lengths)):
            mine = sorted((s, n) for e, s, n, _, _ in pieces if e == d)
            assert [s for s, _ in mine] == np.cumsum([0] + [n for _, n in mine])[:-1].tolist()


def test_window_equals_plain_placement():
    """Written down plainly: descending rests, each to the sequence of least cost with room, else cut to fill the widest."""
    rng = random.Random(21)
    for lengths in ([rng.randrange(1, 5000) for _ in range(200)], [700] * 90, [2047, 2, 1, 1, 2047], [4096], [5], []):
        want, rests, full = [], [], 0
        for d, n in enumerate(lengths):
            start = 0
            while n - start >= 2048:
                want.append((d, start, 2048, full, 0))
                start, full = start + 2048, full + 1
            if n > start:
                rests.append((d, start, n - start))
        total = sum(n for _, _, n in rests)
        sizes = [2048] * (total // 2048) + [1 << b for b in range(11) if total % 2048 >> b & 1]
        used, cost = [0] * len(sizes), [0.0] * len(sizes)
        for d, start, n in sorted(rests, key=lambda r: (-r[2], r[0])):
            while n:
                wide = [k for k in range(len(sizes)) if sizes[k] - used[k] >= n]
                k = min(wide, key=lambda k: cost[k]) if wide else max(range(len(sizes)), key=lambda k: sizes[k] - used[k])
                take = min(n, sizes[k] - used[k])
                want.append((d, start, take, full + k, used[k]))
                used[k] += take
                cost[k] += take + take * take / 2048
                start, n = start + take, n - take
        assert sorted(packing.pack_window(lengths)) == sorted(want)
        assert used == sizes


def test_costs_are_balanced():
    rng = random.Random(8)
    lengths = [rng.choice([30, 100, 400, 1500]) for _ in range(2000)]

    def spread(pieces):
        cost = Counter()
        full = Counter()
        for _, _, n, seq, _ in pieces:
            cost[seq] += packing.piece_cost(n)
            full[seq] += n
        values = [c for s, c in cost.items() if full[s] == 2048]
        return np.std(values) / np.mean(values)

    in_turn, seq, room = [], 0, 2048
    for d, n in enumerate(lengths):
        while n:
            take = min(n, room)
            in_turn.append((d, 0, take, seq, 0))
            n, room = n - take, room - take
            if not room:
                seq, room = seq + 1, 2048
    assert spread(packing.pack_window(lengths)) < spread(in_turn)


def test_pack_round_trip(spark, encoder):
    docs = odd_docs(spark)
    rows = packing.pack(docs, packing.public_encoder_paths()).collect()
    texts = {}
    for r in docs.collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for doc_id, given in texts.items():
        if len(given) == 1:
            whole = b"".join(r.ids for r in sorted(by_doc[doc_id], key=lambda r: r.start))
            want = [*encoder(given[0] or "").tolist(), 1]
            assert np.frombuffer(whole, "<u4").tolist() == want and by_doc[doc_id][0].doc_tokens == len(want)
    assert by_doc[4][0].doc_tokens == 1
    fill = Counter()
    for r in rows:
        fill[r.sequence_id] += r.length
    assert all(v <= 2048 and v & (v - 1) == 0 for v in fill.values())
    assert packing.pack(no_docs(spark), packing.public_encoder_paths()).count() == 0


# quality and toxicity


def auc(y, s):
    order = np.argsort(s, kind="stable")
    ranks = np.empty(len(s))
    ranks[order] = np.arange(1, len(s) + 1)
    n1 = y.sum()
    return (ranks[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.97), ("op8_toxicity", "toxic", 0.75)])
def test_held_out_rows(spark, name, label, least):
    sf = str(DATA / "sf0.01")
    rows = queries.queries()[name](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert held.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0).all() and len(held) > 30
    assert auc(held[label].to_numpy(), held.score.to_numpy()) >= least
    assert ((held.predicted == 1) == (held.score >= (0.3 if label == "quality" else 0.5))).all()
    assert (held.predicted == held[label]).mean() >= 0.93


def test_machine_equals_pairwise_sums():
    rng = np.random.default_rng(1)
    m = quality.Model(0.3, rng.normal(size=50), rng.normal(size=(50, 4)))
    ids, x = np.array([1, 5, 7, 30]), rng.normal(size=4)
    z = 0.3 + m.w[ids] @ x + sum(m.v[ids[i]] @ m.v[ids[j]] * x[i] * x[j] for i in range(4) for j in range(i))
    assert m.score(ids, x) == pytest.approx(1 / (1 + math.exp(-z)))


def test_quality_features_take_odd_texts():
    for t in (None, b"", b" \n", "é😀".encode(), b"\x00\xff", b"x" * 100_000):
        ids, x = quality.features(t, None)
        assert len(ids) == len(x) and np.isfinite(x).all() and ids.max() < quality.WORD_DIM + quality.BINS


@pytest.mark.parametrize("op", [(quality.score_quality, "quality"), (toxicity.score_toxicity, "toxic")])
def test_classifiers_odd_cases(spark, op):
    score, label = op
    none = spark.createDataFrame([], f"doc_id long, {label} int")
    got = score(odd_docs(spark), none).collect()
    assert len(got) == odd_docs(spark).count() and {r.score for r in got} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1), (None, 0), (7, None)], f"doc_id long, {label} int")
    assert all(r.score > 0.9 for r in score(odd_docs(spark), one).collect())
    both = spark.createDataFrame([(1, 1), (8, 0), (6, 1), (10, 0), (-5, 0)], f"doc_id long, {label} int")
    assert all(0 <= r.score <= 1 for r in score(odd_docs(spark), both).collect())
    assert score(no_docs(spark), both).count() == 0


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(5)
    terms = {"".join(rng.choice("abc") for _ in range(rng.randrange(3, 11))): rng.random() for _ in range(40)}
    a = toxicity.Automaton(terms)
    hits = 0
    for _ in range(3000):
        w = rng.choice(list(terms)) if rng.random() < 0.5 else "".join(rng.choice("abc") for _ in range(rng.randrange(0, 12)))
        if w and rng.random() < 0.6:
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1 :], w[:k] + "x" + w[k:], w[:k] + "x" + w[k + 1 :]])
        near = {t: d for t in terms if (d := edit_distance(w, t)) <= toxicity.edits_allowed(t)}
        got = a.find(w)
        assert bool(got) == bool(near), w
        if near:
            hits += 1
            assert got[0][1] == min(near.values()) == near[got[0][0]]
    assert hits > 500


def test_stems_accept_any_ending():
    a = toxicity.Automaton({"lowei*": 1.0, "loser": 2.0})
    assert a.find("loweischaft") == (("lowei*", 0),) and a.find("lowe") == ()
    assert a.find("lozer") == (("loser", 1),) and a.find("") == ()


def test_quotation_counts_less():
    a = toxicity.Automaton({"idiot": 3.0})
    plain = toxicity.features("you are an idiot and more words follow here", a)
    quoted = toxicity.features('she said the word "idiot" was written on it', a)
    assert plain[5] > quoted[5] and quoted[7] > plain[7] == 0 and plain[6] > quoted[6]


def test_drop_toxic_keeps_columns(spark):
    sf = str(DATA / "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    kept = toxicity.drop_toxic(docs, labels)
    scores = {r.doc_id: r.predicted for r in toxicity.score_toxicity(docs, labels).collect()}
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, p in scores.items() if not p}


# language model


def test_lm_counts_equal_brute_force(spark):
    sf = str(DATA / "sf0.001")
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    counts = Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*tokens(t), "\n"])
    n, v = sum(counts.values()), len(counts)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for head in (100, brown.HEAD):  # nearly all words go by the join, or none
        for r in brown.score_texts(docs, head_size=head).collect():
            w = [*tokens(texts[r.doc_id]), "\n"]
            assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
            assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w))
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)


def test_lm_beats_its_base_on_held_out_rows(spark):
    rows = queries.op6_class_lm(spark, str(DATA / "sf0.01")).filter("held_out").toPandas()
    assert rows.score.sum() > rows.base_score.sum() and (rows.score > rows.base_score).mean() > 0.9


def test_exchange_climbs(spark):
    rng = np.random.default_rng(2)
    groups = rng.integers(0, 3, 40)
    b = np.zeros((40, 40))
    for _ in range(4000):
        u = rng.integers(1, 40)
        v = rng.choice(np.flatnonzero(groups == (groups[u] + 1) % 3))
        b[u, v] += 1

    def likelihood(of):
        m = np.zeros((4, 4))
        np.add.at(m, (of[:, None], of[None, :]), b)
        f = lambda x: (x * np.log(np.maximum(x, 1))).sum()
        return f(m) - f(m.sum(0)) - f(m.sum(1))

    start = np.zeros(40, int)
    order = np.argsort(-b.sum(1), kind="stable")
    order = order[order != 0]
    start[order] = 1 + np.arange(39) % 3
    of = brown.exchange(b, classes=4)
    assert of[0] == 0 and (of[1:] > 0).all()
    assert likelihood(of) > likelihood(start)
    # no single move helps any more
    best = likelihood(of)
    for u in range(1, 40):
        for c in range(1, 4):
            other = of.copy()
            other[u] = c
            assert likelihood(other) <= best + 1e-6


def test_model_is_a_distribution():
    rng = np.random.default_rng(0)
    pairs = rng.integers(0, 50, (brown.CLASSES, brown.CLASSES)).astype(float)
    distinct = rng.integers(1, 40, brown.CLASSES).astype(float)
    m = brown.Model(pairs, distinct, int(pairs.sum()), int(distinct.sum()))
    assert np.allclose((10**m.transitions).sum(1), 1)
    assert np.allclose((pairs.sum(0) + brown.ADD * distinct + brown.ADD) / m.room, 1)


def test_words_go_to_the_class_of_greatest_likelihood():
    rng = np.random.default_rng(1)
    pairs = rng.integers(1, 60, (6, 6)).astype(float)
    before, behind = rng.integers(0, 9, (20, 6)).astype(float), rng.integers(0, 9, (20, 6)).astype(float)
    got = brown.best_classes(before, behind, pairs)
    m = pairs + brown.PULL / 6
    for w in range(20):
        n = before[w].sum()

        def likelihood(b, w=w, n=n):
            ahead = sum(behind[w, c] * math.log(m[b, c] / m[b].sum()) for c in range(6))
            return ahead + sum(before[w, c] * math.log(m[c, b] / m[c].sum()) for c in range(6)) - n * math.log(m[:, b].sum())

        assert got[w] == max(range(1, 6), key=likelihood)


def test_lm_score_equals_brute_force(spark, monkeypatch):
    """Classes as found; transitions, emissions and smoothing by hand."""
    docs = spark.read.parquet(str(DATA / "sf0.001/documents.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    found = {}

    def cluster(encoded, known, clustered, real=brown.cluster):
        classes, pairs = real(encoded, known, clustered)
        found.update(classes=classes, known=known)
        return classes, pairs

    monkeypatch.setattr(brown, "cluster", cluster)
    got = brown.score_texts(docs, head_size=6000, clustered=3000).collect()
    classes, known = found["classes"], found["known"]
    assert len(set(classes[brown.WORD_UNITS : 3000])) > 20
    of = lambda w: 0 if w == "\n" else int(classes[known.place[w.encode()]] if w.encode() in known.place else classes[known.size + brown.form_of(w.encode())])
    counts, pairs = Counter(), Counter()
    for i, t in texts.items():
        if zlib.crc32(str(i).encode()) % 10:
            w = [*tokens(t), "\n"]
            counts.update(w)
            c = [0, *map(of, w)]
            pairs.update(zip(c, c[1:]))
    size, out, kinds = Counter(), Counter(), Counter(map(of, counts))
    for (a, b), n in pairs.items():
        size[b] += n
        out[a] += n
    total = sum(size.values())
    share = lambda c: (size[c] + 1) / (total + brown.CLASSES)
    for r in got:
        w = [*tokens(texts[r.doc_id]), "\n"]
        c = [0, *map(of, w)]
        score = sum(math.log10((pairs[a, b] + brown.PULL * share(b)) / (out[a] + brown.PULL)) for a, b in zip(c, c[1:]))
        score += sum(math.log10((counts[x] + brown.ADD) / (size[k] + brown.ADD * (kinds[k] + 1))) for x, k in zip(w, c[1:]))
        assert r.score == pytest.approx(score)


def test_lm_odd_cases(spark):
    got = brown.score_texts(odd_docs(spark)).collect()
    assert len(got) == odd_docs(spark).count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert all(r.n_tokens == 1 for r in got if r.doc_id in (3, 4, 5))
    assert brown.score_texts(no_docs(spark)).count() == 0
    only_held_out = spark.createDataFrame([(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 10 == 0), "a b")], "doc_id long, text string")
    r = brown.score_texts(only_held_out).first()
    assert (r.train_tokens, r.n_known, r.n_tokens) == (0, 0, 3) and math.isfinite(r.score)


# nearest neighbours


def nearest_by_hand(ids, x, q, k):
    s = x @ x[q]
    order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[q]]
    return [(int(ids[j]), float(s[j])) for j in order[:k]]


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall(spark, sf):
    table = spark.read.parquet(str(DATA / sf / "embeddings.parquet")).toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    got = queries.op7_nearest(spark, str(DATA / sf)).toPandas()
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        mine = got[got.query_id == ids[q]].sort_values("rank")
        assert mine["rank"].tolist() == list(range(1, 21))
        want = dict(nearest_by_hand(ids, x, q, 20))
        recall.append(len(want.keys() & set(mine.vec_id)) / 20)
        scores = mine.score.to_numpy()
        assert (np.diff(scores) <= 0).all()
        assert np.allclose(scores, [x[np.flatnonzero(ids == v)[0]] @ x[q] for v in mine.vec_id], atol=1e-12)
    assert np.mean(recall) >= 0.93


def test_clustered_vectors_of_any_length(spark):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(20, 10)), 30, axis=0) * rng.uniform(0.5, 3, (600, 1)) + rng.normal(0, 0.05, (600, 10))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ivfpq.search(df, F.col("vec_id") % 20 == 0, k=10).toPandas()
    recall = [len(dict(nearest_by_hand(np.arange(600), x, q, 10)).keys() & set(got[got.query_id == q].vec_id)) / 10 for q in range(0, 600, 20)]
    assert np.mean(recall) >= 0.95


def test_few_cells_are_probed_where_vectors_have_clusters(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(150, 32)), 80, axis=0) + rng.normal(0, 0.25, (12000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = ivfpq.Index(x[:: 2], 64)
    assert index.share_to_probe(x[::2], 20) < 0.2
    flat = rng.normal(size=(4000, 64))
    assert ivfpq.Index(flat, 64).share_to_probe(flat, 20) > 0.5
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = ivfpq.search(df, F.col("vec_id") % 200 == 0, k=20).toPandas()
    recall = [len(dict(nearest_by_hand(np.arange(12000), x, q, 20)).keys() & set(got[got.query_id == q].vec_id)) / 20 for q in range(0, 12000, 200)]
    assert np.mean(recall) >= 0.93


def test_ties_and_a_hot_vector(spark):
    """A third of all vectors are the same: chunks of a cell, ties to smaller ids."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 8))
    x[::3] = x[0]
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    old, ivfpq.VECTOR_CHUNK = ivfpq.VECTOR_CHUNK, 50
    try:
        got = ivfpq.search(df, F.col("vec_id") == 0, k=5, probed=1.0).orderBy("rank").collect()
    finally:
        ivfpq.VECTOR_CHUNK = old
    want = nearest_by_hand(np.arange(900), x, 0, 5)
    assert [r.score for r in got] == pytest.approx([s for _, s in want])
    if want[0][1] == pytest.approx(x[0] @ x[0]):
        assert [r.vec_id for r in got] == [3, 6, 9, 12, 15]


def test_vectors_odd_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (40, [nan, 1.0]), (4, [inf, 1.0]), (5, [1.0, None]), (6, [1.0]), (None, [1.0, 1.0]), (7, []), (20, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({c: F.lit(1) for c in ("cell", "codes", "query", "v", "q", "rank", "score")})
    got = ivfpq.search(df, F.col("vec_id") % 20 == 0, k=20).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 6, 1.0), (0, 2, 20, 1.0), (0, 3, 20, 1.0), (0, 4, 1, 0.5), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 1, 0.5)]
    assert ivfpq.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert ivfpq.search(df.filter("vec_id IN (2, 3)"), F.col("vec_id") % 20 == 0).count() == 0


# licenses


def license_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def license_by_hand(text):
    w = license_words(text)
    places = [(k, label) for phrase, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    best = {}
    for label, template in license_scan.TEMPLATES:
        t = set(license_words(template))
        size = license_scan.block_size(len(license_words(template)))
        for b in range(max(len(w) - size, 0) + 1):
            n = len(t.intersection(w[b : b + size]))
            if n >= math.ceil(license_scan.THRESHOLD * len(t) - 1e-9):
                best[label] = max(best.get(label, 0), n / len(t))
    base = {label for _, label in places}
    starts = [k for k, _ in places]
    return (len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | best.keys())), pytest.approx(1.0 if base else max(best.values(), default=0.0)))


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for k in range(150):
        parts = [words(rng, rng.randrange(0, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            t = license_words(rng.choice(license_scan.TEMPLATES)[1])
            for _ in range(rng.randrange(2 + len(t) // 10)):
                t[rng.randrange(len(t))] = rng.choice(["x", "the", "license"])
            for _ in range(rng.randrange(2 + len(t) // 8)):
                t.insert(rng.randrange(len(t)), "foreign")
            parts.insert(rng.randrange(4), rng.choice([" ", "-", ", "]).join(t).upper())
        if rng.random() < 0.5:
            parts.insert(1, rng.choice(["CC BY cc-by", "MIT licenses", "the MIT/license", "Apache License"]))
        rows.append((k, "\n".join(parts)))
    rows += [(1000, None), (1001, ""), (1002, "é cc by ü"), (None, "mit license")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = license_scan.scan(df).collect()
    assert len(got) == len(rows)
    texts = {d: t for d, t in rows}
    labelled = 0
    for r in got:
        labelled += bool(r.labels)
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == license_by_hand(texts[r.doc_id]), r.doc_id
        w = license_words(texts[r.doc_id])
        for x in r.blocks:
            block, best = w[x.start : x.start + x.length], 0
            for label, template in license_scan.TEMPLATES:
                t, size = set(license_words(template)), license_scan.block_size(len(license_words(template)))
                if label == x.label and len(block) >= min(size, len(w)):
                    shares = [len(t.intersection(block[b : b + size])) / len(t) for b in range(max(len(block) - size, 0) + 1)]
                    # every block of the run meets the threshold
                    best = max(best, max(shares) if min(shares) >= license_scan.THRESHOLD - 1e-9 else 0)
            assert best >= x.score - 1e-9
    assert labelled > 40


def test_license_query_and_odd_cases(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(str(DATA / "sf0.001/documents.parquet")).collect()}
    for r in queries.op9_license_scan(spark, str(DATA / "sf0.001")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == license_by_hand(texts[r.doc_id])
    assert license_scan.scan(odd_docs(spark)).count() == odd_docs(spark).count()
    assert license_scan.scan(no_docs(spark)).count() == 0
