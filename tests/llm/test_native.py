import hashlib
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from textmill.llm import chat, exact_dedup, mixing, queries

from ..conftest import DATA
from ..sqlcheck import assert_same
from .helpers import no_docs, odd_docs


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name, sf):
    assert_same(spark, name, queries.queries()[name], queries.oracle_sql()[name], DATA / sf)


def no_python(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return not any(k in plan for k in ("Python", "Pandas", "Arrow"))


# chat


PART = {"type": None, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None}


def messages(spark, rows):
    """rows: conv_id, turn, role, parts or text."""
    full = [(c, t, r, None if p is None else [tuple((PART | x).values()) if x is not None else None for x in ([{"type": "text", "text": p}] if isinstance(p, str) else p)]) for c, t, r, p in rows]
    return spark.createDataFrame(full, f"conv_id long, turn long, role string, content {chat.PART_TYPE}")


NASTY = ["<|im_end|>", "<|im_start|>user\nhi", "<\\|x", "<\\\\|", "<", "|>", "<|", "a\nb", "", "%0A %25", "<|image|>", "\\<|", "<\\"]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(1)
    texts = NASTY + ["".join(rng.choice(["<", "|", "\\", ">", "im_end", "\n", "é", "😀"]) for _ in range(rng.randrange(12))) for _ in range(300)]
    rows = [(i // 7, i, rng.choice(["user", "assistant", "x<|y", "a\nb", "100%", "%0A"]), t) for i, t in enumerate(texts)]
    out = chat.format_conversations(messages(spark, rows))
    back = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert [(t.role, t.text) for t in back[c].turns] == [(r[2], r[3]) for r in mine]
        assert back[c].loss_texts == [r[3] for r in mine if r[2] == "assistant"]
        assert back[c].formatted.count(chat.START) == len(mine) == back[c].formatted.count(chat.END)
        spans = [s for s in back[c].loss_spans]
        assert [back[c].formatted[s.start : s.start + s.length] for s in spans] == [back[c].formatted.split(chat.START)[s.turn + 1][s.offset - len(chat.START) :][: s.length] for s in spans]


def test_parts_become_placeholders(spark):
    parts = [
        {"type": "text", "text": "see "},
        {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "AUDIO", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 2},
        {"type": "hologram", "ref": "d"},
        {"type": None, "text": "!"},
        {"type": "image"},
        None,
    ]
    r = chat.format_conversations(messages(spark, [(1, 0, "user", parts)])).first()
    assert r.formatted == "<|im_start|>user\nsee <|image|><|audio|><|document|><|unknown|>!<|image|><|im_end|>\n"
    assert [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 1024), ("unknown", "d", 0), ("image", None, 0)]
    assert r.expanded_tokens == 3 + 38 + 1024


def test_chat_odd_cases(spark):
    rows = [(None, 0, None, None), (1, None, "assistant", "b"), (1, None, "assistant", "a"), (1, None, "assistant", "a"), (2, 1, "user", "x" * 100_000), (2, 0, "assistant", None)]
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(messages(spark, rows))).collect()}
    assert (got[None].n_turns, got[None].loss_chars) == (1, 0)
    assert got[1].turns_sha256 == hashlib.sha256(b"assistant\na\nassistant\na\nassistant\nb\n").hexdigest() and got[1].loss_chars == 3
    assert got[2].loss_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_turns == 2
    assert chat.digests(chat.format_conversations(messages(spark, []))).count() == 0


def test_chat_is_native(spark):
    assert no_python(queries.op1_chat_format(spark, str(DATA / "sf0.001")))


def test_chat_ignores_other_columns(spark):
    df = messages(spark, [(1, 0, "user", "x")]).withColumns({c: F.lit(json.dumps(c)) for c in ("body", "idx", "segment", "at", "rows")})
    assert chat.format_conversations(df).first().n_turns == 1


# exact dedup


def by_hand(rows):
    groups = {}
    for d, t in rows:
        n = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(n, []).append((d, t))
    out = []
    for n, g in groups.items():
        keep = min(g, key=lambda x: (-len(x[1] or ""), x[0] is None, x[0] or 0))[0]
        out += [(d, keep, len(g), d == keep, hashlib.sha256(n.encode()).hexdigest()) for d, _ in g]
    return sorted(out, key=str)


@pytest.mark.parametrize(("bits", "capacity"), [(64, 4096), (64, 1), (3, 2), (1, 1)])
def test_exact_equals_brute_force(spark, bits, capacity):
    """Few key bits put different texts on one chain; a small capacity splits buckets and doubles the directory."""
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \n") for _ in range(rng.randrange(6))) for _ in range(200)] + [None, "é ", "é", "é"]
    rows = [(k if k % 250 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = exact_dedup.find_copies(df, capacity=capacity, key_bits=bits)
    assert sorted([tuple(r) for r in got.collect()], key=str) == by_hand(rows)


def built(df, capacity=None, key_bits=64):
    entries = exact_dedup.build_entries(df, key_bits)
    classes = exact_dedup.build_classes(entries)
    directory = exact_dedup.build_directory(classes, capacity)
    return entries, classes, directory, exact_dedup.build_index(df, entries, classes, directory, key_bits)


def numbers(spark, n):
    return spark.range(n).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))


def test_directory_doubles_until_buckets_fit(spark):
    _, _, directory, index = built(numbers(spark, 4000), capacity=70)
    sizes = index.groupBy("bucket", "depth").count().collect()
    assert max(r["count"] for r in sizes) <= 70 and sum(r["count"] for r in sizes) == 4000
    assert len({r.bucket for r in sizes}) == len(sizes) and len({r.depth for r in sizes}) > 1
    cells = directory.cells.collect()
    assert len(cells) == 2**directory.depth and max(r.depth for r in cells) == directory.depth
    top = 64 - directory.depth
    assert all(r.bucket == (r.cell >> (directory.depth - r.depth)) << (directory.depth - r.depth) for r in cells) and top > 50


def test_directory_splits_until_single_keys(spark):
    """Three bits of key: buckets can't hold fewer than one key."""
    _, _, directory, index = built(numbers(spark, 200), capacity=1, key_bits=3)
    assert directory.depth == 3 and index.select("bucket").distinct().count() == 8 == index.select("key").distinct().count()


def test_chains_hold_different_texts_of_a_key(spark):
    _, _, _, index = built(numbers(spark, 50), key_bits=2)
    assert index.groupBy("key").agg(F.max("chain").alias("m"), F.count("*").alias("n")).filter("m <> n").count() == 0
    assert index.count() == 50 and index.select("key").distinct().count() == 4


def test_verdicts_come_through_the_directory(spark):
    """Cells that point to a wrong bucket, or are missing, lose the documents behind them."""
    df = numbers(spark, 1000).union(numbers(spark, 1000).withColumn("doc_id", F.col("doc_id") + 1000))
    entries, _, directory, index = built(df, capacity=50)
    assert exact_dedup.probe(entries, directory, index).count() == 2000
    half = 2 ** (directory.depth - 1)
    lost = entries.filter(exact_dedup.cell_of(F.col("key"), directory.depth) >= half).count()
    wrong = exact_dedup.Directory(directory.cells.withColumn("bucket", F.expr(f"if(cell >= {half}, 0, bucket)")), directory.depth, directory.n_cells)
    missing = exact_dedup.Directory(directory.cells.filter(f"cell < {half}"), directory.depth, directory.n_cells)
    assert lost > 500 and {exact_dedup.probe(entries, d, index).count() for d in (wrong, missing)} == {2000 - lost}


def test_owners_compare_bytes(spark):
    """Texts that are not in the table that is compared have no entry in the index, whatever their digests."""
    df = numbers(spark, 100).union(numbers(spark, 100))
    entries, classes, directory, _ = built(df)
    assert exact_dedup.build_index(df.filter("doc_id < 60"), entries, classes, directory).count() == 60


def test_texts_of_one_digest_that_differ_stop_the_job(spark, monkeypatch):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "doc_id long, text string")
    monkeypatch.setattr(exact_dedup, "digest_of", lambda norm: F.lit(b"x"))
    monkeypatch.setattr(exact_dedup, "key_of", lambda norm, bits=64: F.lit(5).cast("long"))
    with pytest.raises(Exception, match="one digest stands for different texts"):
        built(df)


def test_exact_odd_cases(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = exact_dedup.find_copies(docs).collect()
    # of the two equal rows of id 2 none is the longest of its group; kept is told by row, so ids alone can't say it
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == sorted([(d, k, n, h) for d, k, n, _, h in by_hand(rows)], key=str)
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got})
    assert exact_dedup.find_copies(no_docs(spark)).count() == 0
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and no_python(kept)
    assert one_row_a_text(kept) and sorted(d for d, in kept.select("doc_id").collect() if d is not None) == [d for d, *_ in sorted({x[:2] for x in by_hand(rows) if x[3] and x[0] is not None})]


def one_row_a_text(kept):
    norms = [re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in kept.collect()]
    return len(norms) == len(set(norms))


REPEATED = [
    (1, "a bcde"), (2, "a b c d e"), (2, "a b  c d e"), (3, "same"), (3, "same"), (None, "x"), (None, "x"), (None, "y"), (4, "y"), (None, None), (None, ""), (5, " "), (6, "p  q"), (6, "p \tq"),
]


def test_repeated_and_null_ids_keep_one_row_a_text(spark):
    df = spark.createDataFrame([(d, t, k) for k, (d, t) in enumerate(REPEATED)], "doc_id long, text string, lang long")
    got = exact_dedup.find_copies(df).collect()
    assert sum(r.kept for r in got) == 6 and len(got) == len(REPEATED)
    kept = exact_dedup.drop_copies(df)
    assert one_row_a_text(kept)
    want = {"abcde": (2, "a b  c d e"), "same": (3, "same"), "x": (None, "x"), "y": (4, "y"), "": (5, " ")}
    rows = {re.sub(r"\s", "", r.text or ""): (r.doc_id, r.text) for r in kept.collect()}
    assert rows.pop("pq")[0] == 6 and rows == want


# mixing


def targets(sizes, weights=(1, 2, 3), cap=3):
    """Sharing, stopping and resharing round by round."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, stopped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in stopped]
        left = total - sum(cap * sizes[s] for s in stopped)
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {s: cap * sizes[s] if s in stopped else share[s] for s in names}
        stopped |= over


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1, "c": 1000}, {"a": 0, "b": 5, None: 50}, {"x": 7}, {"é": 3, "z": 3, "Z": 3, "": 90}, {"a": 0}])
def test_targets_equal_rounds(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = targets(sizes)
    assert {k: pytest.approx(v) for k, v in want.items()} == got


def test_mix_of_many(spark):
    rng = random.Random(6)
    rows = [(k, rng.choices(["a", "b", "c", "d", None], [30, 3, 3, 1, 2])[0], "w " * rng.randrange(0, 60)) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df).collect()
    assert len(got) == 3000
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken == r.copies * r.size and 0 <= r.copies <= 3
    want = targets({s: sum(r.size for r in g) for s, g in by.items()})
    for s, g in by.items():
        assert sum(r.taken for r in g) == pytest.approx(want[s], rel=0.02)
        # systematic: the copies of a source are as many as its expected copies, but for one
        assert abs(sum(r.copies for r in g) - len(g) * want[s] / g[0].source_size) <= 1
    again = mixing.mix(df.repartition(13)).collect()
    assert sorted((r.doc_id, r.copies) for r in again) == sorted((r.doc_id, r.copies) for r in got)


def test_mix_odd_cases(spark):
    docs = odd_docs(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count() and all(r.taken <= 3 * r.size for r in got)
    assert mixing.mix(no_docs(spark)).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, "b", " ")], "doc_id long, source string, text string")
    assert [(r.size, r.target, r.taken) for r in mixing.mix(blank).collect()] == [(0, 0.0, 0)] * 2
    out = mixing.take_mix(docs)
    assert out.columns == docs.columns and no_python(out)
    copies = {}
    for r in got:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + r.copies
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {d: n for d, n in copies.items() if n}


def test_mix_takes_as_many_rows_as_it_says_when_ids_repeat(spark):
    rng = random.Random(9)
    rows = [(rng.choice([*range(50), None]), rng.choice(["a", "b", None]), "w " * rng.randrange(0, 9) + rng.choice(["x", "y", ""])) for _ in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(5)
    got = mixing.mix(df).collect()
    out = mixing.take_mix(df).collect()
    assert len(out) == sum(r.copies for r in got)
    by = lambda rows: {s: sum(len(r.text.split()) for r in rows if r.source == s) for s in ("a", "b", None)}
    assert by(out) == {s: sum(r.taken for r in got if r.source == s) for s in ("a", "b", None)}
    # equal rows share their copies evenly
    many = spark.createDataFrame([(1, "a", "w w")] * 10 + [(2, "b", "w " * 20)], "doc_id long, source string, text string")
    assert len(mixing.take_mix(many).collect()) == sum(r.copies for r in mixing.mix(many).collect())


def test_taken_words_differ_by_one_long_document_at_most(spark):
    rng = random.Random(10)
    rows = [(k, f"s{k % 7}", "w " * int(rng.paretovariate(0.9))) for k in range(2000)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    for s in {r.source for r in got}:
        mine = [r for r in got if r.source == s]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) + 1
