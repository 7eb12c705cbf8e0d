import random

import pytest
from pyspark.sql import functions as F

from textmill import schema
from textmill.operators import chunking
from textmill.sources import splitting


def requests(spark, rows):
    full = [{f.name: r.get(f.name) for f in schema.REQUEST.fields} for r in rows]
    return spark.createDataFrame([tuple(r.values()) for r in full], schema.REQUEST)


def units(spark, kind, text, fmt=None):
    rows = chunking.units(requests(spark, [{"ingest_id": "a", "type": kind, "text": text, "format": fmt}])).orderBy("pos").collect()
    return [(r.text, r.heading) if fmt == "md" else r.text for r in rows]


def log_model(text):
    """A loop over the lines, one state."""
    out, cur = [], []
    for line in text.removesuffix("\n").split("\n"):
        line = line.removesuffix("\r")
        if not splitting.strip(line):
            if cur:
                out.append("\n".join(cur))
            cur = []
            out.append(line)
        elif line[0] in " \t" and cur:
            cur.append(line)
        else:
            if cur:
                out.append("\n".join(cur))
            cur = [line]
    return out + (["\n".join(cur)] if cur else [])


def test_log_golden(spark):
    text = "2026-09-29 INFO start\n\nERROR boom\n    at foo()\n\tat bar()\nINFO done\r\n"
    assert units(spark, "log", text) == ["2026-09-29 INFO start", "", "ERROR boom\n    at foo()\n\tat bar()", "INFO done"]


def test_log_equals_model(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(["a", " ", "\t", "\n", "\n", "\r\n", "x y", " ", "b"]) for _ in range(rng.randrange(0, 40))) for _ in range(300)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: list(r.e) for r in df.select("i", chunking.log_entries(F.col("t")).alias("e")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == log_model(t), repr(t)


def test_paragraphs_golden(spark):
    assert units(spark, "document", "First para\nline two.\n\n\n\nSecond para.\n", "txt") == ["First para\nline two.", "Second para."]


def test_dialogue_keeps_text_and_names_turns(spark):
    turns = [("a", "  Hello,\nworld!  ", None, None), ("b", "x", "mine", None)]
    rows = chunking.candidates(requests(spark, [{"ingest_id": "a", "type": "dialogue", "turns": turns}])).orderBy("pos").collect()
    assert [(r.text, r.turn_id, r.part) for r in rows] == [("  Hello,\nworld!  ", "t1", None), ("x", "mine", None)]


MARKDOWN = "# Policy\n\nIntro text.\n\n## Retention\n\nLogs are kept for 90 days.\n\n```\ncode\n\nstill code\n```\n\n### Detail\n\nDeep.\n\n## Access\n\nAdmins only.\n"


def test_markdown_golden(spark):
    r = "# Policy > ## Retention"
    assert units(spark, "document", MARKDOWN, "md") == [
        ("# Policy", None),
        ("Intro text.", "# Policy"),
        ("## Retention", "# Policy"),
        ("Logs are kept for 90 days.", r),
        ("```\ncode\n\nstill code\n```", r),
        ("### Detail", r),
        ("Deep.", r + " > ### Detail"),
        ("## Access", "# Policy"),
        ("Admins only.", "# Policy > ## Access"),
    ]


def test_long_turn_becomes_parts_with_lineage(spark):
    long = "\n\n".join(" ".join(["word"] * 100) + f" {k}" for k in range(30))
    turns = [("u", f"turn {k}" if k != 7 else long, None, None) for k in range(20)]
    rows = chunking.candidates(requests(spark, [{"ingest_id": "a", "type": "dialogue", "turns": turns}])).orderBy("pos", "part").collect()
    parts = [r for r in rows if r.part]
    assert len(rows) == 49 and len(parts) == 30
    assert {r.parts for r in parts} == {30} and {r.turn_id for r in parts} == {"t8"} and len({r.parent_id for r in parts}) == 1
    assert [r.part for r in parts] == list(range(1, 31))


def test_oversize_paragraph(spark):
    rows = chunking.candidates(requests(spark, [{"ingest_id": "a", "type": "document", "format": "txt", "text": "A sentence that keeps going. " * 100}])).collect()
    assert len(rows) == 3 and max(len(r.text) for r in rows) <= 1024


def test_white_space_over_the_limit_leaves_nothing(spark):
    assert chunking.candidates(requests(spark, [{"ingest_id": "a", "type": "dialogue", "turns": [("u", " " * 2000, None, None)]}])).count() == 0


def boundary_model(text, limit):
    """The splitter as nested searches over a shrinking remainder."""
    out, rest = [], text
    while len(rest.encode()) > limit:
        b = rest.encode()
        head = b[:limit].decode("utf-8", "ignore")
        cut = max(head.rfind("\n"), head.rfind("\r"))
        if cut <= 0:
            best = max(head.rfind(p) for p in (". ", "! ", "? ", "; "))
            cut = best + 1 if best > cut else cut
        for chars in (" \t", ",:-|"):
            if cut <= 0:
                cut = max(head.rfind(c) for c in chars)
        if cut <= 0:
            tail = b[limit : limit + limit // 5].decode("utf-8", "replace")
            found = [k for k, c in enumerate(tail) if c in " \t\r\n"]
            cut = len(b[: limit + len(tail[: found[0]].encode())].decode("utf-8", "ignore")) if found and b[limit] & 0xC0 != 0x80 else -1 if not found else -2
            if cut == -2:
                return None  # a character lies across the limit: not modelled
        if cut <= 0:
            cut = len(head)
        if splitting.strip(rest[:cut]):
            out.append(splitting.strip(rest[:cut]))
        rest = splitting.strip(rest[cut:])
    return out + ([rest] if rest else [])


def test_split_equals_model():
    rng = random.Random(5)
    tried = 0
    for _ in range(3000):
        text = "".join(rng.choice(["a", "bc", "é", "漢", " ", ". ", ", ", "\n", "\t", "wörd", ":", " "]) for _ in range(rng.randrange(1, 80)))
        limit = rng.randrange(8, 40)
        want = boundary_model(text, limit)
        if want is not None and len(text.encode()) > limit:
            tried += 1
            assert splitting.split_bytes(text, limit) == want, (text, limit)
    assert tried > 1500


def test_split_golden():
    text = "This is sentence one. This is sentence two which is longer. And here is sentence three to finish."
    pieces = splitting.split_bytes(text, 30)
    assert len(pieces) >= 3 and max(map(len, pieces)) <= 35


def test_very_long_word_is_cut_at_characters():
    pieces = splitting.split_bytes("é" * 5000, 101)
    assert "".join(pieces) == "é" * 5000 and max(len(p.encode()) for p in pieces) <= 101


@pytest.mark.parametrize(
    ("text", "mode", "n"),
    [
        ("Line 1\n\nLine 2 paragraph\nMore text\n\nLine 3", "para", 3),
        ("Line 1\n\nLine 2 paragraph\nMore text\n\nLine 3", "line", 4),
        ("2026-01-01 a\n2026-01-01 b\n\n2026-01-01 c\n2026-01-01 d", "auto", 4),
        ("ERROR x\n  at y\n  at z\nINFO done", "line", 2),
        ("one\n\ntwo", "auto", 2),
        ("only one", "auto", 1),
        ("   \n ", "auto", 0),
        ("a\nb", "other", 2),
    ],
)
def test_plain_text_modes(text, mode, n):
    assert len(splitting.plain_text(text, mode)) == n
