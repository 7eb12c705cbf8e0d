import random

import pytest

from textmill.config import EngineConfig
from textmill.functions.text import java_pattern
from textmill.operators import chunking, floor

from .test_chunking import requests

LOG = """2026-09-29T10:00:00Z INFO service started

-----
64 bytes from 192.168.8.1: icmp_seq=1 ttl=64 time=0.4 ms
2026-09-29T10:00:01Z WARN disk at 91%
   \n==========
heartbeat seq=12 status=ok
2026-09-29T10:00:01Z WARN disk at 91%
PING 192.168.8.1 (192.168.8.1) 56(84) bytes of data.
ERROR heartbeat missed from node2 for 30s
From 192.168.8.9 icmp_seq=3 Destination Host Unreachable
heartbeat failed: status not ok
retention period is 90 days
****
pong"""


def run(spark, rows, config=None):
    return floor.floored(chunking.candidates(requests(spark, rows)), config)


def kept(spark, rows, config=None):
    return [r.text for r in floor.kept(run(spark, rows, config)).orderBy("ingest_id", "pos", "part").collect()]


def counts(df):
    r = floor.counts(df, "ingest_id").first()
    return (r.blank, r.separator, r.heartbeat, r.duplicate)


def test_log_golden(spark):
    lines = LOG.split("\n")
    rows = [{"ingest_id": "a", "type": "log", "text": LOG}]
    assert kept(spark, rows) == [lines[k - 1] for k in (1, 5, 11, 12, 13, 14)]
    assert counts(run(spark, rows)) == (2, 3, 4, 1)


def test_raw_log_golden(spark):
    text = "INFO a\n\n-----\nheartbeat seq=1 status=ok\nINFO a\nWARN b\n=====\n64 bytes from 10.0.0.1: icmp_seq=4 ttl=64 time=1 ms\n\nERROR c\n"
    rows = [{"ingest_id": "a", "type": "log", "text": text}]
    assert kept(spark, rows) == ["INFO a", "WARN b", "ERROR c"]
    assert counts(run(spark, rows)) == (2, 2, 2, 1)


def test_short_document_chunks_survive(spark):
    texts = ["ok", "-", "--", "# Title", "1", "Title\n====="]
    assert kept(spark, [{"ingest_id": "a", "type": "document", "format": "txt", "text": "\n\n".join(texts)}]) == texts


def dialogue(*turns):
    return [{"ingest_id": "a", "type": "dialogue", "turns": [(s, t, None, None) for s, t in turns]}]


@pytest.mark.parametrize(
    ("turns", "want", "n"),
    [
        ([("a", "Shall I delete the logs?"), ("u", "yes"), ("a", "Shall I restart the service?"), ("u", "yes")], [1, 2, 3, 4], (0, 0, 0, 0)),
        ([("a", "Are you sure?"), ("u", "yes"), ("a", "Are you sure?"), ("u", "yes")], [1, 2, 3], (0, 0, 0, 1)),
        ([("u", "Ready?"), ("a", "yes"), ("u", "yes")], [1, 2, 3], (0, 0, 0, 0)),
        ([("a", "Proceed?"), ("u", "yes"), ("a", "   "), ("u", "hold on"), ("u", "yes")], [1, 2, 4], (1, 0, 0, 1)),
        ([("a", "ping"), ("u", "heartbeat ok")], [1, 2], (0, 0, 0, 0)),
    ],
)
def test_dialogue_goldens(spark, turns, want, n):
    df = run(spark, dialogue(*turns))
    assert [int(r.turn_id[1:]) for r in floor.kept(df).orderBy("pos").collect()] == want
    assert counts(df) == n


def test_question_equals_look_back(spark):
    rng = random.Random(1)
    dialogues = [[(rng.choice("abc"), rng.choice(["x", "y", "z", "  "])) for _ in range(rng.randrange(1, 14))] for _ in range(150)]
    rows = [{"ingest_id": str(i), "type": "dialogue", "turns": [(s, t, None, None) for s, t in d]} for i, d in enumerate(dialogues)]
    got = {(r.ingest_id, r.pos): r.question for r in floor.with_question(chunking.candidates(requests(spark, rows))).collect()}
    import hashlib

    for i, d in enumerate(dialogues):
        for k, (s, _) in enumerate(d):
            back = [t for q, t in d[:k] if t.strip() and q != s]
            assert got[(str(i), k)] == (hashlib.sha256(back[-1].encode()).hexdigest()[:32] if back else "")


def test_requests_are_apart_and_types_can_be_switched_off(spark):
    rows = [{"ingest_id": k, "type": "log", "text": "same\nsame\npong"} for k in "ab"]
    assert kept(spark, rows) == ["same", "same"]
    off = EngineConfig.load({"FLOOR_DEDUP_TYPES": "", "FLOOR_HEARTBEAT_TYPES": " "})
    assert kept(spark, rows[:1], off) == ["same", "same", "pong"]


def test_empty_table(spark):
    assert floor.counts(run(spark, []), "ingest_id").count() == 0


def test_pattern_rewrite():
    assert java_pattern(r"^\d+$") == r"(?d)^[0-9]+\z"
    assert java_pattern(r"(?m)^a$") == r"(?d)(?m)^a$"
    assert java_pattern(r"[\s\d$]") == r"(?d)[\t\n\f\r 0-9$]"


def test_word_edges_equal_their_long_form():
    import re

    from textmill.functions.text import _EDGE

    patterns = [r"\bab", r"\b\d+", r"\b[A-Z_]{3,}", r"\b[a-c]+x", r"\bx*y", r"\bx?y", r"\bx{0,2}y", r"\b[a-c]*x", r"\b[a-c]{0,1}x", r"\b(a|-)", r"\b-", r"\b\d?y", r"x\b"]
    rng = random.Random(8)
    texts = ["".join(rng.choice("abcxyABC_0 1-é") for _ in range(rng.randrange(14))) for _ in range(2000)]
    for p in patterns:
        fast = re.compile(java_pattern(p).removeprefix("(?d)").replace(r"\z", r"\Z"))
        slow = re.compile(p.replace(r"\b", _EDGE).replace(r"\d", "[0-9]"))
        for t in texts:
            assert [m.span() for m in fast.finditer(t)] == [m.span() for m in slow.finditer(t)], (p, t)
