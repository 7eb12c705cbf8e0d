import json

import pytest

from textmill.config import EngineConfig
from textmill.plans import ingest
from textmill.sources.requests import read_files, read_json, validate

from .test_chunking import requests

BASE = {"type": "log", "source": "s", "session": "x", "text": "line"}


def errors(spark, bodies):
    df = spark.createDataFrame([(str(k), b if isinstance(b, str) else json.dumps(b)) for k, b in enumerate(bodies)], "ingest_id string, json string")
    rows = validate(read_json(df)).orderBy(read_json(df).ingest_id.cast("int")).collect()
    return [(r.error.code, r.error.field) if r.error else None for r in sorted(rows, key=lambda r: int(r.ingest_id))]


def without(*keys, **more):
    return {k: v for k, v in BASE.items() if k not in keys} | more


CASES = [
    (BASE, None),
    (without("type"), ("missing_label", "type")),
    (without(type="chat"), ("invalid_label", "type")),
    (without("source"), ("missing_label", "source")),
    (without("session"), ("missing_label", "session")),
    (without("text", type="dialogue", turns=[{"speaker": "a", "text": "x"}, {"text": "y"}]), ("missing_label", "turns[1].speaker")),
    (without(type="dialogue"), ("missing_label", "speaker")),
    ({"origin": "o", "data": "d"}, ("invalid_json", None)),
    ("{broken", ("invalid_json", None)),
    ("[1]", ("invalid_json", None)),
    (without(source=5), ("invalid_json", None)),
    (without("text", type="dialogue", turns=[{"speaker": "a", "text": "x", "mood": "!"}]), ("invalid_json", None)),
    (without(speaker="bob"), ("invalid_label", "turns")),
    (without("text", type="dialogue", turns=[{"speaker": "a", "text": "x"}], speaker="b"), ("invalid_label", "turns")),
    (without("text", type="dialogue", turns=[{"speaker": "a", "turn_id": "1"}, {"speaker": "a", "turn_id": "1"}]), ("invalid_label", "turns[1].turn_id")),
    (without(type="dialogue", speaker="bob"), None),
    (without(type="document", format="docx"), ("invalid_label", "format")),
    (without(type="document", format="pdf"), ("invalid_label", "format")),
    (without(type="document", text="%PDF-1.4"), None),
    (without(text=" \n "), ("empty_input", "text")),
]


def test_label_errors(spark):
    assert errors(spark, [b for b, _ in CASES]) == [e for _, e in CASES]


def test_formats_and_shorthand(spark):
    rows = [
        {"ingest_id": "a", "type": " document ", "source": " s ", "session": "x", "text": "# T"},
        {"ingest_id": "b", "type": "log", "source": "s", "session": "x", "format": "md", "text": "x"},
        {"ingest_id": "c", "type": "dialogue", "source": "s", "session": "x", "speaker": " bob ", "text": "hi"},
    ]
    got = {r.ingest_id: r for r in validate(requests(spark, rows)).collect()}
    assert (got["a"].type, got["a"].source, got["a"].format) == ("document", "s", "txt")
    assert got["b"].format is None
    assert [(t.speaker, t.text) for t in got["c"].turns] == [("bob", "hi")] and got["c"].error is None


def test_too_large(spark):
    row = {"ingest_id": "a", **BASE, "text": "x" * 100}
    assert validate(requests(spark, [row]), EngineConfig(max_body_bytes=50)).first().error.status == 413


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,2\n")
    (tmp_path / "b.json").write_text('[{"x":1},"y"]')
    files = read_files(spark, str(tmp_path), {"type": "document", "source": "s ", "session": "x"})
    result = ingest.ingest(files)
    assert sorted((r.format, r.text) for r in result.records.collect()) == [("csv", "k: 1 | v: 2"), ("json", "y"), ("json", '{"x":1}')]
    talk = read_files(spark, str(tmp_path / "a.csv"), {"type": "dialogue", "source": "s", "session": "x"})
    assert ingest.ingest(talk).rejected.first().code == "invalid_label"


@pytest.mark.parametrize("field", ["text", "source", "session", "type"])
def test_nulls_don_t_crash(spark, field):
    assert validate(requests(spark, [{"ingest_id": "a", **without(field)}])).first().error is not None


def test_memory_ids_are_one_per_request(spark):
    rows = [{"ingest_id": k, "type": "log", "source": "s", "session": "x", "text": "a\nb"} for k in "xyz"]
    result = ingest.ingest(requests(spark, rows))
    ids = {}
    for r in result.records.collect():
        ids.setdefault(r.ingest_id, set()).add(r.memory_id)
    assert all(len(v) == 1 for v in ids.values()) and len({next(iter(v)) for v in ids.values()}) == 3
    assert next(iter(ids["x"]))[14] == "7"
