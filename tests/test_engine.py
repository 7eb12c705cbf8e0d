import json

import pytest
from textmill.config import EngineConfig
from textmill.engine import Conflict, Engine
from textmill.operators.scoring import FunctionEmbedder
from textmill.streaming.ingest import drain_all, ingest_stream, json_stream, push_stream

from .test_chunking import requests


def log_request(k, text):
    return {"ingest_id": k, "type": "log", "source": "s", "session": "x", "text": text}


def engine(spark, tmp_path, **config):
    return Engine(spark, f"file://{tmp_path}", EngineConfig(embed_provider="none", **config))


def test_ingest_drain_ack(spark, tmp_path):
    e = engine(spark, tmp_path)
    answers, errors = e.ingest(requests(spark, [log_request("a", "one\n\ntwo"), log_request("b", "three"), log_request("c", " ")]))
    got = {r.ingest_id: r for r in answers.collect()}
    assert (got["a"].first_seq, got["a"].last_seq, got["a"].discarded.blank, got["b"].first_seq) == (1, 2, 1, 3)
    assert [c.text for c in got["a"].chunks] == ["one", "two"]
    assert [(r.ingest_id, r.code) for r in errors.collect()] == [("c", "empty_input")]
    e.ingest(requests(spark, [log_request("d", "four")]))
    page = e.drain(0, 3)
    assert [c["text"] for c in page.chunks] == ["one", "two", "three"] and page.more and page.pending == 4
    assert e.ack(page.epoch, 3) == 3 and e.ack(page.epoch, 2) == 0
    assert [c["seq"] for c in e.drain().chunks] == [4]
    assert [r.data for r in e.query(2).collect()] == ["three", "four"]
    s = e.stats()
    assert (s["chunks"], s["pending_chunks"], s["requests"], s["chunks_accepted"], s["discarded_blank"]) == (4, 1, 3, 4, 1)
    with pytest.raises(ValueError):
        e.drain(0, 0)


def test_back_pressure(spark, tmp_path):
    e = engine(spark, tmp_path, capacity_mb=1)
    big = "\n".join(f"{k} " + "x" * 1000 for k in range(700))
    assert e.ingest(requests(spark, [log_request("a", big)]), summary=True)[0].first().accepted == 700
    answers, errors = e.ingest(requests(spark, [log_request("b", big)]), summary=True)
    assert answers.count() == 0 and errors.first().code == "buffer_full" and errors.first().status == 503 and errors.first().retry_after_s == 5
    assert e.ingest(requests(spark, [log_request("c", big + "\n" + big.replace("x", "y"))]))[1].first().code == "exceeds_buffer_capacity"
    e.ack(e.cursor.epoch, 700)
    assert e.ingest(requests(spark, [log_request("d", big)]), summary=True)[0].first().first_seq == 701
    assert e.stats()["used_bytes"] <= 1 << 20 and e.stats()["backpressure_hits"] == 2
    assert (e.stats()["backpressure_buffer_full"], e.stats()["backpressure_exceeds_buffer_capacity"]) == (1, 1)
    assert e.drain(0, 1).chunks[0]["seq"] == 701


def test_push_owns_the_cursor(spark, tmp_path):
    e = engine(spark, tmp_path, push_url="http://h/x", push_batch=2)
    e.ingest(requests(spark, [log_request("a", "1\n2\n3")]))
    with pytest.raises(Conflict):
        e.drain()
    pages = []

    def send(body):
        page = json.loads(body)
        pages.append([c["text"] for c in page["chunks"]])
        return 200, "", json.dumps({"epoch": page["epoch"], "accepted_up_to_seq": page["last_seq"]}).encode()

    p = e.pusher(send)
    assert [p.step(), p.step(), p.step() > 0] == [0, 0, True]
    assert pages == [["1", "2"], ["3"]] and e.records.count() == 0


def test_filter(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.ingest(requests(spark, [log_request("a", "GET /healthz 200 OK\nCRITICAL: disk on node7 is 97% full, writes will fail in 10 minutes")]))
    kept, total = e.filter(None, {"from_buffer": "true", "threshold": "0.45"})
    assert [r.data[:8] for r in kept.collect()] == ["CRITICAL"] and total.first().discarded_count == 1
    assert e.stats()["filter_noise_reduction_ratio"] == 0.5
    assert e.health()["status"] == "ok"
    kept, total = e.filter(None, {}, '{"text":"ok ok ok ok ok ok ok\\nERROR: node7 lost its disk at 10:05, 3 jobs failed","threshold":0.45,"chunk_by":"line"}')
    assert [r.data[:5] for r in kept.collect()] == ["ERROR"] and total.first().total_evaluated == 2


def test_needle_is_always_delivered(spark, tmp_path):
    vectors = {"probe": [1.0, 0.0, 0.0], "generic": [0.0, 0.0, 1.0], "needle": [0.82, 0.57, 0.026]}
    embed = FunctionEmbedder(lambda t: next((v for k, v in vectors.items() if k in t), [0.14, 0.985, 0.05]))
    for task, strong in (("probe", True), ("generic", False)):
        e = Engine(spark, f"file://{tmp_path}/{task}", EngineConfig(), embed)
        turns = [("u", "needle", None, None), ("a", "filler one", None, None), ("u", "filler two", None, None)]
        e.ingest(requests(spark, [{"ingest_id": "a", "type": "dialogue", "source": "s", "session": "x", "task": task, "turns": turns}]))
        got = {c["text"]: c for c in e.drain().chunks}
        assert got["needle"]["strong"] is strong and len(got) == 3


def test_stream_is_ordered_and_complete(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(4):
        body = [json.dumps({"type": "log", "source": "s", "session": str(k), "text": f"{k}-{j} a\n{k}-{j} b"}) for j in range(5)]
        (src / f"{k}.json").write_text("\n".join(body))
    e = engine(spark, tmp_path / "log")
    ingest_stream(json_stream(spark, str(src), 1), e, str(tmp_path / "cp")).awaitTermination()
    assert e.last_batch == 3
    ingest_stream(json_stream(spark, str(src), 1), e, str(tmp_path / "cp2")).awaitTermination()  # as if no commit had been kept
    assert e.cursor.next_seq == 41
    seen = []
    assert drain_all(e, 7, lambda p: seen.extend(p.chunks)) == 40
    assert [c["seq"] for c in seen] == list(range(1, 41)) and len({c["text"] for c in seen}) == 40
    by_request = {}
    for c in seen:
        by_request.setdefault(c["ingest_id"], []).append(c["text"][-1])
    assert all(v == ["a", "b"] for v in by_request.values())


def test_resume_goes_on_where_it_stopped(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.ingest(requests(spark, [log_request("a", "1\n2\n3")]), batch_id=0)
    e.ack(e.cursor.epoch, 1)
    # a batch that was cut off: its files are there, the cursor doesn't know them
    lost = engine(spark, tmp_path)
    lost.cursor, lost._save = e.cursor, lambda: None
    lost.ingest(requests(spark, [log_request("b", "lost")]), batch_id=1)
    again = Engine.resume(spark, f"file://{tmp_path}", e.cursor.epoch, e.config)
    assert (again.cursor, again.last_batch) == (e.cursor, 0)
    assert [c["text"] for c in again.drain().chunks] == ["2", "3"]
    again.ingest(requests(spark, [log_request("b", "4")]), batch_id=1)
    assert [(c["seq"], c["text"]) for c in again.drain().chunks] == [(2, "2"), (3, "3"), (4, "4")]
    assert again.ingest(requests(spark, []), batch_id=2)[0].count() == 0


def test_equal_lines_are_requests_of_their_own_in_line_order(spark, tmp_path):
    for folder in ("in/a", "in/b"):
        (tmp_path / folder).mkdir(parents=True)
        lines = [json.dumps({"type": "log", "source": "s", "session": "x", "text": t}) for t in ("z", "same", "a", "same", "", "m")]
        (tmp_path / folder / "same.json").write_text("\n\n".join(lines))
    e = engine(spark, tmp_path / "log")
    ingest_stream(json_stream(spark, str(tmp_path / "in/*")), e, str(tmp_path / "cp")).awaitTermination()
    assert [c["text"] for c in e.drain().chunks] == ["z", "same", "a", "same", "m"] * 2


def test_push_stream_delivers_every_batch(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for k in range(2):
        (src / f"{k}.json").write_text(json.dumps({"type": "log", "source": "s", "session": "x", "text": f"{k}a\n{k}b"}))
    e, got, fails = engine(spark, tmp_path / "log", push_url="http://h/x", push_batch=3), [], [503]

    def send(body):
        if fails:
            return fails.pop(), "1", b""
        page = json.loads(body)
        got.extend(c["text"] for c in page["chunks"])
        return 200, "", json.dumps({"epoch": page["epoch"], "accepted_up_to_seq": page["last_seq"]}).encode()

    waits = []
    push_stream(json_stream(spark, str(src), 1), e, str(tmp_path / "cp"), send, waits.append).awaitTermination()
    assert sorted(got) == ["0a", "0b", "1a", "1b"] and waits == [1.0] and e.records.count() == 0
    s = e.stats()
    assert (s["total_ingested_count"], s["evicted_acked_count"], s["dropped_packets"], s["last_seq"]) == (4, 4, 0, 4) and s["uptime_seconds"] > 0
