import pytest
from pyspark.sql import functions as F

from textmill.config import EngineConfig
from textmill.functions.text import cosine
from textmill.operators import scoring
from textmill.operators.scoring import EmbedError, FunctionEmbedder, HttpEmbedder, embed_each
from textmill.plans import ingest

from .test_chunking import requests


def topic(text):
    t = text.lower()
    return [1.0, 0.0] if "retention" in t else [0.2, 1.0] if "benchmark answer" in t else [0.0, 1.0]


@pytest.mark.parametrize(("a", "b", "want"), [([1, 1], [2, 2], 1.0), ([0, 0], [1, 0], 0.0), ([1, 0], [0, 1], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([([float(x) for x in a], [float(x) for x in b])], "a array<float>, b array<float>")
    assert df.select(cosine(F.col("a"), F.col("b"))).first()[0] == pytest.approx(want)


def run(spark, rows, embedder, **config):
    c = EngineConfig(**config)
    result = ingest.ingest(requests(spark, rows), c, embedder)
    return result, c


MD = "# Policy\n\n## Logs\n\nThe retention period is 90 days.\n\nThe office has plants."


def test_routing_with_headings(spark):
    rows = [{"ingest_id": "a", "type": "document", "source": "s", "session": "x", "format": "md", "text": MD, "task": "retention rules"}]
    result, _ = run(spark, rows, FunctionEmbedder(topic))
    got = {r.text: r for r in result.records.collect()}
    strong = got["The retention period is 90 days."]
    assert strong.strong and strong.heading == "# Policy > ## Logs" and strong.task_score == 1.0
    assert not got["The office has plants."].strong and got["The office has plants."].score_status == "scored"


def test_heading_is_embedded_with_the_text(spark):
    rows = [{"ingest_id": "a", "type": "document", "source": "s", "session": "x", "format": "md", "text": "# retention\n\nplants", "task": "retention"}]
    result, _ = run(spark, rows, FunctionEmbedder(topic))
    assert {r.text: r.strong for r in result.records.collect()} == {"# retention": True, "plants": True}


def test_weak_chunks_are_stored(spark):
    rows = [{"ingest_id": "a", "type": "log", "source": "s", "session": "x", "text": "benchmark answer\nother", "task": "retention"}]
    result, c = run(spark, rows, FunctionEmbedder(topic))
    answer = ingest.responses(result, c, True).first()
    assert (answer.accepted, answer.strong, answer.weak, answer.score_status) == (2, 0, 2, "scored")
    scores = {r.text: r.task_score for r in result.records.collect()}
    assert 0 < scores["benchmark answer"] < 0.3 and scores["other"] == 0.0


class Down:
    def embed(self, texts):
        raise EmbedError("down")


class Picky:
    def embed(self, texts):
        if any("too long" in t for t in texts):
            raise EmbedError("413", rejected=True)
        return [topic(t) for t in texts]


@pytest.mark.parametrize(
    ("task", "embedder", "status", "chunk"),
    [
        ("", FunctionEmbedder(topic), "no_task", "no_task"),
        ("", None, "no_task", "no_task"),
        ("retention", None, "disabled", "disabled"),
        ("retention", Down(), "embedder_unavailable", "embedder_unavailable"),
    ],
)
def test_statuses(spark, task, embedder, status, chunk):
    rows = [{"ingest_id": "a", "type": "log", "source": "s", "session": "x", "text": "one\ntwo", "task": task}]
    result, c = run(spark, rows, embedder)
    got = result.records.collect()
    assert len(got) == 2 and {r.score_status for r in got} == {chunk} and not any(r.strong or r.task_score is not None for r in got)
    assert ingest.responses(result, c, embedder is not None).first().score_status == status


def test_one_bad_input_is_partial(spark):
    rows = [{"ingest_id": "a", "type": "log", "source": "s", "session": "x", "text": "retention\nthis is too long\nb", "task": "retention"}]
    result, c = run(spark, rows, Picky())
    assert {r.text: r.task_score for r in result.records.collect()} == {"retention": 1.0, "this is too long": None, "b": 0.0}
    assert ingest.responses(result, c, True).first().score_status == "partial"


def test_no_chunks_with_a_task_count_as_scored(spark):
    rows = [{"ingest_id": "a", "type": "log", "source": "s", "session": "x", "text": "-----", "task": "t"}]
    result, c = run(spark, rows, FunctionEmbedder(topic))
    answer = ingest.responses(result, c, True).first()
    assert (answer.accepted, answer.score_status, answer.discarded.separator) == (0, "scored", 1)


def test_unreachable_service_is_asked_once():
    calls = []

    class Timeout:
        def embed(self, texts):
            calls.append(len(texts))
            raise EmbedError("timeout")

    assert embed_each(Timeout(), ["a", "b", "c"]) == [None] * 3 and calls == [3]


def test_http_embedder(tmp_path):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    seen = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.append((len(body["input"]), self.headers["Authorization"]))
            status = 500 if "bad" in body["input"] else 200
            rows = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(body["input"])][::-1]
            self.send_response(status)
            self.end_headers()
            self.wfile.write(json.dumps({"data": rows}).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = HttpEmbedder(f"http://127.0.0.1:{server.server_port}/v1", "m", 2, "key", 2000, 2)
    assert e.embed(["a", "bb", "ccc"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0]]
    assert seen == [(2, "Bearer key"), (1, "Bearer key")]
    assert embed_each(e, ["x", "bad"]) == [[1.0, 1.0], None]
    with pytest.raises(EmbedError):
        HttpEmbedder(e.url, "m", 3).embed(["a"])
    server.shutdown()
    assert embed_each(HttpEmbedder("http://127.0.0.1:1/x", "m", 2, timeout_ms=200), ["a", "b"]) == [None, None]


def test_threshold_compares_the_rounded_score(spark):
    df = spark.createDataFrame([("a", "t", [0.29996, (1 - 0.29996**2) ** 0.5], [1.0, 0.0])], "ingest_id string, task string, vector array<double>, task_vector array<double>")
    assert scoring.routed(df, 0.30).first().strong
