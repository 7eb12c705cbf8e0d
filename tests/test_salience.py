import pytest

from textmill.operators import filtering
from textmill.operators.filtering import FilterOptions
from textmill.plans.samples import SALIENCE_LINES

NOISE = [t for t, n in SALIENCE_LINES if n and t.strip()]
SIGNAL = [t for t, n in SALIENCE_LINES if not n]


def scored(spark, texts, **options):
    df = spark.createDataFrame([(i + 1, t) for i, t in enumerate(texts)], "seq long, data string")
    o = FilterOptions(**{"threshold": 0.45, "include_discarded": True} | options)
    return filtering.filter_chunks(df, o)


def metrics(spark, text, **options):
    return scored(spark, [text], **options).first().metrics


def test_noise_goes_and_signal_stays(spark):
    got = {r.data: r.metrics.is_salient for r in scored(spark, NOISE + SIGNAL).collect()}
    assert not any(got[t] for t in NOISE) and all(got[t] for t in SIGNAL)


@pytest.mark.parametrize(
    ("text", "reason"),
    [
        ("", "empty_text"),
        (" \t ", "empty_text"),
        ("!!! ???", "no_alphanumeric_tokens"),
        ("GET /healthz 200 OK", "boilerplate_system_log"),
        ("aaaaaaa b", "high_repetition_low_entropy"),
        ("ab", "low_shannon_entropy"),
    ],
)
def test_reasons(spark, text, reason):
    assert metrics(spark, text, threshold=0.9).discard_reason == reason


def test_entropy(spark):
    assert metrics(spark, "-" * 50).entropy_norm == 0.0
    assert metrics(spark, "abcd").entropy == pytest.approx(2.0)
    assert metrics(spark, "é😀é😀").entropy == pytest.approx(1.0)
    assert metrics(spark, "The quick brown fox jumps over the lazy dog near 42 rivers").entropy_norm >= 0.70


def test_actionable_text_has_no_repetition_penalty(spark):
    m = metrics(spark, "ERROR ------- failed")
    assert m.repetition_penalty == 0.0 and m.is_salient


def test_task_relevance(spark):
    task = "memory leaks and thermal alerts"
    assert metrics(spark, "thermal memory", task=task).task_relevance == 1.0
    assert metrics(spark, "thermal", task=task).task_relevance == 0.5
    assert metrics(spark, "nothing", task=task).task_relevance == 0.0
    assert metrics(spark, "nothing", task="of it").task_relevance == 0.5
    assert metrics(spark, "nothing").task_relevance == 0.5


def test_summary_ids_and_sources(spark):
    df = spark.createDataFrame([(7, "ERROR: disk x failed", ""), (8, "", "o")], "seq long, data string, origin string")
    rows = filtering.filter_chunks(df, FilterOptions(threshold=0.45, include_discarded=True)).orderBy("seq")
    assert [(r.chunk_id, r.source) for r in rows.collect()] == [("chnk-007", "filter_stream"), ("chnk-008", "o")]
    assert filtering.summary(rows).first().asDict() == {"total_evaluated": 2, "salient_count": 1, "discarded_count": 1, "noise_reduction_ratio": 0.5}
    assert filtering.filter_chunks(df, FilterOptions(threshold=0.45)).count() == 1


def test_large_log_is_reduced(spark):
    lines = [NOISE[k % len(NOISE)] for k in range(1500)]
    for k, at in enumerate((3, 400, 800, 1100, 1499)):
        lines[at] = f"CRITICAL ALERT {k}: node{k} memory use is at 9{k}% (limit 80%), requests fail since 10:0{k}"
    items = filtering.split_text(spark.createDataFrame([("\n".join(lines),)], "body string"), "body", FilterOptions(chunk_by="line"))
    out = filtering.filter_chunks(items, FilterOptions(threshold=0.75, include_discarded=True))
    s = filtering.summary(out).first()
    assert s.noise_reduction_ratio >= 0.9 and out.filter("metrics.is_salient AND data LIKE 'CRITICAL%'").count() == 5


def test_partition_oversized(spark):
    df = spark.createDataFrame([(4, "x " * 40), (9, "short")], "seq long, data string")
    rows = filtering.partition_oversized(df, FilterOptions(max_bytes=30)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [1, 2, 3, 4] and rows[-1].data == "short" and rows[-1].size_bytes is None
    rows = filtering.partition_oversized(df, FilterOptions(max_bytes=300)).orderBy("seq").collect()
    assert [r.seq for r in rows] == [4, 9]


@pytest.mark.parametrize(
    ("query", "body", "want"),
    [
        ({}, {}, {"threshold": 0.75, "max_bytes": 4096, "limit": 100}),
        ({"threshold": "0.5"}, {"threshold": 0.6}, {"threshold": 0.5}),
        ({"threshold": "7"}, {"threshold": 0.6}, {"threshold": 0.75}),
        ({}, {"threshold": 0.6, "max_chunk_size": 50, "max_tokens": 20}, {"threshold": 0.6, "max_bytes": 80}),
        ({"max_chunk_size": "50"}, {"max_chunk_size": 60}, {"max_bytes": 50}),
        ({"task": "a"}, {"task": "b"}, {"task": "a"}),
        ({}, {"task": "b", "task_directive": "c"}, {"task": "c"}),
        ({}, {"from_buffer": True, "limit": 3, "since_seq": 4}, {"from_buffer": True, "limit": 3, "since_seq": 4}),
    ],
)
def test_options(query, body, want):
    got = FilterOptions.resolve(query, body)
    assert {k: getattr(got, k) for k in want} == want


def test_percentiles_by_index(spark):
    df = spark.createDataFrame([(float(k),) for k in (3, 0, 2, 1)], "x double")
    got = {r.percent: r.value for r in filtering.distributed_percentiles(df, "x", (0, 50, 99)).collect()}
    assert got == {0: 0.0, 50: 2.0, 99: 3.0}
    assert df.agg(filtering.percentile_by_index(df.x, 50)).first()[0] == 2.0
    assert filtering.distributed_percentiles(df.limit(0), "x", (50,)).count() == 0


BODIES = [
    ('{"items":[{"origin":"o","data":"a"},{"payload":"b"},{"text":"c","data":""}]}', None, [("o", "a"), ("", "b"), ("", "c")]),
    ('{"text":"l1\\nl2","chunk_by":"line"}', None, [("filter_stream", "l1"), ("filter_stream", "l2")]),
    ('{"payload":"only"}', None, [("filter_stream", "only")]),
    ('[{"origin":"x","text":"t"},{"data":"d"}]', None, [("x", "t"), ("filter_stream", "d")]),
    ('["s1","s2"]', None, [("filter_stream", "s1"), ("filter_stream", "s2")]),
    ("h1,h2\n1,2", "text/csv", [("filter_stream", "h1, h2"), ("filter_stream", "1, 2")]),
    ("INFO: a\nINFO: b", None, [("filter_stream", "INFO: a"), ("filter_stream", "INFO: b")]),
    ("", None, []),
]


@pytest.mark.parametrize(("body", "media", "want"), BODIES)
def test_bodies(spark, body, media, want):
    df = spark.createDataFrame([(body, media)], "body string, m string")
    got = filtering.body_items(df, FilterOptions(), "body", "m").orderBy("seq").collect()
    assert [(r.origin, r.data) for r in got] == want and [r.seq for r in got] == list(range(1, len(want) + 1))
