import zlib

import pytest
from pyspark.sql import functions as F

from textmill.sources import markup
from textmill.sources.requests import detect_format


def test_csv_golden():
    body = "timestamp,sensor,reading\n2026-09-12T10:00:00Z,temperature,42.1\n2026-09-12T10:00:01Z,humidity,60\n"
    assert markup.csv_items(body)[0] == "timestamp: 2026-09-12T10:00:00Z | sensor: temperature | reading: 42.1"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('a,b\n"x ""q"", y",2\n', ['a: x "q", y | b: 2']),
        ("a\tb\n1\t2\n", ["a: 1 | b: 2"]),
        ("a,\n1,2,3\n,\n", ["a: 1 | col_2: 2 | col_3: 3"]),
        ("only,row\n", ["only, row"]),
        ('a,b\nbad " quote,1\n', ["a,b", 'bad " quote,1']),
        ('a,b\n"open,1\n', ["a,b", '"open,1']),
        ('a,b\n"multi\nline",1\r\n', ["a: multi\nline | b: 1"]),
        ("  \n", []),
    ],
)
def test_csv(body, want):
    assert markup.csv_items(body) == want


def test_csv_without_headers_keeps_all_rows():
    assert markup.csv_items("a, b\n1,2\n", headers=False) == ["a, b", "1, 2"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ('[{"b":1,"a":"<x>"}, "s", " ", 2.50]', ['{"a":"\\u003cx\\u003e","b":1}', "s", "2.5"]),
        ('{"items":["a","b","c"]}', ["a", "b", "c"]),
        ('{"Items":[1e21, 1e-7, 100000000000000000000]}', ["1e+21", "1e-7", "100000000000000000000"]),
        ('{"a":1}\n\n{"b":2}\n"c"', ['{"a":1}', '{"b":2}', '"c"']),
        ('{"a": 1}', ['{"a": 1}']),
        ("[]", ["[]"]),
        ('[" "]', ['[" "]']),
        ("[NaN]", ["[NaN]"]),
        ("not json", ["not json"]),
        ("", []),
    ],
)
def test_json(body, want):
    assert markup.json_items(body) == want


def test_xml_golden():
    body = "<events><event><type>thermal_alert</type><value>55C</value></event><event><type>a</type><value>b</value></event></events>"
    assert markup.xml_items(body) == ["type: thermal_alert | value: 55C", "type: a | value: b"]


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("<a><b>1</b><c>2</c></a>", ["b: 1", "c: 2"]),
        ("<a><x><b>1</b>tail</x></a>", ["b: 1 | b: tail"]),
        ("<?xml version='1.0'?><n:r><n:item><k>v &amp; w</k></n:item></n:r>", ["k: v & w"]),
        ("<a><b>1</a>", ["<a><b>1</a>"]),
        ("<a x='1'/>", ["<a x='1'/>"]),
    ],
)
def test_xml(body, want):
    assert markup.xml_items(body) == want


def pdf(stream, compress=False):
    head = b"/FlateDecode" if compress else b""
    return b"%PDF-1.4\n1 0 obj\n<< " + head + b" >>\nstream\n" + (zlib.compress(stream) if compress else stream) + b"\nendstream\nendobj"


def test_pdf_golden():
    assert "Hello World" in markup.pdf_items(pdf(b"BT\n/F1 12 Tf\n(Hello World) Tj\nET", True))[0]


@pytest.mark.parametrize(
    ("stream", "want"),
    [
        (rb"BT (a\(b\)\101\n) Tj ET", "a(b)A"),
        (b"BT [(He) 20 (llo) -250 (you)] TJ ET", "Hello you"),
        (b"BT <48692e> Tj T* (next) ' (q) Tj ET", "Hi.\nnext\nq"),
        (b"BT (nested (x) y) Tj ET (outside) Tj", "nested (x) y"),
    ],
)
def test_pdf_text(stream, want):
    assert markup.pdf_items(pdf(stream)) == [f"--- PDF Section 1 ---\n{want}"]


def test_pdf_without_text_and_not_a_pdf():
    assert markup.pdf_items(b"%PDF-1.4 nothing") == [markup.NO_PDF_TEXT]
    assert markup.pdf_items(b"plain") == ["plain"]
    assert markup.pdf_items(pdf(b"broken", False).replace(b"<<  >>", b"<< /FlateDecode >>")) == [markup.NO_PDF_TEXT]


def test_markdown_sections():
    text = "# A\ntext\n## B\n```\n# not a heading\n```\nmore\n### C\nend"
    assert len(markup.markdown_sections(text)) == 3
    assert markup.markdown_sections("p1\n\np2") == ["p1", "p2"]


def test_bounded_section():
    items = markup.parse("md", ("# T\n" + "Some words here. " * 1200).encode(), "auto", 2048)
    assert len(items) > 1 and max(len(i.encode()) for i in items) <= 2048


def test_detect(spark):
    cases = [
        ("doc.txt", None, "", "txt"),
        ("paper.pdf", None, "", "pdf"),
        ("metrics.csv", None, "", "csv"),
        ("feed.xml", None, "", "xml"),
        ("notes.md", None, "", "md"),
        (None, "text/markdown", "", "md"),
        (None, None, "%PDF-1.7 x", "pdf"),
        ("events.JSON", None, "", "json"),
        ("a.b/noext", "application/xml; x", "", "xml"),
        (None, None, " \n{...} ", "json"),
        (None, None, "<p>x</p>", "xml"),
        (None, None, None, "txt"),
    ]
    df = spark.createDataFrame(cases, "f string, c string, s string, want string")
    for r in df.select("*", detect_format(F.col("f"), F.col("c"), F.col("s")).alias("got")).collect():
        assert r.got == r.want, r
