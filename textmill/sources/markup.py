"""Items of CSV, JSON, XML and PDF bodies and sections of Markdown: Python code, run inside Arrow UDFs."""

from __future__ import annotations

import json
import re
import zlib
from decimal import Decimal
from xml.parsers import expat

from .splitting import plain_text, size, strip


def text_of(data: bytes) -> str:
    return data.decode("utf-8", "replace")


# CSV -----------------------------------------------------------------------------------------------------------------


def csv_rows(text: str, comma: str) -> list[list[str]] | None:
    """Records of strict CSV with white space skipped before fields; None if a quote stands where it must not."""
    field = re.compile(rf'(?:(?!\n)\s)*(?:"((?:[^"]|"")*)"|([^"\n{comma}]*))({comma}|\n|\Z)' if comma != "\t" else r'(?:(?![\n\t])\s)*(?:"((?:[^"]|"")*)"|([^"\n\t]*))(\t|\n|\Z)')
    text, rows, row, at = text.replace("\r\n", "\n"), [], [], 0
    while at < len(text) or row:
        if not row and text[at] == "\n":  # an empty line
            at += 1
            continue
        m = field.match(text, at)
        if not m:
            return None
        row.append(m[2] if m[1] is None else m[1].replace('""', '"'))
        at = m.end()
        if m[3] != comma:
            rows.append(row)
            row = []
    return rows


def csv_items(text: str, mode: str = "auto", headers: bool = True) -> list[str]:
    if not strip(text):
        return []
    if mode == "doc":
        return [text]
    rows = csv_rows(text, "\t" if "\t" in text and "," not in text else ",")
    if rows is None:
        return plain_text(text, "line")
    if not headers or len(rows) < 2:
        return [line for r in rows if strip(line := ", ".join(r))]
    names = [strip(n) for n in rows[0]]
    name = lambda k: (names[k] if k < len(names) else "") or f"col_{k + 1}"
    items = (" | ".join(f"{name(k)}: {v}" for k, v in enumerate(map(strip, r)) if v) for r in rows[1:])
    return [i for i in items if i]


# JSON ----------------------------------------------------------------------------------------------------------------


def _no_constant(name: str):
    raise ValueError(name)


def _finite(number: str) -> float:
    x = float(number)
    if x in (float("inf"), float("-inf")):
        raise ValueError(number)
    return x


def load_json(text: str):
    """Strict JSON; numbers are doubles."""
    return json.loads(text, parse_constant=_no_constant, parse_float=_finite, parse_int=_finite)


def _number(x: float) -> str:
    if x == 0 or 1e-6 <= abs(x) < 1e21:
        out = format(Decimal(repr(x)), "f")
        return (out.rstrip("0").rstrip(".") if "." in out else out) or "0"
    return re.sub(r"e([+-])0(\d)$", r"e\1\2", repr(x))


def dump_json(v) -> str:
    """Compact, keys in order, "<>&" and the two line separators escaped."""
    if isinstance(v, dict):
        return "{" + ",".join(f"{dump_json(k)}:{dump_json(v[k])}" for k in sorted(v)) + "}"
    if isinstance(v, list):
        return "[" + ",".join(map(dump_json, v)) + "]"
    if isinstance(v, float):
        return _number(v)
    if isinstance(v, str):
        v = re.sub("[\ud800-\udfff]", "�", v)
        out = json.dumps(v, ensure_ascii=False)
        return re.sub("[<>&\u2028\u2029]", lambda m: f"\\u{ord(m[0]):04x}", out)
    return json.dumps(v)


def _elements(values: list) -> list[str]:
    return [x for v in values if (x := v if isinstance(v, str) else dump_json(v)) and (not isinstance(v, str) or strip(v))]


def json_items(text: str, mode: str = "auto") -> list[str]:
    """Elements of an array or of an object's "items"; else lines that are JSON each; else the whole text."""
    text = strip(text)
    if not text:
        return []
    if mode == "doc":
        return [text]
    try:
        v = load_json(text)
    except (ValueError, RecursionError):
        v = None
    if isinstance(v, dict):
        v = next((v[k] for k in reversed(list(v)) if k.lower() == "items"), None)
    if isinstance(v, list) and (found := _elements(v)):
        return found
    if "\n" in text:
        rows = [r for r in map(strip, text.split("\n")) if r]
        try:
            for r in rows:
                load_json(r)
            return rows
        except (ValueError, RecursionError):
            pass
    return [text]


# XML -----------------------------------------------------------------------------------------------------------------

#: The elements that hold a record each.
RECORD_TAGS = frozenset("item entry record event message row article feed_item log".split())


class _Records:
    """Leaf texts as "tag: text". A text goes by the tag that was opened last; a record ends with a record element, or
    when only one element is left open."""

    def __init__(self):
        self.items, self.fields, self.open, self.tag, self.text = [], [], [], "", []

    def start(self, name: str, _attributes) -> None:
        self.tag = name.rpartition(":")[2]
        self.open.append(self.tag)
        self.text.clear()

    def end(self, _name: str) -> None:
        if (text := strip("".join(self.text))) and self.tag:
            self.fields.append(f"{self.tag}: {text}")
        self.text.clear()
        if self.open.pop().lower() in RECORD_TAGS or len(self.open) == 1:
            self.flush()

    def flush(self) -> None:
        if self.fields:
            self.items.append(" | ".join(self.fields))
            self.fields = []


_PROLOG = re.compile(r"\s*(?:<\?xml[^>]*\?>)?\s*(?:<!--.*?-->\s*)*(?:<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>)?", re.S)


def xml_items(text: str, mode: str = "auto", limit: int = 0) -> list[str]:
    if not strip(text):
        return []
    if mode == "doc":
        return [text]
    found, parser = _Records(), expat.ParserCreate()
    depth = [0]

    def start(name, attributes):
        depth[0] += 1
        if depth[0] > 1:  # the first is ours: bodies may have several roots
            found.start(name, attributes)

    def end(name):
        depth[0] -= 1
        if depth[0]:
            found.end(name)

    parser.StartElementHandler, parser.EndElementHandler = start, end
    parser.CharacterDataHandler = found.text.append
    try:
        parser.Parse(f"<all>{text[_PROLOG.match(text).end() :]}</all>".encode("utf-8", "replace"), True)
    except expat.ExpatError:
        return plain_text(text, mode, limit)
    found.flush()
    return found.items or plain_text(text, "para")


# PDF -----------------------------------------------------------------------------------------------------------------

#: Fixed value: the item of a PDF that shows no text.
NO_PDF_TEXT = "[PDF: No extractable text stream found - document may contain scanned raster images]"
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_EDGE = rb"(?:(?<=[ \t\r\n/\[\]()])|\A)"
_TAIL = rb"(?=[ \t\r\n/\[\]()]|\Z)"
_BEGIN = re.compile(_EDGE + rb"BT" + _TAIL)
_IN_TEXT = re.compile(rb"\(|\[|<(?!<)(?=.)|" + _EDGE + rb"(?:ET|T\*|Td|TD)" + _TAIL, re.S)
_IN_ARRAY = re.compile(rb"\]|\(|<(?!<)(?=.)|[0-9+-][0-9.+-]*", re.S)
_OPERATOR = re.compile(rb"[ \t\r\n]*([^\x00-\x20(\[</]*)")
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.S)


def _literal(data: bytes, at: int) -> tuple[bytes, int]:
    """The string in parentheses that opens at this place, and where it ends."""
    depth = 0
    for m in re.compile(rb"\\.|[()]", re.S).finditer(data, at + 1):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            if not depth:
                return _unescape(data[at + 1 : m.start()]), m.end()
            depth -= 1
    return _unescape(data[at + 1 :]), len(data)


def _unescape(raw: bytes) -> bytes:
    return _ESCAPED.sub(lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPES.get(m[1], m[1]), raw)


def _hex(data: bytes, at: int) -> tuple[bytes, int]:
    end = data.find(b">", at + 1)
    if end < 0:
        return b"", at + 1
    raw = data[at + 1 : end].strip()
    return (bytes.fromhex(raw.decode()) if re.fullmatch(rb"(?:[0-9A-Fa-f]{2})*", raw) else b""), end + 1


def _array(data: bytes, at: int) -> tuple[bytes, int]:
    """Strings of an array; a shift of more than 100 to the left is a blank."""
    out, at = [], at + 1
    while m := _IN_ARRAY.search(data, at):
        at = m.end()
        if m[0] == b"]":
            return b"".join(out), at
        if m[0] in (b"(", b"<"):
            part, at = (_literal if m[0] == b"(" else _hex)(data, m.start())
            out.append(part)
        elif re.fullmatch(rb"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)", m[0]) and float(m[0]) < -100:
            out.append(b" ")
    return b"".join(out), len(data)


def pdf_text(stream: bytes) -> str:
    """What the text objects of a content stream show, line by line."""
    out, at = [], 0
    while begin := _BEGIN.search(stream, at):
        at = begin.end()
        while m := _IN_TEXT.search(stream, at):
            what, at = m[0], m.end()
            if what == b"ET":
                out.append(b"\n")
                break
            if what not in (b"(", b"[", b"<"):
                out.append(b"\n")
                continue
            text, at = {b"(": _literal, b"[": _array, b"<": _hex}[what](stream, m.start())
            shown = _OPERATOR.match(stream, at)
            if shown[1] in ((b"TJ",) if what == b"[" else (b"Tj", b"'", b'"')):
                out += [text, b"\n" if what == b"(" and shown[1] != b"Tj" else b" "]
                at = shown.end()
        else:
            break
    return "\n".join(x for x in map(strip, text_of(b"".join(out)).split("\n")) if x)


def pdf_streams(data: bytes) -> list[bytes]:
    """Bodies of the streams, inflated where their dictionaries say so; those that can't be are left out."""
    found, at = [], 0
    while m := re.compile(rb"stream\r?\n?").search(data, at):
        end = data.find(b"endstream", m.end())
        if end < 0:
            break
        raw, at = data[m.end() : end], end + len(b"endstream")
        start = data.rfind(b"<<", 0, m.start())
        if start >= 0 and b"/FlateDecode" in data[start : m.start()]:
            inflater = zlib.decompressobj()
            try:
                raw = inflater.decompress(raw)
            except zlib.error:
                continue
            if not raw or not inflater.eof:
                continue
        found.append(raw)
    return found


def pdf_items(data: bytes, mode: str = "auto", limit: int = 0) -> list[str]:
    if not data:
        return []
    if not strip(text_of(data[:1024])).startswith("%PDF-"):
        return plain_text(text_of(data), mode, limit)
    pages = [(k, t) for k, s in enumerate(pdf_streams(data), 1) if (t := pdf_text(s))]
    if not pages:
        direct = pdf_text(data)
        return plain_text(direct, mode, limit) if direct else [NO_PDF_TEXT]
    if mode == "para":
        return [p for _, t in pages for x in t.split("\n\n") if (p := strip(x))]
    items = [f"--- PDF Section {k} ---\n{t}" for k, t in pages]
    return ["\n\n".join(items)] if mode == "doc" else items


# Markdown ------------------------------------------------------------------------------------------------------------

_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+|$)")


def markdown_units(text: str) -> list[tuple[str, str]]:
    """Paragraphs, fenced blocks and headings, each with the path of the headings above it."""
    units: list[tuple[str, str]] = []
    above: list[tuple[int, str]] = []
    block: list[str] = []
    fence = None

    def emit(lines: list[str]) -> None:
        if lines:
            units.append(("\n".join(lines), " > ".join(h for _, h in above)))

    for line in (x[:-1] if x.endswith("\r") else x for x in text.split("\n")):
        bare = strip(line)
        if fence:
            block.append(line)
            fence = None if bare.startswith(fence) else fence
        elif bare.startswith(("```", "~~~")):
            fence = bare[:3]
            block.append(line)
        elif heading := bare and _HEADING.match(line):
            emit(block)
            block = []
            above = [h for h in above if h[0] < len(heading[1])]
            emit([line])
            above.append((len(heading[1]), bare))
        elif bare:
            block.append(line)
        else:
            emit(block)
            block = []
    emit(block)
    return units


def markdown_sections(text: str, mode: str = "auto") -> list[str]:
    """Sections that start at headings of up to four levels, outside fenced blocks; without headings, paragraphs."""
    if not strip(text):
        return []
    if mode == "doc":
        return [strip(text)]
    if mode in ("para", "line"):
        return plain_text(text, mode)
    sections: list[list[str]] = [[]]
    fenced = headed = False
    for line in text.replace("\r\n", "\n").split("\n"):
        bare = strip(line)
        fenced ^= bare.startswith("```")
        if not fenced and bare.startswith(("# ", "## ", "### ", "#### ")):
            headed = True
            sections.append([])
        sections[-1].append(line)
    found = [s for s in (strip("\n".join(x)) for x in sections) if s]
    return found if headed or len(found) > 1 else plain_text(text, "para")


def parse(fmt: str, data: bytes, mode: str = "auto", limit: int = 0, headers: bool = True) -> list[str]:
    """Items of a body; those over the limit (if there is one) are split as plain text."""
    if fmt == "pdf":
        items = pdf_items(data, mode, limit)
    else:
        text = text_of(data)
        if fmt == "csv":
            items = csv_items(text, mode, headers)
        elif fmt == "json":
            items = json_items(text, mode)
        elif fmt == "xml":
            items = xml_items(text, mode, limit)
        elif fmt == "md":
            items = markdown_sections(text, mode)
        else:
            return plain_text(text, mode, limit)
    if limit <= 0:
        return items
    return [p for i in items for p in ([i] if size(i) <= limit else plain_text(i, "auto", limit) or [i])]
