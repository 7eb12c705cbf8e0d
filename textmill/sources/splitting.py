"""Byte-bounded splitting and line or paragraph streams of plain text: Python code, run inside Arrow UDFs."""

from __future__ import annotations

import re

from ..functions.text import SPACE_CHARS

BLANK_LINES = re.compile(r"\r?\n[ \t]*\r?\n")
LOOSE_BLANK_LINES = re.compile(r"\r?\n[\t\n\f\r ]*\r?\n")

SENTENCE_ENDS = (b". ", b"! ", b"? ", b"; ")
#: What marks a log (RE2 syntax that Python reads alike, with ASCII classes).
LOG_TIME = re.compile(r"(?m)^([0-9]{4}-[0-9]{2}-[0-9]{2}|\[[0-9]{4}-[0-9]{2}-[0-9]{2}|\[[\t\n\f\r ]*[0-9]+\.[0-9]+\]|[A-Za-z]{3}[\t\n\f\r ]+[0-9]{1,2}[\t\n\f\r ]+[0-9]{2}:[0-9]{2}:[0-9]{2})")
LOG_MARK = re.compile(r"(?mi)^(\[(DEBUG|INFO|WARN|WARNING|ERROR|FATAL|ALERT|CRITICAL|TRACE)\]|DEBUG:|INFO:|WARN:|ERROR:|CRITICAL:|ALERT:|kernel:|ping |GET |POST )")


def strip(text: str) -> str:
    return text.strip(SPACE_CHARS)


def size(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def _last(data: bytes, chars: bytes, start: int, end: int) -> int:
    return max(data.rfind(bytes([c]), start, end) for c in chars)


def _cut(data: bytes, start: int, limit: int) -> int:
    """Where the piece that begins at start ends: the first of these that lies behind start. The last line break within
    the limit; behind the last end of a sentence; the last blank; the last of ",:-|"; the first white space up to a
    fifth beyond the limit; the limit, moved back to the start of a character."""
    end = start + limit
    sentence = max(data.rfind(s, start, end) for s in SENTENCE_ENDS)
    ahead = re.compile(rb"[ \t\r\n]").search(data, end, min(len(data), end + limit // 5))
    for at in (
        _last(data, b"\r\n", start, end),
        sentence + 1 if sentence >= 0 else -1,
        _last(data, b" \t", start, end),
        _last(data, b",:-|", start, end),
        ahead.start() if ahead else -1,
    ):
        if at > start:
            return at
    at = end
    while at > start and data[at] & 0xC0 == 0x80:
        at -= 1
    return at if at > start else end


def split_bytes(text: str, limit: int) -> list[str]:
    """Pieces of at most limit bytes (a fifth more where a word would be cut), without white space at their ends."""
    if limit <= 0 or size(text) <= limit:
        return [text]
    data, pieces, start = text.encode("utf-8", "surrogatepass"), [], 0
    stop = len(text.rstrip(SPACE_CHARS).encode("utf-8", "surrogatepass"))  # from the first cut on, the end is trimmed
    while len(data) - start > limit:
        end = _cut(data, start, limit)
        if piece := strip(data[start:end].decode("utf-8", "replace")):
            pieces.append(piece)
        data = data[:stop] if end < stop else data[:end]
        start = _skip_space(data, end)
    if start < len(data):
        pieces.append(data[start:].decode("utf-8", "replace"))
    return pieces


def _skip_space(data: bytes, at: int) -> int:
    """Behind the white space at this place, looking at a growing part of what follows."""
    reach = 64
    while True:
        part = data[at : at + reach].decode("utf-8", "ignore")
        rest = part.lstrip(SPACE_CHARS)
        if rest or at + reach >= len(data):
            return at + size(part) - size(rest)
        reach *= 8


def bound(text: str, limit: int) -> list[str]:
    """A unit of more than limit bytes as paragraphs, and those as pieces."""
    return [piece for p in map(strip, BLANK_LINES.split(text)) if p for piece in split_bytes(p, limit)]


def line_stream(text: str, limit: int) -> list[str]:
    """Entries of a stream of lines: blank lines are passed over, an indented line belongs to the entry before it."""
    entries: list[list[str]] = []
    for line in text.split("\n"):
        if strip(line):
            if entries and line[0] in " \t":
                entries[-1].append(line.rstrip("\r"))
            else:
                entries.append([line.rstrip("\r")])
    return [piece for e in entries for piece in split_bytes(strip("\n".join(e)), limit)]


def paragraph_stream(text: str, limit: int) -> list[str]:
    return [piece for p in map(strip, LOOSE_BLANK_LINES.split(text)) if p for piece in split_bytes(p, limit)]


def is_log(text: str) -> bool:
    return bool(LOG_TIME.search(text) or LOG_MARK.search(text))


def plain_text(text: str, mode: str = "auto", limit: int = 0) -> list[str]:
    """Plain text by mode: doc, para, auto; any other is line. Without a limit, 4096 bytes."""
    text, limit = strip(text), limit if limit > 0 else 4096
    if not text:
        return []
    mode = mode or "auto"
    if mode == "auto":
        paragraphs = LOOSE_BLANK_LINES.search(text)
        if paragraphs:
            mode = "line" if is_log(text) else "para"
        else:
            mode = "line" if "\n" in text else "doc"
    if mode == "doc":
        return split_bytes(text, limit)
    return paragraph_stream(text, limit) if mode == "para" else line_stream(text, limit)
