"""Text expressions: byte sizes, Unicode white space, RE2 patterns, content ids."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The characters of Unicode white space, as the body of a character class that Java and RE2 read alike.
SPACE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: The same for Python's str.strip.
SPACE_CHARS = "\t\n\x0b\x0c\r \x85\xa0                　"

_ASCII_WORD = "0-9A-Za-z_"
_EDGE = f"(?:(?<=[{_ASCII_WORD}])(?![{_ASCII_WORD}])|(?<![{_ASCII_WORD}])(?=[{_ASCII_WORD}]))"
_OUTSIDE = {"s": r"[\t\n\f\r ]", "S": r"[^\t\n\f\r ]", "d": "[0-9]", "D": "[^0-9]", "w": f"[{_ASCII_WORD}]", "W": f"[^{_ASCII_WORD}]", "b": _EDGE}
_INSIDE = {"s": r"\t\n\f\r ", "d": "0-9", "w": _ASCII_WORD}


#: What certainly begins with a word character, so that a word edge before it needs one look only.
_WORD_AHEAD = re.compile(r"\\[dw]|[0-9A-Za-z_]|\[(?:[0-9A-Za-z_]-[0-9A-Za-z_]|[0-9A-Za-z_])+\](?![*?{])|\[(?:[0-9A-Za-z_]-[0-9A-Za-z_]|[0-9A-Za-z_])+\]\{[1-9]")


def java_pattern(re2: str) -> str:
    """An RE2 pattern as a Java one with the same matches: white space, digits and word edges are ASCII, the end is the
    very end unless (?m) is set, and only a line feed ends a line."""
    multiline = "m" in re2[2 : re2.index(")")] if re2.startswith("(?") and re2[2:3].isalpha() else False
    out, at, inside = [], 0, False
    while at < len(re2):
        c = re2[at]
        if c == "\\" and at + 1 < len(re2):
            if re2[at + 1] == "b" and not inside and (m := _WORD_AHEAD.match(re2, at + 2)) and not re2.startswith(("*", "?", "{0"), m.end()):
                out.append(f"(?<![{_ASCII_WORD}])")
            else:
                out.append((_INSIDE if inside else _OUTSIDE).get(re2[at + 1], re2[at : at + 2]))
            at += 2
            continue
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        out.append(r"\z" if c == "$" and not inside and not multiline else c)
        at += 1
    return "(?d)" + "".join(out)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once: what a lambda captures is otherwise evaluated again for every element."""
    return F.get(F.transform(F.array(value), body), 0)


def trim(text: Column) -> Column:
    """Without Unicode white space at either end."""
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))  # most texts need no look inside
    return F.when(ends.rlike(f"[{SPACE}]"), F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")).otherwise(text)


def is_blank(text: Column) -> Column:
    return ~F.coalesce(text, F.lit("")).rlike(rf"[^{SPACE}]")


def byte_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0))


def content_id(text: Column) -> Column:
    """The first 128 bits of SHA-256, in hex."""
    return F.substring(F.sha2(text.cast("binary"), 256), 1, 32)


def nonempty(text: Column) -> Column:
    """null for an empty string."""
    return F.when(text != "", text)


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; 0 if either vector is zero."""
    return let(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), lambda size: F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size))
