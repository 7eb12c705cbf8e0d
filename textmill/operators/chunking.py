"""Requests to candidates: turns, log entries, paragraphs, headed sections and parsed items, bounded in bytes.

Every step works inside a request's own row, so nothing is shuffled. Python sees only what needs it: bodies of csv, json,
xml, pdf and md documents, and units over the limit.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, content_id, is_blank, let, lines, nonempty
from ..sources import markup, splitting

_UNIT = "struct<text:string,speaker:string,turn_id:string,heading:string,ts:timestamp>"


def _unit(text: Column, speaker=None, turn_id=None, heading=None, ts=None) -> Column:
    null = lambda c, kind: (F.lit(None) if c is None else c).cast(kind)
    return F.struct(text.alias("text"), null(speaker, "string").alias("speaker"), null(turn_id, "string").alias("turn_id"), null(heading, "string").alias("heading"), null(ts, "timestamp").alias("ts"))


def dialogue_units(turns: Column) -> Column:
    """One unit per turn; turns without an id are t1, t2, ... by their place."""
    return F.transform(turns, lambda t, i: _unit(t["text"], t["speaker"], F.coalesce(nonempty(t["turn_id"]), F.concat(F.lit("t"), (i + 1).cast("string"))), None, t["ts"]))


def log_entries(text: Column) -> Column:
    """Lines, blank ones too; an indented line belongs to the entry above it unless a blank line parts them."""
    rows = F.transform(lines(F.regexp_replace(text, r"\n\z", "")), lambda x: F.regexp_replace(x, r"\r\z", ""))

    def begins(blank: Column, rows: Column) -> Column:
        """Where entries begin, from 0."""
        at = F.transform(rows, lambda x, i: F.when((i == 0) | F.get(blank, i) | ~x.rlike(r"^[ \t]") | F.get(blank, i - 1), i))
        return F.filter(at, lambda i: i.isNotNull())

    def entries(starts: Column, rows: Column) -> Column:
        return F.transform(starts, lambda s, k: F.array_join(F.slice(rows, s + 1, F.coalesce(F.get(starts, k + 1), F.size(rows)) - s), "\n"))

    return let(rows, lambda r: let(let(F.transform(r, is_blank), lambda b: begins(b, r)), lambda s: entries(s, r)))


def paragraphs(text: Column) -> Column:
    """Parts between blank lines, without line breaks at their ends; blank ones are not units."""
    parts = F.transform(F.split(text, r"\r?\n[ \t]*\r?\n", -1), lambda p: F.regexp_replace(p, r"^[\r\n]+|[\r\n]+\z", ""))
    return F.filter(parts, lambda p: p.rlike(f"[^{SPACE}]"))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("heading", T.StringType())])))
def _document_units(formats: pd.Series, bodies: pd.Series) -> pd.Series:
    def units(fmt: str | None, body: bytes | None):
        if fmt is None or body is None:
            return None
        if fmt == "md":
            found = markup.markdown_units(markup.text_of(body))
        else:
            found = [(x, "") for x in markup.parse(fmt, body)]
        return [{"text": t, "heading": h or None} for t, h in found]

    return pd.Series([units(f, b) for f, b in zip(formats, bodies, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _items(formats: pd.Series, bodies: pd.Series, modes: pd.Series, limits: pd.Series, headers: pd.Series) -> pd.Series:
    rows = zip(formats, bodies, modes, limits, headers, strict=True)
    return pd.Series([None if b is None else markup.parse(f, b, m, int(n), bool(h)) for f, b, m, n, h in rows], dtype=object)


# what a generator explodes would else be computed once more, for a filter on its size
_document_units, _items = _document_units.asNondeterministic(), _items.asNondeterministic()


def parsed_items(fmt: Column, body: Column, mode: str = "auto", limit: int = 0, headers: bool = True) -> Column:
    """Items of a body in the given format, for filtering and tests."""
    return _items(fmt, body.cast("binary"), F.lit(mode), F.lit(limit), F.lit(headers))


@F.pandas_udf(T.ArrayType(T.StringType()))
def _bound(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else splitting.bound(t, int(n)) for t, n in zip(texts, limits, strict=True)], dtype=object)


@F.pandas_udf(T.ArrayType(T.StringType()))
def _split(texts: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else splitting.split_bytes(t, int(n)) for t, n in zip(texts, limits, strict=True)], dtype=object)


_bound, _split = _bound.asNondeterministic(), _split.asNondeterministic()


def split_at_boundaries(text: Column, limit: int) -> Column:
    return _split(text, F.lit(limit))


def units(requests: DataFrame) -> DataFrame:
    """Valid requests to units: the request's columns but its content, pos, text, speaker, turn_id, heading, ts."""
    kind, fmt = F.col("type"), F.coalesce("format", F.lit("txt"))
    content = F.coalesce(F.col("body"), F.col("text").cast("binary"))
    text = F.coalesce(F.col("body").cast("string"), F.col("text"))
    as_units = lambda texts: F.transform(texts, lambda t: _unit(t)).cast(f"array<{_UNIT}>")
    parsed = (kind == "document") & ~fmt.isin("txt", "raw", "")
    r = requests.withColumn("__parsed", _document_units(F.when(parsed, fmt), F.when(parsed, content)))
    found = (
        F.when(kind == "dialogue", dialogue_units(F.col("turns")).cast(f"array<{_UNIT}>"))
        .when(kind == "log", as_units(log_entries(text)))
        .when(~parsed, as_units(paragraphs(text)))
        .otherwise(F.transform("__parsed", lambda u: _unit(u["text"], None, None, u["heading"])).cast(f"array<{_UNIT}>"))
    )
    kept = [c for c in requests.columns if c not in ("text", "body", "turns", "speaker", "filename", "content_type", "error")]
    return r.select(*kept, F.posexplode(found).alias("pos", "unit")).select(*kept, "pos", "unit.*")


def bound(units: DataFrame, max_bytes: int) -> DataFrame:
    """Units of more than max_bytes as parts with lineage: parent_id, part (from 1), parts. White space alone leaves none."""
    over = F.octet_length("text") > max_bytes
    pieces = F.when(over, _bound(F.when(over, F.col("text")), F.lit(max_bytes))).otherwise(F.array("text"))
    split = units.withColumn("__over", over).withColumn("__unit", F.col("text")).withColumn("__pieces", pieces)
    rows = split.select("*", F.posexplode("__pieces").alias("__part", "__text"))
    out = (
        rows.withColumn("text", F.col("__text"))
        .withColumn("parent_id", F.when(F.col("__over"), content_id(F.col("__unit"))))
        .withColumn("part", F.when(F.col("__over"), F.col("__part") + 1))
        .withColumn("parts", F.when(F.col("__over"), F.size("__pieces")))
    )
    return out.drop(*[c for c in out.columns if c.startswith("__")])


def candidates(requests: DataFrame, max_bytes: int = 1024) -> DataFrame:
    return bound(units(requests), max_bytes)
