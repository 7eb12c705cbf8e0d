"""The salience filter: items to salient and discarded chunks with their metrics, and a summary."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.salience import with_metrics
from ..functions.text import nonempty
from ..sources import markup, splitting
from ..sources.requests import detect_format
from .chunking import parsed_items
from .log import sequenced

DEFAULT_SOURCE = "filter_stream"


@dataclass(frozen=True)
class FilterOptions:
    task: str = ""
    threshold: float = 0.75
    chunk_by: str = ""
    max_bytes: int = 4096
    include_discarded: bool = False
    from_buffer: bool = False
    limit: int = 100
    since_ms: int = 0
    since_seq: int = 0

    @classmethod
    def resolve(cls, query: Mapping[str, str], body: Mapping[str, object], threshold: float = 0.75) -> FilterOptions:
        """Query parameters before the body's fields; values that make no sense are passed over. max_tokens counts four
        bytes a token and goes before max_chunk_size."""

        def number(raw, kind=int):
            try:
                return kind(raw)
            except (TypeError, ValueError):
                return None

        def first(*values, default):
            return next((v for v in values if v), default)

        def share(raw) -> float | None:
            x = number(raw, float)
            return x if x is not None and 0 < x < 1 else None

        def positive(raw, times: int = 1) -> int | None:
            n = number(raw)
            return n * times if n is not None and n > 0 else None

        size_q = positive(query.get("max_tokens"), 4) or positive(query.get("max_chunk_size"))
        size_b = (None if query.get("max_tokens") else positive(body.get("max_tokens"), 4)) or (None if query.get("max_chunk_size") else positive(body.get("max_chunk_size")))
        asked = bool(body.get("from_buffer")) and query.get("from_buffer") != "true"
        source = body if asked else query
        limit = positive(body.get("limit")) if asked else None
        return cls(
            task=first(query.get("task"), query.get("task_directive"), body.get("task_directive"), body.get("task"), default=""),
            threshold=first(share(query.get("threshold")), None if query.get("threshold") else share(body.get("threshold")), default=threshold),
            chunk_by=first(query.get("chunk_by"), body.get("chunk_by"), default=""),
            max_bytes=first(size_b, size_q, default=4096),
            include_discarded=query.get("include_discarded") == "true" or bool(body.get("include_discarded")),
            from_buffer=query.get("from_buffer") == "true" or asked,
            limit=first(limit, positive(query.get("limit")), default=100),
            since_ms=number(source.get("since_ms")) or 0,
            since_seq=number(source.get("since_seq")) or 0,
        )

    def with_(self, **changes) -> FilterOptions:
        return replace(self, **changes)


def item_data(data: Column, payload: Column, text: Column) -> Column:
    """The first of an item's fields that is not empty."""
    return F.coalesce(nonempty(data), nonempty(payload), text, F.lit(""))


def inline_text(text: Column, data: Column, payload: Column) -> Column:
    return F.coalesce(nonempty(text), nonempty(data), payload, F.lit(""))


def _body_items(body: bytes, fmt: str, mode: str, limit: int) -> list[tuple[str, str]]:
    """(origin, data) of a filter body: an object's items, else its text as a stream; an array of items; else the body
    itself, parsed by its format. Fields of a wrong type make the body a document like any other."""
    try:
        value = markup.load_json(markup.text_of(body))
    except (ValueError, RecursionError):
        value = None

    def field(item: dict, *names: str) -> str:
        values = [item.get(n) or "" for n in names]
        if not all(isinstance(v, str) for v in values):
            raise TypeError
        return next((v for v in values if v), "")

    try:
        if isinstance(value, dict):
            items = value.get("items") or []
            if found := [(field(i, "origin"), field(i, "data", "payload", "text")) for i in items]:
                return found
            if text := field(value, "text", "data", "payload"):
                if found := [(DEFAULT_SOURCE, t) for t in splitting.plain_text(text, mode, limit)]:
                    return found
        elif isinstance(value, list) and value:
            return [(field(i, "origin") or DEFAULT_SOURCE, field(i, "data", "payload", "text")) for i in value]
    except (TypeError, AttributeError):
        pass
    return [(DEFAULT_SOURCE, t) for t in markup.parse(fmt, body, mode, limit, headers=False)]


def body_items(bodies: DataFrame, options: FilterOptions, body: str = "body", content_type: str | None = None) -> DataFrame:
    """Filter bodies to chunks: their other columns, seq (from 1 in a body), origin, data."""

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("origin", T.StringType()), T.StructField("data", T.StringType())])))
    def items(bodies: pd.Series, formats: pd.Series) -> pd.Series:
        rows = [None if b is None else [{"origin": o, "data": d} for o, d in _body_items(b, f, options.chunk_by, options.max_bytes)] for b, f in zip(bodies, formats, strict=True)]
        return pd.Series(rows, dtype=object)

    raw = F.col(body).cast("binary")
    media = F.lit(None).cast("string") if content_type is None else F.col(content_type)
    fmt = detect_format(F.lit(None).cast("string"), media, raw.cast("string"))
    others = [c for c in bodies.columns if c not in (body, content_type)]
    rows = bodies.select(*others, F.posexplode(items.asNondeterministic()(raw, fmt)).alias("pos", "item"))
    return rows.select(*others, (F.col("pos") + 1).cast("long").alias("seq"), "item.origin", "item.data")


def split_text(texts: DataFrame, column: str, options: FilterOptions, fmt: Column | None = None) -> DataFrame:
    """Documents to items of a chunk stream: adds seq (from 1 within a document) and data. CSV keeps its header row as an
    item, since headers are not asked for here."""
    items = parsed_items(F.lit("txt") if fmt is None else fmt, F.col(column), options.chunk_by, options.max_bytes, headers=False)
    rows = texts.select(*[c for c in texts.columns if c != column], F.posexplode(items).alias("seq", "data"))
    return rows.withColumn("seq", (F.col("seq") + 1).cast("long"))


def partition_oversized(chunks: DataFrame, options: FilterOptions, *by: str) -> DataFrame:
    """Chunks (seq, data) over the size as several; numbers begin anew from 1 in a stream where any was split."""
    over = F.octet_length("data") > options.max_bytes
    parts = parsed_items(F.lit("txt"), F.when(over, F.col("data")), options.chunk_by, options.max_bytes)
    c = chunks.withColumn("__over", over).withColumn("__parts", parts)
    pieces = F.when(F.col("__over") & (F.size("__parts") > 0), F.col("__parts")).otherwise(F.array("data"))
    rows = c.select("*", F.posexplode(pieces).alias("__k", "__piece"))
    if by:  # a stream is one request's, and bounded as such
        stream = Window.partitionBy(*by)
        rows = rows.withColumn("__any", F.max("__over").over(stream)).withColumn("__seq", F.row_number().over(stream.orderBy("seq", "__k")).cast("long"))
    else:
        any_over = chunks.agg(F.coalesce(F.max(over), F.lit(False))).scalar()
        placed = sequenced(rows.withColumnRenamed("seq", "__old"), ["__old", "__k"])
        rows = placed.withColumnsRenamed({"seq": "__seq", "__old": "seq"}).withColumn("__any", any_over)
    size = F.when(F.col("__over"), F.octet_length("__piece"))
    out = rows.withColumn("seq", F.when(F.col("__any"), F.col("__seq")).otherwise(F.col("seq"))).withColumn("data", F.col("__piece")).withColumn("size_bytes", size)
    return out.drop("__over", "__parts", "__k", "__piece", "__any", "__seq")


def filter_chunks(chunks: DataFrame, options: FilterOptions) -> DataFrame:
    """chunks: seq, data, maybe origin. Adds chunk_id, source and metrics; the discarded ones only if asked for."""
    origin = F.col("origin") if "origin" in chunks.columns else F.lit(None).cast("string")
    scored = with_metrics(chunks, "data", options.task, options.threshold)
    out = scored.withColumn("chunk_id", F.format_string("chnk-%03d", F.col("seq"))).withColumn("source", F.coalesce(nonempty(origin), F.lit(DEFAULT_SOURCE)))
    return out if options.include_discarded else out.filter("metrics.is_salient")


def summary(scored: DataFrame, *by: str) -> DataFrame:
    """scored: all chunks with metrics. evaluated, salient, discarded and the share that was discarded (3 places)."""
    rows = scored.groupBy(*by).agg(F.count(F.lit(1)).alias("total_evaluated"), F.count_if("metrics.is_salient").alias("salient_count"))
    rows = rows.withColumn("discarded_count", F.col("total_evaluated") - F.col("salient_count"))
    ratio = F.when(F.col("total_evaluated") > 0, F.round(F.col("discarded_count") / F.col("total_evaluated"), 3)).otherwise(0.0)
    return rows.withColumn("noise_reduction_ratio", ratio)


def confusion(scored: DataFrame, is_noise: Column) -> DataFrame:
    """One row: how many noise and signal chunks were discarded and kept, and the two rates."""
    salient = F.col("metrics.is_salient")
    c = scored.agg(
        F.count_if(is_noise & ~salient).alias("noise_discarded"),
        F.count_if(is_noise & salient).alias("noise_kept"),
        F.count_if(~is_noise & salient).alias("signal_kept"),
        F.count_if(~is_noise & ~salient).alias("signal_discarded"),
    )
    rate = lambda a, b: F.round(F.try_divide(F.col(a), F.col(a) + F.col(b)), 4)
    return c.withColumns({"tnr": rate("noise_discarded", "noise_kept"), "tpr": rate("signal_kept", "signal_discarded")})


def percentile_by_index(values: Column, percent: int) -> Column:
    """The element at n * percent / 100 (rounded down) of the sorted values, without interpolation. For bounded groups."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) * percent / 100).cast("int"))


def distributed_percentiles(values: DataFrame, column: str, percents: tuple[int, ...]) -> DataFrame:
    """The same for a whole table: percent, value. Equal values are merged first; ranks come from their counts, per range
    partition, so no task sees all values."""
    rows = values.filter(F.col(column).isNotNull()).select(F.col(column).alias("v"), F.monotonically_increasing_id().alias("r"))
    placed = sequenced(rows, ["v", "r"])
    n = rows.count()
    wanted = {p: n * p // 100 + 1 for p in percents}
    seqs = F.create_map(*[x for k in sorted(set(wanted.values())) for x in (F.lit(k).cast("long"), F.array(*[F.lit(q) for q, j in wanted.items() if j == k]))]) if n else None
    if seqs is None:
        return rows.select(F.lit(0).alias("percent"), F.col("v").alias("value")).limit(0)
    return placed.filter(F.col("seq").isin(*wanted.values())).select(F.explode(seqs[F.col("seq")]).alias("percent"), F.col("v").alias("value"))
