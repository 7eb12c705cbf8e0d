"""The floor: drops what holds no information, by four ordered rules, and counts it by reason.

One shuffle, which the windows of question contexts and of duplicates share: dialogues by request, since context goes
along the whole of it; all else by request and text, so that one large log is many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DISCARD_REASONS, EngineConfig
from ..functions.text import content_id, is_blank, java_pattern, lines


def static_reason(kind: Column, text: Column, config: EngineConfig) -> Column:
    """blank, separator or heartbeat; null for the rest."""
    beats, not_beats = java_pattern(config.floor_heartbeat_pattern), java_pattern(config.floor_heartbeat_exclude_pattern)
    heartbeat = kind.isin(*sorted(config.floor_heartbeat_types)) & F.forall(lines(text), lambda x: x.rlike(beats) & ~x.rlike(not_beats))
    return (
        F.when(is_blank(text), "blank")
        .when(text.rlike(java_pattern(config.floor_separator_pattern)), "separator")
        .when(heartbeat, "heartbeat")
    )


def with_question(candidates: DataFrame) -> DataFrame:
    """Adds question: the content id of the latest earlier turn that is not blank and has another speaker, or ''.
    Parts of a turn share it."""
    c = candidates.withColumn("__apart", _apart())
    turn = Window.partitionBy("ingest_id", "__apart").orderBy("pos")
    before = turn.rangeBetween(Window.unboundedPreceding, -1)
    said = F.col("__apart").isNull() & F.coalesce("part", F.lit(1)).eqNullSafe(F.lit(1)) & ~is_blank(F.col("text"))
    me = F.struct(F.col("speaker").alias("speaker"), F.coalesce("parent_id", content_id(F.col("text"))).alias("uid"))
    c = c.withColumn("__prev", F.last(F.when(said, me), ignorenulls=True).over(before))
    change = F.when(said & (F.col("__prev.speaker") != F.col("speaker")), F.col("__prev.uid"))
    c = c.withColumn("__other", F.last(change, ignorenulls=True).over(before))
    question = F.when(F.col("__prev.speaker") != F.col("speaker"), F.col("__prev.uid")).otherwise(F.col("__other"))
    return c.withColumn("question", F.coalesce(question, F.lit(""))).drop("__prev", "__other", "__apart")


def _apart() -> Column:
    """Null in dialogues, whose rows stay together; a hash of the text elsewhere."""
    return F.when(~F.col("type").eqNullSafe("dialogue"), F.xxhash64("text"))


def floored(candidates: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """candidates (ingest_id, type, pos, part, parent_id, speaker, text). Adds question and reason (null: kept).
    Duplicates are later rows of the same text in a request, in a dialogue those that also answer the same question by
    the same speaker; rows that an earlier rule drops don't count."""
    config = config or EngineConfig()
    c = with_question(candidates).withColumn("__static", static_reason(F.col("type"), F.col("text"), config))
    talk = F.col("type") == "dialogue"
    key = [F.when(talk, F.col("speaker")), F.when(talk, F.col("question")), F.col("text")]
    c = c.withColumn("__apart", _apart())
    first = Window.partitionBy("ingest_id", "__apart", F.col("__static").isNull(), *key).orderBy("pos", F.coalesce("part", F.lit(0)))
    again = F.col("type").isin(*sorted(config.floor_dedup_types)) & (F.row_number().over(first) > 1)
    return c.withColumn("reason", F.coalesce("__static", F.when(again, "duplicate"))).drop("__static", "__apart")


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("reason IS NULL").drop("reason", "question")


def counts(rows: DataFrame, *by: str) -> DataFrame:
    """Dropped rows by reason, all four columns always there, and kept ones."""
    aggs = [F.count_if(F.col("reason") == r).alias(r) for r in DISCARD_REASONS]
    return rows.groupBy(*by).agg(*aggs, F.count_if(F.col("reason").isNull()).alias("kept"))
