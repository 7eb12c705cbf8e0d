"""Schemas of requests, candidates and chunks."""

from __future__ import annotations

from pyspark.sql import types as T

TURN = T.StructType(
    [
        T.StructField("speaker", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("turn_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

REQUEST = T.StructType(
    [
        T.StructField("ingest_id", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("session", T.StringType()),
        T.StructField("task", T.StringType()),
        T.StructField("format", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("body", T.BinaryType()),
        T.StructField("filename", T.StringType()),
        T.StructField("content_type", T.StringType()),
        T.StructField("speaker", T.StringType()),
        T.StructField("turns", T.ArrayType(TURN)),
    ]
)

#: The fields that a JSON request may have; any other is an error.
REQUEST_JSON = ("type", "source", "session", "task", "format", "text", "speaker", "turns")

CHUNK_FIELDS = (
    "id memory_id text type format source session speaker turn_id parent_id part parts heading seq ts task task_score strong score_status".split()
)

#: Bytes that a stored record takes besides its strings, and what a score adds.
RECORD_SLOT_BYTES, SCORE_BYTES = 280, 8
SIZED_FIELDS = "id memory_id text type format source session speaker turn_id parent_id heading task score_status".split()
