"""Task scores: embedders, cosine, routing to strong or weak, statuses. Scoring never drops a chunk."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions.text import cosine


class EmbedError(Exception):
    """rejected: the service answered, but not with vectors, so smaller batches may pass."""

    def __init__(self, message: str, rejected: bool = False):
        super().__init__(message)
        self.rejected = rejected


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class HttpEmbedder:
    """A client of the embeddings protocol: batches, a bearer key, a bounded reply, vectors sorted by index and checked."""

    REPLY_LIMIT = 64 << 20

    def __init__(self, url: str, model: str, dim: int, api_key: str = "", timeout_ms: int = 10000, batch: int = 32):
        self.url, self.model, self.dim, self.api_key, self.timeout, self.batch = url, model, dim, api_key, timeout_ms / 1000, batch

    @classmethod
    def of(cls, config: EngineConfig) -> HttpEmbedder:
        return cls(config.embed_url, config.embed_model, config.embed_dim, config.embed_api_key, config.embed_timeout_ms, config.embed_batch_size)

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [v for at in range(0, len(texts), self.batch) for v in self._batch(texts[at : at + self.batch])]

    def _batch(self, texts: list[str]) -> list[list[float]]:
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model, "input": texts}).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as reply:
                raw = reply.read(self.REPLY_LIMIT + 1)
        except urllib.error.HTTPError as e:
            raise EmbedError(f"embedder replied {e.code}", rejected=True) from e
        except OSError as e:
            raise EmbedError(str(e)) from e
        if len(raw) > self.REPLY_LIMIT:
            raise EmbedError("the reply is too large")
        try:
            rows = sorted(json.loads(raw)["data"], key=lambda r: r["index"])
            vectors = [r["embedding"] for r in rows]
        except (ValueError, KeyError, TypeError) as e:
            raise EmbedError(f"unreadable reply: {e}") from e
        if len(vectors) != len(texts) or any(len(v) != self.dim for v in vectors):
            raise EmbedError(f"expected {len(texts)} vectors of {self.dim}")
        return vectors


class FunctionEmbedder:
    """Vectors from a function of one text: for tests, or a model that lives in the worker."""

    def __init__(self, function: Callable[[str], list[float]]):
        self.function = function

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [self.function(t) for t in texts]


def _attempt(embedder: Embedder, texts: list[str]) -> tuple[list[list[float]] | None, bool]:
    """Vectors, or null and whether the service answered. Errors are told by name: an embedder from another module may
    bring its own copy of the class to a worker."""
    try:
        return list(embedder.embed(texts)), False
    except Exception as e:
        if type(e).__name__ != EmbedError.__name__:
            raise
        return None, bool(getattr(e, "rejected", False))


def embed_each(embedder: Embedder, texts: list[str]) -> list[list[float] | None]:
    """Vectors, or null where there is none. A rejected batch of several texts is tried text by text; a service that
    can't be reached is not asked again."""
    if not texts:
        return []
    found, rejected = _attempt(embedder, texts)
    if found is not None or not rejected or len(texts) == 1:
        return found or [None] * len(texts)
    out: list[list[float] | None] = []
    for t in texts:
        one, rejected = _attempt(embedder, [t])
        out += one or [None]
        if one is None and not rejected:
            break
    return out + [None] * (len(texts) - len(out))


def vectors(text: Column, embedder: Embedder, batch: int = 32) -> Column:
    """The embedding of each text, null for a null text; asked for in Arrow batches."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            wanted = [(k, t) for k, t in enumerate(texts) if t is not None]
            out: list[list[float] | None] = [None] * len(texts)
            for at in range(0, len(wanted), batch):
                some = wanted[at : at + batch]
                for (k, _), v in zip(some, embed_each(embedder, [t for _, t in some]), strict=True):
                    out[k] = v
            yield pd.Series(out, dtype=object)

    return run.asNondeterministic()(text)


def embedding_text(text: Column, heading: Column) -> Column:
    """What is embedded: the heading path gives context; the stored text stays as it is."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat(heading, F.lit("\n\n"), text)).otherwise(text)


def task_score(vector: Column, task_vector: Column) -> Column:
    return F.round(cosine(vector, task_vector), 4)


def routed(chunks: DataFrame, threshold: float, enabled: bool = True) -> DataFrame:
    """chunks with task, vector, task_vector: adds task_score, strong and score_status. strong compares the rounded
    score. Without a task: no_task, also where scoring is off."""
    has_task = F.coalesce(F.col("task"), F.lit("")) != ""
    score = F.when(has_task, task_score(F.col("vector"), F.col("task_vector"))) if enabled else F.lit(None).cast("double")
    c = chunks.withColumn("task_score", score).withColumn("strong", F.coalesce(F.col("task_score") >= threshold, F.lit(False)))
    status = F.when(~has_task, "no_task")
    status = status.otherwise("disabled") if not enabled else status.when(F.col("task_score").isNull(), "embedder_unavailable").otherwise("scored")
    return c.withColumn("score_status", status).drop("vector", "task_vector")


def score(chunks: DataFrame, config: EngineConfig, embedder: Embedder | None) -> DataFrame:
    """chunks: ingest_id, text, heading, task. Tasks are embedded once per request, after the floor."""
    if embedder is None:
        return routed(chunks, config.strong_threshold, enabled=False)
    asked = chunks.filter(F.coalesce("task", F.lit("")) != "").select("ingest_id", "task").distinct()
    tasks = asked.select(F.col("ingest_id").alias("__id"), vectors(F.col("task"), embedder, 1).alias("task_vector"))
    text = F.when(F.coalesce("task", F.lit("")) != "", embedding_text(F.col("text"), F.col("heading")))
    embedded = chunks.withColumn("vector", vectors(text, embedder, config.embed_batch_size))
    joined = embedded.join(tasks, F.col("ingest_id") == F.col("__id"), "left").drop("__id")
    return routed(joined, config.strong_threshold)


def request_status(has_task: Column, enabled: bool, chunks: Column, unscored: Column) -> Column:
    """The status of a request: partial if some chunks lack a score; a task without chunks counts as scored."""
    status = F.when(~has_task, "no_task")
    if not enabled:
        return status.otherwise("disabled")
    return status.when((chunks > 0) & (unscored == chunks), "embedder_unavailable").when(unscored > 0, "partial").otherwise("scored")
