"""What the operators of this subpackage share: table access, word patterns, folds, and a cache in the workers."""

from __future__ import annotations

import ctypes
import gc
import sys
import types

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import shared_root, written

__all__ = ["SPACE_CLASS", "WORD_PATTERN", "crc32_mod", "release_memory", "shared_root", "table", "worker_cache", "written"]

#: ASCII white space as the contracts define it: space and U+0009..U+000D.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc32_mod(col: Column, n: int) -> Column:
    """crc32 of the value written as text, modulo n; null counts as an empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def worker_cache() -> dict:
    """A dict that lives as long as the Python process, for models that each task would otherwise load anew."""
    return sys.modules.setdefault("_textmill_worker_cache", types.ModuleType("_textmill_worker_cache")).__dict__


def release_memory() -> None:
    """Hands memory that a Python worker has freed back to the system: workers are used again by later stages, and what
    their allocators keep counts against the executor."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim is not None:
            trim(0)
