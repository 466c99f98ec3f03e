"""Helpers that all operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.work import checkpoint, shared_dir

__all__ = ["ascii_lower", "checkpoint", "give_back", "shared_dir", "slices", "table"]
_C = ctypes.CDLL(None)


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def give_back() -> None:
    """Hand memory that is free back to the system, since workers live on beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_C, "malloc_trim", None):
        trim(0)


def slices(batch: pa.RecordBatch, text: int, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about so many bytes of text each, whole rows, at least one; what they took goes back to the
    system after the batch."""
    sizes = np.cumsum(np.asarray(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False), np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(at, to - at)
        at = to
    give_back()
