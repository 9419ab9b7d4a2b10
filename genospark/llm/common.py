"""Helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import discard, shared_dir, stored

__all__ = ["discard", "shared_dir", "stored"]

#: ASCII white space, as all word and line rules here use it.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Text bytes that one Arrow batch may hold before it reaches Python.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Keeps the bytes that one Arrow batch holds within bounds, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def lower_ascii(c: Column) -> Column:
    """A-Z to a-z; other letters stay."""
    # lower() is much the faster and says the same of text that is ASCII throughout.
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def id_hash(c: Column) -> Column:
    """crc32 of an id written as text, which splits training rows from held-out rows."""
    return F.crc32(c.cast("string").cast("binary"))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: What an operator keeps in a worker from one task to the next, by its name.
_kept: dict[str, dict] = {}


def kept(owner: str) -> dict:
    """What this worker keeps for ``owner`` from task to task.  Executors reuse their workers, so whatever other operators
    left in this one goes: else a pipeline's stages would add up."""
    others = [k for k in _kept if k != owner]
    for k in others:
        del _kept[k]
    if others:
        pa.default_memory_pool().release_unused()
    return _kept.setdefault(owner, {})


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, for work that needs several arrays as long as the texts: ``rows`` rows or about ``most`` bytes
    of strings at most, and one row at least."""
    for batch in batches:
        kinds = (pa.string(), pa.large_string(), pa.binary(), pa.large_binary())
        wide = [pc.binary_length(c).fill_null(0).to_numpy(zero_copy_only=False) for c in batch.columns if c.type in kinds]
        upto = np.cumsum(sum(wide, np.zeros(batch.num_rows, np.int64)))
        at = 0
        while at < batch.num_rows:
            full = int(np.searchsorted(upto, (upto[at - 1] if at else 0) + most, "right"))
            end = min(max(full, at + 1), at + rows, batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
