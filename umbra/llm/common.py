"""Shared helpers: reading tables, cutting lineage in the shared folder, small Arrow tools."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import shared_dir, stash  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_fold(col: str = "doc_id"):
    """crc32 of the id's decimal text, modulo 5; fold 0 is held out."""
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5


def held_out(col: str = "doc_id"):
    """Whether the row is in fold 0; a row without an id is not."""
    return F.coalesce(crc_fold(col) == 0, F.lit(False))


def lists(values: np.ndarray, lengths, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each row."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def pieces(batches, rows: int = 0, chars: int = 8_000_000, text: str = "text"):
    """Cut record batches so that a piece holds about `chars` bytes of text: bounds memory for long texts."""
    for b in batches:
        if not b.num_rows:
            continue
        col = column(b, text)
        size = np.cumsum(np.fromiter((len(x) if x is not None else 0 for x in (v.as_buffer() if v.is_valid else None for v in col.cast(pa.binary()))), np.int64, b.num_rows))
        at = 0
        while at < b.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(size, base + chars, "right")))
            if rows:
                to = min(to, at + rows)
            yield b.slice(at, to - at)
            at = to
