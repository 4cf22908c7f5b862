"""Small helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; every other character as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(key: Column, divisor: int) -> Column:
    """The CRC-32 of a key's decimal text, modulo ``divisor``; null keys count as ''."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % divisor


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column, and where each row starts (one more entry than
    rows).  Nulls have no bytes."""
    kind = pa.large_binary()
    column = column.cast(pa.large_string()) if pa.types.is_string(column.type) else column
    column = column.fill_null("" if pa.types.is_large_string(column.type) else b"").cast(kind)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    if not len(offsets):
        return whole[:0], np.zeros(1, np.int64)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], text: int, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the texts of one are about ``limit`` bytes; one text is never cut."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, starts = utf8(batch.column(text % batch.num_columns))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(starts, starts[at] + limit, side="right")) - 1
            end = min(max(end, at + 1), batch.num_rows)
            yield batch.slice(at, end - at)
            at = end
