"""Splitting texts into overlapping chunks."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions.text import has_text, strip


def _windows(pieces: Sequence[str], size: int, overlap: int, glue: str = "") -> Iterator[str]:
    """Greedy runs of neighbouring pieces of at most ``size`` characters, with ``glue`` between them.

    The next run starts at the earliest piece of the previous one for which the
    repeated part has at most ``overlap`` characters and the new piece still fits.
    """
    gap = len(glue)
    begin = 0
    length = -gap
    for end, piece in enumerate(pieces):
        longer = gap + len(piece)
        if begin < end and length + longer > size:
            yield glue.join(pieces[begin:end])
            while begin < end and (length > overlap or length + longer > size):
                length -= len(pieces[begin]) + gap
                begin += 1
        length += longer
    if begin < len(pieces):
        yield glue.join(pieces[begin:])


def _pieces(text: str, separator: str) -> list[str]:
    """``text`` cut before every separator; single characters for the empty one."""
    if not separator:
        return list(text)
    head, *tail = text.split(separator)
    return [piece for piece in (head, *(separator + part for part in tail)) if piece]


def recursive_chunks(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Chunks of one text, cut at the coarsest separator that it contains.

    Pieces that are still too long are cut again at the finer separators.
    """
    level = next((i for i, s in enumerate(separators) if s in text), len(separators) - 1)
    finer = separators[level + 1 :]
    chunks: list[str] = []
    short: list[str] = []

    def flush() -> None:
        chunks.extend(filter(None, (run.strip() for run in _windows(short, size, overlap))))
        short.clear()

    for piece in _pieces(text, separators[level]):
        if len(piece) < size:
            short.append(piece)
            continue
        flush()
        chunks.extend(recursive_chunks(piece, size, overlap, finer) if finer else [piece])
    flush()
    return chunks


def recursive_chunk_column(
    text: Column,
    size: int = C.CHUNK_SIZE,
    overlap: int = C.CHUNK_OVERLAP,
    separators: Sequence[str] = C.CHUNK_SEPARATORS,
) -> Column:
    """``ARRAY<STRING>`` of chunks.

    Texts no longer than the chunk size, the large majority, have one chunk, their
    stripped text, and stay in the JVM; only the others go through Python.
    """
    if not 0 <= overlap <= size:
        raise ValueError("the overlap must be between 0 and the chunk size")
    separators = tuple(separators)

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(texts: pd.Series) -> pd.Series:
        return texts.map(
            lambda one: None if one is None else recursive_chunks(one, size, overlap, separators)
        )

    is_long = F.length(text) >= size
    # The UDF runs for every row whatever the branch, so short texts are replaced by null.
    # Marked as not deterministic, so that no derived filter repeats it.
    long_chunks = split.asNondeterministic()(F.when(is_long, text))
    return (
        F.when(is_long, long_chunks)
        .when(has_text(text), F.array(strip(text)))
        .otherwise(F.array().cast("array<string>"))
    )


def line_chunk_column(
    text: Column, size: int = C.LINE_CHUNK_SIZE, overlap: int = C.LINE_CHUNK_OVERLAP
) -> Column:
    """``ARRAY<STRING>`` of runs of whole lines, in time linear in the text.

    A line that is longer than ``size`` makes a chunk that is longer than ``size``.  Texts of at
    most ``size`` characters are one run and stay in the JVM.
    """

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def runs(texts: pd.Series) -> pd.Series:
        def split(one: str) -> list[str]:
            rows = [line for line in one.split(C.LINE_SEPARATOR) if line]
            return list(_windows(rows, size, overlap, C.LINE_SEPARATOR))

        return texts.map(lambda one: None if one is None else split(one))

    is_long = F.length(text) > size
    rows = F.filter(F.split(text, C.LINE_SEPARATOR, -1), lambda line: line != "")
    # As above: null instead of short texts, and no repeated calls.
    found = F.when(is_long, runs.asNondeterministic()(F.when(is_long, text))).otherwise(
        F.array(F.array_join(rows, C.LINE_SEPARATOR))
    )
    chunks = F.filter(F.transform(found, strip), lambda chunk: chunk != "")
    return F.when(text.isNotNull(), chunks)


def explode_chunks(df: DataFrame, chunks: Column) -> DataFrame:
    """One row per chunk, with its position from 0 as ``chunk_index``; ``text`` is replaced."""
    keep = [c for c in df.columns if c != "text"]
    return df.select(*keep, F.posexplode(chunks).alias("chunk_index", "text"))


def chunk_lengths(chunks: DataFrame, *keys: str, length: Column | None = None) -> DataFrame:
    """Number, shortest, longest and (truncated) median chunk length per key.

    ``percentile`` merges counts of distinct lengths, which chunking bounds, so a file that
    holds most of the chunks is reduced before the shuffle.
    """
    length = F.length("text") if length is None else length
    return chunks.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_chunks"),
        F.min(length).alias("min_length"),
        F.max(length).alias("max_length"),
        F.percentile(length, F.lit(0.5)).cast("int").alias("median_length"),
    )
