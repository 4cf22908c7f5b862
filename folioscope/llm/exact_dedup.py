"""Exact duplicates by Grace hashing: partitions of distinct texts, each in an open-addressing table.

Texts are equal when they are identical after lower-casing A-Z; a null text is an empty one.  Every
map task sends each text that it has once, however many copies it holds, so a text that makes up a
third of all rows reaches its bucket once per batch.  A bucket's task compares complete texts in a
table of bounded size; texts beyond that size are written to the shared folder and dealt out anew by
other bits of their digest, until all buckets fit.

Defined results: null ids sort below all others (a group of null ids has a null ``keep_id``); of
repeated rows that share both the largest id and the text, exactly one stays; an empty table gives an
empty one; other columns of the input, whatever their names, are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower, slices
from folioscope.session import stored

TABLE_BYTES = 48 << 20
#: Bits that tell which texts may have an equal; 8 MB.
REPEATED_BITS = 1 << 26

_NO_ID = -(1 << 63)
_ROWS = "row_uid long, row_id long, digest binary"
_RECORDS = "digest binary, content binary, n_rows long, best_id long, n_best long"


class ContentTable:
    """Open addressing with linear probing over complete contents, holding at most ``limit`` bytes."""

    def __init__(self, limit: int):
        self.limit, self.bytes = limit, 0
        self.slots = np.full(1 << 10, -1, dtype=np.int64)
        self.digests: list[bytes] = []
        self.contents: list[bytes] = []
        self.counts: list[list[int]] = []

    def _slot(self, digest: bytes, content: bytes) -> tuple[int, int]:
        """The slot where a content is or would go, and its entry or -1."""
        mask = len(self.slots) - 1
        at = int.from_bytes(digest[8:16], "little") & mask
        while (entry := int(self.slots[at])) >= 0:
            if self.digests[entry] == digest:
                if self.contents[entry] != content:
                    raise ValueError("two contents share one SHA-256 digest")
                return at, entry
            at = (at + 1) & mask
        return at, -1

    def _grow(self) -> None:
        self.slots = np.full(2 * len(self.slots), -1, dtype=np.int64)
        mask = len(self.slots) - 1
        for entry, digest in enumerate(self.digests):
            at = int.from_bytes(digest[8:16], "little") & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = entry

    def add(self, digest: bytes, content: bytes, rows: int, best: int, ties: int) -> bool:
        """False when the content is new and the table is full."""
        at, entry = self._slot(digest, content)
        if entry >= 0:
            have = self.counts[entry]
            have[0] += rows
            if best > have[1]:
                have[1:] = [best, ties]
            elif best == have[1]:
                have[2] += ties
            return True
        if self.bytes and self.bytes + len(content) + 200 > self.limit:
            return False
        self.bytes += len(content) + 200
        self.slots[at] = len(self.digests)
        self.digests.append(digest)
        self.contents.append(content)
        self.counts.append([rows, best, ties])
        if 2 * len(self.digests) > len(self.slots):
            self._grow()
        return True


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 2):
        texts = pc.ascii_lower(batch.column(2).fill_null("")).cast(pa.binary()).to_pylist()
        digests = pa.array([hashlib.sha256(x).digest() for x in texts], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), digests], names=["row_uid", "row_id", "digest"])


def _records(found: list[tuple[bytes, bytes | None, int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) or [[], [], [], [], []]
    kinds = [pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
    names = ["digest", "content", "n_rows", "best_id", "n_best"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _distinct_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct texts of each slice, with their rows counted."""
    for batch in slices(batches, 1):
        ids = batch.column(0).fill_null(_NO_ID).to_pylist()
        texts = pc.ascii_lower(batch.column(1).fill_null("")).cast(pa.binary()).to_pylist()
        table = ContentTable(1 << 62)
        for key, text in zip(ids, texts, strict=True):
            table.add(hashlib.sha256(text).digest(), text, 1, key, 1)
        yield _records([(d, c, *n) for d, c, n in zip(table.digests, table.contents, table.counts, strict=True)])


def _bucket(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups of a bucket, without content; records that its table has no room for, with it."""
        table = ContentTable(limit)
        for batch in slices(batches, 1):
            over = []
            for record in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not table.add(*record):
                    over.append(record)
            if over:
                yield _records(over)
        yield _records([(d, None, *n) for d, n in zip(table.digests, table.counts, strict=True)])

    return run


def content_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """``(digest, n_rows, best_id, n_best)`` of every distinct text: its rows, its largest id and
    how often that id occurs."""
    records = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    records = records.mapInArrow(_distinct_texts, _RECORDS)
    found, level = None, 0
    while True:
        dealt = records.repartition(F.xxhash64("digest", F.lit(level)))
        done = stored(dealt.mapInArrow(_bucket(table_bytes), _RECORDS), "dedup-level")
        groups = done.where(F.col("content").isNull()).drop("content")
        found = groups if found is None else found.unionByName(groups)
        records, level = done.where(F.col("content").isNotNull()), level + 1
        if records.isEmpty():
            return found


def duplicate_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """One row per document: ``row_id, keep_id, group_size, kept, digest``."""
    keyed = documents.select(F.monotonically_increasing_id().alias("row_uid"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    # Written once, because the row numbers below must be the same wherever they are read.
    rows = stored(keyed.mapInArrow(_digests, _ROWS), "dedup-rows")
    groups = content_groups(documents, id_col, text_col, table_bytes)
    best = F.coalesce("row_id", F.lit(_NO_ID)) == F.col("best_id")
    joined = rows.join(groups, "digest")
    first = (
        joined.where(best & (F.col("n_best") > 1))
        .groupBy("digest")
        .agg(F.min("row_uid").alias("first_uid"))
    )
    tied = joined.join(first, "digest", "left")
    return tied.select(
        "row_id",
        F.nullif("best_id", F.lit(_NO_ID)).alias("keep_id"),
        F.col("n_rows").alias("group_size"),
        (best & (F.coalesce("first_uid", "row_uid") == F.col("row_uid"))).alias("kept"),
        "digest",
    )


def with_repeated(rows: DataFrame, text_col: str, name: str, bits: int = REPEATED_BITS) -> DataFrame:
    """The rows with a column that is true where another row has the text, and for few others; at most
    ``bits`` bits of a bitmap are broadcast for it."""
    # Texts that are equal but for the case of A-Z have equal hashes.
    place = F.xxhash64(F.lower(text_col))
    seen = rows.select(place.alias("hash")).groupBy("hash").agg(F.count(F.lit(1)).alias("n"))
    # Numbers from 1, as Spark's bitmaps have them.
    number = lambda h: F.pmod(h, F.lit(bits)) + 1
    marks = seen.where("n > 1").select(number(F.col("hash")).alias("number"))
    maps = marks.groupBy(F.bitmap_bucket_number("number").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("_bits"))
    placed = rows.withColumn("_bucket", F.bitmap_bucket_number(number(place))).withColumn("_bit", F.bitmap_bit_position(number(place)))
    byte = F.conv(F.hex(F.substring("_bits", (F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = F.coalesce(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1, F.lit(False))
    return placed.join(F.broadcast(stored(maps, "repeated")), "_bucket", "left").withColumn(name, found).select(*rows.columns, name)


def drop_copies(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", table_bytes: int = TABLE_BYTES) -> DataFrame:
    """The documents without copies: of equal texts the row with the largest id, all columns as they
    came.  Rows of texts that repeat are found by id and digest; the others are not moved."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The row as one value, so that its columns may have any names.
    rows = documents.select(F.struct("*").alias("_row"), F.col(id_col).cast("long").alias("_id"), text.alias("_text"))
    marked = with_repeated(rows, "_text", "_repeated")
    # A text that has no equal stays where it is; only the others are moved and compared.
    alone, others = marked.where("not _repeated").select("_row"), marked.where("_repeated").drop("_repeated")
    best = content_groups(others, "_id", "_text", table_bytes)
    name = F.sha2(ascii_lower(F.col("_text")).cast("binary"), 256)
    keys = best.select(F.lower(F.hex("digest")).alias("_digest"), F.col("best_id").alias("_best"), F.col("n_best").alias("_ties"))
    named = others.select("_row", name.alias("_name"), F.coalesce("_id", F.lit(_NO_ID)).alias("_key"))
    kept = named.join(keys, (F.col("_name") == F.col("_digest")) & (F.col("_key") == F.col("_best")))
    found = alone.unionByName(kept.where(F.col("_ties") == 1).select("_row"))
    if not keys.where(F.col("_ties") > 1).isEmpty():
        found = found.unionByName(kept.where(F.col("_ties") > 1).dropDuplicates(["_name"]).select("_row"))
    return found.select("_row.*")
