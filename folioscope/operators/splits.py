"""Vectors in packed blocks, and two sets of blocks that meet split by split.

A block is one row: about a megabyte of vectors as raw numbers, with the columns that belong to them as
arrays.  The blocks of the larger set are dealt to splits of a bounded size, and every block of the
smaller set is sent to each split.  A task that gets a split holds its vectors and lets the other blocks
pass by one at a time, so its memory is that of one split and one block, however many rows either set
has, and nothing goes through the driver.  The larger set is read once and moved once, and the smaller
one as often as there are splits.

Where the smaller set is large as well, its blocks are dealt to groups of a bounded size and the others to
lanes, each moved once, and a task is a lane and a group: it holds the group and lets the lane pass by.  Every
task reads the two anew, so what is written does not grow with the product of the sets, only what is computed.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of vectors in one block.
BLOCK_BYTES = 1 << 20

#: Bytes of vectors in one split, which a task holds as 64-bit numbers, and once more scaled to length 1.
SPLIT_BYTES = 32 << 20

#: Splits are at least this many, so that a small index still has several tasks.
LEAST_SPLITS = 8

#: Bytes of vectors in one held block where the asked blocks have groups.
LANE_BLOCK_BYTES = 8 << 20

#: Tasks that there are at least, if the splits allow it, where the asked blocks have groups.
_LANE_TASKS = 32

_HEAD = [T.StructField(name, T.LongType()) for name in ("block", "n", "least", "most")]


def packed(rows: DataFrame, vector: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of ``rows``: ``block, n, least, most``, each other column as an array, and ``vectors``.

    ``least`` and ``most`` are the shortest and longest vector (a null one counts as -1).  Vectors are
    numbers of their own type one after the other where all of a block are of the same length, and otherwise
    64-bit ones padded with zeros.
    """
    others = [f for f in rows.schema.fields if f.name != vector]
    schema = T.StructType([*_HEAD, *(T.StructField(f.name, T.ArrayType(f.dataType)) for f in others), T.StructField("vectors", T.BinaryType())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for batch in batches:
            values = batch.column(len(others)).flatten()
            step = max(1, batch.num_rows * block_bytes // max(8 * len(values), 1))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                held.append(part)
                size += 8 * len(part.column(len(others)).flatten())
                if size >= block_bytes:
                    yield _block(number, held, len(others))
                    number, held, size = number + 1, [], 0
        if held:
            yield _block(number, held, len(others))

    return rows.select(*(f.name for f in others), vector).mapInArrow(pack, schema)


def _block(number: int, parts: list[pa.RecordBatch], at: int) -> pa.RecordBatch:
    table = pa.Table.from_batches(parts).combine_chunks()
    n = table.num_rows
    vectors = table.column(at).combine_chunks()
    lengths = vectors.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    flat = flat.astype(np.float32 if flat.dtype == np.float32 else np.float64, copy=False)
    most = int(lengths.max())
    if lengths.min() != most:
        whole = np.zeros((n, max(most, 0)))
        sizes = np.maximum(lengths, 0)
        row = np.repeat(np.arange(n), sizes)
        whole[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        flat = whole
    head = {"block": number, "n": n, "least": int(lengths.min()), "most": most}
    columns = {name: pa.array([value], pa.int64()) for name, value in head.items()}
    for name in table.column_names[:at]:
        values = table.column(name).combine_chunks()
        columns[name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
    columns["vectors"] = pa.array([flat.tobytes()], pa.binary())
    return pa.RecordBatch.from_pydict(columns)


class Block:
    """One block in a task: its vectors as a matrix and its other columns as Arrow arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int, prefix: str):
        self._batch, self._row, self._prefix = batch, row, prefix
        self.number = self["block"]
        self.n, self.least, self.most = self["n"], self["least"], self["most"]

    @property
    def vectors(self) -> np.ndarray:
        data = self._batch.column(f"{self._prefix}vectors")[self._row].as_buffer()
        kind = np.float32 if data.size == 4 * self.n * self.most else np.float64
        return np.frombuffer(data, kind).astype(np.float64, copy=False).reshape(self.n, max(self.most, 0))

    def __getitem__(self, name: str):
        return self._batch.column(self._prefix + name)[self._row].as_py()

    def column(self, name: str) -> pa.Array:
        return self._batch.column(self._prefix + name)[self._row].values


def split_count(rows: int, width: int, split_bytes: int = SPLIT_BYTES) -> int:
    return max(LEAST_SPLITS, -(-rows * max(width, 1) * 8 // split_bytes))


def lane_count(splits: int, groups: int) -> int:
    """How many tasks the held blocks are dealt to for each group of asked blocks.

    With many groups there is one, so that what is told of an asked row does not grow with the held ones.
    """
    return splits if groups == 1 else min(splits, -(-_LANE_TASKS // groups))


def meet(
    asked: DataFrame,
    held: DataFrame,
    splits: int,
    work: Callable[[Iterator[tuple[int, list[Block], Block]]], Iterator[pa.RecordBatch]],
    schema: T.StructType | str,
    groups: int = 1,
) -> DataFrame:
    """``work`` over all ``(split, blocks of the split, asked block)``, one task's after the other.

    Both sides are block tables of ``packed``; splits of one task come one after the other, and within a
    split the asked blocks in order of their number.  With ``groups`` the blocks of a group are asked as one,
    and a held block, which may be larger then, is a split.
    """
    if groups > 1:
        return _met_in_lanes(asked, held, splits, work, schema, groups)
    at = F.pmod(F.xxhash64("block"), F.lit(splits)).cast("int")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(splits - 1)))
    sent_held = held.select(at.alias("split"), F.lit(0).alias("turn"), "block", *(F.col(c).alias(f"held_{c}") for c in held.columns))
    sent = asked.select(everywhere.alias("split"), F.lit(1).alias("turn"), "block", *(F.col(c).alias(f"asked_{c}") for c in asked.columns))
    both = sent_held.unionByName(sent, allowMissingColumns=True).repartition("split")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(_meetings(batches))

    return both.sortWithinPartitions("split", "turn", "block").mapInArrow(run, schema)


def _met_in_lanes(asked: DataFrame, held: DataFrame, splits: int, work: Callable, schema: T.StructType | str, groups: int) -> DataFrame:
    """``meet`` as a product of lanes and groups, of which only the two sets themselves are shuffled."""
    dealt_to = lambda n: F.pmod(F.xxhash64("block"), F.lit(n)).cast("int")
    lanes = held.repartitionById(lane_count(splits, groups), dealt_to(lane_count(splits, groups)))
    grouped = asked.repartitionById(groups, dealt_to(groups)).mapInArrow(_gathered, asked.schema)
    left = lanes.select(*(F.col(c).alias(f"held_{c}") for c in held.columns))
    right = grouped.select(*(F.col(c).alias(f"asked_{c}") for c in asked.columns))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return work(_pairs(batches))

    # The product holds the rows of the right side, one group, and streams the left one.
    return left.crossJoin(right.hint("shuffle_replicate_nl")).mapInArrow(run, schema)


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All blocks of a partition as one; their vectors are of one length."""
    table = pa.Table.from_batches(list(batches)) if (batches := [b for b in batches if b.num_rows]) else None
    if table is None:
        return
    table = table.sort_by("block")
    n = sum(table.column("n").to_pylist())
    columns = {"block": table.column("block")[0:1], "n": pa.array([n], pa.int64()), "least": table.column("least")[0:1], "most": table.column("most")[0:1]}
    for name in table.column_names[len(columns) : -1]:
        values = table.column(name).combine_chunks().flatten()
        columns[name] = pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), values)
    columns["vectors"] = pa.array([b"".join(v.as_buffer() for v in table.column("vectors"))], pa.binary())
    yield from pa.table(columns).combine_chunks().to_batches()


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Block], Block]]:
    for batch in batches:
        for row, number in enumerate(batch.column("held_block").to_pylist()):
            yield number, [Block(batch, row, "held_")], Block(batch, row, "asked_")


def _meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[Block], Block]]:
    split, blocks = None, []
    for batch in batches:
        names, turns = batch.column("split").to_pylist(), batch.column("turn").to_pylist()
        for row, (name, turn) in enumerate(zip(names, turns, strict=True)):
            if name != split:
                split, blocks = name, []
            if turn == 0:
                # A copy of this row alone, so that the batch it came in can go.
                alone = pa.Table.from_batches([batch.slice(row, 1)]).take(pa.array([0])).to_batches()[0]
                blocks.append(Block(alone, 0, "held_"))
            elif blocks:
                yield split, blocks, Block(batch, row, "asked_")
