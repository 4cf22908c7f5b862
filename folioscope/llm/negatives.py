"""Hard negatives by a secondary-sort shuffle.

Vectors become whole numbers and meet the anchors split by split (``operators.splits``).  A first round
keeps each anchor's best rows of its own label, its positives.  A second one knows the positives' scores
and keeps, for each, the best rows of other labels whose score lies in the positive's window, so only
pair scores that can be in the result leave a task.  These are packed into keys of anchor, descending
score, kind and id, and go through ``repartitionAndSortWithinPartitions``.  An iterator then reads every
anchor's keys from the highest score down: a positive opens its window, a negative is handed to each open
window that it fits, and a window closes when it is full or the scores have left it.  No anchor's pairs
are ever held together.

Defined results: rows whose label, vector or one component is null, or a component not finite, take no
part; vectors of different lengths are compared as if the shorter ended in zeros; null ids sort last and
are never anchors; repeated ids are rows of their own, so an anchor that comes twice is answered twice;
equal scores go to the smaller id.  Scaled components are cut at 2^53 and scores at 2^63 - 1, both ways;
within that, scores are exact.  An empty table gives an empty one.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.operators.splits import Block, meet, packed, split_count
from folioscope.session import stored

POSITIVES = 5
NEGATIVES = 5
#: A negative's score is at least this share of the positive's, in percent.
LEAST_PERCENT = 80
SCALE = 256.0

_EXACT = float(1 << 53)
_TOP = (1 << 63) - 1
#: Cells of one score matrix.
_CELLS = 2_000_000

#: A key: anchor row, descending score, kind (0 positive, 1 negative), null id, id, row.
_KEY = ">QQBBQQ"
_KEY_FIELDS = np.dtype([("anchor", ">u8"), ("down", ">u8"), ("kind", "u1"), ("null", "u1"), ("id", ">u8"), ("row", ">u8")])
_SIGN = 1 << 63


def whole_numbers(block: Block, scale: float = SCALE) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(scale * block.vectors), -_EXACT, _EXACT)


def inner_products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Exact products of rows of whole numbers, as 64-bit integers."""
    width = min(left.shape[1], right.shape[1])
    left, right = left[:, :width], right[:, :width]
    most = np.abs(left).max(initial=0.0) * np.abs(right).max(initial=0.0) * width
    if most < _EXACT:
        return (left @ right.T).astype(np.int64)
    exact = np.dot(left.astype(np.int64).astype(object), right.astype(np.int64).astype(object).T)
    return np.clip(exact, -_TOP, _TOP).astype(np.int64)


class Rows:
    """What is known of a block's rows besides their vectors, in order of their ids, nulls last."""

    def __init__(self, block: Block):
        ids, row = block.column("id"), block.column("row").to_numpy()
        null = np.asarray(ids.is_null())
        value = ids.fill_null(0).to_numpy().astype(np.int64)
        order = np.lexsort((row, value, null))
        self.id, self.null, self.row = value[order], null[order], row[order]
        self.label = block.column("label").to_numpy(zero_copy_only=False)[order]
        self.vectors = whole_numbers(block)[order]


class Best:
    """The ``k`` best (score, row) pairs of each anchor so far, ties to the smaller id."""

    def __init__(self, anchors: int, k: int):
        self.k = k
        self.floor = np.full(anchors, -_TOP - 1, np.int64)
        self.anchor = np.empty(0, np.int64)
        self.pairs = np.empty((4, 0), np.int64)  # score, id, null, row

    def add(self, scores: np.ndarray, fits: np.ndarray, rows: Rows, part: slice) -> None:
        """Take in scores, one line per anchor and one column per row, where they fit."""
        keep = fits & (scores >= self.floor[:, None])
        found = np.count_nonzero(keep)
        if not found:
            return
        if scores.shape[1] > self.k and found > 4 * self.k * len(scores):
            kth = np.partition(np.where(keep, scores, -_TOP - 1), -self.k, axis=1)[:, -self.k]
            floor = np.maximum(self.floor, kth)[:, None]
            # Columns are in order of their ids, so of equal scores the first k are enough.
            tied = keep & (scores == floor)
            keep &= (scores > floor) | (tied & (np.cumsum(tied, axis=1, dtype=np.int32) <= self.k))
        anchor, at = np.nonzero(keep)
        new = np.stack([scores[anchor, at], rows.id[part][at], rows.null[part][at].astype(np.int64), rows.row[part][at]])
        anchor, pairs = np.concatenate([self.anchor, anchor]), np.concatenate([self.pairs, new], axis=1)
        order = np.lexsort((pairs[3], pairs[1], pairs[2], -pairs[0], anchor))
        anchor = anchor[order]
        place = np.arange(len(anchor)) - np.searchsorted(anchor, anchor, side="left")
        order = order[place < self.k]
        full = place == self.k - 1
        self.anchor, self.pairs = anchor[place < self.k], pairs[:, order]
        self.floor[anchor[full]] = self.pairs[0][np.searchsorted(self.anchor, anchor[full], "right") - 1]


def _scored(meetings: Iterator[tuple[int, list[Block], Block]]) -> Iterator[tuple[Block, np.ndarray, list[tuple]]]:
    """Each asked block with its whole numbers and the rows of the split."""
    last, rows = None, []
    for split, blocks, asked in meetings:
        if split != last:
            last, rows = split, [Rows(b) for b in blocks]
        yield asked, whole_numbers(asked), rows


def _parts(rows: Rows, anchors: int) -> Iterator[slice]:
    step = max(1, _CELLS // anchors)
    for at in range(0, len(rows.id), step):
        yield slice(at, at + step)


def _positives(k: int):
    def work(meetings) -> Iterator[pa.RecordBatch]:
        for asked, vectors, held in _scored(meetings):
            best = Best(asked.n, k)
            own, label = asked.column("row").to_numpy(), asked.column("label").to_numpy(zero_copy_only=False)
            for rows in held:
                for part in _parts(rows, asked.n):
                    fits = (label[:, None] == rows.label[part]) & (own[:, None] != rows.row[part])
                    best.add(inner_products(vectors, rows.vectors[part]), fits, rows, part)
            score, value, null, row = best.pairs
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(own[best.anchor]),
                    "anchor_id": asked.column("id").take(pa.array(best.anchor)),
                    "score": pa.array(score),
                    "id": pa.array(value, mask=null.astype(bool)),
                    "row": pa.array(row),
                }
            )

    return work


def window(positive: int, least_percent: int = LEAST_PERCENT) -> tuple[int, int]:
    """The lowest and highest score of a positive's negatives; empty (low > high) below zero."""
    return -((-least_percent * positive) // 100), positive


def _negatives(k: int, least_percent: int):
    def work(meetings) -> Iterator[pa.RecordBatch]:
        for asked, vectors, held in _scored(meetings):
            own, label = asked.column("row").to_numpy(), asked.column("label").to_numpy(zero_copy_only=False)
            tops = asked.column("tops").to_pylist()
            most = max(map(len, tops))
            # Anchors with fewer positives get empty windows for the rest.
            low = np.full((most, asked.n), _TOP, np.int64)
            high = np.full((most, asked.n), -_TOP - 1, np.int64)
            for i, scores in enumerate(tops):
                for j, score in enumerate(scores):
                    low[j, i], high[j, i] = window(score, least_percent)
            best = [Best(asked.n, k) for _ in range(most)]
            for rows in held:
                for part in _parts(rows, asked.n):
                    scores = inner_products(vectors, rows.vectors[part])
                    other = label[:, None] != rows.label[part]
                    for j in range(most):
                        best[j].add(scores, other & (scores <= high[j][:, None]) & (scores >= low[j][:, None]), rows, part)
            anchor = np.concatenate([b.anchor for b in best])
            pairs = np.concatenate([b.pairs for b in best], axis=1)
            _, first = np.unique(np.stack([anchor, pairs[3]]), axis=1, return_index=True)
            score, value, null, row = pairs[:, first]
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": pa.array(own[anchor[first]]),
                    "anchor_id": asked.column("id").take(pa.array(anchor[first])),
                    "score": pa.array(score),
                    "id": pa.array(value, mask=null.astype(bool)),
                    "row": pa.array(row),
                }
            )

    return work


def _keys(kind: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.zeros(batch.num_rows, _KEY_FIELDS)
            ids = batch.column("id")
            keys["anchor"] = batch.column("anchor").to_numpy().astype(np.uint64)
            keys["down"] = (_TOP - batch.column("score").to_numpy()).view(np.uint64)
            keys["kind"] = kind
            keys["null"] = np.asarray(ids.is_null())
            keys["id"] = ids.fill_null(0).to_numpy().astype(np.int64).view(np.uint64) ^ np.uint64(_SIGN)
            keys["row"] = batch.column("row").to_numpy().astype(np.uint64)
            data = [k.tobytes() for k in keys]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary()), batch.column("anchor_id")], names=["key", "anchor_id"])

    return run


def _by_anchor(key: bytes) -> int:
    return zlib.crc32(key[:8])


def _mined(limit: int, least_percent: int):
    def run(rows: Iterator[tuple[bytes, int]]) -> Iterator[tuple]:
        anchor, windows = None, []
        for key, anchor_id in rows:
            at, down, kind, null, value, _ = struct.unpack(_KEY, key)
            if at != anchor:
                anchor, windows = at, []
            score = _TOP - down
            name = None if null else value - _SIGN
            if kind == 0:
                windows.append([name, score, 0])
                continue
            windows = [w for w in windows if w[2] < limit and 100 * score >= least_percent * w[1]]
            for w in windows:
                w[2] += 1
                yield anchor_id, w[0], w[2], name, w[1], score

    return run


def finite(vector: Column) -> Column:
    """Whether a vector is there and has neither null nor infinite nor undefined components."""
    value = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return vector.isNotNull() & F.coalesce(F.forall(vector, value), F.lit(False))


def mine_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | str = "label",
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    least_percent: int = LEAST_PERCENT,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` tells which rows of ``vectors`` are anchors.
    """
    spark = vectors.sparkSession
    label = F.col(label) if isinstance(label, str) else label
    taking_part = vectors.where(label.isNotNull() & finite(F.col(vector_col))).select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).cast("long").alias("id"),
        label.alias("label"),
        F.coalesce(anchors, F.lit(False)).alias("asked"),
        F.col(vector_col).cast("array<double>").alias("vector"),
    )
    # Row numbers are fixed by writing them.
    rows = stored(taking_part, "negatives-rows")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("width")).first()
    splits = split_count(size["n"], size["width"])
    held = packed(rows.select("row", "id", "label", "vector"), "vector")
    asked = rows.where(F.col("asked") & F.col("id").isNotNull()).select("row", "id", "label", "vector")
    pair = "anchor long, anchor_id long, score long, id long, row long"
    near = meet(packed(asked, "vector"), held, splits, _positives(positives), pair)
    order = Window.partitionBy("anchor").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "row")
    chosen = stored(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= positives).drop("place"), "positives")
    tops = chosen.groupBy(F.col("anchor").alias("row")).agg(F.collect_set("score").alias("tops"))
    with_tops = asked.join(tops, "row").select("row", "id", "label", "tops", "vector")
    hard = meet(packed(with_tops, "vector"), held, splits, _negatives(negatives, least_percent), pair)
    key = "key binary, anchor_id long"
    keys = chosen.mapInArrow(_keys(0), key).unionAll(hard.mapInArrow(_keys(1), key))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = keys.rdd.map(lambda r: (bytes(r[0]), r[1])).repartitionAndSortWithinPartitions(partitions, _by_anchor)
    found = ordered.mapPartitions(_mined(negatives, least_percent))
    schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    return spark.createDataFrame(found, schema, verifySchema=False)
