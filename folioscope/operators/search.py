"""Exact cosine top-k of a question batch over an index of vectors.

Questions and index are packed into blocks that meet split by split (``splits``): a task holds one split
of the index, scores the question blocks that pass by with a matrix product, and keeps the best ``k``
per question over all its splits.  A question then has ``k`` hits per task at most, which are ranked by
question.  Many questions are dealt to groups, and a task scores one group.

Once a question has ``k`` hits, products of 32-bit numbers tell which points may be better: their error is
bounded, and the few points within it of the k-th best score are scored again with 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from folioscope.operators.splits import BLOCK_BYTES, LANE_BLOCK_BYTES, SPLIT_BYTES, Block, lane_count, meet, packed, split_count
from folioscope.session import dealt, stored

#: Scores are compared after rounding to this many decimals, so equal vectors tie on
#: every machine, whatever the order of additions, and the id decides between them.
SCORE_DECIMALS = 10

#: Cells of one score matrix in a task; bounds its memory, with the copies it is ranked by, to about 64 MB.
_SCORE_CELLS = 2_000_000

#: Hits, and bytes of questions as 64-bit numbers, of a group of questions, beyond which there are several.
_GROUP_HITS, _GROUP_BYTES = 1 << 18, 32 << 20

#: Numbers of vectors that are scored again at a time.
_RESCORED = 1 << 20

#: Hits of a task are cut down to ``k`` per question when there are so many times more.
_SLACK = 4


def _unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; a row without length stays zero."""
    length = np.sqrt(np.einsum("ij,ij->i", matrix, matrix))
    return matrix / np.where(length > 0, length, 1.0)[:, None]


def _of_width(block: Block, width: int) -> np.ndarray:
    if block.least != width or block.most != width:
        raise ValueError(f"a vector does not have {width} elements like the others")
    return _unit_rows(block.vectors)


class _Best:
    """The best ``k`` (score, id) pairs seen so far for each question of a batch.

    With ``slack`` there may be so many times more before they are cut down, and ``prune`` ends the search.
    """

    def __init__(self, floor: np.ndarray, k: int, slack: int = 0):
        self.k = k
        self.most = slack * k * len(floor)
        self.floor = floor.copy()
        self.question = np.empty(0, dtype=np.int64)
        self.score = np.empty(0)
        self.id: np.ndarray = np.empty(0, dtype=object)
        self.at = np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray, at: np.ndarray | int = 0) -> None:
        """Take in the scores of some points, one row per point and one column per question.

        ``at`` has a number for each of them, or is that of the first.
        """
        places = np.arange(at, at + len(ids)) if isinstance(at, int) else at
        keep = scores >= self.floor
        if len(scores) > self.k and np.count_nonzero(keep) > 4 * self.k * len(self.floor):
            by_id = np.argsort(ids, kind="stable")
            scores, ids, places = scores[by_id], ids[by_id], places[by_id]
            keep = self._narrowed(scores)
        row, question = np.nonzero(keep)
        self._take(question, scores[row, question], ids[row], places[row])

    def offer(self, points: np.ndarray, short: np.ndarray, questions: np.ndarray, asked: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """``add`` of the rounded products of points and questions, of which ``short`` and ``asked`` are the 32-bit numbers."""
        # Rows are of length 1 at most, so this bounds the error of a sum of so many products.
        error = 1.01 * (points.shape[1] + 8) * 2.0**-24 + 10.0**-SCORE_DECIMALS
        if np.isfinite(self.floor).all():
            least = np.nextafter((self.floor - error).astype(np.float32), np.float32(-np.inf))
            row, question = np.nonzero(short @ asked.T >= least)
            if len(row) <= 4 * self.k * len(self.floor):
                scores = np.empty(len(row))
                part = max(1, _RESCORED // max(points.shape[1], 1))
                for at in range(0, len(row), part):
                    some = slice(at, at + part)
                    np.einsum("ij,ij->i", points[row[some]], questions[question[some]], out=scores[some])
                scores = np.round(scores, SCORE_DECIMALS)
                keep = scores >= self.floor[question]
                self._take(question[keep], scores[keep], ids[row[keep]], places[row[keep]])
                return
        self.add(np.round(points @ questions.T, SCORE_DECIMALS), ids, places)

    def _take(self, question: np.ndarray, score: np.ndarray, id_: np.ndarray, at: np.ndarray) -> None:
        if len(question) == 0:
            return
        self.question = np.concatenate([self.question, question])
        self.score = np.concatenate([self.score, score])
        self.id = np.concatenate([self.id, id_])
        self.at = np.concatenate([self.at, at])
        if len(self.question) > self.most or not np.isfinite(self.floor).all():
            self.prune()

    def _narrowed(self, scores: np.ndarray) -> np.ndarray:
        """Which points, in order of their ids, are candidates: at most ``2k`` per question.

        All points above the k-th best score here, and of those that tie with it, maybe
        very many copies, the ``k`` smallest ids.
        """
        kth = np.partition(scores, len(scores) - self.k, axis=0)[len(scores) - self.k]
        floor = np.maximum(self.floor, kth)
        tied = scores == floor
        return (scores > floor) | (tied & (np.cumsum(tied, axis=0, dtype=np.int32) <= self.k))

    def prune(self) -> None:
        order = np.argsort(self.id, kind="stable")
        order = order[np.lexsort((-self.score[order], self.question[order]))]
        question = self.question[order]
        first = np.searchsorted(question, question, side="left")
        place = np.arange(len(question)) - first
        order = order[place < self.k]
        self.question, self.score, self.id, self.at = self.question[order], self.score[order], self.id[order], self.at[order]
        full = place == self.k - 1
        self.floor[question[full]] = self.score[np.searchsorted(self.question, question[full], "right") - 1]


def top_k(
    questions: DataFrame,
    index: DataFrame,
    k: int,
    *,
    question_id: str = "question_id",
    question_vector: str = "vector",
    point_id: str = "id",
    point_vector: str = "vector",
    carried: tuple[str, ...] = (),
    split_bytes: int = SPLIT_BYTES,
) -> DataFrame:
    """``(question_id, rank, point_id, score, *carried)`` of the ``k`` nearest points, best first.

    Ties go to the smaller point id.  There is no score threshold and no filter; a
    filter on ``index`` before the call reaches its scan.  The questions are packed and written when
    this is called; who needs the hits twice, or joins them, writes them too (``stored``), so that
    their real size decides whether the join may broadcast them.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if question_id == point_id:
        raise ValueError("question and point ids need different column names")
    asked = stored(packed(questions.select(F.col(question_id).alias("ids"), F.col(question_vector).alias("vector")), "vector"), "questions")
    width = asked.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.sum("n").alias("n")).first()
    if width["least"] != width["most"] or width["most"] == -1:
        raise ValueError(f"a vector does not have {width['most']} elements like the others")
    size = width["most"] or 0
    group = max(1, min(_GROUP_HITS // k, _GROUP_BYTES // (8 * max(size, 1))))
    groups = -(-(width["n"] or 1) // group)
    points = index.select(F.col(point_id).alias("ids"), *carried, F.col(point_vector).alias("vector"))
    points = packed(points, "vector", min(split_bytes, BLOCK_BYTES if groups == 1 else LANE_BLOCK_BYTES))
    splits = split_count(index.count(), size, split_bytes)
    near = meet(
        asked,
        points,
        splits,
        _nearest(k, size, question_id, point_id, to_arrow_type(index.schema[point_id].dataType), T.StructType([index.schema[c] for c in carried])),
        T.StructType(
            [
                T.StructField(question_id, questions.schema[question_id].dataType),
                T.StructField(point_id, index.schema[point_id].dataType),
                T.StructField("score", T.DoubleType()),
                *(index.schema[c] for c in carried),
            ]
        ),
        groups,
    )
    if groups > 1:
        near = dealt(near, width["n"] * k * lane_count(splits, groups), question_id, task_rows=_GROUP_HITS)
    # Spark keeps k rows a question in each task before it shuffles them, and again afterwards.
    order = Window.partitionBy(question_id).orderBy(F.col("score").desc(), F.col(point_id))
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(question_id, "rank", point_id, "score", *carried)


class _Questions:
    """A block of questions in a task, with the best points found for them."""

    def __init__(self, asked: Block, width: int, k: int):
        self.unit = _of_width(asked, width)
        self.short = self.unit.astype(np.float32)
        # A copy, so that the batch that it came in can go.
        self.ids = asked.column("ids").take(pa.array(np.arange(asked.n)))
        self.best = _Best(np.full(asked.n, -np.inf), k, _SLACK)


class _Values:
    """Columns carried with the points, as numbers of their distinct values: places of rows of all blocks."""

    def __init__(self, names: tuple[str, ...]):
        self.names = names
        self.codes: dict[tuple, int] = {}
        self.rows: list[tuple] = []

    def of(self, block: Block) -> np.ndarray:
        found = np.zeros(block.n, np.int64)
        for at, row in enumerate(zip(*(block.column(c).to_pylist() for c in self.names), strict=True)):
            found[at] = self.codes.setdefault(row, len(self.rows))
            if found[at] == len(self.rows):
                self.rows.append(row)
        return found


def _nearest(k: int, width: int, question_id: str, point_id: str, point_type: pa.DataType, carried: T.StructType):
    types = [to_arrow_type(f.dataType) for f in carried]

    def work(meetings: Iterator[tuple[int, list[Block], Block]]) -> Iterator[pa.RecordBatch]:
        found: dict[int, _Questions] = {}
        values = _Values(tuple(carried.names))
        last, held = None, []
        for split, blocks, asked in meetings:
            if split != last:
                last, held = split, []
                for b in blocks:
                    rows = _of_width(b, width)
                    held.append((b.column("ids").to_numpy(zero_copy_only=False), rows, rows.astype(np.float32), values.of(b)))
            if asked.number not in found:
                found[asked.number] = _Questions(asked, width, k)
            own = found[asked.number]
            step = max(k + 1, _SCORE_CELLS // asked.n)
            for ids, rows, short, places in held:
                for at in range(0, len(ids), step):
                    part = slice(at, at + step)
                    own.best.offer(rows[part], short[part], own.unit, own.short, ids[part], places[part])
        for own in found.values():
            best = own.best
            best.prune()
            yield pa.RecordBatch.from_arrays(
                [
                    own.ids.take(pa.array(best.question)),
                    pa.array(best.id, type=point_type),
                    pa.array(best.score, type=pa.float64()),
                    *(pa.array([row[i] for row in values.rows], type=t).take(pa.array(best.at)) for i, t in enumerate(types)),
                ],
                names=[question_id, point_id, "score", *carried.names],
            )

    return work
