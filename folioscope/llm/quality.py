"""Document quality by a regularised quadratic discriminant over text statistics.

Every whole text becomes a short vector of statistics: sizes, and shares on a log-odds scale.  For
each class the labelled rows give a mean and a covariance, which is shrunk towards a multiple of the
identity; the Cholesky factor of each covariance is computed once and cached in the model.  A score is
the logistic of the difference of the two log densities (Mahalanobis distance and log determinant) and
of the log prior.  The sums behind means and covariances are taken over all labelled rows by Spark; the
driver gets two vectors and two matrices.

Defined results: a null text is an empty one and scored like any other; labels that are null, not 0 or
1, or contradict each other for one id are not learned from; without labelled rows of both classes
every score is the share of label 1, or 0.5 without any label; repeated rows are scored alike; an empty
table gives an empty one; ids, languages and sources are never looked at for a score.
"""

from __future__ import annotations

import math
import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices
from folioscope.session import stored

SHRINKAGE = 0.1
#: Log densities differ by thousands far from both classes; the score keeps within this.
CLIP = 30.0

_CAPITALS = bytes(range(65, 91))
_DIGITS = b"0123456789"
_STOPS = b".,;:?"
_SIGNS = bytes(c for c in range(33, 127) if not chr(c).isalnum() and c not in _STOPS + b"'\"-()")

STATISTICS = (
    "word_length",
    "distinct_words",
    "repeated_words",
    "short_words",
    "capitals",
    "digits",
    "stops",
    "signs",
    "repeated_lines",
    "line_words",
    "compression",
)
#: Every statistic starts from this many typical words, so that a short text is not an extreme one.
TYPICAL_WORDS = 25


def _odds(part: float, whole: float, typical: float) -> float:
    """The log odds of a share, as if ``TYPICAL_WORDS`` more had been seen at the typical share."""
    yes = part + TYPICAL_WORDS * typical
    no = whole - part + TYPICAL_WORDS * (1 - typical)
    return math.log(yes / no)


def text_statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, shares on a log-odds scale."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    n, size, m = len(words), len(data), TYPICAL_WORDS
    without = lambda marks: size - len(data.translate(None, marks))
    return [
        math.log((len(text) + 6.0 * m) / (n + m)),
        _odds(n - len(set(words)), n, 0.2) / (1.0 + math.log1p(n + m)),
        _odds(sum(map(operator.eq, words, islice(words, 1, None))), n, 0.02),
        _odds(sum(len(w) <= 3 for w in words), n, 0.35),
        _odds(without(_CAPITALS), size, 0.02),
        _odds(without(_DIGITS), size, 0.005),
        _odds(without(_STOPS), size, 0.03),
        _odds(without(_SIGNS), size, 0.005),
        _odds(len(lines) - len(set(lines)), len(lines), 0.02),
        math.log((n + 4.0 * m) / (len(lines) + 2.0)),
        math.log((len(zlib.compress(data, 1)) + 3.0 * m) / (size + 6.0 * m)),
    ]


@dataclass
class Discriminant:
    """Means, inverted Cholesky factors and log determinants of two classes."""

    prior: float = 0.5
    means: list[np.ndarray] = field(default_factory=list)
    factors: list[np.ndarray] = field(default_factory=list)
    logdets: list[float] = field(default_factory=list)

    @classmethod
    def fit(cls, counts: list[float], sums: list[np.ndarray], products: list[np.ndarray], shrinkage: float = SHRINKAGE) -> Discriminant:
        """From each class's rows, sums and sums of outer products."""
        total = sum(counts)
        model = cls(counts[1] / total if total else 0.5)
        if min(counts) < 2:
            return model
        mean = (sums[0] + sums[1]) / total
        scale = np.sqrt(np.maximum(np.diag(products[0] + products[1]) / total - mean**2, 1e-9))
        for n, s, p in zip(counts, sums, products, strict=True):
            m = s / n
            covariance = (p / n - np.outer(m, m)) / np.outer(scale, scale)
            level = np.trace(covariance) / len(m)
            covariance = (1 - shrinkage) * covariance + (shrinkage * level + 1e-6) * np.eye(len(m))
            lower = np.linalg.cholesky(covariance)
            model.means.append(m)
            model.factors.append(np.linalg.inv(lower) / scale)
            model.logdets.append(2 * float(np.log(np.diag(lower)).sum()))
        return model

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not self.means:
            return np.full(len(x), self.prior)
        density = [-0.5 * ((((x - m) @ f.T) ** 2).sum(axis=1) + d) for m, f, d in zip(self.means, self.factors, self.logdets, strict=True)]
        gap = density[1] - density[0] + math.log(self.prior / (1 - self.prior))
        return 1.0 / (1.0 + np.exp(-np.clip(gap, -CLIP, CLIP)))


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the statistics of the text that stands last, in its place."""
    for batch in slices(batches, -1):
        rows = [text_statistics(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
        columns = [*batch.columns[:-1], pa.array(rows, pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "statistics"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sums of each class, one row per cell of (1, x) times (1, x)."""
    d = len(STATISTICS) + 1
    sums = np.zeros((2, d, d))
    for batch in batches:
        x = np.ones((batch.num_rows, d))
        x[:, 1:] = batch.column(1).flatten().to_numpy().reshape(-1, d - 1)
        label = batch.column(0).to_numpy()
        for k in (0, 1):
            sums[k] += x[label == k].T @ x[label == k]
    labels, cells = np.divmod(np.arange(2 * d * d), d * d)
    yield pa.RecordBatch.from_arrays([pa.array(labels), pa.array(cells), pa.array(sums.ravel())], names=["label", "cell", "value"])


def clean_labels(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """``(label_id, label)`` of the ids whose labels are 0 or 1 and agree."""
    label = F.col(label_col).cast("int")
    rows = labels.where(F.col(id_col).isNotNull() & label.isin(0, 1))
    seen = rows.groupBy(F.col(id_col).alias("label_id")).agg(F.min(label).alias("label"), F.max(label).alias("most"))
    return seen.where(F.col("label") == F.col("most")).drop("most")


def fit_discriminant(vectors: DataFrame, labels: DataFrame, shrinkage: float = SHRINKAGE) -> Discriminant:
    """From ``(row_id, statistics)`` and ``(label_id, label)``."""
    known = vectors.join(labels, F.col("row_id") == F.col("label_id")).select(F.col("label").cast("long"), "statistics")
    cells = known.mapInArrow(_moments, "label long, cell long, value double")
    d = len(STATISTICS) + 1
    sums = np.zeros((2, d * d))
    for row in cells.groupBy("label", "cell").agg(F.sum("value").alias("value")).collect():
        sums[row["label"], row["cell"]] = row["value"]
    sums = sums.reshape(2, d, d)
    return Discriminant.fit(list(sums[:, 0, 0]), list(sums[:, 0, 1:]), list(sums[:, 1:, 1:]), shrinkage)


def _scored(model: Discriminant):
    d = len(STATISTICS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(batch.num_columns - 1).flatten().to_numpy().reshape(-1, d)
            columns = [*batch.columns[:-1], pa.array(model.scores(x))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "score"])

    return run


def score_quality(
    documents: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    shrinkage: float = SHRINKAGE,
) -> DataFrame:
    """``row_id, learned_from, score`` of every document; labels are used where ``learnable`` holds."""
    texts = documents.select(F.col(id_col).alias("row_id"), learnable.alias("learned_from"), F.col(text_col).cast("string").alias("row_text"))
    key = texts.schema["row_id"].dataType.simpleString()
    vectors = stored(texts.mapInArrow(_vectors, f"row_id {key}, learned_from boolean, statistics array<double>"), "quality-statistics")
    model = fit_discriminant(vectors.where("learned_from"), clean_labels(labels, id_col, label_col), shrinkage)
    return vectors.mapInArrow(_scored(model), f"row_id {key}, learned_from boolean, score double")


def keep_good(
    documents: DataFrame,
    labels: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    threshold: float = 0.5,
    shrinkage: float = SHRINKAGE,
) -> DataFrame:
    """The documents that score at least ``threshold``, with the columns they came with."""
    texts = documents.where(learnable).select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    key = texts.schema["row_id"].dataType.simpleString()
    # Vectors meet the labels, as texts would be moved for it once there are too many labels to broadcast.
    vectors = texts.mapInArrow(_vectors, f"row_id {key}, statistics array<double>")
    model = fit_discriminant(vectors, clean_labels(labels, id_col, label_col), shrinkage)

    @F.pandas_udf("double")
    def score(values):
        import pandas as pd

        rows = np.array([text_statistics(t) for t in values]).reshape(-1, len(STATISTICS))
        return pd.Series(model.scores(rows))

    return documents.where(score(F.col(text_col).cast("string")) >= threshold)
