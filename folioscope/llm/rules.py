"""Quality rules: plain counts of a text, and a likelihood ratio of hashed n-grams.

Words and pairs of neighbouring words of every whole text are hashed into buckets.  The buckets' counts
over trusted documents and over the whole corpus are two multinomials; a bucket's weight is the log of
their ratio, both smoothed by the same pseudo-counts, so that a bucket that is hardly ever seen has a
weight near zero.  A document's score is the mean weight of its n-grams, which does not grow with its
length, and a document is kept if its score reaches the threshold: nothing is drawn at random.

The counts are summed per task and then per bucket; the driver gets two numbers per bucket, whose number
is a parameter.  Texts are never shuffled: the ids of trusted documents are broadcast in parts of a
bounded number of ids, counted before, and beyond the first part each reads the texts once more.

Defined results: a null text has no words, like an empty one; without words the score is 0; without
trusted documents every weight is 0 and only the counts decide; of an id that is labelled more than once
all labels must agree that it is trusted; null ids are never trusted; repeated rows count as often as
they occur and are scored alike; an empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices
from folioscope.session import stored

BUCKETS = 1 << 18
#: Pseudo-counts per bucket, in counts of the trusted documents.
SMOOTHING = 5.0
#: Ids of trusted documents that are broadcast at once, about 64 MB as long numbers in a hashed relation.
PART_IDS = 4_000_000
#: A document's mean log ratio must reach this.
THRESHOLD = -0.3

LEAST_WORDS = 20
#: Words in repeated windows, in percent of all words.
MOST_REPEATED = 30
WINDOW_WORDS = 8

_SYMBOLS = b"#*$%&|<>"
_BLANKS = b" \t\n\x0b\x0c\r"
_FOLLOWING = bytes(range(0x80, 0xC0))
_CACHED_WORDS = 1 << 20

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: list[bytes], window: int = WINDOW_WORDS) -> int:
    """Words that lie in a window of ``window`` words, a power of two, that occurs twice or more."""
    if len(words) < window:
        return 0
    numbers: dict[bytes, int] = {}
    ranks = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    # Numbers of longer and longer windows, equal where the windows are.
    length = 1
    while length < window:
        pairs = ranks[:-length] * (int(ranks.max()) + 1) + ranks[length:]
        ranks = np.unique(pairs, return_inverse=True)[1]
        length *= 2
    often = np.bincount(ranks)[ranks] > 1
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.nonzero(often)[0]
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + window, -1)
    return int(np.count_nonzero(np.cumsum(ends)))


def text_counts(data: bytes, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """The ``COUNTS`` of a text in UTF-8 and its words."""
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(words),
        len(data.translate(None, _FOLLOWING + _BLANKS)),
        len(data) - len(data.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


class Hasher:
    """Buckets of a text's words and pairs of words; remembers the words' hashes."""

    def __init__(self, buckets: int):
        self.buckets = np.uint64(buckets)
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > _CACHED_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w)
        single = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        single *= np.uint64(0x9E3779B97F4A7C15)
        pairs = (single[:-1] ^ (single[:-1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + single[1:]
        hashes = np.concatenate([single, pairs])
        hashes ^= hashes >> np.uint64(32)
        return (hashes % self.buckets).astype(np.int64)


def _text(value: str | None) -> bytes:
    return (value or "").encode("utf-8", "surrogatepass")


def _counted(buckets: int, whole: bool):
    """A task's counts of each bucket over all its texts, if asked for, and over the trusted ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(buckets)
        sums = np.zeros((2, buckets), np.int64)
        for batch in slices(batches, 1):
            for trusted, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts = np.bincount(found) if len(found := hashed(_text(text).split())) else found
                if whole:
                    sums[0, : len(counts)] += counts
                if trusted:
                    sums[1, : len(counts)] += counts
        seen = np.nonzero(sums.any(axis=0))[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(seen), "corpus": pa.array(sums[0, seen]), "trusted": pa.array(sums[1, seen])})

    return run


def log_ratios(corpus: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """Each bucket's log ratio of the trusted share to the corpus share."""
    expected = corpus * (trusted.sum() / max(corpus.sum(), 1))
    return np.log((trusted + smoothing) / (expected + smoothing))


def fit_ratios(
    documents: DataFrame, trusted: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, part_ids: int = PART_IDS
) -> np.ndarray:
    """The weights from ``(row_id, row_text)`` and the distinct ids ``(trusted_id)``."""
    trusted = stored(trusted, "trusted")
    parts = max(1, -(-trusted.count() // part_ids))
    cells = None
    for i in range(parts):
        part = F.broadcast(trusted.where(F.pmod(F.xxhash64("trusted_id"), F.lit(parts)) == i))
        # The first pass counts every text, the others only those of their trusted ids.
        flagged = documents.join(part, F.col("row_id") == F.col("trusted_id"), "inner" if i else "left")
        counts = flagged.select(F.col("trusted_id").isNotNull(), "row_text").mapInArrow(_counted(buckets, i == 0), "bucket long, corpus long, trusted long")
        cells = counts if cells is None else cells.unionAll(counts)
    # Two numbers for each of a fixed number of buckets.
    sums = cells.groupBy("bucket").agg(F.sum("corpus").alias("corpus"), F.sum("trusted").alias("trusted")).toArrow()
    counts = np.zeros((2, buckets), np.int64)
    for i, name in enumerate(("corpus", "trusted")):
        counts[i, sums.column("bucket").to_numpy()] = sums.column(name).to_numpy()
    return log_ratios(counts[0], counts[1], smoothing)


def _judged(weights: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = Hasher(len(weights))
        for batch in slices(batches, 1):
            counts, scores = [], []
            for text in batch.column(1).to_pylist():
                data = _text(text)
                words = data.split()
                counts.append(text_counts(data, words))
                scores.append(float(weights[hashed(words)].mean()) if words else 0.0)
            columns = dict(zip(COUNTS, (pa.array(c, pa.int64()) for c in zip(*counts, strict=True)), strict=True))
            yield pa.RecordBatch.from_pydict({"row_id": batch.column(0)} | columns | {"score": pa.array(scores)})

    return run


def trusted_ids(labels: DataFrame, good: Column, id_col: str = "doc_id") -> DataFrame:
    """``(trusted_id)``: ids of which every label row is ``good``."""
    judged = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("trusted_id"))
    return judged.agg(F.min(F.coalesce(good, F.lit(False))).alias("_good")).where("_good").select("trusted_id")


def judge_quality(
    documents: DataFrame,
    trusted: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    buckets: int = BUCKETS,
    smoothing: float = SMOOTHING,
    threshold: float = THRESHOLD,
    least_words: int = LEAST_WORDS,
    most_repeated: int = MOST_REPEATED,
    part_ids: int = PART_IDS,
) -> DataFrame:
    """``row_id``, the ``COUNTS``, ``base_failed, score, kept`` of every document."""
    texts = documents.select(F.col(id_col).alias("row_id"), F.col(text_col).cast("string").alias("row_text"))
    weights = fit_ratios(texts, trusted, buckets, smoothing, part_ids)
    key = texts.schema["row_id"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in COUNTS)
    judged = texts.mapInArrow(_judged(weights), f"row_id {key}, {counts}, score double")
    failed = (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return judged.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold))
