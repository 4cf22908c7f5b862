"""Language identification by error-correcting output codes over hashed byte n-grams.

Each language gets a codeword of bits, and each bit a binary classifier: a naive Bayes model that
says whether a text's language has that bit set.  All classifiers come from one table of n-gram counts
per language, summed by Spark over all learnable texts: the counts of the languages with the bit
against those without.  A text's margin for a bit is the mean log ratio of its n-grams.  Decoding sums,
for each codeword, the logistic loss of the margins weighted by how well each bit told the training
texts apart, and takes the codeword of the least loss; a text whose two best codewords are close is
flagged as ambiguous.

Up to ``EXHAUSTIVE`` languages every split of them is a bit; beyond, random splits with the largest
least distance of many drawn sets.  The driver gets the summed counts, ``BUCKETS`` numbers per language.

Defined results: null texts, and texts without a letter, are ``und`` with score 0, as is every text if
there is no learnable one; null languages are not learned from; with one language every text with a
letter is of it; repeated rows are judged alike; an empty table gives an empty one; columns with other
names are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import slices, utf8

BUCKETS = 1 << 14
EXHAUSTIVE = 6
UNKNOWN = "und"
#: Margins are means per n-gram; this many n-grams speak for a text at most.
EVIDENCE = 60.0
AMBIGUOUS = 0.9
_STEP = 4 << 20


def gram_codes(data: np.ndarray, buckets: int = BUCKETS) -> np.ndarray:
    """The bucket of the three bytes that start at each place, A-Z in lower case."""
    low = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint32)
    if len(low) < 3:
        return np.zeros(0, np.int32)
    mixed = (low[:-2] * np.uint32(0x01000193) + low[1:-1] * np.uint32(0x85EBCA6B) + low[2:] * np.uint32(0xC2B2AE35)).astype(np.uint32)
    mixed ^= mixed >> np.uint32(15)
    mixed *= np.uint32(0x2C1B3C6D)
    return (mixed >> np.uint32(32 - int(math.log2(buckets)))).astype(np.int32)


def codewords(languages: int, seed: int = 7) -> np.ndarray:
    """Rows of -1 and 1, one per language."""
    if languages <= EXHAUSTIVE:
        # Every split once: language 0 always on the side of 1, the side of -1 never empty.
        splits = range((1 << max(languages - 1, 0)) - 1)
        columns = [[1] + [1 if s >> i & 1 else -1 for i in range(languages - 1)] for s in splits]
        return np.array(columns, dtype=np.float64).T.reshape(languages, -1)
    bits = math.ceil(10 * math.log2(languages))
    rng, best, least = np.random.default_rng(seed), None, -1
    for _ in range(200):
        drawn = rng.integers(0, 2, (languages, bits)) * 2.0 - 1.0
        # A column that has all languages on one side splits nothing.
        drawn = drawn[:, np.abs(drawn.sum(axis=0)) < languages]
        apart = (drawn.shape[1] - drawn @ drawn.T) / 2
        distance = (apart + np.eye(languages) * bits).min()
        if distance > least:
            best, least = drawn, distance
    return best


@dataclass
class LanguageCodes:
    languages: list[str]
    words: np.ndarray
    weights: np.ndarray
    bit_weights: np.ndarray

    @classmethod
    def fit(cls, languages: list[str], counts: np.ndarray, smoothing: float = 0.5) -> LanguageCodes:
        """``counts``: a row of bucket counts per language.  Each language counts alike, so that the
        rare ones are not drowned."""
        share = (counts + smoothing) / (counts + smoothing).sum(axis=1, keepdims=True)
        words = codewords(len(languages))
        weights = np.zeros((counts.shape[1], words.shape[1]), np.float32)
        quality = np.ones(words.shape[1])
        for bit in range(words.shape[1]):
            side = words[:, bit] > 0
            weights[:, bit] = np.log(share[side].mean(axis=0)) - np.log(share[~side].mean(axis=0))
            # How far the bit's mean margins of the languages keep to their sides.
            means = share @ weights[:, bit]
            quality[bit] = max(1e-3, float((means * words[:, bit]).min()))
        return cls(languages, words, weights, quality / quality.sum() if len(quality) else quality)

    def margins(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The mean margin of each text for each bit."""
        n, bits = len(starts) - 1, self.words.shape[1]
        sums, grams = np.zeros((n, bits)), np.maximum(np.diff(starts) - 2, 0)
        for row in range(n):
            # A text of any length is taken whole, some megabytes at a time.
            for at in range(int(starts[row]), int(starts[row + 1]) - 2, _STEP):
                codes = gram_codes(data[at : min(at + _STEP + 2, int(starts[row + 1]))], len(self.weights))
                counts = np.bincount(codes, minlength=len(self.weights))
                used = np.flatnonzero(counts) if len(codes) < len(counts) else slice(None)
                sums[row] += counts[used] @ self.weights[used]
        return sums / np.maximum(grams, 1)[:, None]

    def decode(self, margins: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The index of the language of the least loss, and its share against the others."""
        if len(self.languages) == 1:
            return np.zeros(len(margins), np.int64), np.ones(len(margins))
        loss = np.stack([(np.logaddexp(0.0, -4.0 * margins * w) * self.bit_weights).sum(axis=1) for w in self.words], axis=1)
        spread = np.minimum(grams, EVIDENCE)[:, None] * (loss.min(axis=1, keepdims=True) - loss)
        share = np.exp(spread)
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        return best, share[np.arange(len(best)), best]


def _counted(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The n-gram counts of each language in a task."""
        counts: dict[str, np.ndarray] = {}
        for batch in slices(batches, 1):
            data, starts = utf8(batch.column(1))
            for row, language in enumerate(batch.column(0).to_pylist()):
                have = counts.setdefault(language, np.zeros(buckets, np.int64))
                for at in range(int(starts[row]), int(starts[row + 1]) - 2, _STEP):
                    have += np.bincount(gram_codes(data[at : min(at + _STEP + 2, int(starts[row + 1]))], buckets), minlength=buckets)
        for language, have in counts.items():
            used = np.flatnonzero(have)
            yield pa.RecordBatch.from_arrays(
                [pa.array([language] * len(used), pa.string()), pa.array(used), pa.array(have[used])], names=["lang", "bucket", "n"]
            )

    return run


def fit_languages(texts: DataFrame, buckets: int = BUCKETS) -> LanguageCodes | None:
    """From ``(lang, text)`` rows; None without any."""
    counted = texts.mapInArrow(_counted(buckets), "lang string, bucket long, n long")
    sums = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang")
    rows = sums.agg(F.collect_list(F.struct("bucket", "n")).alias("cells")).orderBy("lang").collect()
    if not rows:
        return None
    counts = np.zeros((len(rows), buckets))
    for i, row in enumerate(rows):
        for bucket, n in row["cells"]:
            counts[i, bucket] = n
    return LanguageCodes.fit([r["lang"] for r in rows], counts)


def _predicted(model: LanguageCodes | None, ambiguous: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, -1):
            lettered = batch.column(batch.num_columns - 2).to_pylist()
            if model is None:
                names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            else:
                data, starts = utf8(batch.column(batch.num_columns - 1))
                best, score = model.decode(model.margins(data, starts), np.maximum(np.diff(starts) - 2, 0))
                names = [model.languages[i] if ok else UNKNOWN for i, ok in zip(best, lettered, strict=True)]
                score = np.where(lettered, score, 0.0)
            columns = [*batch.columns[:-2], pa.array(names, pa.string()), pa.array(score), pa.array(score < ambiguous)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-2], "lang_pred", "score", "ambiguous"])

    return run


def identify_languages(
    documents: DataFrame,
    learnable: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    buckets: int = BUCKETS,
    ambiguous: float = AMBIGUOUS,
) -> DataFrame:
    """``row_id, learned_from, lang_pred, score, ambiguous`` of every document."""
    text = F.col(text_col).cast("string")
    known = documents.where(learnable & F.col(lang_col).isNotNull() & text.isNotNull())
    model = fit_languages(known.select(F.col(lang_col).cast("string").alias("lang"), text.alias("text")), buckets)
    rows = documents.select(
        F.col(id_col).alias("row_id"),
        learnable.alias("learned_from"),
        F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("lettered"),
        text.alias("row_text"),
    )
    key = rows.schema["row_id"].dataType.simpleString()
    schema = f"row_id {key}, learned_from boolean, lang_pred string, score double, ambiguous boolean"
    return rows.mapInArrow(_predicted(model, ambiguous), schema)
