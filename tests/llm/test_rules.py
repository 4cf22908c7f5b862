import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from folioscope.llm.catalog import QUERIES
from folioscope.llm.rules import BUCKETS, SMOOTHING, THRESHOLD, judge_quality, repeated_words, text_counts, trusted_ids

MASK = (1 << 64) - 1


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def counts(text):
    text = text or ""
    words = words_of(text)
    lines = [x for x in text.split("\n") if words_of(x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return (
        len(words),
        sum(map(len, words)),
        sum(c in "#*$%&|<>" for c in text),
        sum(x in lines[:i] for i, x in enumerate(lines)),
        len(inside),
    )


def buckets(text, n):
    single = [zlib.crc32(w.encode()) * 0x9E3779B97F4A7C15 & MASK for w in words_of(text)]
    pairs = [((a ^ a >> 29) * 0xBF58476D1CE4E5B9 + b) & MASK for a, b in zip(single, single[1:], strict=False)]
    return [(h ^ h >> 32) % n for h in single + pairs]


def brute_force(rows, trusted, n=BUCKETS, smoothing=SMOOTHING):
    """(id, text) rows to (id, counts, base_failed, score, kept) rows."""
    whole, good = Counter(), Counter()
    for name, text in rows:
        whole.update(buckets(text, n))
        if name in trusted:
            good.update(buckets(text, n))
    share = sum(good.values()) / max(sum(whole.values()), 1)
    found = []
    for name, text in rows:
        grams = buckets(text, n)
        weights = [math.log((good[b] + smoothing) / (whole[b] * share + smoothing)) for b in grams]
        score = sum(weights) / len(weights) if weights else 0.0
        base = counts(text)
        failed = base[0] < 20 or 100 * base[4] > 30 * base[0]
        found.append((name, *base, failed, score, not failed and score >= THRESHOLD))
    return found


def same(got, expected):
    key = lambda r: (r[0] is not None, r[0] or 0, r[1:7], round(r[7], 6))
    got, expected = sorted(got, key=key), sorted(expected, key=key)
    assert [r[:7] + r[8:] for r in got] == [r[:7] + r[8:] for r in expected]
    assert all(abs(a[7] - b[7]) < 1e-8 for a, b in zip(got, expected, strict=True))


COLUMNS = ["row_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "score", "kept"]


@pytest.mark.parametrize(
    "text",
    [
        "", " \n\t\x0b\x0c\r ", "one", "a b c d e f g h", "a b c d e f g h " * 2, "a " * 30, "x#y **&%$|<> é漢😀",
        "same\nother\nsame\n same\n\n\nsame", "no\xa0break\x85here\x1cthere", "a b c d e f g h i a b c d e f g h j b c d e f g h i a",
    ],
)
def test_counts(text):
    data = text.encode()
    assert text_counts(data, data.split()) == counts(text)


def test_repeated_windows_overlap():
    rng = random.Random(4)
    for _ in range(200):
        words = [rng.choice("ab").encode() for _ in range(rng.randrange(40))]
        assert repeated_words(words) == counts(" ".join(w.decode() for w in words))[4]


def test_long_text_is_counted_in_whole():
    text = " ".join(f"w{i % 70001}" for i in range(200_000))
    data = text.encode()
    assert text_counts(data, data.split())[4] == 200_000


@pytest.mark.parametrize("part_ids", [1000, 2])
def test_edge_rows(spark, edge, edge_rows, part_ids):
    trusted = {1, 3, 10, 12, 21, 99}
    ids = spark.createDataFrame([(i,) for i in trusted], "trusted_id long")
    got = judge_quality(edge.repartition(4), ids, part_ids=part_ids).select(COLUMNS).collect()
    same([tuple(r) for r in got], brute_force([(d, t) for d, t, _, _ in edge_rows], trusted))


def test_few_buckets_collide_alike(spark, edge, edge_rows):
    ids = spark.createDataFrame([(1,), (2,)], "trusted_id long")
    got = judge_quality(edge, ids, buckets=7).select(COLUMNS).collect()
    same([tuple(r) for r in got], brute_force([(d, t) for d, t, _, _ in edge_rows], {1, 2}, 7))


def test_no_trusted_documents_and_no_documents(spark, edge, empty):
    none = spark.createDataFrame([], "trusted_id long")
    assert {r["score"] for r in judge_quality(edge, none).collect()} == {0.0}
    assert judge_quality(empty, none).count() == 0


def test_all_labels_of_an_id_must_agree(spark):
    labels = spark.createDataFrame([(1, 1), (2, 1), (2, 0), (3, None), (None, 1), (4, 1), (4, 1)], "doc_id long, quality int")
    found = trusted_ids(labels, F.col("quality") == 1)
    assert sorted(r["trusted_id"] for r in found.collect()) == [1, 4]


def test_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").collect()
    trusted = {r["doc_id"] for r in labels if r["quality"] == 1 and r["toxic"] == 0}
    got = QUERIES["op13_rules"](spark, sf_dir).withColumnRenamed("doc_id", "row_id").select(COLUMNS).collect()
    same([tuple(r) for r in got], brute_force(rows, trusted))
