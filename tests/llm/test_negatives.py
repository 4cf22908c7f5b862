import math
import random

import pytest
from pyspark.sql import functions as F

from folioscope.llm.catalog import QUERIES
from folioscope.llm.negatives import mine_negatives, window

from .conftest import CLASHING

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute_force(rows, every=100, positives=5, negatives=5):
    usable = []
    for n, (name, vector, label) in enumerate(rows):
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        usable.append((n, name, [max(min(math.floor(256 * x), 1 << 53), -(1 << 53)) for x in vector], label))
    last = lambda name: (name is None, name or 0)
    found = []
    for n, name, vector, label in usable:
        if name is None or name % every:
            continue
        scored = [
            (max(min(sum(a * b for a, b in zip(vector, v, strict=False)), (1 << 63) - 1), 1 - (1 << 63)), other, k, m)
            for m, other, v, k in usable
            if m != n
        ]
        ranked = sorted(scored, key=lambda s: (-s[0], last(s[1])))
        for score, other, _, _ in [s for s in ranked if s[2] == label][:positives]:
            hard = [s for s in ranked if s[2] != label and 80 * score <= 100 * s[0] <= 100 * score][:negatives]
            found += [(name, other, rank, s[1], score, s[0]) for rank, s in enumerate(hard, 1)]
    return found


def mined(spark, rows, parts=3, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    frame = frame.withColumns({c: F.lit("x") for c in CLASHING if c not in ("label",)})
    got = mine_negatives(frame, F.col("vec_id") % options.pop("every", 100) == 0, **options)
    return [tuple(r) for r in got.collect()]


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x or 0) for x in r))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    near = lambda c: [c[i] + rng.gauss(0, 0.25) for i in range(6)]
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(4)]
    rows = [(i, near(centres[i % 4]), rng.randrange(3)) for i in range(400)]
    common = centres[0]
    rows += [(1000 + i, common, i % 2) for i in range(300)]  # one vector in two fifths of the rows
    rows += [(1400, common, 0), (1400, common, 1), (1401, common, 0), (1401, common, 0)]  # repeated ids
    rows += [
        (2000, None, 1), (2001, [1.0] * 6, None), (2002, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1),
        (2003, [float("nan")] * 6, 1), (2004, [float("inf")] * 6, 1), (2100, [], 1), (2200, [0.5] * 3, 2),
        (2300, [0.5] * 9, 2), (None, [0.4] * 6, 2), (None, common, 1), (2400, [-1.0] * 6, 0), (-100, near(centres[1]), 1),
    ]
    return rows


@pytest.mark.parametrize("parts", [1, 7])
def test_against_brute_force(spark, rows, parts):
    assert order(mined(spark, rows, parts)) == order(brute_force(rows))


def test_other_settings(spark, rows):
    assert order(mined(spark, rows, every=50, positives=2, negatives=9)) == order(brute_force(rows, 50, 2, 9))


def test_large_components(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.choice([0, 3, 6]) for _ in range(3)], i % 2) for i in range(120)]
    rows += [(200, [1e300, 1.0, 1.0], 0), (201, [1e300, 2.0, 1.0], 0), (202, [1e200, 1.0, 1.0], 1)]
    assert order(mined(spark, rows)) == order(brute_force(rows))


def test_no_rows_and_no_anchors(spark, rows):
    assert mined(spark, rows[1:1]) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 0)]) == []


def test_windows():
    assert window(10) == (8, 10) and window(11) == (9, 11) and window(0) == (0, 0)
    low, high = window(-10)
    assert low > high


def test_query_moves_labels(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    rows = [(r["vec_id"], [float(x) for x in r["embedding"]], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in table]
    got = [tuple(r) for r in QUERIES["op12_negatives"](spark, sf_dir).collect()]
    assert order(got) == order(brute_force(rows))
