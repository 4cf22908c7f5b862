"""Quality and language: edges, brute force and held-out accuracy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.llm import catalog, language, quality


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    groups = [rng.normal(0, 1, (400, 3)), rng.normal(1, 2, (600, 3))]
    model = quality.Discriminant.fit([400, 600], [g.sum(axis=0) for g in groups], [g.T @ g for g in groups], 0.0)
    x = rng.normal(0.5, 1.5, (50, 3))
    logs = []
    for g in groups:
        mean, cov = g.mean(axis=0), np.cov(g.T, bias=True)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean) + np.linalg.slogdet(cov)[1]))
    gap = logs[1] - logs[0] + np.log(1.5)
    assert model.scores(x) == pytest.approx(1 / (1 + np.exp(-gap)), rel=1e-3, abs=1e-5)


def test_quality_edges(spark, edge, edge_rows, empty):
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (10, 0), (11, 1), (11, 0), (12, None), (None, 1), (20, 7)], "doc_id long, quality int")
    rows = quality.score_quality(edge, labels, F.col("doc_id") > 0).collect()
    assert len(rows) == len(edge_rows)
    assert all(0 <= r.score <= 1 for r in rows)
    none = quality.score_quality(edge, labels.where("false"), F.lit(True)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.score_quality(empty, labels, F.lit(True)).count() == 0
    kept = quality.keep_good(edge, labels, F.lit(True))
    assert kept.columns == edge.columns
    assert kept.count() == sum(r.score >= 0.5 for r in quality.score_quality(edge, labels, F.lit(True)).collect())


def test_quality_on_held_out_labels(spark, sf_dir):
    rows = catalog.op1_quality(spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = rows.where("held_out").join(labels, "doc_id").select("predicted", "quality").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held) > 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 6, 12, 40])
def test_codewords_differ(n):
    words = language.codewords(n)
    assert words.shape[0] == n
    for i in range(n):
        for j in range(i):
            assert (words[i] != words[j]).sum() >= 1
    if n > 1:
        assert (np.abs(words.sum(axis=0)) < n).all()


def test_language_edges(edge, edge_rows, empty):
    rows = language.identify_languages(edge, F.lit(True)).collect()
    assert len(rows) == len(edge_rows)
    got = {r.row_id: r for r in rows}
    for key in (4, 5, 6, 9):
        assert (got[key].lang_pred, got[key].score) == ("und", 0.0)
    assert got[20].lang_pred == "en"
    assert all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in language.identify_languages(edge, F.lit(False)).collect()} == {"und"}
    one = language.identify_languages(edge, F.col("lang") == "fr").collect()
    assert {r.lang_pred for r in one} == {"fr", "und"}
    assert language.identify_languages(empty, F.lit(True)).count() == 0


def test_long_texts_are_taken_whole(monkeypatch):
    counts = np.random.default_rng(1).integers(0, 50, (3, language.BUCKETS))
    model = language.LanguageCodes.fit(["a", "b", "c"], counts)
    data = np.random.default_rng(2).integers(97, 122, 5000).astype(np.uint8)
    whole = model.margins(data, np.array([0, 5000]))
    monkeypatch.setattr(language, "_STEP", 64)
    assert model.margins(data, np.array([0, 5000])) == pytest.approx(whole)


def test_language_on_held_out_documents(spark, sf_dir):
    rows = catalog.op5_language(spark, "/root/testdata/sf0.01").where("held_out")
    truth = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    pairs = rows.join(truth, "doc_id").select("lang", "lang_pred").collect()
    assert sum(r.lang == r.lang_pred for r in pairs) >= 0.97 * len(pairs) > 0
