import numpy as np
import pytest

from folioscope.llm import mixing


def test_raking_meets_the_marginals():
    rng = np.random.default_rng(3)
    cells = np.array([(s, l, t) for s in "abcd" for l in "xy" for t in "pq"])
    tokens = rng.integers(100, 1000, len(cells)).astype(float)
    targets = [dict(zip("abcd", (0.3, 0.3, 0.2, 0.2))), {"x": 0.55, "y": 0.45}, {"p": 0.5, "q": 0.5}]
    p = mixing.rake(cells, tokens, targets, 0.3)
    assert (p <= 1).all()
    assert p.max() < 1
    for column, target in enumerate(targets):
        for name, share in target.items():
            assert (tokens * p)[cells[:, column] == name].sum() == pytest.approx(share * 0.3 * tokens.sum(), rel=1e-6)


def test_scarce_categories_stay_whole():
    cells = np.array([("a", "x", "p"), ("b", "x", "p")])
    p = mixing.rake(cells, np.array([10.0, 1000.0]), [{"a": 0.5, "b": 0.5}, {"x": 1.0}, {"p": 1.0}], 0.5)
    assert p[0] == 1.0
    assert 0 < p[1] < 1


def test_edges(edge, edge_rows):
    rows = mixing.mixing_probabilities(edge).collect()
    assert len(rows) == len(edge_rows)
    assert all(0 <= r.mix_probability <= 1 for r in rows)
    assert {r.mix_tokens for r in rows if not (r.text or "").split()} == {1}
    assert all(r.mix_tokens == len(r.text.split()) for r in rows if (r.text or "").split() and " " not in r.text)
    assert all(r.mix_source == (r.source or "") for r in rows)
    again = {(r.doc_id, r.text): r.mix_kept for r in rows}
    assert all(again[r.doc_id, r.text] == r.mix_kept for r in rows)


def test_given_targets_leave_categories_out(edge):
    kept = mixing.mix(edge, targets={"lang": {"en": 1.0}}, budget=0.9)
    assert kept.columns == edge.columns
    assert {r.lang for r in kept.select("lang").collect()} <= {"en"}


def test_empty(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(empty, max_cells=0).count() == 0


@pytest.mark.parametrize("options", [{}, {"budget": 0.4, "targets": {"source": {"a": 3.0, "b": 1.0}}}, {"weights": {"lang": {"x": 0.7}}}])
def test_more_cells_than_the_driver_takes(spark, options, monkeypatch):
    monkeypatch.setattr(mixing, "STEPS", 2)
    rows = [(i, "w " * (20 + 7 * i % 50), "ab"[i % 2], "xy"[i // 2 % 2]) for i in range(24)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").coalesce(1)
    chance = lambda **more: {r.doc_id: (r.mix_probability, r.mix_kept) for r in mixing.mixing_probabilities(frame, **options, **more).collect()}
    driver, table = chance(), chance(max_cells=2)
    assert driver.keys() == table.keys() and len(driver) == len(rows)
    assert max(abs(driver[k][0] - table[k][0]) for k in driver) < 1e-4
    if not options:
        report = lambda **more: sorted((r.marginal, r.category, r.tokens, round(r.kept_tokens, 3)) for r in mixing.mixing_report(frame, **more).collect())
        assert report() == report(max_cells=2)


def test_shares_on_the_tables(spark, sf_dir):
    rows = mixing.mixing_probabilities(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    total = sum(r.mix_tokens for r in rows)
    expected = sum(r.mix_tokens * r.mix_probability for r in rows)
    drawn = sum(r.mix_tokens for r in rows if r.mix_kept)
    # Shares that are those of the corpus are met by the corpus.
    assert expected == pytest.approx(total)
    assert drawn == total
    weighted = mixing.mixing_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), weights={"lang": {"en": 0.5}}).collect()
    langs = {r.category: r for r in weighted if r.marginal == "lang"}
    kept = {k: r.kept_tokens / r.tokens for k, r in langs.items()}
    # Half of the corpus' share for one language, by its tokens against each other's.
    assert all(kept["en"] / kept[k] == pytest.approx(0.5, rel=0.01) for k in kept if k != "en")


def test_nothing_is_dropped_that_no_weight_asks_for(edge):
    assert mixing.mix(edge).count() == edge.count()


def test_the_largest_sample_that_meets_the_weights():
    rng = np.random.default_rng(4)
    cells = np.array([(s, l, t) for s in "abcd" for l in "xy" for t in "pq"])
    tokens = rng.integers(100, 1000, len(cells)).astype(float)
    weights = [None, {"x": 0.5}, {"p": 0.8}]
    targets = [mixing.shares(cells[:, i], tokens, 1.0, None, w) for i, w in enumerate(weights)]
    p = mixing.rake_most(cells, tokens, targets)
    assert p.max() <= 1
    assert max(g.max() for g in mixing.gaps(cells, tokens, targets, p)) <= 2 * mixing.TOLERANCE
    # A twentieth more cannot be had without missing a share.
    more = mixing.rake(cells, tokens, targets, 1.05 * (tokens * p).sum() / tokens.sum())
    assert max(g.max() for g in mixing.gaps(cells, tokens, targets, more)) > 2 * mixing.TOLERANCE


def test_report_on_the_tables(spark, sf_dir):
    from folioscope.llm.catalog import MIX_WEIGHTS

    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.mixing_report(documents, weights=MIX_WEIGHTS).collect()
    assert {r.marginal for r in rows} == {"source", "lang", "topic"}
    assert max(r.gap for r in rows) <= 2 * mixing.TOLERANCE
    langs = [r for r in rows if r.marginal == "lang"]
    assert sum(r.kept_tokens for r in langs) / sum(r.tokens for r in langs) > 0.7
    missed = mixing.mixing_report(documents, flatten=0.5, budget=0.5).collect()
    assert max(r.gap for r in missed if r.marginal == "topic") > 0.1
