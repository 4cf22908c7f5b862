import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators import search
from folioscope.operators.search import top_k
from folioscope.operators.splits import packed
from folioscope.session import stored

SCHEMA = "id string, vector array<float>"


def brute_force(questions, points, k):
    expected = []
    for question, vector in questions:
        scored = []
        for name, other in points:
            a, b = np.asarray(vector, dtype=np.float32).astype(float), np.asarray(other, dtype=np.float32).astype(float)
            norm = np.linalg.norm(a) * np.linalg.norm(b)
            scored.append((-round(float(a @ b / norm) if norm else 0.0, 10), name))
        expected += [(question, rank, name, -score) for rank, (score, name) in enumerate(sorted(scored)[:k], 1)]
    return sorted(expected)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 6)).round(3)
    points = [(f"p{i:03d}", base[i % 60].tolist()) for i in range(150)]  # copies tie
    points += [(f"hot{i:03d}", base[0].tolist()) for i in range(100)]  # one vector in 40 % of the rows
    points += [("zero", [0.0] * 6)]
    questions = [(i, rng.normal(size=6).round(3).tolist()) for i in range(9)]
    questions += [(9, base[0].tolist()), (10, [0.0] * 6)]
    return questions, points


@pytest.mark.parametrize("k", [1, 5, 25, 300])
@pytest.mark.parametrize("split_bytes", [1 << 28, 200])
def test_top_k_is_exact_with_ties_and_in_splits(spark, data, k, split_bytes):
    questions, points = data
    q = spark.createDataFrame(questions, "question_id int, vector array<float>")
    p = spark.createDataFrame(points, SCHEMA).repartition(7)
    got = top_k(q, p, k, split_bytes=split_bytes).collect()
    rows = sorted((r["question_id"], r["rank"], r["id"], r["score"]) for r in got)
    expected = brute_force(questions, points, k)
    assert [r[:3] for r in rows] == [e[:3] for e in expected]
    assert np.allclose([r[3] for r in rows], [e[3] for e in expected], atol=1e-9)


def test_fewer_points_than_k_and_no_points(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vector array<float>")
    p = spark.createDataFrame([("a", [1.0, 1.0])], SCHEMA)
    assert [r["id"] for r in top_k(q, p, 5).collect()] == ["a"]
    assert top_k(q, p.where(F.lit(False)), 5).count() == 0
    assert top_k(q.where(F.lit(False)), p, 5).count() == 0


@pytest.mark.parametrize("sizes", [[3], [1, 3], [2, 0], [2, None]])
def test_other_vector_sizes_fail(spark, sizes):
    q = spark.createDataFrame([(1, [1.0, 0.0])], "question_id int, vector array<float>")
    rows = [(f"p{i}", None if n is None else [1.0] * n) for i, n in enumerate(sizes)]
    with pytest.raises(Exception, match="does not have 2 elements"):
        top_k(q, spark.createDataFrame(rows, SCHEMA).coalesce(1), 5).collect()


def test_questions_of_different_sizes_fail(spark):
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0] * 4)], "question_id int, vector array<float>")
    with pytest.raises(ValueError, match="does not have 4 elements"):
        top_k(q, spark.createDataFrame([("a", [1.0] * 3)], SCHEMA), 5)


def test_bad_arguments(spark):
    q = spark.createDataFrame([(1, [1.0])], "question_id int, vector array<float>")
    p = spark.createDataFrame([("a", [1.0])], SCHEMA)
    with pytest.raises(ValueError):
        top_k(q, p, 0)
    with pytest.raises(ValueError):
        top_k(q, p, 1, question_id="id", point_id="id")


def test_payload_is_not_shuffled(spark, data, capsys):
    questions, points = data
    q = spark.createDataFrame(questions, "question_id int, vector array<float>")
    p = spark.createDataFrame(points, SCHEMA).withColumn("text", F.repeat("id", 100))
    hits = stored(top_k(q, p, 5), "hits")
    hits.join(p.select("id", "text"), "id").explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    # The written hits are known to be small, so the join needs no exchange of either side.
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_questions_in_many_blocks(spark):
    rng = np.random.default_rng(7)
    points = [(f"p{i:04d}", rng.normal(size=4).round(1).tolist()) for i in range(500)]
    questions = [(i, rng.normal(size=4).round(1).tolist()) for i in range(200)]
    q = spark.createDataFrame(questions, "question_id int, vector array<float>").repartition(11)
    p = spark.createDataFrame(points, SCHEMA).repartition(5)
    got = sorted((r["question_id"], r["rank"], r["id"]) for r in top_k(q, p, 3, split_bytes=640).collect())
    assert got == [e[:3] for e in brute_force(questions, points, 3)]


def test_blocks_are_cut_and_padded(spark):
    rows = spark.createDataFrame([(i, [float(i)] * (i % 3)) for i in range(10)], "id long, vector array<double>").coalesce(1)
    blocks = packed(rows, "vector", block_bytes=24).collect()
    assert sum(b["n"] for b in blocks) == 10 and len(blocks) > 2
    assert sorted(i for b in blocks for i in b["id"]) == list(range(10))
    for b in blocks:
        matrix = np.frombuffer(b["vectors"]).reshape(b["n"], b["most"])
        for i, row in zip(b["id"], matrix, strict=True):
            assert row.tolist() == ([float(i)] * (i % 3) + [0.0] * b["most"])[: b["most"]]


@pytest.mark.parametrize("split_bytes", [1 << 28, 200])
def test_groups_of_questions_give_the_same_hits_in_bounded_tasks(spark, data, split_bytes, monkeypatch):
    questions, points = data
    q = spark.createDataFrame(questions, "question_id int, vector array<float>").repartition(5)
    p = spark.createDataFrame(points, SCHEMA).repartition(7)
    rows = lambda: sorted(map(tuple, top_k(q, p, 5, split_bytes=split_bytes).collect()))
    whole = rows()
    assert [r[:3] for r in whole] == [e[:3] for e in brute_force(questions, points, 5)]
    monkeypatch.setattr(search, "_GROUP_HITS", 15)
    # Three questions a group; without groups there was one task for all questions of a split.
    groups, meet = [], search.meet
    monkeypatch.setattr(search, "meet", lambda *given: groups.append(given[-1]) or meet(*given))
    assert rows() == whole
    assert groups == [4]


def test_groups_do_not_multiply_what_is_moved(spark, data, monkeypatch, capsys):
    """Neither points nor questions are repeated before a shuffle, and a task tells ``k`` hits a question."""
    questions, points = data
    q = spark.createDataFrame(questions, "question_id int, vector array<float>").repartition(5)
    p = spark.createDataFrame(points, SCHEMA).repartition(7)
    monkeypatch.setattr(search, "_GROUP_HITS", 15)
    near = []
    monkeypatch.setattr(search, "dealt", lambda df, rows, *keys, **more: near.append((df, rows)) or df)
    got = top_k(q, p, 5, split_bytes=200)
    got.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" in plan and "Generate" not in plan
    told, bound = near[0]
    # Eight lanes for each of the four groups.
    assert bound == len(questions) * 5 * 8 and told.count() <= bound
    assert sorted(tuple(r)[:3] for r in got.collect()) == [e[:3] for e in brute_force(questions, points, 5)]


def test_groups_carry_columns_and_move_points_once(spark, data, monkeypatch, capsys):
    """Hits of many questions know their data file, and vectors are not sent to every group for that."""
    questions, points = data
    q = spark.createDataFrame(questions, "question_id int, vector array<float>").repartition(5)
    p = spark.createDataFrame([(i, v, f"file {int(i[-1]) % 4}" if i[-1].isdigit() else None) for i, v in points], SCHEMA + ", _file string").repartition(7)
    monkeypatch.setattr(search, "_GROUP_HITS", 15)
    got = top_k(q, p, 5, carried=("_file",), split_bytes=200)
    got.explain()
    assert "Generate" not in capsys.readouterr().out
    rows = got.collect()
    assert all(r["_file"] == (f"file {int(r['id'][-1]) % 4}" if r["id"][-1].isdigit() else None) for r in rows)
    assert sorted(tuple(r)[:3] for r in rows) == [e[:3] for e in brute_force(questions, points, 5)]


def test_short_products_lose_no_hit():
    """Scores that differ by less than 32-bit numbers tell are ranked by their 64-bit products."""
    rng = np.random.default_rng(5)
    base = rng.normal(size=40)
    points = search._unit_rows(base + rng.normal(size=(3000, 40)) * 1e-6)
    asked = search._unit_rows(base + rng.normal(size=(6, 40)) * 1e-6)
    ids = np.array([f"p{i:04d}" for i in rng.permutation(3000)], dtype=object)
    best = search._Best(np.full(6, -np.inf), 4, 4)
    for at in range(0, 3000, 100):
        part = slice(at, at + 100)
        best.offer(points[part], points[part].astype(np.float32), asked, asked.astype(np.float32), ids[part], np.arange(at, at + 100))
    best.prune()
    scores = np.round(points @ asked.T, search.SCORE_DECIMALS)
    for n in range(6):
        order = sorted(range(3000), key=lambda i: (-scores[i, n], ids[i]))[:4]
        assert [i for i, of in zip(best.id, best.question, strict=True) if of == n] == [ids[i] for i in order]
        assert [a for a, of in zip(best.at, best.question, strict=True) if of == n] == order


def test_packed_vectors_keep_their_type(spark):
    bytes_of = lambda kind: packed(spark.createDataFrame([("a", [0.1, 0.2])], f"ids string, vector array<{kind}>"), "vector").first()["vectors"]
    assert bytes(bytes_of("float")) == np.array([0.1, 0.2], np.float32).tobytes()
    assert bytes(bytes_of("double")) == np.array([0.1, 0.2]).tobytes()
