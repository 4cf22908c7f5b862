import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope.operators.lists import InvertedLists
from folioscope.operators.search import top_k
from folioscope.session import fresh_folder

from .test_search import SCHEMA


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(6, 12)) * 3
    points = [(f"p{i:04d}", (centres[i % 6] + rng.normal(size=12)).tolist()) for i in range(900)]
    points += [(f"hot{i:03d}", centres[0].tolist()) for i in range(400)] + [("zero", [0.0] * 12)]
    questions = [(i, (centres[i % 6] + rng.normal(size=12)).tolist()) for i in range(40)] + [(40, centres[0].tolist()), (41, [0.0] * 12)]
    p = spark.createDataFrame(points, SCHEMA).repartition(5)
    q = spark.createDataFrame(questions, "question_id int, vector array<float>")
    return p, q, InvertedLists.build(p, fresh_folder(spark, "test-lists"), lists=6)


def rows(frame):
    return sorted((r["question_id"], r["rank"], r["id"], round(r["score"], 9)) for r in frame.collect())


@pytest.mark.parametrize("split_bytes", [1 << 26, 2000])
def test_all_lists_are_the_exact_search(clustered, split_bytes):
    points, questions, index = clustered
    assert rows(index.top_k(questions, 7, probes=6, split_bytes=split_bytes)) == rows(top_k(questions, points, 7))


def test_few_lists_are_enough_where_points_have_clusters(clustered):
    points, questions, index = clustered
    exact = {r[:1] + r[2:3] for r in rows(top_k(questions.where("question_id < 41"), points, 5))}
    near = {r[:1] + r[2:3] for r in rows(index.top_k(questions.where("question_id < 41"), 5, probes=1))}
    assert len(exact & near) >= 0.9 * len(exact)
    # Folders of lists that no question asks for are not read.
    one = questions.where("question_id = 40")
    assert index.top_k(one, 5, probes=1).count() == 5


def test_every_point_is_indexed_from_a_small_sample(spark, clustered):
    points, questions, _ = clustered
    index = InvertedLists.build(points, fresh_folder(spark, "test-lists"), lists=3, sample_rows=10)
    assert index.points().count() == 1301 and len(index.centroids) <= 3
    assert rows(index.top_k(questions, 3, probes=3)) == rows(top_k(questions, points, 3))


def test_no_points_and_no_questions(spark, clustered):
    points, questions, index = clustered
    assert index.top_k(questions.where(F.lit(False)), 5).count() == 0
    empty = InvertedLists.build(points.where(F.lit(False)), fresh_folder(spark, "test-lists"))
    assert empty.top_k(questions, 5).count() == 0
    same = InvertedLists.build(points.where("id like 'hot%'"), fresh_folder(spark, "test-lists"))
    assert same.top_k(questions, 2).where("question_id = 40").count() == 2
    with pytest.raises(ValueError, match="does not have 12 elements"):
        InvertedLists.build(points.unionAll(spark.createDataFrame([("x", [1.0])], SCHEMA)), fresh_folder(spark, "test-lists"))
