import corpus_pipeline as P
from folioscope.llm import catalog


def tables(spark, folder, documents, labels):
    documents.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, left = docs.columns, docs.count()
    sizes = []
    for _, stage in P.STAGES[:-1]:
        docs = P.stored(stage(spark, docs, sf_dir), "test-stage")
        assert docs.columns == columns
        sizes.append(docs.count())
    assert left > sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    pieces = P.STAGES[-1][1](spark, docs, sf_dir)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_agree_with_the_queries(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = lambda frame: sorted(r.doc_id for r in frame.select("doc_id").collect())
    assert ids(P.quality(spark, docs, sf_dir)) == ids(catalog.op1_quality(spark, sf_dir).where("predicted = 1"))
    assert ids(P.exact_copies(spark, docs, sf_dir)) == ids(catalog.op7_exact_dedup(spark, sf_dir).where("kept"))
    assert ids(P.near_copies(spark, docs, sf_dir)) == ids(catalog.op6_jaccard_join(spark, sf_dir).where("component_id = doc_id"))
    assert ids(P.mixing(spark, docs, sf_dir)) == ids(catalog.op9_mixing(spark, sf_dir).where("mix_kept"))


def test_edges_and_empty(spark, edge, empty, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (4, 0, 0), (None, None, None)], "doc_id long, quality int, toxic int")
    for name, frame in (("edge", edge), ("empty", empty)):
        rows = P.run(spark, tables(spark, tmp_path / name, frame, labels))
        assert (rows.count() > 0) == (name == "edge")


def test_texts_are_not_moved_to_the_labels(spark, monkeypatch):
    from pyspark.sql import functions as F

    from folioscope.llm import quality

    plans = []

    def fit(vectors, *args, whole=quality.fit_discriminant):
        plans.append(vectors._jdf.queryExecution().optimizedPlan().toString())
        return whole(vectors, *args)

    monkeypatch.setattr(quality, "fit_discriminant", fit)
    docs = spark.createDataFrame([(i, "plain words in a row. " * (3 + i) if i % 2 else "!!! $$$ " * (1 + i)) for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(10)], "doc_id long, quality int")
    kept = quality.keep_good(docs, labels, F.col("doc_id") < 8)
    assert kept.columns == ["doc_id", "text"]
    assert len(plans) == 1 and "Join" not in plans[0]
