import pytest
from pyspark.sql import functions as F

from folioscope.models.hashing import HashingEmbedder
from folioscope.operators.files import new_files
from folioscope.plans.ingest import build_points, file_chunks, ingest
from folioscope.schemas import PAYLOAD
from folioscope.session import fresh_folder
from folioscope.sources.files import (
    file_text,
    pdf_parser,
    python_parser,
    read_questions,
    scan_folder,
    stream_folder,
    text_parser,
)
from folioscope.sources.index import Collection, collection_report, keep_latest, sample_files
from folioscope.streaming.ingest import start_ingest

FILES = {
    "A.PDF": "first page\fsecond page, with more words",
    "b.pdf": " \n \f \ftext on page three",
    "copy.pdf": "first page\fsecond page, with more words",
    "empty.pdf": "",  # Spark lists no files of zero bytes
    "blank.pdf": " \f\n",
    "c.txt": "not a match",
}


@pytest.fixture
def folder(tmp_path):
    for name, text in FILES.items():
        (tmp_path / name).write_bytes(text.encode())
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_text("in a subfolder")
    return str(tmp_path)


def collection(spark, size=16):
    return Collection(spark, fresh_folder(spark, "test-ingest"), vector_size=size)


def content(c):
    return sorted(
        (r["payload"]["file_name"], r["payload"]["page_number"], r["payload"]["text"], r["id"], len(r["vector"]))
        for r in c.points().collect()
    )


def test_scan_takes_the_suffix_in_any_case_and_no_subfolders(spark, folder):
    names = {r["file_name"] for r in scan_folder(spark, folder).select("file_name").collect()}
    assert names == {"A.PDF", "b.pdf", "copy.pdf", "blank.pdf"}


def test_ingest_once_per_content(spark, folder):
    c = collection(spark)
    report = {r["file_name"]: r for r in ingest(scan_folder(spark, folder), c, text_parser).collect()}
    # copy.pdf is the later copy of A.PDF
    assert set(report) == {"A.PDF", "b.pdf", "blank.pdf"}
    assert report["A.PDF"]["n_chunks"] == 2 and report["A.PDF"]["min_length"] == 10
    assert report["blank.pdf"]["n_chunks"] == 0 and report["blank.pdf"]["median_length"] is None
    got = content(c)
    assert [g[:3] for g in got] == [
        ("A.PDF", "1", "first page"),
        ("A.PDF", "2", "second page, with more words"),
        ("b.pdf", "3", "text on page three"),
    ]
    assert all(g[4] == 16 for g in got)
    assert ingest(scan_folder(spark, folder), c, text_parser).count() == 0
    assert content(c) == got
    assert c.files().count() == 3 and c.last_ingest() == 1


def test_later_files_are_added(spark, folder, tmp_path):
    c = collection(spark)
    ingest(scan_folder(spark, folder), c, text_parser)
    (tmp_path / "new.pdf").write_text("fresh words")
    (tmp_path / "again.pdf").write_text(FILES["b.pdf"])
    report = ingest(scan_folder(spark, folder), c, text_parser).collect()
    assert [r["file_name"] for r in report] == ["new.pdf"]
    assert c.last_ingest() == 2 and c.points().count() == 4


def test_a_died_ingest_is_invisible_and_then_replaced(spark, folder):
    c, whole = collection(spark), collection(spark)
    ingest(scan_folder(spark, folder), whole, text_parser)

    class Dying(Collection):
        def finish(self, *args):
            raise RuntimeError("lost before the ledger was written")

    with pytest.raises(RuntimeError):
        ingest(scan_folder(spark, folder), Dying(spark, c.path, c.name, c.vector_size), text_parser)
    assert c.points().count() == 0 and c.last_ingest() == 0
    ingest(scan_folder(spark, folder), c, text_parser)
    assert content(c) == content(whole)


def test_a_ledger_without_commit_does_not_count(spark, folder):
    c = collection(spark)
    ingest(scan_folder(spark, folder), c, text_parser)
    before = content(c)
    half = c.files().limit(1).drop("ingest").withColumn("file_hash", F.lit("f" * 64))
    half.write.parquet(f"{c._table('files')}/ingest=2")
    assert c.files().count() == 3 and not c.contains_file("f" * 64)
    assert ingest(scan_folder(spark, folder), c, text_parser).count() == 0
    assert content(c) == before


def test_whole_documents_as_units(spark, folder):
    files = scan_folder(spark, folder).withColumn("file_hash", F.sha2("content", 256))
    chunks = file_chunks(files, text_parser, granularity="document").where(F.col("file_name") == "A.PDF").collect()
    assert [(r["text"], r["page_number"]) for r in chunks] == [("first pagesecond page, with more words", None)]
    with pytest.raises(ValueError):
        file_chunks(files, text_parser, granularity="chapter")


def test_python_parser_and_metadata(spark, folder):
    calls = spark.sparkContext.accumulator(0)

    def parse(data):
        calls.add(1)
        return data.decode().split("\f"), {"title": "T", "creationDate": "D:2015"}

    files = scan_folder(spark, folder).withColumn("file_hash", F.sha2("content", 256))
    points = build_points(file_chunks(files, python_parser(parse)), lambda: HashingEmbedder(8)).collect()
    assert len(points) == 5
    assert {(p["payload"]["file_title"], p["payload"]["authors"], p["payload"]["creation_date"]) for p in points} == {
        ("T", None, "D:2015")
    }
    assert calls.value == 4  # every file was parsed once


def test_pdf_without_library_says_so(spark, folder):
    with pytest.raises(Exception, match="pymupdf"):
        file_text(scan_folder(spark, folder), pdf_parser).collect()


def test_pages_join_without_separator(spark, folder):
    texts = {r["file_name"]: r["text"] for r in file_text(scan_folder(spark, folder), text_parser).collect()}
    assert texts["A.PDF"] == "first pagesecond page, with more words"


def test_stream_equals_batch(spark, folder, tmp_path):
    batch, streamed = collection(spark), collection(spark)
    ingest(scan_folder(spark, folder), batch, text_parser)
    checkpoint = fresh_folder(spark, "checkpoint")
    start_ingest(stream_folder(spark, folder), streamed, text_parser, checkpoint).awaitTermination()
    assert content(streamed) == content(batch)
    start_ingest(stream_folder(spark, folder), streamed, text_parser, checkpoint).awaitTermination()
    assert content(streamed) == content(batch)
    (tmp_path / "late.pdf").write_text("arrived late")
    start_ingest(stream_folder(spark, folder), streamed, text_parser, checkpoint).awaitTermination()
    assert streamed.points().count() == batch.points().count() + 1


def test_collection_checks(spark, folder):
    c = collection(spark)
    assert not c.exists()
    with pytest.raises(ValueError, match="does not exist"):
        c.require()
    assert c.points().count() == 0
    c.properties().write.parquet(c._table("properties"))  # a creation that died: a folder without the row
    assert not c.exists()
    c.create_if_absent().create_if_absent()
    assert c.require().properties().collect()[0].asDict() == {
        "collection": c.name, "vector_size": 16, "metric": "cosine"
    }
    ingest(scan_folder(spark, folder), c, text_parser)
    with pytest.raises(ValueError, match="vectors of size 16"):
        Collection(spark, c.path, c.name, 32).require()
    known = c.files().first()["file_hash"]
    assert c.contains_file(known) and not c.contains_file("0" * 64)


def test_scroll_filter_is_pushed_down(spark, folder, capsys):
    c = collection(spark)
    ingest(scan_folder(spark, folder), c, text_parser)
    spark.conf.set("spark.sql.maxMetadataStringLength", 1000)
    found = c.scroll({"file_name": "A.PDF", "page_number": "2"})
    assert [r["payload"]["text"] for r in found.collect()] == ["second page, with more words"]
    assert c.scroll(limit=2).count() == 2
    found.explain()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    plan = capsys.readouterr().out
    assert "LessThanOrEqual(id," in plan and "EqualTo(payload.file_name,A.PDF)" in plan and "TakeOrderedAndProject" in plan


def test_only_the_files_of_the_hits_are_read(spark, folder):
    c = collection(spark)
    ingest(scan_folder(spark, folder), c, text_parser)
    wanted = c.located_points().orderBy("id").limit(1).select("id", "_file")
    found = c.points_in(wanted)
    assert found.join(wanted, "id").count() == 1
    assert len(found.inputFiles()) == 1
    assert sorted(c.points_in(c.located_points()).inputFiles()) == sorted(c.points().inputFiles())
    assert c.points_in(wanted.where(F.lit(False))).count() == 0


def test_files_in_a_folder_with_odd_characters(spark, folder, tmp_path):
    c = Collection(spark, str(tmp_path / "100% of ü"), "my docs", vector_size=16)
    ingest(scan_folder(spark, folder), c, text_parser)
    wanted = c.located_points()
    assert c.points_in(wanted).join(wanted, "id").count() == 3
    assert c.scroll({"page_number": "1"}, limit=5).count() == c.points().where("payload.page_number = '1'").count() > 0
    assert c.scroll(limit=5).count() == 3
    c.upsert(c.points().limit(1).withColumn("payload", F.col("payload").withField("keywords", F.lit("new"))))
    assert c.points().count() == 3 and c.has({"keywords": "new"})


@pytest.fixture
def several_files(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def many_points(spark, n):
    return spark.range(n).selectExpr(
        "format_string('%05d', id) AS id", "array_repeat(float(id), 16) AS vector",
        f"named_struct('file_name', 'f' || id % 7, 'file_hash', 'h' || id % 7, 'file_title', null, 'authors', if(id % 2 = 0, 'even', null), 'keywords', null, "
        "'creation_date', null, 'page_number', string(id div 100), 'text', 'text ' || id, 'summary', '') AS payload",
    ).select("id", "vector", F.col("payload").cast(PAYLOAD).alias("payload"))


def test_upsert_is_seen_and_earlier_commits_stay(spark, several_files):
    c = collection(spark).create_if_absent()
    first = c.upsert(many_points(spark, 300).repartition(4))
    before = sorted(map(str, c.points().collect()))
    new = many_points(spark, 320).where("id in ('00010', '00310', '00319')").withColumn("payload", F.col("payload").withField("keywords", F.lit("changed")))
    older = new.withColumn("payload", F.col("payload").withField("keywords", F.lit("stale")))
    arrived = older.withColumn("v", F.lit(1)).unionAll(new.withColumn("v", F.lit(2))).unionAll(new.withColumn("v", F.lit(0)))
    files = set(c.points().inputFiles())
    second = c.upsert(arrived, F.col("v"))
    assert (first, second) == (1, 2)
    rows = {r["id"]: r["payload"]["keywords"] for r in c.points().collect()}
    assert len(rows) == 302 and {i for i, k in rows.items() if k} == {"00010", "00310", "00319"} and rows["00010"] == "changed"
    assert sorted(map(str, c.points(version=1).collect())) == before
    # Only the file of the replaced point was copied.
    assert c._read("removed", "file string, ingest int").count() == 1 and len(files) > 4
    assert c.entries().where("field = '*'").agg(F.sum("n")).first()[0] == 302
    assert c.has({"keywords": "changed"}) and not c.has({"keywords": "changed"}, version=1) and not c.has({"keywords": "stale"})
    assert c.files().count() == 0 and c.last_ingest() == 2


def test_a_died_upsert_is_invisible_and_then_replaced(spark, folder):
    c = collection(spark).create_if_absent()
    c.upsert(many_points(spark, 50))

    class Dying(Collection):
        def _commit(self, *args):
            raise RuntimeError("lost before the commit")

    with pytest.raises(RuntimeError):
        Dying(spark, c.path, c.name, c.vector_size).upsert(many_points(spark, 60))
    assert c.points().count() == 50
    # An ingest takes the same number; what the upsert had removed is not looked at.
    ingest(scan_folder(spark, folder), c, text_parser)
    assert c.last_ingest() == 2 and c.points().count() == 53 and c.files().count() == 3


def test_scroll_walks_all_pages(spark, several_files):
    c = collection(spark).create_if_absent()
    c.upsert(many_points(spark, 200).repartition(5))
    c.upsert(many_points(spark, 230).where("id >= 190"))
    for terms, expected in [(None, 230), ({"file_name": "f3"}, 33), ({"file_name": "f3", "authors": "even"}, 16), ({"authors": "odd"}, 0)]:
        walked, after = [], None
        while page := [r["id"] for r in c.scroll(terms, 20, after).collect()]:
            assert len(page) <= 20
            walked += page
            after = page[-1]
        assert walked == sorted(set(walked)) and len(walked) == expected
    pages = c.pages(20).orderBy("page").collect()
    assert [p["n"] for p in pages] == [20] * 11 + [10]
    assert [r["id"] for r in c.scroll(None, 20, pages[3]["last_id"]).collect()][0] == pages[4]["first_id"]
    # The first page lies in one data file.
    assert len(c.scroll(limit=5).inputFiles()) == 1


def test_payload_index_intersects_files(spark, several_files):
    c = collection(spark).create_if_absent()
    c.upsert(many_points(spark, 400).repartition(4))
    every = c.files_with().count()
    assert c.files_with({"page_number": "1"}).count() < every and c.files_with({"file_name": "f1"}).count() == every > 4
    assert c.files_with({"page_number": "1", "file_name": "f1"}).count() == c.files_with({"page_number": "1"}).count()
    assert c.files_with({"page_number": "9"}).count() == 0 and not c.has({"page_number": "9"})
    assert c.has({"page_number": "1", "file_name": "f1"}) and not c.has({"file_hash": "h1", "file_name": "f2"})
    with pytest.raises(ValueError, match="no payload index"):
        c.files_with({"text": "x"})


def test_wrong_vector_size_is_refused(spark, folder):
    c = collection(spark, size=16)
    with pytest.raises(Exception, match="vector size is not 16"):
        ingest(scan_folder(spark, folder), c, text_parser, make_embedder=lambda: HashingEmbedder(8))
    assert c.points().count() == 0


def test_upsert_keeps_the_incoming_rows(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    new = spark.createDataFrame([("b", 3), ("c", 4)], "id string, v int")
    assert sorted(map(tuple, keep_latest(old, new).collect())) == [("a", 1), ("b", 3), ("c", 4)]


def test_reports(spark):
    points = spark.createDataFrame([(f"{i:04d}", (f"f{i % 7}",)) for i in range(1200)], "id string, payload struct<file_name:string>")
    assert tuple(collection_report(points).first()) == (1200, "1,200")
    assert tuple(sample_files(points).first()) == ("f0, f1, f2, f3, f4", 2)


def test_questions_under_either_key(spark, tmp_path):
    from folioscope.operators.evaluation import ground_truth

    path = tmp_path / "qa.json"
    path.write_text('[{"question": "q1?", "ground_truth": "é"},\n {"question": "q2?", "answer": "b", "extra": 1}]', encoding="utf-8")
    items = ground_truth(read_questions(spark, str(path)))
    assert sorted(map(tuple, items.collect())) == [("q1?", "é"), ("q2?", "b")]
    with pytest.raises(ValueError):
        ground_truth(items.select("question"))


def test_copies_are_reduced_before_the_ledger_join(spark, capsys):
    hashed = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"h{i}") for i in range(90)], "path int, file_hash string")
    indexed = spark.createDataFrame([("h1",), ("h1",), ("h2",)], "file_hash string")
    found = new_files(hashed, indexed)
    rows = {r["file_hash"]: (r["path"], r["n_copies"]) for r in found.collect()}
    assert rows["hot"] == (0, 30) and "h1" not in rows and len(rows) == 59
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new_files(hashed, indexed).explain()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    left = capsys.readouterr().out.split("SortMergeJoin")[1]
    assert left.index("HashAggregate") < left.index("Exchange")


def test_upsert_keeps_the_latest_of_repeated_rows(spark):
    from pyspark.sql import functions as F

    old = spark.createDataFrame([("a", 1, 0), ("b", 2, 0)], "id string, v int, at int")
    new = spark.createDataFrame([("b", 9, 1), ("b", 3, 2), ("c", 4, 1), ("c", 4, 1)], "id string, v int, at int")
    assert sorted(map(tuple, keep_latest(old, new, version=F.col("at")).collect())) == [("a", 1, 0), ("b", 3, 2), ("c", 4, 1)]
    assert sorted(map(tuple, keep_latest(old, new).collect())) == [("a", 1, 0), ("b", 9, 1), ("c", 4, 1)]


def test_an_upsert_moves_the_points_once(spark, several_files):
    c, plans = collection(spark).create_if_absent(), []

    class Seen(Collection):
        def write_points(self, points, ingest):
            plans.append(points._jdf.queryExecution().executedPlan().toString())
            return super().write_points(points, ingest)

    c.upsert(many_points(spark, 60).repartition(3))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        twice = many_points(spark, 70).where("id >= 30")
        Seen(spark, c.path, c.name, c.vector_size).upsert(twice.unionAll(twice))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plans[0].count("Exchange") == 1 and "Join" not in plans[0]
    ids = [r["id"] for r in c.points().select("id").collect()]
    assert len(ids) == len(set(ids)) and {r["id"] for r in many_points(spark, 70).collect()} <= set(ids)
    assert "max_by" not in keep_latest(twice, twice)._jdf.queryExecution().executedPlan().toString()
