"""Every registered query against its SQL on the smallest tables."""

import importlib
import os

import duckdb
import pytest

from catalog.oracles import oracles
from catalog.queries import registry

entry_module = importlib.import_module("__spark_entry__")
QUERIES = registry()
SQL = oracles()


@pytest.fixture(scope="module")
def connection():
    from tests.conftest import SF_DIR

    if not os.path.isdir(SF_DIR):
        pytest.skip("no test data")
    con = duckdb.connect()
    for file in os.listdir(SF_DIR):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{SF_DIR}/{file}'")
    return con


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, connection, sf_dir, name):
    frame = QUERIES[name](spark, sf_dir)
    columns = sorted(frame.columns)
    expected = connection.execute(SQL[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    right = sorted((tuple(row[i] for i in order) for row in expected.fetchall()), key=repr)
    left = sorted((tuple(row[c] for c in columns) for row in frame.collect()), key=repr)
    assert left == right
    assert left


def test_entry(spark, sf_dir):
    frame = entry_module.entry(spark)
    assert frame.count() > 0


def _in_parts(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{folder}/{name}.parquet")


def test_streams_read_tables_of_several_files(spark, tmp_path):
    said = [(i, t, "user", f"m{i}-{t}") for i in range(4) for t in range(5)] + [(1, None, "user", "somewhere"), (None, 0, "user", "nobody")]
    _in_parts(spark, tmp_path, "conversations", said, "conv_id long, turn long, role string, text string")
    _in_parts(spark, tmp_path, "conversations.parquet.old", [(99, 0, "user", "other")], "conv_id long, turn long, role string, text string")
    told = QUERIES["stream_history"](spark, str(tmp_path))
    assert sorted(map(tuple, told.collect()), key=repr) == sorted(map(tuple, QUERIES["history_window"](spark, str(tmp_path)).collect()), key=repr)
    assert told.count() == len(said)
    texts = [(i, f"text {i}", "en", "a", 6) for i in range(9)]
    _in_parts(spark, tmp_path, "documents", texts, "doc_id long, text string, lang string, source string, n_chars long")
    assert QUERIES["stream_ingest"](spark, str(tmp_path)).count() == len(texts)
