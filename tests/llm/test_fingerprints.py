import hashlib

from pyspark.sql import functions as F

from folioscope.llm import fingerprints


def order(row):
    return (row[0] is not None, row[0] or 0, row[1] or "")


def test_edited_texts(edge, edge_rows):
    rows = sorted(((r[0], r[1] or "") for r in edge_rows), key=order)
    wanted = []
    for i, (key, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        cut = len(text) // 4
        edited = text[: len(text) - cut] + after[:cut]
        wanted.append((key, len(text), hashlib.sha256(edited.encode()).hexdigest()))
    for block_rows in (2000, 3, 1):
        found = fingerprints.fingerprint_documents(edge, block_rows=block_rows).collect()
        assert sorted(((r.row_id, r.n_chars, r.edited_sha256) for r in found), key=repr) == sorted(wanted, key=repr)
        assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)
    by_text = {}
    for r in found:
        by_text.setdefault(r.row_id, set()).add(r.fingerprint)
    assert len(by_text[12]) == 2


def tree(spark, *texts):
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.f for r in fingerprints.with_fingerprint(frame, "t", "f").orderBy("i").collect()]


def test_edits_are_located(spark):
    lines = [f"Line {i} has words. And more of them number {i * 7}!" for i in range(60)]
    changed = [*lines]
    changed[30] = "Something else."
    a, b, same = tree(spark, "\n".join(lines), "\n".join(changed), "\n".join(lines))
    assert a == same != b
    frame = spark.createDataFrame([(a, b)], "a string, b string")
    row = fingerprints.with_likeness(frame, "a", "b", "near").select("near", fingerprints.changed_sections(F.col("a"), F.col("b")).alias("where")).first()
    assert 0.9 < row.near < 1
    # The section of the changed paragraph, and the next if the change moved their border.
    assert 1 <= len(row.where) <= 2


def test_empty_and_single(spark, empty):
    assert fingerprints.fingerprint_documents(empty).count() == 0
    row = fingerprints.fingerprint_documents(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).first()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest()
    assert row.near_next == 1.0
