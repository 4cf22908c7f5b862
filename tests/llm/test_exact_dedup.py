import hashlib
from collections import defaultdict

from folioscope.llm import exact_dedup


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def expected(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[lower(text)].append(key)
    out = []
    for text, keys in groups.items():
        known = [k for k in keys if k is not None]
        best = max(known) if known else None
        out += [(k, best, len(keys), hashlib.sha256(text.encode()).hexdigest()) for k in keys]
    return sorted(out, key=repr)


def check(frame, rows):
    found = frame.collect()
    assert sorted(((r.row_id, r.keep_id, r.group_size, r.digest.hex()) for r in found), key=repr) == expected(rows)
    stays = [r for r in found if r.kept]
    assert len(stays) == len({r.digest for r in found}) == len({r.digest for r in stays})
    assert all(r.row_id == r.keep_id for r in stays)


def test_edges_and_recursion(edge, edge_rows):
    rows = [(r[0], r[1]) for r in edge_rows]
    check(exact_dedup.duplicate_groups(edge), rows)
    # A table of one text forces several levels of spilling.
    check(exact_dedup.duplicate_groups(edge, table_bytes=1), rows)


def test_drop_copies_keeps_columns(edge, edge_rows):
    kept = exact_dedup.drop_copies(edge)
    assert kept.columns == edge.columns
    assert kept.count() == len({lower(r[1]) for r in edge_rows})


def test_empty(empty):
    assert exact_dedup.duplicate_groups(empty).count() == 0
    assert exact_dedup.drop_copies(empty).count() == 0


def test_table_grows_and_compares_content():
    table = exact_dedup.ContentTable(1 << 30)
    for i in range(3000):
        assert table.add(hashlib.sha256(b"%d" % (i % 2000)).digest(), b"%d" % (i % 2000), 1, i, 1)
    assert len(table.contents) == 2000
    assert [c for c in table.counts[:1000]] == [[2, 2000 + i, 1] for i in range(1000)]


def test_only_repeated_texts_are_compared(spark, monkeypatch):
    from folioscope.llm import exact_dedup as D

    rows = [(i, f"Text {i % 90}") for i in range(100)] + [(200, "tEXT 50"), (None, "text 51"), (201, None), (202, ""), (203, None), (203, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []

    def groups(documents, *args, whole=D.content_groups):
        sent.append(documents.count())
        return whole(documents, *args)

    monkeypatch.setattr(D, "content_groups", groups)
    best = {}
    for key, text in rows:
        name = (text or "").lower()
        best[name] = max(best.get(name, -1), -1 if key is None else key)
    found = [((r.text or "").lower(), -1 if r.doc_id is None else r.doc_id) for r in D.drop_copies(frame).collect()]
    assert sorted(found) == sorted(best.items())
    assert sent == [28]
    # With few bits texts without an equal are compared as well.
    monkeypatch.setattr(D, "with_repeated", lambda *args, whole=D.with_repeated: whole(*args, bits=8))
    found = [((r.text or "").lower(), -1 if r.doc_id is None else r.doc_id) for r in D.drop_copies(frame).collect()]
    assert sorted(found) == sorted(best.items())
    assert sent[1] > 28
