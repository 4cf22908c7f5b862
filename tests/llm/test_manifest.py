import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from folioscope.llm.catalog import QUERIES, SQL
from folioscope.llm.common import ascii_lower
from folioscope.llm.manifest import Parent, dataset_manifest, grow, leaf_hash, levels_of


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def up(nodes):
    return [sha("".join(nodes[i : i + 8])) for i in range(0, len(nodes), 8)]


def climb(nodes, at, value):
    """The top of a tree, the top with another value at one place, and the siblings passed."""
    siblings = ""
    while len(nodes) > 1:
        run = at // 8 * 8
        others = nodes[run : run + 8]
        changed = others[: at - run] + [value] + others[at - run + 1 :]
        siblings += "".join(others[: at - run] + others[at - run + 1 :])
        nodes, at, value = up(nodes), at // 8, sha("".join(changed))
    return nodes[0], value, siblings


def lower(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def brute_force(rows):
    """(doc_id, source, lang, n_chars, text) rows."""
    trees = defaultdict(list)
    for name, source, lang, n, text in rows:
        tampered = zlib.crc32(("" if name is None else str(name)).encode()) % 3 == 0
        trees[lang].append((name, leaf(name, source, lang, n, text), leaf(name, source, lang, n, lower(text) if tampered else text)))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for members in trees.values():
        members.sort(key=lambda m: (m[0] is not None, m[0] or 0, m[1]))
    subroots = []
    for lang in order:
        subroots.append(climb([m[1] for m in trees[lang]], 0, "")[0])
    found = Counter()
    for at, lang in enumerate(order):
        nodes = [m[1] for m in trees[lang]]
        for place, (name, own, changed) in enumerate(trees[lang]):
            subroot, folded, siblings = climb(nodes, place, changed)
            root, folded, more = climb(subroots, at, folded)
            found[(name, own, subroot, root, sha(siblings + more), folded, folded == root)] += 1
    return found


def manifest(frame):
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    tampered = F.when(F.crc32(name.cast("binary")) % 3 == 0, leaf_hash(*fields, ascii_lower(F.col("text"))))
    found = dataset_manifest(frame, leaf_hash(*fields, F.col("text")), tampered)
    columns = ["row_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", "proof"), 256), "folded_root", F.col("folded_root") == F.col("root")]
    return Counter(tuple(r) for r in found.select(*columns).collect())


def test_parents_resume_from_their_states():
    children = [sha(str(i)) for i in range(5)]
    parent = Parent(children)
    assert parent.digest == sha("".join(children))
    for slot in range(5):
        changed = children[:slot] + [sha("new")] + children[slot + 1 :]
        assert parent.fold(slot, sha("new").encode()).decode() == sha("".join(changed))
        assert parent.fold(slot, children[slot].encode()).decode() == parent.digest
        assert parent.siblings(slot) == "".join(children[:slot] + children[slot + 1 :])


@pytest.mark.parametrize("size,levels", [(1, 0), (2, 1), (8, 1), (9, 2), (64, 2), (65, 3), (4096, 4), (4097, 4), (10**9, 4)])
def test_levels(size, levels):
    assert levels_of(size) == levels
    assert len(grow([sha("x")] * min(size, 100), levels)) == levels


def test_edge_rows(spark, edge, edge_rows):
    rows = [(d, s, lang, None if t is None else len(t), t) for d, t, lang, s in edge_rows]
    for parts in (1, 5):
        assert manifest(edge.repartition(parts)) == brute_force(rows)


def test_two_rounds_and_many_languages(spark):
    """One language of more rows than a subtree has, and many of one row each."""
    rows = [(i, f"s{i % 3}", "en", i, f"Text {i}") for i in range(4096 + 8 * 8 * 8 + 1)]
    rows += [(i, None, f"l{i:03d}", None, "A" * (i % 5)) for i in range(70)]
    rows += [(7, "x", "en", 1, "Same row")] * 600
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert manifest(frame.repartition(6)) == brute_force(rows)


def test_empty_table(spark, empty):
    found = dataset_manifest(empty, leaf_hash(F.col("text")), F.lit(None).cast("string"))
    assert found.columns == ["row_id", "leaf", "subroot", "root", "proof", "folded_root"] and found.count() == 0


def test_query(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["source"], r["lang"], r["n_chars"], r["text"]) for r in table.collect()]
    assert "op11_manifest" in SQL
    assert Counter(tuple(r) for r in QUERIES["op11_manifest"](spark, sf_dir).collect()) == brute_force(rows)
