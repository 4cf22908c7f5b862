import random
import re
import tempfile
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import blocks
from folioscope.llm import jaccard_join as J
from tests.llm.conftest import sentence


def shingles(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def parts(rows):
    """Ids and sets of the rows, and a number of the component of each."""
    low = -(1 << 63)
    rows = [(low if k is None else k, shingles(t)) for k, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in combinations(range(len(rows)), 2):
        a, b = rows[i][1], rows[j][1]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[find(i)] = find(j)
    return rows, [find(i) for i in range(len(rows))]


def expected(rows):
    rows, numbers = parts(rows)
    least = {}
    for number, (key, _) in zip(numbers, rows, strict=True):
        least[number] = min(least.get(number, key), key)
    name = lambda k: None if k == -(1 << 63) else k
    return sorted(((name(k), len(s), name(least[i])) for i, (k, s) in zip(numbers, rows, strict=True)), key=repr)


def result(frame):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in frame.collect()), key=repr)


def near_rows(seed, n, length=90):
    """Chains of near copies around the threshold, a passage in many documents, and strangers."""
    rng = random.Random(seed)
    passage = sentence(rng, 40)
    rows, texts = [], []
    for i in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randrange(1, 4)):
                words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
            text = " ".join(words)
        else:
            text = sentence(rng, length) + (" " + passage if rng.random() < 0.5 else "")
        texts.append(text)
        rows.append((i, text))
    return rows


def test_edges(edge, edge_rows, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 2000)
    assert result(J.shingle_components(edge, bucket_bytes=1 << 10)) == expected([(r[0], r[1]) for r in edge_rows])


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 4000)
    monkeypatch.setattr(J, "CHUNK", 7)
    rows = near_rows(3, 150)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(J.shingle_components(frame, bucket_bytes=1 << 10)) == expected(rows)
    # Without the rounds that only save work, the R-trees alone find every link.
    monkeypatch.setattr(J, "STAR_ROUNDS", 1)
    assert result(J.shingle_components(frame)) == expected(rows)


def test_keep_one(edge, edge_rows, empty):
    kept = J.keep_one(edge)
    assert kept.columns == edge.columns
    rows, numbers = parts([(r[0], r[1]) for r in edge_rows])
    full = {i for i, (_, s) in zip(numbers, rows, strict=True) if s}
    assert sum(1 for r in kept.collect() if shingles(r.text)) == len(full)
    assert J.keep_one(empty).count() == 0
    assert J.shingle_components(empty).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8, 20, 60, 64, 65, 79, 80, 100, 127, 200, 333, 1000, 5000])
def test_linking_sets_share_a_key(n):
    rng = np.random.default_rng(n)
    for trial in range(20 if n < 1000 else 4):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        # As far apart as a link allows: drop d and add e.
        size = len(a)
        drop = int(rng.integers(0, size // 5 + 1))
        add = 0
        while 100 * (size - drop) >= 80 * (size + add + 1):
            add += 1
        if trial % 2:
            add = int(rng.integers(0, add + 1))
        b = np.unique(np.concatenate([rng.permutation(a)[drop:], rng.integers(0, 1 << 63, add, dtype=np.uint64)]))
        shared = len(np.intersect1d(a, b))
        if J.links(shared, len(a), len(b)):
            assert np.intersect1d(J.set_keys(a), J.set_keys(b)).size


def test_tree_finds_all_that_the_bound_lets_through():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 1 << 63, rng.integers(60, 120), dtype=np.uint64)) for _ in range(20)]
    sets += [np.unique(np.concatenate([s[: len(s) - k], rng.integers(0, 1 << 63, k, dtype=np.uint64)])) for s in sets for k in (1, 3, 9, 20)]
    counts = [J.group_counts(s) for s in sets]
    groups = min(map(len, counts))
    points, sizes = np.stack([J.folded(c, groups) for c in counts]), np.array([len(s) for s in sets])
    tree = J.CountTree(points, sizes, fan_out=4)
    for i in range(len(sets)):
        bound = np.minimum(points, points[i]).sum(axis=1)
        assert sorted(tree.search(points[i], sizes[i])) == np.flatnonzero(bound >= J.needed(sizes + sizes[i])).tolist()
        for j in range(len(sets)):
            assert J.overlap_bound(counts[i], counts[j]) >= len(np.intersect1d(sets[i], sets[j]))


@pytest.mark.parametrize("n", [1, 2, 70, 700, 30_000, 90_000])
def test_sketch_bounds_the_overlap(n):
    rng = np.random.default_rng(n)
    a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    b = np.unique(np.concatenate([a[: n // 2 + 1], rng.integers(0, 1 << 63, n // 3, dtype=np.uint64)]))
    for tokens in (a, b):
        assert J.sketched(J.sketch(tokens)).tolist() == np.sort(tokens & np.uint64(0xFFFF)).tolist()
    counts = [np.bincount((x & np.uint64(0xFFFF)).astype(int), minlength=1 << 16) for x in (a, b)]
    points = [J.numbered(J.sketched(J.sketch(x))) for x in (a, b)]
    bound = int(np.minimum(*counts).sum())
    assert J.shared_by(points[0], [points[1], points[0]]).tolist() == [bound, len(a)]
    assert bound >= len(np.intersect1d(a, b))


def forest_rows(sets, failed=None):
    n = len(sets)
    names = [bytes([i]) for i in range(n)]
    return pa.table(
        {
            "key": pa.array([7] * n, pa.int64()),
            "side": pa.array([J.BOTH] * n, pa.int32()),
            "n": pa.array([len(s) for s in sets], pa.int64()),
            "node": pa.array(names, pa.binary()),
            "component": pa.array(names, pa.binary()),
            "lowest": pa.array([[7]] * n, pa.list_(pa.int64())),
            "failed": pa.array(failed or [None] * n, pa.list_(pa.binary())),
            "sketch": pa.array([J.sketch(s) for s in sets], pa.binary()),
        }
    )


def test_a_task_tells_a_forest_and_goes_round_failed_pairs():
    rng = np.random.default_rng(8)
    base = np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))
    close = [np.unique(np.concatenate([base[5:], rng.integers(0, 1 << 63, 5, dtype=np.uint64)])) for _ in range(60)]
    far = [np.unique(np.concatenate([rng.permutation(base)[60:], rng.integers(0, 1 << 63, 60, dtype=np.uint64)])) for _ in range(60)]
    sets = close + far
    edges = list(J._search_group(forest_rows(sets), J.Forest()))
    links = [(i, j) for i, j in combinations(range(len(sets)), 2) if J.links(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j]))]
    assert len(links) >= 60 * 59 // 2 and len(edges) < len(sets)
    forest, all_links = J.Forest(), J.Forest()
    for a, b in edges:
        assert forest.join(a, b)
    for i, j in links:
        all_links.join(bytes([i]), bytes([j]))
    same = lambda f: {(i, j) for i, j in combinations(range(len(sets)), 2) if f.top(bytes([i])) == f.top(bytes([j]))}
    assert same(forest) == same(all_links)
    # An edge that is told to be none is not told again, and its ends are connected by others.
    a, b = edges[0]
    failed = [[b] if bytes([i]) == a else [a] if bytes([i]) == b else None for i in range(len(sets))]
    again = list(J._search_group(forest_rows(sets, failed), J.Forest()))
    assert (a, b) not in again and len(again) == len(edges)


def test_search_goes_on_until_all_edges_link(spark, monkeypatch):
    # With a bound that lets nearly everything through, forests are full of pairs that do not link.
    monkeypatch.setattr(J, "sketch", lambda tokens: bytes(len(tokens)))
    rows = near_rows(5, 16)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.shingle_components(frame)) == expected(rows)


def test_nodes_are_searched_once_for_keys_with_one_first_node(spark, monkeypatch):
    kept = {}
    monkeypatch.setattr(J, "stored", lambda frame, label, put=J.stored: kept.setdefault(label, put(frame, label)) if label in ("open-rows", "gathered") else put(frame, label))
    rng = random.Random(3)
    words = sentence(rng, 200).split()
    rows = []
    for i in range(20):
        own = list(words)
        for at in rng.sample(range(200), 6):
            own[at] = f"new{i}x{at}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.shingle_components(frame)) == expected(rows)
    assert 0 < kept["gathered"].count() < 0.7 * kept["open-rows"].count()
    # Where they are too many to be searched together, key by key.
    monkeypatch.setattr(J, "CHUNK_TOKENS", 1_000)
    assert result(J.shingle_components(frame)) == expected(rows)


def test_sets_go_to_their_pairs_and_are_not_stored(spark, monkeypatch):
    labels = []
    monkeypatch.setattr(J, "stored", lambda frame, label, put=J.stored: labels.append(label) or put(frame, label))
    monkeypatch.setattr(J, "ASKED_ENDS", 3)
    monkeypatch.setattr(J, "SENT_BYTES", 1)
    rows = near_rows(9, 20)
    assert result(J.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)
    assert "links" in labels and "node-sets" not in labels


def test_nodes_without_a_partner_by_their_counts_get_no_sketch(spark, monkeypatch, tmp_path):
    def counted(batches, run=J._searched, folder=str(tmp_path)):
        def seen():
            for batch in batches:
                with tempfile.NamedTemporaryFile("w", dir=folder, delete=False) as file:
                    file.write(str(batch.num_rows))
                yield batch

        yield from run(seen())

    monkeypatch.setattr(J, "_searched", counted)
    rows_with_sketch = lambda: sum(int(f.read_text()) for f in tmp_path.iterdir())
    rng = random.Random(11)
    # Texts with a passage in common, which shares keys, and nothing else.
    passage = sentence(rng, 60)
    rows = [(i, passage + " " + sentence(rng, 90)) for i in range(30)]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.shingle_components(frame)) == expected(rows)
    assert rows_with_sketch() == 0
    # Near copies around the threshold do get one.
    rows = near_rows(4, 60)
    assert result(J.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))) == expected(rows)


def test_nodes_are_not_shuffled_again_for_their_keys(spark, monkeypatch):
    plans = {}
    monkeypatch.setattr(J, "stored", lambda frame, label, put=J.stored: plans.setdefault(label, frame) and put(frame, label))
    rows = near_rows(3, 60)
    J.shingle_components(spark.createDataFrame(rows, "doc_id long, text string"))
    plan = plans["open-rows"]._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(key" in plan and "Bucketed: true" in plan
    assert not re.search(r"Exchange hashpartitioning\(node#.*\n(?:(?!.*FileScan).*\n)*.*FileScan.*keys#", plan)


def test_near_rows_have_a_pair_that_the_counts_let_through():
    rng = np.random.default_rng(12)
    base = [np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (40, 120, 126, 130, 160, 255, 260, 300, 1000)]
    sets = base + [np.unique(np.concatenate([s[: len(s) - len(s) // d], rng.integers(0, 1 << 63, len(s) // 20, dtype=np.uint64)])) for s in base for d in (3, 8, 20)]
    sets = sets + [s for s in sets[:5]]
    part = [bytes([i % 7]) for i in range(len(sets))]
    counts, n = [J.group_counts(s) for s in sets], [len(s) for s in sets]
    for trial in range(20):
        mine = rng.permutation(len(sets))[: rng.integers(2, len(sets) + 1)]
        side = rng.integers(0, 4, len(mine)) if trial % 2 else np.full(len(mine), J.BOTH)
        rows = pa.table({
            "side": pa.array(side, pa.int32()), "n": pa.array([n[i] for i in mine], pa.int64()),
            "component": pa.array([part[i] for i in mine], pa.binary()), "counts": pa.array([counts[i].tobytes() for i in mine], pa.binary()),
        })
        found = set()
        for x, i in enumerate(mine):
            for y, j in enumerate(mine):
                asks, built = side[x] != J.BUILD, side[y] in (J.BUILD, J.BOTH)
                if asks and built and part[i] != part[j] and J.overlap_bound(counts[i], counts[j]) >= J.needed(n[i] + n[j]):
                    found |= {x, y}
        assert set(np.flatnonzero(J._near_rows(rows)).tolist()) >= found
    strangers = {"side": [J.BOTH] * len(base), "n": n[: len(base)], "component": part[:7] + [b"x", b"y"], "counts": [c.tobytes() for c in counts[: len(base)]]}
    assert not J._near_rows(pa.table(strangers)).any()


def test_many_near_copies_just_below_the_threshold(spark):
    # Texts of 300 words with a few words changed each: most pairs are just below 0.8.
    rng = random.Random(6)
    words = sentence(rng, 300).split()
    rows = []
    for i in range(120):
        own = list(words)
        for at in rng.sample(range(300), 4 + i % 2):
            own[at] = f"new{i}x{at}"
        rows.append((i, " ".join(own)))
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(J.shingle_components(frame)) == expected(rows)


def test_tokens_are_shingles(edge_rows):
    powers = J.Powers()
    for _, text, *_ in edge_rows:
        assert len(J.token_set(np.frombuffer((text or "").encode(), np.uint8), powers)) == len(shingles(text))
