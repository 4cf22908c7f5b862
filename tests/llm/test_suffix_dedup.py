import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from folioscope.llm import blocks, suffix_dedup
from tests.llm.conftest import sentence


def expected(rows):
    low = -(1 << 63)
    texts = [(low if k is None else k, k, (t or "").encode()) for k, t in rows]
    first = {}
    for key, _, data in texts:
        for i in range(len(data) - 49):
            piece = data[i : i + 50]
            first[piece] = min(first.get(piece, key), key)
    out = []
    for key, name, data in texts:
        gone = [False] * len(data)
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < key:
                gone[i : i + 50] = [True] * 50
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        kept = bytes(b for b, g in zip(data, gone, strict=True) if not g)
        out.append((name, len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def result(frame):
    return sorted((tuple(r) for r in frame.select("row_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("size", [200, 4 << 20])
def test_edges(edge, edge_rows, monkeypatch, size):
    monkeypatch.setattr(blocks, "BLOCK_BYTES", size)
    frame = suffix_dedup.remove_repeats(edge, bucket_bytes=1 << 12, with_text=True)
    assert result(frame) == expected([(r[0], r[1]) for r in edge_rows])
    for r in frame.collect():
        assert hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256
        assert sum(s.end - s.start for s in r.spans) == r.n_removed


def test_passages_at_all_offsets(spark, monkeypatch):
    """Shared strings of 45 to 130 bytes at many offsets and in many blocks."""
    rng = random.Random(11)
    passages = [sentence(rng, 30)[:n] for n in (45, 49, 50, 51, 52, 60, 63, 100, 130)]
    rows = [(i, sentence(rng, rng.randrange(0, 12)) + rng.choice(passages) + sentence(rng, rng.randrange(1, 9))) for i in range(120)]
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 700)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert result(suffix_dedup.remove_repeats(frame, bucket_bytes=1 << 12)) == expected(rows)


def test_empty(empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_a_pass_finds_the_keys_of_the_last_round_only(monkeypatch):
    """What earlier rounds told is noted; their keys are not found again by each later pass."""
    rng = random.Random(4)
    shared = sentence(rng, 40)
    texts = [(sentence(rng, 20) + shared + sentence(rng, 20)).encode() for _ in range(6)]
    starts = np.cumsum([0, *map(len, texts)]).astype(np.int64)
    calls = []
    for name in ("regions", "samples", "suffixes"):
        found = getattr(suffix_dedup.BlockState, name)
        monkeypatch.setattr(suffix_dedup.BlockState, name, lambda self, name=name, found=found: calls.append(name) or found(self))
    monkeypatch.setattr(suffix_dedup, "_SETTLE", tuple(getattr(suffix_dedup.BlockState, f.__name__) for f in suffix_dedup._SETTLE))
    steps = ((suffix_dedup.BlockState.regions, *suffix_dedup._STEPS[0][1:]), (suffix_dedup.BlockState.samples, *suffix_dedup._STEPS[1][1:]), (suffix_dedup.BlockState.suffixes, *suffix_dedup._STEPS[2][1:]))
    monkeypatch.setattr(suffix_dedup, "_STEPS", steps)
    block = {"block": 7, "ids": np.arange(6).tobytes(), "starts": starts.tobytes(), "data": b"".join(texts)}
    whole = dict(block)
    for step in range(3):
        calls.clear()
        sent = list(suffix_dedup._asked(step, [3, 3, 3])(iter([pa.RecordBatch.from_pylist([whole])])))
        assert sorted(set(calls)) == sorted(["regions", "samples", "suffixes"][max(step - 1, 0) : step + 1])
        answers = []
        for message in pa.Table.from_batches(sent).to_pylist():
            bits = message["payload"] if message["bucket"] < 0 else bytes(-(-message["n"] // 8))
            answers.append({"bucket": message["bucket"], "bits": bits})
        whole = {**block, "bits0": answers}
    calls.clear()
    row = next(iter(suffix_dedup._finished([3, 3, 3], False)(iter([pa.RecordBatch.from_pylist([whole])])))).to_pylist()
    assert set(calls) == {"suffixes"}
    rows = [(i, t.decode()) for i, t in enumerate(texts)]
    assert sorted(tuple(r.values()) for r in row) == expected(rows)


def test_answers_of_many_buckets_do_not_touch_all_keys_for_each(monkeypatch):
    """All buckets are looked up at once, in the keys' own type; each once took a pass over all keys."""
    rng = np.random.default_rng(2)
    bucket = np.sort(rng.integers(0, 500, 4000).astype(np.uint64))
    bits = rng.random(len(bucket)) < 0.4
    answers = [{"bucket": int(b), "bits": np.packbits(bits[bucket == b]).tobytes()} for b in np.unique(bucket)]
    answers.append({"bucket": -8, "bits": b"note"})
    kinds, search = [], np.searchsorted
    monkeypatch.setattr(np, "searchsorted", lambda keys, of, *more: kinds.append((keys.dtype, np.asarray(of).dtype)) or search(keys, of, *more))
    assert (blocks.answered(answers, bucket) == bits).all()
    assert kinds == [(np.dtype(np.uint64), np.dtype(np.uint64))] * 2
    assert blocks.noted(answers) == b"note"
    assert not blocks.answered(None, bucket).any() and len(blocks.answered([], bucket[:0])) == 0
    names = {m["bucket"]: m["n"] for m in blocks.messages(3, bucket, [bucket]).to_pylist()}
    assert names == {int(b): int((bucket == b).sum()) for b in np.unique(bucket)}


def test_cover_has_all_differences():
    assert {(a - b) % suffix_dedup.PERIOD for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(suffix_dedup.PERIOD))
