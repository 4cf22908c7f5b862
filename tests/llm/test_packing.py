import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
from tokenizers import Tokenizer

from folioscope.llm import packing


def test_least_slack_is_least():
    rng = random.Random(1)
    for _ in range(200):
        items = [rng.randrange(1, 30) for _ in range(rng.randrange(1, 9))]
        room = rng.randrange(1, 60)
        best = max((sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= room), default=0)
        used = packing.least_slack(dict(Counter(items)), room)
        assert sum(n * k for n, k in used.items()) == best
        assert all(k <= Counter(items)[n] for n, k in used.items())


def test_plan_uses_every_piece_once():
    rng = random.Random(2)
    counts = Counter(rng.randrange(1, 1025) for _ in range(5000)) + Counter({1024: 100, 600: 900})
    plan = packing.plan_windows(dict(counts))
    used = Counter()
    for filling, times in plan:
        assert sum(n * k for n, k in filling.items()) <= 1024
        for n, k in filling.items():
            used[n] += k * times
    assert used == counts


def test_words_have_the_tokenizers_ids(edge_rows):
    files = packing.byte_bpe()
    encode, whole = packing.WordEncoder(*files, cached=50), Tokenizer.from_file(files[0])
    texts = [r[1] or "" for r in edge_rows] + ["a<|endoftext|>b", " lead", "trail  ", "a  b\n c\t d", "x   y", "\n\n z", "don't  's it's", "a  b", "\0 a b"]
    for text in texts:
        assert np.frombuffer(encode(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def test_pieces_cover_every_id(edge, edge_rows):
    rows = packing.pack(edge, block_rows=3, with_ids=True).collect()
    whole = Tokenizer.from_file(packing.byte_bpe()[0])
    wanted = Counter()
    for key, text, *_ in edge_rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(ids), 1024):
            piece = ids[at : at + 1024]
            wanted[key, at, len(piece), zlib.crc32(piece.tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == wanted
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 for r in rows)
    windows = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append((r.offset, r.length))
    for pieces in windows.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024


def test_empty(empty):
    assert packing.pack(empty).count() == 0
