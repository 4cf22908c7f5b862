"""Exact similarity join of word shingle sets: grouped tokens, count-vector R-trees, verification.

Two documents link when their sets of five-word shingles have ``100 * shared >= 80 * union``.

* Documents with equal sets are one node, named by a digest of the set.
* Tokens (shingle hashes) are hashed into groups.  Two linking sets differ in at most a ninth of their
  summed sizes, so most groups have the very same tokens in both; a node's key is a group with its
  tokens, and by the prefix principle it is enough to look at as many keys plus one as could differ, in
  an order common to all.  Which keys two nodes share is asked with a few bytes per key; only the nodes'
  shared keys become rows.
* Nodes are points of group counts, ``sum(min(a_g, b_g))`` bounds the overlap of two sets, and pairs below
  the needed overlap are dropped.  The others are verified on their complete sets.
* First each key's nodes are tried against one of them, which joins most of what belongs together; nodes
  of one component need no more pairs.  The rest, nodes of one key in different components, is searched
  with an R-tree for all keys with one first node, or one per key if that has very many: it is packed by the counts, an inner node holds the largest count of
  each group below it, and a branch whose summed minima with a query are too small is not entered.
* A tree of the counts alone comes first; only nodes that it lets through with a node of another component
  get a tree with what follows.
* What a tree lets through is bounded once more in its task, by counts of 65,536 groups, which is nearly the
  overlap itself.  A task tells a spanning forest of the pairs that pass, never the pairs, so what leaves
  it grows with the nodes.  The forests are verified on complete sets.  If one of their edges is no link,
  the nodes that edges told connect with it are searched again without that pair, until all edges are links.
  A pair of other nodes was told, is below a bound, or is connected by links alone.  So no pair is left out: at
  the end every pair that shares a key is in one component, below a bound, or verified.

The components are those of the verified links.  Keys of very many nodes are cut into tiles of sizes and
chunks, and all chunk pairs are searched by tasks of their own.

Defined results: documents without words or text have an empty set and link with nothing; with fewer
than five words, the whole sequence is the one shingle; null ids count as the smallest and are returned
as null; repeated rows are equal sets; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm import blocks as B
from folioscope.session import stored

WORDS = 5
#: Sets up to this size use their tokens themselves as keys.
SMALL = 64
STAR_ROUNDS = 1
#: Nodes of a key that one task searches at once; keys of more are cut.
CHUNK = 1_000
#: Tokens of nodes that are searched together.
CHUNK_TOKENS = 2_000_000
#: The tile of rows that are searched by label.
GATHERED = -2
#: Ends of pairs that a block is asked for at once, and bytes of sets that it sends at once.
ASKED_ENDS = 10_000
SENT_BYTES = 4 << 20
#: Keys of each node by which a pair that shares several is told once rather than for each of them.
LOWEST_KEYS = 12
FAN_OUT = 16

_BASE = 0x2545F4914F6CDD1D
_INVERSE = pow(_BASE, -1, 1 << 64)
_WORD_BASE = np.uint64(0x9FB21C651E98DF25)
_SALT = np.uint64(0xD6E8FEB86659FD93)

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def links(shared: int, a: int, b: int) -> bool:
    return 100 * shared >= 80 * (a + b - shared)


def needed(total: np.ndarray | int) -> np.ndarray | int:
    """The overlap that two sets need whose sizes sum to ``total``."""
    return -(-4 * total // 9)


class Powers:
    """Powers of the base and of its inverse, as far as they were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _BASE, np.uint64)]))
            self.down = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size, _INVERSE, np.uint64)]))
        return self.up[:n], self.down[:n]


def word_hashes(data: np.ndarray, powers: Powers) -> np.ndarray:
    """The hash of each word of a text, A-Z in lower case."""
    blank = _SPACE[data]
    edges = np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    if not len(begin):
        return np.zeros(0, np.uint64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    up, down = powers(len(data) + 1)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(B.random_table(5)[low] * up[:-1])])
    return B.mix64((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64))


def token_set(data: np.ndarray, powers: Powers) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = word_hashes(data, powers)
    if not len(words):
        return words
    n = max(len(words) - WORDS + 1, 1)
    total = np.zeros(n, np.uint64)
    for i in range(min(WORDS, len(words))):
        total = total * _WORD_BASE + words[i : i + n]
    return np.unique(B.mix64(total + np.uint64(min(WORDS, len(words)))))


def set_digest(tokens: np.ndarray) -> bytes:
    return hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()


def level(n: int) -> int:
    """Into how many groups a set of ``n`` tokens is hashed: two to this power; -1: none, tokens are keys."""
    return -1 if n <= SMALL else int(math.log2(n / 1.6))


def _prefix(elements: np.ndarray, length: int) -> np.ndarray:
    return elements if length >= len(elements) else np.partition(elements, length - 1)[:length]


def set_keys(tokens: np.ndarray) -> np.ndarray:
    """The keys of a set: any two linking sets have one in common."""
    n = len(tokens)
    found = []
    # The larger of two linking sets uses its own level, the smaller that of its largest partner too.
    for at in sorted({level(n), level(n + n // 4)}):
        differ = n // 4  # a ninth of the two sizes, the other being a quarter larger at most
        if at < 0:
            found.append(_prefix(B.mix64(tokens + _SALT), differ + 1))
            continue
        group = (tokens >> np.uint64(20)) & np.uint64((1 << at) - 1)
        order = np.argsort(group, kind="stable")
        names, starts = np.unique(group[order], return_index=True)
        content = np.add.reduceat(B.mix64(tokens ^ _SALT)[order], starts)
        elements = B.mix64(content + names * _SALT + np.uint64(at))
        found.append(_prefix(elements, differ + 1))
        if len(elements) <= differ:
            # So few filled groups could all differ although the sets link; then tokens are keys as well.
            found.append(_prefix(B.mix64(tokens + _SALT + np.uint64(at)), differ + 1))
    return np.concatenate(found)


def group_counts(tokens: np.ndarray) -> np.ndarray:
    """A point: the number of tokens in each group, of about four tokens each."""
    groups = 1 << max(4, min(12, int(math.log2(max(len(tokens), 4) / 4))))
    return np.bincount((tokens & np.uint64(groups - 1)).astype(np.int64), minlength=groups).astype(np.uint16)


def sketch(tokens: np.ndarray) -> bytes:
    """A point of 65,536 groups: the sorted groups of the tokens, as the steps between them, a step of 255
    or more in several bytes.  Their last bits are the groups of ``group_counts``."""
    steps = np.diff(np.sort(tokens.astype(np.uint16)).astype(np.int64), prepend=0)
    whole, rest = np.divmod(steps, 255)
    out = np.full(len(steps) + int(whole.sum()), 255, np.uint8)
    out[np.cumsum(whole + 1) - 1] = rest
    return out.tobytes()


def sketched(data: bytes | pa.Buffer) -> np.ndarray:
    """The groups that ``sketch`` wrote."""
    steps = np.frombuffer(data, np.uint8)
    return np.cumsum(steps, dtype=np.int64)[steps != 255]


def numbered(groups: np.ndarray) -> np.ndarray:
    """The groups of a sketch with the number of each repeat: what two share is the sum of minima of their counts."""
    new = np.ones(len(groups), bool)
    new[1:] = groups[1:] != groups[:-1]
    starts = np.flatnonzero(new)
    nth = np.arange(len(groups)) - np.repeat(starts, np.diff(np.append(starts, len(groups))))
    return (groups.astype(np.uint64) << np.uint64(32)) | nth.astype(np.uint64)


def shared_by(point: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """How many elements of the sorted ``point`` each of the others has."""
    every = np.concatenate(others)
    at = np.minimum(np.searchsorted(point, every), len(point) - 1)
    ends = np.cumsum([len(x) for x in others])
    return np.add.reduceat((point[at] == every).astype(np.int64), np.append(0, ends[:-1]))


def folded(counts: np.ndarray, groups: int) -> np.ndarray:
    """Points with fewer groups; the groups of a point are those of any smaller one, split."""
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2).astype(np.uint16)


def overlap_bound(a: np.ndarray, b: np.ndarray) -> int:
    groups = min(len(a), len(b))
    return int(np.minimum(folded(a, groups), folded(b, groups)).sum())


class CountTree:
    """An R-tree over points of equal dimension, packed by repeated tiling; boxes keep upper corners only,
    since a bound on the overlap needs nothing else."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, fan_out: int = FAN_OUT):
        self.order = self._tiled(points, np.arange(len(points)), 0, fan_out)
        self.points, self.sizes = points[self.order], sizes[self.order]
        #: Levels of (upper corners, least sizes), leaves last.
        self.levels = [(self.points, self.sizes)]
        while len(self.levels[0][0]) > fan_out:
            corners, least = self.levels[0]
            at = np.arange(0, len(corners), fan_out)
            self.levels.insert(0, (np.maximum.reduceat(corners, at, axis=0), np.minimum.reduceat(least, at)))
        self.fan_out = fan_out

    @staticmethod
    def _tiled(points: np.ndarray, index: np.ndarray, axis: int, fan_out: int) -> np.ndarray:
        """Points near each other follow each other: halves by one count, then by the next."""
        if len(index) <= fan_out:
            return index
        spread = points[index].astype(np.float32).var(axis=0)
        axis = int(spread.argmax())
        index = index[np.argsort(points[index, axis], kind="stable")]
        half = len(index) // 2
        return np.concatenate([CountTree._tiled(points, part, axis, fan_out) for part in (index[:half], index[half:])])

    def search(self, point: np.ndarray, size: int) -> np.ndarray:
        """The numbers of the points whose bound reaches the needed overlap."""
        nodes = np.arange(len(self.levels[0][0]))
        for depth, (corners, least) in enumerate(self.levels):
            if depth:
                nodes = (nodes[:, None] * self.fan_out + np.arange(self.fan_out)).ravel()
                nodes = nodes[nodes < len(corners)]
            bound = np.minimum(corners[nodes], point).sum(axis=1, dtype=np.int64)
            nodes = nodes[bound >= needed(least[nodes] + size)]
        return self.order[nodes]


# --- passes over the blocks ---


def _sets(row: dict, powers: Powers) -> Iterator[np.ndarray]:
    _, starts, data = B.texts_of(row)
    for a, b in zip(starts[:-1], starts[1:], strict=True):
        yield token_set(data[a:b], powers)


def _block_nodes(row: dict, powers: Powers) -> tuple[list[bytes], list[np.ndarray], list[int]]:
    """The distinct non-empty sets of a block in a fixed order, and the set of each document, -1 for none."""
    known: dict[bytes, int] = {}
    sets: list[np.ndarray] = []
    members = []
    for tokens in _sets(row, powers):
        if not len(tokens):
            members.append(-1)
            continue
        digest = set_digest(tokens)
        if digest not in known:
            known[digest] = len(sets)
            sets.append(tokens)
        members.append(known[digest])
    return list(known), sets, members


def _block_keys(sets: list[np.ndarray], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and short key of each distinct key, whether two sets here have it, all keys, and their sets."""
    keys = [np.unique(set_keys(s)) for s in sets]
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    keys = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
    bucket = B.bucket_of(keys, buckets)
    order, starts = B.groups_of([(bucket << np.uint64(32)) | (keys & np.uint64(0xFFFFFFFF))])
    sizes = np.diff(np.append(starts, len(order)))
    return bucket[order][starts], keys.astype(np.uint32)[order][starts], sizes, keys[order], owner[order]


def _asked(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for row in B.rows_of(batches):
            bucket, key, *_ = _block_keys(_block_nodes(row, powers)[1], buckets)
            if len(bucket):
                yield B.messages(row["block"], bucket, [key])

    return run


_FOUND = "kind string, node binary, doc_id long, text_sha256 string, n long, block long, place int, keys array<long>, counts binary, sketch binary"


def _found(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of documents with their nodes, and of nodes with their shared keys and counts."""
        powers = Powers()
        for row in B.rows_of(batches):
            names, sets, members = _block_nodes(row, powers)
            bucket, _, sizes, keys, owner = _block_keys(sets, buckets)
            shared = np.repeat(B.answered(row["bits0"], bucket) | (sizes > 1), sizes)
            keys, owner = keys[shared], owner[shared]
            order = np.argsort(owner, kind="stable")
            keys, owner = keys[order].astype(np.int64), owner[order]
            ends = np.searchsorted(owner, np.arange(len(sets) + 1))
            ids, starts, data = B.texts_of(row)
            out = []
            for i, at in enumerate(members):
                name, n = (names[at], len(sets[at])) if at >= 0 else (None, 0)
                sha = hashlib.sha256(data[starts[i] : starts[i + 1]]).hexdigest()
                out.append(("document", name, int(ids[i]), sha, n, row["block"], i, None, None, None))
            # Where in the block a set can be made again.
            places = {at: i for i, at in reversed(list(enumerate(members)))}
            for at in np.unique(owner).tolist():
                mine = keys[ends[at] : ends[at + 1]]
                out.append(("node", names[at], None, None, len(sets[at]), row["block"], places[at], mine, group_counts(sets[at]).tobytes(), sketch(sets[at])))
            kinds = [pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            labels = ["kind", "node", "doc_id", "text_sha256", "n", "block", "place", "keys", "counts", "sketch"]
            yield pa.RecordBatch.from_arrays([pa.array(list(v), t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=labels)

    return run


_SIDES = "a binary, b binary, tokens binary"


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The complete sets that a block is asked for, one row for each pair and end."""
    powers = Powers()
    for row in B.rows_of(batches):
        _, starts, data = B.texts_of(row)
        # Ends of one node follow each other, so its set is made once.
        out, size, place, tokens = [], 0, None, b""
        for x in sorted(row["wanted"], key=lambda x: x["place"]):
            if x["place"] != place:
                place = x["place"]
                tokens = token_set(data[starts[place] : starts[place + 1]], powers).tobytes()
            out.append((x["a"], x["b"], tokens))
            size += len(tokens)
            if size >= SENT_BYTES:
                yield _sides(out)
                out, size = [], 0
        if out:
            yield _sides(out)


def _sides(rows: list[tuple[bytes, bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), pa.binary()) for x in zip(*rows, strict=True)], names=["a", "b", "tokens"])


# --- pairs of nodes ---


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose counts allow a link."""
    for batch in batches:
        columns = batch.to_pydict()
        keep = []
        for n, m, a, b in zip(columns["n_a"], columns["n_b"], columns["counts_a"], columns["counts_b"], strict=True):
            need = needed(n + m)
            keep.append(min(n, m) >= need and overlap_bound(np.frombuffer(a, np.uint16), np.frombuffer(b, np.uint16)) >= need)
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sketches allow a link."""
    for batch in batches:
        keep = []
        for n, m, a, b in zip(*(batch.column(c) for c in ("n_a", "n_b", "sketch_a", "sketch_b")), strict=True):
            shared = shared_by(numbered(sketched(a.as_buffer())), [numbered(sketched(b.as_buffer()))])
            keep.append(shared[0] >= needed(n.as_py() + m.as_py()))
        yield batch.filter(pa.array(keep, pa.bool_())).select(["a", "b"])


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs that link, from rows sorted by pair, two of each."""
    last = None
    for batch in batches:
        found = []
        for a, b, tokens in zip(*batch.columns, strict=True):
            pair, tokens = (a.as_py(), b.as_py()), tokens.as_buffer()
            if last is None:
                # Kept as a copy, as the pair's other row may be in the next batch.
                last = pair, tokens.to_pybytes()
                continue
            if last[0] != pair:
                raise ValueError("a pair without one of its sets")
            x, y = np.frombuffer(last[1], np.uint64), np.frombuffer(tokens, np.uint64)
            if links(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y)):
                found.append(pair)
            last = None
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], names=["a", "b"])


class Forest:
    """Disjoint sets of names."""

    def __init__(self):
        self.up: dict[bytes, bytes] = {}

    def top(self, name: bytes) -> bytes:
        while (above := self.up.get(name, name)) != name:
            self.up[name] = name = self.up.get(above, above)
        return name

    def join(self, a: bytes, b: bytes) -> bool:
        """Whether the two were apart."""
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[a] = b
        return a != b


_GROUP = ("key", "tile", "build_chunk", "probe_chunk")
#: What a row is in its tree: a point of it, a query from the same or the next tile of sizes, or point and query.
BUILD, PROBE, NEXT_PROBE, BOTH = range(4)


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A spanning forest of what the R-trees and the sketches let through, from rows sorted by key, tile
    and chunk pair; a group has at most about two chunks of rows."""
    forest = Forest()
    for rows, starts in _whole_groups(batches):
        yield _search_groups(rows, starts, forest)


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """The rows of some whole groups, and where each starts, with the end."""
    kept = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        if kept is not None:
            rows = pa.concat_tables([kept, rows])
        ids = [rows.column(c).to_numpy() for c in _GROUP]
        new = np.ones(len(ids[0]), bool)
        new[1:] = np.logical_or.reduce([x[1:] != x[:-1] for x in ids])
        starts = np.flatnonzero(new)
        if len(starts):
            # The last group may go on in the next batch.
            kept = rows.slice(int(starts[-1]))
            yield rows.slice(0, int(starts[-1])), starts
    if kept is not None:
        yield kept, np.array([0, len(kept)])


_PLACED = "key long, tile int, build_chunk int, probe_chunk int, node binary, component binary, side int"


def _outlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with a partner in their group by their counts, from rows sorted like those of ``_searched``."""
    for rows, starts in _whole_groups(batches):
        near = [_near_rows(rows.slice(a, b - a)) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
        if near:
            yield from rows.drop_columns(["n", "counts"]).filter(pa.array(np.concatenate(near))).to_batches()


def _near_rows(rows: pa.Table) -> np.ndarray:
    """Which rows of a group are of a pair of different components whose counts allow a link."""
    side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    part = rows.column("component").combine_chunks().dictionary_encode().indices.to_numpy()
    found = np.zeros(len(n), bool)
    if not part.any():
        return found
    counts = [np.frombuffer(x.as_buffer(), np.uint16) for x in rows.column("counts")]
    sizes = np.array([len(x) for x in counts])
    # A partner is at most a quarter larger, so it has as many groups, or twice or half as many.
    for groups in np.unique(sizes).tolist():
        mine = np.flatnonzero((sizes == groups) | (sizes == 2 * groups))
        built, asks = (side[mine] == BUILD) | (side[mine] == BOTH), side[mine] != BUILD
        if not built.any() or not asks.any():
            continue
        points, build = np.stack([folded(counts[i], groups) for i in mine.tolist()]), mine[built]
        tree = CountTree(points[built], n[build])
        for i, point in zip(mine[asks].tolist(), points[asks], strict=True):
            near = build[tree.search(point, int(n[i]))]
            # Two of twice as many groups have a tree of their own.
            near = near[(part[near] != part[i]) & ((sizes[near] == groups) | (sizes[i] == groups))]
            if len(near):
                found[i] = found[near] = True
    return found


def _search_groups(rows: pa.Table, starts: np.ndarray, forest: Forest) -> pa.RecordBatch:
    edges: list[tuple[bytes, bytes]] = []
    for start, end in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        edges += _search_group(rows.slice(start, end - start), forest)
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in edges], pa.binary()) for i in (0, 1)], names=["a", "b"])


def _search_group(rows: pa.Table, forest: Forest) -> Iterator[tuple[bytes, bytes]]:
    side, n = rows.column("side").to_numpy(), rows.column("n").to_numpy()
    build, probe = np.flatnonzero((side == BUILD) | (side == BOTH)), np.flatnonzero(side != BUILD)
    nodes, parts, lowest, failed = (rows.column(c).to_pylist() for c in ("node", "component", "lowest", "failed"))
    if not len(build) or not len(probe) or len({forest.top(p) for p in parts}) == 1:
        return
    key = rows.column("key")[0].as_py()
    groups = [sketched(x.as_buffer()) for x in rows.column("sketch")]
    size = 1 << max(4, min(12, int(n.min()).bit_length() - 2))
    points = np.stack([np.bincount(g & (size - 1), minlength=size) for g in groups]).astype(np.uint16)
    # A pair that shares a smaller key is told there.
    told = [frozenset(k for k in ks or () if k < key) for ks in lowest]
    exact: dict[int, np.ndarray] = {}

    def elements(i: int) -> np.ndarray:
        if i not in exact:
            exact[i] = numbered(groups[i])
        return exact[i]

    tree = CountTree(points[build], n[build])
    for i in probe.tolist():
        own, top = nodes[i], forest.top(parts[i])
        near = build[tree.search(points[i], int(n[i]))].tolist()
        # Nodes of one tile meet twice, each as the query once.
        near = [j for j in near if side[i] == NEXT_PROBE or nodes[j] < own]
        near = [j for j in near if told[i].isdisjoint(told[j]) and forest.top(parts[j]) != top and nodes[j] not in (failed[i] or ())]
        if not near:
            continue
        passed = shared_by(elements(i), [elements(j) for j in near]) >= needed(n[near] + n[i])
        for j in np.array(near)[passed].tolist():
            if forest.join(parts[i], parts[j]):
                yield min(own, nodes[j]), max(own, nodes[j])


class _Join:
    """The steps between the tables of nodes, keys and links."""

    def __init__(self, blocks: B.Blocks, found: DataFrame):
        self.blocks = blocks
        nodes = found.where("kind = 'node'").select("node", "n", "block", "place", "counts", "sketch", "keys")
        # One row per node: equal sets of several blocks have equal keys, those shared in one are in all.
        first = Window.partitionBy("node").orderBy("block")
        nodes = nodes.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")
        #: The nodes bucketed by name, which what has few rows of each is joined to without a shuffle of them.
        self.dealt = blocks.bucketed(nodes, "nodes", "node")
        #: The same files as a plain table: a join of very many rows of one node can be split by Spark.
        self.nodes = self.dealt.sparkSession.read.schema(self.dealt.schema).parquet(blocks.folders["nodes"])

    def named(self, parts: DataFrame | None) -> DataFrame:
        """``(node, component, n, keys)``; without parts every node is its own component."""
        held = self.nodes.withColumn("component", F.col("node")) if parts is None else self.dealt.join(parts, "node")
        return held.select("node", "component", "n", "keys")

    def bounded(self, pairs: DataFrame) -> DataFrame:
        left = self.nodes.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("counts").alias("counts_a"))
        right = self.nodes.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("counts").alias("counts_b"))
        sized = pairs.join(left, "a").join(right, "b")
        return sized.mapInArrow(_bounded, "a binary, b binary")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link, by their complete sets."""
        # A set goes straight to where the pair's other one goes, and is neither stored nor moved with the pair.
        end = lambda c: pairs.select("a", "b", F.col(c).alias("node"))
        ends = end("a").union(end("b")).join(self.nodes.select("node", "block", "place"), "node")
        # A node of very many pairs is asked for in parts.
        parts = ends.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / ASKED_ENDS).alias("parts"))
        dealt = ends.join(parts, "block").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
        wanted = dealt.groupBy("block", "part").agg(F.collect_list(F.struct("a", "b", "place")).alias("wanted"))
        asked = self.blocks.table().join(wanted, "block").select("block", "ids", "starts", "data", "wanted")
        sets = asked.mapInArrow(_sets_of, _SIDES).repartition("a", "b").sortWithinPartitions("a", "b")
        return stored(sets.mapInArrow(_verified, "a binary, b binary"), "links")

    def star_pairs(self, parts: DataFrame | None, turn: int) -> DataFrame:
        """Each key's nodes as ``a`` with one of them as ``b``, if that is of another component and not too large or small."""
        named = self.named(parts).withColumn("place", F.xxhash64("node", F.lit(turn)))
        rows = named.select(F.explode("keys").alias("key"), "place")
        # Joined rather than a window by key, which would be one task for a key of very many nodes.
        first = rows.groupBy("key").agg(F.min("place").alias("head"))
        pairs = rows.join(first, "key").where("place != head").select("place", "head").distinct()
        # Names and sizes come to pairs, of which there are fewer than keys.
        end = lambda place, c: named.select(F.col("place").alias(place), F.col("node").alias(c), F.col("component").alias(f"part_{c}"), F.col("n").alias(f"n_{c}"))
        ends = pairs.join(end("place", "a"), "place").join(end("head", "b"), "head")
        # Sizes tell most pairs that cannot link, before the counts of any are moved.
        return ends.where((F.col("part_a") != F.col("part_b")) & (5 * F.least("n_a", "n_b") >= 4 * F.greatest("n_a", "n_b"))).select("a", "b")

    def close(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose sketches allow a link, of which few have no link, so few complete sets are moved in vain."""
        # Only the second nodes, the heads, can have very many pairs: Spark may split the join with a stored table.
        heads = stored(pairs.select(F.col("b").alias("node")).distinct().join(self.dealt.select("node", "n", "sketch"), "node"), "heads")
        left = self.dealt.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
        right = heads.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
        kept = pairs.join(left, "a").join(right, "b").mapInArrow(_close, "a binary, b binary")
        return kept.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))

    def open_keys(self, rows: DataFrame, least: int) -> DataFrame:
        """``(key, nodes, label)`` of the keys with ``least`` nodes or more, of different components; of keys that
        the very same nodes have, the smallest, where their pairs are told.  The label is that of the node
        that comes first by its hash."""
        # A node of its own component has one hash as both, which compresses.
        hashed = rows.select("key", F.xxhash64("node").alias("id"), F.xxhash64("component").alias("part"))
        seen = hashed.groupBy("key").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count(F.lit(1)).alias("nodes"), F.min("id").alias("label"), F.bit_xor("id").alias("who"))
        same = seen.where((F.col("low") != F.col("high")) & (F.col("nodes") >= least)).groupBy("nodes", "label", "who")
        return same.agg(F.min("key").alias("key")).select("key", "nodes", "label")

    def remaining_forests(self, parts: DataFrame, failed: DataFrame | None) -> DataFrame:
        """Spanning forests of the pairs that share a key, are of different components, pass the bounds and
        have not ``failed``."""
        # The only pair of a key with two nodes was tried in the first round; later there are parts of keys.
        least = 3 if failed is None else 2
        rows = self.named(parts).select(F.explode("keys").alias("key"), "node", "component", "n")
        rows = stored(rows.join(self.open_keys(rows, least), "key"), "open-rows")
        # Near copies have many keys in common and mostly the same first node in them; keys with one first node
        # are searched together, so a node is sent once for each such node and not once for each key.
        held = stored(rows.select("label", "node", "component", "n").distinct(), "gathered")
        sizes = held.groupBy("label").agg(F.count(F.lit(1)).alias("nodes"), F.sum("n").alias("tokens"))
        small = stored(sizes.where((F.col("nodes") <= CHUNK) & (F.col("tokens") <= CHUNK_TOKENS)).select("label"), "labels")
        as_whole = lambda key, tile: [
            F.col(key).alias("key"), F.lit(tile).alias("tile"), F.lit(0).alias("build_chunk"), F.lit(0).alias("probe_chunk"), "node", "component", F.lit(BOTH).alias("side")
        ]
        gathered = held.join(small, "label").select(*as_whole("label", GATHERED))
        rows = rows.join(small, "label", "left_anti")
        whole = rows.where(F.col("nodes") <= CHUNK).select(*as_whole("key", 0))
        rows = gathered.unionByName(whole).unionByName(self.cut(rows.where(F.col("nodes") > CHUNK)))
        # What has no partner by the counts, which are small, needs no sketch.
        outlines = rows.join(self.dealt.select("node", "n", "counts"), "node").select(*_GROUP, "node", "component", "side", "n", "counts")
        # A node is joined to its sketch once, not once for each of its groups.
        kept = self.in_groups(outlines).mapInArrow(_outlined, _PLACED).groupBy("node").agg(F.collect_list(F.struct(*_GROUP, "component", "side")).alias("groups"))
        points = self.dealt.select("node", "n", "sketch", F.slice(F.array_sort("keys"), 1, LOWEST_KEYS).alias("lowest"))
        if failed is None:
            points = points.withColumn("failed", F.lit(None).cast("array<binary>"))
        else:
            ends = failed.select(F.col("a").alias("node"), "b").union(failed.select(F.col("b"), F.col("a")))
            points = points.join(ends.groupBy("node").agg(F.collect_set("b").alias("failed")), "node", "left")
        # All pairs of what was gathered are told there.
        placed = kept.join(points, "node").select("node", "n", "sketch", "lowest", "failed", F.explode("groups").alias("at"))
        placed = placed.select("at.*", "node", "n", "sketch", F.when(F.col("at.tile") != GATHERED, F.col("lowest")).alias("lowest"), "failed")
        return self.in_groups(placed).mapInArrow(_searched, "a binary, b binary").distinct()

    def in_groups(self, rows: DataFrame) -> DataFrame:
        """The rows by group.  Many are small: a task goes through its own in order rather than calling Python for each."""
        return rows.repartition(*_GROUP).sortWithinPartitions(*_GROUP, "node")

    def suspects(self, parts: DataFrame, tried: DataFrame, missed: DataFrame) -> DataFrame:
        """The nodes that the edges ``tried`` connect with one that is no link, by the components of before."""
        ends = lambda edges: edges.join(parts.select(F.col("node").alias("a"), F.col("component").alias("part_a")), "a").join(
            parts.select(F.col("node").alias("b"), F.col("component").alias("part_b")), "b"
        ).select(F.col("part_a").alias("a"), F.col("part_b").alias("b"))
        told = ends(tried)
        names = told.select(F.col("a").alias("node")).union(told.select("b")).distinct()
        trees = stored(components(names, told).withColumnRenamed("component", "tree"), "told-trees")
        bad = ends(missed).select(F.col("a").alias("node")).join(trees, "node").select("tree").distinct()
        doubtful = trees.join(bad, "tree").select(F.col("node").alias("component"))
        return stored(parts.join(doubtful, "component").select("node"), "suspects")

    def cut(self, rows: DataFrame) -> DataFrame:
        """The rows of large keys by tile of sizes and pair of chunks."""
        # A partner is at most a quarter larger, so it is of the same tile of sizes or the next.
        tile = F.floor(F.log(1.26, F.col("n"))).cast("int")
        as_side = lambda kind, at: F.struct(F.lit(kind).alias("side"), at.alias("tile"))
        sides = F.array(as_side(BUILD, tile), as_side(PROBE, tile), as_side(NEXT_PROBE, tile - 1))
        rows = rows.withColumn("at", F.explode(sides)).select("key", "node", "component", "at.side", "at.tile")
        built = F.col("side") == BUILD
        sizes = rows.groupBy("key", "tile").agg(F.count(F.when(built, 1)).alias("builds"), F.count(F.when(~built, 1)).alias("probes"))
        sizes = sizes.where("builds > 0 and probes > 1").select(
            "key", "tile", F.ceil(F.col("builds") / CHUNK).cast("int").alias("build_chunks"), F.ceil(F.col("probes") / CHUNK).cast("int").alias("probe_chunks")
        )
        rows = rows.join(sizes, ["key", "tile"])
        own = lambda chunks: F.pmod(F.xxhash64("node"), F.col(chunks)).cast("int")
        chunk = lambda i, j: F.struct(i.alias("build_chunk"), j.alias("probe_chunk"))
        spread = F.when(built, F.transform(F.sequence(F.lit(0), F.col("probe_chunks") - 1), lambda j: chunk(own("build_chunks"), j))).otherwise(
            F.transform(F.sequence(F.lit(0), F.col("build_chunks") - 1), lambda i: chunk(i, own("probe_chunks")))
        )
        return rows.withColumn("chunk", F.explode(spread)).select("key", "tile", "chunk.build_chunk", "chunk.probe_chunk", "node", "component", "side")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(node, component)``: the smallest node reachable, by spreading and shortening until nothing changes."""
    both = stored(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).distinct(), "edges")
    linked = stored(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("component")), "components")
    while True:
        near = both.join(linked.select(F.col("node").alias("b"), F.col("component").alias("near")), "b").groupBy(F.col("a").alias("node")).agg(F.min("near").alias("near"))
        spread = linked.join(near, "node").select("node", F.least("component", "near").alias("next"), "component")
        # A component's name is a node too; its own component is where it now belongs.
        heads = linked.select(F.col("node").alias("next"), F.col("component").alias("further"))
        moved = spread.join(heads, "next", "left").select("node", F.least("next", "further").alias("component"), (F.least("next", "further") != F.col("component")).alias("changed"))
        moved = stored(moved, "components")
        linked = moved.drop("changed")
        if moved.where("changed").isEmpty():
            break
    return nodes.join(linked, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def shingle_components(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = B.BUCKET_BYTES) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, node, text_sha256``; ``node`` is
    a digest of the set, null if that is empty."""
    table = B.Blocks(documents, id_col, text_col)
    # A third of a token per key, a token for five bytes or more, four bytes a key.
    buckets = 1 + int(table.bytes / 5 / 3 * 4) // bucket_bytes
    sent = table.with_answers([]).mapInArrow(_asked(buckets), B.MESSAGE_SCHEMA)
    shared = stored(B.answers(sent, [np.uint32], B.shared_elsewhere), "shared-keys")
    found = stored(table.with_answers([shared]).mapInArrow(_found(buckets), _FOUND), "set-nodes")
    join = _Join(table, found)
    names = join.nodes.select("node")
    parts = names.withColumn("component", F.col("node"))
    edges = None
    for turn in range(STAR_ROUNDS):
        tried = stored(join.bounded(join.star_pairs(parts if turn else None, turn)), "star-pairs")
        new = join.verified(stored(join.close(tried), "close-pairs"))
        edges = new if edges is None else edges.unionByName(new)
        parts = stored(components(names, edges), "parts")
    failed = suspects = None
    while True:
        searched = parts if suspects is None else parts.join(suspects, "node")
        tried = stored(join.remaining_forests(searched, failed), "forests")
        if tried.isEmpty():
            break
        new = join.verified(tried)
        missed = stored(tried.join(new, ["a", "b"], "left_anti"), "no-links")
        edges = edges.unionByName(new)
        if not missed.isEmpty():
            suspects = join.suspects(searched, tried, missed)
        parts = stored(components(names, edges), "parts")
        if missed.isEmpty():
            break
        failed = missed if failed is None else failed.unionByName(missed)
    members = found.where("kind = 'document'").select("doc_id", "n", "node", "text_sha256")
    placed = members.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = placed.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    # Empty sets have no component and stay alone.
    named = placed.join(least, "component", "left")
    no_id = lambda c: F.nullif(c, F.lit(B.NO_ID))
    return named.select(
        no_id(F.col("doc_id")).alias("doc_id"),
        F.col("n").alias("n_shingles"),
        no_id(F.coalesce("least", "doc_id")).alias("component_id"),
        "node",
        "component",
        "text_sha256",
    )


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with the smallest id of each component, with the columns they came with; those with
    an empty set all stay, but for repeated rows of one id and text."""
    found = shingle_components(documents, id_col, text_col)
    row = F.struct(F.coalesce("doc_id", F.lit(B.NO_ID)).alias("id"), F.col("text_sha256").alias("sha"))
    group = F.coalesce(F.hex("component"), F.concat_ws("/", row["id"].cast("string"), row["sha"]))
    counted = found.groupBy(group.alias("group"), row["id"].alias("id"), row["sha"].alias("sha")).agg(F.count(F.lit(1)).alias("n"))
    first = counted.groupBy("group").agg(F.min(F.struct("id", "sha", "n")).alias("first"))
    keep = stored(first.select(F.col("first.id").alias("_id"), F.col("first.sha").alias("_sha"), F.col("first.n").alias("_n")), "kept")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # The row as one value, so that its columns may have any names.
    marked = documents.select(
        F.struct("*").alias("_row"), F.coalesce(F.col(id_col).cast("long"), F.lit(B.NO_ID)).alias("_own_id"), F.sha2(text, 256).alias("_own_sha")
    )
    rows = marked.join(keep, (F.col("_own_id") == F.col("_id")) & (F.col("_own_sha") == F.col("_sha")))
    single = rows.where("_n = 1")
    if not keep.where("_n > 1").isEmpty():
        single = single.unionByName(rows.where("_n > 1").dropDuplicates(["_own_id", "_own_sha"]))
    return single.select("_row.*")
