"""A manifest of a dataset as a tree of SHA-256 midstates.

Every row is a leaf, the hash of its fields.  The leaves of one language, in order of their ids, are
hashed together eight at a time, level by level, to a subroot, and the subroots of all languages
likewise to the root.  A parent that is built keeps a copy of its hash state before each of its child
slots.  To fold a changed child in, the copy of its slot takes the replacement and the siblings to its
right and nothing else: what is left of it is in the state already.

Spark numbers the leaves by a range sort, so a language of any size is spread, and deals them out in
subtrees of 8^4; one round per four levels remains, each over a 4096th of the rows before.  On the way
down each subtree gets the runs above it, once for all its rows.

Defined results: null fields are a single ``-``; empty texts have length 0; rows of one id are ordered by
their leaves, and equal rows follow each other; null ids come first in their language and count as ''
where a CRC is taken; a lone leaf is its language's subroot and a lone subroot the root, without a hash
more; an empty table gives an empty manifest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.session import stored

FAN_OUT = 8
#: Levels that one task builds at once.
LEVELS = 4
SUBTREE = FAN_OUT**LEVELS


def encoded(value: Column) -> Column:
    """``-`` for null, else the bytes in UTF-8, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(*values: Column) -> Column:
    return F.sha2(F.concat(*map(encoded, values)), 256)


class Parent:
    """A node over a run of children: its digest, and the hash states before each child."""

    def __init__(self, children: list[str]):
        self.children = [c.encode() for c in children]
        self.states = []
        state = hashlib.sha256()
        for child in self.children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest()
        # The siblings to the right of each slot.
        self.right = [b"".join(self.children[i + 1 :]) for i in range(len(children))]

    def fold(self, slot: int, child: bytes) -> bytes:
        """The digest with another child in a slot, from that slot's state on."""
        state = self.states[slot].copy()
        state.update(child)
        state.update(self.right[slot])
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> str:
        return (b"".join(self.children[:slot]) + self.right[slot]).decode()


def levels_of(size: int) -> int:
    """Levels that a tree of so many nodes still has, up to those of one subtree."""
    levels = 0
    while size > 1 and levels < LEVELS:
        size, levels = -(-size // FAN_OUT), levels + 1
    return levels


def grow(nodes: list[str], levels: int) -> list[list[Parent]]:
    """The parents above consecutive nodes, level by level."""
    grown = []
    for _ in range(levels):
        parents = [Parent(nodes[i : i + FAN_OUT]) for i in range(0, len(nodes), FAN_OUT)]
        grown.append(parents)
        nodes = [p.digest for p in parents]
    return grown


def numbered(rows: DataFrame, trees: list[str], order: list[str]) -> DataFrame:
    """``rows`` with ``at``, the place in their tree from 0, and ``size``, the nodes of that tree.

    A range sort over tree and order; then each part's rows of a tree count on from those of earlier
    parts.  ``order`` must tell all rows apart, so that a task that runs again sorts alike.
    """
    keys = [F.col(c).asc_nulls_first() for c in trees + order]
    ranged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    # The number of the part, and within it of the row.
    placed = stored(ranged.withColumn("_place", F.monotonically_increasing_id()), "manifest-order")
    part = F.shiftright("_place", 33)
    counts = placed.groupBy(*trees, part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.min("_place").alias("_first"))
    tree = Window.partitionBy(*trees) if trees else Window.partitionBy(F.lit(0))
    before = F.sum("_n").over(tree.orderBy("_part")) - F.col("_n")
    starts = counts.withColumns({"_before": before, "size": F.sum("_n").over(tree)})
    # One row per tree and part; written, so that Spark knows whether it may broadcast them.
    starts = stored(_renamed(starts, [*trees, "_part"]), "manifest-starts")
    found = placed.join(starts, _same(trees) & (part == F.col("_of__part")))
    return found.withColumn("at", F.col("_before") + F.col("_place") - F.col("_first")).select(*rows.columns, "at", "size")


def _tops(group: pa.Table, names: list[str]) -> pa.Table:
    """The top node of one subtree."""
    group = group.sort_by("at")
    at, size = group.column("at")[0].as_py(), group.column("size")[0].as_py()
    grown = grow(group.column("node").to_pylist(), levels_of(size))
    top = grown[-1][0].digest if grown else group.column("node")[0].as_py()
    columns = {c: group.column(c).slice(0, 1).combine_chunks() for c in names}
    columns |= {"at": pa.array([at // SUBTREE]), "size": pa.array([-(-size // SUBTREE)]), "node": pa.array([top])}
    return pa.table(columns)


def _renamed(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.withColumnsRenamed({c: f"_of_{c}" for c in names})


def _same(names: list[str]) -> Column:
    """Equal keys, null ones included, of two tables of which one is ``_renamed``."""
    same = F.lit(True)
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return same


def _subtree() -> Column:
    return F.expr(f"at div {SUBTREE}").alias("subtree")


class Tree:
    """Trees over rows ``(*trees, at, size, node)``: the tops of their subtrees, round by round."""

    def __init__(self, rows: DataFrame, trees: list[str]):
        self.trees = trees
        self.rounds = [rows.select(*trees, "at", "size", "node")]
        self.kinds = "".join(f"`{c}` {rows.schema[c].dataType.simpleString()}, " for c in trees)
        largest = rows.agg(F.coalesce(F.max("size"), F.lit(0))).first()[0]
        while largest > 1 or len(self.rounds) == 1:
            groups = self.rounds[-1].groupBy(*trees, _subtree())
            tops = groups.applyInArrow(lambda g: _tops(g, trees), f"{self.kinds}at long, size long, node string")
            self.rounds.append(stored(tops, "manifest-tops"))
            largest = -(-largest // SUBTREE)

    def roots(self) -> DataFrame:
        """``(*trees, node)``: one row per tree."""
        return self.rounds[-1].select(*self.trees, "node")

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """``(*trees, subtree, top, runs, slots)`` of each subtree of the first round: its tree's root, the
        runs of siblings above it, and its slot in each; ``above`` has the runs above the roots."""
        roots = self.rounds[-1].select(*self.trees, F.lit(0).cast("long").alias("subtree"), F.col("node").alias("top"))
        if above is None:
            known = roots.withColumns({"runs": F.array().cast("array<string>"), "slots": F.array().cast("array<int>")})
        else:
            known = roots.join(_renamed(above.select(*self.trees, "runs", "slots"), self.trees), _same(self.trees)).select(*roots.columns, "runs", "slots")
        for nodes in reversed(self.rounds[1:-1]):
            known = self.each(nodes, known, _paths(self.trees), f"{self.kinds}{_PATH}")
        return known

    def each(self, nodes: DataFrame, paths: DataFrame, work, schema: str) -> DataFrame:
        """``work`` over the nodes of each subtree and the one path above it."""
        mine = nodes.withColumn("subtree", _subtree()).groupBy(*self.trees, "subtree")
        return mine.cogroup(paths.groupBy(*self.trees, "subtree")).applyInArrow(work, schema)


_PATH = "subtree long, top string, runs array<string>, slots array<int>"


def _paths(keep: list[str]):
    """The path of each node of a subtree, which is the one above a subtree of the round before."""

    def run(nodes: pa.Table, above: pa.Table) -> pa.Table:
        nodes = nodes.sort_by("at")
        grown = grow(nodes.column("node").to_pylist(), levels_of(nodes.column("size")[0].as_py()))
        top, runs, slots = (above.column(c)[0].as_py() for c in ("top", "runs", "slots"))
        found_runs, found_slots = [], []
        for i in range(nodes.num_rows):
            own_runs, own_slots = [], []
            for parents in grown:
                i, slot = divmod(i, FAN_OUT)
                own_runs.append(b"".join(parents[i].children).decode())
                own_slots.append(slot)
            found_runs.append(own_runs + runs)
            found_slots.append(own_slots + slots)
        columns = {c: nodes.column(c) for c in keep} | {"subtree": nodes.column("at"), "top": pa.array([top] * nodes.num_rows, pa.string())}
        columns |= {"runs": pa.array(found_runs, pa.list_(pa.string())), "slots": pa.array(found_slots, pa.list_(pa.int32()))}
        return pa.table(columns)

    return run


_DIGEST = 64


def _proofs(leaves: pa.Table, above: pa.Table) -> pa.Table:
    """Every leaf of a subtree with its proof and the root that its changed digest folds to."""
    leaves = leaves.sort_by("at")
    nodes = leaves.column("node").to_pylist()
    grown = grow(nodes, levels_of(leaves.column("size")[0].as_py()))
    top, runs, slots = (above.column(c)[0].as_py() for c in ("top", "runs", "slots"))
    upper = [(Parent([run[i : i + _DIGEST] for i in range(0, len(run), _DIGEST)]), slot) for run, slot in zip(runs, slots, strict=True)]
    higher = [parent.siblings(slot) for parent, slot in upper]
    folded, proofs = [], []
    for i, changed in enumerate(leaves.column("changed").to_pylist()):
        node, proof = (changed or nodes[i]).encode(), []
        for parents in grown:
            i, slot = divmod(i, FAN_OUT)
            node = parents[i].fold(slot, node)
            proof.append(parents[i].siblings(slot))
        for parent, slot in upper:
            node = parent.fold(slot, node)
        folded.append(node.decode())
        proofs.append(proof + higher)
    return pa.table(
        {
            "row_id": leaves.column("row_id"),
            "leaf": leaves.column("node"),
            "subroot": pa.array([top] * len(nodes), pa.string()),
            "proof": pa.array(proofs, pa.list_(pa.string())),
            "folded_root": pa.array(folded, pa.string()),
        }
    )


def dataset_manifest(documents: DataFrame, leaf: Column, changed: Column, tree: Column | str = "lang", id_col: str = "doc_id") -> DataFrame:
    """``row_id, leaf, subroot, root, proof, folded_root`` of every row.

    ``leaf`` is a row's digest as it was recorded and ``changed`` its digest as it is found now, or null
    where it is as recorded; ``folded_root`` is the root that follows from the latter and the recorded
    siblings.  ``proof`` has these, one string of digests per level.
    """
    tree = F.col(tree) if isinstance(tree, str) else tree
    hashed = documents.select(
        F.col(id_col).alias("row_id"), tree.cast("string").alias("tree"), leaf.alias("node"), changed.alias("changed"), F.monotonically_increasing_id().alias("_row")
    )
    # Written first: the texts are hashed once, and the row numbers are fixed.
    hashed = stored(hashed, "manifest-leaves")
    leaves = stored(numbered(hashed, ["tree"], ["row_id", "node", "_row"]).drop("_row"), "manifest-leaves")
    lower = Tree(leaves, ["tree"])
    subroots = stored(numbered(lower.roots(), [], ["tree"]), "manifest-subroots")
    upper = Tree(subroots, [])
    root = upper.roots().first()
    down = upper.each(subroots, upper.paths(), _paths(["tree"]), f"tree string, {_PATH}")
    key = documents.schema[id_col].dataType.simpleString()
    proved = lower.each(leaves, lower.paths(down), _proofs, f"row_id {key}, leaf string, subroot string, proof array<string>, folded_root string")
    return proved.select("row_id", "leaf", "subroot", F.lit(root["node"] if root else None).cast("string").alias("root"), "proof", "folded_root")
