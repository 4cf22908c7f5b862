"""Merkle trees over sections, paragraphs and sentences of documents, in DataFrame operations only.

The text is cut into sentences (after ``.``, ``!`` or ``?`` before a blank, and at line ends), of which
long ones are cut further after every ``RUN_WORDS`` words.  A paragraph is a line, and a section ends at
an empty line or after a paragraph whose digest is divisible by ``FAN_OUT``, so that an edit moves no
section border but those beside it.  A leaf is the digest of a sentence, a paragraph's node the
digest of its leaves, a section's node that of its paragraphs, and the root the SHA-256 of the whole
text and of the section nodes.  Equal roots mean equal texts; sections that two trees do not share
lead to the paragraphs, and those to the leaves, where an edit lies.

``fingerprint`` is the tree as text: the root, then each section as ``node(leaf leaf|leaf ..)``.
``with_likeness`` compares two trees: 1 for equal roots, otherwise the leaves in shared sections count
whole, and the leaves of the others are compared one by one; the likeness is the number of distinct
shared leaves over that of all distinct leaves.

Defined results: a null text is an empty one, whose tree has one leaf, that of ''; rows of one id
follow each other in the order of their texts, and null ids come first; with one document it is its own
next one; an empty table gives an empty one; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN_WORDS = 24
FAN_OUT = 8
#: Neighbouring documents to a block, as long as that makes no more than ``MAX_BLOCKS`` of them.
BLOCK_ROWS = 2_000
MAX_BLOCKS = 20_000

#: Fixed sentence end: a blank after one of these marks.
_SENTENCE = r"([.!?]) "
_RUN = r"((?:[^ ]* ){%d})"


def digest(text: Column) -> Column:
    """The first 12 hexadecimal digits of the SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 12)


def leaves_of(paragraph: Column) -> Column:
    """Sentences, the long ones cut after every ``RUN_WORDS`` words."""
    marked = F.regexp_replace(F.regexp_replace(paragraph, _SENTENCE, "$1 \n"), _RUN % RUN_WORDS, "$1\n")
    return F.split(marked, "\n+")


def paragraph_leaves(text: Column) -> Column:
    """The joined leaf digests of each paragraph."""
    return F.transform(F.split(text, "\n"), lambda p: F.array_join(F.transform(leaves_of(p), digest), " "))


def section_nodes(paragraphs: Column) -> Column:
    """Sections as text, each ``node(leaf leaf|leaf ..)``, from the leaves of each paragraph."""
    empty = digest(F.lit(""))
    ends = lambda p: (p == empty) | (F.conv(F.substring(F.sha2(p, 256), 1, 4), 16, 10).cast("int") % FAN_OUT == 0)
    closed = F.transform(paragraphs, lambda p: F.concat(p, F.when(ends(p), "\n").otherwise("|")))
    sections = F.transform(F.split(F.array_join(closed, ""), "\n"), lambda s: F.rtrim(s, F.lit("|")))
    nodes = F.transform(F.filter(sections, lambda s: s != ""), lambda s: F.concat(digest(s), F.lit("("), s, F.lit(")")))
    return F.array_join(nodes, "")


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the tree of a text column as text: the root, then its sections.

    The steps are columns of their own, since Spark evaluates a lambda's input anew at each use.
    """
    rows = rows.withColumn("_nodes", section_nodes(paragraph_leaves(F.col(text))))
    root = F.sha2(F.concat(F.sha2(text, 256), "_nodes"), 256)
    return rows.withColumn(name, F.concat(root, F.lit(":"), "_nodes")).drop("_nodes")


def sections_of(print_: Column) -> Column:
    """The sections of a fingerprint, each ``node(leaves``."""
    return F.filter(F.split(F.substring_index(print_, ":", -1), r"\)"), lambda s: s != "")


def leaf_set(sections: Column) -> Column:
    """The distinct leaf digests of sections."""
    return F.array_distinct(
        F.flatten(F.transform(sections, lambda s: F.split(F.substring_index(s, "(", -1), r"[ |]")))
    )


def with_likeness(rows: DataFrame, left: str, right: str, name: str) -> DataFrame:
    """Adds the likeness of two fingerprint columns, 0 to 1: roots first, then sections, then the leaves
    of the sections that differ."""
    a, b = F.col("_a"), F.col("_b")
    rows = rows.withColumns({"_a": sections_of(F.col(left)), "_b": sections_of(F.col(right))})
    rows = rows.withColumns(
        {"_shared": leaf_set(F.array_intersect(a, b)), "_left": leaf_set(F.array_except(a, b)), "_right": leaf_set(F.array_except(b, a))}
    )
    common = F.size(F.array_union("_shared", F.array_intersect("_left", "_right")))
    whole = F.size(F.array_union("_shared", F.array_union("_left", "_right")))
    same = F.substring_index(left, ":", 1) == F.substring_index(right, ":", 1)
    likeness = F.when(same, F.lit(1.0)).otherwise(F.coalesce(common / F.nullif(whole, F.lit(0)), F.lit(0.0)))
    return rows.withColumn(name, likeness).drop("_a", "_b", "_shared", "_left", "_right")


def changed_sections(left: Column, right: Column) -> Column:
    """Where two fingerprints differ: the numbers, from 0, of the sections of ``left`` that ``right`` lacks."""
    numbered = F.transform(sections_of(left), lambda s, i: F.struct(i.alias("section"), s.alias("node")))
    return F.transform(F.filter(numbered, lambda x: ~F.array_contains(sections_of(right), x["node"])), lambda x: x["section"])


def with_next(documents: DataFrame, id_col: str, text_col: str, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(row_id, row_text, fingerprint, next_text, next_fingerprint)``: each document and the next by id.

    Documents are dealt into blocks of neighbouring ids.  The lowest ids of the blocks are ids that occur,
    so a block gets a second copy of the document that opens the next block (the last block, of the very
    first), and every neighbour is found within a block.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("row_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("row_text"))
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.count("row_id").alias("ids"), F.min("row_id").alias("low")).first()
    blocks = min(1 + found["n"] // block_rows, MAX_BLOCKS)
    cuts: list[int] = []
    if found["ids"] and blocks > 1:
        at = F.array(*(F.lit(i / blocks) for i in range(1, blocks)))
        cuts = rows.agg(F.percentile_approx("row_id", at, max(10_000, 10 * blocks)).alias("cuts")).first()["cuts"]
        cuts = sorted(set(cuts) - {found["low"]})
    # Block 0 starts with the null ids, block k > 0 with the id cuts[k - 1].
    borders = F.array(*(F.lit(c).cast("long") for c in cuts)) if cuts else F.expr("cast(array() as array<bigint>)")
    block = F.when(F.col("row_id").isNull() | (F.size(borders) == 0), F.lit(0)).otherwise(_rank(F.col("row_id"), borders))
    opens = (F.col("block") > 0) & (F.get(borders, F.col("block") - 1) == F.col("row_id"))
    first = F.col("row_id").isNull() if found["ids"] < found["n"] else F.col("row_id") == F.lit(found["low"])
    last_block = len(cuts)
    places = F.array_compact(
        F.array(
            F.struct(F.col("block").alias("block"), F.lit(0).alias("guest")),
            F.when(opens, F.struct((F.col("block") - 1).alias("block"), F.lit(1).alias("guest"))),
            F.when(first, F.struct(F.lit(last_block).alias("block"), F.lit(2).alias("guest"))),
        )
    )
    placed = rows.withColumn("block", block).withColumn("place", F.explode(places)).select("row_id", "row_text", "place.block", "place.guest")
    ordered = Window.partitionBy("block").orderBy("guest", "row_id", "row_text")
    printed = with_fingerprint(placed.repartition("block"), "row_text", "fingerprint")
    ahead = {"next_text": F.lead("row_text").over(ordered), "next_fingerprint": F.lead("fingerprint").over(ordered)}
    return printed.withColumns(ahead).where("guest = 0").drop("guest", "block")


def _rank(key: Column, borders: Column) -> Column:
    """How many of the sorted borders are at or below a key, by bisection."""
    middle = lambda s: ((s["low"] + s["high"]) / 2).cast("int")
    span = lambda low, high: F.struct(low.alias("low"), high.alias("high"))

    def halve(s: Column, _: Column) -> Column:
        below = F.get(borders, middle(s)) <= key
        step = F.when(below, span(middle(s) + 1, s["high"])).otherwise(span(s["low"], middle(s)))
        return F.when(s["low"] >= s["high"], s).otherwise(step)

    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(borders) + 1.0)).cast("int"))
    return F.aggregate(steps, span(F.lit(0), F.size(borders)), halve, lambda s: s["low"])


def fingerprint_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``row_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text's last quarter is replaced by the first code points of the next document.
    """
    rows = with_next(documents, id_col, text_col, block_rows)
    n = F.length("row_text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("row_text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    rows = rows.withColumns({"n_chars": n.cast("long"), "edited": edited}).drop("row_text", "next_text")
    rows = with_fingerprint(rows, "edited", "edited_fingerprint").withColumn("edited_sha256", F.sha2("edited", 256)).drop("edited")
    rows = with_likeness(rows, "fingerprint", "edited_fingerprint", "near_edited")
    rows = with_likeness(rows, "fingerprint", "next_fingerprint", "near_next")
    return rows.select("row_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
