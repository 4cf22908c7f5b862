"""Mixing by iterative proportional fitting: documents are sampled so that tokens meet target shares.

Documents fall into cells of source, language and topic.  The cells' tokens are summed by Spark;
raking then scales the cells' sampling probabilities to each marginal in turn until all three agree,
never above 1, so that no document is needed twice.  A document stays if a number hashed from its id
and text is below its cell's probability, which any task decides alone and always alike.

Target shares are given per marginal, or follow from the corpus: each category's share of tokens to
the power ``flatten`` (0 makes categories equal, 1 leaves them as they are), times its weight, 1 unless
``weights`` has another.  Without a ``budget`` the sample is the largest one that meets all shares: the
share of tokens to keep grows until raking leaves a category more than ``TOLERANCE`` of its share short
or over, beyond what no sample of any size can mend.  So without weights and targets all documents stay.
With a ``budget``, the share of all tokens to keep, a category with too few tokens for its share stays
whole and the sample is smaller by what it lacks.  ``mixing_report`` tells what every category gets, and
the largest gap of each marginal is logged, as a warning beyond ``TOLERANCE``.

Only the sums of cells reach the driver, if there are ``MAX_CELLS`` of them at most.  More are raked by
Spark in the same way (``CellTable``): a table of cells, per round three grouped sums that are joined back to
it, until no probability moves by more than ``SETTLED`` or for ``SPARK_ROUNDS`` rounds, and an ordinary join
with the documents.  Defined results: null sources and languages are a category of their own (``""``); categories
without tokens or without a target have probability 0 only if targets are given and leave them out;
texts without words count as one token; repeated rows have the same fate; an empty table gives an
empty one.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import UPPER
from folioscope.session import stored

MAX_CELLS = 100_000
#: No budget is searched beyond this share of the tokens: all of them.
BUDGET = 1.0
FLATTEN = 1.0
ROUNDS = 2000
#: The part of its share that a category may miss in the largest sample.
TOLERANCE = 0.001
#: Halvings of the interval in which the largest budget lies.
STEPS = 12
#: Where Spark rakes: rounds, and the change of a probability, as part of the largest one, that is none.
SPARK_ROUNDS = 200
SETTLED = 1e-6
SEED = 17

logger = logging.getLogger(__name__)

MARGINALS = ("mix_source", "mix_lang", "mix_topic")


def form_topic(text: Column) -> Column:
    """A stand-in for topics: the form of a text."""
    size = F.greatest(F.length(text), F.lit(1))
    bars = size - F.length(F.replace(text, F.lit("|"), F.lit("")))
    capitals = size - F.length(F.translate(text, UPPER, ""))
    return (
        F.when(bars >= size / 40, "table")
        .when(capitals >= size / 4, "capitals")
        .when(size < 500, "note")
        .when(size < 5000, "article")
        .otherwise("book")
    )


def words(text: Column) -> Column:
    """The number of runs of characters other than spaces and line breaks, 1 at least."""
    spaced = F.concat(F.lit(" "), F.translate(text, "\n\r\t", "   "))
    return F.greatest(F.size(F.filter(F.split(spaced, " ", -1), lambda w: w != "")), F.lit(1)).cast("long")


def _sums(values: np.ndarray, amounts: np.ndarray) -> dict[str, float]:
    names, index = np.unique(values, return_inverse=True)
    return dict(zip(names.tolist(), np.bincount(index, weights=amounts, minlength=len(names)).tolist(), strict=True))


def shares(values: np.ndarray, tokens: np.ndarray, flatten: float, target: Mapping[str, float] | None, weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Target shares of one marginal over the categories that have tokens."""
    sums = _sums(values, tokens)
    if target is None:
        raw = {v: n**flatten * float((weights or {}).get(v, 1.0)) for v, n in sums.items()}
    else:
        raw = {v: float(target.get(v, 0.0)) for v in sums}
    total = sum(raw.values())
    return {v: x / total if total else 0.0 for v, x in raw.items()}


def rake(cells: np.ndarray, tokens: np.ndarray, targets: list[dict[str, float]], budget: float, rounds: int = ROUNDS) -> np.ndarray:
    """The sampling probability of each cell; ``cells`` has a column of categories per marginal."""
    p = np.full(len(tokens), min(1.0, budget))
    wanted = budget * tokens.sum()
    groups = []
    for column, target in enumerate(targets):
        names, index = np.unique(cells[:, column], return_inverse=True)
        groups.append((index, np.array([target[n] for n in names]) * wanted))
    for _ in range(rounds):
        before = p.copy()
        for index, goal in groups:
            have = np.bincount(index, weights=tokens * p, minlength=len(goal))
            scale = np.divide(goal, have, out=np.zeros_like(goal), where=have > 0)
            p = np.minimum(1.0, p * scale[index])
        if np.abs(p - before).max() < 1e-10:
            break
    return p


def kept_shares(cells: np.ndarray, tokens: np.ndarray, targets: list[dict[str, float]], p: np.ndarray) -> list[dict[str, float]]:
    """The share of each marginal's categories among the tokens that probabilities ``p`` keep."""
    kept = tokens * p
    total = float(kept.sum()) or 1.0
    return [{v: n / total for v, n in _sums(cells[:, i], kept).items()} for i in range(len(targets))]


def gaps(cells: np.ndarray, tokens: np.ndarray, targets: list[dict[str, float]], p: np.ndarray) -> list[np.ndarray]:
    """By marginal, the part of its target share that each category misses or exceeds."""
    shares_ = kept_shares(cells, tokens, targets, p)
    return [np.array([abs(have[v] / t - 1.0) if t else have[v] for v, t in target.items()]) for have, target in zip(shares_, targets, strict=True)]


def rake_most(cells: np.ndarray, tokens: np.ndarray, targets: list[dict[str, float]]) -> np.ndarray:
    """The sampling probabilities of the largest budget at which the marginals agree."""
    # No category can give more than all its tokens.
    bounds = [n / (targets[i][v] * tokens.sum()) for i in range(len(targets)) for v, n in _sums(cells[:, i], tokens).items() if targets[i][v] > 0]
    high = min([BUDGET, *bounds])
    # Far below any bound raking meets the shares as far as they can be met at all; scaled until the
    # first cell is whole, it is a sample that needs no search.
    best = rake(cells, tokens, targets, high * 1e-6)
    if not best.max() > 0:
        return best
    low = high * 1e-6 / best.max()
    best = best / best.max()
    allowed = [np.maximum(g, 0.0) + TOLERANCE for g in gaps(cells, tokens, targets, best)]
    budget = high
    for _ in range(STEPS):
        if budget <= low:
            break
        p = rake(cells, tokens, targets, budget)
        # A smaller sample than the one at hand is none, whatever its budget.
        if all((g <= a).all() for g, a in zip(gaps(cells, tokens, targets, p), allowed, strict=True)):
            best, low = (p, budget) if (tokens * p).sum() >= (tokens * best).sum() else (best, budget)
        else:
            high = budget
        if low == budget == high:
            break
        budget = (low + high) / 2
    return best


class CellTable:
    """Raking where the cells are a table: ``rake``, ``gaps`` and ``rake_most`` on DataFrames."""

    def __init__(self, sums: DataFrame, flatten: float, targets: list[Mapping[str, float] | None], weights: list[Mapping[str, float] | None]):
        self.cells = stored(sums, "mix-cells")
        self.total = self.cells.agg(F.sum("tokens")).first()[0]
        self.goals = [stored(self._goal(*x), "mix-goals") for x in zip(MARGINALS, targets, weights, [flatten] * len(MARGINALS), strict=True)]

    def _goal(self, name: str, target: Mapping[str, float] | None, weights: Mapping[str, float] | None, flatten: float) -> DataFrame:
        """``(category, have, share)`` of one marginal."""
        sums = self.cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("have"))
        given = weights if target is None else target
        # As many rows as the caller gave.
        given = self.cells.sparkSession.createDataFrame([(k, float(v)) for k, v in (given or {}).items()], f"{name} string, given double")
        sums = sums.join(F.broadcast(given), name, "left")
        raw = F.pow("have", F.lit(flatten)) * F.coalesce("given", F.lit(1.0)) if target is None else F.coalesce("given", F.lit(0.0))
        sums = sums.withColumn("raw", raw)
        whole = sums.agg(F.sum("raw")).first()[0] or 0.0
        return sums.select(name, "have", (F.col("raw") / whole if whole else F.lit(0.0)).alias("share"))

    def rake(self, budget: float, rounds: int = SPARK_ROUNDS) -> DataFrame:
        """``cells`` and ``p``."""
        p = self.cells.withColumn("p", F.lit(min(1.0, budget)))
        wanted = budget * float(self.total)
        for _ in range(rounds):
            moved = p.withColumn("before", F.col("p"))
            for name, goal in zip(MARGINALS, self.goals, strict=True):
                have = moved.groupBy(name).agg(F.sum(F.col("tokens") * F.col("p")).alias("now"))
                scale = have.join(goal, name).select(name, F.when(F.col("now") > 0, F.col("share") * wanted / F.col("now")).otherwise(0.0).alias("scale"))
                moved = moved.join(scale, name).withColumn("p", F.least(F.lit(1.0), F.col("p") * F.col("scale"))).drop("scale")
            # Written, so that a round is not computed again by the next.
            p = stored(moved.select(*MARGINALS, "tokens", "p", "before"), "mix-round")
            far = p.agg(F.max(F.abs(F.col("p") - F.col("before"))).alias("moved"), F.max("p").alias("most")).first()
            if not far["moved"] > SETTLED * far["most"]:
                break
        return p.drop("before")

    def kept(self, p: DataFrame) -> float:
        return float(p.agg(F.sum(F.col("tokens") * F.col("p"))).first()[0] or 0.0)

    def gaps(self, p: DataFrame) -> list[DataFrame]:
        """By marginal, ``(category, have, kept, target, share, gap)``."""
        total = self.kept(p) or 1.0
        out = []
        for name, goal in zip(MARGINALS, self.goals, strict=True):
            kept = p.groupBy(name).agg(F.sum(F.col("tokens") * F.col("p")).alias("kept")).withColumn("now", F.col("kept") / total)
            gap = F.when(F.col("share") > 0, F.abs(F.col("now") / F.nullif("share", F.lit(0.0)) - 1.0)).otherwise(F.col("now"))
            out.append(kept.join(goal, name).select(F.col(name).alias("category"), "have", "kept", F.col("share").alias("target"), F.col("now").alias("share"), gap.alias("gap")))
        return out

    def rake_most(self) -> DataFrame:
        bounds = [g.where("share > 0").agg(F.min(F.col("have") / F.col("share"))).first()[0] for g in self.goals]
        high = min([BUDGET, *(b / float(self.total) for b in bounds if b is not None)])
        best = self.rake(high * 1e-6)
        most = best.agg(F.max("p")).first()[0]
        if not most > 0:
            return best
        low = high * 1e-6 / most
        best = best.withColumn("p", F.col("p") / most)
        allowed = [stored(g.select("category", (F.col("gap") + TOLERANCE).alias("allowed")), "mix-allowed") for g in self.gaps(best)]
        budget = high
        for _ in range(STEPS):
            if budget <= low:
                break
            p = self.rake(budget)
            if all(g.join(a, "category").where("gap > allowed").isEmpty() for g, a in zip(self.gaps(p), allowed, strict=True)):
                best, low = (p, budget) if self.kept(p) >= self.kept(best) else (best, budget)
            else:
                high = budget
            if low == budget == high:
                break
            budget = (low + high) / 2
        return best


def _told(names: list[str], found: list[DataFrame], report: list | None) -> None:
    """Logs the gaps of a table of cells, and adds them to a report."""
    for n, g in zip(names, found, strict=True):
        gap = g.agg(F.max("gap")).first()[0]
        logger.log(logging.WARNING if gap > 2 * TOLERANCE else logging.INFO, "mixing: a %s misses its share by %.4f of it", n, gap)
        if report is not None:
            report.append(g.select(F.lit(n).alias("marginal"), "category", F.col("have").alias("tokens"), F.col("kept").alias("kept_tokens"), "target", "share", "gap"))


def _mixed(
    documents: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    lang_col: str = "lang",
    topic: Column | None = None,
    targets: Mapping[str, Mapping[str, float]] | None = None,
    weights: Mapping[str, Mapping[str, float]] | None = None,
    budget: float | None = None,
    flatten: float = FLATTEN,
    max_cells: int = MAX_CELLS,
    report: list | None = None,
) -> DataFrame:
    """``mix_row``, the document as one value, so that its columns may have any names, and
    ``mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_kept``."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    # A number in [0, 1) from id and text: the upper 53 bits of a hash.
    number = F.shiftrightunsigned(F.xxhash64(F.lit(SEED), F.col(id_col), text), 11) / F.lit(float(1 << 53))
    marked = documents.select(
        F.struct("*").alias("mix_row"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("mix_source"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("mix_lang"),
        (F.coalesce(topic.cast("string"), F.lit("")) if topic is not None else form_topic(text)).alias("mix_topic"),
        words(text).alias("mix_tokens"),
        number.alias("mix_number"),
    )
    sums = marked.groupBy(*MARGINALS).agg(F.sum("mix_tokens").alias("tokens")).orderBy(*MARGINALS)
    rows = sums.limit(max_cells + 1).collect()
    names = [c.removeprefix("mix_") for c in MARGINALS]
    if len(rows) > max_cells:
        table = CellTable(sums, flatten, [(targets or {}).get(n) for n in names], [(weights or {}).get(n) for n in names])
        p = table.rake_most() if budget is None else table.rake(budget)
        _told(names, table.gaps(p), report)
        chances = stored(p.select(*MARGINALS, F.col("p").alias("mix_probability")), "mix-chances")
        return marked.join(chances, list(MARGINALS)).withColumn("mix_kept", F.col("mix_number") < F.col("mix_probability"))
    schema = ", ".join(f"{c} string" for c in MARGINALS) + ", mix_probability double"
    spark = documents.sparkSession
    if rows:
        cells = np.array([[r[c] for c in MARGINALS] for r in rows], dtype=object).astype(str)
        tokens = np.array([r["tokens"] for r in rows], dtype=np.float64)
        wanted = [shares(cells[:, i], tokens, flatten, (targets or {}).get(n), (weights or {}).get(n)) for i, n in enumerate(names)]
        p = rake_most(cells, tokens, wanted) if budget is None else rake(cells, tokens, wanted, budget)
        missed = gaps(cells, tokens, wanted, p)
        logger.info("mixing keeps %.4f of %d tokens", (tokens * p).sum() / tokens.sum(), tokens.sum())
        for n, g in zip(names, missed, strict=True):
            logger.log(logging.WARNING if g.max() > 2 * TOLERANCE else logging.INFO, "mixing: a %s misses its share by %.4f of it", n, g.max())
        if report is not None:
            for i, (n, have) in enumerate(zip(names, kept_shares(cells, tokens, wanted, p), strict=True)):
                all_, kept = _sums(cells[:, i], tokens), _sums(cells[:, i], tokens * p)
                report += [(n, v, all_[v], kept[v], wanted[i][v], share, float(gap)) for (v, share), gap in zip(have.items(), missed[i], strict=True)]
        data = [(*(str(x) for x in c), float(v)) for c, v in zip(cells, p, strict=True)]
    else:
        data = []
    chances = spark.createDataFrame(data, schema)
    # At most MAX_CELLS rows, so every task can hold them and no text moves.
    return marked.join(F.broadcast(chances), list(MARGINALS)).withColumn("mix_kept", F.col("mix_number") < F.col("mix_probability"))


def mixing_probabilities(documents: DataFrame, **options) -> DataFrame:
    """The documents and ``mix_source, mix_lang, mix_topic, mix_tokens, mix_probability, mix_kept``, which
    take the place of columns of these names.  The options are those of the module's first lines:
    column names, ``topic``, ``targets``, ``weights``, ``budget``, ``flatten`` and ``max_cells``."""
    added = [*MARGINALS, "mix_tokens", "mix_probability", "mix_kept"]
    own = [F.col("mix_row")[c].alias(c) for c in documents.columns if c not in added]
    return _mixed(documents, **options).select(*own, *added)


def mix(documents: DataFrame, **options) -> DataFrame:
    """The sampled documents with the columns they came with."""
    return _mixed(documents, **options).where("mix_kept").select("mix_row.*")


def mixing_report(documents: DataFrame, **options) -> DataFrame:
    """``marginal, category, tokens, kept_tokens, target, share, gap``: what the options of ``mix`` give
    each category; ``gap`` is the part of its target share that it misses or exceeds."""
    rows: list = []
    _mixed(documents, report=rows, **options)
    if rows and isinstance(rows[0], DataFrame):
        return reduce(DataFrame.unionByName, rows)
    schema = "marginal string, category string, tokens double, kept_tokens double, target double, share double, gap double"
    return documents.sparkSession.createDataFrame(rows, schema)
