"""URL verdicts from host rules and, where no rule fits, a tree of path templates per host.

The tree has one node for each host and path prefix.  Segments that are variable by their form
(numbers, dates, hexadecimal and other long ids) become ``*`` at once.  Below each node, a literal
segment keeps a branch of its own only if it is frequent enough and its labelled URLs are blocked at
a rate that differs from that of its siblings by more than chance; all others, the rare ones and the
statistically similar ones, are merged into ``*``.  Labels are the verdicts of the rules and, for URLs
that no rule decides, the given ``labels`` of pages.  A template's share of blocked URLs is smoothed
towards that of its parent, a host's towards that of all hosts, and templates of a smoothed share of
``threshold`` or more are rejected.  With ``pool``, a branch without labels takes those of the branches
with the same template on all hosts: it is its own node if they differ from those of the other
templates on that level by more than chance, and its share starts from theirs.

All of it is DataFrame operations over counts per host and template, which are small and combined
before they are shuffled; the pages themselves move only for the last join, where Spark splits hot
hosts.  Levels below ``DEPTH`` belong to the node of their first ``DEPTH`` segments, which is how deep
templates go, not a limit on the URLs.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is
judged by the template of the empty host; an empty table gives an empty one; repeated rows are judged
one by one; other columns are ignored.  Labels without an id or a value are none, of several labels of
one page a block wins, and labels of pages that are not there count for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import ascii_lower
from folioscope.session import stored

DEPTH = 3
MIN_SHARE = 0.02
Z = 2.58
PRIOR = 8.0
THRESHOLD = 0.8

#: Fixed forms of variable segments: numbers (with a file ending or not), dates, long hexadecimal ids.
VARIABLE = r"^([0-9]+([-_.][0-9]+)*(\.[a-z0-9]{1,5})?|[0-9a-f]{8,}(-[0-9a-f]+)*(\.[a-z0-9]{1,5})?)$"

Rule = tuple[str, str, str]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z in lower case) and path of a URL."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest fitting rule as text, and its verdict; nulls where none fits.

    Rules are ``(verdict, host, path)``.  Of rules of one length the longer host wins, then a block.
    """
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), -len(r[1]), r[0] != "block"))
    fits = [
        ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2]) for r in ordered
    ]
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, rule in reversed(list(zip(fits, ordered, strict=True))):
        text = F.when(fit, F.lit(rule[1] + rule[2])).otherwise(text)
        verdict = F.when(fit, F.lit(rule[0])).otherwise(verdict)
    return text, verdict


def _segment(path: Column, level: int) -> Column:
    """The segment at a level: ``*`` if its form is variable, '' beyond the end."""
    raw = F.coalesce(F.get(F.split(F.regexp_replace(path, "^/", ""), "/"), F.lit(level)), F.lit(""))
    return F.when(ascii_lower(raw).rlike(VARIABLE), F.lit("*")).otherwise(raw)


def template_tree(cells: DataFrame, depth: int = DEPTH, min_share: float = MIN_SHARE, z: float = Z, prior: float = PRIOR, pool: bool = False) -> DataFrame:
    """``cells`` (host, s0 .. s<depth-1>, n, labelled, blocked) with the template of each cell and its
    ``purity``, the smoothed share of blocked URLs of the leaf template."""
    # One row: the share of blocked URLs among all labelled ones.
    whole = cells.agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked")).first()
    total = whole["blocked"] / whole["labelled"] if whole["labelled"] else 0.0
    hosts = cells.groupBy("host").agg(F.sum("labelled").alias("host_labelled"), F.sum("blocked").alias("host_blocked"))
    hosts = hosts.select("host", ((F.col("host_blocked") + prior * total) / (F.col("host_labelled") + prior)).alias("purity"))
    tree = cells.join(hosts, "host")
    path: list[str] = []
    for level in range(depth):
        parent = ["host", *path]
        child = f"s{level}"
        sums = [F.sum(c).alias(c) for c in ("n", "labelled", "blocked")]
        children = tree.groupBy(*parent, child).agg(*sums)
        parents = children.groupBy(*parent).agg(*(F.sum(c).alias(f"p_{c}") for c in ("n", "labelled", "blocked")))
        judged = children.join(parents, parent)
        others, others_blocked = F.col("p_labelled") - F.col("labelled"), F.col("p_blocked") - F.col("blocked")
        rate, rest = (F.col("blocked") + 0.5) / (F.col("labelled") + 1.0), (others_blocked + 0.5) / (others + 1.0)
        pooled = (F.col("p_blocked") + 0.5) / (F.col("p_labelled") + 1.0)
        error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / (F.col("labelled") + 1.0) + 1.0 / (others + 1.0)))
        own = (
            (F.col(child) == "")
            | ((F.col("n") >= min_share * F.col("p_n")) & (F.col("labelled") > 0) & (others > 0) & (F.abs(rate - rest) > z * error))
        )
        pooled_labelled, pooled_blocked = F.lit(0), F.lit(0)
        if pool:
            judged = _with_pool(judged, path, child)
            others, others_blocked = F.col("l_labelled") - F.col("q_labelled"), F.col("l_blocked") - F.col("q_blocked")
            rate, rest = (F.col("q_blocked") + 0.5) / (F.col("q_labelled") + 1.0), (others_blocked + 0.5) / (others + 1.0)
            pooled = (F.col("l_blocked") + 0.5) / (F.col("l_labelled") + 1.0)
            error = F.sqrt(pooled * (1.0 - pooled) * (1.0 / (F.col("q_labelled") + 1.0) + 1.0 / (others + 1.0)))
            lent = (
                (F.col("labelled") == 0) & (F.col(child) != "*") & (F.col("q_labelled") > 0) & (F.col("n") >= min_share * F.col("p_n"))
                & (others > 0) & (F.abs(rate - rest) > z * error)
            )
            own = own | lent
            pooled_labelled, pooled_blocked = F.when(lent, F.col("q_labelled")).otherwise(0), F.when(lent, F.col("q_blocked")).otherwise(0)
        named = judged.select(
            *parent, child, F.when(own, F.col(child)).otherwise("*").alias(f"t{level}"), pooled_labelled.alias("lent_labelled"), pooled_blocked.alias("lent_blocked")
        )
        tree = tree.join(named, [*parent, child])
        path.append(f"t{level}")
        node = ["host", *path]
        nodes = tree.groupBy(*node, "purity").agg(
            (F.sum("labelled") + F.max("lent_labelled")).alias("t_labelled"), (F.sum("blocked") + F.max("lent_blocked")).alias("t_blocked")
        )
        nodes = nodes.select(*node, ((F.col("t_blocked") + prior * F.col("purity")) / (F.col("t_labelled") + prior)).alias("next"))
        # Written, so that a level is not computed again by the levels below it.
        tree = stored(tree.join(nodes, node).drop("purity", "lent_labelled", "lent_blocked").withColumnRenamed("next", "purity"), "url-tree")
    return tree


def _with_pool(judged: DataFrame, path: list[str], child: str) -> DataFrame:
    """With the labels of each branch's template on all hosts (``q_``) and of its level (``l_``)."""
    branches = judged.groupBy(*path, child).agg(F.sum("labelled").alias("q_labelled"), F.sum("blocked").alias("q_blocked"))
    sums = [F.sum(f"q_{c}").alias(f"l_{c}") for c in ("labelled", "blocked")]
    levels = branches.groupBy(*path).agg(*sums)
    branches = branches.join(levels, path) if path else branches.crossJoin(F.broadcast(levels))
    return judged.join(branches, [*path, child])


def judge_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    id_col: str = "page_id",
    url_col: str = "url",
    depth: int = DEPTH,
    threshold: float = THRESHOLD,
    labels: DataFrame | None = None,
    label_key: Column | None = None,
    pool: bool = False,
) -> DataFrame:
    """``page_id, host, path, rule, verdict, template, purity`` of every page.

    ``labels`` are rows of ``key`` and ``bad``, whether a page is to be blocked; ``label_key``, the page's
    id unless given, is the column of ``pages`` that has the key."""
    host, path = split_url(F.col(url_col).cast("string"))
    key = F.col(id_col) if label_key is None else label_key
    urls = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), key.alias("label_key"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    levels = [f"s{i}" for i in range(depth)]
    urls = urls.withColumns({"rule": rule, "ruled": verdict} | {c: _segment(F.col("path"), i) for i, c in enumerate(levels)})
    told = urls
    if labels is not None:
        given = labels.select(F.col("key").alias("label_key"), F.col("bad").cast("boolean").alias("bad")).where("label_key is not null and bad is not null")
        given = given.groupBy("label_key").agg(F.max("bad").alias("bad"))
        told = urls.select("host", *levels, "ruled", "label_key").join(given, "label_key", "left")
        told = told.withColumn("ruled", F.coalesce("ruled", F.when(F.col("bad"), "block").when(~F.col("bad"), "allow")))
    cells = told.groupBy("host", *levels).agg(
        F.count(F.lit(1)).alias("n"),
        F.count("ruled").alias("labelled"),
        F.coalesce(F.sum((F.col("ruled") == "block").cast("long")), F.lit(0)).alias("blocked"),
    )
    tree = template_tree(stored(cells, "url-cells"), depth, pool=pool)
    template = reduce(lambda a, b: F.concat(a, F.when(b == "", F.lit("")).otherwise(F.concat(F.lit("/"), b))), [F.col(f"t{i}") for i in range(depth)], F.lit(""))
    leaves = tree.select("host", *levels, template.alias("template"), "purity")
    # The verdict of a rule wins; the template decides the rest.
    learned = F.when(F.round("purity", 9) >= threshold, "block").otherwise("allow")
    return urls.join(leaves, ["host", *levels]).select(
        "page_id", "host", "path", "rule", F.coalesce("ruled", learned).alias("verdict"), "template", "purity"
    )


def unruled(judged: DataFrame) -> DataFrame:
    """One row: ``urls`` that no rule decides, and how many of them the templates ``blocked``."""
    rest = judged.where("rule is null")
    return rest.agg(F.count(F.lit(1)).alias("urls"), F.count(F.when(F.col("verdict") == "block", 1)).alias("blocked"))


def document_id(url: Column) -> Column:
    """The number that ends a URL's path, without a file ending; null if there is none."""
    digits = F.regexp_extract(split_url(url)[1], r"/([0-9]{1,18})(\.[A-Za-z0-9]{1,5})?/?$", 1)
    return F.when(digits != "", digits).cast("long")
