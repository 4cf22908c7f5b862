"""From search hits to cited documents, reranking, context and prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions import payload as payload_fn
from folioscope.functions import text as text_fn
from folioscope.session import dealt, stored

CITATION_STYLES = ("suffix", "prefix", "none")

#: Hits that a task scores, about.
HIT_ROWS = 16_384


def cited_documents(
    hits: DataFrame, points: DataFrame, citation: str = "suffix", strict_keys: bool = False
) -> DataFrame:
    """Attach the payload of each hit.

    The payload joins after the top-k, so the texts of the index are read only for
    hits and never shuffled with the vectors.  The citation number is the search rank.
    The source and page of a point are its ``file_name`` and ``page_number``; with
    ``strict_keys`` they are looked up as ``source`` and ``page``, which indexed points
    do not have, and are therefore the defaults.
    """
    found = _texts(points, strict_keys)
    return with_citation(hits.join(found, "id"), F.col("rank"), citation)


def _texts(points: DataFrame, strict_keys: bool) -> DataFrame:
    """``(id, text, source, page)`` of points."""
    if strict_keys:
        source, page = F.lit(C.MISSING_SOURCE), F.lit(C.MISSING_PAGE)
    else:
        source = F.coalesce("payload.file_name", F.lit(C.MISSING_SOURCE))
        page = F.coalesce("payload.page_number", F.lit(C.MISSING_PAGE))
    return points.select(
        "id",
        F.coalesce("payload.text", F.lit("")).alias("text"),
        source.alias("source"),
        page.alias("page"),
    )


def with_citation(documents: DataFrame, number: Column, citation: str = "suffix") -> DataFrame:
    """``reference_number`` and ``page_content`` of documents numbered by ``number``."""
    if citation not in CITATION_STYLES:
        raise ValueError(f"citation must be one of {CITATION_STYLES}")
    content = {
        "suffix": text_fn.cite_suffix(F.col("text"), F.col("reference_number")),
        "prefix": text_fn.cite_prefix(F.col("text"), F.col("source"), F.col("page")),
        "none": F.col("text"),
    }[citation]
    return documents.withColumn("reference_number", text_fn.citation_label(number)).withColumn("page_content", content)


def hit_metadata(hits: DataFrame, points: DataFrame) -> DataFrame:
    """Hits with ``page_content``, the plain text, and ``metadata``, a map of all other
    payload fields and the score."""
    payload = payload_fn.payload_map(F.col("payload"), C.PAYLOAD_FIELDS)
    return hits.join(points.select("id", "payload"), "id").select(
        *hits.columns,
        F.coalesce("payload.text", F.lit("")).alias("page_content"),
        payload_fn.without_text(payload, F.col("score")).alias("metadata"),
    )


def word_overlap(question: Column, text: Column) -> Column:
    """Share of the question's distinct words that occur in the text; a lexical stand-in
    for a hosted reranker, with no claim to its quality."""
    return _shared_words(text_fn.distinct_words(question), text_fn.words(text))


def _shared_words(wanted: Column, found: Column) -> Column:
    common = F.size(F.array_intersect(wanted, found))
    return F.when(F.size(wanted) > 0, common / F.size(wanted)).otherwise(F.lit(0.0))


def hosted_scores(
    documents: DataFrame, make_client: Callable[[], object], on: str = "text", question_id: str = "question_id"
) -> DataFrame:
    """Add ``rerank_score`` by one call per question, for ``documents`` with ``question``.

    A group holds the documents retrieved for one question, as many as the search's ``k``.
    """
    schema = T.StructType([*documents.schema.fields, T.StructField("rerank_score", T.DoubleType())])

    def score(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("rank")
        return group.assign(rerank_score=make_client().score(group["question"].iloc[0], group[on].tolist()))

    return documents.groupBy(question_id).applyInPandas(score, schema)


def rerank(
    documents: DataFrame,
    questions: DataFrame,
    top_n: int = C.RERANK_TOP_N,
    scorer: Callable[[Column, Column], Column] = word_overlap,
    on: str = "text",
    question_id: str = "question_id",
    renumber: bool = False,
    citation: str = "suffix",
    make_client: Callable[[], object] | None = None,
) -> DataFrame:
    """Keep the ``top_n`` documents of each question by a second score; ties keep search order.

    ``questions`` has ``question_id`` and ``question``.  Citation numbers stay those of
    the first search unless ``renumber`` is set; ``citation`` is the style of new ones.
    With ``make_client`` a service scores the documents instead of ``scorer``.
    """
    asked = documents.join(questions.select(question_id, "question"), question_id)
    if make_client is None:
        scored = asked.withColumn("rerank_score", scorer(F.col("question"), F.col(on)))
    else:
        scored = hosted_scores(asked, make_client, on, question_id)
    order = Window.partitionBy(question_id).orderBy(F.col("rerank_score").desc(), "rank")
    best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_n)
    if renumber:
        best = with_citation(best, F.col("position"), citation)
    return best.drop("question")


def reranked_documents(
    hits: DataFrame,
    points: DataFrame,
    questions: DataFrame,
    top_n: int = C.RERANK_TOP_N,
    scorer: Callable[[Column, Column], Column] = word_overlap,
    on: str = "text",
    question_id: str = "question_id",
    renumber: bool = False,
    citation: str = "suffix",
    strict_keys: bool = False,
) -> DataFrame:
    """``rerank`` of the ``cited_documents`` of stored ``hits``, without a sort of their texts.

    Texts join to be scored, and what is ranked are rows without them; the documents that are kept
    then get theirs.  Points may share an id, so a digest tells which of them a row is about.
    """
    which = F.xxhash64("text", "source", "page").alias("_which")
    texts = _texts(points, strict_keys).select("*", which)
    n_hits = hits.count()
    # Hits of one point are narrow rows; a task has the texts of so many hits at most.
    by_point = lambda side: dealt(side, n_hits, "id", task_rows=HIT_ROWS)
    read = by_point(texts).join(by_point(hits.select("id")).distinct(), "id", "left_semi")
    asked = questions.select(question_id, "question")
    if scorer is word_overlap and on == "text":
        # The words of a point are found once, not for each of its hits.
        read = read.select("id", "_which", text_fn.distinct_words(F.col("text")).alias("_words"))
        asked = asked.select(question_id, text_fn.distinct_words(F.col("question")).alias("_wanted"))
        score = _shared_words(F.col("_wanted"), F.col("_words"))
    else:
        score = scorer(F.col("question"), F.col(on))
    documents = by_point(hits.join(asked, question_id)).join(read, "id")
    if "text" in read.columns:
        documents = with_citation(documents, F.col("rank"), citation)
    scored = documents.select(*hits.columns, "_which", score.alias("rerank_score"))
    order = Window.partitionBy(question_id).orderBy(F.col("rerank_score").desc(), "rank")
    best = scored.withColumn("position", F.row_number().over(order)).where(F.col("position") <= top_n)
    best = stored(best, "reranked")
    n_best = best.count()
    wanted = texts.join(best.select("id").distinct(), "id", "left_semi")
    wanted = dealt(wanted, n_best, "id", "_which").dropDuplicates(["id", "_which"])
    kept = dealt(best.join(wanted, ["id", "_which"]).drop("_which"), n_best, question_id)
    kept = with_citation(kept, F.col("position" if renumber else "rank"), citation)
    rest = [c for c in hits.columns if c not in (question_id, "id")]
    return kept.select(question_id, "id", *rest, "text", "source", "page", "reference_number", "page_content", "rerank_score", "position")


def in_search_order(documents: DataFrame) -> DataFrame:
    """Use the search rank as the final position, for retrieval without reranking."""
    return documents.withColumn("position", F.col("rank"))


def assemble(documents: DataFrame, question_id: str = "question_id") -> DataFrame:
    """``context``, ``references`` and ``contexts`` of each question, in final order.

    A group has at most the number of documents retrieved per question.
    """
    ranked = F.array_sort(F.collect_list(F.struct("position", "page_content", "source", "page")))
    gathered = documents.groupBy(question_id).agg(ranked.alias("_docs"))
    contexts = F.transform("_docs", lambda d: d["page_content"])
    references = F.transform(
        "_docs",
        lambda d, i: text_fn.reference_line(
            i + 1,
            F.coalesce(d["source"], F.lit(C.REFERENCE_MISSING_SOURCE)),
            F.coalesce(d["page"], F.lit(C.REFERENCE_MISSING_PAGE)),
        ),
    )
    return gathered.select(
        question_id,
        F.array_join(contexts, "\n\n").alias("context"),
        F.array_join(references, "\n").alias("references"),
        contexts.alias("contexts"),
    )


def with_prompt(questions: DataFrame, template: str = "default") -> DataFrame:
    """Add ``prompt`` from the columns ``context``, ``question`` and, when present,
    ``references`` and ``chat_history``."""
    values = {
        name: F.coalesce(F.col(name), F.lit("")) if name in questions.columns else F.lit("")
        for name in ("context", "references", "chat_history", "question")
    }
    return questions.withColumn("prompt", text_fn.fill_template(text_fn.PROMPTS[template], values))
