"""Answers: retrieved context, prompt and model reply for a set of questions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.functions.text import PROMPTS, fill_template
from folioscope.models.columns import TextModel, complete_column
from folioscope.operators.answers import assemble, with_prompt
from folioscope.operators.chat import PAGE_TURNS, latest_questions, open_questions, prompt_parts, same_keys, with_asked_tail
from folioscope.plans.retrieve import Retriever
from folioscope.session import dealt, stored


def extractive_answer(contexts: Column) -> Column:
    """All of the best context; the offline stand-in for a chat model."""
    return F.coalesce(F.get(contexts, 0), F.lit(""))


def with_context(questions: DataFrame, retriever: Retriever) -> DataFrame:
    """Questions with ``context``, ``references`` and ``contexts``; empty when nothing was found."""
    found = assemble(retriever.retrieve(questions))
    return (
        questions.join(found, "question_id", "left")
        .withColumn("context", F.coalesce("context", F.lit("")))
        .withColumn("references", F.coalesce("references", F.lit("")))
        .withColumn("contexts", F.coalesce("contexts", F.array().cast("array<string>")))
    )


def answer(
    questions: DataFrame,
    retriever: Retriever,
    make_model: Callable[[], TextModel] | None = None,
    template: str = "default",
    condense: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Add ``contexts``, ``prompt`` and ``answer`` to ``(question_id, question[, chat_history])``.

    ``condense(question, chat_history)`` may rewrite a follow-up question for retrieval;
    the prompt keeps the user's own wording.
    """
    asked = questions
    if condense is not None and "chat_history" in questions.columns:
        rewritten = condense(F.col("question"), F.col("chat_history"))
        asked = questions.withColumn("_own", F.col("question")).withColumn(
            "question",
            F.when(F.col("chat_history") != "", rewritten).otherwise(F.col("question")),
        )
    prepared = with_context(asked, retriever)
    if "_own" in prepared.columns:
        prepared = prepared.withColumn("question", F.col("_own")).drop("_own")
    return with_reply(prepared, make_model, template)


def with_reply(
    prepared: DataFrame, make_model: Callable[[], TextModel] | None = None, template: str = "default"
) -> DataFrame:
    """Add ``prompt`` and ``answer`` to questions that have their context."""
    prompted = with_prompt(prepared, template)
    reply = (
        extractive_answer(F.col("contexts"))
        if make_model is None
        else complete_column(make_model, F.col("prompt"))
    )
    return prompted.withColumn("answer", reply)


def _asked(found: DataFrame, session: str, turn: str) -> DataFrame:
    """Questions of sessions, found once for all the steps that use them."""
    return stored(
        found.select(F.col(session).alias("question_id"), session, turn, F.col("text").alias("question")),
        "asked",
    )


def _prepared(
    asked: DataFrame, retriever: Retriever, rewrite: Callable[[DataFrame], DataFrame] | None, session: str
) -> DataFrame:
    """Asked questions with context; a rewritten question is used for retrieval only."""
    if rewrite is None:
        return with_context(asked, retriever)
    found = with_context(rewrite(asked), retriever).drop("question")
    return same_keys(found, asked.select(session, "question"), session)


def _parts(
    asked: DataFrame,
    messages: DataFrame,
    retriever: Retriever,
    rewrite: Callable[[DataFrame], DataFrame] | None,
    session: str,
    turn: str,
    template: str,
    page_turns: int = PAGE_TURNS,
) -> DataFrame:
    # The tails join before the contexts, so that no join sorts these.
    tailed = stored(with_asked_tail(asked, messages, session, turn, page_turns), "tailed")
    prepared = _prepared(tailed, retriever, rewrite, session)
    before, after = PROMPTS[template].split("{chat_history}")
    values = {name: F.col(name) for name in ("context", "references", "question")}
    return prompt_parts(
        prepared.drop("question_id"),
        messages,
        fill_template(before, values),
        fill_template(after, values),
        session,
        turn,
        page_turns,
        keys=asked,
    )


def chat_prompts(
    messages: DataFrame,
    retriever: Retriever,
    session: str = "session_id",
    turn: str = "turn",
    template: str = "default",
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
    page_turns: int = PAGE_TURNS,
) -> DataFrame:
    """The prompt parts of the latest question of every session: ``(session, part, text)``.

    ``rewrite`` may replace the ``question`` of follow-up questions for retrieval.
    """
    asked = _asked(latest_questions(messages, session, turn), session, turn)
    return _parts(asked, messages, retriever, rewrite, session, turn, template, page_turns)


def whole_prompts(parts: DataFrame, session: str = "session_id", rows: int | None = None) -> DataFrame:
    """The parts of each prompt joined in order, for prompts that fit a model's window.

    ``rows`` is how many parts there are at most, about; without it they are written to be counted.
    """
    if rows is None:
        parts = stored(parts, "parts")
        rows = parts.count()
    parts = dealt(parts, rows, session)
    ordered = F.array_sort(F.collect_list(F.struct("part", "text")))
    return parts.groupBy(session).agg(F.array_join(F.transform(ordered, lambda p: p["text"]), "").alias("prompt"))


def chat_turns(
    messages: DataFrame,
    retriever: Retriever,
    make_model: Callable[[], TextModel] | None = None,
    session: str = "session_id",
    turn: str = "turn",
    template: str = "default",
    rewrite: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """The reply to the open question of every session, as messages to append.

    A reply takes the turn after its question.  Without a model it is the best context.
    """
    asked = _asked(open_questions(messages, session, turn), session, turn)
    if make_model is None:
        prepared = _prepared(asked, retriever, rewrite, session)
        replies = prepared.select(session, extractive_answer(F.col("contexts")).alias("text"))
    else:
        parts = _parts(asked, messages, retriever, rewrite, session, turn, template)
        replies = _complete_parts(parts, make_model, session)
    return same_keys(asked, replies, session).select(
        session, (F.col(turn) + 1).alias(turn), F.lit("assistant").alias("role"), "text"
    )


def _complete_parts(parts: DataFrame, make_model: Callable[[], TextModel], session: str) -> DataFrame:
    """One model call per session, on the parts of its prompt joined in order."""

    def complete(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make_model()
        current, pieces = None, []

        def reply() -> pd.DataFrame:
            return pd.DataFrame({session: [current], "text": [model.complete("".join(pieces))]})

        for batch in batches:
            for key, text in zip(batch[session], batch["text"]):
                if pieces and key != current:
                    yield reply()
                    pieces = []
                current = key
                pieces.append(text)
        if pieces:
            yield reply()

    schema = T.StructType([parts.schema[session], T.StructField("text", T.StringType())])
    # Only the parts of one prompt are held at a time, not the sessions of a partition.
    return parts.repartition(session).sortWithinPartitions(session, "part").mapInPandas(complete, schema)
