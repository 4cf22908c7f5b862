"""Evaluation: answers and contexts for a question set, and their scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.judge import parse_reply
from folioscope.functions.text import distinct_words, nonblank_lines, words
from folioscope.functions.vectors import cosine
from folioscope.models.calls import CallStore
from folioscope.models.columns import Embedder, TextModel, complete_column, embed_column
from folioscope.operators.evaluation import answer_correctness, answer_relevancy, word_f1
from folioscope.plans.answer import answer
from folioscope.plans.replay import replay
from folioscope.plans.retrieve import Retriever
from folioscope.session import stored


def evaluation_table(
    items: DataFrame, retriever: Retriever, make_model: Callable[[], TextModel] | None = None
) -> DataFrame:
    """``(question_id, question, answer, contexts, ground_truth)`` of every item.

    Every question is answered by itself, without the history of the earlier ones, so
    the result does not depend on the order of the items; ``remembering_table`` carries them along.
    """
    answered = answer(items, retriever, make_model)
    return answered.select("question_id", "question", "answer", "contexts", "ground_truth")


def remembering_table(
    items: DataFrame, retriever: Retriever, make_model: Callable[[], TextModel] | None = None, order: str = "question_id"
) -> DataFrame:
    """``(question_id, question, prompt, answer, ground_truth)`` of items that are asked one after the
    other in one session, each with the earlier questions and answers in its prompt.

    One session means one round per item, as each needs the answers before it.
    """
    asked = items.select(
        F.lit("evaluation").alias("session_id"), F.col(order).alias("turn"), F.lit("user").alias("role"), F.col("question").alias("text")
    )
    replies = replay(asked, retriever, make_model).select(F.col("turn").alias(order), "prompt", "answer")
    return items.join(replies, order).select("question_id", "question", "prompt", "answer", "ground_truth")


#: Tasks of a judge; a JSON object with what they are about follows on the last line.
STATEMENTS_TASK = 'List the statements that this answer makes. Reply with JSON: {"statements": [...]}.'
VERDICT_TASK = 'Does this statement bear on the question? Reply with JSON: {"verdicts": ["yes"]} or {"verdicts": ["no"]}.'


def judge_relevancy(
    table: DataFrame, make_judge: Callable[[], TextModel], store: CallStore, judge_name: str, threshold: float = 0.5
) -> DataFrame:
    """Answers judged in two steps: ``question_id, question, answer, statements, score, success``.

    A first call lists an answer's statements, a second one gives a verdict on each; the score is the
    share of ``yes``.  An answer without statements has no score and no success.  Each distinct prompt is
    asked once, through the store of calls.
    """
    ask = lambda prompt: complete_column(make_judge, prompt)
    told = table.select("question_id", "question", "answer", _prompt(STATEMENTS_TASK, "answer").alias("prompt"))
    listed = store.call(told, "prompt", judge_name, ask).withColumn("statements", parse_reply(F.col("reply"))["statements"])
    # Written, as both the statements and their verdicts start from it.
    listed = stored(listed.drop("prompt", "reply"), "statements")
    each = listed.select("question_id", "question", F.explode("statements").alias("statement"))
    each = each.withColumn("prompt", _prompt(VERDICT_TASK, "question", "statement"))
    verdict = F.lower(F.get(parse_reply(F.col("reply"))["verdicts"], 0))
    given = store.call(each, "prompt", judge_name, ask).select("question_id", F.coalesce(verdict == "yes", F.lit(False)).alias("relevant"))
    scores = given.groupBy("question_id").agg(F.avg(F.col("relevant").cast("int")).alias("score"))
    return listed.join(scores, "question_id", "left").withColumn("success", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def _prompt(task: str, *columns: str) -> Column:
    return F.concat(F.lit(task + "\n"), F.to_json(F.struct(*columns)))


def judge(prompts: DataFrame, make_model: Callable[[], TextModel], prompt: str = "prompt") -> DataFrame:
    """Add ``judged``, the parsed reply of a judge model to each prompt."""
    return prompts.withColumn("judged", parse_reply(complete_column(make_model, F.col(prompt))))


def judged_scores(judged: DataFrame, threshold: float = 0.5, yes: str = "yes") -> DataFrame:
    """Add ``score``, the share of a reply's verdicts that are ``yes``, and ``success``.

    A reply without verdicts has a null score and no success.
    """
    verdicts = F.col("judged.verdicts")
    agreed = F.size(F.filter(verdicts, lambda v: F.lower(v) == yes))
    score = F.when(F.size(verdicts) > 0, agreed / F.size(verdicts))
    return judged.withColumn("score", score).withColumn("success", F.coalesce(F.col("score") >= threshold, F.lit(False)))


def judge_answers(
    items: DataFrame,
    retriever: Retriever,
    make_judge: Callable[[], TextModel],
    instruction: str,
    make_model: Callable[[], TextModel] | None = None,
    threshold: float = 0.5,
) -> DataFrame:
    """Answers of all items judged case by case: ``question_id, question, answer, judged, score, success``.

    The judge reads the instruction, the question, the answer and its contexts.
    """
    table = evaluation_table(items, retriever, make_model)
    case = F.concat_ws(
        "\n\n", F.lit(instruction), F.col("question"), F.col("answer"), F.array_join("contexts", "\n\n")
    )
    judged = judge(table.withColumn("prompt", case), make_judge)
    return judged_scores(judged, threshold).drop("prompt", "contexts", "ground_truth")


def relevancy_scores(table: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """Answer relevancy per question.

    The lines of the answer stand in for the questions that a model would generate from it.
    """
    # The question is embedded before its answer becomes many lines.
    asked = table.select(
        "question_id", embed_column(make_embedder, F.col("question")).alias("question_vector"), nonblank_lines(F.col("answer")).alias("lines")
    )
    generated = asked.select("question_id", "question_vector", F.explode("lines").alias("line"))
    return answer_relevancy(generated.withColumn("generated_vector", embed_column(make_embedder, F.col("line"))), "question_id")


def faithfulness_scores(table: DataFrame) -> DataFrame:
    """Faithfulness per question: the share of the answer's lines that its own contexts support.

    A line counts as supported when the contexts have all its words, a lexical stand-in for a judge's
    verdicts.  An answer without lines has no row.
    """
    counted = table.select("question_id", _supported(F.col("answer"), F.col("contexts")).alias("share"))
    return counted.where("share.n > 0").select("question_id", (F.col("share.yes") / F.col("share.n")).alias("faithfulness"), F.col("share.n").cast("long").alias("n_statements"))


def _supported(answer: Column, contexts: Column) -> Column:
    """``STRUCT<n, yes>``: an answer's lines, and how many of them have only words of its contexts.

    Both are found within the row: beside an explode, Spark would look for the contexts' words again for
    every line.  The one-element array names the words, so that they are found once.
    """
    def count(known: Column) -> Column:
        lines = F.transform(nonblank_lines(answer), lambda line: F.size(F.array_except(distinct_words(line), known)) == 0)
        total = F.struct(F.lit(0).alias("n"), F.lit(0).alias("yes"))
        return F.aggregate(lines, total, lambda t, good: F.struct((t["n"] + 1).alias("n"), (t["yes"] + good.cast("int")).alias("yes")))

    return F.transform(F.array(F.array_distinct(F.flatten(F.transform(contexts, words)))), count)[0]


def correctness_scores(table: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """Answer correctness per question, with word overlap in place of statement verdicts."""
    vectors = table.select(
        "question_id",
        word_f1(F.col("answer"), F.col("ground_truth")).alias("f1"),
        embed_column(make_embedder, F.col("answer")).alias("answer_vector"),
        embed_column(make_embedder, F.col("ground_truth")).alias("truth_vector"),
    )
    similarity = cosine(F.col("answer_vector"), F.col("truth_vector"))
    return vectors.select(
        "question_id",
        "f1",
        similarity.alias("similarity"),
        answer_correctness(F.col("f1"), similarity).alias("answer_correctness"),
    )


def all_scores(table: DataFrame, make_embedder: Callable[[], Embedder]) -> DataFrame:
    """``question_id, faithfulness, answer_relevancy, answer_correctness``, as the functions above give
    them, in one pass over the answers and with one shuffle; null where one of them has no row."""
    similarity = cosine(F.col("answer_vector"), F.col("truth_vector"))
    answers = table.select(
        "question_id",
        nonblank_lines(F.col("answer")).alias("lines"),
        _supported(F.col("answer"), F.col("contexts")).alias("share"),
        word_f1(F.col("answer"), F.col("ground_truth")).alias("f1"),
        embed_column(make_embedder, F.col("question")).alias("question_vector"),
        embed_column(make_embedder, F.col("answer")).alias("answer_vector"),
        embed_column(make_embedder, F.col("ground_truth")).alias("truth_vector"),
    )
    scored = answers.select("question_id", "lines", "share", "question_vector", answer_correctness(F.col("f1"), similarity).alias("answer_correctness"))
    lines = scored.select("question_id", "share", "question_vector", "answer_correctness", F.explode_outer("lines").alias("line"))
    lines = lines.withColumn("line_vector", embed_column(make_embedder, F.coalesce("line", F.lit(""))))
    relevancy = F.when(F.col("line").isNotNull(), cosine(F.col("question_vector"), F.col("line_vector")))
    share = F.first("share")
    return lines.groupBy("question_id").agg(
        F.when(share["n"] > 0, share["yes"] / share["n"]).alias("faithfulness"),
        F.avg(relevancy).alias("answer_relevancy"),
        F.first("answer_correctness").alias("answer_correctness"),
    )
