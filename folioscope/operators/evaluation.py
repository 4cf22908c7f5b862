"""Scores of answers: means over verdicts, and similarity of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions.text import distinct_words
from folioscope.functions.vectors import cosine


def ground_truth(items: DataFrame) -> DataFrame:
    """Questions with their true answer, under either of its two names."""
    names = [n for n in ("ground_truth", "answer") if n in items.columns]
    if not names:
        raise ValueError("no ground_truth or answer column")
    return items.select("question", F.coalesce(*names).alias("ground_truth"))


def mean_score(scores: DataFrame, *keys: str, score: str = "score") -> DataFrame:
    """Mean score per key, or over everything; null when there is nothing to average."""
    return scores.groupBy(*keys).agg(
        F.avg(F.col(score).cast("double")).alias("mean_score"), F.count(F.lit(1)).alias("n_results")
    )


def faithfulness(verdicts: DataFrame, *keys: str, supported: str = "supported") -> DataFrame:
    """Share of the statements of an answer that its contexts support."""
    return verdicts.groupBy(*keys).agg(
        F.avg(F.col(supported).cast("double")).alias("faithfulness"),
        F.count(F.lit(1)).alias("n_statements"),
    )


def answer_relevancy(generated: DataFrame, *keys: str) -> DataFrame:
    """Mean cosine between the question and the questions generated from its answer.

    ``generated`` has one row per generated question, with the vectors ``question_vector``
    and ``generated_vector``.
    """
    return generated.groupBy(*keys).agg(
        F.avg(cosine(F.col("question_vector"), F.col("generated_vector"))).alias("answer_relevancy")
    )


def relevant_share(verdicts: DataFrame, *keys: str, relevant: str = "relevant") -> DataFrame:
    """Share of the statements of an answer that bear on the question."""
    return verdicts.groupBy(*keys).agg(
        F.avg(F.col(relevant).cast("double")).alias("answer_relevancy")
    )


def statement_f1(true_positive: Column, false_positive: Column, false_negative: Column) -> Column:
    errors = (false_positive + false_negative) / 2
    return F.when(true_positive > 0, true_positive / (true_positive + errors)).otherwise(F.lit(0.0))


def answer_correctness(
    f1: Column, similarity: Column, weights: tuple[float, float] = C.CORRECTNESS_WEIGHTS
) -> Column:
    """Weighted mean of the factual F1 and the semantic similarity."""
    factual, semantic = weights
    return (F.lit(factual) * f1 + F.lit(semantic) * similarity) / (factual + semantic)


def word_f1(answer: Column, truth: Column) -> Column:
    """F1 over distinct words; the offline stand-in for a judge's statement verdicts."""
    given, wanted = distinct_words(answer), distinct_words(truth)
    common = F.size(F.array_intersect(given, wanted))
    return statement_f1(common, F.size(given) - common, F.size(wanted) - common)
