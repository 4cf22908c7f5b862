"""Command line: ingest a folder, describe a collection, ask, chat, evaluate, judge.

The collection name comes from the configuration file or ``COLLECTION_NAME``.  With
``EMBEDDING_API_URL`` set, vectors come from that service; with ``CHAT_API_URL`` and
``CHAT_API_KEY`` set, summaries and answers come from that model.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.config import Config, load_config, require_env
from folioscope.functions.text import three_decimals
from folioscope.models.calls import CallStore
from folioscope.models.hashing import HashingEmbedder
from folioscope.models.offline import LineJudge
from folioscope.models.remote import RemoteEmbedder, answer_model, judge_model, summary_model
from folioscope.operators.evaluation import ground_truth, mean_score
from folioscope.plans.answer import answer, chat_turns
from folioscope.plans.evaluate import correctness_scores, evaluation_table, faithfulness_scores, judge_relevancy, relevancy_scores
from folioscope.plans.ingest import ingest
from folioscope.plans.retrieve import naive_retriever, reranked_retriever
from folioscope.session import stored
from folioscope.sources.files import pdf_parser, read_questions, scan_folder, text_parser
from folioscope.sources.index import Collection, collection_status

CHAT_SETTINGS = ("CHAT_API_URL", "CHAT_API_KEY")


def _embedder(env: Mapping[str, str], size: int) -> Callable:
    url = env.get("EMBEDDING_API_URL")
    return (lambda: RemoteEmbedder(url, size)) if url else (lambda: HashingEmbedder(size))


def _model(env: Mapping[str, str], config: Config, build: Callable) -> Callable | None:
    """A model factory, nothing when no chat service is set, an error when it is half set."""
    if not any(env.get(name) for name in CHAT_SETTINGS):
        return None
    url, key = require_env(CHAT_SETTINGS, env).values()
    return lambda: build(url, key, config)


def _evaluate(table: DataFrame, make_embedder: Callable) -> DataFrame:
    """Mean of each metric over all questions."""
    table = stored(table, "evaluation")
    metrics = {
        "faithfulness": faithfulness_scores(table),
        "answer_relevancy": relevancy_scores(table, make_embedder),
        "answer_correctness": correctness_scores(table, make_embedder),
    }
    means = [
        mean_score(scores, score=name).select(
            F.lit(name).alias("metric"), three_decimals(F.col("mean_score")).alias("mean"), "n_results"
        )
        for name, scores in metrics.items()
    ]
    return reduce(DataFrame.unionByName, means)


def _judge(answered: DataFrame, make_judge: Callable | None, config: Config, store: CallStore) -> DataFrame:
    """Each answer's statements and score, and the mean over all."""
    name = "lines" if make_judge is None else config.judge.model
    judged = stored(judge_relevancy(answered, make_judge or LineJudge, store, name), "judged")
    mean = mean_score(judged).first()["mean_score"]
    return judged.select("question", "answer", "score", "success", "statements", F.lit(mean).cast("double").alias("mean_score"))


def main(arguments: list[str] | None = None, env: Mapping[str, str] | None = None) -> DataFrame | str:
    env = os.environ if env is None else env
    parser = argparse.ArgumentParser(prog="folioscope", description=__doc__.splitlines()[0])
    parser.add_argument("--config", help="YAML configuration file")
    parser.add_argument("--vector-size", type=int, default=Collection.vector_size)
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("ingest", "info", "ask", "chat", "evaluate", "judge"):
        commands.add_parser(name).add_argument("index", help="folder of the collections")
    commands.choices["ingest"].add_argument("folder", help="folder of files")
    commands.choices["ingest"].add_argument("--text", action="store_true", help="text files instead of PDF files")
    commands.choices["ask"].add_argument("question", nargs="+")
    commands.choices["chat"].add_argument("messages", help="JSON lines of session_id, turn, role and text")
    for name in ("evaluate", "judge"):
        commands.choices[name].add_argument("questions", help="JSON file of questions and true answers")
    given = parser.parse_args(arguments)

    config = load_config(given.config, env)
    spark = SparkSession.builder.appName("folioscope").getOrCreate()
    collection = Collection(spark, given.index, config.collection, given.vector_size)
    embedder = _embedder(env, given.vector_size)

    if given.command == "ingest":
        suffix, parse = (".txt", text_parser) if given.text else (".pdf", pdf_parser)
        return ingest(
            scan_folder(spark, given.folder, suffix),
            collection,
            parse,
            embedder,
            _model(env, config, summary_model),
        )
    if given.command == "info":
        return collection_status(collection)
    replies = _model(env, config, answer_model)
    if given.command == "ask":
        asked = spark.createDataFrame(list(enumerate(given.question)), "question_id int, question string")
        answered = answer(asked, reranked_retriever(collection, embedder), replies)
        return answered.select("question", "answer", "references")
    if given.command == "chat":
        messages = spark.read.schema("session_id string, turn long, role string, text string").json(given.messages)
        return chat_turns(messages, reranked_retriever(collection, embedder), replies)
    items = ground_truth(read_questions(spark, given.questions)).withColumn(
        "question_id", F.sha2("question", 256)
    )
    if given.command == "judge":
        answered = evaluation_table(items, reranked_retriever(collection, embedder), replies)
        return _judge(answered, _model(env, config, judge_model), config, CallStore(spark, f"{given.index}/model-calls"))
    return _evaluate(evaluation_table(items, naive_retriever(collection, embedder), replies), embedder)


if __name__ == "__main__":
    result = main()
    print(result) if isinstance(result, str) else result.show(truncate=False)
