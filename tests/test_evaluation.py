import json

import pytest
from pyspark.sql import functions as F

from folioscope.functions.judge import chat_content, embedding_values, is_json, parse_reply
from folioscope.operators import evaluation as E
from folioscope.plans.evaluate import judge

REPLIES = [
    '{"statements": ["a", "b"], "verdicts": ["yes", "no"]}',
    ' {"statements": ["a"], "verdicts": "yes"} ',
    '{"verdicts": [{"verdict": "yes"}, 1]}',
    '["a", "b"]',
    "[]",
    "42",
    '"text"',
    "null",
    "true",
    "{'statements': ['a']}",
    '{"statements": ["a"]} and more',
    '["a"], ["b"]',
    "1, 2",
    '["a"',
    "plain\n\n  lines of text \n",
    "",
    " \n ",
    "{}",
    "1] [2",
    '["a"]] trailing',
    '{"statements": ["a"]}]',
    '"x", "y"]',
    '"unclosed',
    '["tab\there"]',
    '["raw\nnewline"]',
    "01",
    "1.",
    '{"statements": ["a",]}',
    '["\\u00e9", "😀"]',
    '{"statements": []}',
    '[["nested"], {"b": [1, 2]}]',
]


def expected(reply):
    content = reply.strip()
    try:
        value = json.loads(content)
    except json.JSONDecodeError:
        return content, [line.strip() for line in content.split("\n") if line.strip()], []
    statements, verdicts = [], []
    if isinstance(value, dict):
        statements = value.get("statements", [])
        if isinstance(value.get("verdicts"), list):
            verdicts = [v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for v in value["verdicts"]]
    elif isinstance(value, list):
        statements = [v if isinstance(v, str) else json.dumps(v, separators=(",", ":")) for v in value]
    return content, statements, verdicts


def test_judge_replies_of_every_shape(spark):
    frame = spark.createDataFrame(list(enumerate(REPLIES)), "n int, reply string")
    rows = frame.select("n", parse_reply(F.col("reply")).alias("j")).collect()
    for row in rows:
        got = (row["j"]["output"], row["j"]["statements"], row["j"]["verdicts"])
        assert got == expected(REPLIES[row["n"]]), REPLIES[row["n"]]


def test_json_is_strict(spark):
    frame = spark.createDataFrame([(r,) for r in REPLIES], "t string")
    for text, valid in frame.select("t", is_json(F.trim("t"))).collect():
        try:
            json.loads(text)
            assert valid, text
        except json.JSONDecodeError:
            assert not valid, text


def test_judge_model(spark):
    class Judge:
        def complete(self, prompt):
            return json.dumps({"statements": prompt.split(), "verdicts": ["yes"]})

    prompts = spark.createDataFrame([("one two",)], "prompt string")
    judged = judge(prompts, Judge).first()["judged"]
    assert judged["statements"] == ["one", "two"] and judged["verdicts"] == ["yes"]


def test_service_responses(spark):
    frame = spark.createDataFrame(
        [('{"choices": [{"message": {"content": "hi"}}]}', '{"embedding": [1, 2.5]}')], "chat string, embed string"
    )
    row = frame.select(chat_content(F.col("chat")), embedding_values(F.col("embed"))).first()
    assert tuple(row) == ("hi", [1.0, 2.5])


def test_mean_of_nothing_is_null(spark):
    scores = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 0.5)], "q string, score double")
    assert E.mean_score(scores).first()["mean_score"] == 0.5
    assert {r["q"]: r["mean_score"] for r in E.mean_score(scores, "q").collect()} == {"a": 0.5, "b": 0.5}
    nothing = E.mean_score(scores.where(F.lit(False))).first()
    assert nothing["mean_score"] is None and nothing["n_results"] == 0


def test_faithfulness_and_relevant_share(spark):
    verdicts = spark.createDataFrame([(1, True, 1), (1, False, 1), (2, True, 0)], "q int, supported boolean, relevant int")
    assert {r["q"]: r["faithfulness"] for r in E.faithfulness(verdicts, "q").collect()} == {1: 0.5, 2: 1.0}
    assert {r["q"]: r["answer_relevancy"] for r in E.relevant_share(verdicts, "q").collect()} == {1: 1.0, 2: 0.0}


def test_relevancy_is_the_mean_cosine(spark):
    rows = [(1, [1.0, 0.0], [2.0, 0.0]), (1, [1.0, 0.0], [0.0, 3.0])]
    frame = spark.createDataFrame(rows, "q int, question_vector array<float>, generated_vector array<float>")
    assert E.answer_relevancy(frame, "q").first()["answer_relevancy"] == pytest.approx(0.5)


def test_correctness(spark):
    frame = spark.createDataFrame([("the red owl", "the owl flies"), ("", "x"), ("a", "b")], "answer string, truth string")
    f1 = [r[0] for r in frame.select(E.word_f1(F.col("answer"), F.col("truth"))).collect()]
    assert f1 == [pytest.approx(2 / 3), 0.0, 0.0]
    both = spark.range(1).select(E.answer_correctness(F.lit(0.4), F.lit(0.8))).first()[0]
    assert both == pytest.approx(0.75 * 0.4 + 0.25 * 0.8)
    other = spark.range(1).select(E.answer_correctness(F.lit(0.4), F.lit(0.8), (1.0, 1.0))).first()[0]
    assert other == pytest.approx(0.6)


def test_repeated_keys_and_unsupported_lines(spark):
    from pyspark.sql import functions as F

    from folioscope.plans.evaluate import faithfulness_scores

    reply = spark.createDataFrame([('{"statements": ["x"], "a": 1, "a": 2}',)], "r string").select(parse_reply(F.col("r")).alias("p"))
    assert reply.first()["p"]["statements"] == ["x"]
    table = spark.createDataFrame(
        [(1, "The river.\n\nThe sea", ["the river [1]"]), (2, "", ["x"])], "question_id int, answer string, contexts array<string>"
    )
    assert [tuple(r) for r in faithfulness_scores(table).collect()] == [(1, 0.5, 2)]


def test_judged_answers(spark):
    from folioscope.plans.evaluate import judged_scores

    frame = spark.createDataFrame(
        [(1, ["yes", "no", "Yes"]), (2, []), (3, ["no"])], "question_id int, verdicts array<string>"
    ).selectExpr("question_id", "named_struct('verdicts', verdicts) as judged")
    got = {r["question_id"]: (r["score"], r["success"]) for r in judged_scores(frame, 0.6).collect()}
    assert got == {1: (2 / 3, True), 2: (None, False), 3: (0.0, False)}
