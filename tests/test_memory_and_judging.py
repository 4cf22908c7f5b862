import hashlib
import json

import pytest
from pyspark.sql import functions as F

from folioscope.models.calls import CallStore
from folioscope.models.columns import complete_column
from folioscope.models.hashing import HashingEmbedder
from folioscope.models.offline import LineJudge
from folioscope.plans.evaluate import STATEMENTS_TASK, judge_relevancy, remembering_table
from folioscope.plans import replay as replays
from folioscope.plans.replay import remembered, replay
from folioscope.plans.retrieve import text_retriever
from folioscope.session import fresh_folder


class Counting:
    """Numbers its calls in a folder that the test reads."""

    def __init__(self, folder):
        self.folder = folder

    def complete(self, prompt):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return f"<{prompt}>"


class Parrot:
    """Says how many replies its prompt already has, and the last word of the question."""

    def complete(self, prompt):
        return f"reply {prompt.count('Assistant:')}"


def test_each_distinct_text_is_asked_once(spark, tmp_path):
    folder = str(tmp_path)
    store = CallStore(spark, fresh_folder(spark, "test-calls"))
    ask = lambda text: complete_column(lambda: Counting(folder), text)
    rows = spark.createDataFrame([(i, None if i % 7 == 0 else f"t{i % 5}") for i in range(70)], "id long, text string").repartition(6)
    first = store.call(rows, "text", "m", ask)
    assert {(r["text"], r["reply"]) for r in first.collect()} == {(f"t{i}", f"<t{i}>") for i in range(5)} | {(None, None)}
    assert first.count() == 70 and len(list(tmp_path.iterdir())) == 5
    more = rows.unionAll(spark.createDataFrame([(100, "new")], "id long, text string"))
    again = store.call(more, "text", "m", ask)
    assert again.where("text = 'new'").first()["reply"] == "<new>"
    # Both results in one plan: the later call must not see the earlier state of the store.
    assert first.select("reply").unionAll(again.select("reply")).where("reply is not null").count() == 60 + 61
    assert len(list(tmp_path.iterdir())) == 6
    store.call(rows, "text", "other", ask).count()
    assert len(list(tmp_path.iterdir())) == 11
    assert store.call(rows.where("false"), "text", "m", ask).count() == 0


def test_memory_drops_the_oldest(spark):
    row = spark.range(1).select(F.array(F.lit("aaaa"), F.lit("bbb"), F.lit("c")).alias("m"))
    kept = lambda new, limit: row.select(remembered(F.col("m"), F.lit(new), limit)).first()[0]
    assert kept("dd", 100) == ["aaaa", "bbb", "c", "dd"]
    assert kept("dd", 6) == ["bbb", "c", "dd"]
    # Nothing older than what does not fit, even if it were short enough.
    assert kept("dd", 5) == ["c", "dd"] and kept("dddddd", 3) == ["dddddd"]


@pytest.fixture(scope="module")
def retriever(spark):
    texts = spark.createDataFrame([("a", "owls hunt at night"), ("b", "fish swim"), ("c", "bees fly by day")], "id string, text string")
    return text_retriever(texts, lambda: HashingEmbedder(32), k=1)


def test_replay_carries_its_own_replies(spark, retriever):
    rows = [
        ("s", 0, "user", "who hunts at night"), ("s", 1, "assistant", "recorded, not used"), ("s", 2, "user", "who can swim"),
        ("s", 5, "user", "who flies"), ("t", 3, "assistant", "no question"), ("t", 4, "user", "fish"), (None, 0, "user", None),
    ]
    messages = spark.createDataFrame(rows, "session_id string, turn long, role string, text string")
    got = {(r["session_id"], r["round"]): r for r in replay(messages, retriever, lambda: Parrot()).collect()}
    assert set(got) == {("s", 0), ("s", 1), ("s", 2), ("t", 0), (None, 0)}
    # The template itself may name the assistant, so replies are counted from the first prompt.
    base = got["t", 0]["prompt"].count("Assistant:")
    assert [got["s", i]["answer"] for i in range(3)] == [f"reply {base + i}" for i in range(3)]
    last = got["s", 2]["prompt"]
    assert "Human: who hunts at night" in last and f"Assistant: reply {base + 1}" in last and "recorded" not in last
    assert got["s", 2]["turn"] == 5 and "who hunts" not in got["t", 0]["prompt"]
    short = {(r["session_id"], r["round"]): r for r in replay(messages, retriever, lambda: Parrot(), memory_chars=1).collect()}
    assert "who hunts" not in short["s", 2]["prompt"] and "who can swim" in short["s", 2]["prompt"]
    assert replay(messages.where("false"), retriever).count() == 0


def test_evaluation_with_memory(spark, retriever):
    items = spark.createDataFrame([(1, "who hunts", "owls"), (2, "who swims", "fish"), (3, "who flies", "bees")], "question_id long, question string, ground_truth string")
    rows = {r["question_id"]: r for r in remembering_table(items, retriever).collect()}
    assert "who hunts" in rows[3]["prompt"] and "who swims" in rows[3]["prompt"] and "who swims" not in rows[1]["prompt"]
    assert rows[2]["ground_truth"] == "fish" and len(rows) == 3


def test_two_step_judging(spark, tmp_path):
    class Judge(LineJudge):
        def complete(self, prompt):
            Counting(str(tmp_path)).complete(prompt)
            return super().complete(prompt)

    answered = spark.createDataFrame(
        [(1, "where do owls live", "Owls live in trees.\n\nThe sky is blue."), (2, "where do owls live", "nothing"), (3, "x", ""), (4, "where do owls live", "Owls live in trees.\n\nThe sky is blue.")],
        "question_id long, question string, answer string",
    )
    store = CallStore(spark, fresh_folder(spark, "test-judge"))
    rows = {r["question_id"]: r for r in judge_relevancy(answered, Judge, store, "lines").collect()}
    assert (rows[1]["score"], rows[1]["success"], rows[1]["statements"]) == (0.5, True, ["Owls live in trees.", "The sky is blue."])
    assert (rows[2]["score"], rows[2]["success"]) == (0.0, False)
    assert (rows[3]["score"], rows[3]["success"], rows[3]["statements"]) == (None, False, [])
    assert rows[4]["score"] == 0.5
    # Three distinct answers and three distinct statements with their question.
    assert len(list(tmp_path.iterdir())) == 6


def test_offline_judge_reads_the_last_line():
    judge = LineJudge()
    asked = STATEMENTS_TASK + "\n" + json.dumps({"answer": " one \n\n two"})
    assert json.loads(judge.complete(asked)) == {"statements": ["one", "two"]}
    assert json.loads(judge.complete("x\n" + json.dumps({"question": "A b", "statement": "c B"}))) == {"verdicts": ["yes"]}
    assert json.loads(judge.complete("x\n{}")) == {"statements": []}


def test_replay_searches_once_and_without_a_model_needs_no_rounds(spark, retriever):
    class Once:
        calls = 0

        def retrieve(self, questions):
            Once.calls += 1
            return retriever.retrieve(questions)

    class Echo:
        """Replies as the stand-in does, from the context in the prompt."""

        def complete(self, prompt):
            return prompt.split("CONTEXT:")[-1].split("---")[0].strip() if "CONTEXT:" in prompt else ""

    rows = [(s, t, "user", "who hunts at night " * (1 + t % 3)) for s in ("s", "t") for t in range(9)] + [(None, 0, "user", None), (None, 4, "user", "fish")]
    messages = spark.createDataFrame(rows, "session_id string, turn long, role string, text string")
    assert replay(messages, Once(), lambda: Echo()).count() == len(rows) and Once.calls == 1
    plain = {}
    for limit in (1, 90, 200, 1 << 20):
        Once.calls = 0
        got = replay(messages, Once(), memory_chars=limit).collect()
        assert Once.calls == 1 and len(got) == len(rows)
        for session in ("s", "t", None):
            memory = []
            for r in sorted((r for r in got if r["session_id"] == session), key=lambda r: r["round"]):
                history = "".join(memory)
                assert history in r["prompt"] and r["prompt"].count("\nHuman: ") == history.count("\nHuman: ")
                memory.append(f"\nHuman: {r['question']}\nAssistant: {r['answer']}")
                while len(memory) > 1 and sum(map(len, memory)) > limit:
                    memory.pop(0)
        plain[limit] = got
    assert all(len(plain[1 << 20]) == len(v) for v in plain.values())


def test_replay_remembers_all_and_hashes_whole_prompts(spark, retriever, monkeypatch):
    """Memories beyond the former limit of a million characters are whole, as texts and as hashes."""
    long = "who hunts at night " + "x" * 400_000
    rows = [("s", t, "user", f"{long} {t}") for t in range(7)] + [("t", t, "user", "fish") for t in range(2)]
    rows += [(None, 0, "user", None), (None, 4, "user", "bees")]
    messages = spark.createDataFrame(rows, "session_id string, turn long, role string, text string").repartition(3)
    told = replay(messages, retriever).collect()
    prompts = {(r["session_id"], r["round"]): (r["turn"], r["prompt"], r["answer"]) for r in told}
    for session, n in (("s", 7), ("t", 2), (None, 2)):
        memory = ""
        for r in sorted((r for r in told if r["session_id"] == session), key=lambda r: r["round"]):
            assert memory in r["prompt"] and r["prompt"].count("\nHuman: ") == r["round"]
            memory += f"\nHuman: {r['question']}\nAssistant: {r['answer']}"
        assert r["round"] == n - 1
    # In pages of two questions, later pages get the exchanges of earlier ones.
    for page in (1024, 2):
        monkeypatch.setattr(replays, "PAGE_ROUNDS", page)
        got = replay(messages, retriever, hashed=True).collect()
        hashed = {key: (turn, hashlib.sha256(prompt.encode()).hexdigest(), answer) for key, (turn, prompt, answer) in prompts.items()}
        assert len(got) == len(rows) and {(r["session_id"], r["round"]): (r["turn"], r["prompt_hash"], r["answer"]) for r in got} == hashed
    assert replay(messages.where("false"), retriever, hashed=True).count() == 0
