from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.config import Config, ModelConfig, load_config, require_env
from folioscope.models.columns import complete_column, embed_column, first_working, summary_column
from folioscope.models.remote import (
    ChatModel,
    FeatureExtractionEmbedder,
    RemoteEmbedder,
    answer_model,
    judge_model,
    summary_model,
)
from folioscope.session import work_folder


def test_remote_embedder_calls_the_service_once_per_text():
    calls = []

    def post(url, body, headers, timeout):
        calls.append((url, body, timeout))
        return {"embedding": [float(len(body["text"])), 1.0]}

    embedder = RemoteEmbedder("http://host/api//", size=2, post=post)
    assert embedder.embed(["a", "bcd"]) == [[1.0, 1.0], [3.0, 1.0]]
    assert calls[0] == ("http://host/api/embed", {"text": "a"}, 10)


def test_feature_extraction_embedder():
    seen = {}

    def post(url, body, headers, timeout):
        seen.update(url=url, headers=headers)
        return [1.0]

    assert FeatureExtractionEmbedder("http://host", "org/model", "secret", post=post).embed(["x"]) == [[1.0]]
    assert seen == {"url": "http://host/org/model", "headers": {"Authorization": "Bearer secret"}}


def test_chat_model_request():
    seen = {}

    def post(url, body, headers, timeout):
        seen.update(body=body, timeout=timeout)
        return {"choices": [{"message": {"content": " done \n"}}]}

    model = ChatModel("http://host", "key", Config().summary, C.SUMMARY_SYSTEM_MESSAGE, post)
    assert model.complete("text") == "done"
    assert seen["timeout"] == 60
    assert seen["body"] == {
        "model": "llama-3.3-70b-versatile",
        "messages": [
            {"role": "system", "content": C.SUMMARY_SYSTEM_MESSAGE},
            {"role": "user", "content": "text"},
        ],
        "temperature": 0.3,
        "max_tokens": 256,
    }
    with pytest.raises(ValueError):
        ChatModel("http://host", "", ModelConfig())


def test_every_role_has_its_own_settings():
    bodies = []

    def post(url, body, headers, timeout):
        bodies.append(body)
        return {"choices": [{"message": {"content": "x"}}]}

    for build in (summary_model, answer_model, judge_model):
        build("http://host", "key", Config(), post).complete("p")
    assert [(b["temperature"], b.get("max_tokens"), len(b["messages"])) for b in bodies] == [
        (0.3, 256, 2),
        (0.5, None, 1),
        (0.0, 2048, 1),
    ]


class FakeSession:
    """The two settings that decide on the work folder."""

    def __init__(self, master, shared):
        self._shared = shared
        self.sparkContext = SimpleNamespace(
            master=master, applicationId="app-7", getConf=lambda: SimpleNamespace(get=lambda _key: None)
        )
        self.conf = SimpleNamespace(get=lambda _key, default: self._shared or default)


def test_work_folder_is_the_shared_one():
    assert work_folder(FakeSession("yarn", "hdfs:///shared/")) == "hdfs:///shared/folioscope-app-7"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(FakeSession("yarn", None))
    own = work_folder(FakeSession("local[2]", None))
    assert own == work_folder(FakeSession("local[2]", None)) and "folioscope-" in own


class Sometimes:
    """Fails for some chunks."""

    def complete(self, prompt):
        if "bad" in prompt:
            raise RuntimeError("service down")
        return prompt.removeprefix(C.SUMMARY_USER_PREFIX).upper()


def test_summary_falls_back_for_failed_calls_only(spark):
    frame = spark.createDataFrame([("good",), ("bad" * 100,)], "text string")
    got = [r[0] for r in frame.select(summary_column(F.col("text"), Sometimes)).collect()]
    assert got == ["GOOD", ("bad" * 100)[:200] + "..."]


def test_model_that_cannot_be_built_stops_the_job(spark):
    def build():
        raise ValueError("no key")

    frame = spark.createDataFrame([("x",)], "text string")
    with pytest.raises(Exception, match="no key"):
        frame.select(summary_column(F.col("text"), build)).collect()


def test_failed_answers_fail_the_job(spark):
    frame = spark.createDataFrame([("bad",)], "text string")
    with pytest.raises(Exception, match="service down"):
        frame.select(complete_column(Sometimes, F.col("text"))).collect()


def test_one_client_per_partition_and_one_call_per_text(spark):
    built, called = spark.sparkContext.accumulator(0), spark.sparkContext.accumulator(0)

    class Counting:
        size = 2

        def __init__(self):
            built.add(1)

        def embed(self, texts):
            called.add(len(texts))
            return [np.array([1, 2]) for _ in texts]

    frame = spark.range(100, numPartitions=4).select(F.col("id").cast("string").alias("text"))
    vectors = frame.select("text", embed_column(Counting, F.col("text")).alias("v"))
    exploded = vectors.select("text", F.explode("v").alias("x")).where(F.col("x") > 1)
    assert exploded.count() == 100
    assert (built.value, called.value) == (4, 100)


def test_first_working_model():
    tried = []

    def attempt(name):
        tried.append(name)
        if name != C.EMBEDDING_MODELS[-1]:
            raise RuntimeError("not available")
        return "ok"

    assert first_working(C.EMBEDDING_MODELS, attempt) == "ok"
    assert tuple(tried) == C.EMBEDDING_MODELS
    with pytest.raises(ValueError, match="any of the specified models"):
        first_working(["a"], attempt)


def test_config_file_and_environment(tmp_path):
    path = tmp_path / "config.yaml"
    path.write_text("collection: 'c1'\nservice:\n  summarization_model: 'm'\n  temperature: 0.1\n  max_tokens: 9\n")
    config = load_config(str(path), env={})
    assert config.collection == "c1"
    assert config.summary == ModelConfig("m", 0.1, 9)
    assert config.answer.temperature == 0.5 and config.judge.max_tokens == 2048
    assert load_config(str(path), env={"COLLECTION_NAME": "c2"}).collection == "c2"
    assert load_config(None, env={}) == Config()


def test_required_environment():
    assert require_env(["A"], env={"A": "1", "B": "2"}) == {"A": "1"}
    with pytest.raises(ValueError, match="A, B"):
        require_env(["A", "B"], env={"A": "1", "B": ""})


def test_calls_are_tried_again_after_overload(monkeypatch):
    import urllib.error

    from folioscope.models import remote

    codes, pauses = [503, 429], []

    def once(url, body, headers, timeout):
        if codes:
            raise urllib.error.HTTPError(url, codes.pop(0), "busy", None, None)
        return {"ok": body}

    monkeypatch.setattr(remote, "_post_once", once)
    monkeypatch.setattr(remote.time, "sleep", pauses.append)
    assert remote.post_json("u", {"a": 1}, {}, 1) == {"ok": {"a": 1}}
    assert pauses == [1.0, 2.0]
    codes[:] = [404]
    with pytest.raises(urllib.error.HTTPError):
        remote.post_json("u", {}, {}, 1)
    codes[:] = [500] * 4
    with pytest.raises(urllib.error.HTTPError):
        remote.post_json("u", {}, {}, 1)


def test_hosted_reranker_scores_a_question_in_one_call(spark):
    from folioscope.models.remote import RemoteReranker
    from folioscope.operators.answers import rerank

    def post(url, body, headers, timeout):
        order = sorted(range(len(body["documents"])), key=lambda i: -len(body["documents"][i]))
        return {"results": [{"index": i, "relevance_score": len(body["documents"][i]) / 100} for i in order]}

    schema = "question_id int, rank int, text string, source string, page string, page_content string"
    documents = spark.createDataFrame([(q, r, "x" * (r * 3 % 7), "f", "1", "c") for q in (1, 2) for r in range(1, 6)], schema)
    questions = spark.createDataFrame([(1, "a"), (2, "b")], "question_id int, question string")
    best = rerank(documents, questions, top_n=2, make_client=lambda: RemoteReranker("u", "m", "t", post)).collect()
    assert sorted((r["question_id"], r["position"], r["rank"], r["rerank_score"]) for r in best) == [
        (q, p, r, s) for q in (1, 2) for p, r, s in ((1, 2, 0.06), (2, 4, 0.05))
    ]


def test_vectors_are_made_in_small_slices(spark):
    """However many texts a batch has, and however long they are, few are taken at a time."""
    most = spark.sparkContext.accumulator(0)

    class Largest:
        def embed(self, texts):
            texts = list(texts)
            if len(texts) > 512 or (len(texts) > 1 and sum(len(t or "") for t in texts) > 8 << 20):
                most.add(1)
            return [np.array([len(t or ""), 1.0]) for t in texts]

    long = F.when(F.col("id") < 3000, F.repeat(F.lit("x"), 10_000)).when(F.col("id") % 7 > 0, F.col("id").cast("string"))
    frame = spark.range(0, 8000, numPartitions=1).select("id", long.alias("text"))
    vectors = frame.select("id", F.coalesce(F.length("text"), F.lit(0)).alias("n"), embed_column(Largest, F.col("text")).alias("v"))
    assert vectors.where((F.size("v") == 2) & (F.col("v")[0] == F.col("n"))).count() == 8000
    assert most.value == 0
    assert frame.where("id < 0").select(embed_column(Largest, F.col("text"))).count() == 0
