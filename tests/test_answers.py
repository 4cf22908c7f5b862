import pytest
from pyspark.sql import functions as F

from folioscope.models.hashing import HashingEmbedder
from folioscope.operators import answers
from folioscope.plans.answer import answer, chat_prompts, chat_turns, extractive_answer
from folioscope.plans.ingest import ingest
from folioscope.plans.retrieve import naive_retriever, reranked_retriever, text_retriever
from folioscope.session import fresh_folder
from folioscope.sources.files import text_parser
from folioscope.sources.index import Collection, collection_status

TEXTS = {
    "birds.pdf": "swallows fly south\nin autumn\fthe owl hunts at night",
    "fish.pdf": "the trout swims upstream\fsalmon return to the river they know",
    "stars.pdf": "a star cluster is a group of stars\fthe owl nebula is not a bird",
}
QUESTIONS = [(1, "what hunts at night? the owl"), (2, "{context} trout"), (3, "")]


@pytest.fixture(scope="module")
def collection(spark):
    files = spark.createDataFrame(
        [(name, name, bytearray(text.encode())) for name, text in TEXTS.items()],
        "path string, file_name string, content binary",
    )
    c = Collection(spark, fresh_folder(spark, "test-answers"), vector_size=64)
    ingest(files, c, text_parser)
    return c


@pytest.fixture
def questions(spark):
    return spark.createDataFrame(QUESTIONS, "question_id int, question string")


def test_naive_retrieval_cites_by_rank(collection, questions):
    found = naive_retriever(collection, k=2).retrieve(questions).where("question_id = 1").orderBy("position").collect()
    assert [r["position"] for r in found] == [1, 2]
    assert found[0]["page_content"] == "the owl hunts at night [1]"
    assert (found[0]["source"], found[0]["page"], found[0]["reference_number"]) == ("birds.pdf", "2", "[1]")
    assert found[0]["score"] > found[1]["score"]


def test_citation_styles(collection, questions):
    one = questions.where("question_id = 1")
    prefix = naive_retriever(collection, k=1, citation="prefix").retrieve(one).first()["page_content"]
    assert prefix == "[Source: birds.pdf, page 2]\nthe owl hunts at night"
    plain = naive_retriever(collection, k=1, citation="none").retrieve(one).first()["page_content"]
    assert plain == "the owl hunts at night"
    strict = naive_retriever(collection, k=1, strict_keys=True).retrieve(one).first()
    assert (strict["source"], strict["page"]) == ("Unknown source", "n/a")
    with pytest.raises(ValueError):
        naive_retriever(collection, citation="footnote").retrieve(one)


def test_reranking_keeps_first_numbers_unless_renumbered(collection, questions):
    def by_length(_question, text):
        return F.length(text).cast("double")

    kept = reranked_retriever(collection, k=4, top_n=2, scorer=by_length).retrieve(questions)
    rows = kept.where("question_id = 1").orderBy("position").collect()
    assert [r["position"] for r in rows] == [1, 2]
    assert len(rows[0]["text"]) >= len(rows[1]["text"])
    assert rows[0]["reference_number"] == f"[{rows[0]['rank']}]"
    again = reranked_retriever(collection, k=4, top_n=2, scorer=by_length, renumber=True).retrieve(questions)
    rows = again.where("question_id = 1").orderBy("position").collect()
    assert [r["reference_number"] for r in rows] == ["[1]", "[2]"]
    assert rows[1]["page_content"].endswith(" [2]")


def test_rerank_ties_keep_search_order(spark):
    documents = spark.createDataFrame([(1, r, "same") for r in range(1, 8)], "question_id int, rank int, text string")
    questions = spark.createDataFrame([(1, "other")], "question_id int, question string")
    kept = answers.rerank(documents, questions, top_n=3).orderBy("position").collect()
    assert [r["rank"] for r in kept] == [1, 2, 3]


def test_context_and_references(spark):
    documents = spark.createDataFrame(
        [(1, 2, "b", "f2", "3"), (1, 1, "a", None, None), (1, 10, "c", "f3", "1")],
        "question_id int, position int, page_content string, source string, page string",
    )
    row = answers.assemble(documents).first()
    assert row["context"] == "a\n\nb\n\nc"
    assert row["references"] == "[1] Unknown Source, page N/A\n[2] f2, page 3\n[3] f3, page 1"
    assert row["contexts"] == ["a", "b", "c"]


def test_answers_with_and_without_model(collection, questions):
    plain = {r["question_id"]: r for r in answer(questions, naive_retriever(collection, k=2)).collect()}
    assert plain[1]["answer"] == "the owl hunts at night [1]"
    assert "{context} trout" in plain[2]["prompt"] and plain[2]["prompt"].count("trout swims") == 1
    assert len(plain[3]["contexts"]) == 2  # an empty question has no length; ids decide

    class Echo:
        def complete(self, prompt):
            return f"{len(prompt)} characters"

    replied = {r["question_id"]: r for r in answer(questions, naive_retriever(collection, k=2), Echo).collect()}
    assert replied[1]["answer"] == f"{len(plain[1]['prompt'])} characters"


def test_condensed_question_only_for_retrieval(collection, spark):
    asked = spark.createDataFrame(
        [(1, "and it?", "\nHuman: what hunts at night? the owl"), (2, "trout", "")],
        "question_id int, question string, chat_history string",
    )
    rows = {
        r["question_id"]: r
        for r in answer(asked, naive_retriever(collection, k=1), condense=lambda q, h: F.concat(h, q)).collect()
    }
    assert rows[1]["contexts"] == ["the owl hunts at night [1]"]
    assert "Question: and it?" in rows[1]["prompt"] and "what hunts at night" in rows[1]["prompt"]
    assert rows[2]["question"] == "trout"


def test_empty_collection_gives_empty_context(spark, questions):
    empty = Collection(spark, fresh_folder(spark, "test-empty"), vector_size=64).create_if_absent()
    rows = answer(questions, naive_retriever(empty)).collect()
    assert {r["answer"] for r in rows} == {""} and all(r["contexts"] == [] for r in rows) and len(rows) == 3


def test_missing_collection_is_refused(spark):
    with pytest.raises(ValueError, match="does not exist"):
        naive_retriever(Collection(spark, fresh_folder(spark, "test-missing")))


def test_payloads_come_from_the_files_of_the_hits(collection, questions):
    from folioscope.plans.retrieve import Retriever

    retriever = naive_retriever(collection)
    whole = Retriever(collection.points(), retriever.make_embedder)
    found = sorted(map(str, retriever.retrieve(questions).collect()))
    assert found == sorted(map(str, whole.retrieve(questions).collect()))


def test_chat_prompts(collection, spark):
    messages = spark.createDataFrame(
        [("a", 0, "user", "hello"), ("a", 1, "assistant", "hi"), ("a", 2, "user", "what hunts at night? the owl"),
         ("b", 0, "assistant", "nobody asked")],
        "session_id string, turn long, role string, text string",
    )
    rows = chat_prompts(messages, reranked_retriever(collection, k=3, top_n=1)).collect()
    assert [(r["session_id"], r["part"]) for r in rows] == [("a", 0)]
    assert "the owl hunts at night [1]" in rows[0]["text"]
    assert "\nHuman: hello\nAssistant: hi\n" in rows[0]["text"]
    assert rows[0]["text"].count("what hunts at night? the owl") == 1


def test_extractive_answer_of_nothing(spark):
    assert spark.range(1).select(extractive_answer(F.array().cast("array<string>"))).first()[0] == ""


def test_embedder_counts_words():
    embedder = HashingEmbedder(32)
    first, second, none = embedder.embed(["Owl owl, trout", "trout OWL owl", ""])
    assert (first == second).all() and first.sum() == 3 and none.sum() == 0


def test_texts_kept_in_the_session(spark):
    texts = spark.createDataFrame([(1, "owl at night"), (2, "trout in the river")], "id int, text string")
    asked = spark.createDataFrame([(7, "a river trout")], "question_id int, question string")
    retriever = text_retriever(texts, lambda: HashingEmbedder(64), k=1)
    found = retriever.retrieve(asked).first()
    assert (found["id"], found["page_content"]) == ("2", "trout in the river [1]")
    retriever.points.unpersist()


class Repeat:
    """Replies with the last line that holds a question."""

    def complete(self, prompt):
        return [line for line in prompt.split("\n") if "Question:" in line][-1].strip()


@pytest.mark.parametrize("turns", [1, 301])
def test_chat_turns(collection, spark, turns):
    rows = [(s, t, "user" if t % 2 == 0 else "assistant", f"trout swims {s}{s} {t}") for s in ("a", "b", "c") for t in range(turns)]
    messages = spark.createDataFrame(rows, "session_id string, turn long, role string, text string")
    last = turns - 1
    answered = messages.unionByName(
        messages.where("turn = 0").selectExpr("'done' AS session_id", "turn", "'assistant' AS role", "text")
    )
    assert {r["session_id"] for r in chat_turns(answered, naive_retriever(collection)).collect()} == set("abc")
    plain = chat_turns(messages, reranked_retriever(collection, k=3, top_n=1)).collect()
    assert sorted((r["session_id"], r["turn"], r["role"]) for r in plain) == [(s, last + 1, "assistant") for s in "abc"]
    assert all("trout" in r["text"] for r in plain)
    replied = chat_turns(messages, naive_retriever(collection, k=1), Repeat).collect()
    assert sorted((r["session_id"], r["text"]) for r in replied) == [(s, f"Question: trout swims {s}{s} {last}") for s in "abc"]


def test_status(collection, spark):
    assert collection_status(None) == "Database connection not configured"
    missing = Collection(spark, fresh_folder(spark, "test-status"))
    assert "not found" in collection_status(missing)
    row = collection_status(collection).first()
    assert (row["points_label"], row["sample"], row["n_more"]) == ("6", "birds.pdf, fish.pdf, stars.pdf", 0)


def test_rewritten_question_only_for_retrieval(collection, spark):
    messages = spark.createDataFrame(
        [("a", 0, "user", "what hunts at night? the owl"), ("a", 1, "assistant", "x"), ("a", 2, "user", "and then?")],
        "session_id string, turn long, role string, text string",
    )

    def rewrite(asked):
        return asked.withColumn("question", F.lit("trout swims upstream"))

    row = chat_prompts(messages, naive_retriever(collection, k=1), rewrite=rewrite).first()
    assert "the trout swims upstream [1]" in row["text"] and "Question: and then?" in row["text"]
    reply = chat_turns(messages, naive_retriever(collection, k=1), rewrite=rewrite).first()
    assert (reply["turn"], reply["text"]) == (3, "the trout swims upstream [1]")


def test_missing_slots_of_a_prompt_are_empty(spark):
    from folioscope.operators.answers import with_prompt

    frame = spark.createDataFrame([("c", None, "q")], "context string, chat_history string, question string")
    filled = spark.createDataFrame([("c", "", "q")], "context string, chat_history string, question string")
    assert with_prompt(frame).first()["prompt"] == with_prompt(filled).first()["prompt"]


def test_renumbered_documents_keep_their_style(spark):
    from folioscope.operators.answers import rerank

    schema = "question_id int, rank int, text string, source string, page string, page_content string"
    documents = spark.createDataFrame([(1, 1, "t", "f", "2", "old"), (1, 2, "q", "g", "3", "old")], schema)
    questions = spark.createDataFrame([(1, "q")], "question_id int, question string")
    best = {style: rerank(documents, questions, renumber=True, citation=style).where("position = 1").first() for style in ("prefix", "none", "suffix")}
    assert {r["reference_number"] for r in best.values()} == {"[1]"}
    assert best["none"]["page_content"] == "q"
    assert best["prefix"]["page_content"] == "[Source: g, page 3]\nq"
    assert best["suffix"]["page_content"] == "q [1]"


@pytest.mark.parametrize("on", ["text", "page_content"])
def test_reranked_documents_are_those_of_rerank_without_a_sort_of_texts(spark, on):
    payload = "struct<file_name:string,page_number:string,text:string>"
    rows = [(f"p{i % 9}", (f"f{i}", str(i), f"the owl {'hunts ' * (i % 3)}at w{i}")) for i in range(14)]
    rows += [rows[0], ("p3", (None, None, None))]  # ids of several points, one of them twice
    points = spark.createDataFrame(rows, f"id string, payload {payload}")
    hits = spark.createDataFrame(
        [(q, r, f"p{(q * r) % 9}", 1.0 / r) for q in range(6) for r in range(1, 8)] + [(2, 8, None, 0.0)],
        "question_id int, rank int, id string, score double",
    )
    asked = [(0, "owl hunts"), (1, "w4 w5 w6 w7"), (2, "at w1"), (3, ""), (4, None), (4, "owl")]
    questions = spark.createDataFrame(asked, "question_id int, question string")
    for options in ({}, {"renumber": True, "citation": "prefix"}):
        documents = answers.cited_documents(hits, points, options.get("citation", "suffix"))
        old = answers.rerank(documents, questions, 40, on=on, **options)
        new = answers.reranked_documents(hits, points, questions, 40, on=on, **options)
        assert new.columns == old.columns
        columns = [c for c in old.columns if c not in ("position", *(("reference_number", "page_content") if options else ()))]
        key = lambda row: tuple(map(str, row))
        assert sorted(map(key, new.select(columns).collect())) == sorted(map(key, old.select(columns).collect()))
    few = answers.reranked_documents(hits, points, questions, 2, on=on)
    assert few.groupBy("question_id").count().where("count > 2").isEmpty()
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan
