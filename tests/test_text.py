import pytest
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.functions import payload as P
from folioscope.functions import text as X
from folioscope.functions.vectors import checked_size, cosine
from folioscope.operators.answers import with_prompt


def one(spark, column, **values):
    frame = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return frame.select(column.alias("out")).first()["out"]


ODD_SPACES = [" a b ", "\n\ta\r\n", " x ", "　x ", "\x1cx\x1f", "", " \n ", "x", "​x"]


@pytest.mark.parametrize("text", ODD_SPACES)
def test_strip_and_blank_test_agree_with_python(spark, text):
    assert one(spark, X.strip(F.col("t")), t=text) == text.strip()
    assert one(spark, X.has_text(F.col("t")), t=text) is bool(text.strip())


def test_null_text_is_blank(spark):
    assert spark.range(1).select(X.has_text(F.lit(None).cast("string"))).first()[0] is False


def test_nonblank_lines(spark):
    text = "  one \n\n  \ntwo\n"
    assert one(spark, X.nonblank_lines(F.col("t")), t=text) == ["one", "two"]


def test_words_are_runs_of_letters_and_digits(spark):
    assert one(spark, X.words(F.col("t")), t="Été is_it 12x-y!") == ["été", "is", "it", "12x", "y"]


@pytest.mark.parametrize("text", ["short", "x" * 200, "y" * 201, "😀" * 250])
def test_summaries(spark, text):
    assert one(spark, X.summary_cut(F.col("t")), t=text) == text[:200] + "..."
    expected = text[:200] + "..." if len(text) > 200 else text
    assert one(spark, X.summary_cut_if_long(F.col("t")), t=text) == expected


@pytest.mark.parametrize("name, found", [("A.PDF", True), ("b.pdf", True), ("c.txt", False), ("pdf", False)])
def test_suffix(spark, name, found):
    assert one(spark, X.has_suffix(F.col("t")), t=name) is found


def test_endpoint(spark):
    assert one(spark, X.embed_endpoint(F.col("t")), t="http://h/a//") == "http://h/a/embed"


def test_prompt_keeps_slots_inside_values(spark):
    frame = spark.createDataFrame([("{context} and {question}", "ctx {question}")], "question string, context string")
    prompt = with_prompt(frame).first()["prompt"]
    expected = C.PROMPT_DEFAULT.format(
        context="ctx {question}", chat_history="", question="{context} and {question}"
    )
    assert prompt == expected


def test_template_without_value_is_refused():
    with pytest.raises(ValueError, match="slots"):
        X.fill_template("{context} {other}", {"context": None})


def test_html_is_escaped_unless_asked(spark):
    message = "<b>&'\"</b>"
    assert one(spark, X.message_html("<p>{{MSG}}</p>", F.col("t")), t=message) == (
        "<p>&lt;b&gt;&amp;&#x27;&quot;&lt;/b&gt;</p>"
    )
    assert one(spark, X.message_html("<p>{{MSG}}</p>", F.col("t"), escape=False), t=message) == f"<p>{message}</p>"


def test_number_formats(spark):
    assert one(spark, X.thousands(F.col("n")), n=1234567) == "1,234,567"
    assert one(spark, X.three_decimals(F.col("n")), n=0.12349) == "0.123"


def test_payload_default_only_for_absent_keys(spark):
    frame = spark.createDataFrame([(1, {"source": None}), (2, {}), (3, {"source": "s"})], "n int, p map<string,string>")
    got = frame.select("n", P.get_or(F.col("p"), "source", "none").alias("s"), P.has_key(F.col("p"), "source").alias("h"))
    assert sorted(map(tuple, got.collect())) == [(1, None, True), (2, "none", False), (3, "s", True)]


def test_metadata_without_text_and_with_score(spark):
    frame = spark.createDataFrame([({"text": "t", "a": "1"}, 0.5)], "p map<string,string>, s double")
    assert frame.select(P.without_text(F.col("p"), F.col("s"))).first()[0] == {"a": "1", "score": "0.5"}


def test_cosine_of_a_zero_vector_is_zero(spark):
    frame = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0]), ([1.0, 0.0], [2.0, 0.0])], "a array<float>, b array<float>")
    assert [r[0] for r in frame.select(cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0]


def test_wrong_vector_size_fails_the_job(spark):
    frame = spark.createDataFrame([([1.0, 2.0],)], "v array<float>")
    assert frame.select(checked_size(F.col("v"), 2)).first()[0] == [1.0, 2.0]
    with pytest.raises(Exception, match="vector size is not 3"):
        frame.select(checked_size(F.col("v"), 3)).collect()
