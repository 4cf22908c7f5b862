import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import sf_dir, spark  # noqa: F401

#: Names that the operators use inside; inputs may have them too.
CLASHING = (
    "block", "bucket", "key", "node", "digest", "n", "row_id", "row_text", "bits0", "score", "length", "host", "label",
    "statistics", "kind", "component", "tokens", "mix_topic", "fingerprint", "next_text", "place", "_name", "_n", "path", "level", "purity", "s0",
)


def sentence(rng, words):
    vocabulary = ["the", "river", "was", "cold", "and", "stone", "houses", "stood", "along", "its", "banks", "while", "people", "of", "every", "age", "walked", "home"]
    return " ".join(rng.choice(vocabulary) + str(rng.randrange(60)) for _ in range(words))


@pytest.fixture(scope="session")
def edge_rows():
    """(doc_id, text, lang, source): nulls, empty and long texts, ties, repeated rows, near copies."""
    rng = random.Random(5)
    base = sentence(rng, 120)
    words = base.split()
    passage = sentence(rng, 60)
    texts = [
        (1, base, "en", "a"),
        (2, base.upper(), "en", "a"),
        (3, " ".join(words[:60] + ["changed"] + words[61:]), "en", "b"),
        (4, None, "en", "a"),
        (5, "", None, "b"),
        (6, " \n\t ", "de", None),
        (7, "one two", "de", "b"),
        (8, "one  two", "de", "b"),
        (9, "0123 4567 -- !!", None, None),
        (10, sentence(rng, 30) + "\n" + passage + "\n" + sentence(rng, 40), "fr", "c"),
        (11, sentence(rng, 20) + "\n" + passage, "fr", "c"),
        (12, passage, "fr", "c"),
        (12, passage, "fr", "c"),
        (12, sentence(rng, 25), "fr", "c"),
        (None, sentence(rng, 20), "en", "a"),
        (None, base, None, "a"),
        (20, " ".join(sentence(rng, 400) for _ in range(60)), "en", "long"),
        (21, "é ñ ü ß 漢字 😀 " * 8, "es", "a"),
        (22, "word " * 300, "es", "a"),
        (-3, sentence(rng, 6), "es", "a"),
    ]
    return texts


@pytest.fixture(scope="session")
def edge(spark, edge_rows):  # noqa: F811
    frame = spark.createDataFrame(edge_rows, "doc_id long, text string, lang string, source string")
    return frame.withColumns({c: F.lit("x") for c in CLASHING} | {"n_chars": F.length("text").cast("long")}).repartition(3)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")
