"""Judge replies: strict JSON, dispatched on its shape, with a line fallback."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from folioscope.functions.text import nonblank_lines, strip


_REPEATED_KEYS = "spark.sql.variant.allowDuplicateKeys"


def chat_content(response: Column) -> Column:
    """The message text of a chat-completion response."""
    return F.get_json_object(response, "$.choices[0].message.content")


def embedding_values(response: Column) -> Column:
    return F.from_json(response, "struct<embedding: array<float>>")["embedding"]


def _accept_repeated_keys() -> None:
    """Of an object's repeated keys the last counts, as in most JSON readers.

    Spark decides this by a session setting when the expression is built.
    """
    session = SparkSession.getActiveSession()
    if session is not None and session.conf.get(_REPEATED_KEYS) != "true":
        session.conf.set(_REPEATED_KEYS, "true")


def _framed(text: Column) -> Column:
    """The parsed JSON array of ``text`` and its own hash.

    The parser accepts text after a value.  Inside the array such text is a syntax error,
    a further element, or closes the array early; in each case the hash, which a text
    cannot contain, is not the second element.
    """
    _accept_repeated_keys()
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), F.md5(text), F.lit('"]')))


def _is_framed(framed: Column, text: Column) -> Column:
    return F.coalesce(F.try_variant_get(framed, "$[1]", "string") == F.md5(text), F.lit(False))


def is_json(text: Column) -> Column:
    """Whether ``text`` is exactly one JSON value."""
    return _is_framed(_framed(text), text)


def parse_reply(reply: Column) -> Column:
    """``STRUCT<output, statements, verdicts>`` from a judge's reply.

    A JSON object gives its ``statements`` and, when that is a list, its
    ``verdicts``; a JSON array gives the statements; another JSON value gives
    neither.  Text that is not JSON gives its non-blank lines as statements.
    Verdict elements stay JSON text.
    """
    none = F.array().cast("array<string>")
    output = strip(reply)

    def dispatch(read: Column) -> Column:
        shape = F.when(read["valid"], F.schema_of_variant(read["value"])).otherwise("TEXT")
        is_object = F.startswith(shape, F.lit("OBJECT"))

        def strings(path: str) -> Column:
            return F.coalesce(F.try_variant_get(read["value"], path, "array<string>"), none)

        statements = (
            F.when(~read["valid"], nonblank_lines(read["output"]))
            .when(is_object, strings("$.statements"))
            .when(F.startswith(shape, F.lit("ARRAY")), strings("$"))
            .otherwise(none)
        )
        return F.struct(
            read["output"].alias("output"),
            statements.alias("statements"),
            F.when(is_object, strings("$.verdicts")).otherwise(none).alias("verdicts"),
        )

    # transform over a one-element array names a value, so that it is computed once
    framed = F.transform(
        F.array(output), lambda text: F.struct(text.alias("output"), _framed(text).alias("framed"))
    )
    read = F.transform(
        framed,
        lambda f: F.struct(
            f["output"].alias("output"),
            _is_framed(f["framed"], f["output"]).alias("valid"),
            F.try_variant_get(f["framed"], "$[0]", "variant").alias("value"),
        ),
    )
    return F.transform(read, dispatch)[0]
