"""Payload maps: defaults for absent keys, metadata without the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def get_or(payload: Column, key: str, default: str) -> Column:
    """``payload[key]``, or ``default`` where the key is absent.

    A key that is present with a null value yields null.
    """
    return F.when(F.map_contains_key(payload, key), payload[key]).otherwise(F.lit(default))


def has_key(payload: Column, key: str) -> Column:
    return F.map_contains_key(payload, key)


def without_text(payload: Column, score: Column | None = None) -> Column:
    """All entries but ``text``; with ``score`` added when given."""
    rest = F.map_filter(payload, lambda key, _value: key != "text")
    if score is None:
        return rest
    return F.map_concat(rest, F.create_map(F.lit("score"), score.cast("string")))


def payload_map(payload: Column, fields: tuple[str, ...]) -> Column:
    """A ``MAP<STRING,STRING>`` view of the payload struct."""
    entries: list[Column] = []
    for name in fields:
        entries += [F.lit(name), payload[name]]
    return F.create_map(*entries)


def matches_all(payload: Column, terms: dict[str, str]) -> Column:
    """Conjunction of keyword equalities; an empty ``terms`` matches everything."""
    return reduce(
        lambda left, right: left & right,
        (payload[key] == F.lit(value) for key, value in terms.items()),
        F.lit(True),
    )
