"""Model calls as columns: one client per partition, Arrow batches in and out."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope import constants as C
from folioscope.functions import text as text_fn
from folioscope.schemas import VECTOR


class Embedder(Protocol):
    size: int

    def embed(self, texts: Iterable[str]) -> Iterable: ...


class TextModel(Protocol):
    def complete(self, prompt: str) -> str: ...


def _once(udf):
    """Keep the optimizer from repeating a call, as it may for a filter on its result."""
    return udf.asNondeterministic()


#: Texts, and about the bytes of them, that a task of a model has as Python objects at once.
_SLICE_ROWS, _SLICE_BYTES = 512, 4 << 20


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """A batch in slices, so that only a slice of its texts and of their vectors is held besides it.

    An empty batch is one empty slice.
    """
    rows = min(_SLICE_ROWS, max(1, len(texts) * _SLICE_BYTES // max(texts.nbytes, 1)))
    for at in range(0, max(len(texts), 1), rows):
        yield texts.slice(at, rows)


def _vectors(found: Iterable) -> pa.Array:
    rows = [np.asarray(v, dtype=np.float32) for v in found]
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    values = np.concatenate(rows) if rows else np.empty(0, np.float32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float32()))


def embed_column(make_embedder: Callable[[], Embedder], text: Column) -> Column:
    """``ARRAY<FLOAT>`` vectors of ``text``.  An error of the service fails the task,
    and Spark retries it."""

    @F.arrow_udf(VECTOR)
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        embedder = make_embedder()
        for texts in batches:
            for part in _slices(texts):
                yield _vectors(embedder.embed(part.to_pylist()))

    return _once(embed)(text)


def complete_column(make_model: Callable[[], TextModel], prompt: Column, on_error: str | None = "raise") -> Column:
    """The model's reply to each prompt; ``on_error=None`` gives null for a failed call."""

    @F.pandas_udf(T.StringType())
    def complete(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make_model()

        def ask(one: str) -> str | None:
            try:
                return model.complete(one)
            except Exception:
                if on_error == "raise":
                    raise
                return None

        for prompts in batches:
            yield prompts.map(ask)

    return _once(complete)(prompt)


def summary_column(text: Column, make_model: Callable[[], TextModel] | None = None) -> Column:
    """Model summary of a chunk, or its first 200 characters.

    Without a model, and for every chunk whose call fails, the summary is the cut text.
    Building the model happens outside the guarded call, so a missing key stops the job.
    """
    if make_model is None:
        return text_fn.summary_cut(text)
    prompt = F.concat(F.lit(C.SUMMARY_USER_PREFIX), text)
    return F.coalesce(complete_column(make_model, prompt, on_error=None), text_fn.summary_cut(text))


def first_working(candidates: Iterable[str], attempt: Callable[[str], object]) -> object:
    """The first result of ``attempt`` that does not raise, in the order of ``candidates``."""
    failures = []
    for name in candidates:
        try:
            return attempt(name)
        except Exception as error:  # noqa: BLE001 - every failure moves on to the next model
            failures.append(f"{name}: {error}")
    raise ValueError("Could not use any of the specified models: " + "; ".join(failures))
