"""Chunks against a literal, slow reading of the splitting rules."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.operators import chunking as K


def merge(pieces, joint, size, overlap):
    """Walk left to right; emit a full window, then drop from its front as far as needed."""
    chunks, window = [], []

    def length(parts):
        return len(joint.join(parts))

    for piece in pieces:
        if window and length(window) + len(joint) + len(piece) > size:
            chunks.append(joint.join(window).strip())
            while window and (length(window) > overlap or length(window + [piece]) > size):
                window = window[1:]
        window.append(piece)
    if window:
        chunks.append(joint.join(window).strip())
    return [c for c in chunks if c]


def by_line(text, size, overlap):
    return merge([line for line in text.split("\n") if line], "\n", size, overlap)


def recursive(text, size, overlap, separators):
    separator = next(s for s in separators if s in text)
    finer = separators[separators.index(separator) + 1 :]
    if separator:
        parts = text.split(separator)
        pieces = [p for p in [parts[0]] + [separator + p for p in parts[1:]] if p]
    else:
        pieces = list(text)
    chunks, short = [], []
    for piece in pieces:
        if len(piece) < size:
            short.append(piece)
            continue
        chunks += merge(short, "", size, overlap)
        short = []
        chunks += recursive(piece, size, overlap, finer) if finer else [piece]
    return chunks + merge(short, "", size, overlap)


TEXT = st.text(alphabet="ab .,!?\n", max_size=120)


def test_python_helper_matches_the_rules():
    @settings(max_examples=400, deadline=None)
    @given(TEXT, st.integers(2, 25), st.integers(0, 25))
    def check(text, size, overlap):
        overlap = min(overlap, size)
        got = K.recursive_chunks(text, size, overlap, C.CHUNK_SEPARATORS)
        assert got == recursive(text, size, overlap, list(C.CHUNK_SEPARATORS))
        assert all(len(c) <= size and c in text for c in got)
        if text.strip() and len(text) <= size - 1:
            assert got == [text.strip()]

    check()


def _texts():
    texts = ["", " ", "\n\n", "a", " ", "x" * 40, "a\nb\n\nc", "...", "😀" * 30, "\n".join(["ab"] * 40)]
    texts += ["one two, three! four? five.\n\nsix seven\neight" * 3, "a" * 9 + "\n" + "b" * 30 + "\n" + "c" * 3]
    texts += ["".join("ab .,!?\n"[(i * i * 7 + i * n) % 8] for i in range(150)) for n in range(1, 40)]
    return texts


def test_columns_match_the_rules(spark):
    texts = _texts()
    frame = spark.createDataFrame(list(enumerate(texts)), "n int, text string").repartition(3)
    for size, overlap in ((10, 4), (25, 0), (7, 7), (60, 20)):
        got = frame.select(
            "n",
            K.line_chunk_column(F.col("text"), size, overlap).alias("lines"),
            K.recursive_chunk_column(F.col("text"), size, overlap).alias("parts"),
        ).collect()
        assert len(got) == len(texts)
        for row in got:
            text = texts[row["n"]]
            assert row["lines"] == by_line(text, size, overlap), (text, size, overlap)
            assert row["parts"] == recursive(text, size, overlap, list(C.CHUNK_SEPARATORS)), (text, size)


def test_exploded_chunks_and_lengths(spark):
    frame = spark.createDataFrame([("f", "aaaa\nbb\ncccccc"), ("g", "")], "file_hash string, text string")
    chunks = K.explode_chunks(frame, K.line_chunk_column(F.col("text"), 4, 0))
    assert [tuple(r) for r in chunks.orderBy("chunk_index").collect()] == [("f", 0, "aaaa"), ("f", 1, "bb"), ("f", 2, "cccccc")]
    assert [tuple(r) for r in K.chunk_lengths(chunks, "file_hash").collect()] == [("f", 3, 2, 6, 4)]


def test_median_is_cut_not_rounded(spark):
    frame = spark.createDataFrame([("f", "a" * n) for n in (1, 2, 3, 4)], "file_hash string, text string")
    assert K.chunk_lengths(frame, "file_hash").first()["median_length"] == 2


def test_bad_sizes_are_refused():
    with pytest.raises(ValueError, match="overlap"):
        K.recursive_chunk_column(None, 10, 11)
