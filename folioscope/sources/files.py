"""Folders of files: scan and parse."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.schemas import FILE_METADATA, PARSED_FILE, QA_ITEM

#: Turns a binary column into ``STRUCT<pages, metadata>``.
Parser = Callable[[Column], Column]


def suffix_glob(suffix: str) -> str:
    """A path filter that matches ``suffix`` in any case, applied while listing."""
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


def _named(files: DataFrame) -> DataFrame:
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"), "content")


def scan_folder(spark: SparkSession, folder: str, suffix: str = C.FILE_SUFFIX) -> DataFrame:
    """``(path, file_name, content)`` of the files directly in ``folder`` with the suffix.

    Files of zero bytes are not listed.
    """
    return _named(
        spark.read.format("binaryFile").option("pathGlobFilter", suffix_glob(suffix)).load(folder)
    )


def stream_folder(spark: SparkSession, folder: str, suffix: str = C.FILE_SUFFIX) -> DataFrame:
    """The same rows as a stream of files as they arrive."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return _named(
        spark.readStream.format("binaryFile")
        .schema(schema)
        .option("pathGlobFilter", suffix_glob(suffix))
        .load(folder)
    )


def text_parser(content: Column) -> Column:
    """Parser of UTF-8 text, with a form feed between pages and no metadata."""
    texts = F.split(F.decode(content, "UTF-8"), "\f", -1)
    pages = F.transform(
        texts, lambda text, i: F.struct((i + 1).cast("int").alias("page_number"), text.alias("text"))
    )
    return F.struct(pages.alias("pages"), F.lit(None).cast(FILE_METADATA).alias("metadata"))


def python_parser(parse: Callable[[bytes], tuple[list[str], dict | None]]) -> Parser:
    """Parser from a Python function that returns page texts and a metadata dictionary.

    The dictionary has the keys ``title``, ``author``, ``keywords`` and ``creationDate``;
    missing ones, or no dictionary at all, become nulls.
    """

    @F.pandas_udf(PARSED_FILE)
    def parsed(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for content in contents:
            texts, found = parse(content)
            found = found or {}
            rows.append(
                {
                    "pages": [
                        {"page_number": number, "text": text} for number, text in enumerate(texts, 1)
                    ],
                    "metadata": {
                        "file_title": found.get("title"),
                        "authors": found.get("author"),
                        "keywords": found.get("keywords"),
                        "creation_date": found.get("creationDate"),
                    },
                }
            )
        return pd.DataFrame(rows, columns=["pages", "metadata"])

    # Marked as not deterministic, so that no derived filter parses a file twice.
    return parsed.asNondeterministic()


def read_pdf(content: bytes) -> tuple[list[str], dict | None]:
    """Page texts and metadata of a PDF; needs a PDF library on the executors."""
    try:
        import pymupdf
    except ImportError as error:
        raise RuntimeError("reading PDF files needs the pymupdf library on every executor") from error
    with pymupdf.open(stream=content, filetype="pdf") as document:
        return [page.get_text() for page in document], document.metadata


def pdf_parser(content: Column) -> Column:
    return python_parser(read_pdf)(content)


def file_pages(files: DataFrame, parser: Parser) -> DataFrame:
    """One row per page that has text; blank pages are left out without renumbering.

    ``files`` keeps its other columns; ``content`` is replaced by ``metadata``,
    ``page_number`` and ``text``.
    """
    from folioscope.functions.text import has_text

    keep = [c for c in files.columns if c != "content"]
    return (
        files.select(*keep, parser(F.col("content")).alias("_parsed"))
        .select(*keep, F.col("_parsed.metadata").alias("metadata"), F.inline("_parsed.pages"))
        .where(has_text(F.col("text")))
    )


def file_text(files: DataFrame, parser: Parser) -> DataFrame:
    """The text of each file: its pages in order with nothing between them."""
    keep = [c for c in files.columns if c != "content"]
    return files.select(
        *keep,
        F.array_join(F.transform(parser(F.col("content"))["pages"], lambda p: p["text"]), "").alias("text"),
    )


def read_questions(spark: SparkSession, path: str, one_array: bool = True) -> DataFrame:
    """Question set from JSON: a file with one top-level array, or one object per line.

    Unknown keys are ignored.  A large set should have one object per line, because a file
    with a single array cannot be read in parallel.
    """
    return (
        spark.read.schema(QA_ITEM).option("multiLine", one_array).option("encoding", "UTF-8").json(path)
    )
