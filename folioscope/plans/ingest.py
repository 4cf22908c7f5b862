"""Ingestion: files to points in the index, each content once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import has_text, point_id
from folioscope.models.columns import Embedder, TextModel, embed_column, summary_column
from folioscope.models.hashing import HashingEmbedder
from folioscope.operators.chunking import explode_chunks, recursive_chunk_column
from folioscope.operators.files import new_files, with_hash
from folioscope.schemas import FILE_METADATA
from folioscope.sources.files import Parser, file_pages, file_text
from folioscope.sources.index import Collection

GRANULARITIES = ("page", "document")


def file_chunks(
    files: DataFrame,
    parser: Parser,
    granularity: str = "page",
    chunks: Callable[[Column], Column] = recursive_chunk_column,
    spread: bool = True,
) -> DataFrame:
    """``(file_hash, file_name, metadata, page_number, chunk_index, text)`` of every file.

    Chunks never cross pages, unless the granularity is the whole document.  ``spread``
    redistributes pages before the costly steps, so that a file with very many pages is
    not the work of a single task.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}")
    if granularity == "page":
        pages = file_pages(files, parser)
        if spread:
            pages = pages.repartition("file_hash", "page_number")
    else:
        pages = (
            file_text(files, parser)
            .where(has_text(F.col("text")))
            .withColumn("metadata", F.lit(None).cast(FILE_METADATA))
            .withColumn("page_number", F.lit(None).cast("int"))
        )
    return explode_chunks(pages, chunks(F.col("text")))


def build_points(
    chunks: DataFrame,
    make_embedder: Callable[[], Embedder] | None,
    make_summarizer: Callable[[], TextModel] | None = None,
) -> DataFrame:
    """Points from chunks: content-derived id, vector, and the nine payload fields."""
    vector = (
        F.lit(None).cast("array<float>")
        if make_embedder is None
        else embed_column(make_embedder, F.col("text"))
    )
    modelled = chunks.withColumn("vector", vector).withColumn(
        "summary", summary_column(F.col("text"), make_summarizer)
    )
    page = F.col("page_number").cast("string")
    return modelled.select(
        point_id(F.col("file_hash"), F.coalesce(page, F.lit("")), F.col("chunk_index")).alias("id"),
        "vector",
        F.struct(
            "file_name",
            "file_hash",
            F.col("metadata.file_title"),
            F.col("metadata.authors"),
            F.col("metadata.keywords"),
            F.col("metadata.creation_date"),
            page.alias("page_number"),
            "text",
            "summary",
        ).alias("payload"),
    )


def ingest(
    files: DataFrame,
    collection: Collection,
    parser: Parser,
    make_embedder: Callable[[], Embedder] | None = None,
    make_summarizer: Callable[[], TextModel] | None = None,
    granularity: str = "page",
    spread: bool = True,
) -> DataFrame:
    """Add the files ``(path, file_name, content)`` that the collection does not hold yet.

    Files are chosen by hash before anything is parsed, so known files and further
    copies cost one read.  Returns the ledger rows of this ingest: one per new file,
    with its chunk statistics; a file without text has no chunks and is not tried again.
    """
    if make_embedder is None:
        size = collection.vector_size
        make_embedder = lambda: HashingEmbedder(size)
    collection.create_if_absent()
    number = collection.last_ingest() + 1
    hashed = with_hash(files).select("path", "file_name", "file_hash")
    manifest = collection.stage_manifest(
        new_files(hashed, collection.files(), "path", "file_name"), number
    )
    if manifest.isEmpty():
        return collection.files().where(F.lit(False)).drop("ingest")
    # The size of the written manifest is known here, so Spark broadcasts it when small.
    contents = files.select("path", "content").join(manifest, "path")
    points = build_points(
        file_chunks(contents, parser, granularity, spread=spread), make_embedder, make_summarizer
    )
    written = collection.write_points(points, number)
    return collection.finish(manifest, written, number)
