"""Retrieval: questions to cited documents, with or without reranking."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope import constants as C
from folioscope.models.columns import Embedder, embed_column
from folioscope.models.hashing import HashingEmbedder
from folioscope.operators.answers import (
    cited_documents,
    in_search_order,
    rerank,
    reranked_documents,
    word_overlap,
)
from folioscope.operators.search import top_k
from folioscope.session import stored
from folioscope.sources.index import Collection


@dataclass(frozen=True)
class Retriever:
    """Settings of one retrieval; ``top_n`` asks for reranking."""

    points: DataFrame
    make_embedder: Callable[[], Embedder]
    k: int = C.TOP_K
    top_n: int | None = None
    citation: str = "suffix"
    strict_keys: bool = False
    scorer: Callable[[Column, Column], Column] = word_overlap
    rerank_on: str = "text"
    renumber: bool = False
    #: Makes a reranking client, which then scores instead of ``scorer``.
    make_reranker: Callable[[], object] | None = None
    #: Where ``points`` are located ones of a collection.
    collection: Collection | None = None

    def retrieve(self, questions: DataFrame) -> DataFrame:
        """Documents of each question of ``(question_id, question)``, in order of ``position``."""
        asked = questions.select(
            "question_id", embed_column(self.make_embedder, F.col("question")).alias("vector")
        )
        if self.collection is None:
            hits, found = stored(top_k(asked, self.points, self.k), "hits"), self.points
        else:
            # Hits know their data files, and only these are read for the payloads.
            located = stored(top_k(asked, self.points, self.k, carried=("_file",)), "hits")
            hits, found = located.drop("_file"), self.collection.points_in(located)
        if self.top_n is None or self.make_reranker is not None:
            documents = cited_documents(hits, found, self.citation, self.strict_keys)
        if self.top_n is None:
            return in_search_order(documents)
        options = dict(on=self.rerank_on, renumber=self.renumber, citation=self.citation)
        if self.make_reranker is not None:
            return rerank(documents, questions, self.top_n, make_client=self.make_reranker, **options)
        return reranked_documents(hits, found, questions, self.top_n, self.scorer, strict_keys=self.strict_keys, **options)


def _over(collection: Collection, make_embedder: Callable[[], Embedder] | None, **options) -> Retriever:
    size = collection.require().vector_size
    make_embedder = make_embedder or (lambda: HashingEmbedder(size))
    return Retriever(collection.located_points(), make_embedder, collection=collection, **options)


def naive_retriever(
    collection: Collection, make_embedder: Callable[[], Embedder] | None = None, k: int = C.TOP_K, **options
) -> Retriever:
    """The ``k`` nearest points of an existing collection."""
    return _over(collection, make_embedder, k=k, **options)


def reranked_retriever(
    collection: Collection,
    make_embedder: Callable[[], Embedder] | None = None,
    k: int = C.OVER_RETRIEVE_K,
    top_n: int = C.RERANK_TOP_N,
    **options,
) -> Retriever:
    """The ``k`` nearest points, of which reranking keeps ``top_n``."""
    return _over(collection, make_embedder, k=k, top_n=top_n, **options)


def text_retriever(
    texts: DataFrame, make_embedder: Callable[[], Embedder], k: int = C.TOP_K, **options
) -> Retriever:
    """The ``k`` nearest of ``(id, text)`` rows, embedded once and written to the work folder.

    Nothing is written to a collection.
    """
    no_value = F.lit(None).cast("string")
    payload = F.struct(
        *((F.col("text") if name == "text" else no_value).alias(name) for name in C.PAYLOAD_FIELDS)
    )
    points = texts.select(
        F.col("id").cast("string").alias("id"),
        embed_column(make_embedder, F.col("text")).alias("vector"),
        payload.alias("payload"),
    )
    return Retriever(stored(points, "text-points"), make_embedder, k, **options)
