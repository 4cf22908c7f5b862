"""The corpus pipeline: from raw documents to packed training sequences.

Each stage takes the documents that its predecessor kept, calls one operator of ``folioscope.llm`` and
is written and read again before the next one.  All but the last keep the columns of ``documents``.
A stage given an empty table returns an empty one; nulls, ties and repeated rows are treated as the
operators' own descriptions say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.catalog import MIX_WEIGHTS
from folioscope.llm.common import remainder, table
from folioscope.llm.exact_dedup import drop_copies
from folioscope.llm.jaccard_join import keep_one
from folioscope.llm.mixing import mix
from folioscope.llm.packing import pack
from folioscope.llm.quality import keep_good
from folioscope.session import stored


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the discriminant rejects; it learns from two thirds of the labels."""
    return keep_good(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix(docs, weights=MIX_WEIGHTS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mixing", mixing),
    ("packing", packing),
]

#: The discriminant, the similarity join and the packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
