"""Identity of files: first copies and files that are not indexed yet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.functions.text import content_hash


def with_hash(files: DataFrame, content: str = "content") -> DataFrame:
    return files.withColumn("file_hash", content_hash(F.col(content)))


def first_copies(files: DataFrame, order: str = "path", *carry: str) -> DataFrame:
    """One row per distinct content: its hash, the first ``order`` value with the ``carry``
    columns of the same row, and the number of copies.

    Only hashes and names are grouped, and copies are reduced before the shuffle, so a
    content that occurs in a third of all files is no hot group.
    """
    first = F.min(F.struct(order, *carry)) if carry else F.min(order)
    grouped = files.groupBy("file_hash").agg(first.alias("_first"), F.count(F.lit(1)).alias("n_copies"))
    columns = [F.col(f"_first.{c}") for c in (order, *carry)] if carry else [F.col("_first").alias(order)]
    return grouped.select("file_hash", *columns, "n_copies")


def not_indexed(files: DataFrame, indexed: DataFrame) -> DataFrame:
    """The files whose hash is not in ``indexed``; ``files`` has unique hashes.

    An outer join rather than an anti join: the optimizer would push an anti join below
    the aggregation that made the hashes unique, where all copies of one content meet in
    one task.  The right side is reduced to distinct hashes here.
    """
    known = indexed.select("file_hash").distinct().withColumn("_known", F.lit(True))
    return files.join(known, "file_hash", "left").where(F.col("_known").isNull()).drop("_known")


def new_files(files: DataFrame, indexed: DataFrame, order: str = "path", *carry: str) -> DataFrame:
    """Files to ingest: not indexed yet, and the first of their copies in this run."""
    return not_indexed(first_copies(files, order, *carry), indexed)
