"""A store of model calls: what a model said to a text is asked once.

Results lie in a Parquet table under the model's name, addressed by the hash of the text.  Before a call
the texts are reduced to distinct ones and those with a result are left out, so copies of a text and
repeated runs cost no call.  A run that dies leaves only results that are right, and the next one asks
for what is missing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from hashlib import sha256

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioscope.session import stored


@dataclass(frozen=True)
class CallStore:
    """Calls of any models below ``path``, any file system that Spark can write to."""

    spark: SparkSession
    path: str

    def _folder(self, model: str) -> str:
        return f"{self.path.rstrip('/')}/{sha256(model.encode()).hexdigest()[:16]}"

    def results(self, model: str, kind: T.DataType) -> DataFrame:
        """``(key, result)`` of all calls of a model; two writers may have made the same call."""
        schema = T.StructType([T.StructField("key", T.StringType()), T.StructField("result", kind)])
        try:
            return self.spark.read.schema(schema).parquet(self._folder(model))
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def call(
        self, rows: DataFrame, text: str, model: str, ask: Callable[[Column], Column], result: str = "reply"
    ) -> DataFrame:
        """``rows`` with ``result``, what ``ask`` gives for the column ``text``.

        A null text has a null result and is not asked for.
        """
        keyed = rows.withColumn("_key", F.sha2(text, 256))
        # A copy of a text is as good as any other; the aggregation drops most copies before it shuffles.
        distinct = keyed.where(F.col(text).isNotNull()).groupBy("_key").agg(F.first(text).alias("_text"))
        kind = distinct.select(ask(F.col("_text")).alias("result")).schema["result"].dataType
        known = self.results(model, kind)
        fresh = distinct.join(known.select(F.col("key").alias("_key")), "_key", "left_anti")
        asked = fresh.select(F.col("_key").alias("key"), ask(F.col("_text")).alias("result"))
        asked.write.mode("append").parquet(self._folder(model))
        found = self.results(model, kind).join(distinct.select(F.col("_key").alias("key")), "key", "left_semi")
        # Written apart: Spark takes two reads of one folder in one plan for the same, also if files came between.
        found = stored(found.groupBy(F.col("key").alias("_key")).agg(F.first("result").alias(result)), "calls")
        return keyed.join(found, "_key", "left").drop("_key")
