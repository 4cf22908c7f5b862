"""Schemas of the tables the jobs exchange."""

from __future__ import annotations

from pyspark.sql import types as T

FILE_METADATA = T.StructType(
    [
        T.StructField("file_title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("creation_date", T.StringType()),
    ]
)

PAGE = T.StructType(
    [
        T.StructField("page_number", T.IntegerType()),
        T.StructField("text", T.StringType()),
    ]
)

PARSED_FILE = T.StructType(
    [
        T.StructField("pages", T.ArrayType(PAGE)),
        T.StructField("metadata", FILE_METADATA),
    ]
)

PAYLOAD = T.StructType(
    [
        T.StructField("file_name", T.StringType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("file_title", T.StringType()),
        T.StructField("authors", T.StringType()),
        T.StructField("keywords", T.StringType()),
        T.StructField("creation_date", T.StringType()),
        T.StructField("page_number", T.StringType()),
        T.StructField("text", T.StringType()),
        T.StructField("summary", T.StringType()),
    ]
)

VECTOR = T.ArrayType(T.FloatType(), False)

POINT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("vector", VECTOR),
        T.StructField("payload", PAYLOAD),
    ]
)

QA_ITEM = T.StructType(
    [
        T.StructField("question", T.StringType()),
        T.StructField("ground_truth", T.StringType()),
        T.StructField("answer", T.StringType()),
    ]
)
