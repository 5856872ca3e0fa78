"""Record types."""

from __future__ import annotations

from pyspark.sql import types as T

FACTS = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("year_cleaned", T.IntegerType()),
    T.StructField("crop", T.StringType()),
    T.StructField("production", T.DoubleType()),
    T.StructField("yield", T.DoubleType()),
    T.StructField("annual_rainfall", T.DoubleType()),
])

METADATA = T.StructType([
    T.StructField("state", T.StringType()),
    T.StructField("district", T.StringType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("crop", T.StringType()),
    T.StructField("production", T.DoubleType()),
    T.StructField("yield", T.DoubleType()),
    T.StructField("annual_rainfall", T.DoubleType()),
    T.StructField("source", T.StringType()),
    T.StructField("created_at", T.StringType()),
])

DOCUMENT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("metadata", METADATA),
])

VECTOR = T.StructType([*DOCUMENT.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])

MANIFEST = T.StructType([
    T.StructField("model_name", T.StringType()),
    T.StructField("embedding_dim", T.IntegerType()),
    T.StructField("num_vectors", T.LongType()),
    T.StructField("index_type", T.StringType()),
])

QUESTION = T.StructType([
    T.StructField("question_id", T.LongType()),
    T.StructField("query", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
])

ANSWER = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("top_k", T.IntegerType()),
    T.StructField("temperature", T.DoubleType()),
    T.StructField("answer", T.StringType()),
    T.StructField("num_sources", T.IntegerType()),
    T.StructField("batch", T.StringType()),
])

LOG = T.StructType([
    T.StructField("query", T.StringType()),
    T.StructField("timestamp", T.StringType()),
    T.StructField("answer_preview", T.StringType()),
])
