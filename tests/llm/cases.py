"""Rows that every operator must take: nulls, empties, long texts, repeats, clashing names."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("row", T.StringType()), T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    T.StructField("c0", T.LongType()), T.StructField("shard", T.StringType()), T.StructField("words", T.StringType()),
    T.StructField("score", T.DoubleType()), T.StructField("extra", T.MapType(T.StringType(), T.LongType())),
])


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def odd_rows():
    rng = random.Random(1)
    long = words(rng, 30_000, 5000)
    texts = [None, "", " \n\t ", "one", "Two words", "é à ü", long, words(rng, 80), "a b c d e\n" * 40]
    rows = [("r", i, t, "en" if i % 2 else None, None if i % 3 == 0 else f"s{i % 2}", len(t or ""), i, "x", "y", 0.5, {"k": 1}) for i, t in enumerate(texts)]
    rows += [("r", None, "no id here", "de", "s1", 10, 1, None, None, None, None), (None,) * 11]
    rows += [rows[7], rows[7], rows[3]]  # rows that repeat whole
    return rows


def odd_docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def docs_of(spark, texts, **more):
    rows = [("r", i, t, more.get("lang", "en"), more.get("source", "s"), len(t or ""), 0, "x", "y", 0.0, None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)
