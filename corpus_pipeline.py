"""The training-data pipeline: documents through five stages to packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import classifier, lines, mixing, neardup, packing
from quire.llm.queries import tokenizer_path
from quire.llm.shared import BLANK, stored
from quire.session import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return classifier.keep_good(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without later repeated runs; a document that only repeated others goes."""
    cut = lines.dedup_lines(docs)
    has_words = F.col("text").rlike(f"[^{BLANK[1:]}")
    return cut.where((F.col("deleted_words") == 0) | has_words).select(
        "doc_id", "text", "lang", "source",
        F.when(F.col("deleted_words") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"),
    )


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return neardup.keep_one(docs).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Poisson replication to the sources' target weights."""
    return mixing.poisson_mixture(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of several lengths, as pieces with their ids."""
    return packing.packed_sequences(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources", mix),
    ("packing", pack),
]

# Learned rules, sketches and tokenizers have no SQL; tests hold each stage
# against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written before the next reads them."""
    docs = table(settle(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
