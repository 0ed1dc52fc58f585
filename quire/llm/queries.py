"""The queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import classifier, interpolation, lines, mixing, neardup, outliers, packing, resampling, runs, secrets, sharding, suffixes, topk
from quire.llm.shared import text_bytes
from quire.session import settle, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return fn(settle(spark), folder)

        QUERIES[name] = run
        if sql is not None:
            SQL[name] = sql.strip()
        return run

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_ownership_frequency")
def op1(spark, folder):
    return secrets.digest(secrets.secrets_by_ownership(table(spark, folder, "documents")))


@query("op2_poisson_mixture")
def op2(spark, folder):
    """Sources to the 0.7th power of their sizes; one row per copy."""
    return mixing.poisson_mixture(table(spark, folder, "documents")).select(
        "doc_id", "source", "copy", "rate", "n_chars", F.crc32(F.coalesce("text", F.lit(""))).alias("text_crc32")
    )


@query(
    "op3_no_random_access_topk",
    """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
met AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM met)
SELECT query_id, CAST(place AS INTEGER) AS rank, vec_id, score FROM placed WHERE place <= 5""",
)
def op3(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


@query("op4_odd_sketches")
def op4(spark, folder):
    return neardup.near_duplicates(table(spark, folder, "documents")).drop("text_hash")


@query("op5_winnowed_lines")
def op5(spark, folder):
    return lines.dedup_lines(table(spark, folder, "documents")).select("doc_id", "text", "deleted_words")


@query("op6_two_pass_shuffle")
def op6(spark, folder):
    shuffled = sharding.two_pass_shuffle(table(spark, folder, "documents"))
    return shuffled.select(
        "doc_id", (text_bytes("text") + 8).alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"), "shard", "slot", "grown_shard",
    )


@query("op7_hierarchical_packing")
def op7(spark, folder):
    pieces = packing.packed_sequences(table(spark, folder, "documents"), tokenizer_path())
    return packing.with_digest(pieces).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )


@query("op9_deleted_interpolation")
def op9(spark, folder):
    return interpolation.interpolated_scores(table(spark, folder, "documents"))


@query("op10_robust_outliers")
def op10(spark, folder):
    return outliers.robust_rules(table(spark, folder, "documents"))


@query("op8_rule_ensemble")
def op8(spark, folder):
    return classifier.scored(table(spark, folder, "documents"), table(spark, folder, "labels"))


@query("op11_dictionary_resampling")
def op11(spark, folder):
    drawn = resampling.importance_resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query(
    "op12_previous_factors",
    """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT r, doc_id, i, substr(x, 2 * i + 1, 100) AS s FROM (SELECT *, unnest(range(length(x) // 2 - 49)) AS i FROM d)),
m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
f AS (SELECT r, i FROM w JOIN m USING (s) WHERE doc_id > least),
g AS (SELECT r, i, CAST(coalesce(i - lag(i) OVER (PARTITION BY r ORDER BY i) > 50, TRUE) AS INTEGER) AS new FROM f),
h AS (SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS span FROM g),
spans AS (SELECT r, min(i) AS b, max(i) + 50 AS e FROM h GROUP BY r, span),
gaps AS (SELECT r, b, e, coalesce(lag(e) OVER (PARTITION BY r ORDER BY b), 0) AS before FROM spans),
kept AS (
  SELECT d.r, count(*) AS n, sum(e - b) AS gone, max(e) AS tail, string_agg(substr(x, 2 * before + 1, 2 * (b - before)), '' ORDER BY b) AS y
  FROM gaps JOIN d ON d.r = gaps.r GROUP BY d.r)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
  CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN x ELSE y || substr(x, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
)
def op12(spark, folder):
    return suffixes.digest(suffixes.remove_repeats(table(spark, folder, "documents")))


@query("op13_dyadic_squares")
def op13(spark, folder):
    return runs.digest(runs.periodic_runs(table(spark, folder, "documents"), runs.planted))
