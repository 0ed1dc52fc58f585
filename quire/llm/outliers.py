"""Robust multivariate outliers of text statistics, in built-in functions.

Per language and source, the minimum covariance determinant estimate of the mean
and covariance of transformed statistics is found by concentration steps from a
deterministic start; documents far off by their Mahalanobis distance are rejected.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import pick, stored
from quire.llm.stats import with_statistics

# The transformed vector: its parts and the least spread each is given, so that a
# part that is constant in the clean half (no symbols, no repeats) stays usable.
PARTS = ("size", "letters", "symbols", "lines", "repeats")
LEAST_SPREAD = {"size": 0.5, "letters": 0.1, "symbols": 0.25, "lines": 0.35, "repeats": 0.15}
COVERED = 0.75
STEPS = 3
LEAST_ROWS = 60
LIMIT = 1e-5


def chi2_cdf(x: float, k: int) -> float:
    """The chi-square distribution function by the series of the lower gamma function."""
    if x <= 0:
        return 0.0
    a, z = k / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= z / (a + n)
        total += term
    return total * math.exp(-z + a * math.log(z) - math.lgamma(a))


def chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, k) < p else (low, mid)
    return low


def consistency(covered: float, k: int) -> float:
    """What the covariance of the closest ``covered`` share of a normal sample is of the whole."""
    return chi2_cdf(chi2_quantile(covered, k), k + 2) / covered


def _vector() -> dict[str, Column]:
    words = F.col("n_words")
    share = lambda a: F.asin(F.sqrt(F.least(F.lit(1.0), a / F.greatest(words, F.lit(1)))))
    return {
        "size": F.log1p(words),
        "letters": F.log((F.col("word_chars") + 1) / (words + 1)),
        "symbols": F.log1p(100 * F.col("n_symbols") / (F.col("word_chars") + 1)),
        "lines": F.log1p(F.col("n_dup_lines")),
        "repeats": share(F.col("n_repeat_words")),
    }


def _pairs() -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(PARTS) for b in PARTS[: i + 1]]


def _factored(moments: DataFrame) -> DataFrame:
    """``m_*`` and the Cholesky factor ``l_*`` of the covariances ``c_*``."""
    out = moments
    for i, a in enumerate(PARTS):
        for b in PARTS[: i + 1]:
            known = sum((F.col(f"l_{a}_{x}") * F.col(f"l_{b}_{x}") for x in PARTS[: PARTS.index(b)]), F.lit(0.0))
            rest = F.col(f"c_{a}_{b}") - known
            value = F.sqrt(F.greatest(rest, F.lit(1e-9))) if a == b else rest / F.col(f"l_{b}_{b}")
            out = out.withColumn(f"l_{a}_{b}", value)
    return out.select("area", *[f"m_{p}" for p in PARTS], *[f"l_{a}_{b}" for a, b in _pairs()])


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    z: dict[str, Column] = {}
    for i, a in enumerate(PARTS):
        known = sum((F.col(f"l_{a}_{b}") * z[b] for b in PARTS[:i]), F.lit(0.0))
        z[a] = (F.col(a) - F.col(f"m_{a}") - known) / F.col(f"l_{a}_{a}")
    return sum((v * v for v in z.values()), F.lit(0.0))


def _ridge(a: str, b: str) -> Column:
    return F.lit(LEAST_SPREAD[a] ** 2 if a == b else 0.0)


def _start(rows: DataFrame) -> DataFrame:
    """Medians and quartile spreads, without correlations."""
    thirds = rows.groupBy("area").agg(*[F.percentile_approx(p, [0.25, 0.5, 0.75], 10000).alias(p) for p in PARTS])
    made = {f"m_{p}": F.col(p)[1] for p in PARTS}
    for a, b in _pairs():
        spread = F.pow((F.col(a)[2] - F.col(a)[0]) / F.lit(1.349), F.lit(2.0)) if a == b else F.lit(0.0)
        made[f"c_{a}_{b}"] = spread + _ridge(a, b)
    return _factored(thirds.select("area", *[v.alias(k) for k, v in made.items()]))


def _concentrate(rows: DataFrame, now: DataFrame, covered: float) -> DataFrame:
    """Mean and covariance of each area's closest rows under the estimate ``now``."""
    far = rows.join(now, "area").select("area", *PARTS, _distance().alias("far"))
    limit = far.groupBy("area").agg(F.percentile_approx("far", covered, 10000).alias("limit"))
    near = far.join(limit, "area").where("far <= limit")
    factor = consistency(covered, len(PARTS))
    return near.groupBy("area").agg(
        *[F.avg(p).alias(f"m_{p}") for p in PARTS],
        *[(F.covar_pop(a, b) / F.lit(factor) + _ridge(a, b)).alias(f"c_{a}_{b}") for a, b in _pairs()],
    )


def estimates(rows: DataFrame, covered: float = COVERED, steps: int = STEPS) -> DataFrame:
    """One row per area of ``rows``: the concentrated mean and Cholesky factor."""
    now = stored(_start(rows), "mcd")
    for _ in range(steps):
        now = stored(_factored(_concentrate(rows, now, covered)), "mcd")
    return now


def _areas(rows: DataFrame, least: int) -> DataFrame:
    """Where each (language, source) is estimated: alone, with its language's small ones, or with all small ones."""
    n = rows.where("not base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"))
    own = F.when(F.col("n") >= least, F.to_json(F.struct(F.lit(1).alias("k"), "lang", "source")))
    small = n.where(F.col("n") < least).groupBy("lang").agg(F.sum("n").alias("n_lang")).withColumnRenamed("lang", "small")
    wide = F.when(F.col("n_lang") >= least, F.to_json(F.struct(F.lit(2).alias("k"), "lang"))).otherwise(F.lit("{}"))
    return n.join(small, F.col("lang").eqNullSafe(F.col("small")), "left").select(
        F.col("lang").alias("of_lang"), F.col("source").alias("of_source"), F.coalesce(own, wide).alias("area")
    )


def robust_rules(docs: DataFrame, limit: float = LIMIT, least_rows: int = LEAST_ROWS) -> DataFrame:
    """Per document its counts, the base rules' verdict, its distance and whether it is kept.

    The base rules fail documents under 50 words or with more than half of their words
    in repeated windows.  The others of a language and source make one area; areas
    under ``least_rows`` documents are estimated with the small ones of their language,
    and if those are too few, with all small ones.  A document is rejected when a
    normal vector would lie as far with a probability below ``limit``.  An area
    without any estimate keeps its documents.

    Null and empty texts have no words and fail the base rules; null languages and
    sources are values like others; rows that repeat are judged each; a table without
    rows gives none; other columns are not looked at.
    """
    counted = with_statistics(pick(docs, "doc_id", "text", "lang", "source"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = stored(
        counted.withColumn("base_failed", failed).select("*", *[v.alias(k) for k, v in _vector().items()]), "text-statistics"
    )
    areas = stored(_areas(rows, least_rows), "areas")
    placed = stored(
        rows.join(areas, F.col("lang").eqNullSafe(F.col("of_lang")) & F.col("source").eqNullSafe(F.col("of_source")), "left")
        .drop("of_lang", "of_source"),
        "placed-statistics",
    )
    now = estimates(placed.where("not base_failed"))
    far = _distance()
    most = chi2_quantile(1 - limit, len(PARTS))
    return placed.join(now, "area", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.coalesce(far <= F.lit(most), F.lit(True))).alias("kept"),
        F.when(~F.col("base_failed"), F.sqrt(far)).alias("distance"),
    )
