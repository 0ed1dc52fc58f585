"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is its target share of the mixture over its share
of the corpus.  Each document's count is the inverse of the Poisson distribution
of that mean at a uniform number that a seeded hash of the document gives, so a
run can be repeated.  The copies are then shuffled globally.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import packed, stored, text_bytes, unpacked


def repetition_rates(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, scale: float = 1.0
) -> DataFrame:
    """A row per source: size, target share, mean repetitions and the Poisson distribution.

    Sizes are bytes of text plus one per document, so sources of empty texts have a
    size.  Without ``weights`` a source's target weight is its size to ``power``;
    with them, sources that ``weights`` does not name get nothing.  The mixture has
    ``scale`` times the size of the corpus.  ``cdf`` is cut where the rest is below
    what a double can tell from 1.
    """
    sizes = (
        docs.groupBy("source").agg(F.sum(text_bytes("text") + 1).cast("double").alias("size"), F.count("*").alias("docs"))
    )
    if weights is None:
        want = F.pow("size", F.lit(float(power)))
    else:
        want = F.lit(0.0)
        for name, weight in weights.items():
            want = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(weight))).otherwise(want)
    sized = stored(sizes.withColumn("want", want), "source-sizes")
    total = sized.agg(F.sum("size").alias("size"), F.sum("want").alias("want")).first()
    all_size, all_want = total["size"] or 1.0, total["want"] or 1.0
    share = F.col("want") / F.lit(all_want)
    rate = F.col("rate")
    most = (rate + 12 * F.sqrt(rate) + 40).cast("int")
    # Terms as logarithms, so that large means do not underflow.
    start = F.struct((-rate).alias("log"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("cdf"))

    def add(acc, k):
        log = acc["log"] + F.log(rate / k)
        upto = acc["sum"] + F.exp(log)
        return F.struct(log.alias("log"), upto.alias("sum"), F.concat(acc["cdf"], F.array(upto)).alias("cdf"))

    return stored(
        sized.withColumn("share", share).withColumn("rate", F.lit(scale * all_size) * F.col("share") / F.col("size"))
        .withColumn(
            "cdf",
            F.when(rate > 0, F.aggregate(F.sequence(F.lit(1), most), start, add)["cdf"]).otherwise(F.array().cast("array<double>")),
        ),
        "source-rates",
    )


def poisson_mixture(
    docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.7, scale: float = 1.0, seed: int = 7
) -> DataFrame:
    """The documents, each repeated by its Poisson count, in a globally shuffled order.

    ``copy`` numbers a document's repetitions from 0 and ``rate`` is its source's
    mean.  A null source is a source; null texts and ids are values like others;
    rows that repeat whole get the same count each; an empty table gives none.  Each
    copy goes to the partition and place that a hash of id, text and copy names,
    so a hot source spreads evenly.  Columns named like a result are replaced.
    """
    names = docs.columns
    rows = packed(docs, "doc_id", "text", "source")
    rates = repetition_rates(rows, weights, power, scale).select(F.col("source").alias("of"), "rate", "cdf")
    key = F.xxhash64(F.lit(seed), "doc_id", "text")
    uniform = F.shiftrightunsigned(key, 11).cast("double") / F.lit(float(1 << 53))
    counted = (
        rows.withColumn("key", key).withColumn("uniform", uniform)
        # The rates are one small row a source; Spark sees the file's size and broadcasts
        # it below its threshold, or else deals both sides and splits a hot source.
        .join(rates, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("count", F.size(F.filter("cdf", lambda c: c <= F.col("uniform"))))
        .where("count > 0")
    )
    place = F.xxhash64(F.lit(seed + 1), "key", "copy")
    return (
        counted.select("key", "rate", "row", F.explode(F.sequence(F.lit(0), F.col("count") - 1)).alias("copy"))
        .withColumn("place", place)
        .repartition("place").sortWithinPartitions("place")
        .select(*unpacked(names, {"copy": "copy", "rate": "rate"}))
    )
