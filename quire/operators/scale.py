"""Running totals, places and runs that do not gather a large group in one task.

A group (a document, a job) may hold a third of all rows.  They cut a
group into stretches of its own order, work inside the stretches, and
settle the stretches against each other on one row per stretch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.session import cut_lineage, discard

STRETCH = 16384


def running_total(
    df: DataFrame, keys: list[str], order: str, value: Column, name: str, stretch: int = STRETCH
) -> DataFrame:
    """``name``: the sum of ``value`` over the rows before this one (by ``order``).

    ``order`` is an integer, unique within the group.
    """
    cut = df.withColumn("_value", value.cast("bigint")).withColumn("_stretch", F.floor(F.col(order) / stretch))
    ahead = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        cut.groupBy(*keys, "_stretch")
        .agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_stretch", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_stretch").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        cut.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
        .join(before, [*keys, "_stretch"])
        .withColumn(name, F.col("_before") + F.col("_inside"))
        .drop("_value", "_stretch", "_inside", "_before")
    )


def runs(df: DataFrame, keys: list[str], number: str, stretch: int = STRETCH) -> DataFrame:
    """Maximal runs of consecutive numbers: ``keys, first, last``."""
    cut = df.select(*keys, F.col(number).cast("bigint").alias("n")).distinct()
    cut = cut.withColumn("_stretch", F.floor(F.col("n") / stretch))
    inside = Window.partitionBy(*keys, "_stretch").orderBy("n")
    short = (
        cut.withColumn("_island", F.col("n") - F.row_number().over(inside))
        .groupBy(*keys, "_stretch", "_island")
        .agg(F.min("n").alias("first"), F.max("n").alias("last"))
    )
    across = Window.partitionBy(*keys).orderBy("first")
    begins = F.coalesce((F.lag("last").over(across) < F.col("first") - 1).cast("int"), F.lit(1))
    return (
        short.withColumn("_begins", begins)
        .withColumn("_run", F.sum("_begins").over(across.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*keys, "_run")
        .agg(F.min("first").alias("first"), F.max("last").alias("last"))
        .drop("_run")
    )


def total_before(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``name``: the sum of ``value`` over the rows of the same ``keys`` (all rows without keys) before each, by ``order``.

    The order may be of any kind, dense or not.  Rows are dealt by sampled ranges of (keys,
    order), so a group that holds a third of all rows, or all of them, lies in many
    tasks; a sum is that of the group in the ranges before plus that in the row's own.
    Rows equal in keys and order share a range; only one row for each range and group
    meets the others of its group.
    """
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    valued = cut_lineage(df.withColumn("_value", value.cast("bigint")))
    dealt = cut_lineage(valued.repartitionByRange(ranges, *by).withColumn("_range", F.spark_partition_id()))
    discard(valued)
    group = [F.col(k) for k in keys] or [F.lit(0)]
    ahead = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        dealt.groupBy(*keys, "_range").agg(F.sum("_value").alias("_sum"))
        .select(*keys, "_range", F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_before"))
    )
    inside = Window.partitionBy(*keys, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        dealt.withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0))).join(before, [*keys, "_range"])
        .withColumn(name, F.col("_before") + F.col("_inside")).drop("_value", "_range", "_inside", "_before")
    )


def placed_in_order(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """``name``: the place (from 1) of each row among those of its ``keys``, by ``order``, as ``total_before`` deals them."""
    return total_before(df, keys, order, F.lit(1), name).withColumn(name, F.col(name) + 1)
