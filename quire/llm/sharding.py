"""Sharding by a two-pass external shuffle.

Pass 1 scatters the records uniformly into buckets that fit in memory: the shard
is the winner of a seeded rendezvous of the record's id with every shard, and
inside a shard a second seeded hash picks the bucket.  Pass 2 shuffles each bucket
in memory (``shuffle`` is Spark's Fisher-Yates) and lays the buckets end to end.
Everything is built-in functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from quire.llm.shared import packed, stored, text_bytes, unpacked

LAW = "key"


def rendezvous(key: Column, shards: int, seed: int) -> Column:
    """The shard of a key; with one more shard a key stays or moves to that one."""
    bids = [F.struct(F.xxhash64(F.lit(seed), key, F.lit(s)).alias("bid"), F.lit(s).alias("shard")) for s in range(shards)]
    return (F.greatest(*bids) if shards > 1 else bids[0])["shard"]


def _sortable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_sortable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _sortable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))


def two_pass_shuffle(
    docs: DataFrame, shards: int = 24, seed: int = 20, bucket_bytes: int = 16 << 20, cells: int = 4096
) -> DataFrame:
    """Every record with its ``shard``, its ``slot`` there (gapless from 0) and ``grown_shard``.

    The id and the number of shards decide the shard (law ``key``).  A shard's
    records fall into ``cells`` cells by a hash of id and text; neighbouring cells
    make buckets of about ``bucket_bytes``, so only one bucket is ever held in
    memory by a task.  Records are ordered by hash before Fisher-Yates, so a task
    that runs again deals the same slots.

    Null ids fall into one shard, as the law asks, but spread over its buckets by
    their texts; null texts have no bytes; a table without rows gives none; rows
    that repeat whole keep one slot each.  Other columns travel along; those named
    like a result are replaced.
    """
    names = docs.columns
    rows = packed(docs, "doc_id", "text")
    spot = F.xxhash64(F.lit(seed + 1), "doc_id", "text")
    placed = rows.select(
        rendezvous(F.col("doc_id"), shards, seed).alias("shard"),
        rendezvous(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
        spot.alias("spot"),
        F.shiftrightunsigned(spot, 64 - int(math.log2(cells))).cast("int").alias("cell"),
        (text_bytes("text") + 8).alias("size"),
        "row",
    )
    # At most shards * cells rows, whatever the input.
    filled = stored(
        placed.groupBy("shard", "cell").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes")), "shard-cells"
    )
    buckets = {
        r["shard"]: min(cells, max(1, math.ceil(r["bytes"] / bucket_bytes)))
        for r in filled.groupBy("shard").agg(F.sum("bytes").alias("bytes")).collect()  # one row a shard
    }
    how_many = F.element_at(F.array(*[F.lit(buckets.get(s, 1)) for s in range(shards)]), F.col("shard") + 1)
    bucket = F.floor(F.col("cell") * how_many / F.lit(cells)).cast("int")
    ends = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        filled.withColumn("bucket", bucket).groupBy("shard", "bucket").agg(F.sum("rows").alias("rows"))
        .select("shard", "bucket", F.coalesce(F.sum("rows").over(ends), F.lit(0)).alias("start"))
    )
    held = F.collect_list(F.struct("spot", "grown_shard", "row"))
    kinds = rows.schema["row"].dataType
    in_order = (
        F.sort_array(held) if _sortable(kinds)
        else F.array_sort(held, lambda a, b: F.when(a["spot"] < b["spot"], -1).when(a["spot"] > b["spot"], 1).otherwise(0))
    )
    return (
        placed.withColumn("bucket", bucket).groupBy("shard", "bucket").agg(in_order.alias("records"))
        .join(starts, ["shard", "bucket"])
        .sortWithinPartitions("shard", "bucket")
        .select("shard", "bucket", "start", F.shuffle("records", seed).alias("records"))
        .select("shard", "start", F.posexplode("records").alias("pos", "record"))
        .select("shard", (F.col("start") + F.col("pos")).alias("slot"), "record.grown_shard", "record.row")
        .select(*unpacked(names, {"shard": "shard", "slot": "slot", "grown_shard": "grown_shard"}))
    )


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """The shuffled records as Parquet, one folder a shard, each file in slot order."""
    (
        two_pass_shuffle(docs, **how).repartition("shard").sortWithinPartitions("shard", "slot")
        .write.partitionBy("shard").mode("errorifexists").parquet(path)
    )
