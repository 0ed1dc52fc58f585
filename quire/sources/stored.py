"""Stored JSON read with repair: valid parts survive, the rest falls back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTRY = "struct<path:string,display_name:string,last_opened_at:string,pinned:boolean,size_bytes:bigint>"


def valid_entry(e: Column) -> Column:
    return (
        e["path"].isNotNull() & (e["path"] != "")
        & e["last_opened_at"].try_cast("timestamp").isNotNull()
        & e["pinned"].isNotNull()
        & F.coalesce(e["size_bytes"] >= 0, F.lit(True))
    )


def recents_files(raw: DataFrame) -> DataFrame:
    """``owner, path, display_name, last_opened_at, pinned, size_bytes, repaired``.

    ``raw``: owner, content (``{"version":1,"entries":[...]}``).  Each entry is
    read on its own, so a bad one costs only itself.
    """
    wrapped = F.from_json("content", "struct<version:int,entries:array<string>>")
    texts = raw.select("owner", wrapped.alias("file"), "content")
    parsed = texts.select(
        "owner",
        F.coalesce("file.version", F.lit(-1)).alias("version"),
        F.coalesce(F.transform("file.entries", lambda t: F.from_json(t, ENTRY)), F.array().cast(f"array<{ENTRY}>")).alias("entries"),
    )
    kept = F.filter("entries", valid_entry)
    repaired = (F.col("version") != 1) | (F.size(kept) < F.size("entries"))
    return parsed.select("owner", repaired.alias("repaired"), F.explode(kept).alias("e")).select("owner", "e.*", "repaired")


def merged_settings(base: DataFrame, patch: DataFrame, clearable: list[str]) -> DataFrame:
    """Settings after a patch: ``owner, key, value``.

    A key the patch lacks stays; an explicit null clears only the keys that may be
    cleared and leaves any other as it was.
    """
    p = patch.select("owner", "key", F.col("value").alias("new"), F.lit(True).alias("named"))
    clears = F.col("key").isin(clearable) & F.col("named") & F.col("new").isNull()
    return base.join(p, ["owner", "key"], "full").select(
        "owner", "key", F.when(F.coalesce(clears, F.lit(False)), F.lit(None).cast("string")).otherwise(F.coalesce("new", "value")).alias("value")
    )
