"""The list of runnable queries and, where SQL can say the same, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.session import settle

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
COVERS: dict[str, str] = {}


def _plain(df: DataFrame) -> DataFrame:
    """Small integers widen to 64 bits, so both engines ship the same types."""
    wide = {"int", "smallint", "tinyint"}
    return df.select(
        *[F.col(f"`{n}`").cast("bigint").alias(n) if t in wide else F.col(f"`{n}`") for n, t in df.dtypes]
    )


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(spark, folder)``; ``covers`` names the inventory lines it runs."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return _plain(fn(settle(spark), folder))

        run.module = fn.__module__.rsplit(".", 1)[-1]
        QUERIES[name] = run
        COVERS[name] = covers
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return register
