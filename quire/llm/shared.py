"""What the operators of this package share: picking columns, storing steps, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# White space of the word rule: a blank and the code points 9 to 13.
BLANK = r"[\x20\x09-\x0D]"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    A cluster names it in ``spark.checkpoint.dir``.  Only a local session without
    one (tests) gets a folder of its own.
    """
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(own)
    return own


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder once and go on from the file.

    This cuts the lineage, keeps the rows of one evaluation for every later use,
    and survives the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Exactly these columns, by position, so other columns' names cannot clash."""
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(*[F.col(f"c{at[name]}").alias(name) for name in names])


def packed(df: DataFrame, *names: str) -> DataFrame:
    """``names`` beside ``row``, a struct of every column of ``df`` by position."""
    at = {}
    for i, name in enumerate(df.columns):
        at.setdefault(name, i)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.select(
        *[F.col(f"c{at[name]}").alias(name) for name in names], F.struct("*").alias("row")
    )


def unpacked(names: list[str], new: dict[str, Column | str], row: str = "row") -> list[Column]:
    """The columns of a ``packed`` row under their own names; ``new`` ones replace or follow."""
    made = {k: F.col(v) if isinstance(v, str) else v for k, v in new.items()}
    lower = {k.lower() for k in made}
    kept = [
        F.col(f"{row}.c{i}").alias(name)
        for i, name in enumerate(names)
        if name in made or name.lower() not in lower
    ]
    kept = [made[n].alias(n) if n in made else c for n, c in zip([n for n in names if n in made or n.lower() not in lower], kept)]
    return kept + [c.alias(n) for n, c in made.items() if n not in names]


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text; null has none."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def id_part(doc_id: Column | str, parts: int) -> Column:
    """crc32 of the id's decimal text modulo ``parts``; a null id counts as 0."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")), F.lit(0)) % F.lit(parts)


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once per row."""
    return F.element_at(F.transform(F.array(value), body), 1)
