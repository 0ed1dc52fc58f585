"""Session settings the operators rely on."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Building large expressions is slow while call sites are recorded.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


# Spark 4.1 may trust the partitioning of a union whose children's shuffles were
# changed at run time, and then groups a key twice.  Right results come first.
UNION_PARTITIONING = "spark.sql.unionOutputPartitioning"


def settle(spark: SparkSession) -> SparkSession:
    """The run-time setting every query here needs, on a session of any origin."""
    spark.conf.set(UNION_PARTITIONING, "false")
    return spark


def local_session(cores: str = "8", memory: str = "12g", **extra: str) -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quire")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return settle(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Only a local session without one (tests) gets a folder of its own.
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


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from the file.

    Iterative operators call this once per round so that a lost executor costs one
    round, not the whole history.  A file also has its true size: a checkpoint keeps the
    size its plan was guessed to have, and a round that joins a state with itself squares
    that guess until the number alone takes minutes to multiply.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.step_path = path
    return written


def discard(step: DataFrame) -> None:
    """Remove the file of a step that nothing reads any more."""
    context = step.sparkSession.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(step.step_path)
    path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(folder, f"{name}.parquet"))


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash a table by its row key when its files split into fewer tasks than cores.

    A small file is one task however much work each row is.  A large table has
    more splits than cores and is left alone, so nothing is shuffled at scale.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df
