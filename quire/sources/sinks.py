"""Sinks: names, text, positioned HTML, parts, validated publishing."""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from quire.functions.numbers import half_up_to, plain_number
from quire.functions.text import html_escaped
from quire.operators.layout import gathered_lines

BYTE_ORDER_MARK = "\ufeff"
PAGE_BREAK = "\n\f\n"


# Pages of one piece of a text file; most documents are a single piece.
PIECE_PAGES = 4096


def unique_names(df: DataFrame, stem: str, order: str, extension: str) -> DataFrame:
    """Case-insensitive collisions get `` (2)``, `` (3)``... by ``order``, an integer unique
    among equal stems.  A very common stem is numbered stretch by stretch."""
    from quire.operators.scale import running_total

    counted = running_total(df.withColumn("_stem", F.lower(stem)), ["_stem"], order, F.lit(1), "_earlier")
    n = F.col("_earlier") + 1
    return counted.withColumn(
        "name",
        F.concat(
            F.col(stem),
            F.when(n > 1, F.concat(F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.lit("")),
            F.lit(extension),
        ),
    ).drop("_stem", "_earlier")


def text_documents(page_texts: DataFrame, piece_pages: int = PIECE_PAGES) -> DataFrame:
    """Text files as ``doc_id, piece, content``; the pieces of a document in order are its file.

    A byte order mark first, form feeds between pages, a newline last.  A piece holds
    a bounded run of pages, so no document is gathered whole however long it is.
    """
    last = page_texts.groupBy("doc_id").agg(F.max("page").alias("last_page"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("page", "text"))), lambda p: p["text"])
    pieces = (
        page_texts.withColumn("piece", F.floor((F.col("page") - 1) / piece_pages))
        .groupBy("doc_id", "piece")
        .agg(F.array_join(ordered, PAGE_BREAK).alias("body"), F.max("page").alias("to_page"))
        .join(last, "doc_id")
    )
    start = F.when(F.col("piece") == 0, F.lit(BYTE_ORDER_MARK)).otherwise(F.lit(""))
    end = F.when(F.col("to_page") == F.col("last_page"), F.lit("\n")).otherwise(F.lit(PAGE_BREAK))
    return pieces.select("doc_id", "piece", F.concat(start, F.col("body"), end).alias("content"))


def html_sections(lines: DataFrame, width: float, height: float) -> DataFrame:
    """One positioned section per page: a span per line, measured from the top left.

    ``lines``: page rows with their lines, whose sections are made inside the row, or line rows.
    """

    def near(value):
        return plain_number(half_up_to(value, 2))

    def span(line):
        return F.concat(
            F.lit('<span style="left:'), near(line["left"]),
            F.lit("pt;top:"), near(F.lit(height) - line["y"] - line["height"]),
            F.lit("pt;font-size:"), near(line["height"]), F.lit('pt">'),
            html_escaped(line["text"]), F.lit("</span>"),
        )

    pages = gathered_lines(lines, ["text", "y", "left", "height"])
    head = F.concat(
        F.lit(f'<section class="page" style="width:{width:g}pt;height:{height:g}pt" aria-label="Page '),
        F.col("page").cast("string"), F.lit('">'),
    )
    spans = F.array_join(F.transform("lines", span), "\n")
    return pages.select("doc_id", "page", F.concat(head, F.lit("\n"), spans, F.lit("\n</section>")).alias("section"))


def write_parts(df: DataFrame, path: str, part: str = "part") -> None:
    """Each part of the pages as its own output folder."""
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def publish(df: DataFrame, folder: str, name: str) -> str:
    """Write, read back, verify, then point at it.

    The rows go to a folder of their own; their count and an order-free hash, observed
    while they were written, are compared with what is read back, and only then a row
    that names the new folder is added to the pointers.  Pointers are never deleted, so
    a reader, who takes the latest, sees the old or the new rows and never a mixture.
    """
    spark = df.sparkSession
    version = f"{name}-{spark.sparkContext.applicationId}-{id(df):x}"
    target = os.path.join(folder, version)
    digest = [F.count("*").alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("h")]
    seen = Observation()
    df.observe(seen, *digest).write.mode("errorifexists").parquet(target)
    written = spark.read.parquet(target).agg(*digest).first()
    if seen.get != written.asDict():
        raise IOError(f"{target} does not hold what was written to it")
    pointer = spark.createDataFrame([(time.time_ns(), target)], "at long, path string").coalesce(1)
    pointer.write.mode("append").parquet(os.path.join(folder, f"{name}.pointers"))
    return target


def published(spark, folder: str, name: str) -> DataFrame:
    pointers = spark.read.parquet(os.path.join(folder, f"{name}.pointers"))
    return spark.read.parquet(pointers.agg(F.max_by("path", "at")).first()[0])
