"""Files as rows: triage without parsing, decoding, byte patterns."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions.facts import document_id, last_extension

HEADER_BYTES, TRAILER_BYTES = 1024, 8192


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``path, size_bytes, modified_at, content`` of the files under a folder."""
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
        .select("path", F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    )


def latin1(content: Column) -> Column:
    return F.decode(content, "ISO-8859-1")


def tail(content: Column, size: int) -> Column:
    n = F.octet_length(content)
    return F.substring(content, F.greatest(n - size, F.lit(0)) + 1, F.lit(size))


def triage(files: DataFrame, revisions: bool = False) -> DataFrame:
    """Facts of each file and, where it is not a document, why.

    ``files``: path, content -> doc_id, path, size_bytes, version, encrypted,
    linearized, error.  Failures stay beside successes.  Only the first and last bytes
    are looked at, unless ``revisions`` (end marks in the whole file) are asked for.
    """
    head = latin1(F.substring("content", 1, HEADER_BYTES))
    version = F.regexp_extract(head, r"%PDF-(\d\.\d)", 1)
    counted = [occurrences(F.col("content"), "%%EOF").alias("revisions")] if revisions else []
    return files.select(
        document_id(F.col("path")).alias("doc_id"),
        "path",
        F.octet_length("content").alias("size_bytes"),
        F.when(version != "", version).alias("version"),
        F.contains(latin1(tail(F.col("content"), TRAILER_BYTES)), F.lit("/Encrypt")).alias("encrypted"),
        *counted,
        F.contains(latin1(F.substring("content", 1, 2048)), F.lit("/Linearized")).alias("linearized"),
        F.when(version == "", F.lit("That file is not a PDF.")).alias("error"),
    )


def occurrences(content: Column, pattern: str) -> Column:
    """Non-overlapping occurrences of a byte pattern."""
    from quire.functions.text import quoted

    return F.regexp_count(latin1(content), F.lit(quoted(pattern)))


def opened(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents that open, each once, and the failures."""
    seen = triage(files)
    good = seen.where("error is null").dropDuplicates(["doc_id"])
    return good, seen.where("error is not null").select("path", "error")


def decoded_text(content: Column) -> Column:
    """Text by its byte order mark; without one it is UTF-8."""
    hexed = F.hex(F.substring(content, 1, 3))
    return (
        F.when(F.startswith(hexed, F.lit("FFFE")), F.decode(F.substring(content, 3, 2147483647), "UTF-16LE"))
        .when(F.startswith(hexed, F.lit("FEFF")), F.decode(F.substring(content, 3, 2147483647), "UTF-16BE"))
        .when(hexed == "EFBBBF", F.decode(F.substring(content, 4, 2147483647), "UTF-8"))
        .otherwise(F.decode(content, "UTF-8"))
    )


def with_provider(files: DataFrame, providers: DataFrame, most: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """Each source with the provider that takes its extension, or why none does.

    ``files``: owner, ord, name, size_bytes; ``providers``: provider, ord, extension.
    The first provider of an extension wins.  Where limits are asked for, an owner's
    sources beyond ``most`` and files beyond ``most_bytes`` become error rows.
    """
    from pyspark.sql import Window

    first = providers.groupBy("extension").agg(F.min_by("provider", "ord").alias("provider"))
    found = files.withColumn("extension", last_extension(F.col("name"))).join(first, "extension", "left")
    error = F.when(F.col("provider").isNull(), "no provider")
    if most_bytes is not None:
        error = F.when(F.col("size_bytes") > most_bytes, "too large").otherwise(error)
    if most is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("owner").orderBy("ord", "name")))
        error = F.when(F.col("n") > most, "too many files").otherwise(error)
    return found.select("owner", "ord", "name", "provider", error.alias("error"))


def png_size(content: Column) -> Column:
    """Width and height of a PNG by its magic, not its name."""
    magic = F.hex(F.substring(content, 1, 8)) == "89504E470D0A1A0A"

    def number(start: int) -> Column:
        return F.conv(F.hex(F.substring(content, start, 4)), 16, 10).cast("bigint")

    return F.when(
        magic & (F.octet_length(content) >= 24), F.struct(number(17).alias("width"), number(21).alias("height"))
    )


def _jpeg_size(data: bytes) -> tuple[int, int] | None:
    """Frame header of a JPEG: walk the segments to the first SOF."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 < len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        marker = data[at + 1]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            return int.from_bytes(data[at + 7 : at + 9], "big"), int.from_bytes(data[at + 5 : at + 7], "big")
        if marker == 0xFF or marker == 0x01 or 0xD0 <= marker <= 0xD9:
            at += 1 if marker == 0xFF else 2
            continue
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return None


def jpeg_sizes(files: DataFrame) -> DataFrame:
    """``path, width, height`` of JPEG files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = [(_jpeg_size(bytes(c)) or (None, None)) for c in batch["content"]]
            yield pd.DataFrame(
                {"path": batch["path"], "width": [s[0] for s in sizes], "height": [s[1] for s in sizes]}, dtype=object
            )

    return files.select("path", "content").mapInPandas(run, "path string, width long, height long")


def health(files: DataFrame) -> DataFrame:
    """Repair verdict per file from its first and last bytes: a header is there and nothing is locked."""
    return triage(files).select(
        "path", "version", "encrypted", "linearized", (F.col("error").isNull() & ~F.col("encrypted")).alias("can_repair")
    )
