"""Comments: filter, order, authors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "Unknown"


def author(name: Column) -> Column:
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit(UNKNOWN)).otherwise(name)


def comments(
    annotations: DataFrame,
    kinds: list[str] | None = None,
    authors: list[str] | None = None,
    status: str = "all",
    sort: str = "page",
) -> DataFrame:
    """The comments to show, in order; an empty list means everyone or every kind.

    ``annotations``: doc_id, page, kind, author, contents, resolved, created_at,
    modified_at.  A comment's time is when it was made, else changed, else zero.
    Names sort in binary order; pass a collated ``author`` column for another.
    """
    shown = annotations.withColumn("author", author(F.col("author")))
    if kinds:
        shown = shown.where(F.col("kind").isin(kinds))
    if authors:
        shown = shown.where(F.col("author").isin(authors))
    if status == "open":
        shown = shown.where(~F.col("resolved"))
    elif status == "resolved":
        shown = shown.where("resolved")
    time = F.coalesce(F.col("created_at"), F.col("modified_at"), F.timestamp_seconds(F.lit(0)))
    order = {
        "newest": [F.desc("time")],
        "author": [F.asc("author"), F.asc("page")],
        "page": [F.asc("page"), F.asc("time")],
    }[sort]
    return shown.withColumn("time", time).orderBy(*order)


def comment_places(annotations: DataFrame) -> DataFrame:
    """Where each comment of a document stands in its three orders: ``by_page, newest, by_author``.

    Equal times keep the order of ``id``.
    """
    from quire.operators.scale import placed_in_order

    time = F.coalesce(F.unix_micros("created_at"), F.unix_micros("modified_at"), F.lit(0))
    out = annotations.withColumn("author", author(F.col("author"))).withColumn("time", time).withColumn("recent", -time)
    for name, order in (("by_page", ["page", "time", "id"]), ("newest", ["recent", "id"]), ("by_author", ["author", "page", "id"])):
        out = placed_in_order(out, ["doc_id"], order, name)
    return out.drop("recent")


def kinds_of(annotations: DataFrame) -> DataFrame:
    """Kinds of comments of each document that a filter can offer."""
    return annotations.select("doc_id", "kind").distinct()


def authors_of(annotations: DataFrame) -> DataFrame:
    return annotations.select("doc_id", author(F.col("author")).alias("author")).distinct()


def ranked(entries: DataFrame, query: str) -> DataFrame:
    """Lookup by title, keywords and description: how directly each entry matches.

    ``entries``: id, title, keywords (array), description, hidden.  A title that
    begins with the query beats one that holds it, then keywords, then the
    description; a blank query lists everything unranked.
    """
    needle = F.lit(query.strip().lower())
    shown = entries.where(~F.col("hidden"))
    if query.strip() == "":
        return shown.withColumn("score", F.lit(None).cast("int"))
    title = F.lower("title")
    score = (
        F.when(F.startswith(title, needle), 3)
        .when(F.contains(title, needle), 2)
        .when(F.contains(F.lower(F.array_join("keywords", " ")), needle), 1)
        .when(F.contains(F.lower(F.coalesce("description", F.lit(""))), needle), 0)
    )
    return shown.withColumn("score", score).where("score is not null").orderBy(F.desc("score"), "title")
