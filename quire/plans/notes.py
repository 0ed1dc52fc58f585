"""Conversations as comments: a conversation is a document, a turn a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import notes as ops
from quire.plans.registry import query
from quire.session import table


def annotations(spark, folder):
    c, t = F.col("conv_id"), F.col("turn")
    kinds = F.array(F.lit("note"), F.lit("highlight"), F.lit("ink"), F.lit("freeText"))
    return table(spark, folder, "conversations").select(
        c.alias("doc_id"), t.alias("page"), F.element_at(kinds, (F.length("text") % 4 + 1).cast("int")).alias("kind"),
        F.when(c % 5 == 0, F.lit("")).otherwise(F.col("role")).alias("author"), F.md5("text").alias("contents"),
        (F.length("text") % 3 == 0).alias("resolved"),
        F.when(t % 3 > 0, F.timestamp_seconds(c * 1000 + F.length("text"))).alias("created_at"),
        F.when(t % 2 > 0, F.timestamp_seconds(c * 7)).alias("modified_at"),
    )


_NOTES = """a AS (SELECT conv_id AS doc_id, turn AS page, ['note','highlight','ink','freeText'][length(text) % 4 + 1] AS kind, CASE WHEN conv_id % 5 = 0 THEN 'Unknown' ELSE role END AS author, md5(text) AS contents, length(text) % 3 = 0 AS resolved,
  coalesce(CASE WHEN turn % 3 > 0 THEN conv_id * 1000 + length(text) END, CASE WHEN turn % 2 > 0 THEN conv_id * 7 END, 0) AS seconds FROM conversations)"""


@query(
    "comments_view",
    "Q19 F1 T1",
    f"""WITH {_NOTES} SELECT doc_id, page, kind, author, contents, seconds FROM a WHERE kind IN ('note', 'highlight', 'ink') AND author IN ('user', 'Unknown') AND NOT resolved ORDER BY page, seconds""",
)
def comments_view(spark, folder):
    shown = ops.comments(annotations(spark, folder), ["note", "highlight", "ink"], ["user", "Unknown"], "open", "page")
    return shown.select("doc_id", "page", "kind", "author", "contents", F.unix_seconds("time").alias("seconds"))


@query(
    "comment_places",
    "T1 Q19",
    f"""WITH {_NOTES} SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page, seconds) AS by_page, row_number() OVER (PARTITION BY doc_id ORDER BY seconds DESC, page) AS newest,
      row_number() OVER (PARTITION BY doc_id ORDER BY author, page) AS by_author FROM a""",
)
def comment_places(spark, folder):
    placed = ops.comment_places(annotations(spark, folder).withColumn("id", F.col("page")))
    return placed.select("doc_id", "page", "by_page", "newest", "by_author")


@query("comment_kinds", "A10", f"WITH {_NOTES} SELECT DISTINCT doc_id, kind FROM a")
def comment_kinds(spark, folder):
    return ops.kinds_of(annotations(spark, folder))


@query("comment_authors", "A10", f"WITH {_NOTES} SELECT DISTINCT doc_id, author FROM a")
def comment_authors(spark, folder):
    return ops.authors_of(annotations(spark, folder))


@query(
    "ranked_lookup",
    "T2",
    """SELECT p_partkey AS id, p_name AS title, CASE WHEN starts_with(lower(p_name), 'red') THEN 3 WHEN contains(lower(p_name), 'red') THEN 2 WHEN contains(lower(p_brand || ' ' || p_type), 'red') THEN 1 ELSE 0 END::BIGINT AS score
    FROM part WHERE p_size <> 7 AND (contains(lower(p_name), 'red') OR contains(lower(p_brand || ' ' || p_type), 'red') OR contains('shared ' || p_size, 'red'))""",
)
def ranked_lookup(spark, folder):
    entries = table(spark, folder, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_name").alias("title"), F.array("p_brand", "p_type").alias("keywords"),
        F.concat(F.lit("shared "), F.col("p_size").cast("string")).alias("description"), (F.col("p_size") == 7).alias("hidden"),
    )
    return ops.ranked(entries, " RED ").select("id", "title", "score")
