"""Edit logs: order lines as edits of laid-out documents, turns as comment edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import editlog as ops
from quire.plans.notes import annotations
from quire.plans.pages import counts
from quire.plans.registry import query
from quire.plans.trees import _FOREST, path_rows
from quire.session import table

KINDS = ["rotatePages", "movePages", "duplicatePages", "insertBlankPages", "cropPages", "deletePages", "applyRedactions"]


def page_log(spark, folder):
    """Each order line edits the document numbered like its part; one order is one transaction."""
    p, n = F.col("l_partkey"), F.col("l_linenumber")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), n)
    return table(spark, folder, "lineitem").select(
        p.alias("doc_id"), F.col("l_orderkey").alias("txn"), (n * 1000000 + F.col("l_suppkey")).alias("op_index"), kind.alias("kind"),
        F.array((F.col("l_suppkey") % 4 + 1), (F.col("l_orderkey") % 3 + 1)).alias("pages"),
        F.when(n == 1, F.col("l_quantity").cast("bigint") % 3 * 90 + 90).when(n == 2, F.col("l_quantity").cast("bigint") % 4)
        .when(n == 4, F.col("l_quantity").cast("bigint") % 3).alias("number"),
        (F.lit(100.0) + F.col("l_quantity") * 12).alias("width"), F.lit(500.0).alias("height"),
    )


@query("page_edits", "L8 2.12 U3 U4 U5 U6")
def page_edits(spark, folder):
    documents = counts(spark, folder).select("doc_id", "page_count", F.lit(595.28).alias("width"), F.lit(841.89).alias("height"))
    return ops.page_edits(documents, page_log(spark, folder))


@query(
    "edit_wording",
    "H32",
    """WITH e AS (SELECT l_orderkey, l_linenumber AS n, l_partkey AS p, l_suppkey AS s, list_sort(list_distinct([l_suppkey % 4 + 1, l_orderkey % 3 + 1])) AS pg, l_quantity::BIGINT AS q FROM lineitem),
    w AS (SELECT *, CASE WHEN len(pg) = 1 THEN 'page ' || pg[1] WHEN pg[2] = pg[1] + 1 THEN 'pages ' || pg[1] || '-' || pg[2] ELSE 'pages ' || pg[1] || ', ' || pg[2] END AS listed FROM e)
    SELECT l_orderkey, n::BIGINT AS n, p, s, CASE n WHEN 1 THEN 'Rotate ' || listed || ' ' || CASE q % 3 WHEN 0 THEN 'right' WHEN 2 THEN 'left' ELSE '180°' END WHEN 2 THEN 'Move ' || listed WHEN 3 THEN 'Duplicate ' || listed
      WHEN 4 THEN CASE WHEN q % 3 = 1 THEN 'Insert a blank page' ELSE 'Insert ' || (q % 3) || ' blank pages' END WHEN 5 THEN 'Crop ' || listed WHEN 6 THEN 'Delete ' || listed END AS said FROM w""",
)
def edit_wording(spark, folder):
    log = page_log(spark, folder)
    said = ops.wording(F.col("kind"), F.col("pages"), F.col("number"))
    return log.select(
        F.col("txn").alias("l_orderkey"), F.floor(F.col("op_index") / 1000000).alias("n"), F.col("doc_id").alias("p"),
        (F.col("op_index") % 1000000).alias("s"), said.alias("said"),
    )


@query(
    "comment_edits",
    "2.12",
    """WITH b AS (SELECT conv_id AS doc_id, turn AS id, role AS author, length(text) AS size FROM conversations WHERE turn % 4 > 0),
    ch AS (SELECT conv_id AS doc_id, turn AS id, turn * 3 AS ord, CASE turn % 4 WHEN 0 THEN 'put' WHEN 1 THEN 'patch' WHEN 2 THEN 'delete' ELSE 'patch' END AS kind, CASE WHEN turn % 4 < 2 THEN 'ed' END AS author, CASE WHEN turn % 4 <> 1 THEN length(text) * 10 END AS size FROM conversations
      UNION ALL SELECT conv_id, turn - 1, turn * 3 + 1, 'patch', role || '!', NULL FROM conversations WHERE turn > 0),
    ev AS (SELECT doc_id, id, -1 AS ord, 'put' AS kind, author, size FROM b UNION ALL SELECT * FROM ch),
    lf AS (SELECT doc_id, id, max(ord) FILTER (WHERE kind = 'put') AS p, max(ord) FILTER (WHERE kind = 'delete') AS d FROM ev GROUP BY 1, 2)
    SELECT e.doc_id, e.id, arg_max(author, ord) FILTER (WHERE author IS NOT NULL) AS author, (arg_max(size, ord) FILTER (WHERE size IS NOT NULL))::BIGINT AS size FROM ev e JOIN lf ON lf.doc_id = e.doc_id AND lf.id = e.id AND p IS NOT NULL AND (d IS NULL OR p > d) AND kind <> 'delete' AND ord >= p GROUP BY 1, 2""",
)
def comment_edits(spark, folder):
    c = table(spark, folder, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("id"), "role", F.length("text").alias("n"))
    base = c.where("id % 4 > 0").select("doc_id", "id", F.col("role").alias("author"), F.col("n").alias("size"))
    m = F.col("id") % 4
    own = c.select(
        "doc_id", "id", (F.col("id") * 3).alias("ord"), F.when(m == 0, "put").when(m == 2, "delete").otherwise("patch").alias("kind"),
        F.when(m < 2, "ed").alias("author"), F.when(m != 1, F.col("n") * 10).alias("size"),
    )
    later = c.where("id > 0").select(
        "doc_id", (F.col("id") - 1).alias("id"), (F.col("id") * 3 + 1).alias("ord"), F.lit("patch").alias("kind"),
        F.concat("role", F.lit("!")).alias("author"), F.lit(None).cast("int").alias("size"),
    )
    return ops.folded_rows(base, own.unionByName(later), ["doc_id", "id"], ["author", "size"])


@query(
    "recognised_text_edits",
    "2.12",
    """WITH b AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, 'w' || l_partkey AS word FROM lineitem WHERE l_returnflag <> 'R'),
    n AS (SELECT l_orderkey AS doc_id, l_linenumber AS page, l_partkey * 1000 + l_suppkey AS ord, CASE WHEN l_linestatus = 'O' THEN ['x' || l_suppkey, 'y'] ELSE []::VARCHAR[] END AS ws FROM lineitem WHERE l_returnflag = 'R'),
    z AS (SELECT doc_id, page, arg_max(ws, ord) AS ws FROM n GROUP BY 1, 2)
    SELECT doc_id, page::BIGINT AS page, word FROM b WHERE (doc_id, page) NOT IN (SELECT (doc_id, page) FROM z) UNION ALL SELECT doc_id, page, unnest(ws) FROM z""",
)
def recognised_text_edits(spark, folder):
    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus"
    )
    base = lines.where("l_returnflag <> 'R'").select("doc_id", "page", F.concat(F.lit("w"), F.col("l_partkey").cast("string")).alias("word"))
    word = F.array(F.struct(F.concat(F.lit("x"), F.col("l_suppkey").cast("string")).alias("word")), F.struct(F.lit("y").alias("word")))
    none = F.array().cast("array<struct<word:string>>")
    batches = lines.where("l_returnflag = 'R'").select(
        "doc_id", "page", (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("ord"),
        F.when(F.col("l_linestatus") == "O", word).otherwise(none).alias("rows"),
    )
    return ops.replaced_groups(base, batches, ["doc_id", "page"])


@query(
    "alt_text_edits",
    "2.12",
    f"""WITH {_FOREST}, g AS (SELECT doc_id, path, CASE level WHEN 1 THEN 'Sect' WHEN 2 THEN 'Figure' ELSE 'Span' END AS type, 'Raw' || level AS raw, CASE WHEN key % 2 = 0 THEN 'old' END AS alt, key, level FROM t),
    ask AS (SELECT doc_id, CASE WHEN key % 10 = 3 THEN path || '.99' ELSE path END AS path, CASE key % 3 WHEN 0 THEN 'Figure' WHEN 1 THEN 'Raw' || level ELSE 'P' END AS expected, CASE WHEN key % 5 = 0 THEN '  ' ELSE ' new ' || key END AS alt FROM g WHERE level > 1),
    j AS (SELECT coalesce(g.doc_id, ask.doc_id) AS doc_id, coalesce(g.path, ask.path) AS path, g.type, g.raw, g.alt AS old, ask.expected, ask.alt AS new, ask.path IS NOT NULL AS asked FROM g FULL JOIN ask ON ask.doc_id = g.doc_id AND ask.path = g.path)
    SELECT doc_id, path, CASE WHEN asked AND (expected = type OR expected = raw) THEN nullif(trim(new), '') ELSE old END AS alt, NULL::VARCHAR AS error FROM j WHERE type IS NOT NULL
    UNION ALL SELECT doc_id, path, NULL, 'That element is not in this document any more.' FROM j WHERE asked AND (type IS NULL OR (expected <> type AND expected <> raw))""",
)
def alt_text_edits(spark, folder):
    level, key = F.col("level"), F.col("key")
    rows = path_rows(spark, folder)
    tags = rows.select(
        "doc_id", "path", F.when(level == 1, "Sect").when(level == 2, "Figure").otherwise("Span").alias("type"),
        F.concat(F.lit("Raw"), level.cast("string")).alias("raw_type"), F.when(key % 2 == 0, "old").alias("alt"),
    )
    changes = rows.where("level > 1").select(
        "doc_id", F.when(key % 10 == 3, F.concat("path", F.lit(".99"))).otherwise(F.col("path")).alias("path"),
        F.when(key % 3 == 0, "Figure").when(key % 3 == 1, F.concat(F.lit("Raw"), level.cast("string"))).otherwise("P").alias("expected"),
        F.lit(1).alias("ord"), F.when(key % 5 == 0, "  ").otherwise(F.concat(F.lit(" new "), key.cast("string"))).alias("alt"),
    )
    after, refused = ops.with_alt_text(tags, changes)
    return after.select("doc_id", "path", "alt").unionByName(refused, allowMissingColumns=True)


@query(
    "metadata_edits",
    "2.12 A25",
    """WITH b AS (SELECT c_custkey AS doc_id, unnest(['title','author','subject']) AS name, unnest([c_name, c_mktsegment, 'n' || c_nationkey]) AS value FROM customer),
    ch AS (SELECT o_custkey AS doc_id, ['title','author','keywords'][o_orderkey % 3 + 1] AS name, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS value, o_orderkey AS ord FROM orders),
    l AS (SELECT doc_id, name, arg_max(coalesce(value, ''), ord) AS new FROM ch GROUP BY 1, 2)
    SELECT coalesce(b.doc_id, l.doc_id) AS doc_id, coalesce(b.name, l.name) AS name, coalesce(new, b.value) AS value FROM b FULL JOIN l ON l.doc_id = b.doc_id AND l.name = b.name WHERE coalesce(new, b.value) <> ''""",
)
def metadata_edits(spark, folder):
    pairs = F.array(
        F.struct(F.lit("title").alias("name"), F.col("c_name").alias("value")), F.struct(F.lit("author").alias("name"), F.col("c_mktsegment").alias("value")),
        F.struct(F.lit("subject").alias("name"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("value")),
    )
    base = table(spark, folder, "customer").select(F.col("c_custkey").alias("doc_id"), F.inline(pairs))
    names = F.array(F.lit("title"), F.lit("author"), F.lit("keywords"))
    changes = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("doc_id"), F.element_at(names, (F.col("o_orderkey") % 3 + 1).cast("int")).alias("name"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("value"), F.col("o_orderkey").alias("ord"),
    )
    return ops.metadata_edits(base, changes)


@query("outline_edits", "2.12 G4")
def outline_edits(spark, folder):
    rows = path_rows(spark, folder)
    marks = rows.select("doc_id", "path", F.col("node").alias("order"), F.concat(F.lit("t"), F.col("key").cast("string")).alias("title"))
    kinds = F.array(F.lit("updateBookmark"), F.lit("moveBookmark"), F.lit("deleteBookmark"), F.lit("addBookmark"))
    k = F.col("key")
    log = rows.select(
        "doc_id", F.col("node").alias("ord"), F.element_at(kinds, (k % 4 + 1).cast("int")).alias("kind"), "path",
        F.concat(F.lit("t"), k.cast("string")).alias("expected"), F.when(k % 4 == 3, F.lit("0")).otherwise(F.lit("")).alias("parent"),
        F.lit(1).cast("bigint").alias("index"), F.concat(F.lit("new "), k.cast("string")).alias("title"),
    )
    return ops.outline_edits(marks, log)
