"""Order lines as links, fields and attached files that logs of edits change; laid-out pages as text runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import rowedits as ops
from quire.plans import shared_sql as q
from quire.plans.registry import query
from quire.plans.search import pages_of, text_items
from quire.session import cut_lineage, table

_KEY = "l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000"
# Order lines as rows of a document: what stood there first, and one edit each.
_LINES = f"l AS (SELECT l_orderkey AS doc_id, {_KEY} AS ord, l_linenumber AS line, l_partkey AS p, l_suppkey AS s, l_quantity AS qty, l_extendedprice AS price FROM lineitem)"


def _replay(keys: str, fields: list[str], taken: str, missing: str) -> str:
    """SQL that replays edits ``ev`` (keys, ord, kind, msg, fields) over ``base`` (keys, place, fields), one after another."""
    k = keys.split(", ")
    on = lambda a, b: " AND ".join(f"{a}.{x} = {b}.{x}" for x in k)
    new = ", ".join(
        f"CASE WHEN e.msg IS NOT NULL THEN r.{f} WHEN e.kind = 'add' AND (NOT r.alive OR {taken} IS NULL) THEN e.{f} WHEN e.kind = 'update' AND r.alive THEN coalesce(e.{f}, r.{f}) ELSE r.{f} END AS {f}"
        for f in fields
    )
    done = f"(e.msg IS NULL AND ((e.kind = 'add' AND (NOT r.alive OR {taken} IS NULL)) OR (e.kind = 'update' AND r.alive)))"
    return f"""n AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY ord) AS n FROM ev),
    every AS (SELECT {keys} FROM base UNION SELECT {keys} FROM ev),
    r AS (SELECT {', '.join('a.' + x for x in k)}, 0::BIGINT AS n, b.place IS NOT NULL AS alive, b.place, NULL::BIGINT AS touched, {', '.join('b.' + f for f in fields)}, NULL::BIGINT AS ord, NULL::VARCHAR AS kind, NULL::VARCHAR AS error FROM every a LEFT JOIN base b ON {on('a', 'b')}
      UNION ALL
      SELECT {', '.join('r.' + x for x in k)}, e.n, CASE WHEN e.msg IS NOT NULL THEN r.alive WHEN e.kind = 'add' THEN TRUE WHEN e.kind = 'delete' THEN FALSE ELSE r.alive END,
        CASE WHEN {done} AND e.kind = 'add' THEN NULL ELSE r.place END, CASE WHEN {done} THEN e.ord ELSE r.touched END, {new}, e.ord, e.kind,
        CASE WHEN e.msg IS NOT NULL THEN e.msg WHEN e.kind = 'add' AND r.alive THEN {taken} WHEN e.kind <> 'add' AND NOT r.alive THEN {missing} END
      FROM r JOIN n e ON {on('r', 'e')} AND e.n = r.n + 1),
    last AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY n DESC) = 1)"""


_LINK = f"""{_LINES}, k AS (SELECT *, line % 3 AS link, CASE WHEN p % 11 = 0 AND line > 3 THEN 9 ELSE line % 3 % 2 + 1 END AS page FROM l),
base AS (SELECT doc_id, page, link, ord AS place, qty AS x, {{'page': (p % 2 + 1)::BIGINT, 'url': NULL::VARCHAR}} AS target FROM k WHERE line <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, page, link ORDER BY ord) = 1),
ev AS (SELECT doc_id, page, link, ord, ['add', 'update', 'update', 'delete'][s % 4 + 1] AS kind, CASE WHEN p % 3 > 0 THEN price END AS x,
  CASE WHEN s % 4 = 2 THEN NULL WHEN p % 4 = 0 THEN {{'page': NULL::BIGINT, 'url': CASE WHEN p % 5 = 0 THEN 'ftp://x' ELSE 'https://x.org/' || p END}} WHEN p % 7 > 0 THEN {{'page': least(2, p % 5)::BIGINT, 'url': NULL}} END AS target,
  CASE WHEN page > 2 THEN 'That page is not in this document any more.' WHEN s % 4 <> 2 AND p % 4 = 0 AND p % 5 = 0 OR s % 4 = 0 AND p % 4 > 0 AND p % 7 = 0 THEN 'A link can point at a page or at a web address.' END AS msg FROM k WHERE line > 1),
{_replay("doc_id, page, link", ["x", "target"], "'That link is already on the page.'", "'That link is no longer on the page.'")}"""


@query(
    "link_edits",
    "2.12",
    f"""WITH RECURSIVE {_LINK}
    SELECT doc_id, page::BIGINT AS page, link::BIGINT AS link, row_number() OVER (PARTITION BY doc_id, page ORDER BY touched NULLS FIRST, place) AS place, x::DOUBLE AS x, target.page AS target_page, target.url AS url, NULL::BIGINT AS ord, NULL::VARCHAR AS error FROM last WHERE alive
    UNION ALL SELECT doc_id, page, link, NULL, NULL, NULL, NULL, ord, error FROM r WHERE error IS NOT NULL""",
)
def link_edits(spark, folder):
    p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    none = F.lit(None).cast("double")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when((p % 11 == 0) & (line > 3), 9).otherwise(line % 3 % 2 + 1).alias("page"), (line % 3).alias("link"),
        F.expr(_KEY).alias("ord"), p, s, line, "l_quantity", "l_extendedprice",
    )
    first = rows.where("l_linenumber <= 3").groupBy("doc_id", "page", "link").agg(
        F.min("ord").alias("ord"), F.min_by("l_quantity", "ord").alias("x"), F.min_by(p % 2 + 1, "ord").alias("target_page")
    )
    sizes = [none.alias(n) for n in ("y", "width", "height")]
    links = first.select("doc_id", "page", "link", "ord", F.col("x").cast("double").alias("x"), *sizes, "target_page", F.lit(None).cast("string").alias("url"))
    kinds = F.array(*[F.lit(k) for k in ("add", "update", "update", "delete")])
    aimed, web = s % 4 != 2, p % 4 == 0
    log = rows.where("l_linenumber > 1").select(
        "doc_id", "page", "link", "ord", F.element_at(kinds, (s % 4 + 1).cast("int")).alias("kind"),
        F.when(p % 3 > 0, F.col("l_extendedprice").cast("double")).alias("x"), *sizes,
        F.when(aimed & ~web & (p % 7 > 0), p % 5).alias("target_page"),
        F.when(aimed & web, F.when(p % 5 == 0, "ftp://x").otherwise(F.concat(F.lit("https://x.org/"), p.cast("string")))).alias("url"),
    )
    counts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("page_count"))
    after, refused = ops.link_edits(links, log, counts)
    return after.drop("y", "width", "height").unionByName(refused.select("doc_id", "page", "link", "ord", "error"), allowMissingColumns=True)


_FIELD = f"""{_LINES}, k AS (SELECT *, 'f' || s % 3 AS name FROM l),
base AS (SELECT doc_id, name, ord AS place, 1::BIGINT AS page, 'text' AS type, NULL::VARCHAR AS tooltip FROM k WHERE line <= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) = 1),
ev AS (SELECT doc_id, name, ord, ['add', 'update', 'delete'][p % 3 + 1] AS kind, CASE WHEN p % 3 = 0 THEN (CASE WHEN p % 13 = 0 THEN 0 ELSE line % 2 + 1 END)::BIGINT END AS page, CASE WHEN p % 3 = 0 THEN 'check' END AS type, CASE WHEN p % 2 = 0 THEN 'tip ' || p END AS tooltip,
  CASE WHEN p % 3 = 0 AND p % 13 = 0 THEN 'That page is not in this document any more.' END AS msg FROM k WHERE line > 1),
{_replay("doc_id, name", ["page", "type", "tooltip"], "'A field of that name is already in this document.'", "'That field is no longer in this document.'")}"""


@query(
    "field_edits",
    "2.12 Q18",
    f"""WITH RECURSIVE {_FIELD}
    SELECT doc_id, name, page, type, tooltip, NULL::BIGINT AS ord, NULL::VARCHAR AS error FROM last WHERE alive
    UNION ALL SELECT doc_id, name, NULL, NULL, NULL, ord, error FROM r WHERE error IS NOT NULL AND kind <> 'delete'""",
)
def field_edits(spark, folder):
    p, line = F.col("l_partkey"), F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("f"), (F.col("l_suppkey") % 3).cast("string")).alias("name"), F.expr(_KEY).alias("ord"), p, line
    )
    fields = rows.where("l_linenumber <= 2").groupBy("doc_id", "name").agg(F.min("ord").alias("ord")).select(
        "doc_id", "name", "ord", F.lit(1).cast("bigint").alias("page"), F.lit("text").alias("type"), F.lit(None).cast("string").alias("tooltip")
    )
    kinds, adds = F.array(*[F.lit(k) for k in ("add", "update", "delete")]), p % 3 == 0
    log = rows.where("l_linenumber > 1").select(
        "doc_id", "name", "ord", F.element_at(kinds, (p % 3 + 1).cast("int")).alias("kind"),
        F.when(adds, F.when(p % 13 == 0, 0).otherwise(line % 2 + 1)).cast("bigint").alias("page"), F.when(adds, "check").alias("type"),
        F.when(p % 2 == 0, F.concat(F.lit("tip "), p.cast("string"))).alias("tooltip"),
    )
    counts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("page_count"))
    after, refused = ops.field_edits(fields, log, counts, ["type", "tooltip"])
    return after.drop("ord").unionByName(refused.select("doc_id", "name", "ord", "error"), allowMissingColumns=True)


_FILE = f"""{_LINES}, k AS (SELECT *, 'file' || s % 4 || '.txt' AS name FROM l),
base AS (SELECT doc_id, name, ord AS place, p AS size, NULL::VARCHAR AS mime FROM k WHERE line <= 3 QUALIFY row_number() OVER (PARTITION BY doc_id, name ORDER BY ord) = 1),
ev AS (SELECT doc_id, name, ord, CASE WHEN p % 3 = 0 THEN 'delete' ELSE 'add' END AS kind, CASE WHEN p % 3 > 0 THEN p * 10 END AS size, CASE WHEN p % 3 > 0 AND p % 2 = 0 THEN 'text/plain' END AS mime, NULL::VARCHAR AS msg FROM k WHERE line > 2),
{_replay("doc_id, name", ["size", "mime"], "NULL::VARCHAR", "NULL::VARCHAR")}"""


@query(
    "file_edits",
    "2.12 Q24",
    f"""WITH RECURSIVE {_FILE} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS place, name, size, mime FROM last WHERE alive""",
)
def file_edits(spark, folder):
    p = F.col("l_partkey")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("file"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".txt")).alias("name"),
        F.expr(_KEY).alias("ord"), p, "l_linenumber",
    )
    files = rows.where("l_linenumber <= 3").groupBy("doc_id", "name").agg(F.min("ord").alias("ord"), F.min_by("l_partkey", "ord").alias("size")).withColumn(
        "mime", F.lit(None).cast("string")
    )
    log = rows.where("l_linenumber > 2").select(
        "doc_id", "name", "ord", F.when(p % 3 == 0, "delete").otherwise("add").alias("kind"), F.when(p % 3 > 0, p * 10).alias("size"),
        F.when((p % 3 > 0) & (p % 2 == 0), "text/plain").alias("mime"),
    )
    return ops.file_edits(files, log, ["size", "mime"]).select("doc_id", "place", "name", "size", "mime")


# Every page's second run is rewritten and its fourth replaced; then both are edited again.
_TEXT = q.ITEMS + """,
log AS (SELECT doc_id, page, seq, 1 AS ord, 'editText' AS kind, str || ' and ' || doc_id AS text FROM text_items WHERE seq = 1
  UNION ALL SELECT doc_id, page, seq, 2, 'replaceText', 'over ' || left(str, 5) FROM text_items WHERE seq = 3
  UNION ALL SELECT doc_id, page, seq, 3, 'editText', CASE WHEN doc_id % 5 = 0 THEN 'no 日本' ELSE 'late' END FROM text_items WHERE seq = 3
  UNION ALL SELECT doc_id, page, seq, 4, 'editText', 'last ' || page FROM text_items WHERE seq = 1 AND doc_id % 2 = 0
  UNION ALL SELECT DISTINCT doc_id, page, 9999, 5, 'replaceText', 'nowhere' FROM text_items WHERE doc_id % 3 = 0
  UNION ALL SELECT DISTINCT doc_id, page, NULL, 6, 'addText', 'added' FROM text_items
  UNION ALL SELECT DISTINCT doc_id, page + 1000, NULL, 7, 'addText', 'lost' FROM text_items WHERE page = 1),
fresh AS (
  SELECT i.doc_id, i.page, i.seq AS n, CASE WHEN i.seq = 1 AND i.doc_id % 2 = 0 THEN 'last ' || i.page WHEN i.seq = 1 THEN str || ' and ' || i.doc_id WHEN i.seq = 3 THEN '' ELSE str END AS str FROM text_items i
  UNION ALL SELECT doc_id, page, 1000002, text FROM log WHERE ord = 2
  UNION ALL SELECT doc_id, page, 1000006, text FROM log WHERE ord = 6),
laid AS (SELECT doc_id, page, row_number() OVER w - 1 AS seq, str, coalesce(sum(length(str) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_offset FROM fresh WINDOW w AS (PARTITION BY doc_id, page ORDER BY n))"""


@query(
    "text_edits",
    "2.12 W1 S7",
    f"""WITH {_TEXT} SELECT doc_id, page::BIGINT AS page, seq::BIGINT AS seq, str, start_offset, NULL::BIGINT AS ord, NULL::VARCHAR AS error FROM laid
    UNION ALL SELECT doc_id, page, NULL, NULL, NULL, ord, CASE WHEN ord = 7 THEN 'That page is not in this document any more.' WHEN ord = 3 AND doc_id % 5 = 0 THEN 'The font cannot write “日”.' ELSE 'That text is no longer where it was; close the editor and try again.' END FROM log WHERE ord IN (3, 5, 7)""",
)
def text_edits(spark, folder):
    items = cut_lineage(text_items(pages_of(spark, folder)))  # laid out once for all its uses
    at = lambda n: items.where(F.col("seq") == n)
    edit = lambda df, ord_, kind, text: df.select(
        "doc_id", "page", F.col("seq").cast("int").alias("seq"), F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), text.alias("text"), F.lit(70.0).alias("x"), F.lit(40.0).alias("y")
    )
    d = F.col("doc_id")
    every = items.select("doc_id", "page").distinct()
    log = [
        edit(at(1), 1, "editText", F.concat("str", F.lit(" and "), d.cast("string"))), edit(at(3), 2, "replaceText", F.concat(F.lit("over "), F.left("str", F.lit(5)))),
        edit(at(3), 3, "editText", F.when(d % 5 == 0, "no 日本").otherwise("late")), edit(at(1).where(d % 2 == 0), 4, "editText", F.concat(F.lit("last "), F.col("page").cast("string"))),
        edit(every.where(d % 3 == 0).withColumn("seq", F.lit(9999)), 5, "replaceText", F.lit("nowhere")),
        edit(every.withColumn("seq", F.lit(None)), 6, "addText", F.lit("added")),
        edit(every.where("page = 1").select("doc_id", (F.col("page") + 1000).alias("page"), F.lit(None).alias("seq")), 7, "addText", F.lit("lost")),
    ]
    whole = log[0]
    for part in log[1:]:
        whole = whole.unionByName(part)
    after, refused = ops.text_edits(items, whole)
    return after.select("doc_id", "page", F.col("seq").cast("bigint").alias("seq"), "str", F.col("offset").cast("bigint").alias("start_offset")).unionByName(
        refused, allowMissingColumns=True
    )


_OPS = """op AS (SELECT l_suppkey % 50 AS doc_id, l_suppkey % 3 AS page, row_number() OVER (PARTITION BY l_suppkey % 50, l_suppkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS seq,
  ['BDC', 'EMC', 'Tj', 'BMC', 'EMC', 'Tj', 'EMC'][l_partkey % 7 + 1] AS operator, CASE WHEN l_partkey % 7 IN (0, 3) THEN ['Header', 'Span', 'Footer', 'Artifact'][l_partkey % 4 + 1] END AS tag FROM lineitem)"""


@query(
    "tagged_blocks",
    "2.12",
    # One operation after another: where the block to go began and how deep inside it we are.
    f"""WITH RECURSIVE {_OPS},
    w AS (SELECT doc_id, page, 0::BIGINT AS seq, NULL::BIGINT AS begun, 0 AS depth, NULL::BIGINT AS cut_from, NULL::BIGINT AS cut_to FROM (SELECT DISTINCT doc_id, page FROM op)
      UNION ALL SELECT o.doc_id, o.page, o.seq,
        CASE WHEN w.begun IS NULL AND o.operator IN ('BDC', 'BMC') AND o.tag IN ('Header', 'Footer') THEN o.seq WHEN w.begun IS NOT NULL AND o.operator = 'EMC' AND w.depth = 0 THEN NULL ELSE w.begun END,
        CASE WHEN w.begun IS NULL THEN 0 WHEN o.operator IN ('BDC', 'BMC') THEN w.depth + 1 WHEN o.operator = 'EMC' THEN greatest(w.depth - 1, 0) ELSE w.depth END,
        CASE WHEN w.begun IS NOT NULL AND o.operator = 'EMC' AND w.depth = 0 THEN w.begun END, CASE WHEN w.begun IS NOT NULL AND o.operator = 'EMC' AND w.depth = 0 THEN o.seq END
      FROM w JOIN op o ON o.doc_id = w.doc_id AND o.page = w.page AND o.seq = w.seq + 1),
    cut AS (SELECT doc_id, page, cut_from, cut_to FROM w WHERE cut_to IS NOT NULL)
    SELECT o.* FROM op o WHERE NOT EXISTS (SELECT 1 FROM cut c WHERE c.doc_id = o.doc_id AND c.page = o.page AND o.seq BETWEEN c.cut_from AND c.cut_to)""",
)
def tagged_blocks(spark, folder):
    from pyspark.sql import Window

    p, s = F.col("l_partkey"), F.col("l_suppkey")
    pick = lambda names, n: F.element_at(F.array(*[F.lit(x) for x in names]), (p % n + 1).cast("int"))
    order = Window.partitionBy("doc_id", "page").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    rows = table(spark, folder, "lineitem").select((s % 50).alias("doc_id"), (s % 3).alias("page"), "l_orderkey", "l_linenumber", p, s)
    operations = rows.select(
        "doc_id", "page", F.row_number().over(order).cast("bigint").alias("seq"), pick(("BDC", "EMC", "Tj", "BMC", "EMC", "Tj", "EMC"), 7).alias("operator"),
        F.when((p % 7).isin(0, 3), pick(("Header", "Span", "Footer", "Artifact"), 4)).alias("tag"),
    )
    return ops.without_tagged(operations, ["Header", "Footer"])


_PLACED = f"""{_LINES}, k AS (SELECT *, 'im' || s % 3 AS picture, CASE WHEN p % 17 = 0 AND line > 3 THEN 7 ELSE s % 3 % 2 + 1 END AS page FROM l),
base AS (SELECT doc_id, page, picture, ord AS place, qty::DOUBLE AS x, 20.0::DOUBLE AS width, 10.0::DOUBLE AS height FROM k WHERE line <= 2 QUALIFY row_number() OVER (PARTITION BY doc_id, page, picture ORDER BY ord) = 1),
ev AS (SELECT doc_id, page, picture, ord, ['add', 'update', 'delete', 'update'][p % 4 + 1] AS kind, CASE WHEN p % 3 > 0 THEN price::DOUBLE END AS x, CASE WHEN p % 4 = 0 OR p % 5 = 0 THEN (p % 5)::DOUBLE END AS width, CASE WHEN p % 4 = 0 THEN 3.0::DOUBLE END AS height,
  CASE WHEN page > 2 THEN 'That page is not in this document any more.' WHEN (p % 4 = 0 OR p % 5 = 0) AND p % 5 = 0 THEN 'A picture needs a width and a height.' END AS msg FROM k WHERE line > 1),
{_replay("doc_id, page, picture", ["x", "width", "height"], "'That picture is already on the page.'", "'That picture is no longer on the page.'")}"""


@query(
    "placement_edits",
    "2.12 H35",
    f"""WITH RECURSIVE {_PLACED}
    SELECT doc_id, page::BIGINT AS page, picture, x, width, height, NULL::BIGINT AS ord, NULL::VARCHAR AS error FROM last WHERE alive
    UNION ALL SELECT doc_id, page, picture, NULL, NULL, NULL, ord, error FROM r WHERE error IS NOT NULL""",
)
def placement_edits(spark, folder):
    p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.when((p % 17 == 0) & (line > 3), 7).otherwise(s % 3 % 2 + 1).alias("page"),
        F.concat(F.lit("im"), (s % 3).cast("string")).alias("picture"), F.expr(_KEY).alias("ord"), p, line, "l_quantity", "l_extendedprice",
    )
    number = lambda v: F.lit(v).cast("double")
    base = rows.where("l_linenumber <= 2").groupBy("doc_id", "page", "picture").agg(
        F.min("ord").alias("ord"), F.min_by("l_quantity", "ord").cast("double").alias("x")
    ).select("*", number(0).alias("y"), number(20).alias("width"), number(10).alias("height"), number(0).alias("rotation"))
    kinds = F.array(*[F.lit(k) for k in ("add", "update", "delete", "update")])
    log = rows.where("l_linenumber > 1").select(
        "doc_id", "page", "picture", "ord", F.element_at(kinds, (p % 4 + 1).cast("int")).alias("kind"),
        F.when(p % 3 > 0, F.col("l_extendedprice").cast("double")).alias("x"), number(None).alias("y"),
        F.when((p % 4 == 0) | (p % 5 == 0), (p % 5).cast("double")).alias("width"), F.when(p % 4 == 0, number(3)).alias("height"), number(None).alias("rotation"),
    )
    counts = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(2).alias("page_count"))
    after, refused = ops.placement_edits(base, log, counts)
    return after.select("doc_id", "page", "picture", "x", "width", "height").unionByName(
        refused.select("doc_id", "page", "picture", "ord", "error"), allowMissingColumns=True
    )


@query(
    "setting_edits",
    "2.12",
    f"""WITH {_LINES}, k AS (SELECT *, ['tooltip', 'tabOrder', 'layer', 'displayTitle'][p % 4 + 1] AS kind, 'n' || s % 5 AS name FROM l),
    target AS (SELECT DISTINCT doc_id, kind, name FROM k WHERE line <= 3),
    base AS (SELECT doc_id, kind, name, 'old' AS value FROM k WHERE line <= 3 AND s % 2 = 0 GROUP BY ALL),
    ch AS (SELECT doc_id, kind, name, ord, CASE WHEN p % 3 = 0 THEN NULL WHEN p % 3 = 1 THEN ' new ' || p ELSE '  ' END AS value, (doc_id, kind, name) IN (SELECT (doc_id, kind, name) FROM target) AS there FROM k WHERE line > 2),
    l2 AS (SELECT doc_id, kind, name, arg_max(trim(coalesce(value, '')), ord) AS new FROM ch WHERE there GROUP BY ALL)
    SELECT coalesce(b.doc_id, l2.doc_id) AS doc_id, coalesce(b.kind, l2.kind) AS kind, coalesce(b.name, l2.name) AS name, coalesce(new, b.value) AS value, NULL::BIGINT AS ord, NULL::VARCHAR AS error
      FROM base b FULL JOIN l2 ON b.doc_id = l2.doc_id AND b.kind = l2.kind AND b.name = l2.name WHERE coalesce(new, b.value) <> ''
    UNION ALL SELECT doc_id, kind, name, NULL, ord, 'That is not in this document any more.' FROM ch WHERE NOT there""",
)
def setting_edits(spark, folder):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    kinds = F.array(*[F.lit(k) for k in ("tooltip", "tabOrder", "layer", "displayTitle")])
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.element_at(kinds, (p % 4 + 1).cast("int")).alias("kind"), F.concat(F.lit("n"), (s % 5).cast("string")).alias("name"),
        F.expr(_KEY).alias("ord"), p, s, "l_linenumber",
    )
    targets = rows.where("l_linenumber <= 3")
    settings = targets.where(s % 2 == 0).select("doc_id", "kind", "name", F.lit("old").alias("value")).distinct()
    value = F.when(p % 3 == 1, F.concat(F.lit(" new "), p.cast("string"))).when(p % 3 == 2, "  ")
    changes = rows.where("l_linenumber > 2").select("doc_id", "kind", "name", "ord", value.alias("value"))
    after, refused = ops.setting_edits(settings, changes, targets, "That is not in this document any more.")
    return after.unionByName(refused, allowMissingColumns=True)
