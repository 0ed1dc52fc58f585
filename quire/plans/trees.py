"""Regions, nations, customers and orders as trees and graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quire.operators import trees as ops
from quire.operators.scale import placed_in_order
from quire.plans.registry import query
from quire.session import cut_lineage, table


def forest(spark, folder):
    """One tree per region: nations, their customers, their orders.

    ``doc_id, node, up, kind, key``; node numbers keep the three kinds apart.
    """
    n = table(spark, folder, "nation").select(F.col("n_regionkey").cast("bigint").alias("doc_id"), F.col("n_nationkey").cast("bigint").alias("nation"))
    c = table(spark, folder, "customer").select(F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_custkey").alias("customer"))
    o = table(spark, folder, "orders").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").alias("order"))
    nations = n.select("doc_id", (F.col("nation") + 1000).alias("node"), F.lit(None).cast("bigint").alias("up"), F.col("nation").alias("key"))
    customers = c.join(n, "nation").select("doc_id", (F.col("customer") * 2 + 2000).alias("node"), (F.col("nation") + 1000).alias("up"), F.col("customer").alias("key"))
    orders = o.join(c, "customer").join(n, "nation").select("doc_id", (F.col("order") * 2 + 2001).alias("node"), (F.col("customer") * 2 + 2000).alias("up"), F.col("order").alias("key"))
    return nations.unionByName(customers).unionByName(orders)


_FOREST = """n AS (SELECT n_regionkey::BIGINT AS doc_id, n_nationkey::BIGINT AS nk, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS np FROM nation),
c AS (SELECT n.doc_id, n.nk, n.np, c_custkey AS ck, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS cp FROM customer JOIN n ON n.nk = c_nationkey),
o AS (SELECT c.*, o_orderkey AS ok, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS op FROM orders JOIN c ON c.ck = o_custkey),
t AS (SELECT doc_id, nk + 1000 AS node, NULL::BIGINT AS parent, 1 AS level, np::VARCHAR AS path, nk AS key FROM n
  UNION ALL SELECT doc_id, ck * 2 + 2000, nk + 1000, 2, np || '.' || cp, ck FROM c UNION ALL SELECT doc_id, ok * 2 + 2001, ck * 2 + 2000, 3, np || '.' || cp || '.' || op, ok FROM o)"""


def path_rows(spark, folder):
    """The same forest with dotted paths, straight from sibling order, made once for all its uses."""
    f = forest(spark, folder)
    n = F.row_number().over(Window.partitionBy("doc_id", "up").orderBy("node")) - 1
    placed = cut_lineage(f.withColumn("place", n.cast("string")))
    top = placed.where("up is null").select("doc_id", "node", "up", F.col("place").alias("path"), "key", F.lit(1).alias("level"))

    def below(level, above):
        return placed.join(above.select("doc_id", F.col("node").alias("up"), F.col("path").alias("above")), ["doc_id", "up"]).select(
            "doc_id", "node", "up", F.concat("above", F.lit("."), "place").alias("path"), "key", F.lit(level).alias("level")
        )

    second = below(2, top)
    return cut_lineage(top.unionByName(second).unionByName(below(3, second)))


@query(
    "outline_rows",
    "G1 G8",
    f"WITH {_FOREST} SELECT doc_id, node, parent, level::BIGINT AS level, path FROM t",
)
def outline_rows(spark, folder):
    siblings = Window.partitionBy("doc_id", "up").orderBy("node")
    placed = cut_lineage(
        forest(spark, folder).select("doc_id", "node", "up", F.lead("node").over(siblings).alias("next"), (F.row_number().over(siblings) == 1).alias("leading"))
    )
    firsts = placed.where("leading and up is not null").select("doc_id", F.col("up").alias("node"), F.col("node").alias("first"))
    nodes = placed.join(firsts, ["doc_id", "node"], "left").select(
        "doc_id", "node", "first", "next", (F.col("up").isNull() & F.col("leading")).alias("is_root")
    )
    return ops.outline_rows(nodes, ["doc_id"]).select("doc_id", "node", "parent", "level", "path")


@query(
    "visible_counts",
    "G2",
    f"""WITH {_FOREST}, s AS (SELECT *, CASE level WHEN 1 THEN key % 2 = 0 WHEN 2 THEN key % 3 > 0 ELSE true END AS open FROM t),
    cc AS (SELECT s.doc_id, s.path, count(k.node) AS kids FROM s LEFT JOIN s k ON k.doc_id = s.doc_id AND k.parent = s.node GROUP BY ALL),
    v AS (SELECT s.doc_id, s.path, s.open, s.level, cc.kids, CASE WHEN s.level = 1 THEN (SELECT sum(1 + CASE WHEN k.open THEN kk.kids ELSE 0 END) FROM s k JOIN cc kk ON kk.doc_id = k.doc_id AND kk.path = k.path WHERE k.doc_id = s.doc_id AND k.parent = s.node) ELSE cc.kids END AS n FROM s JOIN cc USING (doc_id, path))
    SELECT doc_id, path, (CASE WHEN kids = 0 THEN NULL WHEN open THEN n ELSE -n END)::BIGINT AS count FROM v""",
)
def visible_counts(spark, folder):
    rows = path_rows(spark, folder).withColumn(
        "open", F.when(F.col("level") == 1, F.col("key") % 2 == 0).when(F.col("level") == 2, F.col("key") % 3 > 0).otherwise(True)
    )
    return ops.visible_counts(rows, ["doc_id"])


@query(
    "pruned_outline",
    "G3 G4",
    f"""WITH {_FOREST}, s AS (SELECT *, CASE level WHEN 1 THEN key % 4 > 0 WHEN 2 THEN key % 3 > 0 ELSE key % 2 > 0 END AS keep FROM t)
    SELECT s.doc_id, s.path, CASE WHEN p.keep THEN p.path WHEN g.keep THEN g.path END AS parent_path FROM s LEFT JOIN s p ON p.doc_id = s.doc_id AND p.node = s.parent LEFT JOIN s g ON g.doc_id = p.doc_id AND g.node = p.parent WHERE s.keep""",
)
def pruned_outline(spark, folder):
    rows = path_rows(spark, folder).withColumn(
        "keep", F.when(F.col("level") == 1, F.col("key") % 4 > 0).when(F.col("level") == 2, F.col("key") % 3 > 0).otherwise(F.col("key") % 2 > 0)
    )
    return ops.promoted(rows, ["doc_id"])


@query(
    "subtree_pages",
    "G5",
    f"""WITH {_FOREST}, s AS (SELECT *, CASE WHEN level = 3 THEN key % 7 END AS page FROM t),
    up AS (SELECT doc_id, path, page FROM s WHERE page IS NOT NULL UNION SELECT p.doc_id, p.path, s.page FROM s JOIN s p ON p.doc_id = s.doc_id AND p.node = s.parent WHERE s.page IS NOT NULL
      UNION SELECT g.doc_id, g.path, s.page FROM s JOIN s p ON p.doc_id = s.doc_id AND p.node = s.parent JOIN s g ON g.doc_id = p.doc_id AND g.node = p.parent WHERE s.page IS NOT NULL)
    SELECT doc_id, path, page FROM up""",
)
def subtree_pages(spark, folder):
    rows = path_rows(spark, folder).withColumn("page", F.when(F.col("level") == 3, F.col("key") % 7))
    return ops.subtree_pages(rows, ["doc_id"])


@query(
    "inherited_pages",
    "G6",
    f"""WITH {_FOREST}, s AS (SELECT *, CASE WHEN level = 1 AND key % 3 > 0 THEN key WHEN level = 2 AND key % 4 = 0 THEN key % 11 WHEN level = 3 AND key % 5 = 0 THEN key % 13 END AS page FROM t)
    SELECT s.doc_id, s.path, coalesce(s.page, p.page, g.page) AS page, s.level::BIGINT AS depth,
      row_number() OVER (PARTITION BY s.doc_id ORDER BY list_transform(string_split(s.path, '.'), lambda v: v::INT)) AS reading FROM s LEFT JOIN s p ON p.doc_id = s.doc_id AND p.node = s.parent LEFT JOIN s g ON g.doc_id = p.doc_id AND g.node = p.parent""",
)
def inherited_pages(spark, folder):
    k, level = F.col("key"), F.col("level")
    rows = path_rows(spark, folder).withColumn(
        "page", F.when((level == 1) & (k % 3 > 0), k).when((level == 2) & (k % 4 == 0), k % 11).when((level == 3) & (k % 5 == 0), k % 13)
    )
    found = ops.inherited_pages(rows.withColumnRenamed("up", "parent"), ["doc_id"])
    return placed_in_order(found, ["doc_id"], ["order"], "reading").select("doc_id", "path", "page", "depth", "reading")


@query(
    "outline_moves",
    "G12",
    f"""WITH {_FOREST}, r AS (SELECT t.*, regexp_extract(path, '(\\d+)$', 1)::BIGINT AS p, CASE WHEN contains(path, '.') THEN regexp_replace(path, '\\.\\d+$', '') ELSE '' END AS up FROM t),
    s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, up) AS sib, CASE WHEN up = '' THEN '' ELSE up || '.' END AS u FROM r),
    k AS (SELECT doc_id, up, count(*) AS kids FROM r GROUP BY ALL),
    j AS (SELECT s.*, u || (p - 1) AS into_, coalesce(k.kids, 0) AS kids, CASE WHEN contains(s.up, '.') THEN regexp_replace(s.up, '\\.\\d+$', '') ELSE '' END AS op, CASE WHEN s.up = '' THEN NULL ELSE regexp_extract(s.up, '(\\d+)$', 1)::BIGINT END AS opl
       FROM s LEFT JOIN k ON k.doc_id = s.doc_id AND k.up = s.u || (s.p - 1) AND s.p > 0)
    SELECT doc_id, path, 'up' AS move, CASE WHEN p > 0 THEN up END AS parent, CASE WHEN p > 0 THEN p - 1 END AS "index", CASE WHEN p > 0 THEN u || (p - 1) END AS result FROM j
    UNION ALL SELECT doc_id, path, 'down', CASE WHEN p < sib - 1 THEN up END, CASE WHEN p < sib - 1 THEN p + 2 END, CASE WHEN p < sib - 1 THEN u || (p + 1) END FROM j
    UNION ALL SELECT doc_id, path, 'indent', CASE WHEN p > 0 THEN into_ END, CASE WHEN p > 0 THEN kids END, CASE WHEN p > 0 THEN into_ || '.' || kids END FROM j
    UNION ALL SELECT doc_id, path, 'outdent', CASE WHEN up <> '' THEN op END, opl + 1, CASE WHEN up <> '' THEN CASE WHEN op = '' THEN '' ELSE op || '.' END || (opl + 1) END FROM j""",
)
def outline_moves(spark, folder):
    return ops.planned_moves(path_rows(spark, folder).select("doc_id", "path"), ["doc_id"])


# An order lets its customer refer to one of two others, numbered as in a heap.
_GRAPH = """edge AS (SELECT o_custkey AS s, o_custkey * 2 + o_orderkey % 2 AS t FROM orders),
seed AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > 9000)"""


@query(
    "unused_objects",
    "G7 J16 J17",
    f"""WITH RECURSIVE {_GRAPH}, r AS (SELECT k FROM seed UNION SELECT t FROM r JOIN edge ON s = k)
    SELECT 0::BIGINT AS doc_id, c_custkey AS node FROM customer WHERE c_custkey NOT IN (SELECT k FROM r)""",
)
def unused_objects(spark, folder):
    zero = F.lit(0).cast("bigint").alias("doc_id")
    customers = table(spark, folder, "customer")
    edges = table(spark, folder, "orders").select(
        zero, F.col("o_custkey").alias("source"), (F.col("o_custkey") * 2 + F.col("o_orderkey") % 2).alias("target")
    ).distinct()
    nodes = customers.select(zero, F.col("c_custkey").alias("node"))
    seeds = customers.where("c_acctbal > 9000").select(zero, F.col("c_custkey").alias("node"))
    return ops.unreachable(nodes, seeds, edges, ["doc_id"])


@query(
    "action_chains",
    "G8 A27 F12",
    """WITH a AS (SELECT o_custkey AS doc_id, o_orderkey AS id, ['JavaScript','Launch','GoTo','URI','SubmitForm'][o_orderkey % 5 + 1] AS type, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    SELECT doc_id, first(id ORDER BY n) AS head, count(*) AS sites, count(*) FILTER (WHERE type = 'JavaScript') AS scripts, count(*) FILTER (WHERE type IN ('Launch', 'SubmitForm')) AS reaching FROM a GROUP BY 1""",
)
def action_chains(spark, folder):
    from quire.functions.facts import action_class

    orders = table(spark, folder, "orders")
    ahead = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    links = orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node"), F.lead("o_orderkey").over(ahead).alias("next")
    )
    kinds = F.array(*[F.lit(t) for t in ("JavaScript", "Launch", "GoTo", "URI", "SubmitForm")])
    types = orders.select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("node"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("type")
    )
    sites = ops.chained(links, ["doc_id"]).join(types, ["doc_id", "node"])
    kind = action_class(F.col("type"))
    return sites.groupBy("doc_id", "head").agg(
        F.count("*").alias("sites"), F.count_if(kind == "javascript").alias("scripts"), F.count_if(kind == "reachingOut").alias("reaching")
    )


@query(
    "resolved_roles",
    "J21",
    """WITH RECURSIVE m AS (SELECT DISTINCT p_brand AS type, CASE WHEN regexp_extract(p_brand, '(\\d+)', 1)::INT % 2 = 0 THEN 'Brand#' || (regexp_extract(p_brand, '(\\d+)', 1)::INT // 2) WHEN p_brand = 'Brand#1' THEN 'P' WHEN p_brand = 'Brand#3' THEN 'Brand#6' END AS role FROM part),
    w AS (SELECT type, type AS cur, [type] AS seen, 0 AS n FROM m UNION ALL SELECT w.type, m.role, list_append(seen, m.role), n + 1 FROM w JOIN m ON m.type = w.cur WHERE m.role IS NOT NULL AND NOT list_contains(seen, m.role))
    SELECT 0::BIGINT AS doc_id, type, arg_max(cur, n) AS resolved FROM w GROUP BY type""",
)
def resolved_roles(spark, folder):
    n = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    role = (
        F.when(n % 2 == 0, F.concat(F.lit("Brand#"), F.floor(n / 2).cast("string")))
        .when(F.col("p_brand") == "Brand#1", "P").when(F.col("p_brand") == "Brand#3", "Brand#6")
    )
    brands = table(spark, folder, "part").select(F.lit(0).cast("bigint").alias("doc_id"), F.col("p_brand").alias("type"), role.alias("role")).distinct()
    return ops.resolved_roles(brands, brands.where("role is not null"), ["doc_id"])


@query(
    "layer_order",
    "G11 H29",
    """WITH l AS (SELECT l_orderkey AS doc_id, 'layer ' || (l_partkey % 10) AS layer, l_linenumber % 3 AS depth, l_linenumber * 1000000 + l_partkey * 100 + l_suppkey % 100 AS ord FROM lineitem)
    SELECT doc_id, layer, arg_min(depth, ord)::BIGINT AS depth, min(ord)::BIGINT AS ord FROM l GROUP BY 1, 2""",
)
def layer_order(spark, folder):
    p, line = F.col("l_partkey"), F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("layer "), (p % 10).cast("string")).alias("layer"),
        (line % 3).alias("depth"), (line * 1000000 + p * 100 + F.col("l_suppkey") % 100).alias("ord"),
    )
    return ops.first_per(rows, ["doc_id", "layer"], "ord")


# Orders as the names of a name tree: eight to a leaf, four nodes to a node above, and in every
# tree one node that leads back to the root.
_NAMES = """n AS (SELECT o_custkey % 7 AS doc_id, lpad(o_orderkey::VARCHAR, 9, '0') AS name, o_custkey AS value, row_number() OVER (PARTITION BY o_custkey % 7 ORDER BY o_orderkey) - 1 AS k FROM orders),
want AS (SELECT doc_id, CASE WHEN value % 3 = 0 THEN name || 'x' ELSE name END AS name FROM n WHERE value % 2 = 0 OR value % 3 = 0)"""


@query(
    "name_tree_lookups",
    "G9 J12",
    f"""WITH {_NAMES} SELECT DISTINCT n.doc_id, n.name, n.value FROM n JOIN want USING (doc_id, name)""",
)
def name_tree_lookups(spark, folder):
    nodes, entries = name_trees(spark, folder)
    v = F.col("value")
    wanted = entries.where((v % 2 == 0) | (v % 3 == 0)).select(
        "doc_id", F.when(v % 3 == 0, F.concat("name", F.lit("x"))).otherwise(F.col("name")).alias("name")
    )
    return ops.names_found(nodes, entries, wanted, ["doc_id"]).select("doc_id", "name", "value")


@query("name_tree_entries", "G9", f"WITH {_NAMES} SELECT doc_id, name, value FROM n")
def name_tree_entries(spark, folder):
    return ops.names_of(*name_trees(spark, folder), ["doc_id"])


def name_trees(spark, folder):
    """Nodes of name trees, five levels and a root, with the limits of their names; and the entries of the leaves."""
    order = Window.partitionBy("doc_id").orderBy("o_orderkey")
    names = table(spark, folder, "orders").select(
        (F.col("o_custkey") % 7).alias("doc_id"), "o_orderkey", F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("name"), F.col("o_custkey").alias("value")
    )
    placed = cut_lineage(names.withColumn("k", F.row_number().over(order) - 1))
    node = lambda level: F.when(F.lit(level == 6), F.lit("root")).otherwise(F.concat(F.lit(f"{level}-"), F.floor(F.col("k") / (8 * 4 ** (level - 1))).cast("string")))
    levels = [
        placed.groupBy("doc_id", node(level).alias("node"), node(level + 1).alias("parent")).agg(F.min("name").alias("low"), F.max("name").alias("high"))
        for level in range(1, 6)
    ]
    root = placed.select("doc_id", F.lit("root").alias("node"), *[F.lit(None).cast("string").alias(n) for n in ("parent", "low", "high")]).distinct()
    loop = root.select("doc_id", "node", F.lit("1-0").alias("parent"), "low", "high")
    nodes = root.unionByName(loop)
    for level in levels:
        nodes = nodes.unionByName(level)
    return cut_lineage(nodes), placed.select("doc_id", node(1).alias("node"), "name", "value")
