"""Web pages audited as documents; order lines as fonts, tags and attachments."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import facts
from quire.operators import audit as ops
from quire.plans.registry import query
from quire.session import spread, table

LINK = r'<a href="([^"]*)">([^<]*)</a>'


def web_pages(spark, folder):
    return spread(table(spark, folder, "pages").select(F.col("page_id").alias("doc_id"), "url", "html"), "doc_id")


def links(spark, folder):
    """Links of every page; a path is an address, the text under it its description."""
    found = F.arrays_zip(
        F.regexp_extract_all("html", F.lit(LINK), F.lit(1)).alias("url"), F.regexp_extract_all("html", F.lit(LINK), F.lit(2)).alias("text")
    )
    return web_pages(spark, folder).select("doc_id", F.posexplode(found).alias("ord", "l")).select(
        "doc_id", "ord",
        F.when(F.length("l.url") == 3, F.lit(None).cast("string")).otherwise(F.lit("URI")).alias("action"),
        F.when(F.length("l.url") % 5 == 0, F.lit("")).otherwise(F.col("l.url")).alias("url"),
        F.when(F.length("l.url") == 3, F.when(F.col("ord") % 2 == 0, F.col("l.url"))).alias("destination"),
        F.when(F.length("l.text") > 2, F.col("l.text")).alias("contents"),
        F.when(F.col("ord") % 3 == 0, F.col("ord")).alias("page"),
    )


_LINKS = f"""lk AS (SELECT page_id AS doc_id, generate_subscripts(u, 1) - 1 AS ord, unnest(u) AS u, unnest(t) AS t FROM (SELECT page_id, regexp_extract_all(html, '{LINK}', 1) AS u, regexp_extract_all(html, '{LINK}', 2) AS t FROM pages)),
l AS (SELECT doc_id, ord, CASE WHEN length(u) = 3 THEN NULL ELSE 'URI' END AS action, CASE WHEN length(u) % 5 = 0 THEN '' ELSE u END AS url, CASE WHEN length(u) = 3 AND ord % 2 = 0 THEN u END AS dest, CASE WHEN length(t) > 2 THEN t END AS contents, CASE WHEN ord % 3 = 0 THEN ord END AS page FROM lk)"""


@query(
    "link_targets",
    "F13 F14 F10 J12",
    f"""WITH {_LINKS} SELECT doc_id, ord, CASE WHEN action = 'URI' THEN CASE WHEN url = '' THEN 'empty' ELSE 'url' END WHEN page IS NOT NULL THEN 'page' WHEN dest IS NOT NULL THEN 'named' ELSE 'nowhere' END AS target,
      CASE WHEN page IS NOT NULL THEN 'page' WHEN action = 'URI' THEN 'url' WHEN dest IS NOT NULL THEN 'other' ELSE 'none' END AS outline, CASE WHEN action = 'URI' THEN trim(url) = '' ELSE coalesce(dest, '') = '' END AS empty FROM l""",
)
def link_targets(spark, folder):
    a, u, d, p = (F.col(c) for c in ("action", "url", "destination", "page"))
    return links(spark, folder).select(
        "doc_id", "ord", facts.link_target(a, u, d, p).alias("target"), facts.outline_action(p, a, d).alias("outline"),
        facts.goes_nowhere(a, u, d).alias("empty"),
    )


_META = """m AS (SELECT page_id AS doc_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(html, 'lang="([^"]*)"', 1) || CASE WHEN page_id % 7 = 0 THEN '_x' ELSE '' END AS lang, contains(html, '<h1') AS has_tags, contains(html, '<article') AS marked,
  contains(html, '</b>') AS disp, page_id % 3 = 0 AS enc, page_id % 2 = 0 AS ext FROM pages),
inv AS (SELECT page_id AS doc_id, len(regexp_extract_all(p, '[a-z]')) AS shows, len(regexp_extract_all(p, '###')) AS pics, contains(p, '$$$') AS loose, len(regexp_extract_all(p, '<b>')) AS annots, CASE WHEN contains(p, '%%%') THEN 'S' END AS tabs FROM (SELECT page_id, unnest(string_split(html, '<p>')) AS p FROM pages))"""


def web_inventory(spark, folder):
    def n(pattern):
        return F.regexp_count("p", F.lit(pattern))

    return web_pages(spark, folder).select("doc_id", F.posexplode(F.split("html", "<p>", -1)).alias("page", "p")).select(
        "doc_id", "page", n("[a-z]").alias("text_shows"), n("###").alias("pictures"), F.contains("p", F.lit("$$$")).alias("loose"),
        n("<b>").alias("annots"), F.when(F.contains("p", F.lit("%%%")), "S").alias("tabs"),
    )


def figures(spark, folder):
    """Bold passages as figures; those with a broken mark have no description."""
    text = F.col("text")
    return web_pages(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("html", F.lit("<b>([^<]*)</b>"), F.lit(1))).alias("text")).select(
        "doc_id", F.when(F.contains(text, F.lit("%%%")), "").otherwise(text).alias("alt"), F.lit(None).cast("string").alias("actual_text")
    )


def fields(spark, folder):
    """Entries of the navigation as form fields; very short ones have no name."""
    entry = F.lit('<li><a href="[^"]*">([^<]*)</a></li>')
    return web_pages(spark, folder).select("doc_id", F.explode(F.regexp_extract_all("html", entry, F.lit(1))).alias("text")).select(
        "doc_id", F.when(F.length("text") > 2, F.col("text")).alias("tooltip")
    )


@query(
    "accessibility_audit",
    "Q11 A7 A15 F11 F13 T5 H8",
    f"""WITH {_LINKS}, {_META},
    lf AS (SELECT doc_id, count(*) AS links, count(*) FILTER (WHERE CASE WHEN action = 'URI' THEN trim(url) = '' ELSE coalesce(dest, '') = '' END) AS empty, count(*) FILTER (WHERE contents IS NULL) AS bare FROM l GROUP BY 1),
    pf AS (SELECT doc_id, count(*) FILTER (WHERE pics > 0 AND shows = 0) AS io, count(*) FILTER (WHERE loose) AS lo, count(*) FILTER (WHERE annots > 0 AND tabs IS NULL) AS tp FROM inv GROUP BY 1),
    ff AS (SELECT doc_id, len(b) AS figs, len(list_filter(b, lambda v: contains(v, '%%%') OR trim(v) = '')) AS silent, len(f) AS fields, len(list_filter(f, lambda v: length(v) <= 2)) AS unnamed
      FROM (SELECT page_id AS doc_id, regexp_extract_all(html, '<b>([^<]*)</b>', 1) AS b, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) AS f FROM pages)),
    w AS (SELECT m.*, figs, silent, fields, unnamed, coalesce(links, 0) AS links, coalesce(empty, 0) AS empty, coalesce(bare, 0) AS bare, io, lo, tp FROM m JOIN ff USING (doc_id) LEFT JOIN lf USING (doc_id) LEFT JOIN pf USING (doc_id))
    SELECT doc_id, 'title' AS "check", CASE WHEN trim(title) = '' THEN 'failed' ELSE 'passed' END AS status, 0::BIGINT AS found FROM w
    UNION ALL SELECT doc_id, 'displayTitle', CASE WHEN disp THEN 'passed' ELSE 'warning' END, 0 FROM w
    UNION ALL SELECT doc_id, 'language', CASE WHEN regexp_matches(lang, '^[A-Za-z]{{2,8}}(-[A-Za-z0-9]{{1,8}})*$') THEN 'passed' ELSE 'warning' END, 0 FROM w
    UNION ALL SELECT doc_id, 'tagged', CASE WHEN NOT has_tags THEN 'failed' WHEN marked THEN 'passed' ELSE 'warning' END, 0 FROM w
    UNION ALL SELECT doc_id, 'figureAltText', CASE WHEN figs = 0 OR NOT has_tags THEN 'notApplicable' WHEN silent > 0 THEN 'failed' ELSE 'passed' END, CASE WHEN figs = 0 OR NOT has_tags THEN 0 ELSE silent END FROM w
    UNION ALL SELECT doc_id, 'imageOnlyPages', CASE WHEN io > 0 THEN 'failed' ELSE 'passed' END, io FROM w
    UNION ALL SELECT doc_id, 'formFieldNames', CASE WHEN fields = 0 THEN 'notApplicable' WHEN unnamed > 0 THEN 'failed' ELSE 'passed' END, unnamed FROM w
    UNION ALL SELECT doc_id, 'linkTargets', CASE WHEN links = 0 THEN 'notApplicable' WHEN empty > 0 THEN 'failed' ELSE 'passed' END, empty FROM w
    UNION ALL SELECT doc_id, 'linkDescriptions', CASE WHEN links = 0 OR NOT has_tags THEN 'notApplicable' WHEN bare > 0 THEN 'warning' ELSE 'passed' END, CASE WHEN links = 0 OR NOT has_tags THEN 0 ELSE bare END FROM w
    UNION ALL SELECT doc_id, 'tabOrder', CASE WHEN NOT has_tags THEN 'notApplicable' WHEN tp > 0 THEN 'failed' ELSE 'passed' END, tp FROM w
    UNION ALL SELECT doc_id, 'untaggedContent', CASE WHEN NOT has_tags THEN 'notApplicable' WHEN lo > 0 THEN 'warning' ELSE 'passed' END, lo FROM w
    UNION ALL SELECT doc_id, 'assistivePermission', CASE WHEN enc AND NOT ext THEN 'failed' ELSE 'passed' END, 0 FROM w
    UNION ALL SELECT doc_id, 'readingOrder', 'manual', 0 FROM w UNION ALL SELECT doc_id, 'colourContrast', 'manual', 0 FROM w""",
)
def accessibility_audit(spark, folder):
    k = F.col("doc_id")
    documents = web_pages(spark, folder).select(
        k, F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"),
        F.concat(F.regexp_extract("html", 'lang="([^"]*)"', 1), F.when(k % 7 == 0, "_x").otherwise("")).alias("language"),
        F.contains("html", F.lit("</b>")).alias("display_title"), F.contains("html", F.lit("<h1")).alias("has_tags"),
        F.contains("html", F.lit("<article")).alias("marked"), (k % 3 == 0).alias("encrypted"), (k % 2 == 0).alias("may_extract"),
    )
    return ops.accessibility_report(
        documents, ops.link_facts(links(spark, folder)), ops.page_facts(web_inventory(spark, folder)),
        ops.figure_facts(figures(spark, folder)), ops.field_facts(fields(spark, folder)),
    )


@query(
    "figure_items",
    "T5 A7",
    """WITH f AS (SELECT l_suppkey AS doc_id, l_orderkey * 10 + l_linenumber AS k, max(CASE WHEN l_returnflag = 'R' THEN '' ELSE l_linestatus END) AS alt FROM lineitem GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n, count(*) OVER (PARTITION BY doc_id) AS c FROM f)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY alt <> '', k) AS place, k AS ord, alt <> '' AS described, false AS truncated FROM n""",
)
def figure_items(spark, folder):
    figures = table(spark, folder, "lineitem").groupBy(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord")
    ).agg(F.max(F.when(F.col("l_returnflag") == "R", "").otherwise(F.col("l_linestatus"))).alias("alt"))
    return ops.figure_items(figures)


def findings(spark, folder):
    """Scripts, comments, metadata and outbound links of web pages as hidden information."""
    html = web_pages(spark, folder)

    def found(category, pattern):
        labels = F.regexp_extract_all("html", F.lit(pattern), F.lit(1))
        return F.transform(labels, lambda v, i: F.struct(F.lit(category).alias("category"), i.alias("ord"), v.alias("label")))

    return html.select(
        "doc_id",
        F.inline(F.concat(
            found("documentJavaScript", "<script>([^<]*)"), found("hiddenAnnotations", "<!--(.*?)-->"),
            found("metadata", "<meta ([^>]*)>"), found("launchActions", '<a href="([^"]*)"'),
        )),
    )


@query(
    "hidden_information_report",
    "Q7 A6 A25 A27 F12",
    """WITH f AS (SELECT page_id AS doc_id, 'documentJavaScript' AS category, regexp_extract_all(html, '<script>([^<]*)', 1) AS v FROM pages UNION ALL SELECT page_id, 'hiddenAnnotations', regexp_extract_all(html, '<!--(.*?)-->', 1) FROM pages
      UNION ALL SELECT page_id, 'metadata', regexp_extract_all(html, '<meta ([^>]*)>', 1) FROM pages UNION ALL SELECT page_id, 'launchActions', regexp_extract_all(html, '<a href="([^"]*)"', 1) FROM pages),
    c AS (SELECT unnest(['metadata','xmpMetadata','attachments','documentJavaScript','launchActions','hiddenAnnotations','formData','thumbnails','hiddenLayers','alternateImages']) AS category)
    SELECT p.page_id AS doc_id, c.category, coalesce(len(v), 0) AS count, substr(coalesce(array_to_string(list_slice(v, 1, 10), ', '), ''), 1, 2000) AS detail FROM pages p CROSS JOIN c LEFT JOIN f ON f.doc_id = p.page_id AND f.category = c.category""",
)
def hidden_information_report(spark, folder):
    return ops.hidden_information(web_pages(spark, folder), findings(spark, folder), shown=10, width=2000)


@query(
    "sanitized_findings",
    "Q6",
    """SELECT page_id AS doc_id, 'hiddenAnnotations' AS category, len(regexp_extract_all(html, '<!--(.*?)-->')) AS left_ FROM pages WHERE contains(html, '-->')
    UNION ALL SELECT page_id, 'launchActions', len(regexp_extract_all(html, '<a href="([^"]*)"')) FROM pages WHERE contains(html, '<a href="')""",
)
def sanitized_findings(spark, folder):
    left = ops.sanitized(findings(spark, folder), ["metadata", "documentJavaScript"])
    return left.groupBy("doc_id", "category").agg(F.count("*").alias("left_"))


@query(
    "attachments_report",
    "Q24 F9",
    """WITH a AS (SELECT l_orderkey AS doc_id, l_partkey AS id, 0 AS f, l_linenumber * 1000000 + l_suppkey * 100 + l_quantity::INT AS ord, 'file' || l_partkey || CASE WHEN l_returnflag = 'R' THEN '.exe' ELSE '.pdf' END AS name, CASE WHEN l_linestatus = 'O' THEN l_suppkey END AS decl, l_partkey * 3 AS raw, l_tax > 0.04 AS comp FROM lineitem WHERE l_linenumber <= 4
      UNION ALL SELECT l_orderkey, l_partkey + l_linenumber % 2, 1, l_linenumber * 1000000 + l_suppkey * 100 + l_quantity::INT, 'page' || l_partkey || '.JS', NULL, l_partkey, l_tax > 0.04 FROM lineitem WHERE l_linenumber > 2)
    SELECT doc_id, id, name AS file_name, coalesce(decl, CASE WHEN NOT comp THEN raw END) AS size_bytes, contains(name, '.exe') OR contains(name, '.JS') AS risky FROM a QUALIFY row_number() OVER (PARTITION BY doc_id, id ORDER BY f, ord) = 1""",
)
def attachments_report(spark, folder):
    p, s, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), p, s, line, (line * 1000000 + s * 100 + F.col("l_quantity").cast("int")).alias("ord"),
        "l_returnflag", "l_linestatus", (F.col("l_tax") > 0.04).alias("compressed"),
    )
    ext = F.when(F.col("l_returnflag") == "R", ".exe").otherwise(".pdf")
    named = rows.where("l_linenumber <= 4").select(
        "doc_id", p.alias("id"), "ord", F.concat(F.lit("file"), p.cast("string"), ext).alias("file_name"),
        F.when(F.col("l_linestatus") == "O", s).alias("declared_size"), (p * 3).alias("raw_size"), "compressed",
    )
    on_pages = rows.where("l_linenumber > 2").select(
        "doc_id", (p + line % 2).alias("id"), "ord", F.concat(F.lit("page"), p.cast("string"), F.lit(".JS")).alias("file_name"),
        F.lit(None).cast("bigint").alias("declared_size"), p.alias("raw_size"), "compressed",
    )
    return ops.attachments(named, on_pages)


@query(
    "font_inventory",
    "A2 Q12",
    """WITH f AS (SELECT l_suppkey AS doc_id, l_orderkey * 1000000 + l_linenumber * 100000 + l_partkey AS ord, CASE WHEN l_returnflag = 'R' THEN 'ABCDEF+' ELSE '' END || p_brand AS name, p_type AS type, l_linestatus = 'O' AS embedded FROM lineitem JOIN part ON p_partkey = l_partkey),
    g AS (SELECT doc_id, name, arg_min(type, ord) AS type, arg_min(embedded, ord) AS embedded FROM f GROUP BY 1, 2)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS place, replace(name, 'ABCDEF+', '') AS name, type, embedded, starts_with(name, 'ABCDEF+') AS subset FROM g""",
)
def font_inventory(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
    seen = lines.join(table(spark, folder, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_type"), "l_partkey").select(
        F.col("l_suppkey").alias("doc_id"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_partkey")).alias("ord"),
        F.concat(F.when(F.col("l_returnflag") == "R", "ABCDEF+").otherwise(""), F.col("p_brand")).alias("name"),
        F.col("p_type").alias("type"), (F.col("l_linestatus") == "O").alias("embedded"),
    )
    return ops.fonts(seen)


@query(
    "resolved_destinations",
    "J12",
    """WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS link, CASE WHEN l_returnflag = 'R' THEN l_suppkey END AS ref, 'd' || (l_partkey % 5) AS dest FROM lineitem),
    n AS (SELECT l_orderkey AS doc_id, 'd' || (l_suppkey % 5) AS name, l_suppkey AS ref, CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END AS pr, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS ord FROM lineitem),
    b AS (SELECT doc_id, name, arg_max(ref, [pr, ord]) AS ref FROM n GROUP BY 1, 2), p AS (SELECT l_orderkey AS doc_id, l_suppkey AS ref, min(l_linenumber) AS page FROM lineitem GROUP BY 1, 2)
    SELECT l.doc_id, l.link, p.page::BIGINT AS page FROM l LEFT JOIN b ON b.doc_id = l.doc_id AND b.name = l.dest LEFT JOIN p ON p.doc_id = l.doc_id AND p.ref = coalesce(l.ref, b.ref)""",
)
def resolved_destinations(spark, folder):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    key = F.col("l_linenumber") * 10000000 + p * 1000 + s % 1000
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    links_ = lines.select("doc_id", key.alias("link"), F.when(F.col("l_returnflag") == "R", s).alias("page_ref"), F.concat(F.lit("d"), (p % 5).cast("string")).alias("dest"))
    named = lines.select(
        "doc_id", F.concat(F.lit("d"), (s % 5).cast("string")).alias("name"), s.alias("page_ref"),
        F.when(F.col("l_linestatus") == "O", "names").otherwise("dests").alias("tree"), key.alias("ord"),
    )
    pages = lines.groupBy("doc_id", s.alias("page_ref")).agg(F.min("l_linenumber").alias("page"))
    return ops.resolved_destinations(links_, named, pages)


@query(
    "reading_order",
    "J13",
    """WITH t AS (SELECT o_orderkey AS doc_id, k AS tag, k * 7 % 5 AS ord FROM orders, (SELECT unnest([1, 2, 3, 4]) AS k)),
    g AS (SELECT l_orderkey AS doc_id, l_linenumber % 4 + 1 AS tag, l_linenumber AS page, min(l_quantity) AS x, min(l_tax * 100) AS y, max(l_quantity + l_discount * 100) AS r, max(l_tax * 100 + l_partkey % 9) AS t FROM lineitem GROUP BY ALL),
    b AS (SELECT doc_id, tag, min(page) AS page, min(x) AS x, min(y) AS y, max(r) AS r, max(t) AS top FROM g GROUP BY 1, 2)
    SELECT t.doc_id, row_number() OVER (PARTITION BY t.doc_id ORDER BY t.ord) AS number, t.tag::BIGINT AS tag, b.page::BIGINT AS page, round(x, 4) AS x, round(y, 4) AS y, round(r - x, 4) AS width, round(top - y, 4) AS height FROM t JOIN b USING (doc_id, tag)""",
)
def reading_order(spark, folder):
    lines = table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "doc_id")
    tags = table(spark, folder, "orders").select(F.col("o_orderkey").alias("doc_id"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3, 4)])).alias("tag"))
    tags = tags.withColumn("ord", F.col("tag") * 7 % 5)
    mcid = (F.col("l_partkey") * 1000 + F.col("l_suppkey")).alias("mcid")
    content = lines.select("doc_id", (F.col("l_linenumber") % 4 + 1).alias("tag"), F.col("l_linenumber").alias("page"), mcid).distinct()
    geometry = lines.select(
        "doc_id", F.col("l_linenumber").alias("page"), mcid, F.col("l_quantity").alias("x"), (F.col("l_tax") * 100).alias("y"),
        (F.col("l_discount") * 100).alias("width"), (F.col("l_partkey") % 9).alias("height"),
    )
    found = ops.reading_order(tags, content, geometry)
    return found.select("doc_id", "number", "tag", "page", *[F.round(c, 4).alias(c) for c in ("x", "y", "width", "height")])


# Order lines dealt over the tables of documents by their part, and two categories chosen for each document.
_SANITIZE = """k AS (SELECT l_orderkey AS doc_id, l_partkey AS p, l_suppkey AS s FROM lineitem),
held AS (SELECT doc_id, CASE WHEN p % 9 = 0 AND s % 3 > 0 THEN 'metadata' WHEN p % 9 = 1 THEN 'xmpMetadata' WHEN p % 9 = 2 THEN 'attachments' WHEN p % 9 = 3 AND s % 5 = 0 THEN 'documentJavaScript' WHEN p % 9 = 3 AND s % 5 IN (1, 4) THEN 'launchActions'
   WHEN p % 9 = 4 AND (s % 64 & 34) <> 0 THEN 'hiddenAnnotations' WHEN p % 9 = 5 AND (s % 2 = 0 OR s % 7 = 0) THEN 'formData' WHEN p % 9 = 6 THEN 'thumbnails' WHEN p % 9 = 7 AND s % 2 = 0 THEN 'hiddenLayers' WHEN p % 9 = 8 THEN 'alternateImages' END AS category FROM k),
c AS (SELECT ['metadata','xmpMetadata','attachments','documentJavaScript','launchActions','hiddenAnnotations','formData','thumbnails','hiddenLayers','alternateImages'] AS cs),
d AS (SELECT o_orderkey AS doc_id, unnest([cs[o_orderkey % 10 + 1], cs[(o_orderkey // 10 + 3) % 10 + 1]]) AS category, o_custkey % 3 = o_orderkey % 3 AS fresh FROM orders, c),
n AS (SELECT doc_id, category, count(*) AS before FROM held WHERE category IS NOT NULL GROUP BY 1, 2)"""


def hidden_tables(spark, folder):
    """Nine tables of documents, each a ninth of the order lines."""
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") * 10000000 + p * 1000 + s % 1000).alias("ord"), p, s
    )
    text = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    kinds = F.array(*[F.lit(t) for t in ("JavaScript", "Launch", "GoTo", "URI", "SubmitForm")])
    columns = {
        "metadata": [text("n", s % 4).alias("name"), F.when(s % 3 > 0, text("v", p)).otherwise(" ").alias("value")],
        "xmp": [F.when(s % 2 == 0, s).alias("page")],
        "attachments": [text("file", p).alias("file_name")],
        "actions": [F.element_at(kinds, (s % 5 + 1).cast("int")).alias("type"), text("place ", s).alias("place")],
        "annotations": [p.alias("id"), (s % 64).cast("int").alias("flags")],
        "fields": [
            text("f", p).alias("name"), F.when(s % 2 == 0, text("v", s)).alias("value"), F.when(s % 7 == 0, "d").alias("default_value"), F.lit("On").alias("state"),
        ],
        "thumbnails": [s.alias("page")],
        "layers": [text("layer ", p).alias("layer"), (s % 2 == 0).alias("hidden")],
        "alternates": [p.alias("picture")],
    }
    return {name: rows.where(p % 9 == n).select("doc_id", "ord", *cs) for n, (name, cs) in enumerate(columns.items())}


def sanitize_decisions(spark, folder):
    """Two categories of each order, and the revision each was chosen at; the latest revision of each order."""
    k = F.col("o_orderkey")
    cs = F.array(*[F.lit(c) for c in ops.CATEGORIES])
    pick = lambda n: F.element_at(cs, (n % 10 + 1).cast("int"))
    orders = table(spark, folder, "orders")
    decisions = orders.select(
        k.alias("doc_id"), F.explode(F.array(pick(k), pick(F.floor(k / 10) + 3))).alias("category"), (F.col("o_custkey") % 3).alias("revision")
    )
    return decisions, orders.select(k.alias("doc_id"), (k % 3).alias("revision"))


@query(
    "sanitized_tables",
    "Q6 Q7 A6 A25 A26 A27 2.12",
    f"""WITH {_SANITIZE}, gone AS (SELECT DISTINCT doc_id, category FROM d WHERE fresh),
    shown AS (SELECT l_orderkey AS doc_id, 'fields' AS category, count(*) AS before, count(*) AS after FROM lineitem WHERE l_partkey % 9 = 5 GROUP BY 1)
    SELECT n.doc_id, n.category, before, CASE WHEN g.doc_id IS NULL THEN before ELSE 0 END AS after FROM n LEFT JOIN gone g ON g.doc_id = n.doc_id AND g.category = n.category
    UNION ALL SELECT * FROM shown""",
)
def sanitized_tables(spark, folder):
    """Findings of each category before and after; fields stay when they are emptied."""
    from quire.operators import sanitize as rules

    tables = hidden_tables(spark, folder)
    after, _ = rules.sanitize(tables, *sanitize_decisions(spark, folder))
    kept = lambda held: held["fields"].select("doc_id", F.lit("fields").alias("category"))
    both = lambda held, b, a: rules.findings(held).select("doc_id", "category").unionByName(kept(held)).select(
        "doc_id", "category", F.lit(b).alias("b"), F.lit(a).alias("a")
    )
    return both(tables, 1, 0).unionByName(both(after, 0, 1)).groupBy("doc_id", "category").agg(
        F.sum("b").alias("before"), F.sum("a").alias("after")
    )


@query(
    "sanitize_refusals",
    "Q6 F24",
    f"""WITH {_SANITIZE}, r AS (SELECT d.*, n.before FROM d LEFT JOIN n USING (doc_id, category))
    SELECT doc_id, category, 'The document changed after this was planned.' AS error, CAST(NULL AS BIGINT) AS left_ FROM r WHERE NOT fresh
    UNION ALL SELECT 0, 'all', NULL, 0""",
)
def sanitize_refusals(spark, folder):
    """Decisions taken at another revision, and one row that counts what is left of the others: nothing."""
    from quire.operators import sanitize as rules

    decisions, revisions = sanitize_decisions(spark, folder)
    after, refused = rules.sanitize(hidden_tables(spark, folder), decisions, revisions)
    left = rules.left_over(after, decisions, refused).agg(F.count("*").alias("left_"))
    return refused.select("doc_id", "category", "error", F.lit(None).cast("bigint").alias("left_")).unionByName(
        left.select(F.lit(0).cast("bigint").alias("doc_id"), F.lit("all").alias("category"), F.lit(None).cast("string").alias("error"), "left_")
    )
