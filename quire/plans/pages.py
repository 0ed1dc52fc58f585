"""Page sequences of the laid-out documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import text as fn
from quire.operators import pages as ops
from quire.operators.scale import runs
from quire.plans import shared_sql as q
from quire.plans.registry import query
from quire.plans.search import pages_of
from quire.session import spread, table
from quire.sources.paginate import page_lines


def page_table(spark, folder):
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    return page_lines(documents).select("doc_id", "page", "page_count")


def counts(spark, folder):
    return page_table(spark, folder).where("page = 1").select("doc_id", "page_count")


_PAGES = q.LINES + """,
pg AS (SELECT doc_id, unnest(range(1, page_count + 1)) AS page, page_count FROM page_dim)"""


def longs(*values):
    return F.array(*[F.lit(v).cast("bigint") for v in values])


_PARTS_SQL = """part AS (SELECT doc_id % 7 AS job, doc_id AS part, doc_id, page_count, CASE WHEN doc_id % 2 = 0 THEN list_filter([2, 1, 2, 99], lambda p: p <= page_count) ELSE range(1, page_count + 1) END AS ps FROM page_dim),
start AS (SELECT *, coalesce(sum(len(ps)) OVER (PARTITION BY job ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM part),
landed AS (SELECT job, part, doc_id, before + generate_subscripts(ps, 1) AS landed, unnest(ps) AS page FROM start)"""


def sources_in_jobs(spark, folder):
    return counts(spark, folder).select(
        (F.col("doc_id") % 7).alias("job"), F.col("doc_id").alias("part"), "doc_id",
        F.when(F.col("doc_id") % 2 == 0, longs(2, 1, 2, 99)).alias("pages"),
    )


@query(
    "combine_sources",
    "U1 Q15 S18",
    f"WITH {q.LINES}, {_PARTS_SQL} SELECT job, landed, doc_id, page::BIGINT AS page, part FROM landed",
)
def combine_sources(spark, folder):
    return ops.combined(sources_in_jobs(spark, folder), counts(spark, folder))


@query(
    "carried_bookmarks",
    "J14 Q15",
    f"""WITH {q.LINES}, {_PARTS_SQL},
    mark AS (SELECT doc_id, k::VARCHAR AS path, 'Chapter ' || k AS title, k + 1 AS page FROM page_dim, (SELECT unnest([0, 1, 2]) AS k)),
    last AS (SELECT job, part, doc_id, page, max(landed) AS landed FROM landed GROUP BY ALL)
    SELECT t.job, t.part, t.doc_id, m.path, m.title, m.page::BIGINT AS page, l.landed FROM (SELECT DISTINCT job, part, doc_id FROM landed) t JOIN mark m USING (doc_id)
    LEFT JOIN last l ON l.job = t.job AND l.part = t.part AND l.doc_id = t.doc_id AND l.page = m.page""",
)
def carried_bookmarks(spark, folder):
    marks = counts(spark, folder).select("doc_id", F.explode(longs(0, 1, 2)).alias("k")).select(
        "doc_id", F.col("k").cast("string").alias("path"),
        F.concat(F.lit("Chapter "), F.col("k").cast("string")).alias("title"), (F.col("k") + 1).alias("page"),
    )
    landed = ops.combined(sources_in_jobs(spark, folder), counts(spark, folder))
    return ops.carried_bookmarks(marks, landed)


@query(
    "move_pages",
    "U4",
    f"""WITH {_PAGES}, f AS (SELECT *, (page % 3 = 1)::INT AS hit, least(2, page_count) AS ti FROM pg),
    g AS (SELECT *, sum(hit) OVER (PARTITION BY doc_id ORDER BY page) - hit AS before, sum(hit) OVER (PARTITION BY doc_id) AS block, sum(CASE WHEN page <= 2 THEN hit ELSE 0 END) OVER (PARTITION BY doc_id) AS ahead FROM f),
    h AS (SELECT *, greatest(0, least(2 - ahead, page_count - block)) AS target FROM g)
    SELECT doc_id, page, (CASE WHEN hit = 1 THEN target + before WHEN page - 1 - before < target THEN page - 1 - before ELSE page - 1 - before + block END + 1)::BIGINT AS position FROM h""",
)
def move_pages(spark, folder):
    pages = page_table(spark, folder)
    moves = pages.where("page % 3 = 1").select("doc_id", "page", F.lit(2).alias("to_index"))
    return ops.moved(pages, moves)


@query(
    "duplicate_pages",
    "U5",
    f"""WITH {_PAGES}, g AS (SELECT *, (page - 1) // 2 AS before FROM pg)
    SELECT doc_id, page, (page + before)::BIGINT AS position, false AS copy FROM g UNION ALL SELECT doc_id, page, page + before + 1, true FROM g WHERE page % 2 = 0""",
)
def duplicate_pages(spark, folder):
    pages = page_table(spark, folder)
    return ops.duplicated(pages, pages.where("page % 2 = 0"))


@query(
    "delete_pages",
    "U3",
    f"""WITH {_PAGES}, f AS (SELECT *, doc_id % 10 = 0 OR (doc_id + page) % 3 = 0 AS gone FROM pg),
    g AS (SELECT *, bool_and(gone) OVER (PARTITION BY doc_id) AS refused, (page - coalesce(sum(gone::INT) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS position FROM f)
    SELECT doc_id, page, position, false AS refused FROM g WHERE NOT refused AND NOT gone UNION ALL SELECT DISTINCT doc_id, NULL, NULL, true FROM g WHERE refused""",
)
def delete_pages(spark, folder):
    pages = page_table(spark, folder)
    left, refused = ops.deleted(pages, pages.where("doc_id % 10 = 0 or (doc_id + page) % 3 = 0"))
    return left.withColumn("refused", F.lit(False)).unionByName(
        refused.withColumn("refused", F.lit(True)), allowMissingColumns=True
    )


@query(
    "insert_blank_pages",
    "U6",
    f"""WITH {_PAGES}, s AS (SELECT doc_id, page, page_count, 500.0::DOUBLE + page AS width, 700.0::DOUBLE + doc_id AS height, least(doc_id % 4, page_count) AS i FROM pg)
    SELECT doc_id, (page + CASE WHEN page > i THEN 2 ELSE 0 END)::BIGINT AS position, page, width, height FROM s
    UNION ALL SELECT d.doc_id, i + k, NULL, CASE WHEN i = 0 THEN 595.28 ELSE 500.0 + i END, CASE WHEN i = 0 THEN 841.89 ELSE 700.0 + d.doc_id END
    FROM (SELECT doc_id, least(doc_id % 4, page_count) AS i FROM page_dim) d, (SELECT unnest([1, 2]) AS k)""",
)
def insert_blank_pages(spark, folder):
    pages = page_table(spark, folder).select(
        "doc_id", "page", (F.lit(500.0) + F.col("page")).alias("width"), (F.lit(700.0) + F.col("doc_id")).alias("height")
    )
    inserts = counts(spark, folder).select("doc_id", (F.col("doc_id") % 4).alias("index"), F.lit(2).alias("count"))
    return ops.inserted_blanks(pages, inserts)


@query(
    "insert_pages",
    "U6 U2",
    f"""WITH {_PAGES}, ins AS (SELECT a.doc_id, least(1, a.page_count) AS i, b.doc_id AS src, CASE WHEN a.doc_id % 2 = 0 THEN list_filter([1, 3], lambda p: p <= b.page_count) ELSE range(1, b.page_count + 1) END AS ps
      FROM page_dim a JOIN page_dim b ON b.doc_id = a.doc_id + 1)
    SELECT pg.doc_id, (page + CASE WHEN page > i THEN len(ps) ELSE 0 END)::BIGINT AS position, pg.doc_id AS from_doc, page FROM pg LEFT JOIN ins USING (doc_id)
    UNION ALL SELECT doc_id, i + k, src, p FROM (SELECT doc_id, i, src, unnest(ps) AS p, generate_subscripts(ps, 1) AS k FROM ins)""",
)
def insert_pages(spark, folder):
    pages = page_table(spark, folder)
    inserts = counts(spark, folder).select(
        "doc_id", F.lit(1).alias("index"), (F.col("doc_id") + 1).alias("source_id"),
        F.when(F.col("doc_id") % 2 == 0, longs(3, 1, 3, 0)).alias("pages"),
    )
    return ops.inserted_from(pages, inserts, counts(spark, folder))


@query(
    "extract_pages",
    "U8 S18",
    f"""WITH {_PAGES}, a AS (SELECT doc_id, page_count, unnest([3, 1, 1, 7]) AS page, unnest([0, 1, 2, 3]) AS ord FROM page_dim)
    SELECT doc_id, page::BIGINT AS page, ord::BIGINT AS ord FROM a WHERE page <= page_count""",
)
def extract_pages(spark, folder):
    asked = counts(spark, folder).select("doc_id", longs(3, 1, 1, 7).alias("pages"))
    return ops.extracted(page_table(spark, folder), asked)


@query(
    "split_documents",
    "W11 W12 Q16 S18",
    f"""WITH {_PAGES}, b AS (SELECT doc_id, page, (page - 1) // 2 + 1 AS every_part, page = 1 OR page IN (2, 4) AS begins FROM pg),
    c AS (SELECT *, (sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY page))::BIGINT AS part FROM b)
    SELECT doc_id, page, every_part, part, CASE WHEN page IN (2, 4) THEN 'Part ' || page END AS title FROM c""",
)
def split_documents(spark, folder):
    pages = page_table(spark, folder)
    marks = pages.where("page in (2, 4)").select(
        "doc_id", "page", F.lit(1).alias("ord"), F.concat(F.lit("Part "), F.col("page").cast("string")).alias("title")
    )
    marks = marks.unionByName(marks.withColumn("ord", F.lit(2)).withColumn("title", F.lit("later")))
    return ops.split_every(pages, 2).withColumnRenamed("part", "every_part").join(
        ops.split_at(pages, marks), ["doc_id", "page"]
    )


@query(
    "split_by_ranges",
    "W13 Q16",
    f"""WITH {q.LINES}, r AS (SELECT doc_id, page_count AS n, unnest(['1-2', '2-', '1; 3']) AS piece, unnest([1, 2, 3]) AS part FROM page_dim)
    SELECT doc_id, part::BIGINT AS part, CASE part WHEN 1 THEN CASE WHEN n >= 2 THEN '1,2' ELSE '' END WHEN 2 THEN CASE WHEN n >= 2 THEN array_to_string(range(2, n + 1), ',') ELSE '' END
      ELSE CASE WHEN n >= 3 THEN '1,3' ELSE '' END END AS pages,
      CASE WHEN (part < 3 AND n < 2) OR (part = 3 AND n < 3) THEN 'This document has pages 1 to ' || n || '.' END AS problem FROM r""",
)
def split_by_ranges(spark, folder):
    requests = counts(spark, folder).select("doc_id", "page_count", F.lit("1-2, 2-,, 1; 3").alias("ranges"))
    found = ops.split_ranges(requests)
    return found.select(
        "doc_id", F.col("part").alias("raw_part"), F.array_join(F.col("pages").cast("array<string>"), ",").alias("pages"), "problem"
    ).withColumnRenamed("raw_part", "part")


_RANGES_SQL = """lr AS (SELECT doc_id, 0 AS f, 'romanLower' AS style, '' AS prefix, 1 AS start FROM page_dim WHERE doc_id % 3 > 0
   UNION ALL SELECT doc_id, 1, 'decimal', 'A-', 5 FROM page_dim UNION ALL SELECT doc_id, 4, 'letterUpper', '', 26 FROM page_dim)"""
_LABEL_SQL = """CASE style WHEN 'decimal' THEN prefix || n WHEN 'romanLower' THEN ['i','ii','iii','iv','v','vi','vii','viii','ix','x'][n] WHEN 'letterUpper' THEN repeat(chr(65 + (n - 1)::INT % 26), ((n - 1)::INT // 26) + 1) END"""


def label_ranges(spark, folder):
    options = F.array(
        *[
            F.struct(
                F.lit(f).cast("bigint").alias("from_index"), F.lit(s).alias("style"),
                F.lit(p).alias("prefix"), F.lit(n).cast("bigint").alias("start"),
            )
            for f, s, p, n in ((0, "romanLower", "", 1), (1, "decimal", "A-", 5), (4, "letterUpper", "", 26))
        ]
    )
    flat = counts(spark, folder).select("doc_id", F.inline(options))
    return flat.where((F.col("from_index") > 0) | (F.col("doc_id") % 3 > 0))


@query(
    "page_labels",
    "J9 Q17 H10",
    f"""WITH {_PAGES}, {_RANGES_SQL}, m AS (SELECT pg.doc_id, pg.page, max(f) AS f FROM pg LEFT JOIN lr ON lr.doc_id = pg.doc_id AND lr.f <= pg.page - 1 GROUP BY ALL),
    v AS (SELECT m.doc_id, m.page, style, prefix, start + page - 1 - m.f AS n FROM m LEFT JOIN lr USING (doc_id, f))
    SELECT doc_id, page, {_LABEL_SQL} AS label FROM v""",
)
def page_labels(spark, folder):
    return ops.labelled(page_table(spark, folder), label_ranges(spark, folder))


@query(
    "set_page_labels",
    "Q17",
    f"""WITH {q.LINES}, {_RANGES_SQL}, ch AS (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 1 ELSE 2 END AS f FROM page_dim),
    merged AS (SELECT lr.* FROM lr WHERE (doc_id, f) NOT IN (SELECT (doc_id, f) FROM ch) UNION ALL SELECT doc_id, f, 'none', 'App', 1 FROM ch)
    SELECT doc_id, f::BIGINT AS from_index, style, prefix, start::BIGINT AS start FROM merged
    UNION ALL SELECT doc_id, 0, 'decimal', '', 1 FROM merged GROUP BY doc_id HAVING min(f) > 0""",
)
def set_page_labels(spark, folder):
    changes = counts(spark, folder).select(
        "doc_id", F.when(F.col("doc_id") % 2 == 0, 1).otherwise(2).cast("bigint").alias("from_index"),
        F.lit("none").alias("style"), F.lit("App").alias("prefix"), F.lit(1).cast("bigint").alias("start"),
    )
    return ops.with_label_range(label_ranges(spark, folder), changes)


@query(
    "numbered_pages",
    "W14 H7",
    f"""WITH {_PAGES}, s AS (SELECT doc_id, page, page_count, row_number() OVER (ORDER BY doc_id, page) - 1 AS pos FROM pg),
    n AS (SELECT *, 'QX' || lpad((990 + pos)::VARCHAR, greatest(length((990 + pos)::VARCHAR), 4)::INT, '0') || '-z' AS stamp FROM s)
    SELECT doc_id, page, stamp, 'Page ' || page || ' of ' || page_count || ' ' || stamp || ' ' || doc_id AS footer FROM n""",
)
def numbered_pages(spark, folder):
    stamped = ops.numbered(page_table(spark, folder), "QX", 4, "-z", 990)
    footer = fn.filled_template(
        "Page {{page}} of {{pages}} {{bates}} {{title}}",
        {
            "{{page}}": F.col("page").cast("string"), "{{pages}}": F.col("page_count").cast("string"),
            "{{title}}": F.col("doc_id").cast("string"), "{{bates}}": F.col("stamp"),
        },
    )
    return stamped.select("doc_id", "page", "stamp", footer.alias("footer"))


@query(
    "page_rows",
    "W18",
    f"""WITH {_PAGES}, r AS (SELECT *, page // 2 AS row_, page_count // 2 AS last_ FROM pg), n AS (SELECT *, least(last_, row_ + 1) AS nx FROM r)
    SELECT doc_id, page, row_::BIGINT AS display_row, CASE WHEN nx = 0 THEN 1 ELSE nx * 2 END::BIGINT AS next_page, CASE WHEN page % 2 = 0 THEN 'left' ELSE 'right' END AS side,
      ((page - 1) // 2)::BIGINT AS plain_row, (greatest(0, (page - 1) // 2 - 1) * 2 + 1)::BIGINT AS plain_previous FROM n""",
)
def page_rows(spark, folder):
    page, n = F.col("page"), F.col("page_count")
    return page_table(spark, folder).select(
        "doc_id", "page",
        ops.row_index(page, True, True).alias("display_row"),
        ops.step_page(page, 1, n, True, True).cast("bigint").alias("next_page"),
        ops.side_of(page, True, True).alias("side"),
        ops.row_index(page, True, False).alias("plain_row"),
        ops.step_page(page, -1, n, True, False).alias("plain_previous"),
    )


@query(
    "page_selection",
    "U7",
    """WITH c AS (SELECT o_orderkey AS k, list_sort(list_distinct([o_custkey % 9 + 1, o_custkey % 5 + 3])) AS pages, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 9 + 1 END AS anchor, o_orderkey % 8 + 1 AS p, ['replace','toggle','range'][o_orderkey % 3 + 1] AS m FROM orders),
    s AS (SELECT *, CASE WHEN m = 'toggle' THEN CASE WHEN list_contains(pages, p) THEN list_filter(pages, lambda x: x <> p) ELSE list_sort(list_append(pages, p)) END WHEN m = 'range' AND anchor IS NOT NULL THEN range(least(anchor, p), greatest(anchor, p) + 1) ELSE [p] END AS sel FROM c)
    SELECT k AS order_key, array_to_string(sel, ',') AS pages, CASE WHEN m = 'range' AND anchor IS NOT NULL THEN anchor ELSE p END AS anchor,
      CASE WHEN 10 - len(pages) > 0 THEN least(list_min(pages), 10 - len(pages)) END AS landing FROM s""",
)
def page_selection(spark, folder):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        k.alias("order_key"), F.sort_array(F.array_distinct(F.array(c % 9 + 1, c % 5 + 3))).alias("current"),
        F.when(k % 5 > 0, c % 9 + 1).alias("held"), (k % 8 + 1).alias("clicked"),
        F.element_at(F.array(F.lit("replace"), F.lit("toggle"), F.lit("range")), (k % 3 + 1).cast("int")).alias("modifier"),
    )
    after = ops.selected(F.col("current"), F.col("held"), F.col("clicked"), F.col("modifier"))
    return base.select(
        "order_key", after.alias("after"), ops.selection_after_removal(F.col("current"), F.lit(10)).alias("landing")
    ).select("order_key", F.array_join(F.col("after.pages").cast("array<string>"), ",").alias("pages"), "after.anchor", "landing")


@query(
    "crop_groups",
    "A23 J18",
    f"""WITH {_PAGES}, b AS (SELECT doc_id, page, 10.0 + page % 2 AS x, 600.0 - doc_id % 5 AS width FROM pg),
    i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id, x, width ORDER BY page) AS g FROM b)
    SELECT doc_id, x::DOUBLE AS x, 5.0::DOUBLE AS y, width::DOUBLE AS width, 790.0::DOUBLE AS height, min(page) AS "first", max(page) AS "last" FROM i GROUP BY doc_id, x, width, g""",
)
def crop_groups(spark, folder):
    boxes = page_table(spark, folder).select(
        "doc_id", "page", (F.lit(10.0) + F.col("page") % 2).alias("x"), F.lit(5.0).alias("y"),
        (F.lit(600.0) - F.col("doc_id") % 5).alias("width"), F.lit(790.0).alias("height"),
    )
    return ops.crops(boxes)


@query(
    "hit_page_runs",
    "A16",
    f"""WITH {q.PAGES}, h AS (SELECT doc_id, page FROM page_text WHERE contains(lower(text), 'tion')), i AS (SELECT *, page - row_number() OVER (PARTITION BY doc_id ORDER BY page) AS g FROM h),
    r AS (SELECT doc_id, min(page) AS lo, max(page) AS hi FROM i GROUP BY doc_id, g)
    SELECT doc_id, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS pages FROM r GROUP BY 1""",
)
def hit_page_runs(spark, folder):
    found = pages_of(spark, folder).where(F.contains(F.lower("text"), F.lit("tion"))).select("doc_id", "page")
    worded = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(
        F.concat(F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    )
    # Runs, not pages, are gathered: one entry however long a run is.
    return runs(found, ["doc_id"], "page").groupBy("doc_id").agg(
        F.array_join(
            F.transform(F.sort_array(F.collect_list(F.struct("first", worded.alias("worded")))), lambda r: r["worded"]), ", "
        ).alias("pages")
    )


@query(
    "reconciled_lists",
    "J24",
    """WITH mine AS (SELECT l_orderkey AS owner, l_partkey AS id, max(l_extendedprice) AS o FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY ALL),
    m AS (SELECT owner, id, row_number() OVER (PARTITION BY owner ORDER BY o DESC, id) AS ord FROM mine),
    t AS (SELECT l_orderkey AS owner, l_partkey AS id, max(l_quantity) AS value, min(l_linenumber) * 100000 + min(l_suppkey) AS ord FROM lineitem WHERE l_linenumber > 1 GROUP BY ALL)
    SELECT t.owner, t.id, t.value, CASE WHEN m.ord IS NULL THEN 1 ELSE 0 END::BIGINT AS bucket, coalesce(m.ord, t.ord)::BIGINT AS ord FROM t LEFT JOIN m USING (owner, id)""",
)
def reconciled_lists(spark, folder):
    from pyspark.sql import Window

    lines = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("owner"), F.col("l_partkey").alias("id"), "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    mine = lines.where("l_linenumber % 2 = 0").groupBy("owner", "id").agg(F.max("l_extendedprice").alias("o"))
    mine = mine.withColumn("ord", F.row_number().over(Window.partitionBy("owner").orderBy(F.desc("o"), "id")).cast("bigint"))
    truth = lines.where("l_linenumber > 1").groupBy("owner", "id").agg(
        F.max("l_quantity").alias("value"), (F.min("l_linenumber") * 100000 + F.min("l_suppkey")).cast("bigint").alias("ord")
    )
    return ops.reconciled(mine, truth, ["owner"])


@query(
    "output_names",
    "S17",
    f"""WITH {_PAGES}, n AS (SELECT doc_id, page, 'Doc ' || (doc_id % 50) || CASE WHEN doc_id % 2 = 0 THEN ' PAGE ' ELSE ' page ' END || page AS stem FROM pg),
    r AS (SELECT *, row_number() OVER (PARTITION BY lower(stem) ORDER BY doc_id) AS k FROM n)
    SELECT doc_id, page, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || '.txt' AS name FROM r""",
)
def output_names(spark, folder):
    from quire.sources.sinks import unique_names

    word = F.when(F.col("doc_id") % 2 == 0, F.lit(" PAGE ")).otherwise(F.lit(" page "))
    template = fn.filled_template(
        "{name}#{page}", {"{name}": F.concat(F.lit("Doc "), (F.col("doc_id") % 50).cast("string")), "#": word, "{page}": F.col("page").cast("string")}
    )
    named = page_table(spark, folder).select("doc_id", "page", fn.safe_name(template).alias("stem"))
    return unique_names(named, "stem", "doc_id", ".txt").select("doc_id", "page", "name")
