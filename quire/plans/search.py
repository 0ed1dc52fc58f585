"""Pagination and search."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import search as s
from quire.plans import shared_sql as q
from quire.plans.registry import query
from quire.session import spread, table
from quire.sources.paginate import paginate, text_items


def pages_of(spark, folder):
    return paginate(spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id"))


@query(
    "paginate_pages",
    "Q14 L5 L6 H5 S7",
    f"WITH {q.PAGES} SELECT doc_id, page_count, page, text, length(text) AS chars FROM page_text",
)
def paginate_pages(spark, folder):
    return pages_of(spark, folder).select(
        "doc_id", "page_count", "page", "text", F.length("text").alias("chars")
    )


@query(
    "text_items",
    "Q14 L6 W1 S7",
    f"""WITH {q.ITEMS} SELECT doc_id, page, seq, str, x, round(y, 4) AS y, round(width, 4) AS width, height, has_eol,
    "offset" AS start_offset FROM text_items""",
)
def text_items_query(spark, folder):
    return text_items(pages_of(spark, folder)).select(
        "doc_id", "page", "seq", "str", "x", F.round("y", 4).alias("y"),
        F.round("width", 4).alias("width"), "height", "has_eol",
        F.col("offset").alias("start_offset"),
    )


@query(
    "search_pages",
    "Q1 H1 H2 F3",
    f"""WITH {q.PAGES},
hit AS (SELECT doc_id, page, text, unnest({q.starts("lower(text)", "'ation'")}) AS start FROM page_text
        WHERE contains(lower(text), 'ation') AND page BETWEEN 1 AND page_count)
SELECT doc_id, page, start, start + 5 AS "end", {q.excerpt("text", "start", "start + 5")} AS excerpt FROM hit""",
)
def search_pages_query(spark, folder):
    return s.search_pages(pages_of(spark, folder), "ation", page_range="1-").drop("rects")


_PHRASE_HITS = f"""phrase_hit AS (
  SELECT item_id AS phrase_id, doc_id, page, p.text, length(b.text) AS n,
         unnest({q.starts("lower(p.text)", "lower(b.text)")}) AS start
  FROM page_text p JOIN benchmark b ON contains(lower(p.text), lower(b.text)))"""


def benchmark_lines(spark, folder):
    """The benchmark texts, whole, in pieces of six words (a page breaks its lines), as a phrase list."""
    words = F.split("text", " ")
    starts = F.sequence(F.lit(1), F.greatest(F.size(words), F.lit(1)), F.lit(6))
    pieces = F.transform(starts, lambda i: F.array_join(F.slice(words, i, 6), " "))
    return table(spark, folder, "benchmark").select("item_id", F.posexplode(pieces).alias("piece", "phrase")).select(
        (F.col("item_id") * 10000 + F.col("piece")).alias("phrase_id"), "phrase"
    )


@query(
    "search_phrases",
    "Q1 H1 H2",
    f"""WITH {q.PAGES},
w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark),
phrase AS (SELECT item_id * 10000 + i AS phrase_id, array_to_string(list_slice(w, 6 * i + 1, 6 * i + 6), ' ') AS phrase FROM (SELECT item_id, w, unnest(range((len(w) + 5) // 6)) AS i FROM w)),
hit AS (SELECT phrase_id, phrase, doc_id, page, text, unnest({q.starts("lower(text)", "lower(phrase)")}) AS start
        FROM page_text JOIN phrase ON contains(lower(text), lower(phrase)))
SELECT phrase_id, doc_id, page, start, start + length(phrase) AS "end",
       {q.excerpt("text", "start", "start + length(phrase)")} AS excerpt FROM hit""",
)
def search_phrases_query(spark, folder):
    return s.search_phrases(pages_of(spark, folder), benchmark_lines(spark, folder))


def hits_of(spark, folder):
    return s.search_pages(pages_of(spark, folder), "Que le", case_sensitive=False)


_HIT = f"""hit AS (SELECT doc_id, page, unnest({q.starts("lower(text)", "'que le'")}) AS start FROM page_text WHERE contains(lower(text), 'que le')),
rect AS (SELECT h.doc_id, h.page, h.start, i.seq, i.x + (greatest(h.start, i."offset") - i."offset") * 6.6::DOUBLE AS x, i.y, (least(h.start + 6, i."offset" + length(i.str)) - greatest(h.start, i."offset")) * 6.6::DOUBLE AS width, i.height
  FROM hit h JOIN text_items i ON i.doc_id = h.doc_id AND i.page = h.page AND i."offset" < h.start + 6 AND i."offset" + length(i.str) > h.start)"""


@query(
    "hit_rects",
    "J11",
    f"""WITH {q.PAGES}, {_HIT} SELECT doc_id, page, start, seq, round(x, 4) AS x, round(y, 4) AS y, round(width, 4) AS width, height FROM rect""",
)
def hit_rects(spark, folder):
    items = text_items(pages_of(spark, folder))
    found = s.rects_by_item_join(hits_of(spark, folder).select("doc_id", "page", "start", "end"), items)
    return found.select(
        "doc_id", "page", "start", "seq", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"),
        F.round("width", 4).alias("width"), "height",
    )


@query(
    "highlights_by_page",
    "Q2 J11",
    f"""WITH {q.PAGES}, {_HIT}, f AS (SELECT *, start = min(start) OVER (PARTITION BY doc_id, page) AS current FROM rect)
    SELECT doc_id, page, start, current, row_number() OVER (PARTITION BY doc_id, page ORDER BY current, start, seq) AS draw_order, round(x, 4) AS x, round(width, 4) AS width FROM f""",
)
def highlights_by_page(spark, folder):
    from pyspark.sql import Window

    hits = hits_of(spark, folder)
    first = F.min("start").over(Window.partitionBy("doc_id", "page"))
    marked = hits.withColumn("current", F.col("start") == first)
    return s.highlights_by_page(marked, F.col("current")).select(
        "doc_id", "page", "start", "current", "draw_order", F.round("x", 4).alias("x"), F.round("width", 4).alias("width")
    )


@query(
    "search_summary",
    "A17",
    f"""WITH {q.PAGES}, {_HIT}, h AS (SELECT doc_id, count(*) AS hits, count(DISTINCT page) AS pages_hit FROM hit GROUP BY 1)
    SELECT p.doc_id, count(*) AS scanned, count(*) FILTER (WHERE trim(text) = '') AS without_text, coalesce(any_value(hits), 0) AS hits, coalesce(any_value(pages_hit), 0) AS pages_hit FROM page_text p LEFT JOIN h USING (doc_id) GROUP BY 1""",
)
def search_summary(spark, folder):
    return s.search_summary(pages_of(spark, folder).select("doc_id", "page", "text"), hits_of(spark, folder))


@query(
    "capped_hits",
    "T3 Q1",
    f"""WITH {q.PAGES}, {_HIT}, o AS (SELECT *, row_number() OVER (ORDER BY doc_id, page, start) AS n, count(*) OVER () AS met FROM hit) SELECT doc_id, page, start, met > 50 AS truncated FROM o WHERE n <= 50""",
)
def capped_hits(spark, folder):
    return s.first_hits(s.search_pages(pages_of(spark, folder), "que le"), 50).select("doc_id", "page", "start", "truncated")


@query(
    "hit_steps",
    "W15",
    f"""WITH {q.PAGES}, {_HIT}, k AS (SELECT *, page * 1000000 + start AS hit FROM hit)
    SELECT doc_id, hit, coalesce(lead(hit) OVER w, first_value(hit) OVER w) AS next_hit, coalesce(lag(hit) OVER w, last_value(hit) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS previous_hit FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY hit)""",
)
def hit_steps(spark, folder):
    hits = hits_of(spark, folder).withColumn("hit", F.col("page").cast("bigint") * 1000000 + F.col("start"))
    return s.hit_neighbours(hits, ["doc_id"], ["hit"], "hit")


@query(
    "initial_hits",
    "W16",
    f"""WITH {q.PAGES}, {_HIT}, g AS (SELECT d.source, h.doc_id, h.page, h.start, CASE WHEN h.doc_id = o.doc AND h.page >= 2 THEN 0 WHEN h.doc_id = o.doc THEN 1 ELSE 2 END AS priority
      FROM hit h JOIN documents d USING (doc_id) JOIN (SELECT source, max(doc_id) AS doc FROM documents GROUP BY 1) o USING (source))
    SELECT source, priority::BIGINT AS priority, doc_id, page, start FROM g QUALIFY row_number() OVER (PARTITION BY source ORDER BY priority, doc_id, page, start) = 1""",
)
def initial_hits(spark, folder):
    documents = table(spark, folder, "documents").select("doc_id", "source")
    current = documents.groupBy("source").agg(F.max("doc_id").alias("open_doc"))
    hits = hits_of(spark, folder).join(documents, "doc_id").join(current, "source")
    return s.initial_hit(hits, "source", F.col("open_doc"), F.lit(2), ["doc_id", "page", "start"])
