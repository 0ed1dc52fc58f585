"""Layout of pages: words set with a wavering baseline, and order sheets as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans import shared_sql as q
from quire.plans.registry import query
from quire.plans.search import pages_of
from quire.session import spread, table
from quire.sources.paginate import word_rows


def wavering_words(spark, folder):
    """Words of every page as rows, each a little off its baseline, some set larger."""
    k = F.col("seq")
    return word_rows(pages_of(spark, folder)).select(
        "doc_id", "page", "page_row", "seq", "str", "x",
        (F.col("y") + F.pmod(k * 7 + F.floor(k / 1000), F.lit(9)) * 0.75).alias("y"), "width",
        F.when(F.floor(k / 1000) % 17 == 3, 16.0).otherwise(F.col("height")).alias("height"),
    )


def word_lines(spark, folder, members=False):
    return layout.line_pages(wavering_words(spark, folder), members)


WORDS_SQL = q.ITEMS + f""",
piece AS (SELECT doc_id, page, seq, x, y, height, width / length(str) AS advance, unnest(ps) AS p, generate_subscripts(ps, 1) AS k,
            list_transform(ps, lambda s: length(s)) AS ns
          FROM (SELECT *, regexp_extract_all(str, '{q.BLANK}*{q.SOLID}+') AS ps FROM text_items)),
word AS (SELECT doc_id, page, seq * 1000 + k - 1 AS seq, regexp_replace(p, '^{q.BLANK}+', '') AS str,
           x + (list_sum(list_slice(ns, 1, k)) - length(regexp_replace(p, '^{q.BLANK}+', ''))) * advance AS x,
           y + ((seq * 1000 + k - 1) * 7 + seq) % 9 * 0.75::DOUBLE AS y,
           length(regexp_replace(p, '^{q.BLANK}+', '')) * advance AS width,
           CASE WHEN seq % 17 = 3 THEN 16.0 ELSE height END::DOUBLE AS height FROM piece)"""


def lines_sql(items: str) -> str:
    """Lines of ``items``: an ordered fold per page in SQL."""
    return f"""
sorted AS (SELECT doc_id, page, list({{'y': y, 'x': x, 'seq': seq, 'str': str, 'width': width, 'height': height}} ORDER BY y DESC, x, seq) AS its
           FROM {items} WHERE {q.trimmed("str")} <> '' GROUP BY 1, 2),
folded AS (SELECT doc_id, page, its, list_reduce(its, lambda s, i: {{'anchor': CASE WHEN abs(s.anchor - i.y) <= greatest(1.5, i.height * 0.5) THEN s.anchor ELSE i.y END,
             'n': s.n + CASE WHEN abs(s.anchor - i.y) <= greatest(1.5, i.height * 0.5) THEN 0 ELSE 1 END,
             'ids': list_append(s.ids, s.n + CASE WHEN abs(s.anchor - i.y) <= greatest(1.5, i.height * 0.5) THEN 0 ELSE 1 END)}},
             {{'anchor': 1e9::DOUBLE, 'n': 0, 'ids': []::INT[]}}).ids AS ids FROM sorted),
member AS (SELECT doc_id, page, line, i AS ord, it.y AS y, it.x AS x, it.str AS str, it.width AS width, it.height AS height
           FROM (SELECT doc_id, page, unnest(ids) AS line, unnest(its) AS it, generate_subscripts(ids, 1) AS i FROM folded)),
spaced AS (SELECT *, lag(x + width) OVER w AS px, lag(height) OVER w AS ph, lag(str) OVER w AS ps, row_number() OVER w AS pos
           FROM member WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY x, ord)),
line AS (SELECT doc_id, page, line, {q.collapsed("string_agg(CASE WHEN px IS NOT NULL AND x - px > greatest(1, least(ph, height)) * 0.2 AND NOT regexp_matches(ps, '\\s$') AND NOT regexp_matches(str, '^\\s') THEN ' ' || str ELSE str END, '' ORDER BY pos)")} AS text,
           arg_min(y, ord) AS y, min(x) AS "left", max(x + width) AS "right", max(height) AS height, count(*) AS items FROM spaced GROUP BY 1, 2, 3)"""


WORD_LINES = WORDS_SQL + "," + lines_sql("word")

BLOCKS_SQL = f"""
flag AS (SELECT *, coalesce(lag(y) OVER w - y > greatest(lag(height) OVER w, height) * 1.6
             OR abs("left" - lag("left") OVER w) > greatest(lag(height) OVER w, height) * 0.9
             OR abs(height - lag(height) OVER w) > greatest(1.0, greatest(lag(height) OVER w, height) * 0.25), true) AS starts
         FROM line WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
numbered AS (SELECT *, sum(starts::INT) OVER (PARTITION BY doc_id, page ORDER BY line) AS block, median(height) OVER (PARTITION BY doc_id, page) AS body FROM flag),
block AS (SELECT doc_id, page, block::BIGINT AS block, {q.collapsed("string_agg(text, ' ' ORDER BY line)")} AS text, max(height) AS height, min("left") AS "left",
          max("right") AS "right", max(y) AS top_y, count(*) AS lines, max(height) > any_value(body) * 1.25 AND count(*) <= 3 AS heading FROM numbered GROUP BY 1, 2, 3)"""


@query(
    "layout_lines",
    "Q10 L1 W4 A11",
    f"""WITH {WORD_LINES} SELECT doc_id, page, line::BIGINT AS line, text, round(y, 3) AS y, round("left", 3) AS "left", round("right", 3) AS "right", height, items FROM line""",
)
def layout_lines(spark, folder):
    found = layout.line_rows(word_lines(spark, folder), "items")
    return found.select(
        "doc_id", "page", "line", "text", F.round("y", 3).alias("y"), F.round("left", 3).alias("left"),
        F.round("right", 3).alias("right"), "height", "items",
    )


@query(
    "layout_blocks",
    "Q10 W2 W3 A14 S15",
    f"""WITH {WORD_LINES},{BLOCKS_SQL} SELECT doc_id, page, block, text, height, round("left", 3) AS "left", round("right", 3) AS "right", lines, heading FROM block""",
)
def layout_blocks(spark, folder):
    return layout.blocks(word_lines(spark, folder)).select(
        "doc_id", "page", "block", "text", "height", F.round("left", 3).alias("left"),
        F.round("right", 3).alias("right"), "lines", "heading",
    )


@query(
    "layout_slides",
    "S16",
    f"""WITH {WORD_LINES},{BLOCKS_SQL} SELECT doc_id, page, block, round("left" / 72, 6) AS x, round((841.89 - top_y - height) / 72, 6) AS y,
      round(greatest(0.5, ("right" - "left") / 72), 6) AS w, round(greatest(0.2, height * lines * 1.3 / 72), 6) AS h,
      greatest(6, floor(height + 0.5))::BIGINT AS font_size, heading AS bold FROM block""",
)
def layout_slides(spark, folder):
    boxes = layout.slide_boxes(layout.blocks(word_lines(spark, folder)), 841.89)
    return boxes.select(
        "doc_id", "page", "block", *[F.round(c, 6).alias(c) for c in "xywh"], "font_size", "bold"
    )


@query(
    "layout_page_text",
    "Q10 S12",
    f"""WITH {WORD_LINES} SELECT doc_id, page, md5({q.trimmed("string_agg(text, chr(10) ORDER BY line)")}) AS text FROM line GROUP BY 1, 2""",
)
def layout_page_text(spark, folder):
    found = layout.page_text(word_lines(spark, folder))
    return found.select("doc_id", "page", F.md5("text").alias("text"))


@query(
    "layout_spaced_text",
    "Q10 L2 W6",
    f"""WITH {WORD_LINES},
    wide AS (SELECT doc_id, page, median(height) * 0.5 AS width FROM line GROUP BY 1, 2),
    strip AS (SELECT s.doc_id, s.page, s.line, list_reduce(list({{'x': x, 's': {q.trimmed("str")}}} ORDER BY pos),
        lambda t, i: (CASE WHEN greatest(0, floor(i.x / any_w + 0.5)) > length(t) THEN rpad(t, greatest(0, floor(i.x / any_w + 0.5))::INT, ' ')
           WHEN t <> '' AND NOT suffix(t, ' ') THEN t || ' ' ELSE t END) || i.s, '') AS text
      FROM (SELECT *, width_of AS any_w FROM spaced JOIN (SELECT doc_id, page, width AS width_of FROM wide) USING (doc_id, page)) s GROUP BY 1, 2, 3, any_w),
    gap AS (SELECT doc_id, page, line, coalesce(least(4, greatest(0, floor((lag(y) OVER w - y) / greatest(lag(height) OVER w, height) + 0.5) - 1)), 0)::INT AS blanks
      FROM line WINDOW w AS (PARTITION BY doc_id, page ORDER BY line))
    SELECT doc_id, page, md5({q.trimmed(f"string_agg(repeat(chr(10), blanks) || regexp_replace(text, '{q.BLANK}+$', ''), chr(10) ORDER BY line)")}) AS text
    FROM strip JOIN gap USING (doc_id, page, line) GROUP BY 1, 2""",
)
def layout_spaced_text(spark, folder):
    found = layout.spaced_page_text(word_lines(spark, folder, members=True))
    return found.select("doc_id", "page", F.md5("text").alias("text"))


def order_sheets(spark, folder):
    """Orders as pages: one line per order line, its values set in columns; a
    title and a note above and below."""
    k = F.col("l_partkey")
    cells = F.array(
        F.struct(F.lit(72.0).alias("x"), F.concat(F.lit("Item "), k.cast("string")).alias("str")),
        F.struct((F.lit(202.0) + k % 3).alias("x"), F.col("l_quantity").cast("int").cast("string").alias("str")),
        F.struct((F.lit(302.0) - k % 2).alias("x"), F.concat(F.floor("l_extendedprice").cast("string"), F.lit(".5")).alias("str")),
        F.struct(F.lit(402.0).alias("x"), F.col("l_returnflag").alias("str")),
    )
    rows = spread(table(spark, folder, "lineitem"), "l_orderkey").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.lit(700.0) - F.col("l_linenumber") * 18).alias("y"),
        ((F.floor(F.col("l_extendedprice") * 100) * 1000 + k % 1000) * 10).alias("base"),
        F.posexplode(cells).alias("at", "cell"),
        F.lit(10.0).alias("height"),
    )
    notes = spread(table(spark, folder, "orders"), "o_orderkey").select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(
            F.array(
                F.struct(F.lit(740.0).alias("y"), F.lit(1).alias("base"), F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("str"), F.lit(18.0).alias("height")),
                F.struct(F.lit(80.0).alias("y"), F.lit(990).alias("base"), F.col("o_orderpriority").alias("str"), F.lit(10.0).alias("height")),
            )
        ).alias("n"),
    )
    flat = rows.select("doc_id", "y", (F.col("base") + F.col("at")).alias("seq"), "cell.x", "cell.str", "height").unionByName(
        notes.select("doc_id", "n.y", F.col("n.base").alias("seq"), F.lit(72.0).alias("x"), "n.str", "n.height")
    )
    return flat.select(
        "doc_id", F.lit(1).alias("page"), "seq", "str", "x", "y", (F.length("str") * 5.0).alias("width"), "height"
    )


def sheet_lines(spark, folder):
    return layout.line_pages(layout.gathered_rows(order_sheets(spark, folder)))


SHEETS_SQL = """
cell AS (
  SELECT l_orderkey AS doc_id, 700.0 - l_linenumber * 18 AS y, (floor(l_extendedprice * 100)::BIGINT * 1000 + l_partkey % 1000) * 10 + ci AS seq, 10.0 AS height,
    CASE ci WHEN 0 THEN 72.0 WHEN 1 THEN 202.0 + l_partkey % 3 WHEN 2 THEN 302.0 - l_partkey % 2 ELSE 402.0 END AS x,
    CASE ci WHEN 0 THEN 'Item ' || l_partkey WHEN 1 THEN l_quantity::INT::VARCHAR WHEN 2 THEN floor(l_extendedprice)::BIGINT || '.5' ELSE l_returnflag END AS str
  FROM lineitem, (SELECT unnest([0, 1, 2, 3]) AS ci)
  UNION ALL SELECT o_orderkey, 740.0, 1, 18.0, 72.0, 'Order ' || o_orderkey FROM orders
  UNION ALL SELECT o_orderkey, 80.0, 990, 10.0, 72.0, o_orderpriority FROM orders),
item AS (SELECT doc_id, 1 AS page, seq, str, x::DOUBLE AS x, y::DOUBLE AS y, length(str) * 5.0::DOUBLE AS width, height::DOUBLE AS height FROM cell)"""

TABLES_SQL = SHEETS_SQL + "," + lines_sql("item") + """,
start AS (SELECT s.doc_id, s.page, s.line, s.x FROM spaced s JOIN line l USING (doc_id, page, line)
          WHERE l.items >= 2 AND (s.px IS NULL OR s.x - s.px > greatest(6, l.height * 0.9))),
cand AS (SELECT l.doc_id, l.page, l.line, count(*) AS n FROM line l JOIN start s USING (doc_id, page, line) GROUP BY 1, 2, 3),
cnt AS (SELECT doc_id, page, count(*) AS c, count(*) FILTER (WHERE n >= 2) AS r FROM cand GROUP BY 1, 2),
edge AS (SELECT doc_id, page, floor(x / 4 + 0.5) * 4 AS e, count(*) AS n FROM start GROUP BY ALL),
col AS (SELECT doc_id, page, list(e ORDER BY e) AS columns FROM edge JOIN cnt USING (doc_id, page)
        WHERE c >= 3 AND r >= 3 AND n >= greatest(2, ceil(c * 0.6)) GROUP BY 1, 2 HAVING count(*) >= 2),
row_cell AS (SELECT s.doc_id, s.page, s.line, greatest(len(list_filter(columns, lambda e: e <= s.x + 4)) - 1, 0) AS "column", s.str, s.pos
        FROM spaced s JOIN cand c ON c.doc_id = s.doc_id AND c.page = s.page AND c.line = s.line AND c.n >= 2 JOIN col ON col.doc_id = s.doc_id AND col.page = s.page),
grid AS (SELECT doc_id, page, line, generate_subscripts(columns, 1) - 1 AS "column" FROM cand JOIN col USING (doc_id, page) WHERE n >= 2),
told AS (SELECT doc_id, page, line, "column", string_agg(trim(str), ' ' ORDER BY pos) AS text FROM row_cell GROUP BY 1, 2, 3, 4),
filled AS (SELECT doc_id, page, line, "column", coalesce(told.text, '') AS text FROM grid LEFT JOIN told USING (doc_id, page, line, "column"))"""


@query(
    "table_cells",
    "Q10 L9 L10 A13 W5 J10 S14 H12",
    f"""WITH {TABLES_SQL} SELECT doc_id, page::BIGINT AS page, line::BIGINT AS line, "column"::BIGINT AS "column", text,
      CASE WHEN regexp_matches(regexp_replace(text, '[\\s,]', '', 'g'), '^[+-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast(regexp_replace(text, '[\\s,]', '', 'g') AS DOUBLE) END AS number
    FROM filled
    UNION ALL SELECT doc_id, page, line, 0, text, NULL FROM line ANTI JOIN col USING (doc_id, page)""",
)
def table_cells(spark, folder):
    return layout.sheet_rows(sheet_lines(spark, folder))


@query(
    "word_paragraphs",
    "S15 L9",
    f"""WITH {TABLES_SQL.replace("line AS (SELECT doc_id, page, line,", "every_line AS (SELECT doc_id, page, line,", 1).replace("FROM spaced GROUP BY 1, 2, 3)", "FROM spaced GROUP BY 1, 2, 3), line AS (SELECT * FROM every_line)", 1)},
    tabled AS (SELECT doc_id, page, line, string_agg(text, chr(9) ORDER BY "column") AS text FROM filled GROUP BY 1, 2, 3),
    {BLOCKS_SQL.replace("FROM line WINDOW", "FROM (SELECT * FROM every_line ANTI JOIN tabled USING (doc_id, page, line)) WINDOW")}
    SELECT doc_id, page::BIGINT AS page, 'block' AS part, block AS ord, heading, floor(height * 2 + 0.5)::BIGINT AS half_points, text FROM block
    UNION ALL SELECT doc_id, page, 'table', line, false, NULL, text FROM tabled""",
)
def word_paragraphs(spark, folder):
    return layout.document_paragraphs(sheet_lines(spark, folder))
