"""Geometry rules over numbers of the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.plans.registry import query
from quire.session import table

# Two rectangles per order line, from its numbers.
_RECTS_SQL = """r AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_partkey, l_suppkey,
  (l_partkey % 97)::DOUBLE AS ax, (l_suppkey % 53)::DOUBLE AS ay, l_quantity AS aw, (l_partkey % 11)::DOUBLE AS ah,
  (l_suppkey % 89)::DOUBLE AS bx, (l_partkey % 61)::DOUBLE AS by_, (l_suppkey % 40)::DOUBLE AS bw, 50 * l_discount * 10 AS bh FROM lineitem)"""


def rects(spark, folder):
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", p, s,
        g.rect(p % 97, s % 53, F.col("l_quantity"), p % 11).alias("a"),
        g.rect(s % 89, p % 61, s % 40, F.lit(50) * F.col("l_discount") * 10).alias("b"),
    )


@query(
    "rectangle_rules",
    "H19 F15 J7",
    f"""WITH {_RECTS_SQL}, c AS (SELECT *, least(ax + aw, bx + bw) - greatest(ax, bx) AS ow, least(ay + ah, by_ + bh) - greatest(ay, by_) AS oh FROM r),
    d AS (SELECT *, CASE WHEN ow > 0 AND oh > 0 THEN ow * oh ELSE 0.0 END AS shared FROM c)
    SELECT l_orderkey, l_linenumber, round(shared, 6) AS shared,
      ow >= 0 AND oh >= 0 AND (shared > 0 OR aw * ah = 0 OR bw * bh = 0) AS touches,
      ax < bx + bw AND bx < ax + aw AND ay < by_ + bh AND by_ < ay + ah AS overlaps,
      bx >= ax - 0.5 AND by_ >= ay - 0.5 AND bx + bw <= ax + aw + 0.5 AND by_ + bh <= ay + ah + 0.5 AS inside,
      (ax + aw / 2 BETWEEN bx AND bx + bw AND ay + ah / 2 BETWEEN by_ AND by_ + bh) OR (aw * ah > 0 AND shared / (aw * ah) >= 0.3) AS covered,
      round(greatest(ax + aw, bx + bw) - least(ax, bx), 6) AS union_width, round(aw + 4, 6) AS grown,
      (aw > 0.5 AND ah > 0.5)::BIGINT + (bw > 0.5 AND bh > 0.5)::BIGINT AS quads FROM d""",
)
def rectangle_rules(spark, folder):
    a, b = F.col("a"), F.col("b")
    return rects(spark, folder).select(
        "l_orderkey", "l_linenumber",
        F.round(g.shared_area(a, b), 6).alias("shared"),
        g.touches(a, b).alias("touches"),
        g.overlaps(a, b).alias("overlaps"),
        g.contains_rect(a, b).alias("inside"),
        g.glyph_covered(a, b).alias("covered"),
        F.round(g.union(a, b)["width"], 6).alias("union_width"),
        F.round(g.inflated(a, 2.0)["width"], 6).alias("grown"),
        F.size(g.quads(F.array(a, b))).alias("quads"),
    )


@query(
    "page_to_screen",
    "H23 H14 H13",
    f"""WITH {_RECTS_SQL}, t AS (SELECT *, (l_linenumber - 1) % 4 AS q, ax - 5 AS x, ay - 7 AS y, 1.5 * 2.0 AS k FROM r WHERE aw > 0 AND ah > 0)
    SELECT l_orderkey, l_linenumber, q AS quarter,
      round(k * CASE q WHEN 1 THEN y WHEN 2 THEN 595 - (x + aw) WHEN 3 THEN 842 - (y + ah) ELSE x END, 4) AS "left",
      round(k * CASE q WHEN 1 THEN x WHEN 2 THEN y WHEN 3 THEN 595 - (x + aw) ELSE 842 - (y + ah) END, 4) AS top,
      round(k * CASE WHEN q % 2 = 1 THEN ah ELSE aw END, 4) AS width, round(k * CASE WHEN q % 2 = 1 THEN aw ELSE ah END, 4) AS height,
      round(ax, 4) AS back_x, round(ay, 4) AS back_y, round(aw, 4) AS back_w, round(ah, 4) AS back_h FROM t""",
)
def page_to_screen(spark, folder):
    page = g.rect(F.lit(5), F.lit(7), F.lit(595), F.lit(842))
    turn = (F.col("l_linenumber") - 1) % 4 * 90 + 360
    args = (page, F.lit(1.5), turn, F.lit(2.0))
    placed = (
        rects(spark, folder)
        .withColumn("screen", g.to_screen(F.col("a"), *args))
        .where(F.col("screen").isNotNull())
        .withColumn("back", g.from_screen(F.col("screen"), *args))
    )
    return placed.select(
        "l_orderkey", "l_linenumber", ((F.col("l_linenumber") - 1) % 4).alias("quarter"),
        F.round("screen.x", 4).alias("left"), F.round("screen.y", 4).alias("top"),
        F.round("screen.width", 4).alias("width"), F.round("screen.height", 4).alias("height"),
        F.round("back.x", 4).alias("back_x"), F.round("back.y", 4).alias("back_y"),
        F.round("back.width", 4).alias("back_w"), F.round("back.height", 4).alias("back_h"),
    )


@query(
    "crop_boxes",
    "H22 S9",
    f"""WITH {_RECTS_SQL}, v AS (SELECT *, CASE WHEN l_partkey % 5 = 0 OR least(60, bx + bw) <= greatest(0, bx) OR least(50, by_ + bh) <= greatest(0, by_) THEN [0.0, 0.0, 60.0, 50.0]
        ELSE [greatest(0, bx), greatest(0, by_), least(60, bx + bw) - greatest(0, bx), least(50, by_ + bh) - greatest(0, by_)] END AS b FROM r)
    SELECT l_orderkey, l_linenumber, round(b[1], 4) AS vx, round(b[2], 4) AS vy, round(b[3], 4) AS vw, round(b[4], 4) AS vh,
      round(greatest(1, b[3] - 3 - ah), 4) AS frame_w, 3 + ah < b[3] - 1 AND 2 + 4 < b[4] - 1 AS fits,
      CASE WHEN b[3] - 3 - ah >= 1 THEN round(ah, 2) ELSE round(greatest(0, floor((b[3] - 3 - 1) * 100 + 0.5) / 100), 2) END AS right_margin,
      round(greatest(0, least(ax, 60)), 4) AS cx, round(greatest(1, least(aw, 60 - greatest(0, least(ax, 60)))), 4) AS cw FROM v""",
)
def crop_boxes(spark, folder):
    media = g.rect(F.lit(0), F.lit(0), F.lit(60), F.lit(50))
    crop = F.when(F.col("l_partkey") % 5 != 0, F.col("b"))
    margins = (F.lit(3.0), F.lit(2.0), F.col("a.height"), F.lit(4.0))
    seen = rects(spark, folder).withColumn("v", g.visible_box(media, crop))
    seen = seen.withColumn("frame", g.framed(F.col("v"), *margins)).withColumn("held", g.clamped_crop(media, F.col("a")))
    return seen.select(
        "l_orderkey", "l_linenumber",
        *[F.round(f"v.{n}", 4).alias("v" + n[0]) for n in ("x", "y", "width", "height")],
        F.round("frame.width", 4).alias("frame_w"),
        g.margins_fit(F.col("v"), *margins).alias("fits"),
        F.round(g.margins_of(F.col("frame"), F.col("v"))["right"], 2).alias("right_margin"),
        F.round("held.x", 4).alias("cx"), F.round("held.width", 4).alias("cw"),
    )


@query(
    "placements",
    "H35",
    """WITH p AS (SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, l_quantity AS w, (1.0 + l_linenumber)::DOUBLE AS h, (l_partkey % 360)::DOUBLE AS deg, l_partkey % 2 = 1 AS fx,
        (l_suppkey % 50)::DOUBLE AS x, (l_partkey % 70)::DOUBLE AS y FROM lineitem),
    m AS (SELECT *, CASE WHEN fx THEN -w ELSE w END * cos(radians(deg)) AS a, CASE WHEN fx THEN -w ELSE w END * sin(radians(deg)) AS b, -h * sin(radians(deg)) AS c, h * cos(radians(deg)) AS d,
        CASE WHEN fx THEN w / 2 ELSE -w / 2 END * cos(radians(deg)) + h / 2 * sin(radians(deg)) + x + w / 2 AS e FROM p)
    SELECT l_orderkey, l_linenumber, round(a, 5) + 0.0 AS a, round(b, 5) + 0.0 AS b, round(c, 5) + 0.0 AS c, round(d, 5) + 0.0 AS d, round(e, 5) + 0.0 AS e,
      round(w, 5) AS width, round(h, 5) AS height, deg AS rotation, fx AS flip_x FROM m""",
)
def placements(spark, folder):
    box = g.rect(F.col("l_suppkey") % 50, F.col("l_partkey") % 70, F.col("l_quantity"), F.lit(1.0) + F.col("l_linenumber"))
    degrees, flip = (F.col("l_partkey") % 360).cast("double"), F.col("l_partkey") % 2 == 1
    made = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", g.placement_matrix(box, degrees, flip, F.lit(False)).alias("m")
    )
    read = made.withColumn("back", g.placement_box(*[F.col(f"m.{n}") for n in "abcdef"]))
    return read.select(
        "l_orderkey", "l_linenumber",
        *[(F.round(f"m.{n}", 5) + 0.0).alias(n) for n in "abcde"],
        F.round("back.width", 5).alias("width"), F.round("back.height", 5).alias("height"),
        (F.col("back.rotation") % 360).alias("rotation"), F.col("back.flip_x").alias("flip_x"),
    )


# Vectors as drawings: consecutive numbers are the points of a path, in points.
_POINTS_SQL = """v AS (SELECT vec_id, label, list_transform(range(len(embedding) // 2), lambda i: embedding[2 * i + 1]::DOUBLE * 1000) AS xs,
   list_transform(range(len(embedding) // 2), lambda i: embedding[2 * i + 2]::DOUBLE * 1000) AS ys FROM embeddings)"""


def drawings(spark, folder):
    e = F.col("embedding")
    points = F.transform(
        F.sequence(F.lit(0), F.floor(F.size(e) / 2).cast("int") - 1),
        lambda i: F.struct(
            (F.element_at(e, 2 * i + 1).cast("double") * 1000).alias("x"),
            (F.element_at(e, 2 * i + 2).cast("double") * 1000).alias("y"),
        ),
    )
    return table(spark, folder, "embeddings").select("vec_id", "label", points.alias("points"))


@query(
    "measurements",
    "Q20 W17 H18",
    f"""WITH {_POINTS_SQL}, m AS (SELECT *, ['mm','cm','m','in','ft','yd','pt','mi','km'][vec_id % 9 + 1] AS unit,
      list_sum(list_transform(range(1, len(xs)), lambda i: sqrt(pow(xs[i + 1] - xs[i], 2) + pow(ys[i + 1] - ys[i], 2)))) AS len,
      abs(list_sum(list_transform(range(1, len(xs) + 1), lambda i: xs[i] * ys[i % len(xs) + 1] - xs[i % len(xs) + 1] * ys[i]))) / 2 AS ar FROM v),
    f AS (SELECT *, 1 / CASE unit WHEN 'pt' THEN 1.0 WHEN 'in' THEN 72 WHEN 'ft' THEN 864 WHEN 'yd' THEN 2592 WHEN 'mi' THEN 4561920 WHEN 'mm' THEN 72 / 25.4::DOUBLE
       WHEN 'cm' THEN 72 / 2.54::DOUBLE WHEN 'm' THEN 7200 / 2.54::DOUBLE ELSE 7200000 / 2.54::DOUBLE END AS factor FROM m),
    k AS (SELECT *, CASE WHEN label % 2 = 0 THEN len * factor ELSE ar * factor * factor END AS val FROM f)
    SELECT vec_id, unit, round(len, 4) AS length, round(ar, 2) AS area, round(val, 6) AS value,
      regexp_replace(regexp_replace(printf('%.6f', CASE WHEN val >= 100 THEN round(val, 1) WHEN val >= 1 THEN round(val, 2) ELSE round(val, 3) END), '0+$', ''), '\\.$', '')
        || CASE WHEN label % 2 = 0 THEN ' ' ELSE ' sq ' END || unit AS shown FROM k""",
)
def measurements(spark, folder):
    units = F.array(*[F.lit(u) for u in ("mm", "cm", "m", "in", "ft", "yd", "pt", "mi", "km")])
    m = drawings(spark, folder).select(
        "vec_id",
        (F.col("label") % 2 == 1).alias("is_area"),
        F.element_at(units, (F.col("vec_id") % 9 + 1).cast("int")).alias("unit"),
        g.path_length(F.col("points")).alias("length"),
        g.polygon_area(F.col("points")).alias("area"),
    )
    factor = 1 / g.points_per(F.col("unit"))
    m = m.withColumn(
        "value", F.when(F.col("is_area"), F.col("area") * factor * factor).otherwise(F.col("length") * factor)
    )
    return m.select(
        "vec_id", "unit", F.round("length", 4).alias("length"), F.round("area", 2).alias("area"),
        F.round("value", 6).alias("value"),
        g.measured_text(F.col("value"), F.col("is_area"), F.col("unit")).alias("shown"),
    )


_KINDS = ["highlight", "note", "freeText", "square", "line", "polygon", "ink", "arrow", "callout"]


@query(
    "annotation_bounds",
    "H20 H21 A11 H28",
    f"""WITH {_POINTS_SQL}, k AS (SELECT *, {_KINDS!r}[vec_id % 9 + 1] AS kind, (vec_id % 4)::DOUBLE AS border FROM v),
    p AS (SELECT *, greatest(1, border) + 1 AS w FROM k),
    d AS (SELECT *, CASE WHEN kind = 'highlight' THEN 1 WHEN kind = 'freeText' THEN 0 WHEN kind = 'square' THEN w / 2 WHEN kind IN ('line', 'arrow') THEN w * 3 ELSE w END AS pad FROM p)
    SELECT vec_id, kind, round(CASE WHEN kind = 'note' THEN xs[1] ELSE list_min(xs) - pad END, 4) AS x, round(CASE WHEN kind = 'note' THEN ys[1] - 20 ELSE list_min(ys) - pad END, 4) AS y,
      round(CASE WHEN kind = 'note' THEN 20 ELSE list_max(xs) - list_min(xs) + pad * 2 END, 4) AS width, round(CASE WHEN kind = 'note' THEN 20 ELSE list_max(ys) - list_min(ys) + pad * 2 END, 4) AS height,
      kind NOT IN ('highlight', 'note', 'polygon', 'ink') AS resizable, round(list_min(xs) + 12, 4) AS moved_x, round(greatest(0, least(1, xs[3] / 100)), 5) AS blue FROM d""",
)
def annotation_bounds(spark, folder):
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    d = drawings(spark, folder).select(
        "vec_id", "points", F.element_at(kinds, (F.col("vec_id") % 9 + 1).cast("int")).alias("kind"),
        (F.col("vec_id") % 4).cast("double").alias("border"),
    )
    d = d.withColumn("box", g.annotation_bounds(F.col("kind"), F.col("points"), F.col("border"))).withColumn(
        "moved", g.bounds(g.translated(F.col("points"), F.lit(12.0), F.lit(-3.0)))
    )
    colour = g.unit_colour(F.transform(F.slice("points", 1, 3), lambda p: p["x"] / 100))
    return d.select(
        "vec_id", "kind", *[F.round(f"box.{n}", 4).alias(n) for n in ("x", "y", "width", "height")],
        g.resizable(F.col("kind")).alias("resizable"), F.round("moved.x", 4).alias("moved_x"),
        F.round(colour["b"], 5).alias("blue"),
    )


@query(
    "page_size_histogram",
    "A1 Q12 A24 T7",
    """WITH p AS (SELECT l_suppkey AS doc_id, l_partkey * 10 + l_linenumber AS page, 595.0 + l_quantity AS w, 842.0 - l_linenumber * 0.26 AS h, (l_linenumber % 4) * 90 AS r FROM lineitem),
    s AS (SELECT doc_id, page, greatest(0.1, floor(CASE WHEN r % 180 = 90 THEN h ELSE w END * 10 + 0.5) / 10) AS width, greatest(0.1, floor(CASE WHEN r % 180 = 90 THEN w ELSE h END * 10 + 0.5) / 10) AS height FROM p),
    c AS (SELECT doc_id, width, height, count(*) AS pages, min(page) AS first_page FROM s GROUP BY ALL),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pages DESC, first_page, width, height) AS rank FROM c),
    o AS (SELECT doc_id, count(*) FILTER (WHERE width > height) > count(*) FILTER (WHERE width <= height) AS landscape FROM s GROUP BY 1)
    SELECT doc_id, width, height, pages, first_page, rank, landscape FROM n JOIN o USING (doc_id)""",
)
def page_size_histogram(spark, folder):
    from quire.operators.audit import page_sizes, mostly_landscape

    line = F.col("l_linenumber")
    pages = table(spark, folder, "lineitem").select(
        F.col("l_suppkey").alias("doc_id"),
        (F.col("l_partkey") * 10 + line).alias("page"),
        g.displayed_size(F.col("l_quantity") + 595.0, F.lit(842.0) - line * 0.26, line % 4 * 90).alias("size"),
    ).select("doc_id", "page", "size.*")
    return page_sizes(pages).join(mostly_landscape(pages), "doc_id")


@query(
    "pixel_classes",
    "H27",
    """WITH p AS (SELECT vec_id, i, list_transform([embedding[i * 3 + 1], embedding[i * 3 + 2], embedding[i * 3 + 3]], lambda v: floor((v::DOUBLE + 0.5) * 255)) AS a,
        list_transform([embedding[i * 3 + 2], embedding[i * 3 + 3], embedding[i * 3 + 4]], lambda v: floor((v::DOUBLE + 0.5) * 255)) AS b
      FROM (SELECT vec_id, embedding, unnest(range((len(embedding) - 1) // 3)) AS i FROM embeddings)),
    d AS (SELECT *, abs(a[1] - b[1]) + abs(a[2] - b[2]) + abs(a[3] - b[3]) AS dist, a[1] * .299 + a[2] * .587 + a[3] * .114 AS la, b[1] * .299 + b[2] * .587 + b[3] * .114 AS lb FROM p)
    SELECT vec_id, CASE WHEN dist <= 96 THEN 'same' WHEN lb > la + 40 THEN 'removed' WHEN la > lb + 40 THEN 'added' ELSE 'recoloured' END AS class, count(*) AS n FROM d GROUP BY ALL""",
)
def pixel_classes(spark, folder):
    e = F.col("embedding")

    def level(i):
        return F.floor((F.element_at(e, i).cast("double") + 0.5) * 255)

    pairs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(e) - 1) / 3).cast("int") - 1),
        lambda i: F.struct(*[level(i * 3 + k).alias(f"c{k}") for k in (1, 2, 3, 4)]),
    )
    p = table(spark, folder, "embeddings").select("vec_id", F.explode(pairs).alias("p")).select("vec_id", "p.*")
    before, after = [F.col(f"c{k}") for k in (1, 2, 3)], [F.col(f"c{k}") for k in (2, 3, 4)]
    distance = sum((F.abs(x - y) for x, y in zip(before, after)), F.lit(0))
    return p.groupBy(
        "vec_id", g.pixel_class(distance, g.luminance(*before), g.luminance(*after)).alias("class")
    ).agg(F.count("*").alias("n"))


@query(
    "paper_boxes",
    "H25",
    """WITH s AS (SELECT p_partkey, p_size, ['a3','a4','a5','letter','legal','tabloid'][p_partkey % 6 + 1] AS paper, [841.89, 595.28, 419.53, 612, 612, 792][p_partkey % 6 + 1]::DOUBLE AS w0,
        [1190.55, 841.89, 595.28, 792, 1008, 1224][p_partkey % 6 + 1]::DOUBLE AS h0, p_size % 2 = 1 AS land, p_retailprice / 3 AS margin FROM part),
    o AS (SELECT *, CASE WHEN land THEN h0 ELSE w0 END AS w, CASE WHEN land THEN w0 ELSE h0 END AS h FROM s),
    m AS (SELECT *, greatest(0, least(margin, w / 2 - 24, h / 2 - 24)) AS safe FROM o)
    SELECT p_partkey, paper, round(w, 4) AS width, round(h, 4) AS height, round(safe, 4) AS x, round(greatest(24, w - safe * 2), 4) AS box_width, round(greatest(24, h - safe * 2), 4) AS box_height FROM m""",
)
def paper_boxes(spark, folder):
    from quire.sources.paginate import PAPER

    names = ["a3", "a4", "a5", "letter", "legal", "tabloid"]
    at = (F.col("p_partkey") % 6 + 1).cast("int")
    sizes = F.element_at(F.array(*[F.struct(F.lit(PAPER[n][0]).alias("w"), F.lit(PAPER[n][1]).alias("h")) for n in names]), at)
    land = F.col("p_size") % 2 == 1
    p = table(spark, folder, "part").select(
        "p_partkey", F.element_at(F.array(*[F.lit(n) for n in names]), at).alias("paper"),
        F.when(land, sizes["h"]).otherwise(sizes["w"]).alias("w"), F.when(land, sizes["w"]).otherwise(sizes["h"]).alias("h"),
        (F.col("p_retailprice") / 3).alias("margin"),
    )
    p = p.withColumn("safe", F.greatest(F.lit(0.0), F.least(F.col("margin"), F.col("w") / 2 - 24, F.col("h") / 2 - 24)))
    return p.select(
        "p_partkey", "paper", F.round("w", 4).alias("width"), F.round("h", 4).alias("height"), F.round("safe", 4).alias("x"),
        F.round(F.greatest(F.lit(24.0), F.col("w") - F.col("safe") * 2), 4).alias("box_width"),
        F.round(F.greatest(F.lit(24.0), F.col("h") - F.col("safe") * 2), 4).alias("box_height"),
    )
