"""Near copies among the documents as originals and revisions; vectors as pictures."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5
from heapq import nsmallest

import pyarrow as pa
from pyspark.sql import functions as F

from quire.operators import compare as ops
from quire.plans import shared_sql as q
from quire.plans.geometry import _RECTS_SQL, rects
from quire.plans.registry import query
from quire.plans.search import pages_of
from quire.session import cut_lineage, spread, table
from quire.sources.paginate import page_counts, paginate


def least_runs(batches: Iterator[pa.RecordBatch], words: int = 5, most: int = 8) -> Iterator[pa.RecordBatch]:
    """The least MD5 hashes of a text's distinct runs of words, a row for each."""
    for batch in batches:
        ids, counts, keys = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
            cut = text.split(" ")
            # Runs as the words after each other; a text of fewer words is one run.
            runs = {" ".join(run) for run in zip(*[cut[n:] for n in range(words)])} if len(cut) >= words else {text}
            found = nsmallest(most, {md5(run.encode(), usedforsecurity=False).digest() for run in runs})
            ids += [doc_id] * len(found)
            counts += [len(found)] * len(found)
            keys += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(counts, pa.int32()), pa.array(keys, pa.binary())], names=["doc_id", "n", "key"])


def revision_pairs(spark, folder):
    """Near copies as originals and revisions, by what they share over their whole texts.

    A document's keys are the eight least hashes of its runs of five words (a sample of
    all of them, wherever they stand).  Each key votes for the least document that has
    it; a document is a revision of the one that at least half of its keys vote for, the
    most first.  A star, never all pairs.
    """
    documents = spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id").where("text is not null")
    keyed = cut_lineage(documents.mapInArrow(least_runs, "doc_id long, n int, key binary"))
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("original"), F.count("*").alias("holders")).where("holders > 1")
    votes = keyed.join(first, "key").where("doc_id > original").groupBy("doc_id", "n", "original").agg(F.count("*").alias("votes"))
    chosen = votes.where("2 * votes >= n").groupBy("doc_id").agg(F.max_by("original", F.struct("votes", -F.col("original"))).alias("original"))
    return chosen.select(
        F.col("doc_id").alias("pair_id"), "original", F.col("doc_id").alias("revised"),
        (F.col("doc_id") % 3 - 1).cast("int").alias("offset"),
    )


_PAIRS_SQL = """words AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) AS i FROM documents WHERE text IS NOT NULL),
five AS (SELECT doc_id, i, concat_ws(' ', w, lead(w, 1) OVER d, lead(w, 2) OVER d, lead(w, 3) OVER d, lead(w, 4) OVER d) AS run, count(*) OVER (PARTITION BY doc_id) AS n FROM words WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
keys AS (SELECT doc_id, list_slice(list_sort(list_distinct(list(md5(run)))), 1, 8) AS ks FROM five WHERE i <= greatest(n - 4, 1) GROUP BY 1),
keyed AS (SELECT doc_id, len(ks) AS n, unnest(ks) AS key FROM keys),
vote AS (SELECT k.doc_id, k.n, f.original, count(*) AS votes FROM keyed k JOIN (SELECT key, min(doc_id) AS original FROM keyed GROUP BY 1) f USING (key) WHERE k.doc_id > f.original GROUP BY ALL),
pair AS (SELECT doc_id AS pair_id, original, doc_id AS revised, (doc_id % 3 - 1)::INT AS off FROM vote WHERE 2 * votes >= n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, original) = 1),
spine AS (SELECT pair_id, original, revised, off, n, m, unnest(range(least(1, 1 - off), greatest(n, m - off) + 1)) AS pos
   FROM (SELECT p.*, a.page_count AS n, b.page_count AS m FROM pair p JOIN page_dim a ON a.doc_id = p.original JOIN page_dim b ON b.doc_id = p.revised)),
pp AS (SELECT pair_id, pos - least(1, 1 - off) + 1 AS "index", original, CASE WHEN pos BETWEEN 1 AND n THEN pos END AS original_page, revised, CASE WHEN pos + off BETWEEN 1 AND m THEN pos + off END AS revised_page FROM spine)"""


@query("page_pairs", "J1", f"WITH {q.LINES}, {_PAIRS_SQL} SELECT * FROM pp")
def page_pairs(spark, folder):
    pairs = cut_lineage(revision_pairs(spark, folder))
    return ops.page_pairs(pairs, cut_lineage(page_counts(paired_documents(spark, folder, pairs))))


@query(
    "page_words",
    "H4",
    f"""WITH {q.ITEMS},
    piece AS (SELECT *, unnest(ps) AS p, generate_subscripts(ps, 1) AS k, list_transform(ps, lambda s: length(s)) AS ns FROM (SELECT *, regexp_extract_all(str, '{q.BLANK}*{q.SOLID}+') AS ps FROM text_items)),
    w AS (SELECT *, regexp_replace(p, '^{q.BLANK}+', '') AS word FROM piece)
    SELECT doc_id, page, word, round(x + (list_sum(list_slice(ns, 1, k)) - length(word)) * 6.6, 3) AS x, round(y - 2.2, 3) AS y, round(length(word) * 6.6::DOUBLE, 3) AS width, height FROM w""",
)
def page_words(spark, folder):
    words = pages_of(spark, folder).select("doc_id", "page", F.inline(ops.page_words(F.col("items"))))
    return words.select(
        "doc_id", "page", F.col("text").alias("word"), F.round("x", 3).alias("x"), F.round("y", 3).alias("y"),
        F.round("width", 3).alias("width"), "height",
    )


def page_sizes(pages):
    """Documents come on three paper sizes, by id."""
    return pages.select(
        "doc_id", "page", (F.lit(595.28) + F.col("doc_id") % 3).alias("width"),
        (F.lit(841.89) - F.col("doc_id") % 2 * 0.5).alias("height"),
    )


@query(
    "page_size_differences",
    "Q8 U9",
    f"""WITH {q.LINES}, {_PAIRS_SQL}, s AS (SELECT *, 595.28 + original % 3 AS wa, 841.89 - original % 2 * 0.5 AS ha, 595.28 + revised % 3 AS wb, 841.89 - revised % 2 * 0.5 AS hb FROM pp WHERE original_page IS NOT NULL AND revised_page IS NOT NULL)
    SELECT pair_id, "index", 'pageSize' AS kind, 'Page size changed: ' || floor(wa + 0.5)::INT || ' × ' || floor(ha + 0.5)::INT || ' → ' || floor(wb + 0.5)::INT || ' × ' || floor(hb + 0.5)::INT || ' pt' AS summary
    FROM s WHERE abs(wa - wb) >= 1 OR abs(ha - hb) >= 1""",
)
def page_size_differences(spark, folder):
    pages = pages_of(spark, folder)
    spine = ops.page_pairs(revision_pairs(spark, folder), pages.where("page = 1").select("doc_id", "page_count"))
    both = spine.where("original_page is not null and revised_page is not null")
    return ops.size_differences(both, page_sizes(pages)).select("pair_id", "index", "kind", "summary")


def paired_documents(spark, folder, pairs):
    """Only documents with a counterpart are laid out."""
    ids = pairs.select(F.col("original").alias("doc_id")).unionByName(pairs.select(F.col("revised").alias("doc_id")))
    documents = table(spark, folder, "documents").select("doc_id", "text").join(ids.distinct(), "doc_id", "left_semi")
    return spread(documents, "doc_id")


def differences(spark, folder):
    pairs = cut_lineage(revision_pairs(spark, folder)).withColumn("offset", F.lit(0))
    # Once: pairing, sizes and both sides' words all read the same pages.
    pages = cut_lineage(paginate(paired_documents(spark, folder, pairs)))
    return ops.compare_documents(pairs, pages, page_sizes(pages))


@query("compare_documents", "Q8 J1 H4 L7 W19 L3 H6 U9 T8")
def compare_documents(spark, folder):
    found = differences(spark, folder)
    return found.select(
        "pair_id", "index", "class", "place", "kind", "summary",
        F.size("original_rects").alias("original_rects"), F.size("revised_rects").alias("revised_rects"),
    )


@query("difference_summary", "A29 F2")
def difference_summary(spark, folder):
    shown = ops.visible(differences(spark, folder), "text")
    per_page = shown.groupBy("pair_id", "index").agg(F.count("*").alias("n"))
    return per_page.groupBy("pair_id").agg(F.sum("n").alias("shown"), F.count("*").alias("pages"))


def pictures(spark, folder, side):
    """Vectors stacked 64 to a picture: even ones the original's rows, odd ones the revision's."""
    e = table(spark, folder, "embeddings").where(F.col("vec_id") % 2 == side)
    row = F.floor(F.col("vec_id") / 2)
    flat = e.select(
        F.floor(row / 64).alias("pair_id"), (row % 64).alias("y"), F.posexplode("embedding").alias("x", "v")
    )
    level = F.floor((F.col("v").cast("double") + 0.5) * 255)
    return flat.select("pair_id", "x", "y", level.alias("r"), (255 - level).alias("g"), level.alias("b"))


_PIX = """pix AS (SELECT vec_id % 2 AS side, vec_id // 2 // 64 AS pair_id, vec_id // 2 % 64 AS y, i - 1 AS x, floor((v::DOUBLE + 0.5) * 255) AS l FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
j AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.x, b.x) AS x, coalesce(a.y, b.y) AS y,
   CASE WHEN a.l IS NULL OR b.l IS NULL THEN 2 * abs(255 - coalesce(a.l, b.l)) + abs(coalesce(a.l, b.l)) ELSE 3 * abs(a.l - b.l) END AS d
   FROM (SELECT * FROM pix WHERE side = 0) a FULL JOIN (SELECT * FROM pix WHERE side = 1) b ON a.pair_id = b.pair_id AND a.x = b.x AND a.y = b.y),
cell AS (SELECT pair_id, x // 8 AS cx, y // 8 AS cy, count(*) FILTER (WHERE d > 96) AS changed, count(*) AS pixels FROM j GROUP BY ALL)"""


@query("pixel_cells", "A20 H27", f"WITH {_PIX} SELECT * FROM cell")
def pixel_cells(spark, folder):
    return ops.pixel_cells(pictures(spark, folder, 0), pictures(spark, folder, 1))


@query(
    "pixel_regions",
    "Q9 G10",
    f"""WITH RECURSIVE {_PIX}, f AS (SELECT pair_id, cx, cy FROM cell WHERE changed >= 40),
    reach AS (SELECT pair_id, cx AS sx, cy AS sy, cx, cy FROM f UNION SELECT r.pair_id, r.sx, r.sy, f.cx, f.cy FROM reach r JOIN f ON f.pair_id = r.pair_id AND abs(f.cx - r.cx) <= 2 AND abs(f.cy - r.cy) <= 2),
    comp AS (SELECT pair_id, sx, sy, min(cy * 100000 + cx) AS id FROM reach GROUP BY ALL),
    box AS (SELECT pair_id, id, min(sx) AS l, min(sy) AS t, max(sx) AS r, max(sy) AS b FROM comp GROUP BY ALL),
    dim AS (SELECT pair_id, max(x) + 1 AS w, max(y) + 1 AS h FROM j GROUP BY 1)
    SELECT pair_id, row_number() OVER (PARTITION BY pair_id ORDER BY id) - 1 AS region, l * 8 AS "left", t * 8 AS top, least(w, (r + 1) * 8) - l * 8 AS width, least(h, (b + 1) * 8) - t * 8 AS height FROM box JOIN dim USING (pair_id)""",
)
def pixel_regions(spark, folder):
    a, b = pictures(spark, folder, 0), pictures(spark, folder, 1)
    sizes = a.unionByName(b).groupBy("pair_id").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    cells = ops.pixel_cells(a, b)
    # Vectors differ nearly everywhere, so only the busiest cells count as changed here.
    busy = cells.withColumn("changed", F.when(F.col("changed") >= 40, F.col("changed")).otherwise(0))
    return ops.pixel_regions(busy, sizes)


@query(
    "unexplained_regions",
    "J8 Q9 U9",
    f"""WITH {_RECTS_SQL}, rg AS (SELECT l_orderkey AS pair_id, l_linenumber AS i, l_partkey * 1000 + l_suppkey % 1000 AS region, ax AS x, ay AS y, aw AS w, ah AS h FROM r),
    ex AS (SELECT l_orderkey AS pair_id, l_linenumber AS i, bx AS x, by_ AS y, bw AS w, bh AS h FROM r WHERE l_suppkey > 20)
    SELECT pair_id, i AS "index", region FROM rg WHERE NOT EXISTS (SELECT 1 FROM rg o JOIN ex e ON e.pair_id = o.pair_id AND e.i = o.i AND o.x < e.x + e.w AND e.x < o.x + o.w AND o.y < e.y + e.h AND e.y < o.y + o.h
      WHERE o.pair_id = rg.pair_id AND o.i = rg.i AND o.region = rg.region)""",
)
def unexplained_regions(spark, folder):
    r = rects(spark, folder).withColumn("side", F.lit("original"))
    keys = [F.col("l_orderkey").alias("pair_id"), F.col("l_linenumber").alias("index")]
    region = (F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("region")
    regions = r.select(*keys, region, "side", "a.*")
    explained = r.where("l_suppkey > 20").select(*keys, "side", "b.*")
    return ops.unexplained(regions, explained).select("pair_id", "index", "region")
