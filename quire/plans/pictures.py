"""Parts as stored pictures, order lines as the places they are drawn."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import pictures as ops
from quire.plans.registry import query
from quire.session import table


def stored(spark, folder):
    k, size = F.col("p_partkey"), F.col("p_size")
    facts = {
        "image_mask": F.col("p_brand") == "Brand#1", "colour_key": F.col("p_brand") == "Brand#2", "decode": F.col("p_brand") == "Brand#3",
        "bits": F.when(F.col("p_brand") == "Brand#4", 1).otherwise(8), "width": size * 40, "height": F.floor("p_retailprice"),
        "channels": F.when(k % 11 == 0, None).when(k % 3 == 0, 1).otherwise(3),
        "filter": F.when(F.col("p_type") == "ECONOMY", "DCTDecode").when(F.col("p_type") == "SMALL", "").when(F.col("p_type") == "PROMO", "JPXDecode").otherwise("FlateDecode"),
        "predictor": k % 4 == 0,
    }
    return table(spark, folder, "part").select(
        (k % 20).alias("doc_id"), k.alias("ref"), ops.picture_kind(facts).alias("kind"), facts["channels"].alias("channels"),
        facts["width"].alias("width"), facts["height"].alias("height"), (size * 1000).cast("bigint").alias("stored_bytes"),
        (F.floor("p_retailprice") * 20).alias("new_bytes"), (k % 2 == 0).alias("photographic"),
    )


def placements(spark, folder):
    """Every order line draws the picture of twice its part's number, so pictures of odd numbers are never drawn."""
    p = F.col("l_partkey") * 2
    return table(spark, folder, "lineitem").select(
        (p % 20).alias("doc_id"), p.alias("ref"), (F.col("l_quantity") * 4).alias("a"), F.col("l_linenumber").cast("double").alias("b"),
        (F.col("l_tax") * 100).alias("c"), (F.col("l_quantity") * 3).alias("d"),
    )


_PICS = """pc AS (SELECT p_partkey % 20 AS doc_id, p_partkey AS ref, p_size * 40 AS width, floor(p_retailprice) AS height, p_size * 1000::BIGINT AS stored_bytes, floor(p_retailprice)::BIGINT * 20 AS new_bytes, p_partkey % 2 = 0 AS photo,
  CASE WHEN p_partkey % 3 = 0 THEN 1 ELSE 3 END AS channels,
  CASE WHEN p_brand IN ('Brand#1','Brand#2','Brand#3','Brand#4') OR p_size <= 0 OR p_partkey % 11 = 0 THEN 'untouchable' WHEN p_type = 'ECONOMY' THEN 'jpeg' WHEN p_type = 'SMALL' THEN 'lossless' WHEN p_type = 'PROMO' OR p_partkey % 4 = 0 THEN 'untouchable' ELSE 'lossless' END AS kind FROM part),
sz AS (SELECT l_partkey * 2 AS ref, max(sqrt(pow(l_quantity * 4, 2) + pow(l_linenumber, 2))) AS w, max(sqrt(pow(l_tax * 100, 2) + pow(l_quantity * 3, 2))) AS h FROM lineitem GROUP BY 1),
dp AS (SELECT pc.*, CASE WHEN w > 0 AND h > 0 THEN least(width / (w / 72), height / (h / 72)) END AS dpi FROM pc LEFT JOIN sz USING (ref)),
de AS (SELECT *, kind <> 'untouchable' AND coalesce(dpi > 225, false) AS rs, kind = 'jpeg' AS j, kind = 'lossless' AS lo FROM dp),
tr AS (SELECT *, kind <> 'untouchable' AND NOT (lo AND NOT photo AND NOT rs) AS tried FROM de),
oc AS (SELECT *, tried AND new_bytes >= stored_bytes AS kept, tried AND new_bytes < stored_bytes AS done FROM tr)"""


@query(
    "picture_decisions",
    "F18 F19 H24 A4 Q13 J16",
    f"""WITH {_PICS} SELECT doc_id, ref, kind, round(dpi, 4) AS dpi, done AND rs AS resampled, done AND NOT rs AND j AS recompressed, done AND lo AND photo AS converted, false AS greyed, kept FROM oc""",
)
def picture_decisions(spark, folder):
    made = ops.decisions(stored(spark, folder), placements(spark, folder), ops.PRESETS["balanced"])
    return made.select("doc_id", "ref", "kind", F.round("dpi", 4).alias("dpi"), "resampled", "recompressed", "converted", "greyed", "kept")


@query(
    "optimize_analysis",
    "A3 A5 Q13",
    f"""WITH {_PICS} SELECT doc_id, count(*) AS total, sum(stored_bytes)::BIGINT AS bytes, count(*) FILTER (WHERE kind = 'jpeg') AS jpeg, count(*) FILTER (WHERE kind = 'lossless') AS lossless, count(*) FILTER (WHERE kind = 'untouchable') AS untouchable,
      floor(max(dpi) FILTER (WHERE kind <> 'untouchable') + 0.5)::BIGINT AS highest_dpi, count(*) FILTER (WHERE done AND rs) AS resampled, count(*) FILTER (WHERE done AND NOT rs AND j) AS recompressed, count(*) FILTER (WHERE done AND lo AND photo) AS converted, 0::BIGINT AS greyed, count(*) FILTER (WHERE kept) AS kept FROM oc GROUP BY 1""",
)
def optimize_analysis(spark, folder):
    return ops.analysis(ops.decisions(stored(spark, folder), placements(spark, folder), ops.PRESETS["balanced"]))


@query(
    "undrawn_pictures",
    "J16 J17",
    """SELECT p_partkey % 20 AS doc_id, p_partkey AS ref FROM part WHERE p_partkey NOT IN (SELECT l_partkey * 2 FROM lineitem)""",
)
def undrawn_pictures(spark, folder):
    return ops.unmeasured(stored(spark, folder), placements(spark, folder))


@query(
    "photographic_pictures",
    "A21",
    """WITH px AS (SELECT label AS picture, vec_id * 1000 + i AS idx, floor((v::DOUBLE + 0.5) * 255)::BIGINT AS r, floor((v::DOUBLE + 0.5) * 97)::BIGINT AS g, i % 200 AS b FROM (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)),
    c AS (SELECT *, count(*) OVER (PARTITION BY picture) AS n FROM px), s AS (SELECT * FROM c WHERE idx % greatest(1, n // 8192) = 0)
    SELECT picture::BIGINT AS picture, count(DISTINCT (r, g, b)) AS colours, CASE WHEN bool_and(r = g AND g = b) THEN count(DISTINCT (r, g, b)) > 160 ELSE count(DISTINCT (r, g, b)) > 512 END AND any_value(n) >= 4096 AS photographic FROM s GROUP BY 1""",
)
def photographic_pictures(spark, folder):
    level = F.col("v").cast("double") + 0.5
    px = table(spark, folder, "embeddings").select("label", "vec_id", F.posexplode("embedding").alias("i", "v")).select(
        F.col("label").alias("picture"), (F.col("vec_id") * 1000 + F.col("i")).alias("idx"), F.floor(level * 255).alias("r"),
        F.floor(level * 97).alias("g"), (F.col("i") % 200).cast("bigint").alias("b"),
    )
    counts = px.groupBy("picture").agg(F.count("*").alias("count"))
    return ops.photographic(px.join(counts, "picture"))
