"""Pictures and where they are drawn: what they are, how sharp, what to do with them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions.numbers import half_up

RESAMPLE_OVER = 1.5
SAMPLES, COLOURS, GREYS, PHOTO_PIXELS = 8192, 512, 160, 4096


@dataclass(frozen=True)
class Preset:
    target_dpi: int
    recompress_jpeg: bool
    convert_photos: bool
    grayscale: bool = False
    downsample: bool = True


# The presets.
PRESETS = {
    "quality": Preset(300, False, False),
    "balanced": Preset(150, True, True),
    "small": Preset(96, True, True),
}


def picture_kind(p: dict[str, Column]) -> Column:
    """jpeg, lossless or untouchable, from a picture's own facts."""
    off_limits = (
        p["image_mask"] | p["colour_key"] | p["decode"] | (p["bits"] != 8)
        | (p["width"] <= 0) | (p["height"] <= 0)
        | p["channels"].isNull()
    )
    plain = (p["filter"] == "") | ((p["filter"] == "FlateDecode") & ~p["predictor"])
    return (
        F.when(off_limits, "untouchable").when(p["filter"] == "DCTDecode", "jpeg")
        .when(plain, "lossless").otherwise("untouchable")
    )


def drawn_sizes(placements: DataFrame) -> DataFrame:
    """Largest drawn width and height of each picture, each on its own: ``doc_id, ref, w, h``."""
    return placements.groupBy("doc_id", "ref").agg(
        F.max(F.hypot("a", "b")).alias("drawn_width"), F.max(F.hypot("c", "d")).alias("drawn_height")
    )


def unmeasured(listings: DataFrame, placements: DataFrame) -> DataFrame:
    """Pictures some page's resources list and no walked page draws."""
    return listings.select("doc_id", "ref").distinct().join(placements.select("doc_id", "ref"), ["doc_id", "ref"], "left_anti")


def decisions(pictures: DataFrame, placements: DataFrame, preset: Preset) -> DataFrame:
    """What an optimisation would do with each picture.

    ``pictures``: doc_id, ref, kind, channels, width, height, stored_bytes, new_bytes,
    photographic -> plus dpi, resample, grey, outcome.  A change that does not make
    the picture smaller is not kept unless grey was asked for.
    """
    sized = pictures.join(drawn_sizes(placements), ["doc_id", "ref"], "left").withColumn(
        "dpi", g.drawn_dpi(F.col("width"), F.col("height"), F.col("drawn_width"), F.col("drawn_height"))
    )
    workable = F.col("kind") != "untouchable"
    over = F.coalesce(F.col("dpi") > preset.target_dpi * RESAMPLE_OVER, F.lit(False))
    resample = workable & over & F.lit(preset.downsample)
    grey = workable & F.lit(preset.grayscale) & (F.col("channels") == 3)
    jpeg = F.col("kind") == "jpeg"
    lossless = F.col("kind") == "lossless"
    wanted = resample | grey | (jpeg & F.lit(preset.recompress_jpeg)) | (lossless & F.lit(preset.convert_photos))
    as_jpeg = jpeg | (F.lit(preset.convert_photos) & F.col("photographic"))
    idle = lossless & ~as_jpeg & ~resample & ~grey
    tried = workable & wanted & ~idle
    larger = tried & ~grey & (F.col("new_bytes") >= F.col("stored_bytes"))
    done = tried & ~larger
    return sized.select(
        "doc_id", "ref", "kind", "stored_bytes", "new_bytes", "dpi",
        (done & resample).alias("resampled"), (done & ~resample & jpeg).alias("recompressed"),
        (done & lossless & as_jpeg).alias("converted"), (done & grey).alias("greyed"), larger.alias("kept"),
    )


def analysis(decided: DataFrame) -> DataFrame:
    """Totals per document: pictures and bytes by kind, sharpest picture, expected outcome."""
    flags = ("resampled", "recompressed", "converted", "greyed", "kept")
    return decided.groupBy("doc_id").agg(
        F.count("*").alias("total"),
        F.sum("stored_bytes").alias("bytes"),
        *[F.count_if(F.col("kind") == k).alias(k) for k in ("jpeg", "lossless", "untouchable")],
        half_up(F.max(F.when(F.col("kind") != "untouchable", F.col("dpi")))).alias("highest_dpi"),
        *[F.count_if(c).alias(c) for c in flags],
    )


def photographic(pixels: DataFrame) -> DataFrame:
    """Pictures with more colours than a drawing has: ``picture, colours, photographic``.

    ``pixels``: picture, idx, r, g, b (grey has r = g = b), count.  Every n-th pixel is
    looked at; distinct colours are counted in two steps, so one huge picture does
    not meet in one task.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("count") / SAMPLES))
    looked = pixels.where(F.col("idx") % step == 0)
    seen = looked.groupBy("picture", "r", "g", "b").agg(F.max("count").alias("count"))
    facts = seen.groupBy("picture").agg(
        F.count("*").alias("colours"), F.max("count").alias("count"),
        F.bool_and((F.col("r") == F.col("g")) & (F.col("g") == F.col("b"))).alias("grey"),
    )
    many = F.when(F.col("grey"), F.col("colours") > GREYS).otherwise(F.col("colours") > COLOURS)
    return facts.select("picture", "colours", (many & (F.col("count") >= PHOTO_PIXELS)).alias("photographic"))
