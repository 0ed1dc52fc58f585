"""Rectangles, page boxes, placements, measures and colours as column arithmetic.

A rectangle is ``struct<x,y,width,height>`` in points from the bottom left.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.numbers import half_up, half_up_to, plain_number, quarter_turns

GLYPH_SHARE = 0.3
INSIDE_SLACK = 0.5
NOTE_SIZE = 20.0


def rect(x: Column, y: Column, width: Column, height: Column) -> Column:
    return F.struct(
        x.cast("double").alias("x"), y.cast("double").alias("y"),
        width.cast("double").alias("width"), height.cast("double").alias("height"),
    )


def right(r: Column) -> Column:
    return r["x"] + r["width"]


def top(r: Column) -> Column:
    return r["y"] + r["height"]


def area(r: Column) -> Column:
    return F.greatest(F.lit(0.0), r["width"]) * F.greatest(F.lit(0.0), r["height"])


def shared_area(a: Column, b: Column) -> Column:
    w = F.least(right(a), right(b)) - F.greatest(a["x"], b["x"])
    h = F.least(top(a), top(b)) - F.greatest(a["y"], b["y"])
    return F.when((w > 0) & (h > 0), w * h).otherwise(0.0)


def touches(a: Column, b: Column) -> Column:
    """Closed: edges count only for a shape without area (a hairline, a point)."""
    meets = (a["x"] <= right(b)) & (b["x"] <= right(a)) & (a["y"] <= top(b)) & (b["y"] <= top(a))
    return meets & ((shared_area(a, b) > 0) | (area(a) == 0) | (area(b) == 0))


def overlaps(a: Column, b: Column) -> Column:
    """Strict: a common edge is not an overlap."""
    return (a["x"] < right(b)) & (b["x"] < right(a)) & (a["y"] < top(b)) & (b["y"] < top(a))


def contains_point(r: Column, x: Column, y: Column) -> Column:
    return (x >= r["x"]) & (x <= right(r)) & (y >= r["y"]) & (y <= top(r))


def contains_rect(outer: Column, inner: Column, slack: float = INSIDE_SLACK) -> Column:
    return (
        (inner["x"] >= outer["x"] - slack)
        & (inner["y"] >= outer["y"] - slack)
        & (right(inner) <= right(outer) + slack)
        & (top(inner) <= top(outer) + slack)
    )


def glyph_covered(box: Column, mark: Column) -> Column:
    """A glyph goes when its middle is under the mark, or enough of it is."""
    middle = contains_point(mark, box["x"] + box["width"] / 2, box["y"] + box["height"] / 2)
    return middle | ((area(box) > 0) & (shared_area(box, mark) / area(box) >= GLYPH_SHARE))


def inflated(r: Column, by: Column | float) -> Column:
    by = F.lit(by) if isinstance(by, (int, float)) else by
    return rect(r["x"] - by, r["y"] - by, r["width"] + by * 2, r["height"] + by * 2)


def union(a: Column, b: Column) -> Column:
    x, y = F.least(a["x"], b["x"]), F.least(a["y"], b["y"])
    return rect(x, y, F.greatest(right(a), right(b)) - x, F.greatest(top(a), top(b)) - y)


def bounds(points: Column, pad: Column | float = 0.0) -> Column:
    """Bounding box of ``array<struct<x,y>>``; no points give an empty box at zero."""
    pad = F.lit(pad) if isinstance(pad, (int, float)) else pad
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    low_x, low_y = F.array_min(xs), F.array_min(ys)
    box = rect(
        low_x - pad, low_y - pad,
        F.array_max(xs) - low_x + pad * 2, F.array_max(ys) - low_y + pad * 2,
    )
    zero = F.lit(0.0)
    return F.when(F.size(points) > 0, box).otherwise(rect(zero, zero, zero, zero))


TEXT_MARKUP = ("highlight", "underline", "strikeOut", "squiggly")
BOXED = ("freeText", "square", "circle", "stamp", "imageStamp")


def annotation_bounds(kind: Column, points: Column, border: Column) -> Column:
    """The box of an annotation from its points (corners, ends, vertices or strokes).

    How far it reaches beyond them depends on the kind: a note hangs below its
    point, shapes leave room for half their stroke, lines for their arrow heads.
    """
    pad = F.greatest(F.lit(1.0), border) + 1
    first = F.element_at(points, 1)
    tight = bounds(points)
    return (
        F.when(kind.isin(*TEXT_MARKUP), bounds(points, 1.0))
        .when(kind == "note", rect(first["x"], first["y"] - NOTE_SIZE, F.lit(NOTE_SIZE), F.lit(NOTE_SIZE)))
        .when(kind == "freeText", tight)
        .when(kind.isin(*BOXED), inflated(tight, pad / 2))
        .when(kind.isin("line", "arrow"), bounds(points, pad * 3))
        .otherwise(bounds(points, pad))
    )


def translated(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.struct((p["x"] + dx).alias("x"), (p["y"] + dy).alias("y")))


def resizable(kind: Column) -> Column:
    """Markup is tied to its words and ink to the hand: both move, neither scales."""
    return kind.isin(*BOXED, "callout", "line", "arrow")


def quads(rects: Column, minimum: float = 0.5) -> Column:
    """Corner lists (upper left, upper right, lower left, lower right) of real rectangles."""
    real = F.filter(rects, lambda r: (r["width"] > minimum) & (r["height"] > minimum))
    return F.transform(
        real, lambda r: F.array(r["x"], top(r), right(r), top(r), r["x"], r["y"], right(r), r["y"])
    )


def visible_box(media: Column, crop: Column) -> Column:
    """The crop box within the media box; one wholly outside is ignored."""
    x, y = F.greatest(media["x"], crop["x"]), F.greatest(media["y"], crop["y"])
    r, t = F.least(right(media), right(crop)), F.least(top(media), top(crop))
    return F.when(crop.isNull() | (r <= x) | (t <= y), media).otherwise(rect(x, y, r - x, t - y))


def framed(box: Column, left: Column, bottom: Column, right_: Column, top_: Column) -> Column:
    """What margins leave of a box; at least a point each way."""
    return rect(
        box["x"] + left, box["y"] + bottom,
        F.greatest(F.lit(1.0), box["width"] - left - right_),
        F.greatest(F.lit(1.0), box["height"] - bottom - top_),
    )


def margins_of(frame: Column, box: Column) -> Column:
    def near(value: Column) -> Column:
        return F.greatest(F.lit(0.0), half_up_to(value, 2))

    return F.struct(
        near(frame["x"] - box["x"]).alias("left"),
        near(frame["y"] - box["y"]).alias("bottom"),
        near(right(box) - right(frame)).alias("right"),
        near(top(box) - top(frame)).alias("top"),
    )


def margins_fit(box: Column, left: Column, bottom: Column, right_: Column, top_: Column) -> Column:
    return (left + right_ < box["width"] - 1) & (bottom + top_ < box["height"] - 1)


def clamped_crop(media: Column, box: Column) -> Column:
    """A requested crop held inside the page."""
    x = F.greatest(media["x"], F.least(box["x"], right(media)))
    y = F.greatest(media["y"], F.least(box["y"], top(media)))
    return rect(
        x, y,
        F.greatest(F.lit(1.0), F.least(box["width"], right(media) - x)),
        F.greatest(F.lit(1.0), F.least(box["height"], top(media) - y)),
    )


def to_screen(r: Column, page: Column, scale: Column, turn: Column, unit: Column) -> Column:
    """A page rectangle on the displayed page: top left origin, turned, scaled."""
    x, y = r["x"] - page["x"], r["y"] - page["y"]
    k = scale * F.when(unit == 0, F.lit(1.0)).otherwise(unit)
    quarter = quarter_turns(turn)

    def box(left, top_, width, height):
        return rect(left * k, top_ * k, width * k, height * k)

    placed = (
        F.when(quarter == 1, box(y, x, r["height"], r["width"]))
        .when(quarter == 2, box(page["width"] - (x + r["width"]), y, r["width"], r["height"]))
        .when(
            quarter == 3,
            box(page["height"] - (y + r["height"]), page["width"] - (x + r["width"]), r["height"], r["width"]),
        )
        .otherwise(box(x, page["height"] - (y + r["height"]), r["width"], r["height"]))
    )
    return F.when((r["width"] > 0) & (r["height"] > 0), placed)


def from_screen(b: Column, page: Column, scale: Column, turn: Column, unit: Column) -> Column:
    """The inverse of :func:`to_screen`."""
    k = scale * F.when(unit == 0, F.lit(1.0)).otherwise(unit)
    quarter = quarter_turns(turn)

    def point(sx: Column, sy: Column) -> tuple[Column, Column]:
        cx, cy = sx / k, sy / k
        x = (
            F.when(quarter == 1, cy).when(quarter == 2, page["width"] - cx)
            .when(quarter == 3, page["width"] - cy).otherwise(cx)
        )
        y = (
            F.when(quarter == 1, cx).when(quarter == 2, cy)
            .when(quarter == 3, page["height"] - cx).otherwise(page["height"] - cy)
        )
        return x + page["x"], y + page["y"]

    x1, y1 = point(b["x"], b["y"])
    x2, y2 = point(right(b), top(b))
    return rect(F.least(x1, x2), F.least(y1, y2), F.abs(x2 - x1), F.abs(y2 - y1))


def placement_box(a: Column, b: Column, c: Column, d: Column, e: Column, f: Column) -> Column:
    """Box, rotation and mirroring of a placement matrix."""
    width, height = F.hypot(a, b), F.hypot(c, d)
    cx, cy = (a + c) / 2 + e, (b + d) / 2 + f
    degrees = F.pmod(F.degrees(F.atan2(-c, d)), F.lit(360.0))
    return F.struct(
        (cx - width / 2).alias("x"), (cy - height / 2).alias("y"),
        width.alias("width"), height.alias("height"),
        half_up_to(degrees, 2).alias("rotation"), (a * d - b * c < 0).alias("flip_x"),
    )


def placement_matrix(box: Column, rotation: Column, flip_x: Column, flip_y: Column) -> Column:
    """The matrix that puts a unit square in a box, mirrored, then turned about its middle."""
    cos, sin = F.cos(F.radians(rotation)), F.sin(F.radians(rotation))
    sx = F.when(flip_x, -box["width"]).otherwise(box["width"])
    sy = F.when(flip_y, -box["height"]).otherwise(box["height"])
    ox = F.when(flip_x, box["width"]).otherwise(0.0) - box["width"] / 2
    oy = F.when(flip_y, box["height"]).otherwise(0.0) - box["height"] / 2
    return F.struct(
        (sx * cos).alias("a"), (sx * sin).alias("b"), (-sy * sin).alias("c"), (sy * cos).alias("d"),
        (ox * cos - oy * sin + box["x"] + box["width"] / 2).alias("e"),
        (ox * sin + oy * cos + box["y"] + box["height"] / 2).alias("f"),
    )


# Points per unit.
POINTS_PER_UNIT = {
    "pt": 1.0, "in": 72.0, "ft": 72.0 * 12, "yd": 72.0 * 36, "mi": 72.0 * 63360,
    "mm": 72 / 25.4, "cm": 72 / 2.54, "m": 7200 / 2.54, "km": 7200000 / 2.54,
}


def points_per(unit: Column) -> Column:
    return F.create_map(*[F.lit(v) for pair in POINTS_PER_UNIT.items() for v in pair])[unit]


def calibrated_factor(length: Column, real: Column) -> Column:
    """Real length per point of a drawn line; null unless both are positive and finite."""
    return F.when((length > 0) & (real > 0) & (real < float("inf")), real / length)


def path_length(points: Column) -> Column:
    ahead = F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0)))
    steps = F.zip_with(
        points, ahead, lambda p, n: F.when(n.isNull(), 0.0).otherwise(F.hypot(n["x"] - p["x"], n["y"] - p["y"]))
    )
    return F.aggregate(steps, F.lit(0.0), lambda total, s: total + s)


def polygon_area(points: Column) -> Column:
    around = F.concat(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, 1))
    twice = F.zip_with(points, around, lambda p, n: p["x"] * n["y"] - n["x"] * p["y"])
    return F.abs(F.aggregate(twice, F.lit(0.0), lambda total, s: total + s)) / 2


def measured_text(value: Column, is_area: Column, unit: Column) -> Column:
    size = F.abs(value)
    digits = F.when(size >= 100, F.round(value, 1)).when(size >= 1, F.round(value, 2)).otherwise(F.round(value, 3))
    return F.concat(plain_number(digits), F.when(is_area, F.lit(" sq ")).otherwise(F.lit(" ")), unit)


def drawn_dpi(width_px: Column, height_px: Column, drawn_width: Column, drawn_height: Column) -> Column:
    return F.when(
        (drawn_width > 0) & (drawn_height > 0),
        F.least(width_px / (drawn_width / 72), height_px / (drawn_height / 72)),
    )


def luminance(r: Column, g: Column, b: Column) -> Column:
    return r * 0.299 + g * 0.587 + b * 0.114


PIXEL_THRESHOLD = 96
INK_MARGIN = 40


def pixel_class(distance: Column, before: Column, after: Column) -> Column:
    return (
        F.when(distance <= PIXEL_THRESHOLD, "same")
        .when(after > before + INK_MARGIN, "removed")
        .when(before > after + INK_MARGIN, "added")
        .otherwise("recoloured")
    )


def unit_colour(parts: Column) -> Column:
    """Three components are RGB, one is grey, anything else is no colour; clamped to 0..1."""

    def held(i: int) -> Column:
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.element_at(parts, i)))

    names = ("r", "g", "b")
    return F.when(
        F.size(parts) >= 3, F.struct(*[held(i + 1).alias(n) for i, n in enumerate(names)])
    ).when(F.size(parts) == 1, F.struct(*[held(1).alias(n) for n in names]))


def ocr_placement(left, top_, width, height, image_w, image_h, page_w, page_h, advance) -> Column:
    """A recognised word's pixel box on the page: baseline, size and stretch.

    ``advance`` is the word's natural width at size 1.
    """
    x, w = left * (page_w / image_w), width * (page_w / image_w)
    h = height * (page_h / image_h)
    y = page_h - (top_ + height) * (page_h / image_h)
    size = F.greatest(F.lit(1.0), h / 0.86)
    stretch = F.greatest(F.lit(1.0), F.least(F.lit(1000.0), w / (advance * size) * 100))
    return F.struct(
        half_up_to(x, 3).alias("x"), half_up_to(y + h * 0.18, 3).alias("baseline"),
        half_up_to(size, 3).alias("size"), half_up_to(stretch, 3).alias("stretch"),
    )


def displayed_size(width: Column, height: Column, rotation: Column) -> Column:
    """Page size as shown: sides swap on a quarter turn; tenths of a point, at least one."""

    def near(value: Column) -> Column:
        return F.greatest(F.lit(0.1), half_up(value * 10) / 10)

    turned = quarter_turns(rotation) % 2 == 1
    return F.struct(
        near(F.when(turned, height).otherwise(width)).alias("width"),
        near(F.when(turned, width).otherwise(height)).alias("height"),
    )


PI = math.pi
