"""Page ranges: ``1-5, 8, 12-`` parsed, tested, expanded and written back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import let
from quire.functions.text import trimmed


def _halves(piece: Column) -> Column:
    """Both ends as typed; a single page is both of its ends."""
    dash = F.instr(piece, "-")
    return F.struct(
        trimmed(F.when(dash > 0, F.substring(piece, F.lit(1), dash - 1)).otherwise(piece)).alias("first"),
        trimmed(F.when(dash > 0, F.substring(piece, dash + 1, F.length(piece))).otherwise(piece)).alias("last"),
    )


def _pieces(text: Column) -> Column:
    typed = F.filter(F.transform(F.split(text, "[,;]", -1), trimmed), lambda p: p != "")
    return F.transform(typed, _halves)


def _fault(value: Column, count: Column) -> Column:
    return (
        F.when(value == "", F.lit(None).cast("string"))
        .when(~value.rlike(r"^[0-9]+$"), F.concat(F.lit("“"), value, F.lit("” is not a page number.")))
        .when(
            ~F.coalesce(value.try_cast("bigint"), F.lit(-1)).between(1, count),
            F.concat(F.lit("This document has pages 1 to "), count.cast("string"), F.lit(".")),
        )
    )


def _bounds(piece: Column, count: Column) -> Column:
    first = F.when(piece["first"] == "", F.lit(1).cast("bigint")).otherwise(piece["first"].try_cast("bigint"))
    last = F.when(piece["last"] == "", count.cast("bigint")).otherwise(piece["last"].try_cast("bigint"))
    return F.struct(F.least(first, last).alias("first"), F.greatest(first, last).alias("last"))


def parsed(text: Column, count: Column) -> Column:
    """``struct<kind, message, spans>``; kind is all, pages or invalid.

    Spans stay ranges: whether a page is in one is a comparison, and no page
    list is built unless :func:`expanded` is asked for it.
    """
    spans_type = "array<struct<first:bigint,last:bigint>>"

    def judged(pieces: Column) -> Column:
        faults = F.transform(
            pieces, lambda p: F.coalesce(_fault(p["first"], count), _fault(p["last"], count))
        )
        return F.struct(
            pieces.alias("pieces"),
            F.when(count <= 0, F.lit("The document has no pages."))
            .when(F.size(pieces) == 0, F.lit("Enter at least one page."))
            .otherwise(F.try_element_at(F.filter(faults, lambda m: m.isNotNull()), F.lit(1)))
            .alias("message"),
        )

    def result(seen: Column) -> Column:
        bad = seen["message"].isNotNull()
        return F.struct(
            F.when(bad, F.lit("invalid")).otherwise(F.lit("pages")).alias("kind"),
            seen["message"].alias("message"),
            F.when(bad, F.array().cast(spans_type))
            .otherwise(F.transform(seen["pieces"], lambda p: _bounds(p, count)))
            .cast(spans_type)
            .alias("spans"),
        )

    everything = F.struct(
        F.lit("all").alias("kind"),
        F.lit(None).cast("string").alias("message"),
        F.array().cast(spans_type).alias("spans"),
    )
    return F.when(trimmed(text) == "", everything).otherwise(
        let(let(_pieces(text), judged), result)
    )


def includes(parsed_range: Column, page: Column) -> Column:
    return (parsed_range["kind"] == "all") | F.exists(
        parsed_range["spans"], lambda s: page.between(s["first"], s["last"])
    )


def expanded(parsed_range: Column, count: Column) -> Column:
    """The sorted distinct pages a range covers."""
    one = F.lit(1).cast("bigint")
    everything = F.when(count > 0, F.sequence(one, count.cast("bigint"))).otherwise(
        F.array().cast("array<bigint>")
    )
    listed = F.sort_array(
        F.array_distinct(
            F.flatten(F.transform(parsed_range["spans"], lambda s: F.sequence(s["first"], s["last"])))
        )
    )
    return F.when(parsed_range["kind"] == "all", everything).otherwise(listed)


def normalized_pages(pages: Column, count: Column) -> Column:
    """Distinct pages inside the document, sorted."""
    return F.sort_array(F.array_distinct(F.filter(pages, lambda p: p.between(1, count))))


def written(pages: Column) -> Column:
    """A page array as ``1-3, 7``: runs of neighbours collapse."""
    def runs(listed: Column) -> Column:
        return F.zip_with(
            F.filter(listed, lambda p: ~F.array_contains(listed, p - 1)),
            F.filter(listed, lambda p: ~F.array_contains(listed, p + 1)),
            lambda a, b: F.when(a == b, a.cast("string")).otherwise(
                F.concat(a.cast("string"), F.lit("-"), b.cast("string"))
            ),
        )

    return F.array_join(let(F.sort_array(F.array_distinct(pages)), runs), ", ")


def print_selection(
    scope: Column, text: Column, subset: Column, current: Column, count: Column
) -> Column:
    """``struct<pages, message>`` of a print choice; a blank range is an error here."""
    rng = parsed(text, count)
    every = expanded(parsed(F.lit(""), count), count)
    base = (
        F.when(scope == "current", F.array(F.least(F.greatest(current, F.lit(1)), count).cast("bigint")))
        .when(scope == "range", let(rng, lambda r: expanded(r, count)))
        .otherwise(every)
    )
    kept = F.filter(
        base,
        lambda p: (subset == "all") | (p % 2 == F.when(subset == "odd", 1).otherwise(0)),
    )
    return let(kept, lambda pages: _print_result(pages, scope, text, subset, rng, count))


def _print_result(kept, scope, text, subset, rng, count) -> Column:
    message = (
        F.when(count <= 0, F.lit("The document has no pages."))
        .when(
            (scope == "range") & (trimmed(text) == ""),
            F.lit("Enter the pages to print, such as 1-4, 9."),
        )
        .when((scope == "range") & (rng["kind"] == "invalid"), rng["message"])
        .when(
            (subset != "all") & (F.size(kept) == 0),
            F.concat(F.lit("Those pages include no "), subset, F.lit(" pages.")),
        )
    )
    return F.struct(
        F.when(message.isNull(), kept).otherwise(F.array().cast("array<bigint>")).alias("pages"),
        message.alias("message"),
    )
