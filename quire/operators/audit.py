"""Facts and audits of whole documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_sizes(pages: DataFrame, most: int | None = None) -> DataFrame:
    """Displayed page sizes per document, most frequent first, earliest page breaking ties; all, or the first ``most``."""
    counted = pages.groupBy("doc_id", "width", "height").agg(
        F.count("*").alias("pages"), F.min("page").alias("first_page")
    )
    order = Window.partitionBy("doc_id").orderBy(F.desc("pages"), "first_page", "width", "height")
    ranked = counted.withColumn("rank", F.row_number().over(order))
    return ranked if most is None else ranked.where(F.col("rank") <= most)


def mostly_landscape(pages: DataFrame) -> DataFrame:
    """True where wide pages outnumber the rest."""
    wide = F.col("width") > F.col("height")
    return pages.groupBy("doc_id").agg((F.count_if(wide) > F.count_if(~wide)).alias("landscape"))


# The checks, in report order.
CHECKS = [
    "title", "displayTitle", "language", "tagged", "figureAltText", "imageOnlyPages", "formFieldNames",
    "linkTargets", "linkDescriptions", "tabOrder", "untaggedContent", "assistivePermission",
    "readingOrder", "colourContrast",
]

# The categories of hidden information, in report order.
CATEGORIES = [
    "metadata", "xmpMetadata", "attachments", "documentJavaScript", "launchActions", "hiddenAnnotations",
    "formData", "thumbnails", "hiddenLayers", "alternateImages",
]


def link_facts(links: DataFrame) -> DataFrame:
    """Per document: links, links that lead nowhere, links without a description.

    ``links``: doc_id, action, url, destination, contents.
    """
    from quire.functions.facts import goes_nowhere
    from quire.functions.text import is_blank

    bare = is_blank(F.coalesce("contents", F.lit("")))
    return links.groupBy("doc_id").agg(
        F.count("*").alias("links"),
        F.count_if(goes_nowhere(F.col("action"), F.col("url"), F.col("destination"))).alias("empty_links"),
        F.count_if(bare).alias("bare_links"),
    )


def page_facts(inventory: DataFrame) -> DataFrame:
    """Per document from a page inventory (doc_id, page, text_shows, pictures, loose, annots, tabs)."""
    return inventory.groupBy("doc_id").agg(
        F.count_if((F.col("pictures") > 0) & (F.col("text_shows") == 0)).alias("image_only"),
        F.count_if("loose").alias("loose_pages"),
        F.count_if((F.col("annots") > 0) & (F.coalesce("tabs", F.lit("")) != "S")).alias("tab_pages"),
    )


def figure_facts(figures: DataFrame) -> DataFrame:
    from quire.functions.text import is_blank

    silent = is_blank(F.coalesce("alt", F.lit(""))) & is_blank(F.coalesce("actual_text", F.lit("")))
    return figures.groupBy("doc_id").agg(F.count("*").alias("figures"), F.count_if(silent).alias("silent_figures"))


def field_facts(fields: DataFrame) -> DataFrame:
    from quire.functions.text import is_blank

    return fields.groupBy("doc_id").agg(
        F.count("*").alias("fields"), F.count_if(is_blank(F.coalesce("tooltip", F.lit("")))).alias("unnamed_fields")
    )


def accessibility_report(documents: DataFrame, *facts: DataFrame) -> DataFrame:
    """Fourteen checks per document: ``doc_id, check, status, found``.

    ``documents``: doc_id, title, language, display_title, has_tags, marked, encrypted,
    may_extract; ``facts``: per-document counts of links, pages, figures, fields.
    Every fact is one aggregate by document, so the report is a few joins on it
    and no list is gathered.  A check whose facts were not given is ``unknown``; a
    document without a row in the facts that were given has none of those things.
    """
    from quire.functions.facts import language_tag
    from quire.functions.text import is_blank

    wide = documents
    for fact in facts:
        wide = wide.join(fact, "doc_id", "left")

    def count(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0))

    tags = F.col("has_tags")

    def counted(total: str | None, bad: str, verdict: str, needs_tags: bool = False) -> tuple[Column, Column]:
        if bad not in wide.columns or (total is not None and total not in wide.columns):
            return F.lit("unknown"), F.lit(None)
        absent = F.lit(False) if total is None else count(total) == 0
        if needs_tags:
            absent = absent | ~tags
        status = F.when(absent, "notApplicable").when(count(bad) > 0, verdict).otherwise("passed")
        return status, F.when(absent, 0).otherwise(count(bad))

    def stated(status: Column) -> tuple[Column, Column]:
        return status, F.lit(0)

    checks = {
        "title": stated(F.when(is_blank(F.coalesce("title", F.lit(""))), "failed").otherwise("passed")),
        "displayTitle": stated(F.when(F.col("display_title"), "passed").otherwise("warning")),
        "language": stated(
            F.when(F.col("language").isNull(), "failed").when(language_tag(F.col("language")), "passed").otherwise("warning")
        ),
        "tagged": stated(F.when(~tags, "failed").when(F.col("marked"), "passed").otherwise("warning")),
        "figureAltText": counted("figures", "silent_figures", "failed", needs_tags=True),
        "imageOnlyPages": counted(None, "image_only", "failed"),
        "formFieldNames": counted("fields", "unnamed_fields", "failed"),
        "linkTargets": counted("links", "empty_links", "failed"),
        "linkDescriptions": counted("links", "bare_links", "warning", needs_tags=True),
        "tabOrder": counted(None, "tab_pages", "failed", needs_tags=True),
        "untaggedContent": counted(None, "loose_pages", "warning", needs_tags=True),
        "assistivePermission": stated(
            F.when(F.col("encrypted") & (F.col("may_extract") == F.lit(False)), "failed").otherwise("passed")
        ),
        "readingOrder": stated(F.lit("manual")),
        "colourContrast": stated(F.lit("manual")),
    }
    rows = [
        F.struct(F.lit(name).alias("check"), checks[name][0].alias("status"), checks[name][1].cast("bigint").alias("found"))
        for name in CHECKS
    ]
    return wide.select("doc_id", F.inline(F.array(*rows)))


def figure_items(figures: DataFrame, most: int | None = None) -> DataFrame:
    """Figures to show, those without text in front: all, or the first ``most`` in tree order.

    ``figures``: doc_id, ord, alt -> doc_id, place, ord, described, truncated.
    """
    from quire.functions.text import is_blank

    tree = Window.partitionBy("doc_id").orderBy("ord")
    kept = figures.withColumn("truncated", F.lit(False))
    if most is not None:
        counts = figures.groupBy("doc_id").agg((F.count("*") > most).alias("truncated"))
        kept = figures.withColumn("n", F.row_number().over(tree)).where(F.col("n") <= most).join(counts, "doc_id")
    described = ~is_blank(F.coalesce("alt", F.lit("")))
    shown = kept.withColumn("described", described)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("described", "ord"))
    return shown.withColumn("place", place).select("doc_id", "place", "ord", "described", "truncated")


def hidden_information(
    documents: DataFrame, findings: DataFrame, shown: int | None = None, width: int | None = None
) -> DataFrame:
    """Ten categories per document: ``doc_id, category, count, detail``; empty ones stay.

    ``findings``: doc_id, category, ord, label.  A report may ask for the first
    ``shown`` labels and the first ``width`` characters; labels are cut before they are
    gathered.
    """
    order = Window.partitionBy("doc_id", "category").orderBy("ord", "label")
    label = F.struct("n", "label")
    kept = label if shown is None else F.when(F.col("n") <= shown, label)
    detail = F.array_join(F.transform(F.sort_array(F.collect_list(kept)), lambda r: r["label"]), ", ")
    found = (
        findings.withColumn("n", F.row_number().over(order)).groupBy("doc_id", "category")
        .agg(F.count("*").alias("count"), (detail if width is None else F.substring(detail, 1, width)).alias("detail"))
    )
    grid = documents.select("doc_id", F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    return grid.join(found, ["doc_id", "category"], "left").select(
        "doc_id", "category", F.coalesce("count", F.lit(0)).alias("count"), F.coalesce("detail", F.lit("")).alias("detail")
    )


def sanitized(findings: DataFrame, categories: list[str]) -> DataFrame:
    """What is left after removing the chosen categories only."""
    return findings.where(~F.col("category").isin(categories))


def attachments(named: DataFrame, on_pages: DataFrame) -> DataFrame:
    """Attached files of a document: the name tree first, then page annotations; an id counts once.

    Both: doc_id, id, ord, file_name, declared_size, raw_size, compressed.
    """
    from quire.functions.facts import risky_attachment

    both = named.withColumn("from", F.lit(0)).unionByName(on_pages.withColumn("from", F.lit(1)))
    rest = [c for c in both.columns if c not in ("doc_id", "id")]
    once = both.groupBy("doc_id", "id").agg(F.min_by(F.struct(*rest), F.struct("from", "ord")).alias("a"))
    size = F.coalesce("a.declared_size", F.when(~F.col("a.compressed"), F.col("a.raw_size")))
    return once.select(
        "doc_id", "id", F.col("a.file_name").alias("file_name"), size.alias("size_bytes"),
        risky_attachment(F.col("a.file_name")).alias("risky"),
    )


def fonts(seen: DataFrame) -> DataFrame:
    """Fonts of a document, one row per name, the first description met; by name.

    ``seen``: doc_id, ord, name, type, embedded -> plus ``subset`` and ``place``.
    """
    first = seen.groupBy("doc_id", "name").agg(F.min_by(F.struct("type", "embedded"), "ord").alias("f"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    return first.withColumn("place", place).select(
        "doc_id", "place", F.regexp_replace("name", r"^[A-Z]{6}\+", "").alias("name"), "f.type", "f.embedded",
        F.col("name").rlike(r"^[A-Z]{6}\+").alias("subset"),
    )


def resolved_destinations(links: DataFrame, named: DataFrame, pages: DataFrame) -> DataFrame:
    """Links to page numbers: a direct page wins, else the named destination's page.

    ``links``: doc_id, link, page_ref, dest; ``named``: doc_id, name, page_ref, tree
    (names beat dests), ord (the latest wins); ``pages``: doc_id, page_ref, page.
    """
    best = named.groupBy("doc_id", F.col("name").alias("dest")).agg(
        F.max_by("page_ref", F.struct(F.when(F.col("tree") == "names", 1).otherwise(0).alias("p"), "ord")).alias("named_ref")
    )
    return (
        links.join(best, ["doc_id", "dest"], "left")
        .withColumn("page_ref", F.coalesce("page_ref", "named_ref"))
        .join(pages, ["doc_id", "page_ref"], "left")
        .select("doc_id", "link", "page")
    )


def reading_order(tags: DataFrame, content: DataFrame, geometry: DataFrame) -> DataFrame:
    """Tags in tree order with the box of what they mark: ``doc_id, number, tag, page, x, y, width, height``.

    ``tags``: doc_id, tag, ord; ``content``: doc_id, tag, page, mcid; ``geometry``:
    doc_id, page, mcid, x, y, width, height.
    """
    boxes = content.join(geometry, ["doc_id", "page", "mcid"]).groupBy("doc_id", "tag").agg(
        F.min("page").alias("page"), F.min("x").alias("x"), F.min("y").alias("y"),
        F.max(F.col("x") + F.col("width")).alias("r"), F.max(F.col("y") + F.col("height")).alias("t"),
    )
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("ord"))
    return tags.join(boxes, ["doc_id", "tag"]).withColumn("number", number).select(
        "doc_id", "number", "tag", "page", "x", "y", (F.col("r") - F.col("x")).alias("width"), (F.col("t") - F.col("y")).alias("height")
    )
