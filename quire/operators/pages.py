"""Page sequences: combine, move, duplicate, insert, delete, split, label, number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quire.functions import ranges
from quire.functions.numbers import page_label
from quire.operators.scale import running_total, total_before

LABEL_STRETCH = 4096


def combined(parts: DataFrame, documents: DataFrame) -> DataFrame:
    """``job, landed, doc_id, page, part``: pages of many sources in chosen order.

    ``parts``: job, part, doc_id, pages (repeats allowed; null takes every page);
    ``documents``: doc_id, page_count.  Pages a source does not have are dropped.
    Where a page lands is its part's start plus its place in the part's list, so
    only one row per part is ever ordered.
    """
    chosen = parts.join(documents, "doc_id").select(
        "job",
        "part",
        "doc_id",
        F.filter(
            F.coalesce("pages", F.sequence(F.lit(1).cast("bigint"), F.col("page_count").cast("bigint"))),
            lambda p: p.between(1, F.col("page_count")),
        ).alias("chosen"),
    )
    before = Window.partitionBy("job").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    placed = chosen.withColumn("start", F.coalesce(F.sum(F.size("chosen")).over(before), F.lit(0)))
    return placed.select(
        "job", "part", "doc_id", "start", F.posexplode("chosen").alias("at", "page")
    ).select("job", (F.col("start") + F.col("at") + 1).alias("landed"), "doc_id", "page", "part")


def carried_bookmarks(bookmarks: DataFrame, landed: DataFrame) -> DataFrame:
    """Bookmarks of the sources with the page each landed on; null where it was not taken.

    The last landing of a repeated page wins.
    """
    where = landed.groupBy("job", "part", "doc_id", "page").agg(F.max("landed").alias("landed"))
    taken = landed.select("job", "part", "doc_id").distinct()
    return (
        taken.join(bookmarks, "doc_id")
        .join(where, ["job", "part", "doc_id", "page"], "left")
        .select("job", "part", "doc_id", "path", "title", "page", "landed")
    )


def _flagged(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Pages with ``listed`` (0/1) and how many listed pages come before each."""
    marks = listed.select("doc_id", "page").distinct().withColumn("_hit", F.lit(1))
    flagged = pages.join(marks, ["doc_id", "page"], "left").withColumn(
        "listed", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")
    return running_total(flagged, ["doc_id"], "page", F.col("listed"), "listed_before")


def moved(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """Block move: listed pages keep their order and land together.

    ``moves``: doc_id, page, to_index (0-based, counted before the move).
    """
    targets = moves.groupBy("doc_id").agg(F.max("to_index").alias("to_index"))
    flagged = _flagged(pages, moves)
    facts = (
        flagged.join(targets, "doc_id")
        .groupBy("doc_id")
        .agg(
            F.first("to_index").alias("to_index"),
            F.sum("listed").alias("block"),
            F.count_if(F.col("listed") == 0).alias("kept"),
            F.count_if((F.col("listed") == 1) & (F.col("page") <= F.col("to_index"))).alias("ahead"),
        )
        .select(
            "doc_id",
            "block",
            F.greatest(F.lit(0), F.least(F.col("to_index") - F.col("ahead"), F.col("kept"))).alias("target"),
        )
    )
    rank = F.col("page") - 1 - F.col("listed_before")
    index = (
        F.when(F.col("target").isNull(), F.col("page") - 1)
        .when(F.col("listed") == 1, F.col("target") + F.col("listed_before"))
        .when(rank < F.col("target"), rank)
        .otherwise(rank + F.col("block"))
    )
    return flagged.join(facts, "doc_id", "left").select("doc_id", "page", (index + 1).alias("position"))


def duplicated(pages: DataFrame, listed: DataFrame) -> DataFrame:
    """Each listed page again right after itself: ``doc_id, page, position, copy``."""
    spots = F.when(F.col("listed") == 1, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    return _flagged(pages, listed).select(
        "doc_id", "page", "listed_before", F.explode(spots).alias("copy")
    ).select(
        "doc_id", "page", (F.col("page") + F.col("listed_before") + F.col("copy").cast("int")).alias("position"), "copy"
    )


def deleted(pages: DataFrame, listed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages left, renumbered, and the documents refused because none would be left."""
    flagged = _flagged(pages, listed)
    refused = flagged.groupBy("doc_id").agg(F.min("listed").alias("all_gone")).where("all_gone = 1").select("doc_id")
    left = (
        flagged.join(refused, "doc_id", "left_anti")
        .where(F.col("listed") == 0)
        .select("doc_id", "page", (F.col("page") - F.col("listed_before")).alias("position"))
    )
    return left, refused


def inserted_blanks(pages: DataFrame, inserts: DataFrame) -> DataFrame:
    """Blank pages put in at an index, sized like the page they follow (A4 in front).

    ``pages``: doc_id, page, width, height; ``inserts``: doc_id, index, count (one
    per document).
    """
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    placed = inserts.join(counts, "doc_id").select(
        "doc_id", F.greatest(F.lit(0), F.least("index", "n")).alias("index"), "count"
    )
    before = pages.select("doc_id", F.col("page").alias("index"), "width", "height")
    blanks = placed.join(before, ["doc_id", "index"], "left").select(
        "doc_id",
        F.explode(F.sequence(F.col("index") + 1, F.col("index") + F.col("count"))).alias("position"),
        F.lit(None).cast("bigint").alias("page"),
        F.coalesce("width", F.lit(595.28)).alias("width"),
        F.coalesce("height", F.lit(841.89)).alias("height"),
    ).withColumn("position", F.col("position").cast("bigint"))
    kept = pages.join(placed, "doc_id", "left").select(
        "doc_id",
        (F.col("page") + F.when(F.col("page") > F.col("index"), F.col("count")).otherwise(0))
        .cast("bigint")
        .alias("position"),
        F.col("page").cast("bigint").alias("page"),
        "width",
        "height",
    )
    return kept.unionByName(blanks)


def extracted(pages: DataFrame, asked: DataFrame) -> DataFrame:
    """The asked pages that exist, in the order of asking: ``doc_id, ord, page``."""
    return asked.select("doc_id", F.posexplode("pages").alias("ord", "page")).join(
        pages.select("doc_id", "page"), ["doc_id", "page"], "left_semi"
    )


def split_every(pages: DataFrame, size: int) -> DataFrame:
    return pages.select("doc_id", "page", (F.floor((F.col("page") - 1) / size) + 1).alias("part"))


def split_at(pages: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Parts beginning at boundary pages; page 1 always begins one.

    ``boundaries``: doc_id, page, ord, title.  A part is named by the first
    boundary on its first page, else it is null and named by its pages.
    """
    named = boundaries.groupBy("doc_id", "page").agg(F.min_by("title", "ord").alias("title"))
    joined = pages.join(named.withColumn("_hit", F.lit(1)), ["doc_id", "page"], "left").withColumn(
        "begins", F.when((F.col("page") == 1) | F.col("_hit").isNotNull(), 1).otherwise(0)
    )
    counted = running_total(joined, ["doc_id"], "page", F.col("begins"), "before")
    return counted.select(
        "doc_id", "page", (F.col("before") + F.col("begins")).alias("part"),
        F.when(F.col("begins") == 1, F.col("title")).alias("title"),
    )


def split_ranges(requests: DataFrame) -> DataFrame:
    """One part per comma piece of a range text; parts may overlap.

    ``requests``: doc_id, ranges, page_count -> doc_id, part, pages, problem.
    """
    pieces = F.filter(F.split("ranges", ","), lambda p: F.trim(p) != "")
    parts = requests.select("doc_id", "page_count", F.posexplode(pieces).alias("part", "piece")).withColumn(
        "range", ranges.parsed(F.col("piece"), F.col("page_count"))
    )
    return parts.select(
        "doc_id",
        (F.col("part") + 1).alias("part"),
        ranges.expanded(F.col("range"), F.col("page_count")).alias("pages"),
        F.col("range.message").alias("problem"),
    )


def labelled(pages: DataFrame, label_ranges: DataFrame) -> DataFrame:
    """The printed label of each page; null before the first range.

    ``label_ranges``: doc_id, from_index (0-based), style, prefix, start.  A range
    runs to the next one's start; both sides meet on stretches of the page
    number, so a very long document spreads over many tasks.
    """
    following = Window.partitionBy("doc_id").orderBy("from_index")
    spans = label_ranges.withColumn("until", F.lead("from_index").over(following))
    last = pages.groupBy("doc_id").agg(F.max("page").alias("last"))
    spans = (
        spans.join(last, "doc_id")
        .withColumn("until", F.least(F.coalesce("until", F.col("last")), F.col("last")))
        .where(F.col("from_index") < F.col("until"))
        .withColumn(
            "stretch",
            F.explode(
                F.sequence(
                    F.floor(F.col("from_index") / LABEL_STRETCH), F.floor((F.col("until") - 1) / LABEL_STRETCH)
                )
            ),
        )
        .drop("last")
    )
    index = F.col("page") - 1
    inside = (index >= F.col("from_index")) & (index < F.col("until"))
    numbered = pages.withColumn("stretch", F.floor(index / LABEL_STRETCH))
    found = (
        numbered.join(spans, ["doc_id", "stretch"])
        .where(inside)
        .select(
            "doc_id",
            "page",
            page_label(F.col("style"), F.col("prefix"), F.col("start") + index - F.col("from_index")).alias("label"),
        )
    )
    return pages.select("doc_id", "page").join(found, ["doc_id", "page"], "left")


def with_label_range(label_ranges: DataFrame, changes: DataFrame) -> DataFrame:
    """Ranges after setting one: it replaces the range at its page, the others stay,
    and a document whose first range is not at page 0 gets a decimal one there."""
    kept = label_ranges.join(changes.select("doc_id", "from_index"), ["doc_id", "from_index"], "left_anti")
    merged = kept.unionByName(changes)
    bare = (
        merged.groupBy("doc_id").agg(F.min("from_index").alias("lowest")).where("lowest > 0")
        .select(
            "doc_id", F.lit(0).cast("bigint").alias("from_index"), F.lit("decimal").alias("style"),
            F.lit("").alias("prefix"), F.lit(1).cast("bigint").alias("start"),
        )
    )
    return merged.unionByName(bare)


def numbered(pages: DataFrame, prefix: str, digits: int, suffix: str, start: int) -> DataFrame:
    """Stamped numbers running through all documents in (doc_id, page) order.

    ``pages``: doc_id, page, page_count.  Only one row per document is totalled,
    by sampled ranges of the ids; a page's number is its document's start plus its place.
    """
    documents = pages.select("doc_id", "page_count").distinct()
    starts = total_before(documents, [], ["doc_id"], F.col("page_count"), "before").select("doc_id", "before")
    number = (F.lit(start) + F.col("before") + F.col("page") - 1).cast("string")
    # Padding must never cut a longer number.
    padded = F.lpad(number, F.greatest(F.length(number), F.lit(digits)), F.lit("0"))
    return pages.join(starts, "doc_id").select(
        "doc_id", "page", "page_count", F.concat(F.lit(prefix), padded, F.lit(suffix)).alias("stamp")
    )


def inserted_from(pages: DataFrame, inserts: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages of a source put in at an index: ``doc_id, position, from_doc, page``.

    ``inserts``: doc_id, index, source_id, pages (null takes all); ``sources``:
    doc_id, page_count.  The list is sorted and distinct, as far as it exists.
    """
    known = sources.select(F.col("doc_id").alias("source_id"), F.col("page_count").alias("available"))
    counts = pages.groupBy("doc_id").agg(F.count("*").alias("n"))
    wanted = (
        inserts.join(known, "source_id")
        .join(counts, "doc_id")
        .select(
            "doc_id",
            "source_id",
            F.greatest(F.lit(0), F.least("index", "n")).alias("index"),
            ranges.normalized_pages(
                F.coalesce("pages", F.sequence(F.lit(1).cast("bigint"), F.col("available").cast("bigint"))),
                F.col("available"),
            ).alias("wanted"),
        )
    )
    added = wanted.select("doc_id", "source_id", "index", F.posexplode("wanted").alias("at", "page")).select(
        "doc_id", (F.col("index") + F.col("at") + 1).cast("bigint").alias("position"),
        F.col("source_id").alias("from_doc"), F.col("page").cast("bigint").alias("page"),
    )
    shift = wanted.select("doc_id", "index", F.size("wanted").alias("count"))
    kept = pages.join(shift, "doc_id", "left").select(
        "doc_id",
        (F.col("page") + F.when(F.col("page") > F.col("index"), F.col("count")).otherwise(0))
        .cast("bigint")
        .alias("position"),
        F.col("doc_id").alias("from_doc"),
        F.col("page").cast("bigint").alias("page"),
    )
    return kept.unionByName(added)


def row_index(page: Column, two_page: bool, cover: bool) -> Column:
    """0-based index of the display row a page sits in."""
    held = F.greatest(F.lit(1), page)
    if not two_page:
        return held - 1
    return F.floor(held / 2) if cover else F.floor((held - 1) / 2)


def row_first_page(row: Column, two_page: bool, cover: bool) -> Column:
    if two_page and cover:
        return F.when(row == 0, 1).otherwise(row * 2)
    return row * 2 + 1 if two_page else row + 1


def step_page(page: Column, offset: int, count: Column, two_page: bool, cover: bool) -> Column:
    """First page of the row ``offset`` rows away, held inside the document."""
    last = row_index(count, two_page, cover)
    row = F.least(last, F.greatest(F.lit(0), row_index(page, two_page, cover) + offset))
    return F.when(count <= 0, 1).otherwise(row_first_page(row, two_page, cover))


def side_of(page: Column, two_page: bool, cover: bool) -> Column:
    if not two_page:
        return F.lit("centre")
    return F.when(page % 2 == (0 if cover else 1), "left").otherwise("right")


def selected(pages: Column, anchor: Column, clicked: Column, modifier: Column) -> Column:
    """Selection after a click: replace, toggle or extend from the anchor."""
    ranged = F.sequence(F.least(anchor, clicked), F.greatest(anchor, clicked))
    toggled = F.when(
        F.array_contains(pages, clicked), F.array_except(pages, F.array(clicked))
    ).otherwise(F.array_union(pages, F.array(clicked)))
    return F.struct(
        F.when(modifier == "toggle", F.sort_array(toggled))
        .when((modifier == "range") & anchor.isNotNull(), ranged)
        .otherwise(F.array(clicked))
        .alias("pages"),
        F.when((modifier == "range") & anchor.isNotNull(), anchor).otherwise(clicked).alias("anchor"),
    )


def selection_after_removal(removed: Column, count: Column) -> Column:
    """The page that took the first removed page's place; null when none is left."""
    left = count - F.size(F.array_distinct(removed))
    return F.when(left > 0, F.least(F.array_min(removed), left))


def crops(boxes: DataFrame) -> DataFrame:
    """Pages that end with the same rectangle share one operation.

    ``boxes``: doc_id, page, x, y, width, height -> the rectangle with its page
    runs; the page list stays as runs, one row each, however long it is.
    """
    from quire.operators.scale import runs

    return runs(boxes, ["doc_id", "x", "y", "width", "height"], "page")


def reconciled(mine: DataFrame, truth: DataFrame, keys: list[str]) -> DataFrame:
    """My rows still in the truth in my order (refreshed), then new ones in theirs.

    ``mine``/``truth``: keys, id, ord (+ value in truth); result: id, value and a
    sortable ``(bucket, ord)``.
    """
    m = mine.select(*keys, "id", F.col("ord").alias("my_ord"))
    return truth.join(m, [*keys, "id"], "left").select(
        *keys,
        "id",
        "value",
        F.when(F.col("my_ord").isNull(), 1).otherwise(0).alias("bucket"),
        F.coalesce("my_ord", "ord").alias("ord"),
    )
