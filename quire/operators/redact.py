"""Redaction: finding text as a reader sees it, what marks cover, removal and proof."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import let
from quire.functions.text import at_word_edge, collapsed, match_starts
from quire.operators.search import automaton_hits

# Shares of the text size.
SPACE_GAP, LINE_SHIFT = 0.15, 0.5
ASCENT, DESCENT = 0.75, -0.2
BAND = 64.0
CHAR = "struct<ch:string,run:int,x:double,y:double,width:double,height:double>"
BOXES = "array<struct<x:double,y:double,width:double,height:double>>"
UNREADABLE = "�"


# The one capital whose lower case is two characters, and a stand-in for it.
DOTTED_I, STAND_IN = "\u0130", "\ue000"


def folded(value: Column) -> Column:
    """Lower case that never changes the number of characters."""
    held = F.replace(value, F.lit(DOTTED_I), F.lit(STAND_IN))
    return F.replace(F.lower(held), F.lit(STAND_IN), F.lit(DOTTED_I))


def item_glyphs(item: Column) -> Column:
    """One entry per character of an item: its text and box, set evenly."""
    advance = item["width"] / F.length(item["str"])
    return F.transform(
        F.sequence(F.lit(0), F.length(item["str"]) - 1),
        lambda i: F.struct(
            F.substring(item["str"], i + 1, F.lit(1)).alias("ch"),
            item["seq"].alias("run"),
            (item["x"] + i * advance).alias("x"),
            (item["y"] + item["height"] * DESCENT).alias("y"),
            advance.alias("width"),
            (item["height"] * (ASCENT - DESCENT)).alias("height"),
        ),
    )


def reader_characters(items: Column) -> Column:
    """The page's characters as a reader sees them.

    A shift off the line, a gap or a long step back between items reads as a
    space (one without a box); runs of white space are one; none leads.
    """
    drawn = F.filter(items, lambda i: i["str"] != "")

    def implied(item: Column, before: Column) -> Column:
        along = item["x"] - (before["x"] + before["width"])
        size = F.when(item["height"] == 0, 1.0).otherwise(F.abs(item["height"]))
        return (F.abs(item["y"] - before["y"]) > size * LINE_SHIFT) | (along > size * SPACE_GAP) | (along < -size)

    space = F.struct(
        F.lit(" ").alias("ch"), F.lit(0).alias("run"),
        *[F.lit(None).cast("double").alias(n) for n in ("x", "y", "width", "height")],
    )

    def of_page(all_items: Column) -> Column:
        return F.flatten(
            F.transform(
                all_items,
                lambda item, i: F.when(
                    (i > 0) & implied(item, F.element_at(all_items, F.greatest(i, F.lit(1)))),
                    F.concat(F.array(space).cast(f"array<{CHAR}>"), item_glyphs(item).cast(f"array<{CHAR}>")),
                ).otherwise(item_glyphs(item).cast(f"array<{CHAR}>")),
            )
        )

    def single_spaced(chars: Column) -> Column:
        blank = r"^[\s\u00a0]$"
        kept = F.filter(
            chars,
            lambda c, i: ~c["ch"].rlike(blank)
            | ((i > 0) & ~F.element_at(chars, F.greatest(i, F.lit(1)))["ch"].rlike(blank)),
        )
        return F.transform(kept, lambda c: c.withField("ch", F.when(c["ch"].rlike(blank), F.lit(" ")).otherwise(c["ch"])))

    return let(let(drawn, of_page), single_spaced)


def same_bar(a: Column, b: Column) -> Column:
    """Boxes of one bar: they share half the lower one's height and are close."""
    shared = F.least(g.top(a), g.top(b)) - F.greatest(a["y"], b["y"])
    gap = F.greatest(b["x"] - g.right(a), a["x"] - g.right(b))
    return (shared >= F.least(a["height"], b["height"]) * 0.5) & (gap <= F.greatest(a["height"], b["height"]))


def _merge(boxes: Column, joins) -> Column:
    """Fold neighbours: each entry joins the last box or opens one."""
    return F.aggregate(
        boxes,
        F.array().cast(BOXES),
        lambda out, box: let(
            F.try_element_at(out, F.lit(-1)),
            lambda last: F.when(
                F.coalesce(joins(last, box), F.lit(False)),
                F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(g.union(last, box))),
            ).otherwise(F.concat(out, F.array(box))),
        ).cast(BOXES),
    )


def match_boxes(chars: Column) -> Column:
    """Boxes of matched characters: one per run, then joined along a line."""
    boxed = F.filter(chars, lambda c: c["x"].isNotNull())
    runs = F.array_distinct(F.transform(boxed, lambda c: c["run"]))
    per_run = F.transform(
        runs,
        lambda r: let(
            F.filter(boxed, lambda c: c["run"] == r),
            lambda mine: g.rect(
                F.array_min(F.transform(mine, lambda c: c["x"])),
                F.array_min(F.transform(mine, lambda c: c["y"])),
                F.array_max(F.transform(mine, lambda c: c["x"] + c["width"])) - F.array_min(F.transform(mine, lambda c: c["x"])),
                F.array_max(F.transform(mine, lambda c: c["y"] + c["height"])) - F.array_min(F.transform(mine, lambda c: c["y"])),
            ),
        ),
    )
    return F.filter(_merge(per_run, same_bar), lambda b: (b["width"] > 0) & (b["height"] > 0))


def apart(starts: Column, size: Column) -> Column:
    """Starts of matches that do not overlap, from the left."""
    return F.aggregate(
        starts,
        F.array().cast("array<int>"),
        lambda out, s: F.when(F.coalesce(F.try_element_at(out, F.lit(-1)) + size > s, F.lit(False)), out).otherwise(F.array_append(out, s)),
    )


def _matches(found: DataFrame, keys: list[str]) -> DataFrame:
    """Text and boxes of ``chars`` from ``start`` over ``size`` characters, where any has a box."""
    cut = found.withColumn("found", F.slice("chars", F.col("start") + 1, F.col("size")))
    return cut.select(
        *keys, "doc_id", "page", "start", F.array_join(F.transform("found", lambda c: c["ch"]), "").alias("text"),
        match_boxes(F.col("found")).alias("rects"),
    ).where(F.size("rects") > 0)


def _read(pages: DataFrame) -> DataFrame:
    """Each page's characters as a reader sees them, and their text."""
    chars = pages.select("doc_id", "page", reader_characters(F.col("items")).alias("chars"))
    return chars.withColumn("text", F.array_join(F.transform("chars", lambda c: c["ch"]), ""))


def find_text(
    pages: DataFrame, query: str, match_case: bool = False, whole_word: bool = False, cap: int | None = None
) -> DataFrame:
    """Matches to mark: ``doc_id, page, start, text, rects``; matches never overlap.

    Pages are first narrowed on the text without white space (which a match must
    hold however its words are spaced); characters and boxes are worked out for
    the pages left, inside their rows.
    """
    wanted = " ".join(query.split())
    fold = (lambda c: c) if match_case else folded
    if wanted == "":
        pages = pages.where(F.lit(False))
    squeezed = F.regexp_replace(F.array_join("items.str", ""), r"[\s\u00a0]+", "")
    needle = wanted.replace(" ", "")
    texts = _read(pages.where(F.contains(fold(squeezed), fold(F.lit(needle)))))
    starts = match_starts(fold(F.col("text")), fold(F.lit(wanted)), True, whole_word)
    found = texts.select("doc_id", "page", "chars", F.explode(apart(starts, F.lit(len(wanted)))).alias("start"), F.lit(len(wanted)).alias("size"))
    matches = _matches(found, [])
    return matches if cap is None else matches.orderBy("doc_id", "page", "start").limit(cap)


def find_phrases(pages: DataFrame, phrases: DataFrame, match_case: bool = False, whole_word: bool = False) -> DataFrame:
    """Matches of a list of phrases: ``phrase_id, doc_id, page, start, text, rects``.

    Spaced and folded as ``find_text`` does; matches of one phrase never overlap, those
    of different phrases may.  The list, of a size the caller has measured, is one
    automaton that runs over each page's text without white space, and again over the
    text as a reader sees it where that found something.
    """
    fold = (lambda c: c) if match_case else folded
    spaced = phrases.select("phrase_id", collapsed(F.col("phrase")).alias("phrase")).where("phrase <> ''").select(
        "phrase_id", fold(F.col("phrase")).alias("folded")
    )
    squeeze = lambda c: F.regexp_replace(c, r"[\s\u00a0]+", "")
    narrow = pages.withColumn("squeezed", fold(squeeze(F.array_join("items.str", ""))))
    held = automaton_hits(narrow.select("doc_id", "page", "items", "squeezed"), "squeezed", spaced.withColumn("folded", squeeze(F.col("folded"))))
    texts = _read(held.select("doc_id", "page", "items")).withColumn("folded", fold(F.col("text")))
    hits = automaton_hits(texts, "folded", spaced).withColumn("ids", F.array_distinct("hits.phrase_id"))

    def of_phrase(phrase_id: Column) -> Column:
        mine = F.filter("hits", lambda h: h["phrase_id"] == phrase_id)
        size = F.element_at(mine, 1)["size"]
        starts = F.transform(mine, lambda h: h["start"])
        if whole_word:
            starts = F.filter(starts, lambda s: at_word_edge(F.col("folded"), s - 1) & at_word_edge(F.col("folded"), s + size))
        return F.struct(phrase_id.alias("phrase_id"), size.alias("size"), apart(starts, size).alias("starts"))

    found = hits.select("doc_id", "page", "chars", F.explode(F.transform("ids", of_phrase)).alias("p")).select(
        "doc_id", "page", "chars", "p.phrase_id", "p.size", F.explode("p.starts").alias("start")
    )
    return _matches(found, ["phrase_id"])


def page_classes(pages: DataFrame) -> DataFrame:
    """Pages without text and pages with text nothing can read."""
    return pages.select(
        "doc_id",
        "page",
        (F.size("items") == 0).alias("textless"),
        F.exists("items", lambda i: F.contains(i["str"], F.lit(UNREADABLE))).alias("unreadable"),
    ).where("textless or unreadable")


def _banded(df: DataFrame, low: Column, high: Column) -> DataFrame:
    """Rows once per horizontal band they cross, so that overlaps become equal keys."""
    return df.withColumn("band", F.explode(F.sequence(F.floor(low / BAND), F.floor(high / BAND))))


def _meets(item: Column, mark: Column) -> Column:
    """Whether a mark reaches the box of an item's glyphs, whichever way the item runs."""
    far, low, high = item["x"] + item["width"], item["y"] + item["height"] * DESCENT, item["y"] + item["height"] * ASCENT
    return (
        (mark["x"] <= F.greatest(item["x"], far)) & (F.least(item["x"], far) <= g.right(mark))
        & (mark["y"] <= F.greatest(low, high)) & (F.least(low, high) <= g.top(mark))
    )


def _with_marks(pages: DataFrame, marks: DataFrame, *columns: Column) -> DataFrame:
    """Pages that have marks: ``doc_id, page, items, marks``; a page's marks come to its row.

    Marks are far smaller than the pages they lie on, so a task looks its pages up among
    its marks and no page row is sorted.
    """
    by_page = marks.groupBy("doc_id", "page").agg(F.collect_list(F.struct(*columns)).alias("marks"))
    drawn = F.transform(
        F.filter("items", lambda i: i["str"] != ""), lambda i: F.struct(*[i[n].alias(n) for n in ("seq", "str", "x", "y", "width", "height")])
    )
    return pages.select("doc_id", "page", drawn.alias("items")).join(by_page.hint("shuffle_hash"), ["doc_id", "page"])


def _set_evenly(item: Column) -> Column:
    """What all glyphs of an item share: how many they are, and the rest of their boxes."""
    return F.struct(
        F.length(item["str"]).alias("n"), (item["width"] / F.length(item["str"])).alias("advance"),
        (item["y"] + item["height"] * DESCENT).alias("y"), (item["height"] * (ASCENT - DESCENT)).alias("height"),
    )


def _glyph_box(item: Column, shared: Column, i: Column) -> Column:
    """The box of an item's glyph at place ``i``, as ``item_glyphs`` sets it."""
    return g.rect(item["x"] + i * shared["advance"], shared["y"], shared["advance"], shared["height"])


def _taken(item: Column, shared: Column, mark: Column) -> Column:
    """Places of an item's glyphs that a mark takes.

    A glyph goes only if its middle, or its share of the text size, is between the mark's
    ends.  Glyphs stand evenly, so the ends tell which can go, and, where the mark holds the
    middle of the line, which do; only those at the ends are measured.  Where glyphs are
    too narrow for that beside numbers as large, all are.
    """
    advance, last = shared["advance"], shared["n"] - 1
    covered = lambda i: g.glyph_covered(_glyph_box(item, shared, i), mark)
    known = lambda c: F.abs(c) < 1e300  # noqa: E731  neither NaN nor infinite
    told = (advance != 0) & known(advance) & (F.abs(item["x"]) <= F.abs(advance) * 1e12) & known(mark["x"]) & known(g.right(mark))
    at = lambda x: F.greatest(F.lit(-9.0), F.least((x - item["x"]) / advance, last + 9.0))
    held = lambda n: F.greatest(F.lit(0), F.least(n.cast("int"), last))
    slack, middle = 0.01, shared["y"] + shared["height"] / 2

    def ranges(ends: Column) -> Column:
        begin, end = F.least(ends["a"], ends["b"]), F.greatest(ends["a"], ends["b"])
        low = held(F.ceil(begin - (1 - g.GLYPH_SHARE + slack)))
        return F.struct(
            low.alias("low"), F.greatest(low, held(F.floor(end - (g.GLYPH_SHARE - slack)))).alias("high"), F.ceil(begin - (0.5 - slack)).cast("int").alias("first"),
            F.when((middle >= mark["y"]) & (middle <= g.top(mark)), F.floor(end - (0.5 + slack)).cast("int")).otherwise(-1).alias("last"),
        )

    def found(r: Column) -> Column:
        """From the first to the last that surely go, and one beside each; or those measured."""
        first = F.greatest(F.lit(0), F.when(covered(r["first"] - 1), r["first"] - 1).otherwise(r["first"]))
        end = F.least(last, F.when(covered(r["last"] + 1), r["last"] + 1).otherwise(r["last"]))
        some = (r["first"] <= r["last"]) & (r["first"] <= last) & (r["last"] >= 0)
        return F.when(some, F.sequence(first, end)).otherwise(F.filter(F.sequence(r["low"], r["high"]), covered))

    ends = F.struct(at(mark["x"]).alias("a"), at(g.right(mark)).alias("b"))
    return F.when(told, let(let(ends, ranges), found)).otherwise(F.filter(F.sequence(F.lit(0), last), covered))


def marked_glyphs(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Glyphs each mark takes: ``id`` with the glyph's columns.

    ``marks``: id, doc_id, page, x, y, width, height (one row per rectangle).  A page's
    marks come to its row; only glyphs that a mark can reach are looked at, inside the
    row, and only glyphs that a mark takes leave it.
    """
    met = _with_marks(pages, marks, F.col("id"), F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    kept = ["run", "glyph", "ch", "x", "y", "width", "height"]

    def glyph(item: Column, shared: Column, mark: Column, i: Column) -> Column:
        box = _glyph_box(item, shared, i)
        return F.struct(
            mark["id"].alias("id"), item["seq"].alias("run"), i.alias("glyph"), F.substring(item["str"], i + 1, F.lit(1)).alias("ch"),
            *[box[n].alias(n) for n in ("x", "y", "width", "height")],
        )

    def taken(item: Column) -> Column:
        under = F.filter("marks", lambda m: _meets(item, m))
        return let(
            _set_evenly(item),
            lambda shared: F.flatten(F.transform(under, lambda m: F.transform(_taken(item, shared, m), lambda i: glyph(item, shared, m, i)))),
        )

    hits = met.select("doc_id", "page", F.inline(F.flatten(F.transform("items", taken))))
    return hits.select("id", "doc_id", "page", *kept).distinct()


def mark_texts(hits: DataFrame) -> DataFrame:
    """What each mark removes, with a space between runs: ``id, doc_id, page, text``."""
    ordered = F.sort_array(F.collect_list(F.struct("run", "glyph", "ch")))
    joined = F.aggregate(
        ordered,
        F.struct(F.lit(None).cast("int").alias("run"), F.lit("").alias("text")),
        lambda s, c: F.struct(
            c["run"].alias("run"),
            F.concat(
                s["text"],
                F.when(s["run"].isNotNull() & (s["run"] != c["run"]) & ~s["text"].rlike(r"\s$"), F.lit(" ")).otherwise(F.lit("")),
                c["ch"],
            ).alias("text"),
        ),
        lambda s: s["text"],
    )
    return hits.groupBy("id", "doc_id", "page").agg(collapsed(joined).alias("text"))


def _kept_pieces(item: Column, marks: Column) -> Column:
    """The pieces of an item that its page's marks leave; whole where no mark meets it.

    What is left lies between the places taken, so only glyphs near a mark are looked at.
    """
    piece = lambda n, text, x, width: F.struct(
        item["seq"].alias("seq"), n.alias("piece"), text.alias("str"), x.alias("x"), item["y"].alias("y"), width.alias("width"), item["height"].alias("height")
    )
    met = F.exists(marks, lambda m: _meets(item, m))
    whole = F.array(piece(F.lit(0), item["str"], item["x"], item["width"]))

    def cut(shared: Column) -> Column:
        gone = F.sort_array(F.array_distinct(F.flatten(
            F.transform(F.filter(marks, lambda m: _meets(item, m)), lambda m: _taken(item, shared, m))
        )))

        def between(gone: Column) -> Column:
            gaps = F.arrays_zip(F.concat(F.array(F.lit(-1)), gone).alias("b"), F.concat(gone, F.array(shared["n"])).alias("e"))
            return F.transform(
                F.filter(gaps, lambda r: r["e"] - r["b"] > 1),
                lambda r, n: piece(
                    n, F.substring(item["str"], r["b"] + 2, r["e"] - r["b"] - 1), item["x"] + (r["b"] + 1) * shared["advance"],
                    shared["advance"] * (r["e"] - r["b"] - 1),
                ),
            )

        return let(gone, between)

    return F.when(met, let(_set_evenly(item), cut)).otherwise(whole)


def redacted_items(pages: DataFrame, marks: DataFrame) -> DataFrame:
    """Items of marked pages with covered glyphs gone: ``doc_id, page, seq, piece, str, x, y, width, height``.

    Kept glyphs stay where they were drawn; an item cut in the middle becomes the
    pieces on either side.  A page's marks come to its row, and the glyphs of the items
    they meet are cut inside it, so no glyph moves.
    """
    marked = _with_marks(pages, marks, F.col("x"), F.col("y"), F.col("width"), F.col("height"))
    return marked.select("doc_id", "page", F.inline(F.flatten(F.transform("items", lambda i: _kept_pieces(i, F.col("marks"))))))


def left_under_marks(items: DataFrame, marks: DataFrame) -> DataFrame:
    """The proof: glyphs of redacted items still under a mark.  Must be empty."""
    shaped = items.groupBy("doc_id", "page").agg(
        F.collect_list(
            # A piece is told by its item and its number there; glyphs need one number for both.
            F.struct((F.col("seq").cast("bigint") * (1 << 31) + F.col("piece")).alias("seq"), "str", "x", "y", "width", "height")
        ).alias("items")
    )
    return marked_glyphs(shaped, marks)


EVERYWHERE = (-1e9, -1e9, 2e9, 2e9)


def objects_under(objects: DataFrame, marks: DataFrame) -> DataFrame:
    """How marks meet other objects of their page: ``doc_id, page, object, mark, touched, inside``.

    ``objects``: doc_id, page, object and a nullable rectangle ``box``; one without
    a rectangle cannot be said to be outside a mark.  ``marks``: doc_id, page, mark, box.
    """
    boxed = objects.where("box is not null")
    unplaced = objects.where("box is null").withColumn("box", g.rect(*[F.lit(v) for v in EVERYWHERE]))
    named = marks.withColumnRenamed("box", "mark_box")
    left = _banded(boxed, F.col("box.y"), F.col("box.y") + F.col("box.height"))
    right = _banded(named, F.col("mark_box.y"), F.col("mark_box.y") + F.col("mark_box.height"))
    # A pair that shares several bands counts in the first of them only.
    shared = F.floor(F.greatest(F.col("box.y"), F.col("mark_box.y")) / BAND)
    near = left.join(right, ["doc_id", "page", "band"]).where(F.col("band") == shared).drop("band")
    anywhere = unplaced.join(named, ["doc_id", "page"])
    columns = ["doc_id", "page", "object", "mark", "box", "mark_box"]
    pairs = near.select(*columns).unionByName(anywhere.select(*columns))
    return pairs.where(g.touches(F.col("mark_box"), F.col("box"))).select(
        "doc_id", "page", "object", "mark", g.contains_rect(F.col("mark_box"), F.col("box")).alias("inside")
    )


def disposition(kind: Column, touched: Column, inside: Column, lossless: Column, clips: Column, has_box: Column) -> Column:
    """What happens to a graphic under marks."""
    return (
        F.when((kind == "group") & ~has_box, "raster")
        .when((kind == "path") & inside & ~clips, "remove")
        .when(kind == "path", "keep")
        .when(~touched, "keep")
        .when(inside, "remove")
        .when(kind == "group", "raster")
        .when((kind == "picture") & lossless, "repaint")
        .otherwise("raster")
    )


def closed_under_marks(hits: DataFrame, links: DataFrame, widgets: DataFrame) -> DataFrame:
    """Hits with all that goes with them, however far the chain: ``doc_id, object, by``.

    ``hits``: doc_id, object; ``links``: doc_id, object, other (a comment and its pop-up,
    or its parent: each shows the other's text, so they go either way); ``widgets``:
    doc_id, object, field (a widget takes its whole field, with the widgets of other
    pages).  ``by`` is ``mark`` for a hit and ``tie`` for what is tied to one.

    A field is a node of its own between its widgets, so a field of n widgets is n
    edges.  Each round follows only what the round before found.
    """
    from quire.operators.trees import reachable

    name = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    tie = lambda df, a, b: df.select("doc_id", a.alias("source"), b.alias("target"))
    one, other = name("o", "object"), name("o", "other")
    edges = (
        tie(links, one, other).unionByName(tie(links, other, one))
        .unionByName(tie(widgets, one, name("f", "field"))).unionByName(tie(widgets, name("f", "field"), one))
    )
    kind = dict(hits.dtypes)["object"]
    found = reachable(hits.select("doc_id", one.alias("node")), edges, ["doc_id"], both_ways=True).where(F.startswith("node", F.lit("o")))
    rows = found.select("doc_id", F.substring("node", 2, 1 << 30).cast(kind).alias("object"))
    direct = hits.select("doc_id", "object").distinct().withColumn("by", F.lit("mark"))
    return rows.join(direct, ["doc_id", "object"], "left").select("doc_id", "object", F.coalesce("by", F.lit("tie")).alias("by"))


# Why a page cannot be cut and becomes a picture, in the order they are told.
RASTER_REASONS = {
    "unreadable": "Part of this page is stored in a way {app} cannot read, so it cannot show that nothing is left under the marks.",
    "unmeasured": "Some text under a mark is drawn in a font that does not say where its characters sit.",
    "uncut": "Some text under a mark is written in a way {app} cannot take apart safely.",
    "group": "Part of the page under a mark is drawn as a reusable group, which {app} cannot cut into.",
    "inline": "A picture written into the page itself lies partly under a mark.",
    "picture": "A picture under a mark could not be read.",
}
STAGES = {"unreadable": 0, "unmeasured": 1, "uncut": 1, "group": 2, "inline": 2, "picture": 2}


def plan_pages(marks: DataFrame, pages: DataFrame, findings: DataFrame) -> DataFrame:
    """What each marked page would become: ``doc_id, page, mode, reasons``.

    ``marks``: doc_id, page; ``pages``: doc_id, page_count (marks beyond a document's
    pages are left out); ``findings``: doc_id, page, ord, reason (a key of
    ``RASTER_REASONS``), of the parts of the page the marks meet.  A page with a reason
    becomes a picture, the others are cut; each reason counts once, those of the page
    first, then of its text, then of its graphics, each in the order they are met.
    """
    asked = marks.join(pages.select("doc_id", "page_count"), "doc_id").where("page between 1 and page_count").select("doc_id", "page").distinct()
    stage = F.element_at(F.create_map(*[F.lit(x) for pair in STAGES.items() for x in pair]), F.col("reason"))
    # One row for each reason of a page, wherever how many times it was met.
    first = findings.groupBy("doc_id", "page", "reason").agg(F.min("ord").alias("ord")).withColumn("stage", stage)
    told = first.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("stage", "ord", "reason"))).alias("told"))
    return asked.join(told, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(F.col("told").isNull(), "native").otherwise("raster").alias("mode"),
        F.coalesce(F.transform("told", lambda t: t["reason"]), F.array().cast("array<string>")).alias("reasons"),
    )


def plan_marks(marks: DataFrame, texts: DataFrame, pictures: DataFrame, annotations: DataFrame) -> DataFrame:
    """What each mark would take: ``doc_id, page, mark, text, images, annotations``.

    ``marks``: doc_id, page, mark; ``texts``: mark, doc_id, page, text; the other two:
    doc_id, page, mark and object, a row for each meeting.  Counts come before joins.
    """
    keys = ["doc_id", "page", "mark"]
    counted = lambda df, name: df.groupBy(*keys).agg(F.countDistinct("object").alias(name))
    return (
        marks.select(*keys).distinct().join(texts.select(*keys, "text"), keys, "left")
        .join(counted(pictures, "images"), keys, "left").join(counted(annotations, "annotations"), keys, "left")
        .select(*keys, F.coalesce("text", F.lit("")).alias("text"), *[F.coalesce(n, F.lit(0)).alias(n) for n in ("images", "annotations")])
    )


def fresh_plans(plans: DataFrame, revisions: DataFrame) -> DataFrame:
    """Plans with whether they still fit: one made at another revision is refused."""
    current = revisions.groupBy("doc_id").agg(F.max("revision").alias("current"))
    return plans.join(current, "doc_id", "left").select(
        "doc_id", "plan", "revision",
        F.when(
            F.col("current").isNull() | (F.col("revision") != F.col("current")),
            F.lit("The document changed after this was planned."),
        ).alias("error"),
    )
