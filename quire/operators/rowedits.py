"""Edits of rows that belong to a document: links, fields, files, placements, text runs, tagged blocks.

A log of edits is not replayed row by row.  What an edit meets depends only on the
earlier edits of the same row (or the same page), so it is told by windows and
aggregates over those, and no document's log is one task's work.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADD, UPDATE, DELETE = "add", "update", "delete"


def keyed_edits(
    base: DataFrame, log: DataFrame, keys: list[str], fields: list[str], taken: str | None, missing: str | None,
    invalid: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Rows after a log of adds, updates and deletes by key, and the edits refused.

    ``base``: keys, ord (its place) and fields; ``log``: keys, ord (unique, in time),
    ``kind`` and fields.  A key lives from its row or an add until a delete, and is free
    again after that.  An add of a living key is refused with ``taken``, or replaces the
    row where that is None; an update or delete of a key that does not live is refused
    with ``missing``, or does nothing.  ``invalid``, a column of messages or null, refuses
    an edit for what it says before anything else and leaves the key as it was.

    An update keeps the value of each field it leaves null.  ``touched`` is the ord of
    the last add or update (null for a row as it was), so that rows put back at the end
    of their list can be ordered: first those never touched by ``ord``, then by ``touched``.
    """
    start = base.select(*keys, F.lit(-1).cast("bigint").alias("at"), F.lit("base").alias("kind"), F.col("ord").alias("place"), *fields)
    events = log.withColumn("message", F.lit(None).cast("string") if invalid is None else invalid)
    bad = events.where("message is not null").select(*keys, F.col("ord").cast("bigint").alias("ord"), "kind", F.col("message").alias("error"))
    good = events.where("message is null").select(
        *keys, F.col("ord").cast("bigint").alias("at"), "kind", F.lit(None).cast(base.schema["ord"].dataType).alias("place"), *fields
    )
    # Whether a key lives is told by the last add or delete before; a refused one changes nothing about that.
    before = Window.partitionBy(*keys).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    turn = F.when(F.col("kind").isin("base", ADD), True).when(F.col("kind") == DELETE, False)
    known = start.unionByName(good).withColumn("lives", F.coalesce(F.last(turn, ignorenulls=True).over(before), F.lit(False)))
    wrong = F.when((F.col("kind") == ADD) & F.col("lives"), F.lit(taken)).when(
        F.col("kind").isin(UPDATE, DELETE) & ~F.col("lives"), F.lit(missing)
    )
    known = known.withColumn("error", wrong)
    refused = known.where("error is not null").select(*keys, F.col("at").alias("ord"), "kind", "error").unionByName(bad)
    done = known.where("error is null and (kind = 'base' or kind = 'add' or lives)")
    ends = done.groupBy(*keys).agg(
        F.max(F.when(F.col("kind").isin("base", ADD), F.col("at"))).alias("begun"), F.max(F.when(F.col("kind") == DELETE, F.col("at"))).alias("gone")
    ).where("gone is null or begun > gone")
    alive = done.where("kind <> 'delete'").join(ends.drop("gone"), keys).where("at >= begun")
    latest = [F.max_by(f, F.when(F.col(f).isNotNull(), F.col("at"))).alias(f) for f in fields]
    after = alive.groupBy(*keys).agg(
        *latest, F.max(F.when(F.col("at") == F.col("begun"), F.col("place"))).alias("ord"), F.max(F.when(F.col("at") >= 0, F.col("at"))).alias("touched")
    )
    return after, refused


# Messages of refused edits.
GONE_PAGE = "That page is not in this document any more."
GONE_LINK = "That link is no longer on the page."
GONE_FIELD = "That field is no longer in this document."
NAME_TAKEN = "A field of that name is already in this document."
GONE_TEXT = "That text is no longer where it was; close the editor and try again."
LINK_TARGET = "A link can point at a page or at a web address."


def _on_pages(log: DataFrame, pages: DataFrame) -> DataFrame:
    return log.join(pages.select("doc_id", "page_count"), "doc_id", "left")


def _page_problem() -> Column:
    return F.when(F.col("page_count").isNull() | (F.col("page") < 1) | (F.col("page") > F.col("page_count")), F.lit(GONE_PAGE))


def link_edits(links: DataFrame, log: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of pages after adds, updates and deletes, in drawing order, and the edits refused.

    ``links``: doc_id, page, link, ord and the fields x, y, width, height, target_page,
    url; ``log``: the same with kind; ``pages``: doc_id, page_count.  A target is a web
    address or a page, which is brought into the document; changing it leaves nothing of
    the old one.  An updated link comes last on its page.
    """
    fields = ["x", "y", "width", "height", "target"]
    target = F.when(F.col("url").isNotNull(), F.struct(F.lit(None).cast("bigint").alias("page"), F.col("url").alias("url"))).when(
        F.col("target_page").isNotNull(), F.struct(F.col("target_page").cast("bigint").alias("page"), F.lit(None).cast("string").alias("url"))
    )
    from quire.functions.facts import allowed_url

    events = _on_pages(log, pages).withColumn(
        "target_page", F.when(F.col("target_page").isNotNull(), F.least("target_page", "page_count"))
    ).withColumn("target", target)
    # Nothing is behind a target, an address of another kind, or an add without any.
    nowhere = (F.col("url").isNotNull() & ~allowed_url(F.col("url"))) | ((F.col("kind") == ADD) & F.col("target").isNull())
    invalid = F.coalesce(_page_problem(), F.when(nowhere, F.lit(LINK_TARGET)))
    after, refused = keyed_edits(
        links.withColumn("target", target), events, ["doc_id", "page", "link"], fields, "That link is already on the page.", GONE_LINK, invalid
    )
    place = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.asc_nulls_first("touched"), "ord"))
    return after.select(
        "doc_id", "page", "link", place.alias("place"), "x", "y", "width", "height", F.col("target.page").alias("target_page"), F.col("target.url").alias("url")
    ), refused


def field_edits(fields: DataFrame, log: DataFrame, pages: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """Form fields after adds, updates and deletes, and the edits refused.

    ``fields``: doc_id, name, ord, page and ``names`` (properties such as rectangle, type,
    tooltip, options); ``log``: the same with kind.  A name is taken while its field
    lives and free again after its deletion; deleting what is not there does nothing.
    """
    events = _on_pages(log, pages)
    invalid = F.when(F.col("kind") == ADD, _page_problem())
    after, refused = keyed_edits(fields, events, ["doc_id", "name"], ["page", *names], NAME_TAKEN, GONE_FIELD, invalid)
    return after.drop("touched"), refused.where("kind <> 'delete'")


def file_edits(files: DataFrame, log: DataFrame, names: list[str]) -> DataFrame:
    """Attached files after adds and removals: one of a name replaces the other, by name.

    ``files``: doc_id, name, ord and ``names``; ``log``: the same with kind.  Removing what
    is not there does nothing.
    """
    after, _ = keyed_edits(files, log, ["doc_id", "name"], names, None, None)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))
    return after.withColumn("place", place).drop("ord", "touched")


def text_edits(items: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Text items after edits of their runs, with offsets repaired, and the edits refused.

    ``items``: doc_id, page, seq, str, x, y, width, height, offset; ``log``: doc_id, page,
    seq (null for added text), ord, kind (``editText`` rewrites a run in place,
    ``replaceText`` empties it and draws the text over the page at the same place,
    ``addText`` draws it at x, y) and text.  A run that is not there, or was emptied
    before, is refused; so is text that cannot be drawn, whose characters are named.

    What is drawn over a page comes after its runs, in the order of the log.  A run keeps
    its offset plus the growth of the runs before it on the page, a running sum of length
    changes; nothing is laid out again.
    """
    from quire.functions.text import undrawable_characters

    cannot = undrawable_characters(F.col("text"))
    events = log.withColumn(
        "error", F.when(F.size(cannot) > 0, F.concat(F.lit("The font cannot write “"), F.element_at(cannot, 1), F.lit("”.")))
    )
    bad = events.where("error is not null")
    good = events.where("error is null").drop("error")
    runs = items.select("doc_id", "page", "seq", F.lit(True).alias("there"))
    before = Window.partitionBy("doc_id", "page", "seq").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    on_runs = good.where("kind <> 'addText'").join(runs, ["doc_id", "page", "seq"], "left")
    on_runs = on_runs.withColumn("emptied", F.coalesce(F.max(F.col("kind") == "replaceText").over(before), F.lit(False)))
    lost = on_runs.where("there is null or emptied").withColumn("error", F.lit(GONE_TEXT))
    done = on_runs.where("there is not null and not emptied")
    last = done.groupBy("doc_id", "page", "seq").agg(
        F.max_by("text", F.when(F.col("kind") == "editText", F.col("ord"))).alias("rewritten"), F.max(F.col("kind") == "replaceText").alias("emptied")
    )
    changed = items.join(last, ["doc_id", "page", "seq"], "left").withColumn(
        "new", F.when(F.col("emptied"), "").otherwise(F.coalesce("rewritten", "str"))
    )
    # Set evenly, a run grows in its own width.
    advance = F.when(F.length("str") > 0, F.col("width") / F.length("str")).otherwise(F.col("height") * 0.6)
    page = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    grown = F.length("new") - F.length("str")
    kept = changed.select(
        "doc_id", "page", "seq", F.col("new").alias("str"), "x", "y", (advance * F.length("new")).alias("width"), "height",
        (F.col("offset") + F.coalesce(F.sum(grown).over(page), F.lit(0))).alias("offset"), (advance / F.col("height")).alias("share"),
    )
    over = done.where("kind = 'replaceText'").join(
        items.select("doc_id", "page", "seq", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("height").alias("rh"), advance.alias("ra")),
        ["doc_id", "page", "seq"],
    ).select("doc_id", "page", "ord", "text", F.col("rx").alias("x"), F.col("ry").alias("y"), F.col("rh").alias("height"), F.col("ra").alias("advance"))
    ends = kept.groupBy("doc_id", "page").agg(
        F.max("seq").alias("last"), F.max(F.col("offset") + F.length("str") + 1).alias("until"), F.max("height").alias("usual"), F.max("share").alias("share")
    )
    plain = good.where("kind = 'addText'").join(ends.select("doc_id", "page", "usual", "share"), ["doc_id", "page"]).select(
        "doc_id", "page", "ord", "text", "x", "y", F.col("usual").alias("height"), (F.col("usual") * F.col("share")).alias("advance")
    )
    log_order = Window.partitionBy("doc_id", "page").orderBy("ord")
    ahead = log_order.rowsBetween(Window.unboundedPreceding, -1)
    drawn = (
        over.unionByName(plain).join(ends.select("doc_id", "page", "last", "until"), ["doc_id", "page"])
        .select(
            "doc_id", "page", (F.col("last") + F.row_number().over(log_order)).alias("seq"), F.col("text").alias("str"), "x", "y",
            (F.col("advance") * F.length("text")).alias("width"), "height",
            (F.col("until") + F.coalesce(F.sum(F.length("text") + 1).over(ahead), F.lit(0))).alias("offset"),
        )
    )
    nowhere = good.where("kind = 'addText'").join(ends.select("doc_id", "page"), ["doc_id", "page"], "left_anti").withColumn("error", F.lit(GONE_PAGE))
    refused = [f.select("doc_id", "page", "ord", "error") for f in (bad, lost, nowhere)]
    return kept.drop("share").unionByName(drawn), refused[0].unionByName(refused[1]).unionByName(refused[2])


def without_tagged(operations: DataFrame, tags: list[str]) -> DataFrame:
    """Page content without the blocks of these tags: ``doc_id, page, seq, operator, tag``.

    ``operations``: one row each, in the order of ``seq``; ``BDC`` and ``BMC`` open a block
    and ``EMC`` closes the last one open.  A block goes whole, with the blocks inside it;
    an end without a beginning stays, and a block without an end stays with all inside.

    A running sum of openings and ends is the depth; an opening and the next end at its
    depth are a block.  A second running sum over the blocks to go tells what is inside.
    """
    page = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens, closes = F.col("operator").isin("BDC", "BMC"), F.col("operator") == "EMC"
    deep = operations.withColumn("depth", F.sum(F.when(opens, 1).when(closes, -1).otherwise(0)).over(page))
    marks = deep.where(opens | closes).withColumn("level", F.when(opens, F.col("depth") - 1).otherwise(F.col("depth")))
    at_level = Window.partitionBy("doc_id", "page", "level").orderBy("seq")
    paired = marks.withColumn("end", F.when(F.lead("operator").over(at_level) == "EMC", F.lead("seq").over(at_level)))
    wanted = paired.where(opens & F.col("tag").isin(tags)).select("doc_id", "page", "seq", "end")
    # Inside a block that never ends nothing is taken out; a block is inside an earlier one that ends later.
    earlier = Window.partitionBy("doc_id", "page").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    outer = wanted.withColumn("held", F.max("end").over(earlier))
    endless = outer.where(F.col("end").isNull() & (F.col("held").isNull() | (F.col("held") < F.col("seq")))).groupBy("doc_id", "page").agg(F.min("seq").alias("endless"))
    blocks = outer.where("end is not null").join(endless, ["doc_id", "page"], "left").where("endless is null or seq < endless")
    edges = blocks.select("doc_id", "page", "seq", F.lit(1).alias("step")).unionByName(blocks.select("doc_id", "page", F.col("end").alias("seq"), F.lit(-1).alias("step")))
    stepped = operations.join(edges, ["doc_id", "page", "seq"], "left")
    inside = F.sum(F.coalesce("step", F.lit(0))).over(page)
    return (
        stepped.withColumn("inside", inside).where("inside = 0 and step is null").select("doc_id", "page", "seq", "operator", "tag")
    )


GONE_PICTURE = "That picture is no longer on the page."


def placement_edits(placements: DataFrame, log: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pictures of pages after they were placed anew, deleted or added, in drawing order, and the edits refused.

    ``placements``: doc_id, page, picture, ord and x, y, width, height, rotation; ``log``: the
    same with kind.  A picture keeps its place in the drawing order when it is moved; one
    added comes on top.  A box without an area is refused.
    """
    fields = ["x", "y", "width", "height", "rotation"]
    flat = F.when((F.col("width") <= 0) | (F.col("height") <= 0), F.lit("A picture needs a width and a height."))
    bare = F.when((F.col("kind") == ADD) & (F.col("width").isNull() | F.col("height").isNull()), F.lit("A picture needs a width and a height."))
    after, refused = keyed_edits(
        placements, _on_pages(log, pages), ["doc_id", "page", "picture"], fields, "That picture is already on the page.", GONE_PICTURE,
        F.coalesce(_page_problem(), flat, bare),
    )
    # What was there first is drawn first, whatever moved since; then what was added, in time.
    began = F.row_number().over(Window.partitionBy("doc_id", "page").orderBy(F.asc_nulls_last("ord"), "touched"))
    return after.select("doc_id", "page", "picture", began.alias("place"), *fields), refused


def setting_edits(settings: DataFrame, changes: DataFrame, targets: DataFrame, gone: str) -> tuple[DataFrame, DataFrame]:
    """Settings by name after changes (the last word counts, a blank clears), and the changes refused.

    ``settings``: doc_id, kind, name, value (field tooltips, tab orders of pages, layers
    shown at first, whether a title is displayed); ``changes``: the same with ord;
    ``targets``: doc_id, kind, name of what can be set.  A change of what is not there is
    refused with ``gone``, and the others of the same log still count.
    """
    keys = ["doc_id", "kind", "name"]
    known = targets.select(*keys).distinct().withColumn("there", F.lit(True))
    asked = changes.join(known, keys, "left")
    last = asked.where("there").groupBy(*keys).agg(F.max_by(F.trim(F.coalesce("value", F.lit(""))), "ord").alias("new"))
    after = settings.join(last, keys, "full").select(*keys, F.coalesce("new", "value").alias("value")).where("value <> ''")
    return after, asked.where("there is null").select(*keys, "ord", F.lit(gone).alias("error"))
