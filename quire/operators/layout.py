"""Reading a page's geometry: lines, paragraphs, headings, tables, spaced text."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.functions import let
from quire.functions.numbers import cell_number, half_up
from quire.functions.text import BLANKS, collapsed, is_blank, trimmed, trimmed_end

PAGE = ["doc_id", "page"]
ITEM = ["seq", "str", "x", "y", "width", "height"]
# Fixed values of the reading rules.
LINE_SHARE, LINE_MINIMUM = 0.5, 1.5
WORD_GAP = 0.2
BLOCK_GAP, BLOCK_INDENT, BLOCK_RESIZE = 1.6, 0.9, 0.25
HEADING_SHARE, HEADING_LINES = 1.25, 3
COLUMN_GAP, COLUMN_MINIMUM, COLUMN_GRID, COLUMN_SLACK = 0.9, 6.0, 4, 4
COLUMN_SHARE = 0.6
# The blanks of the data model as a class for Arrow's expressions.
_CLASS = r"[\t-\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
_MEMBER = "struct<x:double,i:int,str:string,width:double,height:double>"
_LINE = "struct<line:int,text:string,y:double,left:double,right:double,height:double,n:int{}>"


def page_rows(items: DataFrame) -> DataFrame:
    """Items that come as rows, gathered to one row a page (a page holds what fits on it)."""
    return items.groupBy(*PAGE).agg(F.collect_list(F.struct(*ITEM)).alias("items"))


def item_rows(pages: DataFrame) -> DataFrame:
    """The items of page rows as rows; ``page_row`` keeps the rows of a page row together."""
    told = pages.select(*PAGE, "items", F.monotonically_increasing_id().alias("page_row"))
    return told.select(*PAGE, "page_row", F.inline("items")).select(*PAGE, "page_row", *ITEM)


def gathered_rows(items: DataFrame) -> DataFrame:
    """Items of any order, those of a page brought together: one shuffle, no lists."""
    return items.repartition(*PAGE).sortWithinPartitions(*PAGE)


def _fold_lines(y: np.ndarray, height: np.ndarray, first: np.ndarray) -> list[int]:
    """Where lines open, items sorted downwards: one near the open line's *first* item joins it."""
    found, anchor = [], 0.0
    reach = np.maximum(LINE_MINIMUM, height * LINE_SHARE)
    for i, (at, near, new) in enumerate(zip(y.tolist(), reach.tolist(), first.tolist())):
        if new or not anchor - at <= near:
            anchor = at
            found.append(i)
    return found


def _changes(columns: list[pa.ChunkedArray]) -> np.ndarray:
    """Rows whose key is another than that of the row before; the first row counts."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for column in columns:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        other = pc.fill_null(pc.not_equal(a, b), pc.xor(pc.is_null(a), pc.is_null(b)))
        out[1:] |= other.to_numpy(zero_copy_only=False).astype(bool)
    return out


def _pages_of_lines(items: pa.Table, keys: list[str], members: bool, out: pa.Schema) -> pa.RecordBatch:
    """Whole pages of items, read as lines: one row a page."""
    def number(name: str) -> np.ndarray:
        return items[name].combine_chunks().to_numpy(zero_copy_only=False).astype(float)

    begins = _changes([items[k] for k in keys])
    page = np.cumsum(begins)
    x, y, width, height = (number(n) for n in ("x", "y", "width", "height"))
    seq = items["seq"].combine_chunks().to_numpy(zero_copy_only=False)
    order = np.lexsort((seq, x, -y, page))
    same = lambda a: a[order][1:] == a[order][:-1]
    if (same(page) & same(y) & same(x) & same(seq)).any():
        # Items of one place and number: the rest of the row decides.
        text = items["str"].to_pylist()
        order = np.array(sorted(order.tolist(), key=lambda i: (page[i], -y[i], x[i], seq[i], text[i].encode(), width[i], height[i])))
    page, x, y, width, height = (a[order] for a in (page, x, y, width, height))
    first = np.ones(len(page), bool)
    first[1:] = page[1:] != page[:-1]
    starts = np.array(_fold_lines(y, height, first))
    line = np.zeros(len(page), np.int64)
    line[starts] = 1
    line = np.cumsum(line)
    top = y[starts]
    place = np.arange(len(page)) - starts[line - 1]

    # From left to right inside each line.
    across = np.lexsort((x, line))
    x, width, height, place, order = (a[across] for a in (x, width, height, place, order))
    text = items["str"].combine_chunks().take(pa.array(order))
    opens = np.zeros(len(page), bool)
    opens[starts] = True
    end = x + width
    spaced = np.zeros(len(page), bool)
    spaced[1:] = x[1:] - end[:-1] > np.maximum(1.0, np.minimum(height[:-1], height[1:])) * WORD_GAP
    spaced &= ~opens
    edged = pc.match_substring_regex(text, rf"\A{_CLASS}|{_CLASS}\z").to_numpy(zero_copy_only=False)
    if edged.any():
        spaced &= ~pc.match_substring_regex(text, rf"\A{_CLASS}").to_numpy(zero_copy_only=False)
        ends = pc.match_substring_regex(text, rf"{_CLASS}\z").to_numpy(zero_copy_only=False)
        spaced[1:] &= ~ends[:-1]
    gaps = pa.array([" ", ""]).take(pa.array(np.where(spaced, 0, 1)))
    bounds = pa.array(np.append(starts, len(page)), pa.int32())
    joined = pc.binary_join(pa.ListArray.from_arrays(bounds, pc.binary_join_element_wise(gaps, text, "")), "")
    if pc.any(pc.match_substring_regex(joined, rf"{_CLASS.replace(' ', '')}|  |\A | \z")).as_py():
        joined = pc.utf8_trim(pc.replace_substring_regex(joined, f"{_CLASS}+", " "), BLANKS)

    new_page = first[starts]
    number_of = np.arange(len(starts)) - np.maximum.accumulate(np.where(new_page, np.arange(len(starts)), 0)) + 1
    kind = out.field("lines").type.value_type
    columns = [
        pa.array(number_of, pa.int32()), joined, pa.array(top), pa.array(np.minimum.reduceat(x, starts)),
        pa.array(np.maximum.reduceat(end, starts)), pa.array(np.maximum.reduceat(height, starts)),
        pa.array(np.diff(np.append(starts, len(page))), pa.int32()),
    ]
    if members:
        parts = [pa.array(x), pa.array(place, pa.int32()), text, pa.array(width), pa.array(height)]
        inner = kind.field("items").type
        columns.append(pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(parts, fields=list(inner.value_type)), type=inner))
    rows = pa.StructArray.from_arrays(columns, fields=list(kind))
    pages = pa.ListArray.from_arrays(pa.array(np.append(np.flatnonzero(new_page), len(starts)), pa.int32()), rows, type=out.field("lines").type)
    heads = items.select(PAGE).take(pa.array(np.flatnonzero(begins)))
    return pa.RecordBatch.from_arrays([*(heads[c].combine_chunks() for c in PAGE), pages], schema=out)


def line_pages(items: DataFrame, members: bool = True) -> DataFrame:
    """``doc_id, page, lines``: one row a page, its lines in order.

    ``items``: rows (doc_id, page, seq, str, x, y, width, height) with those of a page one
    after another (``item_rows``, ``gathered_rows``).  The lines of a page are an ordered fold,
    so it runs over Arrow batches, with the rest of the line worked out in whole columns;
    a task holds a batch and the page that is not yet whole.  ``members`` false leaves
    out the items of the lines.
    """
    keys = ["page_row"] if "page_row" in items.columns else PAGE
    kind = T.DataType.fromDDL(f"array<{_LINE.format(f',items:array<{_MEMBER}>' if members else '')}>")
    schema = T.StructType([*(items.schema[c] for c in PAGE), T.StructField("lines", kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out, waiting = to_arrow_schema(schema), []
        for batch in batches:
            if not batch.num_rows:
                continue
            seam = pa.Table.from_batches([waiting[-1].slice(waiting[-1].num_rows - 1), batch] if waiting else [batch])
            begins = np.flatnonzero(_changes([seam[k] for k in keys])[1:]) + (0 if waiting else 1)
            if not len(begins):
                waiting.append(batch)
                continue
            yield _pages_of_lines(pa.Table.from_batches([*waiting, batch.slice(0, begins[-1])]), keys, members, out)
            waiting = [batch.slice(begins[-1])]
        if waiting:
            yield _pages_of_lines(pa.Table.from_batches(waiting), keys, members, out)

    told = items.where(~is_blank(F.col("str"))).select(
        *dict.fromkeys([*PAGE, *keys]), F.col("seq").cast("long").alias("seq"), "str",
        *[F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "height")],
    )
    return told.mapInArrow(run, schema)


def lines(pages: DataFrame) -> DataFrame:
    """``doc_id, page, line, text, y, left, right, height, items`` of page rows with nested items."""
    return line_rows(line_pages(item_rows(pages)))


def line_rows(pages: DataFrame, count: str | None = None) -> DataFrame:
    """The lines of page rows as rows; ``count`` names a column for the number of their items."""
    found = pages.select(*PAGE, F.inline("lines"))
    return found.withColumnRenamed("n", count) if count else found.drop("n")


def gathered_lines(page_lines: DataFrame, fields: list[str]) -> DataFrame:
    """Lines as page rows, in order; page rows stay as they are, line rows are gathered."""
    if "lines" in page_lines.columns:
        return page_lines
    return page_lines.groupBy(*PAGE).agg(F.sort_array(F.collect_list(F.struct("line", *fields))).alias("lines"))


def _median(values: Column) -> Column:
    """The mean of the middle two."""
    return let(
        F.sort_array(values),
        lambda v: (F.element_at(v, F.floor((F.size(v) + 1) / 2).cast("int")) + F.element_at(v, F.floor(F.size(v) / 2).cast("int") + 1)) / 2,
    )


def paragraphs(lines: Column) -> Column:
    """The paragraphs of a page's lines: an array, worked out inside the row; no lines have none."""

    def starts(lines: Column) -> Column:
        """Places (from 1) where a paragraph begins, and one past the end."""

        def begins(i: Column) -> Column:
            def against(pair: Column) -> Column:
                above, here = pair["above"], pair["here"]
                spacing = pair["spacing"]
                return (
                    (above["y"] - here["y"] > spacing * BLOCK_GAP)
                    | (F.abs(here["left"] - above["left"]) > spacing * BLOCK_INDENT)
                    | (F.abs(here["height"] - above["height"]) > F.greatest(F.lit(1.0), spacing * BLOCK_RESIZE))
                )

            above, here = F.get(lines, i - 2), F.get(lines, i - 1)
            pair = F.struct(above.alias("above"), here.alias("here"), F.greatest(above["height"], here["height"]).alias("spacing"))
            return (i == 1) | F.coalesce(let(pair, against), F.lit(True))

        return F.array_append(F.filter(F.sequence(F.lit(1), F.size(lines)), begins), F.size(lines) + 1)

    def block(rows: Column, k: Column, body: Column) -> Column:
        height = F.array_max(F.transform(rows, lambda r: r["height"]))
        return F.struct(
            (k + 1).cast("bigint").alias("block"),
            F.array_join(F.transform(rows, lambda r: r["text"]), " ").alias("joined"),
            height.alias("height"),
            F.array_min(F.transform(rows, lambda r: r["left"])).alias("left"),
            F.array_max(F.transform(rows, lambda r: r["right"])).alias("right"),
            F.array_max(F.transform(rows, lambda r: r["y"])).alias("top_y"),
            F.size(rows).cast("bigint").alias("lines"),
            body.alias("body"),
        )

    def shared(fact: Column) -> Column:
        at, all_lines = fact["at"], fact["lines"]
        return F.transform(
            F.slice(at, 1, F.size(at) - 1),
            lambda s, k: let(F.slice(all_lines, s, F.get(at, k + 1) - s), lambda rows: block(rows, k, fact["body"])),
        )

    facts = F.struct(
        lines.alias("lines"), starts(lines).alias("at"), _median(F.transform(lines, lambda r: r["height"])).alias("body")
    )
    found = F.transform(
        let(facts, shared),
        lambda b: F.struct(
            b["block"].alias("block"), collapsed(b["joined"]).alias("text"), *[b[c].alias(c) for c in ("height", "left", "right", "top_y", "lines")],
            ((b["height"] > b["body"] * HEADING_SHARE) & (b["lines"] <= HEADING_LINES)).alias("heading"),
        ),
    )
    return F.when(F.size(lines) > 0, found)


def blocks(page_lines: DataFrame) -> DataFrame:
    """Paragraphs: ``doc_id, page, block, text, height, left, right, top_y, lines, heading``.

    Worked out inside the page row; nothing is shuffled when ``page_lines`` are page rows.
    """
    pages = gathered_lines(page_lines, ["text", "y", "left", "right", "height"])
    return pages.select(*PAGE, F.inline(paragraphs(F.col("lines"))))


def column_starts(items: Column, height: Column) -> Column:
    """The left edges of a line's first item and of items after a wide gap."""
    kept = F.filter(
        items,
        lambda item, i: (i == 0)
        | let(
            F.element_at(items, F.greatest(i, F.lit(1))),
            lambda before: item["x"] - (before["x"] + before["width"])
            > F.greatest(F.lit(COLUMN_MINIMUM), height * COLUMN_GAP),
        ),
    )
    return F.transform(kept, lambda item: item["x"])


def shaped_pages(page_lines: DataFrame) -> DataFrame:
    """One row per page: ``doc_id, page, columns, lines``.

    ``columns`` are the table's column edges, empty when the page has no table;
    each line carries ``in_table``.  A page is gathered once (it holds what fits
    on a page) and everything about its table is worked out inside the row, so
    the lines are read a single time and nothing is joined back.
    """
    starts = lambda r: F.when(F.size(r["items"]) >= 2, column_starts(r["items"], r["height"])).otherwise(
        F.array().cast("array<double>")
    )
    kept = ("line", "text", "y", "left", "right", "height", "items")
    gathered = gathered_lines(page_lines, list(kept[1:])).select(
        *PAGE,
        F.transform("lines", lambda r: F.struct(*[r[c].alias(c) for c in kept], starts(r).alias("starts"))).alias("lines"),
    )
    facts = gathered.select(
        "*",
        F.size(F.filter("lines", lambda r: F.size(r["items"]) >= 2)).alias("candidates"),
        F.size(F.filter("lines", lambda r: F.size(r["starts"]) >= 2)).alias("table_rows"),
        F.flatten(
            F.transform(
                "lines",
                lambda r: F.transform(r["starts"], lambda x: half_up(x / COLUMN_GRID) * COLUMN_GRID),
            )
        ).alias("edges"),
    )
    shared = F.filter(
        F.array_distinct("edges"),
        lambda e: F.size(F.filter("edges", lambda other: other == e))
        >= F.greatest(F.lit(2), F.ceil(F.col("candidates") * COLUMN_SHARE)),
    )
    found = facts.select(
        *PAGE,
        "lines",
        F.when((F.col("candidates") >= 3) & (F.col("table_rows") >= 3), F.sort_array(shared))
        .otherwise(F.array().cast("array<bigint>"))
        .alias("edges"),
    ).withColumn(
        "columns", F.when(F.size("edges") >= 2, F.col("edges")).otherwise(F.array().cast("array<bigint>"))
    )
    return found.select(
        *PAGE,
        "columns",
        F.transform(
            "lines",
            lambda r: r.withField(
                "in_table", (F.size("columns") >= 2) & (F.size(r["starts"]) >= 2)
            ).dropFields("starts"),
        ).alias("lines"),
    )


def cells(items: Column, columns: Column) -> Column:
    """A line's items shared out: each to the last column beginning at or before it."""
    placed = F.transform(
        items,
        lambda item: F.struct(
            F.greatest(F.size(F.filter(columns, lambda e: e <= item["x"] + COLUMN_SLACK)) - 1, F.lit(0)).alias("at"),
            trimmed(item["str"]).alias("str"),
        ),
    )
    return let(
        placed,
        lambda all_placed: F.transform(
            columns,
            lambda _, i: collapsed(
                F.array_join(
                    F.transform(F.filter(all_placed, lambda p: p["at"] == i), lambda p: p["str"]), " "
                )
            ),
        ),
    )


def page_text(page_lines: DataFrame) -> DataFrame:
    """The words of a page, one line of the page a line."""
    return gathered_lines(page_lines, ["text"]).select(
        *PAGE, trimmed(F.array_join(F.transform("lines", lambda r: r["text"]), "\n")).alias("text")
    )


def spaced_page_text(page_lines: DataFrame) -> DataFrame:
    """The words of a page where they sit: columns by character, blank lines kept."""

    def spaced(items: Column, width: Column) -> Column:
        return F.aggregate(
            items,
            F.lit(""),
            lambda text, item: let(
                F.greatest(F.lit(0), half_up(item["x"] / width)).cast("int"),
                lambda column: F.concat(
                    F.when(column > F.length(text), F.rpad(text, column, F.lit(" ")))
                    .when((text != "") & ~F.endswith(text, F.lit(" ")), F.concat(text, F.lit(" ")))
                    .otherwise(text),
                    trimmed(item["str"]),
                ),
            ),
        )

    def blanks(above: Column, here: Column) -> Column:
        gap = half_up((above["y"] - here["y"]) / F.greatest(above["height"], here["height"])) - 1
        return F.coalesce(F.least(F.lit(4), F.greatest(F.lit(0), gap)), F.lit(0)).cast("int")

    measured = gathered_lines(page_lines, ["text", "y", "height", "items"]).withColumn(
        "width", _median(F.transform("lines", lambda r: r["height"])) * 0.5
    )
    shown = F.transform(
        "lines",
        lambda r, i: F.when(
            F.col("width") > 0,
            F.concat(
                F.repeat(F.lit("\n"), F.when(i > 0, blanks(F.get(F.col("lines"), i - 1), r)).otherwise(F.lit(0))),
                trimmed_end(spaced(r["items"], F.col("width"))),
            ),
        ).otherwise(r["text"]),
    )
    return measured.select(*PAGE, trimmed(F.array_join(shown, "\n")).alias("text"))


def sheet_rows(page_lines: DataFrame) -> DataFrame:
    """Spreadsheet rows: the table's cells where a page has a table, else a line a row.

    ``doc_id, page, line, column, text, number`` (number where the cell reads as one).
    """
    has_table = F.size("columns") >= 2
    shown = shaped_pages(page_lines).select(
        *PAGE,
        has_table.alias("has_table"),
        F.explode(
            F.transform(
                F.filter("lines", lambda r: ~has_table | r["in_table"]),
                lambda r: F.struct(
                    r["line"].alias("line"),
                    F.when(has_table, cells(r["items"], F.col("columns")))
                    .otherwise(F.array(r["text"]))
                    .alias("cells"),
                ),
            )
        ).alias("row"),
    )
    return shown.select(
        *PAGE, "has_table", "row.line", F.posexplode("row.cells").alias("column", "text")
    ).select(
        *PAGE,
        "line",
        "column",
        "text",
        F.when(F.col("has_table"), cell_number(F.col("text"))).alias("number"),
    )


def document_paragraphs(page_lines: DataFrame) -> DataFrame:
    """Word-processor paragraphs: blocks of the lines outside the table, then its rows.

    ``doc_id, page, part, ord, heading, half_points, text``
    """
    pages = shaped_pages(page_lines).select(
        *PAGE, "columns",
        paragraphs(F.filter("lines", lambda r: ~r["in_table"])).alias("body"),
        F.filter("lines", lambda r: r["in_table"]).alias("rows"),
    )
    body = F.transform(
        "body",
        lambda b: F.struct(
            F.lit("block").alias("part"), b["block"].cast("int").alias("ord"), b["heading"].alias("heading"),
            half_up(b["height"] * 2).cast("int").alias("half_points"), b["text"].alias("text"),
        ),
    )
    table = F.transform(
        "rows",
        lambda r: F.struct(
            F.lit("table").alias("part"), r["line"].alias("ord"), F.lit(False).alias("heading"),
            F.lit(None).cast("int").alias("half_points"), F.array_join(cells(r["items"], F.col("columns")), "\t").alias("text"),
        ),
    )
    # Both parts leave the row together, so the lines are read once.
    parts = F.when(F.col("body").isNull(), table).otherwise(F.concat(body, table))
    return pages.select(*PAGE, F.inline(parts))


def slide_boxes(page_blocks: DataFrame, page_height: float) -> DataFrame:
    """Slide text boxes in inches from the top left."""
    return page_blocks.select(
        *PAGE,
        "block",
        "text",
        (F.col("left") / 72).alias("x"),
        ((F.lit(page_height) - F.col("top_y") - F.col("height")) / 72).alias("y"),
        F.greatest(F.lit(0.5), (F.col("right") - F.col("left")) / 72).alias("w"),
        F.greatest(F.lit(0.2), F.col("height") * F.col("lines") * 1.3 / 72).alias("h"),
        F.greatest(F.lit(6), half_up(F.col("height"))).cast("int").alias("font_size"),
        F.col("heading").alias("bold"),
    )
