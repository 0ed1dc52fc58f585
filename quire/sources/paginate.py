"""Text documents laid out as pages of positioned lines (fixed-pitch type).

One document is one row and stays one row until its pages are exploded, so the
whole layout runs without a shuffle: wrapping is a greedy regular expression,
pages are slices of the line array, and positions follow from the line number.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.text import BLANKS as TEXT_BLANKS
from quire.functions.text import blank_led_words, drawable, unevenly_spaced

# Paper in points, portrait.
PAPER = {
    "a3": (841.89, 1190.55),
    "a4": (595.28, 841.89),
    "a5": (419.53, 595.28),
    "letter": (612.0, 792.0),
    "legal": (612.0, 1008.0),
    "tabloid": (792.0, 1224.0),
}


@dataclass(frozen=True)
class PageSetup:
    paper: str = "a4"
    landscape: bool = False
    margin: float = 36.0
    font_size: float = 11.0
    line_height: float = 1.4
    pitch: float = 0.6  # of the font size

    @property
    def size(self) -> tuple[float, float]:
        width, height = PAPER[self.paper]
        return (height, width) if self.landscape else (width, height)

    @property
    def box(self) -> tuple[float, float, float, float]:
        """x, y, width, height of the text area; a margin never eats the page."""
        width, height = self.size
        margin = max(0.0, min(self.margin, width / 2 - 24, height / 2 - 24))
        return margin, margin, max(24.0, width - margin * 2), max(24.0, height - margin * 2)

    @property
    def leading(self) -> float:
        return self.font_size * self.line_height

    @property
    def advance(self) -> float:
        return self.font_size * self.pitch

    @property
    def columns(self) -> int:
        usable = max(1.0, self.box[2] - self.font_size * 0.7)
        return max(1, math.floor(usable / self.advance + 1e-9))

    @property
    def lines_per_page(self) -> int:
        return max(1, math.floor(self.box[3] / self.leading))


A4 = PageSetup()
# After mapping to drawable text only these two blanks are left besides breaks.
BLANKS = " \u00a0"
SPACE = r"[ \u00a0]"
SOLID = r"[^ \u00a0]"
NONE = "array<string>"


def _none() -> Column:
    return F.array().cast(NONE)


def _wrapped_carefully(paragraph: Column, columns: int) -> Column:
    """One paragraph that begins or ends with blanks.

    Leading blanks stay on the first line: a run longer than a line fills lines
    of its own, and a run that leaves no room for the first word stands alone.
    """
    lead = F.length(paragraph) - F.length(F.ltrim(paragraph, F.lit(BLANKS)))
    word = F.length(F.regexp_extract(paragraph, f"^{SPACE}*({SOLID}*)", 1))
    facts = F.struct(
        lead.alias("lead"),
        word.alias("word"),
        F.greatest(F.floor((lead - 1) / columns), F.lit(0)).cast("int").alias("filled"),
    )

    def finish(fact: Column) -> Column:
        rest = fact["lead"] - fact["filled"] * columns
        alone = (rest > 0) & (fact["word"] > 0) & (rest + fact["word"] > columns)
        skip = F.when(alone, fact["lead"]).otherwise(fact["filled"] * columns)
        body = F.substring(paragraph, skip + 1, F.length(paragraph))
        pieces = F.regexp_extract_all(
            body, F.lit(f".{{1,{columns}}}(?:{SPACE}+|$)|.{{{columns}}}"), F.lit(0)
        )
        last = F.coalesce(F.try_element_at(pieces, F.lit(-1)), F.lit(""))
        # Blanks that no longer fit at the very end open one more, empty, line.
        overflow = (F.length(last) > columns) & (F.rtrim(last, F.lit(BLANKS)) != last)
        return F.concat(
            F.when(
                fact["filled"] > 0,
                F.transform(
                    F.sequence(F.lit(0), fact["filled"] - 1),
                    lambda i: F.substring(paragraph, i * columns + 1, F.lit(columns)),
                ),
            ).otherwise(_none()),
            F.when(alone, F.array(F.lit(""))).otherwise(_none()),
            F.transform(pieces, lambda piece: F.rtrim(piece, F.lit(BLANKS))),
            F.when(overflow, F.array(F.lit(""))).otherwise(_none()),
        )

    # A one-element transform binds the facts once.
    return F.when(paragraph == "", F.array(F.lit(""))).otherwise(
        F.flatten(F.transform(F.array(facts), finish))
    )


def wrapped_text(text: Column, columns: int) -> Column:
    """All lines of drawable text, wrapped greedily to ``columns`` characters.

    A line is the longest text that ends before a blank or at the author's own
    break; a longer word is cut; blanks at a break go.  Where no line begins or
    ends with a blank, one pass of one expression over the whole text does it.
    """
    plain = F.transform(
        F.regexp_extract_all(
            text, F.lit(f"(?m).{{1,{columns}}}(?:{SPACE}+|$)|.{{{columns}}}|^$"), F.lit(0)
        ),
        lambda piece: F.rtrim(piece, F.lit(BLANKS)),
    )
    last_break = F.when(F.right(text, F.lit(1)).isin("\n", "\r"), F.array(F.lit(""))).otherwise(_none())
    careful = F.flatten(
        F.transform(
            F.split(text, r"\r\n|\r|\n", -1), lambda p: _wrapped_carefully(p, columns)
        )
    )
    return (
        F.when(text == "", F.array(F.lit("")))
        .when(text.rlike(rf"(?m)^{SPACE}|{SPACE}$"), careful)
        .otherwise(F.concat(plain, last_break))
    )


def _wrapped(documents: DataFrame, setup: PageSetup) -> DataFrame:
    """``doc_id, all_lines, page_count``: one row per document."""
    return (
        documents.select(
            "doc_id",
            drawable(F.when(F.col("text") == "", F.lit(" ")).otherwise(F.col("text"))).alias("drawn"),
        )
        .select("doc_id", wrapped_text(F.col("drawn"), setup.columns).alias("all_lines"))
        .select(
            "doc_id",
            "all_lines",
            F.greatest(F.ceil(F.size("all_lines") / setup.lines_per_page), F.lit(1)).cast("int").alias("page_count"),
        )
    )


def page_counts(documents: DataFrame, setup: PageSetup = A4) -> DataFrame:
    """``doc_id, page_count``: the pages ``paginate`` makes, without making them."""
    return _wrapped(documents, setup).select("doc_id", "page_count")


def page_lines(documents: DataFrame, setup: PageSetup = A4) -> DataFrame:
    """``doc_id, page_count, page, lines``: one row per page, no shuffle."""
    per_page = setup.lines_per_page
    return (
        _wrapped(documents, setup)
        .withColumn("page", F.explode(F.sequence(F.lit(1), F.col("page_count"))))
        .select(
            "doc_id",
            "page_count",
            "page",
            F.slice("all_lines", (F.col("page") - 1) * per_page + 1, F.lit(per_page)).alias("lines"),
        )
    )


def paginate(documents: DataFrame, setup: PageSetup = A4) -> DataFrame:
    """``doc_id, page_count, page, text, items``: pages with their positioned items.

    Items stay nested in the page row, so searching a page and finding the boxes
    of a match need no join.
    """
    x, y, _, height = setup.box
    numbered = page_lines(documents, setup).select(
        "doc_id",
        "page_count",
        "page",
        F.filter(
            F.transform("lines", lambda line, i: F.struct(line.alias("str"), i.alias("line"))),
            lambda entry: entry["str"] != "",
        ).alias("drawn"),
    )
    measured = numbered.select(
        "*",
        F.aggregate(
            F.transform("drawn", lambda entry: F.length(entry["str"])),
            F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
            lambda state, n: F.struct(
                (state["at"] + n + 1).alias("at"),
                F.array_append(state["out"], state["at"]).alias("out"),
            ),
            lambda state: state["out"],
        ).alias("starts"),
        F.size("drawn").alias("n"),
    )
    items = F.transform(
        F.arrays_zip("drawn", "starts"),
        lambda entry, i: F.struct(
            i.alias("seq"),
            entry["drawn"]["str"].alias("str"),
            F.lit(x).alias("x"),
            (
                F.lit(y + height)
                - F.lit(setup.leading) * (entry["drawn"]["line"] + 1)
                + F.lit(setup.font_size * 0.25)
            ).alias("y"),
            (F.length(entry["drawn"]["str"]) * F.lit(setup.advance)).alias("width"),
            F.lit(setup.font_size).alias("height"),
            (i + 1 < F.col("n")).alias("has_eol"),
            entry["starts"].alias("offset"),
        ),
    )
    return measured.select(
        "doc_id",
        "page_count",
        "page",
        F.array_join("drawn.str", "\n").alias("text"),
        items.alias("items"),
    )


def text_items(pages: DataFrame) -> DataFrame:
    """The flat item table of pages with nested items."""
    return pages.select("doc_id", "page", F.inline("items"))


def word_rows(pages: DataFrame) -> DataFrame:
    """One row per word, as a scanner or another producer would draw them.

    ``doc_id, page, page_row, seq, str, x, y, width, height``: the words of a page row stay
    one after another.  Lines leave the row before their words are cut, so all of it is
    plain projection.  A word's place is told by the text before it; with single spaces,
    which is nearly all text, that is what comes before the space.
    """
    at, piece = F.col("at"), F.col("piece")
    word = F.when(F.col("odd"), F.ltrim(piece, F.lit(TEXT_BLANKS))).otherwise(piece)
    before = F.when(
        F.col("odd"),
        F.length(F.array_join(F.slice(blank_led_words(F.col("whole")), 1, at + 1), "")) - F.length("str"),
    ).otherwise(F.when(at == 0, 0).otherwise(F.length(F.call_function("substring_index", F.col("whole"), F.lit(" "), at)) + 1))
    advance = F.col("width") / F.length("whole")
    return (
        pages.select("doc_id", "page", "items", F.monotonically_increasing_id().alias("page_row"))
        .select("doc_id", "page", "page_row", F.inline("items"))
        .select(
            "doc_id", "page", "page_row", "seq", F.col("str").alias("whole"), "x", "y", "width", "height",
            unevenly_spaced(F.col("str")).alias("odd"),
        )
        .select("*", F.posexplode(F.when(F.col("odd"), blank_led_words(F.col("whole"))).otherwise(F.split("whole", " "))).alias("at", "piece"))
        .select("*", word.alias("str"))
        .select(
            "doc_id", "page", "page_row", (F.col("seq") * 1000 + at).cast("int").alias("seq"), "str",
            (F.col("x") + before * advance).alias("x"), "y", (F.length("str") * advance).alias("width"), "height",
        )
    )
