"""Literal search over pages: offsets, excerpts, highlight boxes, phrase lists."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quire.functions import let, ranges
from quire.functions.text import WORD_CHARACTER, at_word_edge, excerpt, match_starts

RECT = "struct<x:double,y:double,width:double,height:double>"


def match_rects(items: Column, start: Column, end: Column) -> Column:
    """One box per item a match overlaps, by share of the item's characters."""
    hit = F.filter(
        items,
        lambda item: (item["offset"] < end)
        & (item["offset"] + F.length(item["str"]) > start)
        & (item["width"] != 0),
    )
    return F.transform(
        hit,
        lambda item: F.struct(
            (
                item["x"]
                + (F.greatest(start, item["offset"]) - item["offset"])
                * (item["width"] / F.length(item["str"]))
            ).alias("x"),
            item["y"].alias("y"),
            (
                (
                    F.least(end, item["offset"] + F.length(item["str"]))
                    - F.greatest(start, item["offset"])
                )
                * (item["width"] / F.length(item["str"]))
            ).alias("width"),
            item["height"].alias("height"),
        ),
    )


def search_pages(
    pages: DataFrame,
    query: str,
    case_sensitive: bool = False,
    whole_word: bool = False,
    page_range: str = "",
    cap: int | None = None,
) -> DataFrame:
    """Hits of ``query``: ``doc_id, page, start, end, excerpt, rects``.

    A blank query finds nothing; outer spaces of any other query count.  The
    range is applied before the scan of the text.  ``cap`` keeps the first hits
    in (document, page, offset) order.
    """
    if query.strip() == "":
        pages = pages.where(F.lit(False))
    if page_range.strip():
        pages = pages.where(
            ranges.includes(ranges.parsed(F.lit(page_range), F.col("page_count")), F.col("page"))
        )
    hay = F.col("text") if case_sensitive else F.lower("text")
    needle = query if case_sensitive else query.lower()
    hits = (
        pages.where(F.contains(hay, F.lit(needle)))
        .select(
            "doc_id",
            "page",
            "text",
            "items",
            F.explode(match_starts(F.col("text"), query, case_sensitive, whole_word)).alias("start"),
        )
        .withColumn("end", F.col("start") + len(query))
        .select(
            "doc_id",
            "page",
            "start",
            "end",
            excerpt(F.col("text"), F.col("start"), F.col("end")).alias("excerpt"),
            match_rects(F.col("items"), F.col("start"), F.col("end")).alias("rects"),
        )
    )
    if cap is not None:
        hits = hits.orderBy("doc_id", "page", "start").limit(cap)
    return hits


def first_hits(hits: DataFrame, cap: int) -> DataFrame:
    """The first ``cap`` hits in (document, page, offset) order, with ``truncated``: were there more?

    One hit beyond the cap answers that; no more than cap + 1 rows leave each task.
    """
    order = ["doc_id", "page", "start"]
    some = hits.orderBy(*order).limit(cap + 1)
    everything = Window.partitionBy(F.lit(0))
    numbered = some.withColumn("_place", F.row_number().over(everything.orderBy(*order))).withColumn("_met", F.count("*").over(everything))
    return numbered.where(F.col("_place") <= cap).withColumn("truncated", F.col("_met") > cap).drop("_place", "_met")


def rects_by_item_join(hits: DataFrame, items: DataFrame) -> DataFrame:
    """The boxes of hits when items are a table of their own (interval overlap).

    Pages join on (doc_id, page); the interval test runs inside a page.
    """
    end_of_item = F.col("offset") + F.length("str")
    overlap = (F.col("offset") < F.col("end")) & (end_of_item > F.col("start"))
    first = F.greatest("start", "offset")
    last = F.least(F.col("end"), end_of_item)
    per_character = F.col("width") / F.length("str")
    return (
        hits.join(items.where((F.length("str") > 0) & (F.col("width") != 0)), ["doc_id", "page"])
        .where(overlap)
        .select(
            "doc_id",
            "page",
            "start",
            "end",
            "seq",
            (F.col("x") + (first - F.col("offset")) * per_character).alias("x"),
            "y",
            ((last - first) * per_character).alias("width"),
            "height",
        )
    )


# Above this many bytes of phrase text the list is shuffled by anchors, not sent to the
# pages: an automaton takes some fifty bytes a character in every worker.
BROADCAST_BYTES = 2 << 20
GRAM = 3
_WORD, _EDGE = f"{WORD_CHARACTER}+", r"[^\p{L}\p{N}_]"


class Automaton:
    """A phrase list as one automaton (states with failure links), run once over a text."""

    held: dict[int, "Automaton"] = {}

    def __init__(self, phrases: list[tuple[object, str]]):
        self.ids: dict[str, list[object]] = {}
        for phrase_id, folded in phrases:
            self.ids.setdefault(folded, []).append(phrase_id)
        self.machine = ahocorasick.Automaton()
        for folded in self.ids:
            self.machine.add_word(folded, folded)
        self.machine.make_automaton()

    @classmethod
    def of(cls, sent) -> "Automaton":
        """The automaton of a broadcast list, made once in a worker; the last one is kept."""
        if sent.id not in cls.held:
            cls.held = {sent.id: cls(sent.list.value)}
        return cls.held[sent.id]

    def hits(self, text: str | None) -> list[dict]:
        """Every occurrence, overlapping ones too, by phrase: ``phrase_id``, ``start``, ``size``."""
        if not text or not self.ids:
            return []
        return [
            {"phrase_id": i, "start": end - len(found) + 1, "size": len(found)}
            for end, found in self.machine.iter(text) for i in self.ids[found]
        ]


class SentList:
    """A broadcast phrase list under a name of its own."""

    def __init__(self, spark, phrases: list[tuple[object, str]]):
        self.id, self.list = uuid.uuid4().hex, spark.sparkContext.broadcast(phrases)


def automaton_hits(frame: DataFrame, folded: str, phrases: DataFrame) -> DataFrame:
    """Rows of ``frame`` whose text ``folded`` holds a phrase, with ``hits``; rows do not move.

    ``phrases``: phrase_id, folded, of a size that its caller has measured.
    """
    sent = SentList(frame.sparkSession, [(r[0], r[1]) for r in phrases.select("phrase_id", "folded").collect()])
    kind = phrases.schema["phrase_id"].dataType
    hit = T.ArrayType(T.StructType([T.StructField("phrase_id", kind), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())]))
    arrow = to_arrow_type(hit)
    at = frame.columns.index(folded)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton.of(sent)
        for batch in batches:
            hits = [machine.hits(text) for text in batch.column(at).to_pylist()]
            kept = pa.array([bool(h) for h in hits])
            columns = [c.filter(kept) for c in batch.columns] + [pa.array([h for h in hits if h], type=arrow)]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "hits"])

    return frame.mapInArrow(scan, T.StructType([*frame.schema.fields, T.StructField("hits", hit)]))


def _anchored(phrases: DataFrame) -> DataFrame:
    """Each phrase with one anchor that every page with an occurrence has.

    Its longest word with both edges inside the phrase; or else the end of the word it
    begins in, or the beginning of the word it ends in, up to three characters; or else
    the first characters of a phrase inside one word; or its first character, where it
    has no word.
    """
    inner = F.regexp_extract_all("folded", F.lit(f"(?<={_EDGE}){_WORD}(?={_EDGE})"), F.lit(0))
    longest = F.element_at(F.array_sort(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    head, tail = F.regexp_extract("folded", f"^({_WORD}){_EDGE}", 1), F.regexp_extract("folded", f"{_EDGE}({_WORD})$", 1)

    def gram(tag: str, value: Column, take) -> Column:
        size = F.least(F.length(value), F.lit(GRAM))
        return F.concat(F.lit(tag), size.cast("string"), take(value, size))

    inside = F.regexp_extract("folded", f"^{_WORD}$", 0)
    anchor = (
        F.when(F.size(inner) > 0, F.concat(F.lit("w0"), longest))
        .when((head != "") & (F.length(head) >= F.length(tail)), gram("s", head, F.right))
        .when(tail != "", gram("p", tail, F.left))
        .when(inside != "", gram("i", inside, F.left))
        .otherwise(gram("c", F.left("folded", F.lit(1)), F.left))
    )
    return phrases.withColumn("anchor", anchor)


def _anchors_of(folded: Column, tags: list[str]) -> Column:
    """The anchors of the kinds in ``tags`` (``w0``, ``s2`` ...) that a page has, from its distinct words."""
    words = F.array_distinct(F.regexp_extract_all(folded, F.lit(_WORD), F.lit(0)))

    def of_kind(words: Column, tag: str) -> Column:
        kind, size = tag[0], int(tag[1])
        if kind == "c":
            made = F.array_distinct(F.split(folded, ""))
        elif kind == "w":
            made = words
        else:
            long = F.filter(words, lambda w: F.length(w) >= size)
            if kind == "i":
                each = lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - size + 1), lambda i: F.substring(w, i, F.lit(size)))
                made = F.array_distinct(F.flatten(F.transform(long, each)))
            else:
                made = F.array_distinct(F.transform(long, lambda w: (F.right if kind == "s" else F.left)(w, F.lit(size))))
        return F.transform(made, lambda x: F.concat(F.lit(tag), x))

    return let(words, lambda w: F.concat(*[of_kind(w, t) for t in tags]))


def search_phrases(
    pages: DataFrame,
    phrases: DataFrame,
    case_sensitive: bool = False,
    whole_word: bool = False,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Hits of a whole list of phrases: ``phrase_id, doc_id, page, start, end, excerpt``.

    Never pages x phrases.  A list within ``broadcast_bytes`` (measured) becomes an
    automaton that runs once over each page, and no page moves.  A larger list meets the
    pages by anchors in a shuffle of keys alone, and the text is fetched for the pairs
    that matched.  Blank phrases find nothing.
    """
    fold = (lambda c: c) if case_sensitive else F.lower
    listed = (
        phrases.select("phrase_id", "phrase")
        .withColumn("folded", fold(F.col("phrase")))
        .where(F.length(F.regexp_replace("phrase", r"\s", "")) > 0)
    )
    size = listed.agg(F.coalesce(F.sum(F.octet_length("phrase") + 64), F.lit(0))).first()[0]
    if size <= broadcast_bytes:
        texts = pages.select("doc_id", "page", "text", fold(F.col("text")).alias("folded"))
        found = (
            automaton_hits(texts, "folded", listed).select("doc_id", "page", "text", F.explode("hits").alias("hit"))
            .select("hit.phrase_id", "doc_id", "page", "text", "hit.start", (F.col("hit.start") + F.col("hit.size")).alias("end"))
        )
        if whole_word:
            found = found.where(at_word_edge(F.col("text"), F.col("start") - 1) & at_word_edge(F.col("text"), F.col("end")))
    else:
        listed = _anchored(listed)
        tags = [r[0] for r in listed.select(F.left("anchor", F.lit(2))).distinct().collect()]
        keys = (
            pages.select("doc_id", "page", F.explode(_anchors_of(fold(F.col("text")), tags)).alias("anchor"))
            .join(listed.select("anchor", "phrase_id"), "anchor")
            .select("doc_id", "page", "phrase_id")
        )
        paired = keys.join(listed.drop("anchor"), "phrase_id").join(pages.select("doc_id", "page", "text"), ["doc_id", "page"])
        found = paired.where(F.contains(fold(F.col("text")), F.col("folded"))).select(
            "phrase_id", "doc_id", "page", "text", F.length("phrase").alias("size"),
            F.explode(match_starts(F.col("text"), F.col("phrase"), case_sensitive, whole_word)).alias("start"),
        ).withColumn("end", F.col("start") + F.col("size"))
    return found.select(
        "phrase_id", "doc_id", "page", "start", "end", excerpt(F.col("text"), F.col("start"), F.col("end")).alias("excerpt")
    )


def search_summary(pages: DataFrame, hits: DataFrame) -> DataFrame:
    """Per document: pages scanned, pages without text, hits, pages with hits."""
    scanned = pages.groupBy("doc_id").agg(
        F.count("*").alias("scanned"),
        F.count_if(F.trim("text") == "").alias("without_text"),
    )
    # Count per page first: the distinct pages of a document are then plain rows,
    # and no document's hits gather in one task.
    found = (
        hits.groupBy("doc_id", "page")
        .agg(F.count("*").alias("n"))
        .groupBy("doc_id")
        .agg(F.sum("n").alias("hits"), F.count("*").alias("pages_hit"))
    )
    return scanned.join(found, "doc_id", "left").select(
        "doc_id",
        "scanned",
        "without_text",
        F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("pages_hit", F.lit(0)).alias("pages_hit"),
    )


def hit_neighbours(hits: DataFrame, keys: list[str], order: list[str], hit_id: str) -> DataFrame:
    """Each hit with the next and previous one in its group, wrapping round.

    ``hits`` carry ``page``.  Hits are put beside each other within their page; only a
    page's first and last hit look beyond it, on one row per page.
    """
    here = Window.partitionBy(*keys, "page").orderBy(*order)
    inside = hits.withColumn("next_hit", F.lead(hit_id).over(here)).withColumn("previous_hit", F.lag(hit_id).over(here))
    ends = hits.groupBy(*keys, "page").agg(
        F.min_by(hit_id, F.struct(*order)).alias("first"), F.max_by(hit_id, F.struct(*order)).alias("last")
    )
    across = Window.partitionBy(*keys).orderBy("page")
    around = ends.groupBy(*keys).agg(F.min_by("first", "page").alias("top"), F.max_by("last", "page").alias("bottom"))
    beside = (
        ends.select(*keys, "page", F.lead("first").over(across).alias("after"), F.lag("last").over(across).alias("before"))
        .join(around, keys)
    )
    return inside.join(beside, [*keys, "page"]).select(
        *keys,
        hit_id,
        F.coalesce("next_hit", "after", "top").alias("next_hit"),
        F.coalesce("previous_hit", "before", "bottom").alias("previous_hit"),
    )


def initial_hit(hits: DataFrame, group: str, document: Column, page: Column, rank: list[str]) -> DataFrame:
    """Where a search starts: first hit in this document at or after the page,
    else the first in the document, else the first of all (per ``group``)."""
    priority = (
        F.when((F.col("doc_id") == document) & (F.col("page") >= page), 0)
        .when(F.col("doc_id") == document, 1)
        .otherwise(2)
    )
    key = F.struct(priority.alias("priority"), *rank)
    return hits.groupBy(group).agg(
        F.min(key).alias("best")
    ).select(group, "best.*")


def highlights_by_page(hits: DataFrame, current: Column) -> DataFrame:
    """Boxes to draw, the current hit's last: ``doc_id, page, draw_order, rect...``."""
    flat = hits.select(
        "doc_id",
        "page",
        "start",
        current.alias("current"),
        F.posexplode("rects").alias("part", "rect"),
    )
    order = Window.partitionBy("doc_id", "page").orderBy("current", "start", "part")
    return flat.select(
        "doc_id",
        "page",
        "start",
        "current",
        F.row_number().over(order).alias("draw_order"),
        "rect.*",
    )
