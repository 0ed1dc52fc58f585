"""Recognised words from tab-separated text, their lines, confidence and placing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.functions import geometry as g
from quire.functions import let
from quire.functions.numbers import half_up, half_up_to
from quire.functions.text import BLANKS, drawable_line

# As in ``numbers.NUMERAL`` and beside it; here the white space is spelled out.
NUMERAL = r"^[ \t\n\x0b\f\r]*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?[ \t\n\x0b\f\r]*$"
HEXADECIMAL = r"^0[xX][0-9a-fA-F]{1,15}$"
BOX = ("left", "top", "width", "height")
CELLS = 12


def _numbers(cells: pa.Array) -> pa.Array:
    """``parsed_number`` of a column of cells."""
    plain = pc.match_substring_regex(cells, NUMERAL)
    found = pc.cast(pc.utf8_trim(pc.if_else(plain, cells, None), " \t\n\x0b\f\r+"), pa.float64())
    odd = np.flatnonzero(np.asarray(pc.match_substring_regex(cells, HEXADECIMAL).fill_null(False)))
    if odd.size:
        told = found.to_pylist()
        for at in odd.tolist():
            told[at] = float(int(cells[at].as_py(), 16))
        found = pa.array(told, type=pa.float64())
    return found


def _or_zero(cells: pa.Array) -> pa.Array:
    """A blank cell counts as zero."""
    blank = pc.equal(pc.utf8_trim(cells, BLANKS), "")
    return pc.coalesce(_numbers(cells), pc.if_else(blank, 0.0, pa.scalar(None, pa.float64())))


def words(rows: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """Words of recognised pages: ``doc_id, page, seq, text, left, top, width, height, confidence, line``.

    ``rows``: doc_id, page, ord, row (one line of the source), and ``page_row`` where the
    lines of a page already stay one after another, in order, as a file of them does; else
    they are brought together first.  Word rows have level 5 and at least twelve columns;
    the line number counts changes of block, paragraph and line, and moves on before a word
    is dropped for a bad box.  ``page_row`` and the columns ``carried`` stay with the words.
    """
    if "page_row" not in rows.columns:
        rows = rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "ord").withColumn("page_row", F.xxhash64("doc_id", "page"))
    lines = rows.where((F.col("row") != "") & ~F.startswith("row", F.lit("level"))).select(
        "doc_id", "page", "page_row", "ord", "row", *carried
    )
    kept = ["doc_id", "page", "page_row", *carried]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, line = None, -1
        for batch in batches:
            parts = pc.split_pattern(batch.column("row"), "\t", max_splits=CELLS - 1)
            whole = pc.equal(pc.list_value_length(parts), CELLS)
            batch, parts = batch.filter(whole), parts.filter(whole)
            if not batch.num_rows:
                continue
            flat = parts.flatten()
            cell = lambda n: flat.take(pa.array(np.arange(len(parts)) * CELLS + n))  # noqa: B023, E731
            text = pc.utf8_trim(cell(11), BLANKS)
            spoken = pc.and_(pc.equal(_numbers(cell(0)), 5.0).fill_null(False), pc.not_equal(text, ""))
            at = np.flatnonzero(np.asarray(spoken))
            if not at.size:
                continue
            keys = pc.binary_join_element_wise(cell(2), cell(3), cell(4), ":").take(pa.array(at))
            owners = batch.column("page_row").take(pa.array(at))
            owner = np.asarray(owners)
            fresh = np.ones(at.size, dtype=bool)
            fresh[1:] = owner[1:] != owner[:-1]
            changed = fresh.copy()
            changed[1:] |= np.asarray(pc.not_equal(keys[1:], keys[:-1]))
            if last is not None and last[0] == owner[0]:
                fresh[0], changed[0] = False, last[1] != keys[0].as_py()
            counted = np.cumsum(changed)
            # A page begins at zero; what was open goes on from its line.
            starts = np.maximum.accumulate(np.where(fresh, counted, 0))
            number = np.where(starts > 0, counted - starts, counted + line)
            last, line = (int(owner[-1]), keys[-1].as_py()), int(number[-1])
            spot = pa.array(at)
            boxes = [_or_zero(cell(n).take(spot)) for n in (6, 7, 8, 9)]
            good = boxes[0].is_valid()
            for box in boxes[1:]:
                good = pc.and_(good, box.is_valid())
            conf = _or_zero(cell(10).take(spot)).fill_null(-1.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(spot) for c in kept], batch.column("ord").take(spot), text.take(spot), *boxes, conf, pa.array(number.astype(np.int32))],
                names=[*kept, "seq", "text", *BOX, "confidence", "line"],
            ).filter(good)

    kinds = dict(lines.dtypes)
    fields = [*[(c, kinds[c]) for c in kept], ("seq", kinds["ord"]), ("text", "string"), *[(n, "double") for n in BOX], ("confidence", "double"), ("line", "int")]
    boxed = lines.mapInArrow(read, ", ".join(f"{n} {k}" for n, k in fields))
    whole = [F.greatest(F.lit(0), half_up(F.col(n))).cast("int").alias(n) for n in BOX]
    return boxed.select("doc_id", "page", "page_row", "seq", "text", *whole, "confidence", "line", *carried)


def page_texts(found: DataFrame) -> DataFrame:
    """Text and mean confidence of each page; unknown confidence does not count.

    ``found``: the words as ``words`` gives them, a page's one after another; a page is put
    together where its words are.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page, pieces, total, n, line = None, [], 0.0, 0, None
        names = ["doc_id", "page", "text", "total", "n"]

        def framed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.string(), pa.float64(), pa.int64()))], names=names
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            owner, lines = np.asarray(batch.column("page_row")), np.asarray(batch.column("line"))
            sure = np.asarray(batch.column("confidence"))
            known = np.where(sure >= 0, sure, 0.0)
            breaks = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            new_line = np.concatenate([[True], lines[1:] != lines[:-1]])
            texts = pc.binary_join_element_wise(pc.if_else(pa.array(new_line), "\n", " "), batch.column("text"), "")
            sums, counts = np.add.reduceat(known, breaks), np.add.reduceat((sure >= 0).astype(np.int64), breaks)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([*breaks.tolist(), len(owner)], type=pa.int32()), texts), "").to_pylist()
            done = []
            for at, text, part, count in zip(breaks.tolist(), joined, sums.tolist(), counts.tolist()):
                if page is not None and page[0] == owner[at]:
                    # The same page goes on in this batch.
                    pieces.append(("\n" if lines[at] != line else " ") + text[1:])
                    total, n = total + part, n + count
                    continue
                if page is not None:
                    done.append((*page[1], "".join(pieces), total, n))
                page = (owner[at], (batch.column("doc_id")[at].as_py(), batch.column("page")[at].as_py()))
                pieces, total, n = [text[1:]], part, count
            line = lines[-1]
            if done:
                yield framed(done)
        if page is not None:
            yield framed([(*page[1], "".join(pieces), total, n)])

    kinds = dict(found.dtypes)
    made = found.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("page").cast("bigint").alias("page"), "page_row", "text", "confidence", "line"
    ).mapInArrow(put, "doc_id long, page long, text string, total double, n long")
    return made.select(
        F.col("doc_id").cast(kinds["doc_id"]).alias("doc_id"), F.col("page").cast(kinds["page"]).alias("page"), "text",
        half_up_to(F.col("total") / F.nullif(F.col("n"), F.lit(0)), 1).alias("confidence"),
    )


def document_confidence(pages: DataFrame) -> DataFrame:
    """The mean of the page means."""
    return pages.groupBy("doc_id").agg(half_up_to(F.avg("confidence"), 1).alias("confidence"))


def placed(found: DataFrame, sizes: DataFrame | None = None, minimum: float = 0.0, advance: float = 0.6) -> DataFrame:
    """Words over the page they were read from: ``doc_id, page, seq, text, x, baseline, size, stretch``.

    ``sizes``: doc_id, page, image_width, image_height, page_width, page_height; none where
    the words carry these columns themselves, so nothing is joined.  Words
    surer than ``minimum`` or of unknown confidence are kept, if they have a box and
    can be drawn.
    """
    unsure = (F.col("confidence") >= 0) & (F.col("confidence") < minimum)
    shown = found.where(~unsure & (F.col("width") > 0) & (F.col("height") > 0)).withColumn(
        # Plain characters are drawn as they are.
        "text", F.when(F.col("text").rlike("^[!-~]+$"), F.col("text")).otherwise(let(F.col("text"), drawable_line))
    ).where("text <> ''")
    at = g.ocr_placement(
        F.col("left"), F.col("top"), F.col("width"), F.col("height"), F.col("image_width"), F.col("image_height"),
        F.col("page_width"), F.col("page_height"), F.length("text") * advance,
    )
    sized = shown if sizes is None else shown.join(sizes, ["doc_id", "page"])
    return sized.select("doc_id", "page", "seq", "text", at.alias("at")).select(
        "doc_id", "page", "seq", "text", "at.*"
    )
