"""Line dedup by winnowing over line hashes.

A text is a sequence of units: its lines, cut behind sentence ends; what is longer than
``LONG`` words is cut on, where the hash of two neighbouring words is the least of
``CUT_WINDOW`` in a row, so that a passage inside a long line has its own cuts wherever
it stands.  A gram is whole units of ``GRAM_WORDS`` words or more; from every stretch of
whole units with ``STRETCH_WORDS`` words the least gram is a fingerprint.  Whatever two
texts share over ``RUN_WORDS`` words holds such a stretch whole, so it has a fingerprint
in both.

A fingerprint's first place in the corpus meets all its later places.  Each match is
extended both ways on the words, beyond the units at its ends, and a later match of
``LEAST_WORDS`` words or more is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import packed, pick, stored, unpacked
from quire.llm.suffixes import Hashed

RUN_WORDS = 50
LEAST_WORDS = 30
LONG, CUT_WINDOW = 10, 7
# A run of RUN_WORDS loses less than LONG words to the units at each of its ends, and a
# stretch must hold a gram that goes on to the end of its last unit.
STRETCH_WORDS = RUN_WORDS - 2 * LONG
GRAM_WORDS = STRETCH_WORDS - LONG - 2
# Bytes of text whose units are worked out at once; a longer text is taken alone.
STREAM_BYTES = 1 << 20
# Up to so many rows (about 50 MB at most), keys and runs are broadcast.
SMALL = 500_000
_ODD = 0x9E3779B97F4A7C15
_BACK = pow(_ODD, -1, 1 << 64)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _BACKS = _power(_ODD, 1), _power(_BACK, 1)


def _mixed(value: np.ndarray) -> np.ndarray:
    value = value ^ (value >> np.uint64(31))
    value *= np.uint64(0xBF58476D1CE4E5B9)
    return value ^ (value >> np.uint64(29))


def _spans(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of each stretch [begin, end) of the values."""
    global _POWERS, _BACKS
    if len(_POWERS) <= len(values):
        _POWERS, _BACKS = _power(_ODD, 2 * len(values) + 1), _power(_BACK, 2 * len(values) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _POWERS[: len(values)], dtype=np.uint64)])
    return _mixed((sums[end] - sums[begin]) * _BACKS[begin])


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_SENTENCE_END = np.zeros(256, dtype=bool)
_SENTENCE_END[[ord(c) for c in ".!?"]] = True


def words_in(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, begin and end of every word; words are parted by a blank and the bytes 9 to 13.

    The lowest bit of a hash tells whether the word ends a sentence.
    """
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    hashes = Hashed(raw).of(begin, end) if len(begin) else np.empty(0, np.uint64)
    return (hashes & ~np.uint64(1)) | _SENTENCE_END[raw[end - 1]], begin, end


def hashed_words(text: bytes) -> np.ndarray:
    """Hash of every word."""
    return words_in(np.frombuffer(text, dtype=np.uint8))[0]


def least_of_each(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the least value of each stretch [begin, end) stands, the last of equals (by upper bits)."""
    low = np.uint64((1 << 26) - 1)
    table = [(values & ~low) | (low - np.arange(len(values), dtype=np.uint64))]
    size = end - begin
    level = np.frexp(size.astype(np.float64))[1] - 1  # the largest power of two that fits
    for k in range(1, int(level.max(initial=0)) + 1):
        last, half = table[-1], 1 << (k - 1)
        table.append(np.minimum(last[:-half], last[half:]) if len(last) > half else last[:0])
    least = np.empty(len(begin), dtype=np.uint64)
    for k, held in enumerate(table):
        at = np.flatnonzero(level == k)
        least[at] = np.minimum(held[begin[at]], held[end[at] - (1 << k)])
    return (low - (least & low)).astype(np.int64)


class Units:
    """The words of several texts and where their units end."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts), dtype=np.uint8)
        self.words, begin, stop = words_in(raw)
        self.doc_end = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
        end = (self.words & np.uint64(1)).astype(bool)
        lines = np.cumsum(raw == 10)
        if len(begin):
            end[:-1] |= lines[begin[1:]] > lines[stop[:-1] - 1]
            end[-1] = True
        self._cut_long(end)
        self.end = np.flatnonzero(end) + 1
        self.start = np.concatenate([[0], self.end[:-1]]).astype(np.int64)[: len(self.end)]
        self.hashes = _spans(self.words, self.start, self.end)

    def _cut_long(self, end: np.ndarray) -> None:
        """Cut units of more than LONG words behind the least of their pairs' hashes."""
        stop = np.flatnonzero(end) + 1
        begin = np.concatenate([[0], stop[:-1]]).astype(np.int64)[: len(stop)]
        long = stop - begin > LONG
        begin, stop = begin[long], stop[long]
        windows = stop - 1 - begin - CUT_WINDOW + 1
        first = np.repeat(begin - (np.cumsum(windows) - windows), windows) + np.arange(int(windows.sum()))
        if len(first):
            pairs = _mixed(self.words[:-1] * np.uint64(_ODD) + self.words[1:])
            end[least_of_each(pairs, first, first + CUT_WINDOW)] = True

    def fingerprints(self, gram: int = GRAM_WORDS, stretch: int = STRETCH_WORDS) -> tuple[np.ndarray, np.ndarray]:
        """Gram hashes and first units of the least gram of every stretch, in order."""
        n = len(self.start)
        edge = np.append(self.start, self.end[-1:] if n else 0)
        until = self.doc_end[np.searchsorted(self.doc_end, self.start, side="right")] if n else edge[:0]
        gram_end = np.searchsorted(edge, self.start + gram)
        whole = np.flatnonzero(self.start + stretch <= until)
        last = np.searchsorted(gram_end, np.searchsorted(edge, self.start[whole] + stretch), side="right")
        fits = np.minimum(gram_end, n)
        values = _spans(self.hashes, np.arange(n), fits)
        at = np.unique(least_of_each(values, whole, last))
        return values[at], at


_STEP = np.arange(32)


def _common(a: np.ndarray, b: np.ndarray, p: np.ndarray, q: np.ndarray, way: int) -> np.ndarray:
    """How many words ``a`` from each p and ``b`` from each q have in common, on or back, all looked at together.

    Both sides are padded by a step at each end with words that differ.
    """
    total, open_, look = np.zeros(len(p), dtype=np.int64), np.arange(len(p)), way * _STEP
    while len(open_):
        at = way * total[open_]
        differ = a[(p[open_] + at)[:, None] + look] != b[(q[open_] + at)[:, None] + look]
        same = differ.argmax(axis=1)
        on = ~differ[np.arange(len(same)), same]
        total[open_] += np.where(on, len(look), same)
        open_ = open_[on]
    return total


def _padded(words: np.ndarray, edge: int) -> np.ndarray:
    out = np.full(len(words) + 2 * len(_STEP), edge, dtype=np.uint64)
    out[len(_STEP) : len(_STEP) + len(words)] = words
    return out


def matches(hits: np.ndarray, a: np.ndarray, b: np.ndarray, least: int = LEAST_WORDS) -> list[tuple[int, int]]:
    """Stretches [start, end) of ``a`` of ``least`` words or more that match ``b`` around the hits (rows: place in a, place in b)."""
    found: list[tuple[int, int]] = []
    a, b, pad = _padded(a, 0), _padded(b, 2**64 - 1), len(_STEP)
    hits = hits[np.lexsort((hits[:, 0], hits[:, 0] - hits[:, 1]))]
    while len(hits):
        # Of the hits that are equally far apart the first is extended; what it covers is done.
        apart = hits[:, 0] - hits[:, 1]
        first = np.flatnonzero(np.diff(apart, prepend=apart[0] - 1))
        p, q = hits[first, 0], hits[first, 1]
        end = p + _common(a, b, p + pad, q + pad, 1)
        start = p - _common(a, b, p + pad - 1, q + pad - 1, -1)
        long = end - start >= least
        found += zip(start[long].tolist(), end[long].tolist())
        hits = hits[hits[:, 0] >= np.repeat(end, np.diff(np.append(first, len(hits))))]
    return sorted(found)


def without(text: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int]:
    """The text without these words, and how many went; emptied lines go, blank lines stay."""
    change = np.zeros(len(text) // 2 + 2, dtype=np.int64)
    for start, end in runs:
        change[start] += 1
        change[end] -= 1
    gone = np.cumsum(change) > 0
    out, deleted, k = [], 0, 0
    for line in text.split(b"\n"):
        words = line.split()
        lost = int(gone[k : k + len(words)].sum())
        if lost:
            deleted += lost
            line = _kept(line, words, gone[k : k + len(words)])
        k += len(words)
        if line or not lost:
            out.append(line)
    return b"\n".join(out), deleted


def _kept(line: bytes, words: list[bytes], gone: np.ndarray) -> bytes:
    """The words left of a line, each with the blanks before it."""
    out, at = [], 0
    for word, g in zip(words, gone):
        stop = line.index(word, at) + len(word)
        if not g:
            out.append(line[at:stop])
        at = stop
    return b"".join(out).strip()


PRINT = pa.struct([("gram", pa.int64()), ("at", pa.int32())])
LINED = "doc_id long, text_hash long, prints array<struct<gram:long,at:int>>"


def _lined(batches: Iterator[pa.RecordBatch], gram: int, stretch: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(2).to_pylist()
        begin = held = 0
        for i in range(len(texts) + 1):
            if i == len(texts) or (held and held + len(texts[i]) > STREAM_BYTES):
                units = Units(texts[begin:i])
                grams, at = units.fingerprints(gram, stretch)
                starts = units.start[at]
                doc = np.searchsorted(units.doc_end, starts, side="right")
                first = np.concatenate([[0], units.doc_end[:-1]]).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=i - begin))]).astype(np.int32)
                inner = [pa.array(grams.view(np.int64)), pa.array((starts - first[doc]).astype(np.int32))]
                prints = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(inner, fields=list(PRINT)))
                yield pa.RecordBatch.from_arrays([batch.column(c)[begin:i] for c in (0, 1)] + [prints], names=["doc_id", "text_hash", "prints"])
                begin, held = i, 0
            if i < len(texts):
                held += len(texts[i])


RUNS = "doc_id long, text_hash long, runs array<struct<start:int,end:int>>"


@lru_cache(maxsize=64)
def _remembered(text: bytes) -> np.ndarray:
    return hashed_words(text)


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The matches of each pair of texts; pairs of one text come one after another."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        hits = batch.column(2)
        places = np.stack([hits.flatten().field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], axis=1).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(pc.list_value_length(hits).to_numpy(zero_copy_only=False))])
        runs = []
        for i, (a, b) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
            found = matches(places[cuts[i] : cuts[i + 1]], _remembered(a), _remembered(b))
            runs.append([{"start": s, "end": e} for s, e in found])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(runs, kind)], names=["doc_id", "text_hash", "runs"])


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= SMALL else df


def dedup_lines(docs: DataFrame, gram: int = GRAM_WORDS, stretch: int = STRETCH_WORDS) -> DataFrame:
    """The documents without later repeated runs of words; ``deleted_words`` tells how much went.

    Documents are in the order of their ids (null first), then of their texts' hashes.
    Every run of fifty words or more that stands earlier in the corpus, or in the same
    document, has a fingerprint that meets that fingerprint's first place; what matches
    around it over thirty words or more goes.  A document whose words all repeat keeps
    an empty text.  Rows that repeat whole are one document and come out alike.  Null
    and empty texts stay as they are; texts of any length are read whole, a long one
    alone; a table without rows gives none; other columns travel along, and one named
    ``deleted_words`` is replaced.
    """
    names = docs.columns
    rows = pick(docs, "doc_id", "text").where(F.col("text").isNotNull()).select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(5), "text").alias("text_hash"), F.col("text").cast("binary").alias("text")
    )
    # Rows that repeat whole have one key and the same prints; their hits are told once.
    lined = stored(rows.mapInArrow(lambda batches: _lined(batches, gram, stretch), LINED).where(F.size("prints") > 0), "lined")
    prints = lined.select("doc_id", "text_hash", F.inline("prints"))
    # One small row for each fingerprint that has two places or more.
    first = stored(
        prints.groupBy("gram").agg(F.min(F.struct("doc_id", "text_hash", "at")).alias("first"), F.count("*").alias("places"))
        .where("places > 1")
        .select("gram", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash"), F.col("first.at").alias("first_at")),
        "first-places",
    )
    own = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_hash") == F.col("first_hash"))
    pairs = stored(
        prints.join(first, "gram").where(~(own & (F.col("at") == F.col("first_at"))))
        .groupBy("doc_id", "text_hash", "first_id", "first_hash")
        .agg(F.collect_set(F.struct("at", "first_at")).alias("hits")),
        "matched-places",
    )
    # Runs end inside units, so they are told on the texts, each fetched once.
    wanted = stored(
        pairs.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"))
        .union(pairs.select("first_id", "first_hash")).distinct(),
        "texts-wanted",
    )
    texts = stored(
        rows.join(_small(wanted), F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
        .groupBy("w_id", "w_hash").agg(F.first("text").alias("text")),
        "texts-found",
    )
    earlier = texts.select(F.col("w_id").alias("e_id"), F.col("w_hash").alias("e_hash"), F.col("text").alias("first_text"))
    later = texts.select(F.col("w_id").alias("l_id"), F.col("w_hash").alias("l_hash"), "text")
    matched = (
        pairs.join(earlier, F.col("first_id").eqNullSafe(F.col("e_id")) & (F.col("first_hash") == F.col("e_hash")))
        .drop("e_id", "e_hash")
        .join(later, F.col("doc_id").eqNullSafe(F.col("l_id")) & (F.col("text_hash") == F.col("l_hash")))
        .select("doc_id", "text_hash", "hits", "text", "first_text")
    )
    runs = stored(
        matched.mapInArrow(_extended, RUNS).where(F.size("runs") > 0)
        .groupBy("doc_id", "text_hash").agg(F.flatten(F.collect_list("runs")).alias("runs"))
        .select(F.col("doc_id").alias("r_id"), F.col("text_hash").alias("r_hash"), "runs"),
        "runs",
    )

    @F.pandas_udf("text string, deleted_words long")
    def rewritten(text: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = [(b"", 0) if r is None else without(t, [(x["start"], x["end"]) for x in r]) for t, r in zip(text, runs)]
        return pd.DataFrame({"text": [t.decode() for t, _ in out], "deleted_words": [n for _, n in out]})

    # Where the runs are small they go to the documents, so untouched texts never move.
    at = next(i for i, name in enumerate(names) if name == "text")
    text = F.col(f"row.c{at}")
    whole = packed(docs, "doc_id").withColumn("hash", F.xxhash64(F.lit(5), text))
    return (
        whole.join(_small(runs), F.col("doc_id").cast("long").eqNullSafe(F.col("r_id")) & (F.col("hash") == F.col("r_hash")), "left")
        .withColumn("new", rewritten(F.when(F.col("runs").isNotNull(), text.cast("binary")), "runs"))
        .select(*unpacked(names, {
            "text": F.when(F.col("runs").isNotNull(), F.col("new.text")).otherwise(text),
            "deleted_words": F.coalesce("new.deleted_words", F.lit(0).cast("long")),
        }))
    )
