"""Periodic runs of words by online dyadic square catching.

Words arrive one after another.  Whenever a block of ``2**k`` words, aligned to a
multiple of its length, is complete, a catcher is set for it: it watches the next
words for copies of the block that begin ``2**k`` to ``2**(k+1) - 1`` words after it.
A copy at distance d that is met once more at 2 d is a square with period d;
comparing suffixes backwards and forwards from there grows it to the whole run, and
squares of one run merge.

The documents of a batch are appended to one stream.  All catchers of a level watch
at once: what they see is one comparison of the stream's blocks with the words behind
them, so a level costs one look at each word.  A level holds only the documents that
are long enough for it.  Rows never move between tasks.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import pick

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
# Bytes of text whose words are one stream; a longer text is a stream of its own.
STREAM_BYTES = 4 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)

Words = list[bytes]


def words_of(text: bytes | None) -> Words:
    """The words of a UTF-8 text; ``bytes.split`` cuts at a blank and the bytes 9 to 13 only."""
    return text.split() if text else []


def numbered(docs: list[Words]) -> list[np.ndarray]:
    """Words as numbers, equal for equal words only."""
    flat = np.empty(sum(map(len, docs)), dtype=object)
    flat[:] = [w for d in docs for w in d]
    codes = pd.factorize(flat)[0].astype(np.int64)
    return np.split(codes, np.cumsum([len(d) for d in docs])[:-1]) if docs else []


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of neighbouring stretches as hashes of both together."""
    h = (left * _ODD) ^ (right + _MIX)
    h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def common_prefix(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix, looked for in steps that double."""
    n, at, step = min(len(a), len(b)), 0, 32
    while at < n:
        differ = a[at : min(n, at + step)] != b[at : min(n, at + step)]
        if differ.any():
            return at + int(differ.argmax())
        at, step = at + step, step * 2
    return n


class Runs:
    """The runs of one document as its squares are caught."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.back = words[::-1]
        # Starts and ends of the runs of a period, in ascending order.
        self.by_period: dict[int, tuple[list[int], list[int]]] = {}
        self.least: dict[tuple[int, int], int] = {}

    def _known(self, start: int, end: int, period: int) -> bool:
        """Is the square part of a run whose period divides its own?"""
        for p, (starts, ends) in self.by_period.items():
            if period % p == 0:
                at = bisect_right(starts, start) - 1
                if at >= 0 and ends[at] >= end:
                    return True
        return False

    def caught(self, start: int, period: int, size: int) -> None:
        """Grow a square to its run.  Squares of one period come in the order of their starts."""
        if self._known(start, start + period + size, period):
            return
        w, n = self.words, len(self.words)
        ahead = common_prefix(w[start:], w[start + period :])
        before = common_prefix(self.back[n - start :], self.back[n - start - period :])
        first, end = start - before, start + period + ahead
        if end - first >= max(LEAST_LENGTH, LEAST_EXPONENT * period):
            starts, ends = self.by_period.setdefault(period, ([], []))
            starts.append(first)
            ends.append(end)
            # A run is met again at multiples of its period; the least one is its own.
            self.least[first, end] = min(period, self.least.get((first, end), period))

    def found(self) -> list[tuple[int, int, int]]:
        """(start, length, period) by start, then period."""
        return sorted(((s, e - s, p) for (s, e), p in self.least.items()), key=lambda r: (r[0], r[2]))


def _squares(stream: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, distance) of what the catchers of blocks of ``size`` words catch, in order.

    ``stream[i]`` is the hash of the ``size`` words from i.  A catcher speaks when its
    block comes at a distance and again at twice that; every run of exponent four has a
    block that does.
    """
    table = stream.reshape(-1, size)
    block, at = np.nonzero(table[1:] == table[:-1, :1])
    start, distance = block * size, at + size
    third = start + 2 * distance
    inside = third < len(stream)
    start, distance, third = start[inside], distance[inside], third[inside]
    again = stream[third] == stream[start]
    return start[again], distance[again]


def runs_of(docs: list[np.ndarray]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each document of numbered words."""
    runs = [Runs(d) for d in docs]
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    kept = np.flatnonzero(lengths >= LEAST_LENGTH)
    hashes = [docs[i].astype(np.uint64) * _ODD + _MIX for i in kept]
    size = 1
    while len(kept):
        # Each document begins on a block of its own; what fills the gaps equals nothing.
        room = -(-lengths[kept] // size) * size
        begin = np.concatenate([[0], np.cumsum(room)[:-1]])
        stream = np.arange(1, int(room.sum()) + 1, dtype=np.uint64) * _MIX
        for b, h in zip(begin, hashes):
            stream[b : b + len(h)] = h
        starts, distances = _squares(stream, size)
        owners = np.searchsorted(begin, starts, side="right") - 1
        starts -= begin[owners]
        whole = starts + 2 * distances + size <= lengths[kept[owners]]
        for o, s, d in zip(kept[owners[whole]].tolist(), starts[whole].tolist(), distances[whole].tolist()):
            runs[o].caught(s, d, size)
        # Neighbouring blocks join for the next level, in documents that can hold its runs.
        longer = lengths[kept] >= LEAST_EXPONENT * 2 * size
        hashes = [_joined(h[:-size], h[size:]) for h, long in zip(hashes, longer) if long]
        kept, size = kept[longer], size * 2
    return [r.found() for r in runs]


def collapsed(words: Words, runs: list[tuple[int, int, int]]) -> Words:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    drop = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    return [w for w, d in zip(words, np.cumsum(drop).tolist()) if d == 0]


RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
SCHEMA = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, text string"


def _streams(texts: list[bytes | None]) -> Iterator[slice]:
    """Stretches of a batch that make one stream each."""
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > STREAM_BYTES:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t or b"")
    yield slice(begin, len(texts))


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, Words], Words] | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``runs`` and the text without what runs repeat, per document.

    A run is a stretch of words with smallest period q and at least ``max(6, 4 q)``
    words that no neighbouring word extends keeping the period; its words after the
    first q go.  ``text`` is the kept words, joined by one blank.  ``rewrite`` may change
    a document's words before they are read.

    Null and empty texts have no words and no runs; a null id stays null.  Rows that
    repeat are answered each.  A text of any length is read whole: its words are one
    stream in one task, of memory in proportion to it.  An empty table gives no rows;
    other columns are not looked at.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0).to_pylist(), part.column(1).to_pylist()
            for at in _streams(texts):
                words = [words_of(t) for t in texts[at]]
                if rewrite is not None:
                    words = [rewrite(i, w) for i, w in zip(ids[at], words)]
                found = runs_of(numbered(words))
                yield pa.record_batch(
                    [
                        pa.array(ids[at], pa.int64()), pa.array([len(w) for w in words], pa.int64()),
                        pa.array([[dict(zip(("start", "length", "period"), r)) for r in f] for f in found], RUN),
                        pa.array([b" ".join(collapsed(w, f)) for w, f in zip(words, found)], pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n_words", "runs", "text"],
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(batches, SCHEMA)


def planted(doc_id: int | None, words: Words) -> Words:
    """Every tenth document by its hashed id repeats itself from some word on; a null id never does."""
    if doc_id is None or not words:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g, n = h // 10, len(words)
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    return words[:begin] + [words[begin + i % period] for i in range(n - begin)]


def digest(found: DataFrame) -> DataFrame:
    """The query's columns: counts, the longest run (then the first, then the shortest period) and hashes."""
    sign = lambda f: F.when(F.size("runs") > 0, f)
    longest = F.array_sort("runs", lambda a, b: (
        F.when(a["length"] != b["length"], F.signum(b["length"] - a["length"]))
        .when(a["start"] != b["start"], F.signum(a["start"] - b["start"]))
        .otherwise(F.signum(a["period"] - b["period"])).cast("int")
    ))[0]
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]), F.lit("\n")))
    return found.withColumn("longest", sign(longest)).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period",
        F.expr("longest.length * 1000 div longest.period").alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines), 256).alias("runs_sha256"), F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
