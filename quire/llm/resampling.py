"""Target-distribution importance resampling with an Aho-Corasick dictionary.

Hashed bags of word runs describe the raw corpus and the target; a document's weight
is how much more its runs belong to the target, and Gumbel noise on the weights makes
the highest scores a draw without replacement.

The hash of a run is the crc32 of its words joined by one space.  It is not taken from
the run's bytes: a dictionary of delimiter-bounded words carries, for each word, the
crc32 of the word, that of a space and the word, and their length.  An Aho-Corasick
automaton scans a stretch of documents once and emits these payloads; the crc32 of two
neighbours follows from the payloads of both (one is moved on by the length of the
other), so runs of two and three words are compositions of neighbouring payloads.

Every worker learns its own dictionary from the words it meets, up to a bound; words
beyond it are read directly, so the bound changes nothing but the time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.llm.shared import pick, stored

BUCKETS = 10_000
LEAST_WORDS = 20
SEED = 42
# A draw of so many out of ``OF`` documents.
PART, OF = 5, 100
RUN_WORDS = 3
# A worker's dictionary: at most so many words of at most so many bytes.
DICTIONARY_WORDS = 50_000
LONGEST_WORD = 63
# Share of a stretch's words that may be read directly before the dictionary takes them in.
UNKNOWN = 0.02
# Bytes of text that are scanned as one stretch; a longer text is a stretch of its own.
STRETCH_BYTES = 4 << 20

# Letters A-Z become small; every other ASCII character but digits and small letters separates.
_TO_WORDS = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def _crc_of_bytes() -> np.ndarray:
    """What one more byte does to a crc32, for each value of its lowest byte."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> np.uint32(1)) ^ np.uint32(0xEDB88320), table >> np.uint32(1))
    return table


_BYTE = _crc_of_bytes()


def _moved_once(crc: np.ndarray) -> np.ndarray:
    return (crc >> np.uint32(8)) ^ _BYTE[crc & np.uint32(255)]


def _moves(n: int) -> np.ndarray:
    """[k, i, b]: byte b at place i of a crc32, moved on by k bytes, for k up to n."""
    table = np.empty((n + 1, 4, 256), dtype=np.uint32)
    table[0] = np.arange(256, dtype=np.uint32)[None, :] << (np.uint32(8) * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(1, n + 1):
        table[k] = _moved_once(table[k - 1])
    return table


_MOVES = _moves(LONGEST_WORD + 1)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """crc32 values, each as if ``by`` zero bytes had followed (before the other half is added)."""
    crc, by = crc.copy(), by.copy()
    far = len(_MOVES) - 1
    while True:
        step = np.minimum(by, far)
        table = _MOVES[:, 0][step, crc & np.uint32(255)]
        for i in range(1, 4):
            table = table ^ _MOVES[:, i][step, (crc >> np.uint32(8 * i)) & np.uint32(255)]
        crc, by = table, by - step
        if not by.any():
            return crc


class Dictionary:
    """Delimiter-bounded words with payloads, in an automaton that takes in new words."""

    def __init__(self, words: int = DICTIONARY_WORDS):
        self.room = words
        self.known: dict[bytes, int] = {}
        self.automaton = ahocorasick.Automaton()
        # The end of a document is the first entry; no text holds it as a word.
        self.crc, self.spaced, self.length = [0], [0], [1]
        self.automaton.add_word(" \n ", 0)
        self.automaton.make_automaton()

    def _take_in(self, words: list[bytes]) -> None:
        for word in words:
            if len(self.known) >= self.room:
                break
            if len(word) <= LONGEST_WORD and word not in self.known:
                at = self.known[word] = len(self.crc)
                self.automaton.add_word(f" {word.decode('latin-1')} ", at)
                for held, value in zip((self.crc, self.spaced, self.length), payload(word)):
                    held.append(value)
        self.automaton.make_automaton()

    def _matches(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Where each match ends and what it is, in the order of the text."""
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), dtype=np.int64)
        return flat[0::2], flat[1::2]

    def _between(self, text: str, ends: np.ndarray, at: np.ndarray) -> list[tuple[int, list[bytes]]]:
        """(place among the matches, words) of the stretches that no match covers."""
        starts = ends - np.array(self.length, dtype=np.int64)[at] - 1
        before = np.concatenate([[0], ends[:-1]])
        return [(int(i), text[before[i] + 1 : starts[i]].encode("latin-1").split()) for i in np.flatnonzero(starts != before)]

    def scan(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Payloads of the words of `` word word \\n word ... \\n ``: crc32, crc32 behind a space, length; ends have length 0."""
        text = text.decode("latin-1")
        ends, at = self._matches(text)
        between = self._between(text, ends, at)
        if between and sum(len(w) for _, w in between) > UNKNOWN * len(at) and len(self.known) < self.room:
            self._take_in([w for _, words in between for w in words])
            ends, at = self._matches(text)
            between = self._between(text, ends, at)
        held = [np.array(x, dtype=t)[at] for x, t in ((self.crc, np.uint32), (self.spaced, np.uint32), (self.length, np.int64))]
        held[2][at == 0] = 0
        if between:
            places = np.repeat([i for i, _ in between], [len(w) for _, w in between])
            direct = [payload(w) for _, words in between for w in words]
            held = [np.insert(h, places, np.array(x, dtype=h.dtype)) for h, x in zip(held, zip(*direct))]
        return tuple(held)


def payload(word: bytes) -> tuple[int, int, int]:
    return zlib.crc32(word), zlib.crc32(b" " + word), len(word)


_DICTIONARY: list[Dictionary] = []


def dictionary() -> Dictionary:
    """This worker's dictionary."""
    if not _DICTIONARY:
        _DICTIONARY.append(Dictionary())
    return _DICTIONARY[0]


class Features:
    """The hashed runs of one to three words of a stretch of documents."""

    def __init__(self, texts: list[bytes | None], words: Dictionary):
        docs = [t.translate(_TO_WORDS).split() if t else [] for t in texts]
        crc, spaced, length = words.scan(b" " + b"".join(b" ".join(d) + b" \n " if d else b"\n " for d in docs))
        self.ends = np.flatnonzero(length == 0)
        real = length > 0
        # Runs that begin at each word; what would cross an end of a document is none.
        self.hashes = [crc]
        self.valid = [real]
        for k in range(1, RUN_WORDS):
            last = self.hashes[-1]
            grown, valid = np.zeros_like(crc), np.zeros_like(real)
            if len(crc) > k:
                n = len(crc) - k
                grown[:n] = moved(last[:n], length[k:] + 1) ^ spaced[k:]
                valid[:n] = self.valid[-1][:n] & real[k:]
            self.hashes.append(grown)
            self.valid.append(valid)

    def counts(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(h[v] % np.uint32(buckets), minlength=buckets) for h, v in zip(self.hashes, self.valid))

    def by_document(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Words, features and the sum of the gains of each document."""
        at = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)[self.ends]]))
        weight = sum(np.where(v, gains[h % np.uint32(len(gains))], 0) for h, v in zip(self.hashes, self.valid))
        return at(self.valid[0].astype(np.int64)), at(sum(v.astype(np.int64) for v in self.valid)), at(weight)


def _stretches(texts: list[bytes | None]) -> Iterator[slice]:
    begin = held = 0
    for i, t in enumerate(texts):
        if held and held + len(t or b"") > STRETCH_BYTES:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(t or b"")
    if texts:
        yield slice(begin, len(texts))


def feature_counts(rows: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket`` and ``n``: how many features of all texts fall into each bucket that has any."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for part in parts:
            texts = part.column(0).to_pylist()
            for at in _stretches(texts):
                total += Features(texts[at], dictionary()).counts(buckets)
        met = np.flatnonzero(total)
        yield pa.record_batch([pa.array(met.astype(np.int32)), pa.array(total[met])], names=["bucket", "n"])

    made = pick(rows, "text").select(F.col("text").cast("binary").alias("text")).mapInArrow(batches, "bucket int, n long")
    return made.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Whole thousandths of the log ratio of target to raw, by bucket, each count one more than met.

    Both frames hold at most a row for each bucket, whatever the corpus.
    """
    held = []
    for frame in (raw, target):
        counts = np.zeros(buckets)
        for bucket, n in frame.select("bucket", "n").collect():
            counts[bucket] = n
        held.append(counts)
    s, t = held
    ratio = (t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def document_weights(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features`` and ``weight`` of every document."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            ids, texts = part.column(0), part.column(1).to_pylist()
            for at in _stretches(texts):
                columns = Features(texts[at], dictionary()).by_document(gains)
                yield pa.record_batch(
                    [ids[at], *[pa.array(c.astype(np.int64)) for c in columns]], names=["doc_id", "n_words", "n_features", "weight"]
                )

    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(batches, "doc_id long, n_words long, n_features long, weight long")


def _noise(seed: int):
    """Whole thousandths of Gumbel noise from the hashed id; a null id hashes as the empty text."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def ranked(scored: DataFrame, part: int = PART, of: int = OF) -> DataFrame:
    """``rank`` 1, 2, 3 ... of the highest scores among rows that ``may`` be drawn; null for all others.

    Rows are dealt by ranges of the order, so equal ids and scores share a range only
    as far as a row number does not tell them apart; a rank is its range's offset plus
    its place there.  Only the number of ranges goes through one task.
    """
    spark = scored.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    dealt = stored(
        stored(scored.withColumn("row", F.monotonically_increasing_id()), "scores")
        .repartitionByRange(ranges, *order).withColumn("range", F.spark_partition_id()),
        "ranges",
    )
    sizes = dealt.groupBy("range").agg(F.sum(F.col("may").cast("long")).alias("n"))
    all_ = Window.partitionBy(F.lit(0))
    offsets = sizes.select(
        "range", (F.sum("n").over(all_.orderBy("range").rowsBetween(Window.unboundedPreceding, -1))).alias("before"),
        F.expr(f"sum(n) OVER (PARTITION BY 0) * {part} div {of}").alias("draw"),
    )
    place = F.row_number().over(Window.partitionBy("range").orderBy(*order)) + F.coalesce("before", F.lit(0))
    return (
        dealt.join(F.broadcast(offsets), "range").withColumn("place", place.cast("long"))
        .withColumn("rank", F.when(F.col("may") & (F.col("place") <= F.col("draw")), F.col("place")))
        .drop("range", "before", "draw", "place", "row")
    )


def importance_resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, part: int = PART, of: int = OF,
    seed: int = SEED,
) -> DataFrame:
    """Every document's ``n_words``, ``n_features``, ``weight``, ``score`` and, if drawn, its ``rank``.

    Of the documents with ``least_words`` words or more, ``part`` out of ``of`` (rounded
    down) are drawn: the highest scores, ties to smaller ids.  Words are runs of letters,
    digits and non-ASCII characters, lower-cased in A-Z.

    Null and empty texts have no features and weight 0.  A null id is scored as an
    empty name and ranked before other ids of its score.  Rows that repeat are counted,
    scored and ranked each.  Texts are read whole at any length, a long one as a stretch
    of its own.  Without documents there are no rows; a target without features leaves
    every gain to the counts of the corpus alone.  Other columns are not looked at.
    """
    gains = bucket_gains(feature_counts(docs, buckets), feature_counts(target, buckets), buckets)
    scored = document_weights(docs, gains).withColumn("score", F.col("weight") + _noise(seed)).withColumn("may", F.col("n_words") >= least_words)
    return ranked(scored, part, of).drop("may")
