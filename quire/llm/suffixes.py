"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte goes when a string of ``LEAST`` bytes over it also starts in a document with a
smaller id.  In the suffix order of all places the longest earlier match of a place is
shared with one of two neighbours: the previous and the next place in that order that
come from an earlier document.  A place whose match with either is ``LEAST`` bytes or
more starts a string to remove.

The suffix order of a whole corpus is not built at once.  Every window of ``LEAST``
bytes has an anchor, the least of the hashed grams in it, so equal windows have equal
anchors; the windows of a document that share an anchor are one stretch.

1. Documents are dealt into blocks.  A block asks about the grams of its anchors, and
   ranges of the hash tell which occur in two documents, one bit each.
2. A block sends the stretches around those anchors, each different one once with its
   least id.  Stretches with equal grams meet, their windows are put in suffix order,
   the array tells which start earlier, and the block gets a bit for each window.
3. The block cuts its documents.

The texts move once, between tasks, when they are dealt; the three steps read the same
shuffled rows.  What else moves is hashes, stretches of repeated grams and bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import pick, text_bytes

LEAST = 50
GRAM = 16
# Grams in a window, the most windows an anchor can stand for.
REACH = LEAST - GRAM + 1
# Text of a block, text whose hashes go to one range, and text whose stretches do: at
# least the first, at most the second; in between they grow with the corpus, so that
# there are some thousands of each.  No step sends more messages than there are anchors.
BLOCK_TEXT, RANGE_TEXT, STRETCH_TEXT = (3 << 20, 16 << 20), (8 << 20, 48 << 20), (3 << 20, 16 << 20)
MANY = 4000
# Bytes that are hashed at once; longer texts are read in overlapping pieces.
PIECE_BYTES = 256 << 10
# Documents of one gram beyond which its windows go each by its own hash.
WIDE = 20_000
# Different stretches whose windows are put in order at once, cut between grams.
TOGETHER = 10_000

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACE = np.uint64((1 << 24) - 1)


def _power(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


_POWERS, _BACK = _power(_BASE, 0), _power(_INVERSE, 0)
_BYTES = np.random.default_rng(50).integers(0, 1 << 64, 256, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(_BASE)
    return h ^ (h >> np.uint64(32))


class Hashed:
    """Bytes whose substrings have hashes."""

    def __init__(self, raw: np.ndarray):
        global _POWERS, _BACK
        if len(_POWERS) <= len(raw):
            _POWERS, _BACK = _power(_BASE, len(raw) + 1), _power(_INVERSE, len(raw) + 1)
        self.sums = np.zeros(len(raw) + 1, dtype=np.uint64)
        np.cumsum(_BYTES[raw] * _POWERS[: len(raw)], out=self.sums[1:])

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[end] - self.sums[begin]) * _BACK[begin])

    def grams(self) -> np.ndarray:
        n = len(self.sums) - GRAM
        return _mixed((self.sums[GRAM:] - self.sums[:-GRAM]) * _BACK[:n]) if n > 0 else np.empty(0, np.uint64)


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` in a row."""
    held, have = values, 1
    while have * 2 <= width:
        held, have = np.minimum(held[:-have], held[have:]), have * 2
    rest = width - have
    return np.minimum(held[: len(held) - rest], held[rest:]) if rest else held


class Stretches:
    """A block's documents and the stretches of windows that share an anchor."""

    def __init__(self, texts: list[bytes], ids: np.ndarray):
        self.texts, self.ids = texts, ids
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        doc, begin, windows, offset, gram, whole = [], [], [], [], [], []
        for pieces in self._pieces(lengths):
            raw = b"".join(texts[d][b:e] for d, b, e in pieces)
            hashed = Hashed(np.frombuffer(raw, dtype=np.uint8))
            sizes = np.array([e - b for _, b, e in pieces], dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            grams = hashed.grams()
            # The leftmost of the least grams in a window is its anchor.
            ordered = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            anchor = (least_of(ordered, REACH) & _PLACE).astype(np.int64)
            owner = np.repeat(np.arange(len(pieces)), sizes)[: len(anchor)]
            start = np.arange(len(anchor))
            inside = start + LEAST <= (at + sizes)[owner]
            start, anchor, owner = start[inside], anchor[inside], owner[inside]
            first = np.flatnonzero(np.diff(anchor, prepend=-1) != 0)
            count = np.diff(np.append(first, len(anchor)))
            s, a, o = start[first], anchor[first], owner[first]
            doc.append(np.array([d for d, _, _ in pieces], dtype=np.int64)[o])
            begin.append(s - at[o] + np.array([b for _, b, _ in pieces], dtype=np.int64)[o])
            windows.append(count)
            offset.append(a - s)
            gram.append(_mixed(grams[a]))  # the least of many hashes are small ones; mixed again they are even
            whole.append(hashed.of(s, s + count + LEAST - 1))
        join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.empty(0, kind)
        self.doc, self.begin, self.windows = join(doc, np.int64), join(begin, np.int64), join(windows, np.int64)
        self.offset, self.gram, self.whole = join(offset, np.int64), join(gram, np.uint64), join(whole, np.uint64)

    def _pieces(self, lengths: np.ndarray) -> Iterator[list[tuple[int, int, int]]]:
        """(document, begin, end) of texts to hash at once; pieces of a text overlap by all but one byte of a window."""
        held, size = [], 0
        for d in np.flatnonzero(lengths >= LEAST):
            for b in range(0, int(lengths[d]) - LEAST + 1, PIECE_BYTES):
                e = min(int(lengths[d]), b + PIECE_BYTES + LEAST - 1)
                if held and size + e - b > PIECE_BYTES + LEAST:
                    yield held
                    held, size = [], 0
                held.append((int(d), b, e))
                size += e - b
        if held:
            yield held

    def asked(self) -> tuple[np.ndarray, np.ndarray]:
        """The different grams in order, and in how many of the block's documents each is."""
        pairs = np.lexsort((self.ids[self.doc], self.gram))
        g, d = self.gram[pairs], self.ids[self.doc][pairs]
        new = np.concatenate([[True], (g[1:] != g[:-1])]) if len(g) else np.empty(0, bool)
        other = new | np.concatenate([[True], d[1:] != d[:-1]]) if len(g) else new
        grams = g[new]
        return grams, np.bincount(np.cumsum(new)[other] - 1, minlength=len(grams)).astype(np.int64)

    def keep(self, grams: np.ndarray, repeated: np.ndarray, wide: np.ndarray) -> "Chosen":
        at = np.searchsorted(grams, self.gram)
        return Chosen(self, np.flatnonzero(repeated[at] & ~wide[at]), np.flatnonzero(repeated[at] & wide[at]))


class Chosen:
    """The stretches of repeated grams, those of wide grams as single windows; different ones once."""

    def __init__(self, all_: Stretches, narrow: np.ndarray, wide: np.ndarray):
        self.all = all_
        n = all_.windows[wide]
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        self.doc = np.concatenate([all_.doc[narrow], np.repeat(all_.doc[wide], n)])
        self.begin = np.concatenate([all_.begin[narrow], np.repeat(all_.begin[wide], n) + within])
        self.windows = np.concatenate([all_.windows[narrow], np.ones(len(within), np.int64)])
        # A single window has no anchor to meet at: its offset is beyond all others.
        self.offset = np.concatenate([all_.offset[narrow], np.full(len(within), 255)])
        single = self._hashes(np.arange(len(narrow), len(self.doc)))
        self.key = np.concatenate([all_.gram[narrow], single])
        whole = np.concatenate([all_.whole[narrow], single])
        ids = all_.ids[self.doc]
        # By key, then stretch, then id: the first of each stretch is sent.
        order = np.lexsort((self.begin, self.doc, ids, self.windows, self.offset, whole, self.key))
        same = np.zeros(len(order), dtype=bool)
        k, w, o, m = self.key[order], whole[order], self.offset[order], self.windows[order]
        same[1:] = (k[1:] == k[:-1]) & (w[1:] == w[:-1]) & (o[1:] == o[:-1]) & (m[1:] == m[:-1])
        self.sent = order[~same]
        self.stretch = np.empty(len(order), dtype=np.int64)
        self.stretch[order] = np.cumsum(~same) - 1

    def _hashes(self, at: np.ndarray) -> np.ndarray:
        if not len(at):
            return np.empty(0, np.uint64)
        return np.concatenate([
            Hashed(np.frombuffer(b"".join(self.bytes_of(i) for i in part), dtype=np.uint8)).of(
                np.arange(len(part)) * LEAST, np.arange(1, len(part) + 1) * LEAST
            )
            for part in np.array_split(at, max(1, len(at) * LEAST // PIECE_BYTES))
        ])

    def bytes_of(self, i: int) -> bytes:
        b = self.begin[i]
        return self.all.texts[self.doc[i]][b : b + self.windows[i] + LEAST - 1]

    def starts(self, earlier: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, place) of the windows that start earlier, from a bit for each window sent."""
        sent_windows = self.windows[self.sent]
        first = np.cumsum(sent_windows) - sent_windows
        n = self.windows
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        bits = earlier[np.repeat(first[self.stretch], n) + within]
        # The block itself holds the stretch under a smaller id.
        ids = self.all.ids
        later = ids[self.doc] > ids[self.doc[self.sent]][self.stretch]
        hit = bits | np.repeat(later, n)
        return np.repeat(self.doc, n)[hit], (np.repeat(self.begin, n) + within)[hit]


def earlier_neighbours(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place the nearest place before and behind it with a smaller value (-1 and n: none)."""

    def before(v: np.ndarray) -> np.ndarray:
        near = np.arange(-1, len(v) - 1)
        open_ = np.arange(len(v))
        while len(open_):
            # Whatever lies between a place and its pointer is not smaller, so pointers may be followed.
            open_ = open_[(near[open_] >= 0)]
            open_ = open_[v[near[open_]] >= v[open_]]
            near[open_] = near[near[open_]]
        return near

    return before(values), len(values) - 1 - before(values[::-1])[::-1]


def starts_earlier(windows: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which windows (rows of bytes) come from an earlier document too, by the longest-previous-factor array."""
    if not len(ids):
        return np.empty(0, bool)
    padded = np.zeros((len(windows), -(-windows.shape[1] // 8) * 8), dtype=np.uint8)
    padded[:, : windows.shape[1]] = windows
    words = padded.view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    words = words[order]
    # Windows with a common prefix of all their bytes are neighbours in suffix order.
    new = np.concatenate([[True], (words[1:] != words[:-1]).any(axis=1)])
    group = np.cumsum(new) - 1
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(order)) - 1
    previous, following = earlier_neighbours(ids[order])
    out = np.empty(len(order), dtype=bool)
    out[order] = (previous >= first[group]) | (following <= last[group])
    return out


def told(lengths: np.ndarray, offsets: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A bit for each window of the stretches that met in a range: does it start in an earlier document?"""
    n, sizes = len(lengths), lengths + LEAST - 1
    begin = np.cumsum(sizes) - sizes
    first = np.cumsum(lengths) - lengths
    whole, key = np.empty(n, np.uint64), np.empty(n, np.uint64)
    for at in np.array_split(np.arange(n), max(1, len(raw) // PIECE_BYTES)):
        if len(at):
            b0 = begin[at[0]]
            hashed = Hashed(raw[b0 : begin[at[-1]] + sizes[at[-1]]])
            b = begin[at] - b0
            whole[at] = hashed.of(b, b + sizes[at])
            anchored = offsets[at] != 255
            a = b + np.where(anchored, offsets[at], 0)
            key[at] = np.where(anchored, hashed.of(a, a + GRAM), whole[at])
    order = np.lexsort((ids, lengths, offsets, whole, key))
    change = np.zeros(n, dtype=bool)
    change[:1] = True
    for x in (lengths, offsets, whole, key):
        change[1:] |= x[order][1:] != x[order][:-1]
    group = np.cumsum(change) - 1
    leader = order[change]  # each stretch with its least id
    out = np.repeat(False, int(lengths.sum()))
    # Stretches that no other stretch meets need no order.
    k = key[leader]
    met = np.zeros(len(leader), dtype=bool)
    met[1:] = k[1:] == k[:-1]
    met[:-1] |= met[1:]
    some = np.flatnonzero(met)
    cuts = np.flatnonzero(np.diff(k[some], prepend=k[some][:1]) != 0)
    at = 0
    while at < len(some):
        end = len(some) if at + TOGETHER >= len(some) else at + TOGETHER
        later = cuts[np.searchsorted(cuts, end) :]
        end = len(some) if end == len(some) or not len(later) else int(later[0])
        part = leader[some[at:end]]
        w = lengths[part]
        place = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
        rows = np.lib.stride_tricks.sliding_window_view(raw, LEAST)[np.repeat(begin[part], w) + place]
        out[np.repeat(first[part], w) + place] = starts_earlier(rows, np.repeat(ids[part], w))
        at = end
    # The others of a stretch are later copies, or repeats of its least id with its bits.
    rest = order[~change]
    lead = leader[group[~change]]
    w = lengths[rest]
    place = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
    out[np.repeat(first[rest], w) + place] = out[np.repeat(first[lead], w) + place] | np.repeat(ids[rest] > ids[lead], w)
    return out


def _edges(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Bounds of the equal ranges of the hash in sorted keys."""
    inner = np.array([(r << 64) // ranges for r in range(1, ranges)], dtype=np.uint64)
    return np.concatenate([[0], np.searchsorted(keys, inner), [len(keys)]])


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers from 0 in as few bytes each as the largest needs; that width stands first."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    return bytes([width]) + np.ascontiguousarray(numbers, dtype="<u8").view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(body), 8), dtype=np.uint8)
    out[:, : raw[0]] = body
    return out.view("<u8").ravel()


# Hashes are asked about by their upper bits; a chance meeting only sends a stretch in vain.
_DROPPED = np.uint64(16)

ASKED = "kind int, part int, block int, hashes binary, counts binary, n long"
TOLD = "block int, kind int, part int, bits binary, wide binary, n long"
SENT = "kind int, part int, block int, lengths binary, offsets binary, body binary, ids binary, n long"
GRAMS, STRETCHES = 1, 2
RESULT = "doc_id long, n_bytes long, spans array<struct<start:long,length:long>>, kept binary"


def _names(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _stretches(rows: pd.DataFrame) -> tuple[pd.DataFrame, Stretches]:
    rows = rows[rows["named"]].sort_values("row")
    return rows, Stretches([t if t is not None else b"" for t in rows["text"]], rows["doc_id"].to_numpy(dtype=np.int64))


def _ask(rows: pd.DataFrame, ranges: int) -> pd.DataFrame:
    grams, counts = _stretches(rows)[1].asked()
    at, block, out = _edges(grams, ranges), int(rows["block"].iloc[0]), []
    for p in np.flatnonzero(np.diff(at)):
        part = slice(at[p], at[p + 1])
        steps = np.diff(grams[part] >> _DROPPED, prepend=np.uint64(0))
        out.append((GRAMS, int(p), block, _narrow(steps[:1]) + _narrow(steps[1:]), _narrow(counts[part] - 1), part.stop - part.start))
    return pd.DataFrame(out, columns=_names(ASKED))


def _tell_grams(rows: pd.DataFrame) -> pd.DataFrame:
    """For each block: which of its grams occur in two documents, and which of those in very many."""
    asked = []
    for raw in rows["hashes"]:
        cut = 1 + raw[0]
        asked.append(np.cumsum(np.concatenate([_wide(raw[:cut]), _wide(raw[cut:])])))
    known = np.unique(np.concatenate(asked))
    documents = np.zeros(len(known), dtype=np.int64)
    places = [np.searchsorted(known, a) for a in asked]
    for at, raw in zip(places, rows["counts"]):
        np.add.at(documents, at, _wide(raw).astype(np.int64) + 1)
    part = int(rows["part"].iloc[0])
    return pd.DataFrame(
        [
            (int(b), GRAMS, part, np.packbits(documents[at] > 1).tobytes(), np.packbits(documents[at] > WIDE).tobytes(), len(at))
            for b, at in zip(rows["block"], places)
        ],
        columns=_names(TOLD),
    )


def _bits(messages: pd.DataFrame, kind: int, column: str) -> np.ndarray:
    mine = messages[messages["kind"] == kind].sort_values("part")
    parts = [np.unpackbits(np.frombuffer(b, np.uint8), count=int(n)) for b, n in zip(mine[column], mine["n"])]
    return np.concatenate(parts).astype(bool) if parts else np.empty(0, bool)


def _chosen(stretches: Stretches, messages: pd.DataFrame) -> Chosen:
    grams, _ = stretches.asked()
    return stretches.keep(grams, _bits(messages, GRAMS, "bits"), _bits(messages, GRAMS, "wide"))


def _send(rows: pd.DataFrame, messages: pd.DataFrame, ranges: int) -> pd.DataFrame:
    if rows.empty or messages.empty:
        return pd.DataFrame(columns=_names(SENT))
    chosen = _chosen(_stretches(rows)[1], messages)
    at, block, out = _edges(chosen.key[chosen.sent], ranges), int(rows["block"].iloc[0]), []
    packer = zstandard.ZstdCompressor(level=1)
    for p in np.flatnonzero(np.diff(at)):
        sent = chosen.sent[at[p] : at[p + 1]]
        lengths = chosen.windows[sent]
        body = packer.compress(b"".join(chosen.bytes_of(i) for i in sent))
        ids = packer.compress(chosen.all.ids[chosen.doc[sent]].astype("<i8").tobytes())
        out.append((STRETCHES, int(p), block, lengths.astype(np.uint8).tobytes(), chosen.offset[sent].astype(np.uint8).tobytes(), body, ids, int(lengths.sum())))
    return pd.DataFrame(out, columns=_names(SENT))


def _tell_stretches(rows: pd.DataFrame) -> pd.DataFrame:
    unpack = zstandard.ZstdDecompressor().decompress
    join = lambda parts, kind: np.frombuffer(b"".join(parts), dtype=kind)
    earlier = told(
        join(rows["lengths"], np.uint8).astype(np.int64), join(rows["offsets"], np.uint8).astype(np.int64),
        join(map(unpack, rows["body"]), np.uint8), join(map(unpack, rows["ids"]), "<i8"),
    )
    part, ends = int(rows["part"].iloc[0]), np.cumsum(rows["n"].to_numpy())
    return pd.DataFrame(
        [
            (int(b), STRETCHES, part, np.packbits(bits).tobytes(), b"", len(bits))
            for b, bits in zip(rows["block"], np.split(earlier, ends[:-1]))
        ],
        columns=_names(TOLD),
    )


def removed_spans(length: int, starts: np.ndarray) -> list[tuple[int, int]]:
    """(start, length) of the maximal stretches that windows from these sorted places cover."""
    if not len(starts):
        return []
    new = np.concatenate([[True], np.diff(starts) > LEAST])
    begin = starts[new]
    end = np.append(starts[np.flatnonzero(new)[1:] - 1], starts[-1]) + LEAST
    return list(zip(begin.tolist(), (end - begin).tolist()))


def _cut(rows: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame(columns=["doc_id", "n_bytes", "spans", "kept"])
    out = [(None, len(t or b""), [], t or b"") for t in rows.loc[~rows["named"], "text"]]
    rows, stretches = _stretches(rows)
    docs = places = np.empty(0, np.int64)
    if len(stretches.gram):
        docs, places = _chosen(stretches, messages).starts(_bits(messages, STRETCHES, "bits"))
    order = np.lexsort((places, docs))
    by_doc = np.split(places[order], np.searchsorted(docs[order], np.arange(1, len(rows))))
    for doc_id, text, starts in zip(rows["doc_id"].astype(int), stretches.texts, by_doc):
        spans = removed_spans(len(text), starts)
        kept, at = [], 0
        for start, length in spans:
            kept.append(text[at:start])
            at = start + length
        out.append((doc_id, len(text), [{"start": s, "length": n} for s, n in spans], b"".join([*kept, text[at:]])))
    frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def parts_of(total: int, sizes: tuple[int, int]) -> int:
    """How many parts of a size between two bounds make a corpus."""
    return max(1, math.ceil(total / min(sizes[1], max(sizes[0], total // MANY))))


def remove_repeats(
    docs: DataFrame, block_text: tuple[int, int] = BLOCK_TEXT, range_text: tuple[int, int] = RANGE_TEXT,
    stretch_text: tuple[int, int] = STRETCH_TEXT,
) -> DataFrame:
    """``doc_id``, ``n_bytes``, removed ``spans`` and the ``kept`` bytes of every document.

    A byte of the UTF-8 text is removed when one of the 50-byte strings over it also
    starts in a document with a smaller id.  Strings are judged on the input and never
    cross documents; what is kept may end inside a character, so it is bytes.

    Null and empty texts have no bytes.  A document without an id is neither earlier nor
    later than others and keeps all.  Rows of one id are no earlier documents to each
    other and are answered each.  Texts are read whole, in pieces if they are long.  An
    empty table gives no rows; other columns are not looked at.
    """
    rows = pick(docs, "doc_id", "text")
    total = rows.agg(F.sum(text_bytes("text") + 8)).first()[0] or 0
    blocks, ranges, parts = parts_of(total, block_text), parts_of(total, range_text), parts_of(total, stretch_text)
    dealt = (
        rows.withColumn("row", F.monotonically_increasing_id())
        .select(
            # The row's number is hashed too, so rows that repeat are spread.
            F.pmod(F.xxhash64(F.lit(12), "doc_id", "row"), F.lit(blocks)).cast("int").alias("block"), "row",
            F.col("doc_id").isNotNull().alias("named"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"),
            F.col("text").cast("binary").alias("text"),
        )
        .repartition(blocks, "block")
    )
    asked = dealt.groupBy("block").applyInPandas(lambda df: _ask(df, ranges), ASKED)
    grams = asked.groupBy("kind", "part").applyInPandas(_tell_grams, TOLD)
    sent = dealt.groupBy("block").cogroup(grams.groupBy("block")).applyInPandas(lambda a, b: _send(a, b, parts), SENT)
    stretches = sent.groupBy("kind", "part").applyInPandas(_tell_stretches, TOLD)
    return dealt.groupBy("block").cogroup(grams.unionByName(stretches).groupBy("block")).applyInPandas(_cut, RESULT)


def digest(cut: DataFrame) -> DataFrame:
    """The query's columns."""
    return cut.select(
        "doc_id", "n_bytes", F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )
