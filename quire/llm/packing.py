"""Hierarchical packing of tokenised documents into windows of several lengths.

Each task tokenises its documents and packs them in portions of bounded size, so
nothing is shuffled: full windows are cut from long documents, what is left of each
document goes to the tier of the smallest window that holds it, every tier's
windows are filled to the last id (gaps of longer windows from shorter tiers), and
windows of one length are dealt to step groups of equal token counts.
"""

from __future__ import annotations

import string
from array import array
from bisect import bisect_right, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import pick

LONGEST = 4096
TIERS = (4096, 2048, 1024, 512)
END = 2
# Ids packed together by a task, and tokens of one training step.
PORTION = 2_000_000
STEP = 4 * LONGEST
# Words whose ids a worker remembers (about 200 bytes each), and marks that follow letters.
REMEMBERED = 300_000
MARKS = string.punctuation

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class _Letters(dict):
    """Each letter as the tokenizer's byte level writes it."""

    def __init__(self, byte_level):
        self.byte_level = byte_level

    def __missing__(self, letter: str) -> str:
        self[letter] = made = self.byte_level.pre_tokenize_str(letter)[0][0]
        return made


class WordIds(dict):
    """The ids (little-endian 32 bits) of white-space separated words.

    The tokenizer drops white space, so a text's ids are its words' ids in a row.  A
    word of plain Latin letters goes straight to the tokenizer's model, and marks
    behind it are a word of their own; any other goes through the whole tokenizer.
    """

    def __init__(self, definition: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_str(definition)
        self.model = self.tokenizer.model
        self.letters = _Letters(pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False))

    def _plain(self, letters: str) -> bytes:
        known = self.get(letters.encode())
        if known is None:
            written = letters if letters.isascii() else "".join(map(self.letters.__getitem__, letters))
            known = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        return known

    def __missing__(self, raw: bytes) -> bytes:
        word = raw.decode()
        low = word.lower()
        core = low.rstrip(MARKS)
        if core.isalpha() and max(core) < "ɐ" and len(low) == len(word):
            made = self._plain(core) + (self[low[len(core) :].encode()] if len(core) < len(low) else b"")
        else:
            made = array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()
        if len(self) < REMEMBERED:
            self[raw] = made
        return made

    def text(self, text: str | None) -> bytes:
        raw = (text or "").encode()
        # Lower case meets more known words; special tokens are told apart by case.
        words = (raw if b"<|" in raw else raw.lower()).split()
        return b"".join(map(self.__getitem__, words))


_KNOWN: dict[int, WordIds] = {}


def _word_ids(definition: str) -> WordIds:
    key = hash(definition)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = WordIds(definition)
    return _KNOWN[key]


class Tiers:
    """Leftovers by length, shortest first in each tier; a leftover is [doc, start, length]."""

    def __init__(self):
        self.rows: list[tuple[int, int, int]] = []

    def add(self, length: int, doc: int, start: int) -> None:
        self.rows.append((length, doc, start))

    def settle(self) -> None:
        self.rows.sort()

    def longest_upto(self, length: int) -> tuple[int, int, int] | None:
        at = bisect_right(self.rows, (length, 1 << 62, 0))
        return self.rows.pop(at - 1) if at else None

    def longest(self) -> tuple[int, int, int]:
        return self.rows.pop()

    def back(self, row: tuple[int, int, int]) -> None:
        insort(self.rows, row)


def pack_portion(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (tier, pieces) for documents of these lengths; a piece is (doc, start, length).

    Every window is full.  What is left at the very end is cut into windows whose
    lengths are powers of two, so that nothing is padded.
    """
    top = tiers[0]
    windows: list[tuple[int, list[tuple[int, int, int]]]] = []
    left = Tiers()
    for doc, n in enumerate(lengths):
        at = 0
        while n - at >= top:
            windows.append((top, [(doc, at, top)]))
            at += top
        if n > at:
            left.add(n - at, doc, at)
    left.settle()
    waiting = sum(r[0] for r in left.rows)
    while left.rows:
        # The tier of the longest leftover, or the largest window that the rest still fills.
        want = left.rows[-1][0]
        tier = min(t for t in tiers if t >= min(want, top))
        if tier > waiting:
            tier = 1 << (waiting.bit_length() - 1)
        gap, pieces = tier, []
        while gap:
            row = left.longest_upto(gap)
            if row is None:  # nothing fits whole: cut the shortest that is left
                length, doc, start = left.rows.pop(0)
                pieces.append((doc, start, gap))
                left.back((length - gap, doc, start + gap))
                gap = 0
            else:
                length, doc, start = row
                pieces.append((doc, start, length))
                gap -= length
        windows.append((tier, pieces))
        waiting -= tier
    return windows


def step_groups(windows: list[tuple[int, list]], step: int = STEP) -> list[int]:
    """A step group for each window: groups of one length with ``step`` tokens each.

    Windows of a length are dealt in turn over the groups that length fills, those
    with many pieces first, so groups are alike in tokens and in documents.
    """
    group = [0] * len(windows)
    first = 0
    for tier in sorted({t for t, _ in windows}, reverse=True):
        mine = sorted((i for i, (t, _) in enumerate(windows) if t == tier), key=lambda i: (-len(windows[i][1]), i))
        many = max(1, -(-len(mine) * tier // step))
        for k, i in enumerate(mine):
            turn, at = divmod(k, many)
            group[i] = first + (at if turn % 2 == 0 else many - 1 - at)
        first += many
    return group


def packed_sequences(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, portion: int = PORTION) -> DataFrame:
    """Pieces of documents laid into sequences; ``tokenizer`` is the path of its file.

    A document's ids are its text's and then ``END``.  A piece is ``length`` ids from
    ``start``, which lie at ``offset`` of sequence ``sequence_id``; ``tier`` is the
    sequence's length and ``step_group`` its training step.  Null and empty texts
    have the end id alone; a null id stays null; rows that repeat are packed each;
    a table without rows gives none.  Other columns are not looked at.
    """
    with open(tokenizer, encoding="utf-8") as file:
        definition = file.read()
    known = docs.sparkSession.sparkContext.broadcast(definition)  # one vocabulary file

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = _word_ids(known.value)
        # Ids of this task: its partition above, a running number below.
        base = TaskContext.get().partitionId() << 40
        sequence, group = base, base
        ids: list = []
        held: list[bytes] = []
        total = 0

        def flush() -> pd.DataFrame:
            nonlocal sequence, group
            windows = pack_portion([len(h) // 4 for h in held], tiers)
            groups = step_groups(windows)
            out = []
            for (tier, pieces), g in zip(windows, groups):
                offset = 0
                for doc, start, length in pieces:
                    out.append((ids[doc], start, length, held[doc][4 * start : 4 * (start + length)], len(held[doc]) // 4, sequence, offset, tier, group + g))
                    offset += length
                sequence += 1
            group += max(groups, default=-1) + 1
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in PIECES.split(", ")])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            return frame

        end = END.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"]):
                made = words.text(text) + end
                ids.append(doc_id)
                held.append(made)
                total += len(made) // 4
                if total >= portion:
                    yield flush()
                    ids, held, total = [], [], 0
        if held:
            yield flush()

    return pick(docs, "doc_id", "text").mapInPandas(pack, PIECES)


def with_digest(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of the ids."""
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
