"""Language-model scoring by deleted interpolation.

Maximum-likelihood estimates of word pairs, of single words and the uniform
distribution are mixed; the weights depend on how often the pair's first word was
seen as a context, and expectation-maximisation learns them on held-out counts: an
occurrence's own count is deleted from every count it is judged by.

Documents are dealt into blocks of bounded size once.  A block tells, for each of
its distinct words and pairs, its own count, in sorted order; the counts are summed
by ranges of the hash and come back to the block in the same order.  Texts, not
tokens, are what moves, and everything gathered follows the corpus.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import id_part, pick, text_bytes

BLOCK_BYTES = 12 << 20
ROUNDS = 40
# Cells of the held-out statistics: steps per doubling of a probability.
FINE = 2
REMEMBERED = 100_000
WORD, PAIR, TOTALS, WEIGHTS = 1, 2, 3, 4
LEAST_WEIGHT = 1e-6

END = np.uint64(xxhash.xxh3_64_intdigest(b"\nend"))
BEGIN = np.uint64(xxhash.xxh3_64_intdigest(b"\nbegin"))


class _Hashes(dict):
    """64-bit hashes of words; a worker remembers the first ones it meets."""

    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = made
        return made


_HASHES = _Hashes()


def tokens_of(text: str | None) -> np.ndarray:
    """Hashes of the lower-cased words and the end."""
    words = (text or "").encode().lower().split()
    out = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    return np.append(out, END)


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0x632BE59BD9B4E019))
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Block:
    """The tokens of a block's documents, its distinct words and pairs and where each token's are."""

    def __init__(self, texts: list[str | None], training: np.ndarray):
        docs = [tokens_of(t) for t in texts]
        self.lengths = np.array([len(d) for d in docs], dtype=np.int64)
        tokens = np.concatenate(docs) if docs else np.empty(0, np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64) if docs else np.empty(0, np.int64)
        before = np.empty_like(tokens)
        before[1:] = tokens[:-1]
        before[self.starts] = BEGIN
        self.training = np.repeat(training, self.lengths)
        # The start is no word: it is counted for contexts only, beside the words.
        self.words, self.word_at = np.unique(np.append(tokens, BEGIN), return_inverse=True)
        self.begin_at = int(self.word_at[-1])
        self.word_at = self.word_at[:-1]
        self.context_at = np.empty_like(self.word_at)
        self.context_at[1:] = self.word_at[:-1]
        self.context_at[self.starts] = self.begin_at
        self.pairs, self.pair_at = np.unique(_mix(before, tokens), return_inverse=True)

    def own_counts(self, documents: int) -> tuple[np.ndarray, np.ndarray]:
        words = np.bincount(self.word_at[self.training], minlength=len(self.words))
        words[self.begin_at] = documents
        return words, np.bincount(self.pair_at[self.training], minlength=len(self.pairs))


def _ranges(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Bounds of the ``parts`` equal ranges of the hash in a sorted array."""
    edges = [np.uint64((p << 64) // parts) for p in range(1, parts)]
    return np.concatenate([[0], np.searchsorted(hashes, np.array(edges, dtype=np.uint64)), [len(hashes)]])


def _narrow(numbers: np.ndarray) -> bytes:
    """Numbers as bytes of the least width that holds them all, which stands first."""
    width = max(1, (int(numbers.max(initial=0)).bit_length() + 7) // 8)
    raw = np.ascontiguousarray(numbers, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + raw[:, :width].tobytes()


def _wide(raw: bytes) -> np.ndarray:
    body = np.frombuffer(raw, dtype=np.uint8, offset=1).reshape(-1, raw[0])
    out = np.zeros((len(body), 8), dtype=np.uint8)
    out[:, : raw[0]] = body
    return out.view("<u8").ravel().astype(np.int64)


def _steps(hashes: np.ndarray) -> bytes:
    """Sorted hashes as the first and the steps between them."""
    return hashes[:1].tobytes() + _narrow(np.diff(hashes))


def _hashes(raw: bytes) -> np.ndarray:
    steps = np.concatenate([np.frombuffer(raw, dtype=np.uint64, count=1), _wide(raw[8:]).astype(np.uint64)])
    return np.cumsum(steps, dtype=np.uint64)


MESSAGE = "block int, kind int, part int, body binary, tokens long, types long"
MESSAGE_COLUMNS = [c.split()[0] for c in MESSAGE.split(", ")]
ASKED = "kind int, part int, block int, hashes binary, counts binary"


def _asked(rows: pd.DataFrame, parts: int) -> pd.DataFrame:
    """A block's own training counts, a row for each range of the hash."""
    training = (~rows["held_out"]).to_numpy()
    block = Block(rows["text"].tolist(), training)
    words, pairs = block.own_counts(int(training.sum()))
    number = int(rows["block"].iloc[0])
    out = []
    for kind, hashes, counts in ((WORD, block.words, words), (PAIR, block.pairs, pairs)):
        at = _ranges(hashes, parts)
        out += [
            (kind, p, number, _steps(hashes[at[p] : at[p + 1]]), _narrow(counts[at[p] : at[p + 1]]))
            for p in range(parts) if at[p + 1] > at[p]
        ]
    return pd.DataFrame(out, columns=["kind", "part", "block", "hashes", "counts"])


def _summed(rows: pd.DataFrame) -> pd.DataFrame:
    """The corpus counts of one range, laid out as each block asked, and the range's totals."""
    kind, part = int(rows["kind"].iloc[0]), int(rows["part"].iloc[0])
    hashes = [_hashes(h) for h in rows["hashes"]]
    counts = [_wide(c) for c in rows["counts"]]
    known = np.unique(np.concatenate(hashes))
    total = np.zeros(len(known), dtype=np.int64)
    places = [np.searchsorted(known, h) for h in hashes]
    for at, c in zip(places, counts):
        total[at] += c  # a block's hashes are distinct
    out = [(int(b), kind, part, _narrow(total[at]), 0, 0) for b, at in zip(rows["block"], places)]
    if kind == WORD:
        real = total[known != BEGIN]
        out.append((-1, TOTALS, part, b"", int(real.sum()), int((real > 0).sum())))
    return pd.DataFrame(out, columns=MESSAGE_COLUMNS)


class Counts:
    """The corpus counts a block got back, per token."""

    def __init__(self, block: Block, messages: pd.DataFrame):
        by = {k: g.sort_values("part") for k, g in messages.groupby("kind")}
        words = np.concatenate([_wide(b) for b in by[WORD]["body"]])
        pairs = np.concatenate([_wide(b) for b in by[PAIR]["body"]])
        totals = by[TOTALS].iloc[0]
        self.tokens, self.types = int(totals["tokens"]), int(totals["types"])
        self.word, self.context, self.pair = words[block.word_at], words[block.context_at], pairs[block.pair_at]
        self.uniform = 1.0 / (self.types + 1)


def context_bucket(counts: np.ndarray) -> np.ndarray:
    """0 for contexts never seen, else one more than the whole part of the count's logarithm to base 2."""
    return np.where(counts > 0, np.frexp(counts.astype(np.float64))[1], 0)


CELLS = "bucket int, pair_cell int, word_cell int, n long, pair_sum double, word_sum double, uniform double"


def _cell(p: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(p > 0, np.floor(-FINE * np.log2(p)), -1).astype(np.int32)


def _deleted(rows: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
    """Held-out statistics of a block's training tokens, each judged without itself, in cells."""
    if rows.empty:  # a block that no document fell into
        return pd.DataFrame(columns=[x.split()[0] for x in CELLS.split(", ")])
    block = Block(rows["text"].tolist(), (~rows["held_out"]).to_numpy())
    c = Counts(block, messages)
    use = block.training
    context = c.context[use] - 1
    pair_p = np.where(context > 0, (c.pair[use] - 1) / np.maximum(context, 1), 0.0)
    word_p = (c.word[use] - 1) / max(1, c.tokens - 1)
    frame = pd.DataFrame({
        "bucket": context_bucket(context), "pair_cell": _cell(pair_p), "word_cell": _cell(word_p),
        "pair_sum": pair_p, "word_sum": word_p,
    })
    out = frame.groupby(["bucket", "pair_cell", "word_cell"]).agg(n=("pair_sum", "size"), pair_sum=("pair_sum", "sum"), word_sum=("word_sum", "sum"))
    out = out.reset_index()
    out["uniform"] = c.uniform
    return out[[x.split()[0] for x in CELLS.split(", ")]]


def em_weights(n: np.ndarray, parts: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of ``parts`` (a row per estimate, a column per cell) for counts ``n``."""
    weights = np.full(len(parts), 1 / len(parts))
    for _ in range(rounds):
        mixed = weights[:, None] * parts
        share = mixed / np.maximum(mixed.sum(axis=0), 1e-300)
        weights = (share * n).sum(axis=1)
        weights = np.maximum(weights / weights.sum(), LEAST_WEIGHT)
        weights /= weights.sum()
    return weights


def _learned(cells: pd.DataFrame) -> pd.DataFrame:
    """One bucket's weights of pair, word and uniform."""
    bucket = int(cells["bucket"].iloc[0])
    n = cells["n"].to_numpy(dtype=np.float64)
    parts = np.stack([cells["pair_sum"] / n, cells["word_sum"] / n, cells["uniform"].to_numpy(dtype=np.float64)])
    w = em_weights(n, parts)
    if bucket == 0:  # no pair estimate in such contexts
        w = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
    return pd.DataFrame([(-1, WEIGHTS, bucket, w.tobytes(), 0, 0)], columns=MESSAGE_COLUMNS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(rows: pd.DataFrame, messages: pd.DataFrame) -> pd.DataFrame:
    if rows.empty:
        return pd.DataFrame(columns=[x.split()[0] for x in SCORES.split(", ")])
    block = Block(rows["text"].tolist(), (~rows["held_out"]).to_numpy())
    c = Counts(block, messages)
    # A bucket without held-out tokens takes the weights of the nearest fuller one below.
    table = np.tile(np.array([0.0, 0.5, 0.5]), (66, 1))
    learned = messages[messages["kind"] == WEIGHTS].sort_values("part")
    for bucket, body in zip(learned["part"], learned["body"]):
        table[int(bucket) :] = np.frombuffer(body, dtype=np.float64)
    w = table[context_bucket(c.context)]
    pair_p = np.where(c.context > 0, c.pair / np.maximum(c.context, 1), 0.0)
    mixed = w[:, 0] * pair_p + w[:, 1] * (c.word / max(1, c.tokens)) + w[:, 2] * c.uniform
    base = np.log10((c.word + 0.5) / (c.tokens + 0.5 * (c.types + 1)))
    add = lambda x: np.add.reduceat(x, block.starts)  # noqa: E731  every document has its end, so no stretch is empty
    return pd.DataFrame({
        "doc_id": rows["doc_id"].astype("Int64"), "held_out": rows["held_out"].to_numpy(), "n_tokens": block.lengths,
        "n_known": add((c.word > 0).astype(np.int64)), "train_tokens": c.tokens, "base_score": add(base), "score": add(np.log10(mixed)),
    })


def interpolated_scores(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Each document's tokens, known tokens, base score and the model's log10 probability.

    The model learns from documents whose id's crc32 modulo 5 is not 1 (a null id
    counts as 0).  A text is its words, lower-cased in A-Z, and one end; null and empty
    texts are the end alone.  Rows that repeat are counted and scored each.  Without
    training tokens every count is 0 and the uniform distribution over one type is
    left.  A table without rows gives none; other columns are not looked at.
    """
    rows = pick(docs, "doc_id", "text")
    size = rows.agg(F.sum(text_bytes("text") + 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    dealt = rows.select(
        F.pmod(F.xxhash64(F.lit(9), "doc_id", "text"), F.lit(blocks)).cast("int").alias("block"),
        F.col("doc_id").cast("long").alias("doc_id"), (id_part("doc_id", 5) == 1).alias("held_out"), "text",
    ).repartition(blocks, "block")
    each = lambda df: df.drop("block").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*MESSAGE_COLUMNS)

    asked = dealt.groupBy("block").applyInPandas(lambda df: _asked(df, blocks), ASKED)
    told = asked.groupBy("kind", "part").applyInPandas(_summed, MESSAGE)
    # Two sums over the ranges make one row of totals, which every block gets.
    totals = (
        told.where(F.col("kind") == TOTALS).agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
        .select(F.lit(TOTALS).alias("kind"), F.lit(0).alias("part"), F.lit(None).cast("binary").alias("body"), "tokens", "types")
    )
    counts = told.where(F.col("kind") != TOTALS).unionByName(each(totals))
    cells = (
        dealt.groupBy("block").cogroup(counts.groupBy("block")).applyInPandas(_deleted, CELLS)
        .groupBy("bucket", "pair_cell", "word_cell")
        .agg(F.sum("n").alias("n"), F.sum("pair_sum").alias("pair_sum"), F.sum("word_sum").alias("word_sum"), F.max("uniform").alias("uniform"))
    )
    weights = cells.groupBy("bucket").applyInPandas(_learned, MESSAGE)
    return dealt.groupBy("block").cogroup(counts.unionByName(each(weights)).groupBy("block")).applyInPandas(_scored, SCORES)
