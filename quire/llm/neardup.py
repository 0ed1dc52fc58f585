"""Near-duplicate documents by MinHash with odd sketches.

A document's distinct word shingles give MinHash samples.  Bands of samples propose
candidates; the samples folded into a parity bitmap (an odd sketch) tell by the
population count of two sketches' XOR how alike two sets are, so only likely pairs
are verified on full sets.  Within a bucket, members meet the one nearest to the
bitwise majority of all sketches; what that leaves apart is then compared across
components.  Links become components by contraction.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quire.llm.shared import packed, pick, stored, unpacked

WORDS = 5
SIMILAR = 75  # percent of the union that two sets share
BANDS, ROWS = 32, 4
SAMPLES = 256  # the first BANDS * ROWS of them make the bands
BITS = 1024
# Pairs whose sketches tell less are no candidates: four deviations below the threshold
# for the sketch of the samples.  That of the set is finer up to SET_SAMPLES shingles;
# beyond, half as many may be sampled, and estimates at the threshold then deviate by up
# to 0.0192 (sqrt(0.75 * 0.25 / 512) and the bitmap), with a longer tail below, so its
# bound lies five of these below.
LEAST_ESTIMATE = 0.63
SET_BITS, SET_SAMPLES = 2048, 1024
LEAST_SET_ESTIMATE = 0.65
SAMPLED = BITS // 64  # 64-bit words of the first sketch
# Members of a bucket that are compared in one piece, how many of the nearest a member
# meets first, and shingles sampled in one piece.
GROUP = 4096
NEAREST = 2
PIECE = 1 << 16
# Up to so many rows (about 20 MB), the keys of the texts to verify are broadcast.
SMALL = 500_000
# Documents signed at a time, and words whose hashes a worker remembers.
SLICE = 500
REMEMBERED = 100_000

_RANDOM = np.random.default_rng(4)
_TIMES = _RANDOM.integers(1 << 31, size=SAMPLES, dtype=np.int64).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_PLUS = _RANDOM.integers(1 << 32, size=SAMPLES, dtype=np.int64).astype(np.uint32)
_SPOT = _RANDOM.integers(1 << 62, size=SAMPLES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        made = xxhash.xxh3_64_intdigest(word)
        if len(self) < REMEMBERED:
            self[word] = made
        return made


_HASHES = _Hashes()


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle are one."""
    words = (text or "").encode().lower().split()
    h = np.fromiter(map(_HASHES.__getitem__, words), dtype=np.uint64, count=len(words))
    if not len(h):
        return h
    width = min(WORDS, len(h))
    n = len(h) - width + 1
    out = np.full(n, width, dtype=np.uint64)
    for k in range(width):
        out = (out ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= SIMILAR * (len(a) + len(b) - shared)


def samples(sets: list[np.ndarray]) -> np.ndarray:
    """MinHash samples, a row per (non-empty) set."""
    out = np.empty((len(sets), SAMPLES), dtype=np.uint32)
    at = 0
    while at < len(sets):
        end, size = at, 0
        while end < len(sets) and (end == at or size + len(sets[end]) <= PIECE):
            size += len(sets[end])
            end += 1
        all_ = np.concatenate(sets[at:end])
        folded = (all_ ^ (all_ >> np.uint64(32))).astype(np.uint32)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]])]).astype(np.int64)
        for i in range(SAMPLES):
            out[at:end, i] = np.minimum.reduceat(folded * _TIMES[i] + _PLUS[i], starts)
        at = end
    return out


def bands(values: np.ndarray) -> np.ndarray:
    """A 64-bit key for each band, its number mixed in."""
    n = len(values)
    parts = values[:, : BANDS * ROWS].reshape(n, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (n, BANDS)).copy()
    for r in range(ROWS):
        key = (key ^ parts[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def odd_sketches(values: np.ndarray) -> np.ndarray:
    """Parity bitmaps of the samples, as 64-bit words."""
    spot = (values.astype(np.uint64) + np.uint64(1)) * _SPOT
    spot = (spot >> np.uint64(64 - int(math.log2(BITS)))).astype(np.int64)
    rows = np.arange(len(values))[:, None] * BITS
    odd = np.bincount((rows + spot).ravel(), minlength=len(values) * BITS) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(values), BITS), axis=1).view(np.uint64)


def apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ."""
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


# The estimate 1 + BITS / (4 SAMPLES) ln(1 - 2 apart / BITS) as a bound of the bits.
MOST_APART = int(BITS / 2 * (1 - math.exp(-4 * SAMPLES * (1 - LEAST_ESTIMATE) / BITS)))



def set_sketch(shingles: np.ndarray) -> np.ndarray:
    """Odd sketches of the set itself: level, two counts, two bitmaps.

    At level L the shingles whose hashes begin with L zeros are taken; L is the least
    that leaves about ``SET_SAMPLES``, and L + 1 stands beside it, because two similar
    sets are at most one level apart.
    """
    level = max(0, math.ceil(math.log2(len(shingles) / SET_SAMPLES)))
    out = np.zeros(3 + 2 * SET_BITS // 64, dtype=np.uint64)
    out[0] = level
    for k in range(2):
        taken = shingles[: np.searchsorted(shingles, np.uint64((1 << (64 - level - k)) - 1), side="right")]
        spot = ((taken * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - int(math.log2(SET_BITS)))).astype(np.int64)
        odd = np.bincount(spot, minlength=SET_BITS) & 1
        out[1 + k] = len(taken)
        at = 3 + k * SET_BITS // 64
        out[at : at + SET_BITS // 64] = np.packbits(odd.astype(np.uint8)).view(np.uint64)
    return out


def similarity(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The similarity that two set sketches tell, row by row; 0 for sets of too different sizes."""
    level = np.maximum(a[:, 0], b[:, 0])
    ka, kb = (level - a[:, 0]).astype(np.int64), (level - b[:, 0]).astype(np.int64)
    fits = (ka < 2) & (kb < 2)
    ka, kb = np.minimum(ka, 1), np.minimum(kb, 1)
    rows = np.arange(len(a))
    both = (a[rows, 1 + ka] + b[rows, 1 + kb]).astype(np.float64)
    words = SET_BITS // 64
    bits = apart(a[:, 3:].reshape(-1, 2, words)[rows, ka], b[:, 3:].reshape(-1, 2, words)[rows, kb])
    differ = -SET_BITS / 2 * np.log(np.maximum(1 - 2 * bits / SET_BITS, 1e-9))
    return np.where(fits & (both > 0), (both - differ) / np.maximum(both + differ, 1), 0.0)


SIGNED = "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>, sketch binary"


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for at in range(0, len(batch), SLICE):  # small slices: samples and bitmaps are wider than texts
            yield _signed_slice(batch.iloc[at : at + SLICE])


def _signed_slice(rows: pd.DataFrame) -> pd.DataFrame:
    sets = [shingle_set(t) for t in rows["text"]]
    full = [i for i, s in enumerate(sets) if len(s)]
    keys: list = [None] * len(sets)
    band_keys: list = [None] * len(sets)
    sketches: list = [None] * len(sets)
    if full:
        values = samples([sets[i] for i in full])
        for i, b, s in zip(full, bands(values), odd_sketches(values)):
            keys[i] = xxhash.xxh3_128_digest(sets[i].tobytes())
            band_keys[i], sketches[i] = b, np.concatenate([s, set_sketch(sets[i])]).tobytes()
    return pd.DataFrame({
        "doc_id": rows["doc_id"].astype("Int64"), "text_hash": rows["text_hash"], "n_shingles": [len(s) for s in sets],
        "set_key": keys, "bands": band_keys, "sketch": sketches,
    })


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Whole groups of rows that come sorted by ``keys``: a frame and where its groups begin."""
    held: list[pd.DataFrame] = []

    def starts(frame: pd.DataFrame) -> np.ndarray:
        new = np.ones(len(frame), dtype=bool)
        values = frame[keys].to_numpy()
        new[1:] = (values[1:] != values[:-1]).any(axis=1)
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        if held and not (held[-1][keys].iloc[-1] == batch[keys].iloc[-1]).all():
            frame = pd.concat([*held, batch], ignore_index=True)
            held = []
        elif held:
            held.append(batch)
            continue
        else:
            frame = batch.reset_index(drop=True)
        at = starts(frame)
        if len(at) > 1:
            yield frame.iloc[: at[-1]], at[:-1]
        held = [frame.iloc[at[-1] :]]
    if held:
        frame = pd.concat(held, ignore_index=True)
        yield frame, starts(frame)


def _sketch_rows(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["sketch"]), dtype=np.uint64).reshape(len(frame), -1)


def likely(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two sketches may be similar: first by their samples, then by their sets."""
    near = apart(a[:, :SAMPLED], b[:, :SAMPLED]) <= MOST_APART
    at = np.flatnonzero(near)
    near[at] = similarity(a[at, SAMPLED:], b[at, SAMPLED:]) >= LEAST_SET_ESTIMATE
    return near


def centre(sketches: np.ndarray) -> int:
    """The member nearest to the bitwise majority."""
    sketches = np.ascontiguousarray(sketches[:, :SAMPLED])
    ones = np.unpackbits(sketches.view(np.uint8), axis=1).sum(axis=0, dtype=np.int64)
    majority = np.packbits((2 * ones > len(sketches)).astype(np.uint8)).view(np.uint64)
    return int(np.argmin(apart(sketches, majority)))


def _stars(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Candidates between the centre of each group and its other members."""
    for frame, at in _grouped(batches, ["bucket", "piece"]):
        sketch, node = _sketch_rows(frame), frame["node"].to_numpy()
        ends = np.append(at[1:], len(frame))
        two = at[ends - at == 2]
        left, right = [two], [two + 1]
        for start, end in zip(at[ends - at > 2], ends[ends - at > 2]):
            middle = start + centre(sketch[start:end])
            others = np.delete(np.arange(start, end), middle - start)
            left.append(np.full(len(others), middle))
            right.append(others)
        a, b = np.concatenate(left), np.concatenate(right)
        near = likely(sketch[a], sketch[b])
        a, b = node[a[near]], node[b[near]]
        yield pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})


def _across(batches: Iterator[pd.DataFrame], keys: list[str], nearest: int | None = None) -> Iterator[pd.DataFrame]:
    """Candidates between different components of a group: all, or each member's ``nearest``.

    The members of a group's largest component are met by the others only.  In a
    group of two pieces, members of one piece do not meet.  A pair that shares an earlier
    band has met in that bucket, so it is told once.
    """
    for frame, at in _grouped(batches, keys):
        sketch, node, root = _sketch_rows(frame), frame["node"].to_numpy(), frame["root"].to_numpy()
        piece, bucket = frame["piece"].to_numpy(), frame["bucket"].to_numpy()
        keys_of = np.stack(frame["bands"].to_numpy()) if nearest is None else None
        both = (frame["one"] != frame["other"]).to_numpy() if "one" in keys else np.zeros(len(frame), dtype=bool)
        for start, end in zip(at, np.append(at[1:], len(frame))):
            names, counts = np.unique(root[start:end], return_counts=True)
            largest = names[np.argmax(counts)]
            met = np.zeros(end - start, dtype=bool)
            found = []
            for i in np.flatnonzero(root[start:end] != largest):
                me = start + i
                met[i] = True
                bits = apart(sketch[start:end, :SAMPLED], sketch[me, :SAMPLED])
                near = (bits <= MOST_APART) & (root[start:end] != root[me])
                if both[me]:
                    near &= piece[start:end] != piece[me]
                if nearest is None:
                    near &= ~met
                    first = int(np.argmax(keys_of[me] == bucket[me]))
                    near &= ~(keys_of[start:end, :first] == keys_of[me, :first]).any(axis=1)
                others = np.flatnonzero(near)
                mine = np.broadcast_to(sketch[me], (len(others), sketch.shape[1]))
                others = others[likely(mine, sketch[start + others])]
                if nearest is not None and len(others) > nearest:
                    others = others[np.argsort(bits[others], kind="stable")[:nearest]]
                if len(others):
                    other = node[start + others]
                    found.append(np.stack([np.minimum(other, node[me]), np.maximum(other, node[me])]))
            if found:
                a, b = np.concatenate(found, axis=1)
                yield pd.DataFrame({"a": a, "b": b}).drop_duplicates()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for every node of ``edges`` (a, b): one root a component.

    Each round hooks a node to the neighbour of the least hash and contracts the graph,
    so long chains shrink as fast as stars; a round's tables are stored.
    """
    least = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
    edges = stored(edges.select("a", "b"), "edges")
    roots = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("root", F.col("node")), "roots")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        hooks = stored(
            both.groupBy("a").agg(F.min(least("b")).alias("best")).select("a", F.least("best", least("a"))["n"].alias("up")), "hooks"
        )
        roots = stored(
            roots.join(hooks, F.col("root") == F.col("a"), "left").select("node", F.coalesce("up", "root").alias("root")), "roots"
        )
        edges = stored(
            edges.join(hooks.select("a", F.col("up").alias("a_up")), "a")
            .join(hooks.select(F.col("a").alias("b"), F.col("up").alias("b_up")), "b")
            .where("a_up <> b_up")
            .select(F.least("a_up", "b_up").alias("a"), F.greatest("a_up", "b_up").alias("b")).distinct(),
            "edges",
        )
    return roots


@F.pandas_udf(T.BooleanType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    known: dict[str, np.ndarray] = {}

    def set_of(text: str) -> np.ndarray:
        if text not in known:
            if len(known) > 64:
                known.clear()
            known[text] = shingle_set(text)
        return known[text]

    return pd.Series([similar(set_of(x), set_of(y)) for x, y in zip(a, b)], dtype=bool)


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of the distinct ``pairs`` (a, b) whose full sets are similar."""
    wanted = stored(
        pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        .join(classes.select("node", F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash")), "node"),
        "texts-wanted",
    )
    small = F.broadcast(wanted) if wanted.count() <= SMALL else wanted
    found = stored(
        texts.join(small, F.col("doc_id").eqNullSafe(F.col("w_id")) & (F.col("text_hash") == F.col("w_hash")))
        .groupBy("node").agg(F.first("text").alias("text")),
        "texts-found",
    )
    return stored(
        pairs.join(found.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        .join(found.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        .where(_alike("text_a", "text_b")).select("a", "b"),
        "links",
    )


def _apart_pairs(members: DataFrame, roots: DataFrame, sketches: DataFrame, nearest: int | None) -> DataFrame:
    """Candidates inside buckets that still hold several components.

    Buckets of two members are settled.  ``nearest`` looks inside the pieces of a
    bucket only; without it every two pieces meet.
    """
    placed = stored(
        members.where("n > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "placed-members"
    )
    mixed = stored(
        placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("bucket"),
        "mixed-buckets",
    )
    met, keys = placed.join(mixed, "bucket"), ["bucket", "piece"]
    if nearest is None:
        pieces = F.ceil(F.col("n") / F.lit(GROUP)).cast("int")
        met = (
            met.withColumn("with", F.explode(F.sequence(F.lit(0), pieces - 1)))
            .withColumn("one", F.least("piece", "with")).withColumn("other", F.greatest("piece", "with"))
        )
        keys = ["bucket", "one", "other"]
    wanted = ["sketch"] if nearest is not None else ["sketch", "bands"]
    return (
        met.join(sketches.select("node", *wanted), "node").select(*dict.fromkeys([*keys, "piece", "node", "root", *wanted]))
        .repartition(*keys).sortWithinPartitions(*keys)
        .mapInPandas(lambda batches: _across(batches, keys, nearest), "a long, b long").distinct()
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per document ``n_shingles``, ``component_id``, ``kept`` (and ``text_hash``, its text's hash).

    Texts with equal sets are one class, and pairs stand between classes, so copies
    cost nothing.  A pair that meets the threshold shares no band with a probability
    of 5 in a million.  ``component_id`` is the least id a document is linked with,
    over any number of links, itself included.

    Documents without words are alone.  A null id is passed over when the least id is
    sought; where no id is left the component has none.  ``kept`` holds where the id
    is the component's; rows that repeat whole, id included, are kept or not as one.
    A table without rows gives none; other columns are not looked at.
    """
    texts = pick(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(4), "text").alias("text_hash"), "text"
    )
    signed = stored(texts.mapInPandas(_signed, SIGNED), "signatures")
    classes = stored(
        signed.where("set_key is not null").groupBy("set_key")
        .agg(
            F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "text_hash")).alias("one"),
            F.first("bands").alias("bands"), F.first("sketch").alias("sketch"),
        )
        .select(
            F.monotonically_increasing_id().alias("node"), "set_key", "least_id", "one.doc_id", "one.text_hash", "bands", "sketch"
        ),
        "classes",
    )
    all_members = classes.select("node", F.explode("bands").alias("bucket"))
    buckets = stored(all_members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    piece = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / F.lit(GROUP))).cast("int")
    members = stored(all_members.join(buckets, "bucket").withColumn("piece", piece), "members")
    sketches = classes.select("node", "sketch", "bands")

    stars = stored(
        members.join(sketches.drop("bands"), "node").select("bucket", "piece", "node", "sketch")
        .repartition("bucket", "piece").sortWithinPartitions("bucket", "piece")
        .mapInPandas(_stars, "a long, b long").distinct(),
        "stars",
    )
    links = _verified(stars, classes, texts)
    roots = components(links)

    # What a centre leaves apart mostly hangs on another copy: the nearest ones come
    # first, so that few members are left for the comparison of everything still apart.
    tested = stars
    for nearest in (NEAREST, None):
        pairs = stored(_apart_pairs(members, roots, sketches, nearest).join(tested, ["a", "b"], "left_anti"), "across")
        links = stored(links.union(_verified(pairs, classes, texts)), "links")
        tested = tested.union(pairs)
        roots = components(links)

    owned = stored(
        classes.join(roots, "node", "left").select("set_key", "least_id", F.coalesce("root", "node").alias("root")), "owned-classes"
    )
    least = stored(owned.groupBy("root").agg(F.min("least_id").alias("component")), "least-ids")
    named = stored(owned.join(least, "root").select("set_key", "component"), "named-classes")
    return (
        signed.select("doc_id", "text_hash", "n_shingles", "set_key").join(named, "set_key", "left")
        .withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component")))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents whose component goes by their own id, their columns unchanged."""
    kept = near_duplicates(docs).where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash"))
    rows = packed(docs, "doc_id", "text").withColumn("hash", F.xxhash64(F.lit(4), "text"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("k_id")) & (F.col("hash") == F.col("k_hash"))
    return rows.join(kept, same, "left_semi").select(*unpacked(docs.columns, {}))
