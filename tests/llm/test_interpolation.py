import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from quire.llm import interpolation as lm
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs, odd_rows

LOWER = {c: c + 32 for c in range(65, 91)}


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)) + ["\nend"]


def brute(docs):
    """Counts, EM over every training token one by one, and scores, with dictionaries."""
    train = [d for d, _ in docs if zlib.crc32(("" if d is None else str(d)).encode()) % 5 != 1]
    train_set = set(train)
    words, pairs, contexts = Counter(), Counter(), Counter()
    for d, text in docs:
        if d in train_set:
            before = "\nbegin"
            for w in tokens(text):
                words[w] += 1
                pairs[before, w] += 1
                contexts[before] += 1
                before = w
    n, v = sum(words.values()), len(words)
    held = {}
    for d, text in docs:
        if d in train_set:
            before = "\nbegin"
            for w in tokens(text):
                c = contexts[before] - 1
                p = ((pairs[before, w] - 1) / c if c else 0.0, (words[w] - 1) / max(1, n - 1), 1 / (v + 1))
                held.setdefault(c.bit_length(), []).append(p)
                before = w
    weights = {}
    for bucket, ps in held.items():
        w = lm.em_weights(np.ones(len(ps)), np.array(ps).T)
        if bucket == 0:
            w = np.array([0.0, w[1], w[2]]) / (w[1] + w[2])
        weights[bucket] = w

    def weight(bucket):
        known = [b for b in weights if b <= bucket]
        return weights[max(known)] if known else np.array([0.0, 0.5, 0.5])

    out = []
    for d, text in docs:
        score, before = 0.0, "\nbegin"
        for w in tokens(text):
            c = contexts[before]
            a = weight(c.bit_length())
            score += math.log10(a[0] * (pairs[before, w] / c if c else 0) + a[1] * words[w] / max(1, n) + a[2] / (v + 1))
            before = w
        base = sum(math.log10((words[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(text))
        out.append((d, len(tokens(text)), sum(words[w] > 0 for w in tokens(text)), n, base, score))
    return out


def compare(rows, expected, score_within):
    key = lambda x: (x[0] is None, x[0] or 0, x[1], x[4])
    got = sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in rows], key=key)
    for a, b in zip(got, sorted(expected, key=key), strict=True):
        assert a[:4] == b[:4]
        assert a[4] == pytest.approx(b[4], rel=1e-9)
        assert a[5] == pytest.approx(b[5], rel=score_within)


def test_query_against_dictionaries(spark, small):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    rows = QUERIES["op9_deleted_interpolation"](spark, small).collect()
    # EM sees tokens in cells of half an octave, the brute force one by one.
    compare(rows, brute(docs), 0.01)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) for r in rows)


def test_blocks_do_not_change_scores(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    one = {r["doc_id"]: r["score"] for r in lm.interpolated_scores(docs).collect()}
    many = {r["doc_id"]: r["score"] for r in lm.interpolated_scores(docs, block_bytes=20_000).collect()}
    assert one.keys() == many.keys() and all(one[d] == pytest.approx(many[d], rel=1e-9) for d in one)


def test_model_beats_the_base_on_held_out_texts(spark, small):
    rows = [r for r in QUERIES["op9_deleted_interpolation"](spark, small).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_odd_rows(spark):
    compare(lm.interpolated_scores(odd_docs(spark), block_bytes=50_000).collect(), brute([(r[1], r[2]) for r in odd_rows()]), 0.02)
    assert lm.interpolated_scores(no_docs(spark)).count() == 0
    held = next(i for i in range(50) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = docs_of(spark, ["nothing was learned"] * (held + 1)).where(f"doc_id = {held}")
    row = lm.interpolated_scores(only).first()
    assert (row["train_tokens"], row["n_known"], row["n_tokens"]) == (0, 0, 4) and math.isfinite(row["score"])


def test_counts_survive_their_packing():
    rng = np.random.default_rng(1)
    for top in (1, 200, 70_000, 1 << 40):
        counts = rng.integers(0, top, 50)
        assert (lm._wide(lm._narrow(counts)) == counts).all()
    hashes = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64) * np.uint64(2))
    assert (lm._hashes(lm._steps(hashes)) == hashes).all() and (lm._hashes(lm._steps(hashes[:1])) == hashes[:1]).all()
