import random
import re
from collections import Counter, defaultdict

import numpy as np

from quire.llm import neardup
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs, odd_rows, words

LOWER = {c: c + 32 for c in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    """Least reachable ids by comparing every pair that shares a shingle."""
    sets = {d: shingles(t) for d, t in docs.items()}
    up = {d: d for d in docs}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        shared = Counter(e for x in s for e in holders[x])
        for e, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[e]) - n):
                a, b = sorted((find(d), find(e)))
                up[b] = a
        for x in s:
            holders[x].append(d)
    return {d: (len(sets[d]), find(d)) for d in docs}


def compare(rows, docs):
    expected = brute(docs)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_query_against_shared_shingles(spark, small):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    compare(QUERIES["op4_odd_sketches"](spark, small).collect(), docs)


def changed(rng, text, share):
    return " ".join(f"x{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split())


def test_families_whose_copies_hang_on_one_text(spark):
    """Copies near the threshold: many are linked with the original alone, some only through another copy."""
    rng = random.Random(8)
    texts = []
    for size, share in ((120, 0.02), (40, 0.03), (30, 0.01), (25, 0.06)):
        original = words(rng, 150, 10**6)
        family = [changed(rng, original, share) for _ in range(size)]
        at = rng.randrange(size)
        texts += [*family[:at], original, *family[at:]]
    chain = [words(rng, 100, 10**6)]
    for _ in range(40):  # each linked with its neighbours only
        chain.append(" ".join(chain[-1].split()[12:]) + " " + words(rng, 12, 10**6))
    texts += chain + [words(rng, 60, 10**6) for _ in range(50)] + ["Short TEXT", "short text", "short  text !"]
    rng.shuffle(texts)
    compare(neardup.near_duplicates(docs_of(spark, texts)).collect(), dict(enumerate(texts)))


def test_buckets_in_several_pieces(spark, monkeypatch):
    rng = random.Random(9)
    original = words(rng, 120, 10**6)
    texts = [changed(rng, original, 0.02) for _ in range(60)] + [original]
    monkeypatch.setattr(neardup, "GROUP", 8)
    compare(neardup.near_duplicates(docs_of(spark, texts)).collect(), dict(enumerate(texts)))


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(1)
    errors = []
    for similarity in (0.95, 0.85, 0.75):
        for _ in range(40):
            n = 600
            shared = int(2 * n * similarity / (1 + similarity))
            all_ = rng.integers(1, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64)
            a, b = all_[:n], np.concatenate([all_[:shared], all_[n : 2 * n - shared]])
            sketch = neardup.odd_sketches(neardup.samples([np.unique(a), np.unique(b)]))
            bits = neardup.apart(sketch[0], sketch[1])
            assert bits <= neardup.MOST_APART
            errors.append(1 + neardup.BITS / (4 * neardup.SAMPLES) * np.log(1 - 2 * bits / neardup.BITS) - similarity)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.04


def test_set_sketches_are_finer_at_every_size():
    rng = np.random.default_rng(2)
    for n in (5, 60, 600, 1030, 5000, 60_000):
        errors = []
        for similarity in (0.9, 0.75):
            for _ in range(30):
                shared = max(1, int(2 * n * similarity / (1 + similarity)))
                all_ = rng.integers(1, 1 << 63, 2 * n, dtype=np.int64).astype(np.uint64) * np.uint64(2)
                a, b = np.unique(all_[:n]), np.unique(np.concatenate([all_[:shared], all_[n : 2 * n - shared]]))
                true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
                got = neardup.similarity(neardup.set_sketch(a)[None], neardup.set_sketch(b)[None])[0]
                errors.append(got - true)
                assert true < 0.75 or got >= neardup.LEAST_SET_ESTIMATE
        assert np.std(errors) < 0.015, n


def test_components_of_chains_and_stars(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(2000, 2001), (2001, 2000)]
    rng.shuffle(edges)
    rows = neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for r in rows:
        groups[r["root"]].add(r["node"])
    assert sorted(map(len, groups.values())) == [2, 200, 301]
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(spark):
    rows = neardup.near_duplicates(odd_docs(spark)).collect()
    assert len(rows) == len(odd_rows())
    compare([r for r in rows if r["doc_id"] is not None and r["doc_id"] not in (3, 7)], {r[1]: r[2] for r in odd_rows() if r[1] not in (None, 3, 7)})
    assert [(r["component_id"], r["kept"]) for r in rows if r["doc_id"] in (3, 7)] == [(r["doc_id"], True) for r in rows if r["doc_id"] in (3, 7)]
    assert all(r["component_id"] is None and r["kept"] for r in rows if r["doc_id"] is None)
    both = docs_of(spark, ["a b c d e f g", "a b c d e f g"]).selectExpr("nullif(doc_id, 0) as doc_id", "text")
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in neardup.near_duplicates(both).collect()) == [(0, 1, False), (1, 1, True)]
    assert neardup.near_duplicates(no_docs(spark)).count() == 0
    kept = neardup.keep_one(odd_docs(spark))
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_rows())


def test_set_sketches_keep_long_pairs_at_the_threshold():
    rng = np.random.default_rng(3)
    errors = []
    for n in (1030, 2100, 4200, 8300):
        for small in (n, -(-3 * n // 4)):  # sets of one size, and one inside the other
            for _ in range(500):
                shared = -(-3 * (n + small) // 7)
                x = rng.integers(0, 1 << 64, n + small - shared, dtype=np.uint64)
                a, b = np.unique(x[:small]), np.unique(np.concatenate([x[:shared], x[small:]]))
                assert neardup.similar(a, b)
                got = neardup.similarity(neardup.set_sketch(a)[None], neardup.set_sketch(b)[None])[0]
                assert got >= neardup.LEAST_SET_ESTIMATE
                errors.append(got - 0.75)
    assert np.std(errors) * 4.42 < 0.75 - neardup.LEAST_SET_ESTIMATE  # 5 in a million
