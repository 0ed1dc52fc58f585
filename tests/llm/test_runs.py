import hashlib
import random
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import runs
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs


def brute(words):
    """Runs by trying every period from the least up at every place."""
    n, found = len(words), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j > i and (j + p - i) >= max(6, 4 * p) and (i, j + p) not in found:
                found[i, j + p] = p
            i = max(j, i + 1)
    return sorted(((s, e - s, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def smallest_period(words):
    return next(p for p in range(1, len(words) + 1) if all(words[i] == words[i - p] for i in range(p, len(words))))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=90), min_size=1, max_size=8))
def test_streams_find_the_runs_of_every_document(docs):
    texts = [[b"w%d" % x for x in d] for d in docs]
    got = runs.runs_of(runs.numbered(texts))
    assert got == [brute(t) for t in texts]
    for t, found in zip(texts, got):
        assert all(smallest_period(t[s : s + n]) == p for s, n, p in found)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 70), st.integers(4, 9), st.integers(0, 40), st.integers(0, 2**31))
def test_planted_periods_of_any_length(period, times, tail, seed):
    rng = random.Random(seed)
    unit = [rng.randrange(3) for _ in range(period)]
    doc = [rng.randrange(3) for _ in range(tail)] + unit * times + unit[: tail % period] + [rng.randrange(3) for _ in range(tail)]
    assert runs.runs_of([np.array(doc)]) == [brute(doc)]


def test_nested_runs_and_multiples():
    doc = (["a"] * 8 + ["b"]) * 5
    found = brute(doc)
    assert runs.runs_of(runs.numbered([[w.encode() for w in doc]])) == [found]
    assert (0, 45, 9) in found and (0, 8, 1) in found and len(found) == 6
    kept = runs.collapsed([w.encode() for w in doc], found)
    assert kept == [b"a", b"b"]  # the first period, itself without its repeats


def slow_row(doc_id, text):
    words = (text or "").encode().split()
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is not None and h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
    return (
        doc_id, len(found), *best, None if not found else 1000 * best[1] // best[2],
        hashlib.sha256("".join("%d,%d,%d\n" % r for r in found).encode()).hexdigest(),
        hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest(),
    )


def test_query_against_brute_force(spark, small):
    rows = QUERIES["op13_dyadic_squares"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    short = {d["doc_id"]: d["text"] for d in docs if len(d["text"] or "") < 9000}
    assert len(rows) == len(docs) and len(short) > 150
    got = {r["doc_id"]: tuple(r) for r in rows}
    assert all(got[i] == slow_row(i, t) for i, t in short.items())
    assert sum(r["n_runs"] > 0 for r in rows) >= len(rows) // 20


def test_odd_rows(spark):
    rows = odd_docs(spark).collect()
    out = runs.digest(runs.periodic_runs(odd_docs(spark))).collect()
    assert len(out) == len(rows)
    empty = hashlib.sha256(b"").hexdigest()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    for i in (0, 1, 2):
        assert by[i][0][1:] == (0, None, None, None, None, empty, empty)
    assert len(by[7]) == 3 and len(set(by[7])) == 1 and len(by[None]) == 2
    assert by[8][0]["period"] == 5 and by[8][0]["length"] == 200  # forty lines of five words
    assert runs.periodic_runs(no_docs(spark)).count() == 0


def test_no_run_crosses_documents_and_texts_come_back(spark):
    out = runs.periodic_runs(docs_of(spark, ["x x x", "x x x", "y " * 7 + "z", "a b a b"])).orderBy("doc_id").collect()
    assert [len(r["runs"]) for r in out] == [0, 0, 1, 0]
    assert [r["text"] for r in out] == ["x x x", "x x x", "y z", "a b a b"]
    assert [r["n_words"] for r in out] == [3, 3, 8, 2]
