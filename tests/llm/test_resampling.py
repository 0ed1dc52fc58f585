import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import resampling
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def lowered(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def features(text):
    words = WORD.findall(lowered(text))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def slow(docs, target):
    buckets = [[zlib.crc32(f.encode()) % 10000 for f in features(t)[1]] for _, t in docs]
    s, t = Counter(b for d in buckets for b in d), Counter(zlib.crc32(f.encode()) % 10000 for x in target for f in features(x)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out = []
    for (i, text), bs in zip(docs, buckets):
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in bs)
        out.append([i, len(bs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(features(text)[0]) >= 20])
    may = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is not None, r[0] or 0))
    for n, r in enumerate(may[: 5 * len(may) // 100]):
        r[4] = n + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


LETTERS = st.sampled_from(["a", "B", "z", "7", " ", "  ", ",", "\n", "é", "ß", "\x00", "\x7f", "日本", "w" * 70, "ab c", "-"])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(LETTERS, max_size=30).map("".join), min_size=1, max_size=6), st.integers(0, 6))
def test_composed_payloads_are_the_hashes_of_the_runs(texts, room):
    made = resampling.Features([t.encode() for t in texts], resampling.Dictionary(room))
    all_ = [features(t) for t in texts]
    expected = np.zeros(97, dtype=np.int64)
    for _, fs in all_:
        for f in fs:
            expected[zlib.crc32(f.encode()) % 97] += 1
    assert (made.counts(97) == expected).all()
    gains = np.arange(97) * 3 - 50
    words, n, weight = made.by_document(gains)
    assert words.tolist() == [len(w) for w, _ in all_] and n.tolist() == [len(f) for _, f in all_]
    assert weight.tolist() == [sum(int(gains[zlib.crc32(x.encode()) % 97]) for x in f) for _, f in all_]


def test_dictionary_takes_in_words_and_keeps_its_bound():
    words = resampling.Dictionary(3)
    for text in (b"one two", b"two three four five", b"one five six"):
        made = resampling.Features([text], words)
        assert made.hashes[0][made.valid[0]].tolist() == [zlib.crc32(w) for w in text.split()]
    assert set(words.known) == {b"one", b"two", b"three"}


def test_query_against_dictionaries(spark, small):
    rows = QUERIES["op11_dictionary_resampling"](spark, small).collect()
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    target = [r["text"] for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]
    assert sorted((tuple(r) for r in rows), key=str) == slow(docs, target)
    assert sum(r["rank"] is not None for r in rows) >= 5


def test_odd_rows(spark):
    odd = odd_docs(spark)
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()] * 12
    many = odd
    for _ in range(11):
        many = many.unionByName(odd)
    target = ["w1 w2 w3", None, ""]
    rows = resampling.importance_resample(many, docs_of(spark, target)).select("doc_id", "n_features", "weight", "score", "rank").collect()
    assert sorted((tuple(r) for r in rows), key=str) == slow(docs, target)
    ranks = sorted(r["rank"] for r in rows if r["rank"] is not None)
    assert ranks == list(range(1, len(ranks) + 1)) and ranks
    assert resampling.importance_resample(no_docs(spark), docs_of(spark, target)).count() == 0
    assert resampling.importance_resample(odd, no_docs(spark)).count() == odd.count()
