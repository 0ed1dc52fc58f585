import hashlib
import random

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import suffixes
from quire.llm.queries import QUERIES, SQL
from tests.llm.cases import docs_of, no_docs, odd_docs, words

L = suffixes.LEAST


def slow(docs):
    """(id, spans, kept) of every (id, bytes) by a dictionary of all strings."""
    least = {}
    for i, t in docs:
        for p in range(len(t) - L + 1):
            s = t[p : p + L]
            if i is not None and i < least.get(s, i + 1):
                least[s] = i
    out = []
    for i, t in docs:
        gone = np.zeros(len(t) + 2, dtype=int)
        for p in range(len(t) - L + 1):
            if i is not None and least[t[p : p + L]] < i:
                gone[p + 1 : p + L + 1] = 1
        edge = np.flatnonzero(np.diff(gone))
        spans = [(int(b), int(e - b)) for b, e in zip(edge[::2], edge[1::2])]
        out.append((i, spans, bytes(c for c, g in zip(t, gone[1:]) if not g)))
    return sorted(out, key=str)


def by_blocks(docs, blocks, ranges, parts, monkeypatch=None):
    """The operator's steps, one call a group, without a session."""
    import pandas as pd

    dealt = {}
    for row, (i, t) in enumerate(docs):
        dealt.setdefault(row % blocks, []).append((row % blocks, row, i is not None, i or 0, t))
    dealt = {b: pd.DataFrame(r[::-1], columns=["block", "row", "named", "doc_id", "text"]) for b, r in dealt.items()}
    group = lambda df, *by: [g for _, g in df.groupby(list(by))] if len(df) else []
    cat = lambda dfs, schema: pd.concat(dfs) if dfs else pd.DataFrame(columns=suffixes._names(schema))
    asked = cat([suffixes._ask(d, ranges) for d in dealt.values()], suffixes.ASKED)
    grams = cat([suffixes._tell_grams(g) for g in group(asked, "kind", "part")], suffixes.TOLD)
    sent = cat([suffixes._send(d, grams[grams["block"] == b], parts) for b, d in dealt.items()], suffixes.SENT)
    bits = cat([suffixes._tell_stretches(g) for g in group(sent, "kind", "part")], suffixes.TOLD)
    told = pd.concat([grams, bits])
    out = cat([suffixes._cut(d, told[told["block"] == b]) for b, d in dealt.items()], "x int")
    return sorted(
        ((None if pd.isna(i) else int(i), [(s["start"], s["length"]) for s in spans], kept) for i, spans, kept in zip(out["doc_id"], out["spans"], out["kept"])),
        key=str,
    )


@st.composite
def corpora(draw):
    rng = random.Random(draw(st.integers(0, 2**32)))
    letters = draw(st.sampled_from([b"a", b"ab", b"abcdefgh", bytes(range(256))]))
    some = lambda n: bytes(rng.choice(letters) for _ in range(n))
    shared = [some(rng.choice([10, 49, 50, 51, 60, 120, 300])) for _ in range(4)]
    docs = []
    for _ in range(draw(st.integers(1, 9))):
        t = b"".join(rng.choice(shared) if rng.random() < 0.5 else some(rng.randrange(80)) for _ in range(rng.randrange(6)))
        docs.append((rng.choice([None, *range(-3, 6)]), t))
    return docs


@settings(max_examples=120, deadline=None)
@given(corpora(), st.integers(1, 3), st.integers(1, 3), st.integers(1, 3))
def test_blocks_agree_with_all_strings(docs, blocks, ranges, parts):
    assert by_blocks(docs, blocks, ranges, parts) == slow(docs)


@pytest.mark.parametrize("piece,wide,together", [(64, 0, 5), (200, 1, 1), (1 << 20, 0, 3), (100, 20_000, 2)])
def test_small_bounds_change_nothing(monkeypatch, piece, wide, together):
    monkeypatch.setattr(suffixes, "PIECE_BYTES", piece)
    monkeypatch.setattr(suffixes, "WIDE", wide)
    monkeypatch.setattr(suffixes, "TOGETHER", together)
    rng = random.Random(piece)
    passage, line = words(rng, 60).encode(), b"terms and conditions apply to all of these offers, see over"
    docs = [(i, (words(rng, 30).encode() + line + words(rng, 5).encode()) * 2 + passage[rng.randrange(200) :]) for i in range(12)]
    docs += [(20, docs[3][1]), (21, b"-" * 400), (22, b"-" * 120), (20, docs[3][1])]
    assert by_blocks(docs, 3, 2, 3) == slow(docs)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=60))
def test_neighbours_in_suffix_order(values):
    before, behind = suffixes.earlier_neighbours(np.array(values))
    n = len(values)
    assert before.tolist() == [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
    assert behind.tolist() == [min((j for j in range(i + 1, n) if values[j] < values[i]), default=n) for i in range(n)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def expected(docs):
    texts = [(i, (t or "").encode()) for i, t in docs]
    sizes = {}
    out = []
    for i, spans, kept in slow(texts):
        gone = sum(n for _, n in spans)
        out.append((i, len(kept) + gone, gone, len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def test_query_against_sql(spark, small):
    got = rows_of(QUERIES["op12_previous_factors"](spark, small))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{small}/documents.parquet')")
    assert got == sorted(con.execute(SQL["op12_previous_factors"]).fetchall(), key=str)
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    assert got == expected(docs) and sum(r[2] > 0 for r in got) > 20
    many = suffixes.remove_repeats(spark.read.parquet(f"{small}/documents.parquet"), block_text=(60_000,) * 2, range_text=(90_000,) * 2, stretch_text=(50_000,) * 2)
    assert got == rows_of(suffixes.digest(many))


def test_odd_rows(spark):
    docs = [(r["doc_id"], r["text"]) for r in odd_docs(spark).collect()]
    assert rows_of(suffixes.digest(suffixes.remove_repeats(odd_docs(spark), block_text=(70_000, 70_000)))) == expected(docs)
    assert suffixes.remove_repeats(no_docs(spark)).count() == 0
    out = suffixes.remove_repeats(docs_of(spark, ["é" * 40, "ü" + "é" * 40])).orderBy("doc_id").collect()
    assert out[1]["kept"] == "ü".encode() and [tuple(s) for s in out[1]["spans"]] == [(2, 80)]
