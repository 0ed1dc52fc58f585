import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import packing
from quire.llm.queries import QUERIES, tokenizer_path
from tests.llm.cases import no_docs, odd_docs, odd_rows


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_windows_are_full_and_hold_each_id_once(lengths):
    windows = packing.pack_portion(lengths)
    seen = {}
    for tier, pieces in windows:
        assert sum(n for _, _, n in pieces) == tier and tier & (tier - 1) == 0 and tier <= 4096
        for doc, start, n in pieces:
            assert n > 0
            seen.setdefault(doc, []).append((start, start + n))
    for doc, n in enumerate(lengths):
        spans = sorted(seen[doc])
        assert spans[0][0] == 0 and spans[-1][1] == n and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 9000), min_size=1, max_size=60))
def test_step_groups_are_of_one_length_and_balanced(lengths):
    windows = packing.pack_portion(lengths)
    frame = pd.DataFrame({"tier": [t for t, _ in windows], "group": packing.step_groups(windows)})
    assert (frame.groupby("group")["tier"].nunique() == 1).all()
    sizes = frame.groupby(["tier", "group"]).size()
    assert (sizes * sizes.index.get_level_values(0) <= packing.STEP).all()
    assert (sizes.groupby("tier").max() - sizes.groupby("tier").min() <= 1).all()


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.characters(codec="utf-8"), st.sampled_from("aAé Ö́.,'<|>\n\tſK İ \x1c")), max_size=60))
def test_word_ids_are_the_tokenizers(text):
    from tokenizers import Tokenizer

    path = tokenizer_path()
    words = packing._word_ids(open(path, encoding="utf-8").read())
    own = np.frombuffer(words.text(text), dtype="<u4").tolist()
    assert own == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def check(tokenizer, rows, texts):
    """Every id of every text once, in order, in gapless sequences."""
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
        padded += 0 if at & (at - 1) == 0 else 4096 - at
    assert padded == 0
    got = {}
    for r in rows:
        got.setdefault(r["doc_id"], []).append(r)
    assert set(got) == set(texts)
    for doc, text in texts.items():
        ids = ids_of(tokenizer, text)
        at = 0
        for r in sorted(got[doc], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)


def test_query_is_an_exact_round_trip(spark, small, tokenizer):
    rows = QUERIES["op7_hierarchical_packing"](spark, small).collect()
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    check(tokenizer, rows, {d["doc_id"]: d["text"] for d in docs})


def test_odd_rows(spark, tokenizer):
    rows = packing.with_digest(packing.packed_sequences(odd_docs(spark).coalesce(1), tokenizer_path())).collect()
    once = {r[1]: r[2] for r in odd_rows() if r[1] is not None and r[1] not in (3, 7)}
    check_rows = [r for r in rows if r["doc_id"] in once]
    for doc, text in once.items():
        assert sum(r["length"] for r in check_rows if r["doc_id"] == doc) == len(ids_of(tokenizer, text))
    assert sum(r["length"] for r in rows if r["doc_id"] == 7) == 3 * len(ids_of(tokenizer, odd_rows()[7][2]))
    assert sum(r["length"] for r in rows if r["doc_id"] is None) == len(ids_of(tokenizer, "no id here")) + 1
    assert packing.packed_sequences(no_docs(spark), tokenizer_path()).count() == 0
