"""Phrase lists: the automaton and the anchors find what a plain search finds."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import redact, search
from quire.plans.search import pages_of

TEXTS = ["The cat sat. The other cat\nsat on the mat", "caté cat_x \U0001f600 cat, concat 5cats", "— er. never er.er.", "", None, "aaaa aaa", "ÉTÉ été"]
PHRASES = ["cat", "the", "er.", "— e", "aa", "sat\non", "other cat", "ÉTÉ", "\U0001f600 cat", ",", " ", "", "on the mat", "ca", "x \U0001f600", "at, con", "cat"]


def plain(texts, phrases, case_sensitive, whole_word):
    """Every occurrence, character by character."""
    out = set()
    word = lambda c: c.isalnum() or c == "_"
    for d, t in enumerate(texts):
        hay = (t or "") if case_sensitive else (t or "").lower()
        for n, phrase in enumerate(phrases):
            p = phrase if case_sensitive else phrase.lower()
            if not p.strip():
                continue
            for i in range(len(hay) - len(p) + 1):
                edges = not whole_word or not ((i and word(t[i - 1])) or (i + len(p) < len(t) and word(t[i + len(p)])))
                if hay[i : i + len(p)] == p and edges:
                    out.add((n, d, i, i + len(p)))
    return out


@pytest.mark.parametrize("case_sensitive,whole_word", [(False, False), (True, True)])
@pytest.mark.parametrize("most", [1 << 20, 0])
def test_both_ways_find_every_occurrence(spark, case_sensitive, whole_word, most):
    rng = random.Random(2)
    texts = TEXTS + ["".join(rng.choice("ab .") for _ in range(200)) for _ in range(5)]
    phrases = PHRASES + ["".join(rng.choice("ab .") for _ in range(rng.randrange(1, 6))) for _ in range(30)]
    pages = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("page", F.lit(1))
    listed = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    got = search.search_phrases(pages, listed, case_sensitive, whole_word, broadcast_bytes=most).collect()
    assert len(got) == len({tuple(r)[:5] for r in got})
    assert {(r.phrase_id, r.doc_id, r.start, r.end) for r in got} == plain(texts, phrases, case_sensitive, whole_word)


def test_an_empty_list_finds_nothing(spark, small):
    none = spark.createDataFrame([], "phrase_id long, phrase string")
    assert search.search_phrases(pages_of(spark, small), none).count() == 0


def test_phrase_lists_for_redaction_agree_with_single_searches(spark, small):
    pages = pages_of(spark, small)
    phrases = ["En  la", "tion de", "que", "aa"]
    listed = spark.createDataFrame(list(enumerate(phrases)), "phrase_id long, phrase string")
    for whole_word in (False, True):
        got = redact.find_phrases(pages, listed, whole_word=whole_word).collect()
        for n, phrase in enumerate(phrases):
            alone = redact.find_text(pages, phrase, whole_word=whole_word).collect()
            assert {tuple(r)[1:4] + (str(r.rects),) for r in got if r.phrase_id == n} == {tuple(r)[:3] + (str(r.rects),) for r in alone}
