import zlib
from collections import Counter

import numpy as np

from quire.llm import mixing, sharding
from quire.llm.queries import QUERIES
from tests.llm.cases import docs_of, no_docs, odd_docs, odd_rows, words


def test_every_row_has_one_gapless_slot(spark):
    out = sharding.two_pass_shuffle(odd_docs(spark), shards=5, bucket_bytes=2000, cells=64)
    rows = out.collect()
    assert Counter(r["text"] for r in rows) == Counter(r[2] for r in odd_rows())
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert {r["c0"] for r in rows} == {r[6] for r in odd_rows()}
    assert [c for c in out.columns if c == "shard"] == ["shard"]
    assert sharding.two_pass_shuffle(no_docs(spark)).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark, small):
    rows = QUERIES["op6_two_pass_shuffle"](spark, small).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        raw = docs[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 8, zlib.crc32(raw), "key")
        assert r["grown_shard"] in (r["shard"], 24)
    assert 0 <= min(r["shard"] for r in rows) and max(r["shard"] for r in rows) <= 23


def test_shuffle_is_repeatable_and_not_in_order(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    a = sharding.two_pass_shuffle(docs, shards=1, seed=3).select("slot", "doc_id").collect()
    b = sharding.two_pass_shuffle(docs.repartition(7), shards=1, seed=3).select("slot", "doc_id").collect()
    order = [d for _, d in sorted(map(tuple, a))]
    assert order == [d for _, d in sorted(map(tuple, b))] and order != sorted(order)
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_written_shards_are_read_back(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    path = str(tmp_path / "out")
    sharding.write_shards(docs, path, shards=3)
    back = spark.read.parquet(path)
    assert back.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).isEmpty() and back.count() == docs.count()


def test_counts_invert_the_poisson_distribution(spark):
    rng = __import__("random").Random(2)
    docs = docs_of(spark, [words(rng, 20) for _ in range(3000)])
    out = mixing.poisson_mixture(docs, {"s": 1.0}, scale=2.5)
    counts = Counter(r["doc_id"] for r in out.select("doc_id").collect())
    got = np.array([counts.get(i, 0) for i in range(3000)])
    assert abs(got.mean() - 2.5) < 0.12 and abs(got.var() - 2.5) < 0.3
    assert abs((got == 0).mean() - np.exp(-2.5)) < 0.02
    assert sorted(r["copy"] for r in out.where("doc_id = 5").collect()) == list(range(counts.get(5, 0)))


def test_rates_meet_target_weights(spark):
    rng = __import__("random").Random(3)
    a = docs_of(spark, [words(rng, 30) for _ in range(900)], source="big")
    b = docs_of(spark, [words(rng, 30) for _ in range(100)], source=None).withColumn("doc_id", __import__("pyspark").sql.functions.expr("doc_id + 10000"))
    out = mixing.poisson_mixture(a.unionByName(b), {"big": 1.0, None: 1.0})
    n = Counter(r["source"] for r in out.select("source").collect())
    assert 400 < n["big"] < 600 and 330 < n[None] < 670
    assert mixing.poisson_mixture(a.unionByName(b), {"big": 1.0}).where("source is null").count() == 0


def test_mixture_takes_odd_rows(spark):
    out = mixing.poisson_mixture(odd_docs(spark), scale=400.0)  # large means: counts far from zero
    rows = Counter(r["text"] for r in out.select("text").collect())
    assert set(rows) == {r[2] for r in odd_rows()}
    assert mixing.poisson_mixture(no_docs(spark)).count() == 0
    again = mixing.poisson_mixture(odd_docs(spark).repartition(3), scale=400.0)
    assert rows == Counter(r["text"] for r in again.select("text").collect())
