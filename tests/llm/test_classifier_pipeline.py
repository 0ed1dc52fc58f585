import math
import random
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm import classifier, mixing
from quire.llm.queries import QUERIES
from quire.llm.shared import id_part
from tests.llm.cases import docs_of, no_docs, odd_docs, odd_rows, words

LABELS = "text string, doc_id long, quality int, toxic int"


def test_held_out_accuracy_on_whole_tables(spark):
    folder = "/root/testdata/sf0.01"
    rows = QUERIES["op8_rule_ensemble"](spark, folder).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    test = [r for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(test) > 80 and sum(r["predicted"] == labels[r["doc_id"]] for r in test) / len(test) > 0.95


def toy(spark):
    rng = random.Random(10)
    good = [words(rng, 80, 2000) for _ in range(150)]
    bad = [" ".join(f"{w}$$$" for w in words(rng, 80).split()) for _ in range(150)]
    docs = docs_of(spark, good + bad)
    return docs, spark.createDataFrame([("z", i, int(i < 150), 0) for i in range(300)], LABELS)


def test_rules_say_what_the_expression_computes(spark):
    docs, labels = toy(spark)
    stats = classifier.with_statistics(docs.select("doc_id", "text"), wide=True)
    stats = stats.select("doc_id", *[v.alias(k) for k, v in classifier.features().items()])
    model = classifier.fit(classifier.labelled(stats, labels))
    assert 0 < len(model.rules) < 200 and len(model.told()) == len(model.rules)
    for r in stats.withColumn("score", model.score()).collect():
        total = model.intercept + sum(
            w for rule, w in model.rules if all((r[f] > t) if above else (r[f] <= t) for f, above, t in rule)
        )
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-total)))
        assert (r["score"] >= 0.5) == (r["doc_id"] < 150)


def test_held_out_labels_teach_nothing(spark):
    docs, labels = toy(spark)
    turned = labels.withColumn("quality", F.when(id_part("doc_id", 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = {r["doc_id"]: r["score"] for r in classifier.scored(docs, labels).collect()}
    assert a == {r["doc_id"]: r["score"] for r in classifier.scored(docs, turned).collect()}


def test_odd_rows_and_labels(spark):
    none = spark.createDataFrame([], LABELS)
    rows = classifier.scored(odd_docs(spark), none).collect()
    assert len(rows) == len(odd_rows()) and {(r["score"], r["predicted"]) for r in rows} == {(0.5, 1)}
    one = spark.createDataFrame([("t", 0, 1, 0), ("t", 0, 1, 0), ("t", None, 0, 0), ("t", 2, None, 0), ("t", 99, 0, 1)], LABELS)
    assert all(r["score"] > 0.5 for r in classifier.scored(odd_docs(spark), one).collect())
    assert classifier.scored(no_docs(spark), none).count() == 0
    kept = classifier.keep_good(odd_docs(spark), none)
    assert kept.columns == odd_docs(spark).columns and kept.count() == len(odd_rows())


def folder_of(spark, tmp_path, docs, labels):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(11)
    sentence = lambda: words(rng, 12, 10**6).capitalize() + "."
    passage = " ".join(sentence() for _ in range(6))
    clean = ["\n".join(sentence() for _ in range(12)) for _ in range(150)]
    near = [" ".join(w if rng.random() > 0.01 else f"q{rng.randrange(10**6)}" for w in words(rng, 90, 10**6).split()) for _ in range(1)]
    near += [near[0].replace(near[0].split()[40], "changed", 1)]
    sharing = [clean[0] + "\n" + passage, sentence() + " " + passage]
    bad = [" ".join(f"{w}$$$" for w in words(rng, 80).split()) for _ in range(60)]
    texts = [*clean, *near, *sharing, clean[3], *bad]
    docs = docs_of(spark, texts).select("doc_id", "text", "lang", "source", "n_chars")
    labels = spark.createDataFrame([("z", i, int(i < 150), 0) for i in [*range(150), *range(155, 215)]], LABELS)
    folder = folder_of(spark, tmp_path, docs, labels)
    stages = dict(corpus_pipeline.STAGES)

    one = stages["quality classifier"](spark, docs, folder)
    assert one.columns == docs.columns
    ids = {r["doc_id"] for r in one.collect()}
    assert ids >= set(range(155)) and not ids & set(range(155, 215))

    two = stages["line dedup"](spark, one, folder)
    rows = {r["doc_id"]: r for r in two.collect()}
    assert two.columns == docs.columns and 154 not in rows and set(rows) == ids - {154}
    assert all(rows[i]["text"] == clean[i] for i in range(150))
    assert rows[152]["text"] == passage and rows[153]["text"] == sharing[1].replace(" " + passage, "")
    assert all(r["n_chars"] == len(r["text"]) for r in rows.values())

    three = stages["MinHash near-dedup"](spark, docs, folder)
    kept = {r["doc_id"] for r in three.collect()}
    assert three.columns == docs.columns and 150 in kept and 151 not in kept and 154 not in kept and kept >= set(range(150))

    four = stages["mixing sources"](spark, three, folder)
    assert four.columns == docs.columns
    counts = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    expected = mixing.poisson_mixture(three).groupBy("doc_id").count().collect()
    assert counts == {r["doc_id"]: r["count"] for r in expected}

    five = stages["packing"](spark, four, folder)
    ends = five.where(F.col("start") + F.col("length") == F.col("doc_tokens")).groupBy("doc_id").count().collect()
    assert {r["doc_id"]: r["count"] for r in ends} == counts


def test_run_is_the_stages_one_after_another(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, small)
    assert docs.columns == corpus_pipeline.run(spark, small).columns
    key = lambda df: sorted((r["doc_id"], r["start"], r["length"] if False else 0) for r in df.where("start = 0").collect())
    assert key(docs) == key(corpus_pipeline.run(spark, small))


def test_stages_take_odd_rows(spark, tmp_path):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    labels = spark.createDataFrame([], LABELS)
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "a", odd_docs(spark).select(*columns), labels)).count() > 0
    assert corpus_pipeline.run(spark, folder_of(spark, tmp_path / "b", no_docs(spark).select(*columns), labels)).count() == 0


def test_the_package_imports_without_a_session():
    subprocess.run([sys.executable, "-c", "import corpus_pipeline, __spark_entry__ as e; assert 'pipeline' in e.queries()"], check=True)
