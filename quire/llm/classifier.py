"""Quality classifier as a sparse rule ensemble.

Shallow trees over text statistics give paths, each a conjunctive rule; a lasso
logistic regression over the rules keeps a few with weights; the kept rules become
one Spark column expression that scores any table of statistics.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.shared import id_part, packed, pick, stored, unpacked
from quire.llm.stats import with_statistics

# A rule: ((feature, above, threshold), ...) in order of features; ``above`` is > and else <=.
Rule = tuple[tuple[str, bool, float], ...]

TREES = 30
DEPTH = 3
PENALTY = 0.002
# Labelled rows that training reads at most, those with the least hashes of their ids.
SAMPLE_ROWS = 20_000


def features() -> dict[str, Column]:
    """What rules speak of: sizes and shares, all of them statistics of the text alone."""
    words, letters, lines = F.col("n_words"), F.col("word_chars"), F.col("n_lines")
    per = lambda a, b: a / F.greatest(b, F.lit(1))
    return {
        "log_words": F.log1p(words),
        "word_length": per(letters, words),
        "symbol_share": per(F.col("n_symbols"), letters),
        "symbols_per_word": per(F.col("n_symbols"), words),
        "repeat_share": per(F.col("n_repeat_words"), words),
        "dup_line_share": per(F.col("n_dup_lines"), lines),
        "upper_share": per(F.col("n_upper"), letters),
        "digit_share": per(F.col("n_digits"), letters),
        "mark_share": per(F.col("n_marks"), words),
        "stop_share": per(F.col("n_stops"), words),
        "words_per_line": per(words, lines),
    }


def labelled(stats: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out third, features and ``label``."""
    known = (
        pick(labels, "doc_id", "quality").where("doc_id is not null and quality is not null")
        .groupBy("doc_id").agg(F.min(F.col("quality").cast("double")).alias("label"))
    )
    return (
        stats.where(id_part("doc_id", 3) != 1).join(known, "doc_id")
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(*features(), "label")
    )


def paths(model, names: list[str]) -> list[Rule]:
    """Every path from a root to a node below it, bounds of one feature merged, each once."""
    found: set[Rule] = set()

    def walk(node, bounds: dict[tuple[str, bool], float]) -> None:
        if bounds:
            found.add(tuple(sorted((f, above, t) for (f, above), t in bounds.items())))
        if "Internal" not in node.getClass().getSimpleName():
            return
        split = node.split()
        feature, at = names[split.featureIndex()], split.threshold()
        for above, child in ((False, node.leftChild()), (True, node.rightChild())):
            key = (feature, above)
            old = bounds.get(key, at)
            walk(child, {**bounds, key: max(old, at) if above else min(old, at)})

    for tree in model.trees:
        walk(tree._call_java("rootNode"), {})
    return sorted(found)


def rule_column(rule: Rule) -> Column:
    tests = [F.col(f) > F.lit(t) if above else F.col(f) <= F.lit(t) for f, above, t in rule]
    return reduce(lambda a, b: a & b, tests).cast("double")


class RuleEnsemble:
    """An intercept and weighted rules."""

    def __init__(self, intercept: float, rules: list[tuple[Rule, float]]):
        self.intercept, self.rules = intercept, rules

    def score(self) -> Column:
        """The probability of label 1 as an expression over ``features``."""
        total = reduce(lambda a, b: a + b, [rule_column(r) * F.lit(w) for r, w in self.rules], F.lit(self.intercept))
        return 1 / (1 + F.exp(-total))

    def told(self) -> list[str]:
        """The rules in words, the weightiest first."""
        say = lambda r: " and ".join(f"{f} {'>' if above else '<='} {t:.4g}" for f, above, t in r)
        return [f"{w:+.3f} {say(r)}" for r, w in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(train: DataFrame, trees: int = TREES, depth: int = DEPTH, penalty: float = PENALTY, seed: int = 8) -> RuleEnsemble:
    """Trees, their paths, then lasso weights; with one class only, a constant."""
    rows = stored(train, "labelled").coalesce(4)
    seen = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two labels
    if len(seen) < 2:
        good, all_ = seen.get(1.0, 0), sum(seen.values())
        odds = (good + 1) / (all_ - good + 1)
        return RuleEnsemble(math.log(odds), [])
    names = list(features())
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(rows).select("vector", "label")
    forest = RandomForestClassifier(
        featuresCol="vector", numTrees=trees, maxDepth=depth, minInstancesPerNode=5, seed=seed
    ).fit(vectors)
    rules = paths(forest, names)
    if not rules:
        return RuleEnsemble(math.log(seen[1.0] / seen[0.0]), [])
    held = rows.select("label", *[rule_column(r).alias(f"r{i}") for i, r in enumerate(rules)])
    held = VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="rules").transform(held)
    lasso = LogisticRegression(
        featuresCol="rules", elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True
    ).fit(held.select("rules", "label"))
    weights = lasso.coefficients.toArray().tolist()
    return RuleEnsemble(float(lasso.intercept), [(r, w) for r, w in zip(rules, weights) if w])


def scored(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """Per document ``held_out``, ``score`` and ``predicted``; the model learns from ``labels``.

    Scores come from the text's statistics alone.  Documents whose id's crc32 modulo 3
    is 1 are held out of learning.  Null and empty texts are scored by their zero
    statistics; a null id counts as crc32 0; rows that repeat are scored each, and a
    label row that repeats counts once, with the lower label; no labels at all give
    the score 0.5; a table without rows gives none; other columns are not looked at.
    """
    stats = stored(
        with_statistics(pick(docs, "doc_id", "text"), wide=True).select("doc_id", *[v.alias(k) for k, v in features().items()]),
        "quality-statistics",
    )
    model = fit(labelled(stats, labels), **how)
    score = model.score()
    return stats.select("doc_id", (id_part("doc_id", 3) == 1).alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.5).cast("int")
    )


def keep_good(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """The documents that the model does not reject, their columns unchanged."""
    stats = with_statistics(pick(docs, "doc_id", "text"), wide=True)
    train = labelled(stats.select("doc_id", *[v.alias(k) for k, v in features().items()]), labels)
    model = fit(train, **how)
    counted = with_statistics(packed(docs, "doc_id", "text"), wide=True)
    made = counted.select("row", *[v.alias(k) for k, v in features().items()])
    return made.where(model.score() >= 0.5).select(*unpacked(docs.columns, {}))
