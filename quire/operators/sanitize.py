"""Taking hidden information out of all tables of a document at once, and looking for it.

A category says which table it lies in, which rows hold it, and what becomes of them.
Looking and removing read the same rules, so nothing is removed that is not reported
and nothing reported stays.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.facts import action_class, hidden_flag
from quire.functions.text import is_blank
from quire.operators.redact import fresh_plans


@dataclass(frozen=True)
class Rule:
    """Where a category of hidden information lies.

    Rows of ``table`` for which ``found`` holds are told by ``label`` and dropped; where
    ``emptied`` names columns, the rows stay and take these values instead.
    """

    table: str
    found: Column
    label: Column
    emptied: dict[str, Column] = field(default_factory=dict)


def rules() -> dict[str, Rule]:
    """The ten categories over the tables of documents.

    metadata: name, value; xmp: page (null for the document's own); attachments:
    file_name; actions: type, place; annotations: id, flags; fields: name, value,
    default_value, state; thumbnails: page; layers: layer, hidden; alternates: picture.
    All have doc_id and ord.
    """
    text = lambda c: F.col(c).cast("string")
    filled = ~is_blank(F.coalesce("value", F.lit("")))
    site = F.concat("type", F.lit(" ("), "place", F.lit(")"))
    always = F.lit(True)
    return {
        "metadata": Rule("metadata", filled, F.col("name")),
        "xmpMetadata": Rule("xmp", always, F.coalesce(F.concat(F.lit("page "), text("page")), F.lit("document"))),
        "attachments": Rule("attachments", always, F.col("file_name")),
        "documentJavaScript": Rule("actions", action_class(F.col("type")) == "javascript", F.col("place")),
        "launchActions": Rule("actions", action_class(F.col("type")) == "reachingOut", site),
        "hiddenAnnotations": Rule("annotations", hidden_flag(F.col("flags")), text("id")),
        "formData": Rule(
            "fields", filled | ~is_blank(F.coalesce("default_value", F.lit(""))), F.col("name"),
            {"value": F.lit(None).cast("string"), "default_value": F.lit(None).cast("string"), "state": F.lit("Off")},
        ),
        "thumbnails": Rule("thumbnails", always, F.concat(F.lit("page "), text("page"))),
        "hiddenLayers": Rule("layers", F.col("hidden"), F.col("layer")),
        "alternateImages": Rule("alternates", always, text("picture")),
    }


def bit(category: Column) -> Column:
    """The bit of a category in a set of categories, which is one number."""
    return F.coalesce(*[F.when(category == name, F.lit(1 << n)) for n, name in enumerate(rules())], F.lit(0))


def findings(tables: dict[str, DataFrame]) -> DataFrame:
    """Hidden information of all tables: ``doc_id, category, ord, label``; a table that is not given has none."""
    found = [
        tables[rule.table].where(rule.found).select("doc_id", F.lit(name).alias("category"), "ord", rule.label.alias("label"))
        for name, rule in rules().items() if rule.table in tables
    ]
    out = found[0]
    for part in found[1:]:
        out = out.unionByName(part)
    return out


def sanitize(tables: dict[str, DataFrame], decisions: DataFrame, revisions: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """All tables without the chosen categories, and the decisions refused.

    ``decisions``: doc_id, category, revision (at which it was taken); ``revisions``:
    doc_id, revision.  A decision taken at another revision than the latest is refused and
    changes nothing.  One row of decisions for each document is routed to every table: a
    row goes, or is emptied, when its document and the category it holds were chosen.  A
    table of several categories is joined once.
    """
    refused = fresh_plans(decisions.select("doc_id", F.col("category").alias("plan"), "revision"), revisions).where("error is not null").select(
        "doc_id", F.col("plan").alias("category"), "revision", "error"
    )
    plans = decisions.groupBy("doc_id", "revision").agg(F.bit_or(bit(F.col("category"))).alias("plan"))
    chosen = fresh_plans(plans, revisions).where("error is null").groupBy("doc_id").agg(F.bit_or("plan").alias("_chosen"))
    after = {}
    for name, table in tables.items():
        mine = {category: rule for category, rule in rules().items() if rule.table == name}
        if not mine:
            after[name] = table
            continue
        held = F.coalesce(*[F.when(rule.found, F.lit(category)) for category, rule in mine.items()])
        marked = table.join(chosen, "doc_id", "left")
        hit = F.coalesce(F.col("_chosen").bitwiseAND(bit(held)) > 0, F.lit(False))
        emptied = {c: v for rule in mine.values() for c, v in rule.emptied.items()}
        kept = marked.withColumn("_hit", hit) if emptied else marked.where(~hit)
        for column, value in emptied.items():
            kept = kept.withColumn(column, F.when(F.col("_hit"), value).otherwise(F.col(column)))
        after[name] = kept.select(*table.columns)
    return after, refused


def left_over(after: dict[str, DataFrame], decisions: DataFrame, refused: DataFrame) -> DataFrame:
    """The proof: findings of a category that was chosen and not refused.  Must be empty."""
    asked = decisions.select("doc_id", bit(F.col("category")).alias("asked"), F.lit(0).alias("refused")).unionByName(
        refused.select("doc_id", F.lit(0).alias("asked"), bit(F.col("category")).alias("refused"))
    )
    done = asked.groupBy("doc_id").agg(F.bit_or("asked").bitwiseAND(F.bitwise_not(F.bit_or("refused"))).alias("_done")).where("_done > 0")
    found = findings(after)
    return found.join(done, "doc_id").where(F.col("_done").bitwiseAND(bit(F.col("category"))) > 0).select(*found.columns)
