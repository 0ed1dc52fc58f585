"""Form fields: calculation, validation, missing values, edits to values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.functions.dates import typed_date
from quire.functions.numbers import half_up, plain_number, typed_number
from quire.functions.text import trimmed

NUMBER_MESSAGE = "This field takes a number."
DATE_MESSAGE = "This field takes a date, such as 2026-09-23 or 23/09/2026."


def calculated(fields: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """What each calculated field comes to: ``doc_id, name, value, differs``.

    ``fields``: doc_id, name, value (text), read_only, kind (sum, product,
    average) and operands (names); ``changes``: doc_id, name, value typed but not
    yet stored.  Operands read a change first, then what is stored.  Results do
    not feed each other: every operand is a value from before the pass.
    """
    stored = fields.select("doc_id", "name", "value")
    if changes is None:
        current = stored
    else:
        typed = changes.select("doc_id", "name", F.struct(F.col("value").alias("v")).alias("typed"))
        current = stored.join(typed, ["doc_id", "name"], "full").select(
            "doc_id", "name",
            F.when(F.col("typed").isNotNull(), F.col("typed.v")).otherwise(F.col("value")).alias("value"),
        )
    numbers = current.select("doc_id", F.col("name").alias("operand"), typed_number(F.col("value")).alias("number"))
    targets = fields.where(F.col("kind").isNotNull() & ~F.col("read_only") & (F.size("operands") > 0))
    used = targets.select(
        "doc_id", "name", "kind", F.col("value").alias("stored"), F.explode("operands").alias("operand")
    ).join(numbers, ["doc_id", "operand"], "left")
    worked = used.groupBy("doc_id", "name").agg(
        F.first("kind").alias("kind"),
        F.first("stored").alias("stored"),
        F.count("number").alias("n"),
        F.sum("number").alias("total"),
        F.product("number").alias("product"),
    )
    result = (
        F.when(F.col("kind") == "product", F.col("product"))
        .when(F.col("kind") == "average", F.col("total") / F.col("n"))
        .otherwise(F.col("total"))
    )
    value = F.when(F.col("n") == 0, F.lit("")).otherwise(
        # Past nine trillion the six kept decimals are beyond a double anyway.
        plain_number(F.when(F.abs(result) < 9e12, half_up(result * 1e6) / 1e6).otherwise(result))
    )
    return worked.select(
        "doc_id", "name", value.alias("value"), (F.coalesce("stored", F.lit("")) != value).alias("differs")
    )


def problem(rule: Column, kind: Column, value: Column) -> Column:
    """The message a field's value earns under its rule; blank values are fine."""
    checked = (kind == "text") & value.isNotNull() & (trimmed(value) != "")
    return F.when(
        checked & (rule == "number") & typed_number(value).isNull(), F.lit(NUMBER_MESSAGE)
    ).when(checked & (rule == "date") & typed_date(value).isNull(), F.lit(DATE_MESSAGE))


def missing(fields: DataFrame) -> DataFrame:
    """Required fields that hold nothing."""
    text, many, ticked = F.col("value.s"), F.col("value.a"), F.col("value.b")
    empty = (
        F.when(F.col("kind") == "checkbox", ~F.coalesce(ticked, F.lit(False)))
        .when(many.isNotNull(), F.size(many) == 0)
        .otherwise(ticked.isNull() & (F.coalesce(text, F.lit("")) == ""))
    )
    return fields.where(F.col("required") & ~F.col("read_only") & empty)


def value_list(value: Column) -> Column:
    """Any value as a list: null and empty text are no entries."""
    text = F.coalesce(value["s"], value["b"].cast("string"))
    return F.coalesce(
        value["a"],
        F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(F.array(text)),
    )


def same_value(left: Column, right: Column) -> Column:
    """Lists and single values compare as lists; otherwise values must be identical."""
    lists = left["a"].isNotNull() | right["a"].isNotNull()
    return F.when(lists, value_list(left) == value_list(right)).otherwise(left.eqNullSafe(right))


def first_number(value: Column) -> Column:
    """A form value as a number: lists give their first entry, booleans nothing."""
    text = F.coalesce(F.try_element_at(value["a"], F.lit(1)), value["s"])
    return F.when(value["b"].isNull(), typed_number(text))


def written_values(fields: DataFrame, changes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fields after a batch of value changes, and the changes refused.

    ``changes``: doc_id, name, ord, value (union struct).  The last change of a
    field counts.  Unknown fields are refused, read-only ones left as they are;
    text is cut to its limit, choices keep only what is offered.
    """
    last = changes.groupBy("doc_id", "name").agg(F.max_by("value", "ord").alias("asked"))
    known = fields.select("doc_id", "name")
    refused = last.join(known, ["doc_id", "name"], "left_anti").select(
        "doc_id", "name", F.lit("That field is no longer in this document.").alias("error")
    )
    asked, options = F.col("asked"), F.coalesce("options", F.array().cast("array<string>"))
    text = F.when(F.coalesce(asked["b"], F.lit(False)), "true").otherwise(
        F.coalesce(F.array_join(asked["a"], ","), asked["s"], F.lit(""))
    )
    single = F.struct(text.alias("s"), F.lit(None).cast("array<string>").alias("a"), F.lit(None).cast("boolean").alias("b"))

    def union(s=None, a=None, b=None):
        return F.struct(
            (s if s is not None else F.lit(None).cast("string")).alias("s"),
            (a if a is not None else F.lit(None).cast("array<string>")).alias("a"),
            (b if b is not None else F.lit(None).cast("boolean")).alias("b"),
        )

    cut = F.when(F.col("max_length").isNull(), single["s"]).otherwise(
        F.substring(single["s"], F.lit(1), F.col("max_length"))
    )
    offered = F.filter(
        F.coalesce(asked["a"], F.when(asked["s"].isNotNull(), F.array(asked["s"])), F.array().cast("array<string>")),
        lambda o: F.array_contains(options, o),
    )
    choice = F.coalesce(asked["s"], F.lit(""))
    new = (
        F.when(F.col("kind") == "text", union(s=cut))
        .when(
            F.col("kind") == "checkbox",
            union(b=F.coalesce(asked["b"], F.lit(False)) | F.coalesce(asked["s"].isin("true", "on"), F.lit(False))),
        )
        .when(
            F.col("kind") == "radio",
            F.when(choice == "", union()).when(F.array_contains(options, choice), union(s=choice)).otherwise(F.col("value")),
        )
        .when(F.col("kind").isin("dropdown", "list"), F.when(F.size(offered) > 0, union(a=offered)).otherwise(union()))
        .otherwise(F.col("value"))
    )
    after = (
        fields.join(last.withColumn("changed", F.lit(True)), ["doc_id", "name"], "left")
        .withColumn("value", F.when(F.col("changed") & ~F.col("read_only"), new).otherwise(F.col("value")))
        .drop("asked", "changed")
    )
    return after, refused


def widget_pages(fields: DataFrame, page: int) -> DataFrame:
    """One row per widget drawn on a page; a widget without a page is on the first."""
    return fields.select("doc_id", "name", F.posexplode("widgets").alias("widget", "at")).where(
        F.coalesce(F.col("at"), F.lit(1)) == page
    ).select("doc_id", "name", "widget")


def next_free(names: DataFrame, group: str, name: str, prefix: str) -> DataFrame:
    """Per group, the smallest ``prefixN`` not in use.

    Only numbers up to one above the count can matter, so a number is free when
    it follows the longest run 1..k that is all in use.
    """
    number = F.regexp_extract(name, rf"^{prefix}([1-9]\d{{0,17}})$", 1).try_cast("bigint")
    used = names.select(group, number.alias("n")).where("n is not null").distinct()
    follows = used.select(group, (F.col("n") + 1).alias("n"))
    firsts = names.select(group).distinct().withColumn("n", F.lit(1).cast("bigint"))
    free = firsts.unionByName(follows).distinct().join(used, [group, "n"], "left_anti")
    return free.groupBy(group).agg(F.concat(F.lit(prefix), F.min("n").cast("string")).alias("free"))
