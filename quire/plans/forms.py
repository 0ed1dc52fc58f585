"""Order lines as form fields: one form per order, its lines the operands."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.operators import forms as ops
from quire.plans.registry import query
from quire.session import table


def order_fields(spark, folder):
    """Stored fields of every order and the three totals that use them."""
    lines = table(spark, folder, "lineitem").groupBy(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("line"), F.col("l_linenumber").cast("string")).alias("name")
    ).agg(F.max("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
    typed = (
        F.when(F.col("p") % 5 == 0, F.concat(F.lit("$ "), F.format_string("%.2f", "q")))
        .when(F.col("p") % 5 == 1, F.concat(F.format_string("%.0f", "q"), F.lit(",000")))
        .when(F.col("p") % 5 == 2, F.lit("n/a"))
        .otherwise(F.format_string("%.1f", "q"))
    )
    stored = lines.select(
        "doc_id", "name", typed.alias("value"), F.lit(False).alias("read_only"),
        F.lit(None).cast("string").alias("kind"), F.array().cast("array<string>").alias("operands"),
    )
    operands = F.array(*[F.lit(f"line{i}") for i in (1, 2, 3, 9)])
    kinds = F.array(F.lit("sum"), F.lit("product"), F.lit("average"))
    totals = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.explode(kinds).alias("kind"), (F.col("o_orderkey") % 7 == 0).alias("ro")
    ).select(
        "doc_id", F.col("kind").alias("name"), F.lit("0").alias("value"),
        (F.col("ro") & (F.col("kind") == "product")).alias("read_only"), "kind", operands.alias("operands"),
    )
    return stored.unionByName(totals)


_FIELDS_SQL = """ln AS (SELECT l_orderkey AS doc_id, 'line' || l_linenumber AS name, max(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL),
fld AS (SELECT doc_id, name, CASE p % 5 WHEN 0 THEN '$ ' || printf('%.2f', q) WHEN 1 THEN printf('%.0f', q) || ',000' WHEN 2 THEN 'n/a' ELSE printf('%.1f', q) END AS value,
   CASE p % 5 WHEN 1 THEN q * 1000 WHEN 2 THEN NULL ELSE q END AS number FROM ln)"""


@query(
    "calculated_fields",
    "A12 J15 J23 Q18 H11",
    f"""WITH {_FIELDS_SQL}, op AS (SELECT o_orderkey AS doc_id, unnest(['sum','product','average']) AS kind FROM orders),
    ch AS (SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 4 = 0 THEN 12.5 END AS v FROM orders WHERE o_orderkey % 2 = 0),
    cur AS (SELECT coalesce(f.doc_id, c.doc_id) AS doc_id, coalesce(f.name, 'line1') AS name, CASE WHEN c.doc_id IS NOT NULL THEN c.v ELSE f.number END AS number
       FROM fld f FULL JOIN ch c ON c.doc_id = f.doc_id AND f.name = 'line1'),
    w AS (SELECT op.doc_id, op.kind, count(number) AS n, sum(number) AS t, product(number) AS p FROM op LEFT JOIN cur ON cur.doc_id = op.doc_id AND cur.name IN ('line1', 'line2', 'line3', 'line9')
       WHERE NOT (op.kind = 'product' AND op.doc_id % 7 = 0) GROUP BY ALL),
    v AS (SELECT *, CASE kind WHEN 'sum' THEN t WHEN 'product' THEN p ELSE t / n END AS r FROM w)
    SELECT doc_id, kind AS name, CASE WHEN n = 0 THEN '' ELSE regexp_replace(regexp_replace(printf('%.6f', floor(r * 1000000 + 0.5) / 1000000), '0+$', ''), '\\.$', '') END AS value, true AS differs FROM v""",
)
def calculated_fields(spark, folder):
    changes = table(spark, folder, "orders").where("o_orderkey % 2 = 0").select(
        F.col("o_orderkey").alias("doc_id"), F.lit("line1").alias("name"),
        F.when(F.col("o_orderkey") % 4 == 0, F.lit(" 12.5")).alias("value"),
    )
    return ops.calculated(order_fields(spark, folder), changes)


@query(
    "field_problems",
    "F16 Q18",
    """WITH f AS (SELECT o_orderkey, ['number','date','text'][o_orderkey % 3 + 1] AS rule, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority WHEN 1 THEN ' ' WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 3 THEN floor(o_totalprice)::BIGINT::VARCHAR ELSE '31/02/2024' END AS value,
       CASE WHEN o_orderkey % 11 = 0 THEN 'list' ELSE 'text' END AS kind FROM orders)
    SELECT o_orderkey AS order_key, rule, value, CASE WHEN kind <> 'text' OR trim(value) = '' THEN NULL
      WHEN rule = 'number' AND o_orderkey % 5 IN (0, 2, 4) THEN 'This field takes a number.'
      WHEN rule = 'date' AND o_orderkey % 5 <> 2 THEN 'This field takes a date, such as 2026-09-23 or 23/09/2026.' END AS problem FROM f""",
)
def field_problems(spark, folder):
    k = F.col("o_orderkey")
    value = (
        F.when(k % 5 == 0, F.col("o_orderpriority")).when(k % 5 == 1, F.lit(" "))
        .when(k % 5 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .when(k % 5 == 3, F.floor("o_totalprice").cast("string")).otherwise(F.lit("31/02/2024"))
    )
    rule = F.element_at(F.array(F.lit("number"), F.lit("date"), F.lit("text")), (k % 3 + 1).cast("int"))
    kind = F.when(k % 11 == 0, "list").otherwise("text")
    return table(spark, folder, "orders").select(
        k.alias("order_key"), rule.alias("rule"), value.alias("value"), ops.problem(rule, kind, value).alias("problem")
    )


def customer_fields(spark, folder):
    """Customers as form fields of every kind, one form per nation."""
    k, seg = F.col("c_custkey"), F.col("c_mktsegment")
    kinds = F.array(*[F.lit(v) for v in ("text", "checkbox", "radio", "dropdown", "list")])
    kind = F.element_at(kinds, (k % 5 + 1).cast("int"))
    text = F.when(kind.isin("text", "radio"), F.when(k % 4 == 0, F.lit("")).otherwise(seg))
    many = F.when(kind.isin("dropdown", "list"), F.when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(seg)))
    ticked = F.when(kind == "checkbox", k % 2 == 0)
    return table(spark, folder, "customer").select(
        F.col("c_nationkey").cast("bigint").alias("doc_id"), F.col("c_name").alias("name"), kind.alias("kind"),
        (k % 7 < 4).alias("required"), (k % 6 == 0).alias("read_only"),
        F.struct(text.alias("s"), many.alias("a"), ticked.alias("b")).alias("value"),
        F.array(F.lit("BUILDING"), F.lit("MACHINERY"), F.lit("FURNITURE")).alias("options"),
        F.when(k % 2 == 0, F.lit(4)).alias("max_length"), k.alias("key"),
        F.array((k % 3).cast("int"), F.when(k % 5 > 0, (k % 4 + 1).cast("int"))).alias("widgets"),
    )


_CF = """cf AS (SELECT c_nationkey::BIGINT AS doc_id, c_name AS name, c_custkey AS key, ['text','checkbox','radio','dropdown','list'][c_custkey % 5 + 1] AS kind, c_custkey % 7 < 4 AS required, c_custkey % 6 = 0 AS read_only, c_mktsegment AS seg FROM customer)"""


@query(
    "missing_fields",
    "F22 F23",
    f"""WITH {_CF} SELECT doc_id, name, kind FROM cf WHERE required AND NOT read_only AND CASE kind WHEN 'checkbox' THEN key % 2 = 1 WHEN 'text' THEN key % 4 = 0 WHEN 'radio' THEN key % 4 = 0 ELSE key % 3 = 0 END""",
)
def missing_fields(spark, folder):
    return ops.missing(customer_fields(spark, folder)).select("doc_id", "name", "kind")


@query(
    "written_field_values",
    "F23 2.12",
    f"""WITH {_CF}, o AS (SELECT *, seg IN ('BUILDING','MACHINERY','FURNITURE') AS offered FROM cf),
    n AS (SELECT *, CASE kind WHEN 'text' THEN CASE WHEN key % 2 = 0 THEN substr('MACHINERY', 1, 4) ELSE 'MACHINERY' END WHEN 'checkbox' THEN 'false' WHEN 'radio' THEN 'MACHINERY' ELSE 'MACHINERY' END AS new,
      CASE kind WHEN 'text' THEN CASE WHEN key % 4 = 0 THEN '' ELSE seg END WHEN 'radio' THEN CASE WHEN key % 4 = 0 THEN '' ELSE seg END WHEN 'checkbox' THEN (key % 2 = 0)::VARCHAR ELSE CASE WHEN key % 3 = 0 THEN '' ELSE seg END END AS old FROM o)
    SELECT doc_id, name, kind, CASE WHEN key % 2 = 0 AND NOT read_only THEN new ELSE old END AS value,
      CASE WHEN key % 2 = 1 OR read_only THEN true WHEN kind = 'checkbox' THEN (key % 2 = 0)::VARCHAR = new WHEN kind IN ('text', 'radio') THEN old = new ELSE old = new END AS same,
      NULL::VARCHAR AS error FROM n
    UNION ALL SELECT doc_id, 'ghost' || key, NULL, NULL, NULL, 'That field is no longer in this document.' FROM cf WHERE key % 50 = 1""",
)
def written_field_values(spark, folder):
    fields = customer_fields(spark, folder)
    asked = F.struct(F.lit("MACHINERY").alias("s"), F.lit(None).cast("array<string>").alias("a"), F.lit(None).cast("boolean").alias("b"))
    changes = fields.where("key % 2 = 0").select("doc_id", "name", F.lit(2).alias("ord"), asked.alias("value"))
    earlier = changes.withColumn("ord", F.lit(1)).withColumn("value", F.col("value").withField("s", F.lit("x")))
    ghosts = fields.where("key % 50 = 1").select(
        "doc_id", F.concat(F.lit("ghost"), F.col("key").cast("string")).alias("name"), F.lit(1).alias("ord"), asked.alias("value")
    )
    after, refused = ops.written_values(fields, changes.unionByName(earlier).unionByName(ghosts))
    before = fields.select("doc_id", "name", F.col("value").alias("old"))
    return (
        after.join(before, ["doc_id", "name"])
        .select(
            "doc_id", "name", "kind", F.array_join(ops.value_list(F.col("value")), ",").alias("value"),
            ops.same_value(F.col("value"), F.col("old")).alias("same"),
        )
        .unionByName(refused, allowMissingColumns=True)
    )


@query(
    "fields_on_page",
    "J25 J20",
    f"""WITH {_CF}, w AS (SELECT doc_id, name, 0 AS widget, key % 3 AS page FROM cf UNION ALL SELECT doc_id, name, 1, CASE WHEN key % 5 > 0 THEN key % 4 + 1 END FROM cf)
    SELECT doc_id, name, widget::BIGINT AS widget FROM w WHERE coalesce(page, 1) = 1""",
)
def fields_on_page(spark, folder):
    return ops.widget_pages(customer_fields(spark, folder), 1)


@query(
    "next_free_names",
    "H36",
    """WITH u AS (SELECT l_orderkey AS doc_id, 'text' || l_linenumber AS name FROM lineitem), n AS (SELECT DISTINCT doc_id, regexp_extract(name, '^text([1-9]\\d*)$', 1)::BIGINT AS n FROM u),
    c AS (SELECT DISTINCT doc_id, 1::BIGINT AS n FROM u UNION SELECT doc_id, n + 1 FROM n)
    SELECT c.doc_id, 'text' || min(c.n) AS free FROM c ANTI JOIN n ON n.doc_id = c.doc_id AND n.n = c.n GROUP BY 1""",
)
def next_free_names(spark, folder):
    names = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), F.concat(F.lit("text"), F.col("l_linenumber").cast("string")).alias("name")
    )
    return ops.next_free(names, "doc_id", "name", "text")
