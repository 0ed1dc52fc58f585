"""Column rules over the sample tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quire.functions import dates, facts, numbers, ranges, text
from quire.plans import shared_sql as q
from quire.plans.registry import query
from quire.session import spread, table


def documents(spark, folder):
    return spread(table(spark, folder, "documents").select("doc_id", "text"), "doc_id")


@query(
    "drawable_text",
    "H5 F17 A22 H9 H6",
    rf"""WITH d AS (SELECT doc_id, text,
      list_distinct_ordered AS bad FROM (SELECT doc_id, text,
        regexp_extract_all(text, '[^\t -~\x{{a0}}-\x{{ff}}€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ]') AS list_distinct_ordered FROM documents))
    SELECT doc_id, md5({q.drawable("text")}) AS drawn,
      md5({q.trimmed(f"regexp_replace({q.drawable('text')}, '[\r\n]+', ' ', 'g')")}) AS one_line,
      array_to_string(list_filter(bad, lambda c, i: list_position(bad, c) = i), '') AS undrawable,
      len(bad) = 0 AS is_drawable,
      md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) AS escaped,
      '“' || CASE WHEN length(text) > 70 THEN substr(text, 1, 69) || '…' ELSE text END || '”' AS summary
    FROM d""",
)
def drawable_text(spark, folder):
    body = F.col("text")
    bad = text.undrawable_characters(body)
    return documents(spark, folder).select(
        "doc_id",
        F.md5(text.drawable(body)).alias("drawn"),
        F.md5(text.drawable_line(body)).alias("one_line"),
        F.array_join(bad, "").alias("undrawable"),
        (F.size(bad) == 0).alias("is_drawable"),
        F.md5(text.html_escaped(body)).alias("escaped"),
        text.quoted_summary(body, 70).alias("summary"),
    )


_TOKENS = f"""tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '{q.SOLID}+')) AS token FROM documents)"""
_NUMERAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _sql_number(e: str) -> str:
    return f"CASE WHEN regexp_matches({e}, '{_NUMERAL}') THEN try_cast({e} AS DOUBLE) END"


@query(
    "typed_numbers",
    "H11 H12 H31 F16",
    rf"""WITH {_TOKENS},
    c AS (SELECT doc_id, token, regexp_replace(token, '[\s,\x{{a0}}]', '', 'g') AS cell,
            regexp_replace(regexp_replace(token, '[\s,\x{{a0}}]', '', 'g'), '^[^\d+-.]+', '') AS typed
          FROM tok WHERE regexp_matches(token, '\d'))
    SELECT doc_id, count(*)::BIGINT AS tokens,
      count({_sql_number("typed")})::BIGINT AS typed_numbers, count({_sql_number("cell")})::BIGINT AS cell_numbers,
      coalesce(max({_sql_number("typed")}), 0) AS largest, coalesce(min({_sql_number("cell")}), 0) AS smallest
    FROM c GROUP BY doc_id""",
)
def typed_numbers(spark, folder):
    tokens = documents(spark, folder).select(
        "doc_id", F.explode(F.regexp_extract_all("text", F.lit(text.SOLID + "+"), F.lit(0))).alias("token")
    )
    typed, cell = numbers.typed_number(F.col("token")), numbers.cell_number(F.col("token"))
    return (
        tokens.where(F.col("token").rlike(r"\d"))
        .select("doc_id", typed.alias("typed"), cell.alias("cell"))
        .groupBy("doc_id")
        .agg(
            F.count("*").alias("tokens"),
            F.count("typed").alias("typed_numbers"),
            F.count("cell").alias("cell_numbers"),
            F.coalesce(F.max("typed"), F.lit(0.0)).alias("largest"),
            F.coalesce(F.min("cell"), F.lit(0.0)).alias("smallest"),
        )
    )


# Orders give dates in every written form, impossible ones among them.
@query(
    "document_dates",
    "H15 H16",
    r"""WITH w AS (SELECT o_orderkey AS k, o_orderdate AS d, CASE o_orderkey % 5
        WHEN 0 THEN strftime(o_orderdate, 'D:%Y%m%d%H%M%S') || 'Z00''00'
        WHEN 1 THEN strftime(o_orderdate, '%Y%m') || lpad((o_orderkey % 40)::VARCHAR, 2, '0')
        WHEN 2 THEN strftime(o_orderdate, 'D:%Y') || lpad((o_orderkey % 16)::VARCHAR, 2, '0') || strftime(o_orderdate, '%d') || lpad((o_orderkey % 30)::VARCHAR, 2, '0') || '1575'
        WHEN 3 THEN strftime(o_orderdate, 'D:%Y%m%d') || '101112+05''30'''
        ELSE ' ' || strftime(o_orderdate, 'D:%Y%m%d') || '235959-11''15' END AS t FROM orders),
    p AS (SELECT k, d, t, regexp_extract(trim(t), '^D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:([+-Z])(\d{2})''?(\d{2})?''?)?',
        ['y','mo','da','h','mi','s','sg','oh','om']) AS g FROM w),
    n AS (SELECT k, d, t, try_cast(g.y AS INT) AS y, coalesce(try_cast(g.mo AS INT), 1) AS mo, coalesce(try_cast(g.da AS INT), 1) AS da,
        coalesce(try_cast(g.h AS INT), 0) AS h, coalesce(try_cast(g.mi AS INT), 0) AS mi, coalesce(try_cast(g.s AS INT), 0) AS s,
        CASE g.sg WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * (coalesce(try_cast(g.oh AS INT), 0) * 60 + coalesce(try_cast(g.om AS INT), 0)) AS off FROM p),
    r AS (SELECT *, make_date(y, 1, 1) + to_months(mo - 1) + to_days(da - 1) + to_hours(h) + to_minutes(mi - off) + to_seconds(s) AS ts FROM n)
    SELECT k AS order_key, t AS written, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS lenient,
      CASE WHEN mo BETWEEN 1 AND 12 AND da BETWEEN 1 AND 31 AND (h < 24 OR (h = 24 AND mi = 0 AND s = 0)) AND mi < 60 AND s < 60
           THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') END AS strict,
      'D:' || strftime(d, '%Y%m%d%H%M%S') || 'Z00''00' AS rewritten FROM r""",
)
def document_dates(spark, folder):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")

    def two(value):
        return F.lpad(value.cast("string"), 2, "0")

    form = (
        F.when(k % 5 == 0, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMddHHmmss"), F.lit("Z00'00")))
        .when(k % 5 == 1, F.concat(F.date_format(d, "yyyyMM"), two(k % 40)))
        .when(
            k % 5 == 2,
            F.concat(F.lit("D:"), F.date_format(d, "yyyy"), two(k % 16), F.date_format(d, "dd"), two(k % 30), F.lit("1575")),
        )
        .when(k % 5 == 3, F.concat(F.lit("D:"), F.date_format(d, "yyyyMMdd"), F.lit("101112+05'30'")))
        .otherwise(F.concat(F.lit(" D:"), F.date_format(d, "yyyyMMdd"), F.lit("235959-11'15")))
    )
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    return (
        table(spark, folder, "orders")
        .select(k, d, form.alias("written"))
        .select(
            k.alias("order_key"),
            "written",
            F.date_format(dates.lenient_document_date(F.col("written")), iso).alias("lenient"),
            F.date_format(dates.strict_document_date(F.col("written")), iso).alias("strict"),
            dates.written_document_date(d).alias("rewritten"),
        )
    )


@query(
    "typed_dates",
    "H17",
    r"""WITH w AS (SELECT o_orderkey AS k, CASE o_orderkey % 4
        WHEN 0 THEN strftime(o_orderdate, '%Y-') || (month(o_orderdate))::VARCHAR || '-' || (o_orderkey % 33)::VARCHAR
        WHEN 1 THEN (o_orderkey % 32)::VARCHAR || '/' || strftime(o_orderdate, '%m/%Y')
        WHEN 2 THEN ' ' || strftime(o_orderdate, '%d.%m.') || strftime(o_orderdate, '%y') || ' '
        ELSE o_orderpriority END AS t FROM orders),
    p AS (SELECT k, t, CASE
        WHEN regexp_matches(trim(t), '^\d{4}-\d{1,2}-\d{1,2}$') THEN string_split(trim(t), '-')
        WHEN regexp_matches(trim(t), '^\d{1,2}[./]\d{1,2}[./]\d{2,4}$') THEN list_reverse(regexp_split_to_array(trim(t), '[./]')) END AS g FROM w)
    SELECT k AS order_key, t AS typed,
      strftime(try_cast(lpad(CASE WHEN g[1]::INT < 100 THEN g[1]::INT + 2000 ELSE g[1]::INT END::VARCHAR, 4, '0') || '-' || lpad(g[2], 2, '0') || '-' || lpad(g[3], 2, '0') AS DATE), '%Y-%m-%d') AS read
    FROM p""",
)
def typed_dates(spark, folder):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    typed = (
        F.when(k % 4 == 0, F.concat_ws("-", F.date_format(d, "yyyy"), F.month(d).cast("string"), (k % 33).cast("string")))
        .when(k % 4 == 1, F.concat((k % 32).cast("string"), F.lit("/"), F.date_format(d, "MM/yyyy")))
        .when(k % 4 == 2, F.concat(F.lit(" "), F.date_format(d, "dd.MM.yy"), F.lit(" ")))
        .otherwise(F.col("o_orderpriority"))
    )
    return (
        table(spark, folder, "orders")
        .select(k.alias("order_key"), typed.alias("typed"))
        .withColumn("read", F.date_format(dates.typed_date(F.col("typed")), "yyyy-MM-dd"))
    )


_UNITS_SQL = " ".join(
    f"WHEN abs(s) >= {n} THEN CASE WHEN floor(s / {n} + 0.5) > 0 THEN 'in ' ELSE '' END || abs(floor(s / {n} + 0.5)::BIGINT)::VARCHAR || ' {u}' "
    f"|| CASE WHEN abs(floor(s / {n} + 0.5)) = 1 THEN '' ELSE 's' END || CASE WHEN floor(s / {n} + 0.5) > 0 THEN '' ELSE ' ago' END"
    for u, n in dates.UNITS
)


@query(
    "relative_times",
    "H33",
    f"""WITH e AS (SELECT event_id, (epoch_ms(ts) - epoch_ms(TIMESTAMP '2024-01-10 12:00:00')) / 1000.0::DOUBLE AS s FROM events)
    SELECT event_id, CASE {_UNITS_SQL} ELSE 'just now' END AS said FROM e""",
)
def relative_times(spark, folder):
    now = F.lit("2024-01-10 12:00:00").cast("timestamp")
    return table(spark, folder, "events").select(
        "event_id", dates.relative_time(F.col("ts"), now).alias("said")
    )


@query(
    "byte_sizes",
    "H34",
    """WITH b AS (SELECT o_orderkey AS k, floor(CASE o_orderkey % 6 WHEN 0 THEN o_totalprice % 1024 WHEN 1 THEN o_totalprice
        WHEN 2 THEN o_totalprice * 1024 WHEN 3 THEN o_totalprice * 1048576 WHEN 4 THEN o_totalprice * 1073741824 ELSE -1 END) AS v FROM orders),
    u AS (SELECT k, v, CASE WHEN v < 1048576 THEN 1 WHEN v < 1073741824 THEN 2 WHEN v < 1099511627776 THEN 3 ELSE 4 END AS i FROM b),
    s AS (SELECT *, v / pow(1024.0, i) AS x FROM u),
    r AS (SELECT *, CASE WHEN x >= 100 THEN floor(x + 0.5) ELSE floor(x * 10 + 0.5) / 10 END AS y FROM s)
    SELECT k AS order_key, CASE WHEN v < 0 THEN 'unknown' WHEN v < 1024 THEN v::BIGINT::VARCHAR || CASE WHEN v = 1 THEN ' byte' ELSE ' bytes' END
      ELSE regexp_replace(regexp_replace(printf('%.6f', y), '0+$', ''), '\\.$', '') || ' ' || ['KB','MB','GB','TB'][i] END AS size FROM r""",
)
def byte_sizes(spark, folder):
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    value = (
        F.when(k % 6 == 0, price % 1024)
        .when(k % 6 == 1, price)
        .when(k % 6 == 2, price * 1024)
        .when(k % 6 == 3, price * 1048576)
        .when(k % 6 == 4, price * 1073741824)
        .otherwise(F.lit(-1.0))
    )
    return table(spark, folder, "orders").select(
        k.alias("order_key"), numbers.byte_size(F.floor(value)).alias("size")
    )


_LEFT = ["v"]
for _amount, _ in numbers.NUMERALS:
    _LEFT.append(f"({_LEFT[-1]} % {_amount})")
_ROMAN_SQL = " || ".join(
    f"repeat('{mark}', ({left} // {amount})::INT)" for (amount, mark), left in zip(numbers.NUMERALS, _LEFT)
)


@query(
    "page_label_styles",
    "H10",
    f"""WITH v AS (SELECT p_partkey, (p_partkey % 4200)::INT AS raw, greatest((p_partkey % 4200)::INT, 1) AS v,
        CASE p_partkey % 6 WHEN 0 THEN 'decimal' WHEN 1 THEN 'romanLower' WHEN 2 THEN 'romanUpper' WHEN 3 THEN 'letterLower' WHEN 4 THEN 'letterUpper' ELSE 'none' END AS style FROM part),
    l AS (SELECT *, {_ROMAN_SQL} AS roman, repeat(chr(65 + (v - 1) % 26), (v - 1) // 26 + 1) AS letters FROM v)
    SELECT p_partkey, style, 'p-' || CASE style WHEN 'decimal' THEN v::VARCHAR WHEN 'romanLower' THEN lower(roman) WHEN 'romanUpper' THEN roman
      WHEN 'letterLower' THEN lower(letters) WHEN 'letterUpper' THEN letters ELSE '' END AS label FROM l""",
)
def page_label_styles(spark, folder):
    k = F.col("p_partkey")
    styles = F.array(*[F.lit(s) for s in ("decimal", "romanLower", "romanUpper", "letterLower", "letterUpper", "none")])
    return (
        table(spark, folder, "part")
        .select(k, F.element_at(styles, (k % 6 + 1).cast("int")).alias("style"))
        .select(k, "style", numbers.page_label(F.col("style"), F.lit("p-"), k % 4200).alias("label"))
    )


@query(
    "permission_bits",
    "F7 F8 Q22 F6",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey AS bits, l_linenumber AS revision,
        (l_quantity::INT % 5) + 1 AS version, l_suppkey FROM lineitem),
    c AS (SELECT *, bits & 4 <> 0 AS p, bits & 8 <> 0 AS m, bits & 16 <> 0 AS x, bits & 32 <> 0 AS a,
        CASE WHEN revision >= 3 THEN bits & 256 <> 0 ELSE bits & 32 <> 0 END AS f,
        CASE WHEN revision >= 3 THEN bits & 1024 <> 0 ELSE bits & 8 <> 0 END AS s FROM b)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, CASE WHEN NOT p THEN 'none' WHEN revision >= 3 AND bits & 2048 = 0 THEN 'low' ELSE 'full' END AS print,
      CASE WHEN m THEN 'all' WHEN a THEN 'annotate' WHEN f THEN 'form' WHEN s THEN 'assembly' ELSE 'none' END AS modify,
      x AS extract, CASE WHEN revision >= 3 THEN bits & 512 <> 0 ELSE x END AS extract_for_accessibility,
      f AS fill_forms, a AS annotate, s AS assemble, bits & 34 <> 0 AS hidden,
      CASE WHEN l_suppkey % 7 = 0 THEN 'Custom security handler' WHEN l_suppkey % 4 = 0 THEN 'AES-256' WHEN l_suppkey % 4 = 1 THEN 'AES-128'
           WHEN l_suppkey % 4 = 2 THEN 'None' WHEN version = 5 THEN 'AES-256' WHEN l_suppkey % 3 = 0 THEN 'RC4'
           ELSE 'RC4 ' || (version * 40)::VARCHAR || '-bit' END AS algorithm FROM c""",
)
def permission_bits(spark, folder):
    bits, revision = F.col("l_partkey").cast("int"), F.col("l_linenumber")
    supplier, version = F.col("l_suppkey"), F.col("l_quantity").cast("int") % 5 + 1
    handler = F.when(supplier % 7 == 0, "Custom").otherwise("Standard")
    method = F.when(supplier % 4 == 0, "AESV3").when(supplier % 4 == 1, "AESV2").when(supplier % 4 == 2, "None").otherwise("V2")
    key_bits = F.when(supplier % 3 != 0, version * 40)
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        *facts.permissions(bits, revision),
        facts.hidden_flag(bits).alias("hidden"),
        facts.algorithm(handler, method, version, key_bits).alias("algorithm"),
    )


_RISKY_SQL = ", ".join(f"'{e}'" for e in facts.RISKY_EXTENSIONS)


@query(
    "host_facts",
    "F9 F10 F21 S2 S17",
    rf"""WITH p AS (SELECT page_id, url, string_split(regexp_replace(url, '[?#].*$', ''), '/')[-1] AS leaf, string_split(url, '/')[3] AS host FROM pages),
    n AS (SELECT *, 'Report' || chr(58) || ' ' || leaf || '.' || ['exe','PDF','js','txt','tar.gz'][page_id % 5 + 1] || '..' AS name,
      '/data/' || host || '/' || CASE page_id % 3 WHEN 0 THEN '../' WHEN 1 THEN 'a/../b/./' ELSE '../../' END || leaf AS path, '/data/' || host AS root FROM p),
    s AS (SELECT *, {q.trimmed("regexp_replace(regexp_replace(regexp_extract(name, '[^\\/]*$'), '[<>:\"|?*\\x{00}-\\x{1f}]', '', 'g'), '\\.+$', '')")} AS clean FROM n)
    SELECT page_id, md5(url) AS url_hash, regexp_matches(lower(url), '^https?://[^\s/?#]+') OR regexp_matches(lower(url), '^mailto:') AS allowed,
      contains(clean, '.') AND lower(string_split(clean, '.')[-1]) IN ({_RISKY_SQL}) AS risky,
      CASE WHEN clean = '' THEN 'page' ELSE substr(clean, 1, 120) END AS safe, page_id % 3 = 1 AS inside,
      substr(sha256(lower(path)), 1, 32) AS document_id FROM s""",
)
def host_facts(spark, folder):
    url = F.col("url")
    leaf = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    host = F.element_at(F.split(url, "/"), 3)
    kinds = F.array(*[F.lit(e) for e in ("exe", "PDF", "js", "txt", "tar.gz")])
    k = F.col("page_id")
    step = F.when(k % 3 == 0, "../").when(k % 3 == 1, "a/../b/./").otherwise("../../")
    base = table(spark, folder, "pages").select(
        "page_id",
        "url",
        F.concat(F.lit("Report: "), leaf, F.lit("."), F.element_at(kinds, (k % 5 + 1).cast("int")), F.lit("..")).alias("name"),
        F.concat(F.lit("/data/"), host, F.lit("/"), step, leaf).alias("path"),
        F.concat(F.lit("/data/"), host).alias("root"),
    )
    safe = text.safe_name(F.col("name"))
    return base.select(
        "page_id",
        F.md5("url").alias("url_hash"),
        facts.allowed_url(url).alias("allowed"),
        facts.risky_attachment(safe).alias("risky"),
        safe.alias("safe"),
        facts.inside_root(F.col("path"), F.col("root")).alias("inside"),
        facts.document_id(F.col("path")).alias("document_id"),
    )


@query(
    "log_scrubbing",
    "F20 M8",
    r"""SELECT event_id, 'user=' || user_id::VARCHAR || ' ' || ['password', 'Token', 'PASSPHRASE', 'note'][event_id % 4 + 1] || [': ', '=', '" : '][event_id % 3 + 1]
      || CASE WHEN event_id % 4 < 3 THEN '***' WHEN event_id % 2 = 0 THEN event_type ELSE '"' || event_type || ' x"' END || ' value ' || props AS line FROM events""",
)
def log_scrubbing(spark, folder):
    k = F.col("event_id")

    def pick(options, n):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (k % n + 1).cast("int"))

    line = F.concat(
        F.lit("user="), F.col("user_id").cast("string"), F.lit(" "),
        pick(("password", "Token", "PASSPHRASE", "note"), 4), pick((": ", "=", '" : '), 3),
        F.when(k % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit('"'), F.col("event_type"), F.lit(' x"'))),
        F.lit(" value "), F.col("props"),
    )
    return table(spark, folder, "events").select("event_id", facts.scrubbed(line).alias("line"))


@query(
    "secrets_in_documents",
    "F20",
    # Word after word: what stands behind one is a value only after an optional quote, blanks and a separator.
    r"""WITH RECURSIVE seek AS (
      SELECT doc_id, text, '' AS shown, text AS rest FROM documents
      UNION ALL
      SELECT doc_id, text,
        shown || CASE WHEN hit IS NULL THEN rest WHEN cut IS NULL THEN left(rest, hit.at) ELSE left(rest, length(rest) - length(value)) || '***' END,
        CASE WHEN hit IS NULL THEN NULL WHEN cut IS NULL THEN substr(rest, hit.at + 1) ELSE substr(value, cut + 1) END
      FROM (
        SELECT *, CASE WHEN left(b, 1) IN (':', '=') AND value <> '' THEN
          CASE WHEN left(value, 1) IN (chr(34), chr(39)) AND instr(substr(value, 2), left(value, 1)) > 0 THEN instr(substr(value, 2), left(value, 1)) + 1
            ELSE length(string_split(translate(value, BLANKS, repeat(' ', 6)), ' ')[1]) END END AS cut
        FROM (
          SELECT *, ltrim(substr(b, 2), BLANKS) AS value
          FROM (
            SELECT *, ltrim(CASE WHEN left(after, 1) IN (chr(34), chr(39)) THEN substr(after, 2) ELSE after END, BLANKS) AS b
            FROM (
              SELECT *, substr(rest, hit.at + length(hit.word)) AS after
              FROM (
                SELECT *, list_min(list_transform(list_filter(['password', 'passphrase', 'secret', 'token'], lambda w: instr(lower(rest), w) > 0),
                  lambda w: {'at': instr(lower(rest), w), 'word': w})) AS hit
                FROM seek WHERE rest IS NOT NULL))))))
    SELECT doc_id, md5(shown) AS clean, shown <> text AS changed FROM seek WHERE rest IS NULL AND text IS NOT NULL""".replace(
        "BLANKS", "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    ),
)
def secrets_in_documents(spark, folder):
    return (
        documents(spark, folder)
        .select("doc_id", "text", facts.scrubbed(F.col("text")).alias("clean_text"))
        .select("doc_id", F.md5("clean_text").alias("clean"), (F.col("clean_text") != F.col("text")).alias("changed"))
    )


@query(
    "page_ranges",
    "F3 A16 U2 F25 A28",
    """WITH r AS (SELECT o_orderkey AS k, (o_custkey % 9 + 5)::BIGINT AS n, o_orderkey % 3 + 1 AS a, o_orderkey % 4 + 2 AS b FROM orders),
    s AS (SELECT *, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN a || '-' || b || ' ; ' || n WHEN 2 THEN '-' || a || ',' || b || '-'
       WHEN 3 THEN b || ' - ' || a WHEN 4 THEN (n + 1) || ', 2' ELSE 'x' || a END AS input FROM r),
    e AS (SELECT *, CASE k % 6 WHEN 0 THEN range(1, n + 1) WHEN 1 THEN list_sort(list_distinct(list_concat(range(least(a, b), greatest(a, b) + 1), [n])))
       WHEN 2 THEN list_sort(list_distinct(list_concat(range(1, a + 1), range(b, n + 1)))) WHEN 3 THEN range(least(a, b), greatest(a, b) + 1) ELSE [] END AS pages FROM s)
    SELECT k AS order_key, input, n AS page_count, CASE k % 6 WHEN 0 THEN 'all' WHEN 4 THEN 'invalid' WHEN 5 THEN 'invalid' ELSE 'pages' END AS kind,
      CASE k % 6 WHEN 4 THEN 'This document has pages 1 to ' || n || '.' WHEN 5 THEN '“' || input || '” is not a page number.' END AS message,
      array_to_string(pages, ',') AS pages,
      (SELECT coalesce(string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo), '')
       FROM (SELECT min(p) AS lo, max(p) AS hi FROM (SELECT p, p - row_number() OVER (ORDER BY p) AS g FROM (SELECT unnest(pages) AS p)) GROUP BY g)) AS written,
      CASE WHEN k % 6 IN (4, 5) THEN n ELSE len(pages) END AS planned
    FROM e""",
)
def page_ranges(spark, folder):
    k = F.col("o_orderkey")
    base = table(spark, folder, "orders").select(
        k.alias("order_key"),
        (F.col("o_custkey") % 9 + 5).alias("page_count"),
        (k % 3 + 1).cast("string").alias("a"),
        (k % 4 + 2).cast("string").alias("b"),
    )
    k, n, a, b = F.col("order_key"), F.col("page_count").cast("string"), F.col("a"), F.col("b")
    typed = (
        F.when(k % 6 == 0, F.lit(""))
        .when(k % 6 == 1, F.concat(a, F.lit("-"), b, F.lit(" ; "), n))
        .when(k % 6 == 2, F.concat(F.lit("-"), a, F.lit(","), b, F.lit("-")))
        .when(k % 6 == 3, F.concat(b, F.lit(" - "), a))
        .when(k % 6 == 4, F.concat((F.col("page_count") + 1).cast("string"), F.lit(", 2")))
        .otherwise(F.concat(F.lit("x"), a))
    )
    return (
        base.withColumn("input", typed)
        .withColumn("range", ranges.parsed(F.col("input"), F.col("page_count")))
        .withColumn("listed", ranges.expanded(F.col("range"), F.col("page_count")))
        .select(
            "order_key",
            "input",
            "page_count",
            "range.kind",
            "range.message",
            F.array_join(F.transform("listed", lambda p: p.cast("string")), ",").alias("pages"),
            ranges.written(F.col("listed")).alias("written"),
            F.when(F.col("range.kind") == "invalid", F.col("page_count"))
            .otherwise(F.size("listed"))
            .alias("planned"),
        )
    )


@query(
    "print_pages",
    "F4 H8",
    """WITH r AS (SELECT o_orderkey AS k, (o_custkey % 12 + 1)::BIGINT AS n, ['all','current','range'][o_orderkey % 3 + 1] AS scope,
        ['all','odd','even'][(o_orderkey // 3) % 3 + 1] AS subset, o_orderkey % 20 AS cur FROM orders),
    s AS (SELECT *, CASE WHEN k % 2 = 0 THEN '' ELSE '2-' END AS t FROM r),
    b AS (SELECT *, CASE scope WHEN 'current' THEN [least(greatest(cur, 1), n)] WHEN 'all' THEN range(1, n + 1)
        ELSE CASE WHEN t = '' OR n < 2 THEN [] ELSE range(2, n + 1) END END AS base,
        CASE WHEN scope = 'range' AND t = '' THEN 'Enter the pages to print, such as 1-4, 9.'
             WHEN scope = 'range' AND n < 2 THEN 'This document has pages 1 to ' || n || '.' END AS m FROM s),
    f AS (SELECT *, list_filter(base, lambda p: subset = 'all' OR p % 2 = CASE subset WHEN 'odd' THEN 1 ELSE 0 END) AS kept FROM b)
    SELECT k AS order_key, CASE WHEN m IS NULL AND NOT (subset <> 'all' AND len(kept) = 0) THEN array_to_string(kept, ',') ELSE '' END AS pages,
      coalesce(m, CASE WHEN subset <> 'all' AND len(kept) = 0 THEN 'Those pages include no ' || subset || ' pages.' END) AS message,
      CASE WHEN len(kept) = 1 THEN 'Page ' || kept[1] WHEN len(kept) > 8 THEN len(kept) || ' pages' ELSE 'Pages ' || array_to_string(kept, ', ') END AS wording
    FROM f WHERE coalesce(m, '') = ''""",
)
def print_pages(spark, folder):
    k, n = F.col("o_orderkey"), F.col("o_custkey") % 12 + 1

    def pick(options, by):
        return F.element_at(F.array(*[F.lit(o) for o in options]), by.cast("int"))

    subset = pick(("all", "odd", "even"), F.floor(k / 3) % 3 + 1)
    choice = ranges.print_selection(
        pick(("all", "current", "range"), k % 3 + 1),
        F.when(k % 2 == 0, F.lit("")).otherwise(F.lit("2-")),
        subset,
        k % 20,
        n,
    )
    return (
        table(spark, folder, "orders")
        .select(k.alias("order_key"), choice.alias("choice"))
        .where(F.col("choice.message").isNull() | F.startswith("choice.message", F.lit("Those pages")))
        .select(
            "order_key",
            F.array_join(F.transform("choice.pages", lambda p: p.cast("string")), ",").alias("pages"),
            "choice.message",
            facts.pages_wording(F.col("choice.pages")).alias("wording"),
        )
    )
