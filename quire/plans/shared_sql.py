"""SQL building blocks shared by the oracles (written for DuckDB)."""

from __future__ import annotations

from quire.sources.paginate import A4

N = A4.columns
PER_PAGE = A4.lines_per_page
BLANK = r"[\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SOLID = r"[^\s\x{0b}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
WORD = r"[\p{L}\p{N}_]"


def trimmed(e: str) -> str:
    return f"regexp_replace({e}, '^{BLANK}+|{BLANK}+$', '', 'g')"


def collapsed(e: str) -> str:
    return trimmed(f"regexp_replace({e}, '{BLANK}+', ' ', 'g')")


def drawable(e: str) -> str:
    e = f"replace({e}, chr(9), '    ')"
    e = f"translate({e}, '‘’“”–—', '''''\"\"--')"
    e = f"replace({e}, '…', '...')"
    return f"regexp_replace({e}, '[^\\n\\r -~\\x{{a0}}-\\x{{ff}}]', '?', 'g')"


def excerpt(text: str, start: str, end: str, radius: int = 34) -> str:
    a = f"greatest(0, {start} - {radius})"
    b = f"least(length({text}), {end} + {radius})"
    inner = collapsed(f"substr({text}, {a} + 1, {b} - {a})")
    return (
        f"(CASE WHEN {a} > 0 THEN '…' ELSE '' END || {inner} || "
        f"CASE WHEN {b} < length({text}) THEN '…' ELSE '' END)"
    )


def starts(text: str, needle: str) -> str:
    """0-based starts of all occurrences, overlapping ones too."""
    return (
        f"list_filter(range(length({text}) - length({needle}) + 1), "
        f"lambda i: substr({text}, i + 1, length({needle})) = {needle})"
    )


def half_up(e: str) -> str:
    return f"floor({e} + 0.5)"


_S = r"[\s\x{a0}]"
_WRAP = f".{{1,{N}}}(?:{_S}+|$)|.{{{N}}}"

# Documents laid out as pages of at most PER_PAGE lines of N characters.
LINES = f"""
para AS (
  SELECT doc_id, i AS para_no, p,
         length(regexp_extract(p, '^{_S}*')) AS lead,
         length(regexp_extract(p, '^{_S}*([^\\s\\x{{a0}}]*)', 1)) AS word
  FROM (SELECT doc_id, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
        FROM (SELECT doc_id, regexp_split_to_array({drawable("CASE WHEN text = '' THEN ' ' ELSE text END")}, '\\r\\n|\\r|\\n') AS ps
              FROM documents))),
para2 AS (SELECT *, greatest((lead - 1) // {N}, 0) AS filled FROM para),
para3 AS (SELECT *, (lead - filled * {N} > 0 AND word > 0 AND lead - filled * {N} + word > {N}) AS pushed FROM para2),
para4 AS (SELECT *, regexp_extract_all(substr(p, CASE WHEN pushed THEN lead ELSE filled * {N} END + 1), '{_WRAP}') AS pieces FROM para3),
wrapped AS (
  SELECT doc_id, para_no, CASE WHEN p = '' THEN [''] ELSE
    list_concat(list_transform(range(filled), lambda i: substr(p, i * {N} + 1, {N})),
    list_concat(CASE WHEN pushed THEN [''] ELSE []::VARCHAR[] END,
    list_concat(list_transform(pieces, lambda r: regexp_replace(r, '{_S}+$', '')),
                CASE WHEN length(coalesce(pieces[-1], '')) > {N} AND regexp_matches(pieces[-1], '{_S}$')
                     THEN [''] ELSE []::VARCHAR[] END))) END AS ls
  FROM para4),
doc_line AS (
  SELECT doc_id, str, row_number() OVER (PARTITION BY doc_id ORDER BY para_no, k) - 1 AS line_no
  FROM (SELECT doc_id, para_no, unnest(ls) AS str, generate_subscripts(ls, 1) AS k FROM wrapped)),
page_line AS (
  SELECT doc_id, line_no // {PER_PAGE} + 1 AS page, line_no % {PER_PAGE} AS line, str FROM doc_line),
page_dim AS (SELECT doc_id, max(line_no) // {PER_PAGE} + 1 AS page_count FROM doc_line GROUP BY 1)"""

X, Y, _W, _H = A4.box
ITEMS = LINES + f""",
drawn AS (
  SELECT doc_id, page, line, str, row_number() OVER w - 1 AS seq, count(*) OVER (PARTITION BY doc_id, page) AS n,
         coalesce(sum(length(str) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset"
  FROM page_line WHERE str <> '' WINDOW w AS (PARTITION BY doc_id, page ORDER BY line)),
text_items AS (
  SELECT doc_id, page, seq, str, {X}::DOUBLE AS x,
         {Y + _H}::DOUBLE - {A4.leading}::DOUBLE * (line + 1) + {A4.font_size * 0.25}::DOUBLE AS y,
         length(str) * {A4.advance!r}::DOUBLE AS width, {A4.font_size}::DOUBLE AS height,
         seq + 1 < n AS has_eol, "offset" FROM drawn)"""

PAGES = ITEMS + """,
page_text AS (
  SELECT l.doc_id, d.page_count, l.page,
         coalesce(string_agg(l.str, chr(10) ORDER BY l.line) FILTER (WHERE l.str <> ''), '') AS text
  FROM page_line l JOIN page_dim d USING (doc_id) GROUP BY ALL)"""
