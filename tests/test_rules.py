"""Rules on small literal rows."""

import random

import pytest
from pyspark.sql import functions as F

from quire.functions import dates, facts, numbers, ranges, text
from quire.operators import audit, layout, pages, redact, trees
from quire.operators.scale import running_total, runs
from quire.sources import files, ocr, sinks
from quire.sources.paginate import PageSetup, wrapped_text


def one(spark, column, **cells):
    names = list(cells)
    frame = spark.createDataFrame([tuple(cells.values())], names) if names else spark.range(1)
    return frame.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    "hay, needle, case, whole, starts",
    [
        ("aaa", "aa", False, False, [0, 1]),
        ("Cat cat scatter", "cat", False, False, [0, 4, 9]),
        ("Cat cat scatter", "cat", True, False, [4, 9]),
        ("Cat cat scatter", "cat", False, True, [0, 4]),
        ("cost (a+b)?", "(a+b)?", False, False, [5]),
        ("Größe, größe", "GRÖSSE", False, False, []),
        ("Größe, größe", "größe", False, False, [0, 7]),
        ("x\\Ey\\E", "\\E", False, False, [1, 4]),
        ("", "a", False, False, []),
        ("abc", "", False, False, []),
        ("under_score score", "score", False, True, [12]),
    ],
)
def test_match_starts(spark, hay, needle, case, whole, starts):
    assert one(spark, text.match_starts(F.col("h"), needle, case, whole), h=hay) == starts
    assert one(spark, text.match_starts(F.col("h"), F.col("n"), case, whole), h=hay, n=needle) == starts


def test_excerpt_cuts_only_where_it_must(spark):
    body = "x" * 50 + " needle " + "y" * 50
    got = one(spark, text.excerpt(F.col("t"), F.lit(51), F.lit(57)), t=body)
    assert got == "…" + "x" * 33 + " needle " + "y" * 33 + "…"
    assert one(spark, text.excerpt(F.col("t"), F.lit(0), F.lit(1)), t="a  b") == "a b"


def wrap(value, n):
    """Greedy wrap, word by word, as a plain loop."""
    lines = []
    import re

    for paragraph in re.split(r"\r\n|\r|\n", value):
        if paragraph == "":
            lines.append("")
            continue
        current = ""
        for token in re.split(r"([  ]+)", paragraph):
            if token == "":
                continue
            if current != "" and len(current + token) > n:
                lines.append(current.rstrip("  "))
                current = token.lstrip("  ")
            else:
                current += token
            while len(current) > n:
                lines.append(current[:n])
                current = current[n:]
        lines.append(current.rstrip("  "))
    return lines


def test_wrapping_against_a_loop(spark):
    rng = random.Random(7)
    samples = ["", "a", "one two", " lead", "   ", "trail ", "x" * 25, "ab " * 9, "\n", "a\n\nb\n", "\r\nq"]
    for _ in range(400):
        samples.append("".join(rng.choice(["a", "bb", "cccccccc", " ", " ", "  ", "\n", "ddddddddddddddd"]) for _ in range(rng.randint(1, 25))))
    frame = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, s string")
    got = {r.i: list(r.v) for r in frame.select("i", wrapped_text(F.col("s"), 10).alias("v")).collect()}
    wrong = [(s, got[i], wrap(s, 10)) for i, s in enumerate(samples) if got[i] != wrap(s, 10)]
    assert not wrong, wrong[:3]


def test_page_setup_follows_the_paper():
    setup = PageSetup()
    assert (setup.columns, setup.lines_per_page) == (78, 49)
    assert PageSetup(paper="letter", landscape=True).size == (792.0, 612.0)
    assert PageSetup(margin=5000).box[2:] == (48.0, pytest.approx(841.89 - 2 * 273.64))


@pytest.mark.parametrize(
    "typed, count, kind, expected",
    [
        ("", 3, "all", [1, 2, 3]), ("2", 3, "pages", [2]), ("1-2; 5", 5, "pages", [1, 2, 5]), ("9-4", 9, "pages", [4, 5, 6, 7, 8, 9]),
        ("-2,4-", 5, "pages", [1, 2, 4, 5]), ("2-3,3-4", 5, "pages", [2, 3, 4]), ("x", 3, "invalid", []), ("7", 3, "invalid", []),
        (" , ;", 3, "invalid", []), ("1", 0, "invalid", []), ("1-", 4, "pages", [1, 2, 3, 4]),
    ],
)
def test_page_ranges(spark, typed, count, kind, expected):
    parsed = ranges.parsed(F.col("t"), F.col("n"))
    assert one(spark, parsed["kind"], t=typed, n=count) == kind
    assert one(spark, ranges.expanded(parsed, F.col("n")), t=typed, n=count) == expected


def test_range_messages_and_writing(spark):
    assert one(spark, ranges.parsed(F.lit("3-x"), F.lit(9))["message"]) == "“x” is not a page number."
    assert one(spark, ranges.parsed(F.lit("12"), F.lit(9))["message"]) == "This document has pages 1 to 9."
    assert one(spark, ranges.written(F.array(*[F.lit(n) for n in (3, 1, 2, 7, 7)]))) == "1-3, 7"


@pytest.mark.parametrize(
    "typed, expected",
    [("1,234.50", 1234.5), (" £ 12 ", 12.0), ("-3", -3.0), ("-", None), ("", None), ("12 apples", None), ("1e3", 1000.0), ("0x10", 16.0), ("€.5", 0.5)],
)
def test_typed_numbers(spark, typed, expected):
    assert one(spark, numbers.typed_number(F.col("t")), t=typed) == expected


@pytest.mark.parametrize(
    "typed, expected",
    [("2026-09-23", "2026-09-23"), ("23/09/2026", "2026-09-23"), ("3.2.24", "2024-02-03"), ("31/02/2024", None), ("2023-02-29", None), ("soon", None)],
)
def test_typed_dates(spark, typed, expected):
    assert one(spark, F.date_format(dates.typed_date(F.col("t")), "yyyy-MM-dd"), t=typed) == expected


def test_document_dates(spark):
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    lenient = F.date_format(dates.lenient_document_date(F.col("t")), iso)
    strict = F.date_format(dates.strict_document_date(F.col("t")), iso)
    assert one(spark, lenient, t="D:20240102030405+01'30'") == "2024-01-02T01:34:05"
    assert one(spark, lenient, t="D:20241301") == "2025-01-01T00:00:00"
    assert one(spark, strict, t="D:20241301") is None
    assert one(spark, strict, t="D:2024") == "2024-01-01T00:00:00"
    assert one(spark, lenient, t="yesterday") is None
    for typed, loose, tight in (
        ("20240102", "2024-01-02T00:00:00", "2024-01-02T00:00:00"), (":2024", "2024-01-01T00:00:00", "2024-01-01T00:00:00"),
        ("D:20240102030405Z00'00'", "2024-01-02T03:04:05", "2024-01-02T03:04:05"), ("D:2024010203-02", "2024-01-02T05:00:00", "2024-01-02T05:00:00"),
        ("D:20240102030405-0230", "2024-01-02T05:34:05", "2024-01-02T05:34:05"), ("D:20240102030405+1", "2024-01-02T03:04:05", "2024-01-02T03:04:05"),
        ("D:20240102030405A01", "2024-01-02T02:04:05", "2024-01-02T03:04:05"), ("D:202", None, None), ("D:20240102256199", "2024-01-03T02:02:39", None),
        ("D:20240102030405+2500", "2024-01-01T02:04:05", None), ("D:20245", "2024-01-01T00:00:00", "2024-01-01T00:00:00"),
    ):
        assert one(spark, lenient, t=typed) == loose, typed
        assert one(spark, strict, t=typed) == tight, typed


def test_log_lines_hide_secrets(spark):
    for line, shown in (
        ("password=abc def", "password=*** def"), ('Token: "two words" end', "Token: *** end"), ("my secret : 'x y'", "my secret : ***"),
        ('"passphrase": 12', '"passphrase": ***'), ("token=", "token="), ("no word here", "no word here"), ("SECRET=a token=b", "SECRET=*** token=***"),
        ("token: password: x", "token: *** x"), ("token=a:b=c d", "token=*** d"), ("token='a=b' secret=1", "token=*** secret=***"),
        ("token='open end", "token=*** end"), ('say token" = "a secret: b" c', 'say token" = *** c'), ("mytoken\t=\tx\ny", "mytoken\t=\t***\ny"),
        ("token == x", "token =*** x"), ("token is: x", "token is: x"), ("password:", "password:"), ("token=\u00e9\U0001f600 z", "token=*** z"),
        ("secret='' x", "secret=*** x"), ("secret''=x", "secret''=x"), ("token= ", "token= "),
    ):
        assert one(spark, facts.scrubbed(F.col("t")), t=line) == shown


def test_labels_and_sizes(spark):
    said = [one(spark, numbers.page_label(F.lit(s), F.lit("p"), F.lit(n))) for s, n in (("romanLower", 1994), ("letterUpper", 28), ("decimal", 0), ("none", 4))]
    assert said == ["pmcmxciv", "pBB", "p1", "p"]
    assert [one(spark, numbers.byte_size(F.lit(n))) for n in (1, 1023, 1536, 150 * 1024, -1)] == ["1 byte", "1023 bytes", "1.5 KB", "150 KB", "unknown"]


def test_containment_of_paths(spark):
    inside = facts.inside_root(F.col("p"), F.col("r"))
    assert one(spark, inside, p="/a/b/../b/c", r="/a/b")
    assert not one(spark, inside, p="/a/b/../../c", r="/a/b")
    assert not one(spark, inside, p="/a/bc", r="/a/b")
    assert one(spark, inside, p="/a/b", r="/a/b/")


def items(rows):
    return [(1, 1, i, s, float(x), float(y), len(s) * 5.0, float(h)) for i, (s, x, y, h) in enumerate(rows)]


ITEM = "doc_id long, page int, seq int, str string, x double, y double, width double, height double"


def test_tables_are_found_and_prose_is_not(spark):
    grid = [(s, x, y, 10) for y, row in ((700, ("Item", "Qty", "Price")), (680, ("Widget", "12", "4.50")), (660, ("Sprocket", "3", "19.00"))) for s, x in zip(row, (100, 300, 420))]
    found = layout.sheet_rows(layout.lines(layout.page_rows(spark.createDataFrame(items(grid), ITEM)))).orderBy("line", "column").collect()
    assert [r.text for r in found] == ["Item", "Qty", "Price", "Widget", "12", "4.50", "Sprocket", "3", "19.00"]
    assert [r.number for r in found][3:6] == [None, 12.0, 4.5]
    prose = [("It was", 72, 700, 10), ("a bright", 72, 686, 10), ("cold day", 72, 672, 10)]
    rows = layout.sheet_rows(layout.lines(layout.page_rows(spark.createDataFrame(items(prose), ITEM)))).collect()
    assert len(rows) == 3 and {r.column for r in rows} == {0}


def test_line_anchor_is_the_first_item(spark):
    # Each step is within the tolerance of the one before, not of the first.
    steps = [("a", 10, 100, 10), ("b", 40, 97, 10), ("c", 70, 94, 10)]
    found = layout.lines(layout.page_rows(spark.createDataFrame(items(steps), ITEM))).orderBy("line").collect()
    assert [r.text for r in found] == ["a b", "c"]


def test_words_of_a_scan(spark):
    def row(level, line, conf, word, left="10"):
        return "\t".join([str(level), "1", "1", "1", str(line), "1", left, "5", "30", "12", conf, word])

    rows = [row(4, 1, "-1", ""), row(5, 1, "96.2", "Invoice"), row(5, 1, "95.1", "number"), row(5, 2, "12.5", "ACME-0042"), row(5, 2, "-1", " "), row(5, 3, "50", "lost", "x"), row(5, 4, "n", "tail")]
    frame = spark.createDataFrame([(1, 1, i, r) for i, r in enumerate(["level\tx", "", *rows])], "doc_id long, page int, ord int, row string")
    words = ocr.words(frame)
    assert [(r.text, r.line, r.confidence) for r in words.orderBy("seq").collect()] == [("Invoice", 0, 96.2), ("number", 0, 95.1), ("ACME-0042", 1, 12.5), ("tail", 3, -1.0)]
    page = ocr.page_texts(words).first()
    assert page.text == "Invoice number\nACME-0042\ntail" and page.confidence == 67.9


def page_row(spark, *rows):
    item = "struct<seq:int,str:string,x:double,y:double,width:double,height:double>"
    return spark.createDataFrame([(1, 1, [(i, s, float(x), float(y), len(s) * 5.0, 10.0) for i, (s, x, y) in enumerate(rows)])], f"doc_id long, page int, items array<{item}>")


def test_redaction_reads_across_runs(spark):
    page = page_row(spark, ("Secret", 10, 100), ("plan", 42, 100), ("B", 10, 80), ("secretplan", 60, 80))
    found = redact.find_text(page, "secret  plan").collect()
    assert [(r.text, r.start, len(r.rects)) for r in found] == [("Secret plan", 0, 1)]
    assert [r.start for r in redact.find_text(page, "plan b").collect()] == [7]
    assert redact.find_text(page, "SECRET", match_case=True).count() == 0
    assert [r.start for r in redact.find_text(page, "secret", whole_word=True).collect()] == [0]


def test_matches_to_redact_do_not_overlap(spark):
    assert [r.start for r in redact.find_text(page_row(spark, ("aaaa", 0, 0)), "aa").collect()] == [0, 2]


def test_running_totals_cross_stretches(spark):
    frame = spark.range(1, 1000).select(F.lit(1).alias("k"), F.col("id").alias("n"))
    got = running_total(frame, ["k"], "n", F.col("n") % 3, "before", stretch=64).orderBy("n").collect()
    total = 0
    for row in got:
        assert row.before == total
        total += row.n % 3


def test_runs_cross_stretches(spark):
    numbers_ = [1, 2, 3, 7, 8, *range(60, 200), 500]
    frame = spark.createDataFrame([(1, n) for n in numbers_ + numbers_], "k int, n int")
    assert sorted((r["first"], r["last"]) for r in runs(frame, ["k"], "n", stretch=16).collect()) == [(1, 3), (7, 8), (60, 199), (500, 500)]


@pytest.mark.parametrize("moving, to, expected", [([1], 3, [2, 3, 1, 4, 5]), ([4, 5], 0, [4, 5, 1, 2, 3]), ([2, 4], 3, [1, 3, 2, 4, 5]), ([1, 5], 99, [2, 3, 4, 1, 5])])
def test_block_moves(spark, moving, to, expected):
    base = spark.range(1, 6).select(F.lit(1).alias("doc_id"), F.col("id").alias("page"))
    moves = spark.createDataFrame([(1, p, to) for p in moving], "doc_id int, page long, to_index int")
    assert [r.page for r in pages.moved(base, moves).orderBy("position").collect()] == expected


def test_list_ranking_and_loops(spark):
    links = [(1, n, n + 1) for n in range(1, 200)] + [(1, 200, None), (2, 1, 2), (2, 2, 1)]
    got = trees.chained(spark.createDataFrame(links, "k int, node long, next long"), ["k"]).collect()
    assert {r.node: r.place for r in got if r.k == 1} == {n: n - 1 for n in range(1, 201)}
    assert {(r.node, r.head, r.place) for r in got if r.k == 2} == {(1, None, None), (2, None, None)}


def test_long_lists_and_deep_trees_lose_nothing(spark):
    """20,000 siblings, and one entry under another 100 levels deep."""
    wide = [(1, n, None, n + 1 if n < 20_000 else None, n == 1) for n in range(1, 20_001)]
    deep = [(2, n, n + 1 if n < 100 else None, None, n == 1) for n in range(1, 101)]
    nodes = spark.createDataFrame(wide + deep, "k int, node long, first long, next long, is_root boolean")
    rows = trees.outline_rows(nodes, ["k"]).collect()
    assert [r.node for r in sorted((r for r in rows if r.k == 1), key=lambda r: r.order)] == list(range(1, 20_001))
    assert {r.node: r.level for r in rows if r.k == 2} == {n: n for n in range(1, 101)}


def test_roles_are_followed_to_their_end(spark):
    roles = spark.createDataFrame([(1, f"t{n}", f"t{n + 1}") for n in range(40)] + [(1, "a", "b"), (1, "b", "a")], "k int, type string, role string")
    types = spark.createDataFrame([(1, "t0"), (1, "t7"), (1, "a"), (1, "plain")], "k int, type string")
    got = {r.type: r.resolved for r in trees.resolved_roles(types, roles, ["k"]).collect()}
    assert got == {"t0": "t40", "t7": "t40", "a": "b", "plain": "plain"}


def test_missing_facts_are_unknown(spark):
    one_doc = spark.createDataFrame([(1, "t", "en", True, True, True, False, True)], "doc_id int, title string, language string, display_title boolean, has_tags boolean, marked boolean, encrypted boolean, may_extract boolean")
    status = {r.check: r.status for r in audit.accessibility_report(one_doc).collect()}
    assert status["figureAltText"] == "unknown" and status["title"] == "passed"
    none = spark.createDataFrame([], "doc_id int, alt string, actual_text string")
    assert {r.check: r.status for r in audit.accessibility_report(one_doc, audit.figure_facts(none)).collect()}["figureAltText"] == "notApplicable"


def test_moves_in_an_outline(spark):
    rows = spark.createDataFrame([(1, p) for p in ("0", "0.0", "0.1", "1", "2")], "doc_id int, path string")
    plan = {(r.path, r.move): (r.parent, r["index"], r.result) for r in trees.planned_moves(rows, ["doc_id"]).collect()}
    assert plan["1", "up"] == ("", 0, "0") and plan["1", "down"] == ("", 3, "2")
    assert plan["1", "indent"] == ("0", 2, "0.2") and plan["0.1", "outdent"] == ("", 1, "1")
    assert plan["0", "up"] == (None, None, None) and plan["0.0", "indent"] == (None, None, None)


def test_file_health(spark):
    made = [("/good", b"%PDF-1.7 body"), ("/locked", b"%PDF-1.4 " + b"x" * 9000 + b"/Encrypt 3 0 R"), ("/plain", b"hello")]
    got = {r.path: r for r in files.health(spark.createDataFrame(made, "path string, content binary")).collect()}
    assert got["/good"].can_repair and got["/good"].version == "1.7"
    assert got["/locked"].encrypted and not got["/locked"].can_repair
    assert not got["/plain"].can_repair and got["/plain"].version is None


def test_pictures_tell_their_size(spark):
    png = bytes.fromhex("89504e470d0a1a0a0000000d49484452") + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\0" * 8
    jpeg = bytes.fromhex("ffd8ffe000104a46494600010100000100010000ffc0001108") + (90).to_bytes(2, "big") + (120).to_bytes(2, "big") + b"\x03" + b"\0" * 9
    frame = spark.createDataFrame([("p", png), ("j", jpeg)], "path string, content binary")
    sizes = {r.path: r.s for r in frame.select("path", files.png_size(F.col("content")).alias("s")).collect()}
    assert tuple(sizes["p"]) == (640, 480) and sizes["j"] is None
    assert {r.path: (r.width, r.height) for r in files.jpeg_sizes(frame).collect()}["j"] == (120, 90)


def test_publish_swaps_only_verified_rows(spark, tmp_path):
    folder = str(tmp_path)
    first = spark.range(10).withColumn("v", F.col("id") * 2)
    sinks.publish(first, folder, "pages")
    assert sinks.published(spark, folder, "pages").count() == 10
    sinks.publish(spark.range(3).withColumn("v", F.col("id")), folder, "pages")
    assert sinks.published(spark, folder, "pages").count() == 3


def test_text_pieces_join_to_one_file(spark):
    pages_ = spark.createDataFrame([(1, n, f"p{n}") for n in range(1, 8)] + [(2, 1, "x")], "doc_id int, page int, text string")
    whole = {r.doc_id: r.content for r in sinks.text_documents(pages_).collect()}
    cut = sinks.text_documents(pages_, piece_pages=3).orderBy("doc_id", "piece").collect()
    assert "".join(r.content for r in cut if r.doc_id == 1) == whole[1]
    assert whole[1].endswith("p6\n\f\np7\n") and whole[2] == sinks.BYTE_ORDER_MARK + "x\n"


def test_parts_are_written_apart(spark, tmp_path):
    frame = spark.createDataFrame([(1, 1, 1), (1, 2, 2)], "doc_id int, page int, part int")
    sinks.write_parts(frame, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == ["part=1", "part=2"]
