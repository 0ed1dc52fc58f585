"""Lines read over Arrow batches: pages across batches, ties, blanks, and no work in lists of a page."""

from pyspark.sql import functions as F

from quire.operators import layout
from quire.plans import QUERIES
from quire.sources.paginate import paginate, word_rows

ITEM = "doc_id long, page int, seq long, str string, x double, y double, width double, height double"


def read(spark, rows):
    return layout.line_pages(layout.gathered_rows(spark.createDataFrame(rows, ITEM)))


def test_pages_that_cross_batches_stay_whole(spark):
    rows = [(d, p, i, f"w{i}", 10.0 * (i % 5), 700.0 - 20 * (i // 5), 8.0, 10.0) for d in (1, 2, 3) for p in (1, 2) for i in range(25)]
    kept = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        whole = sorted(map(str, layout.line_rows(read(spark, rows)).collect()))
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        cut = sorted(map(str, layout.line_rows(read(spark, rows)).collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", kept)
    assert len(whole) == 30 and cut == whole


def test_items_of_one_place_and_number_go_by_their_text(spark):
    rows = [(1, 1, 0, s, 10.0, 700.0, 5.0, 10.0) for s in ("b", "a", "c")]
    assert [r["text"] for r in layout.line_rows(read(spark, rows)).collect()] == ["abc"]


def test_gaps_blanks_and_pages_without_words(spark):
    rows = [
        (1, 1, 0, "a\u00a0 b", 10.0, 700.0, 5.0, 10.0), (1, 1, 1, "c ", 40.0, 700.0, 5.0, 10.0), (1, 1, 2, "d", 80.0, 701.0, 5.0, 10.0),
        (2, 1, 0, " \u2003", 10.0, 700.0, 5.0, 10.0),
    ]
    found = layout.line_rows(read(spark, rows), "n").collect()
    assert [(r["doc_id"], r["text"], r["y"], r["n"]) for r in found] == [(1, "a b c d", 701.0, 3)]


def test_words_of_oddly_spaced_lines_stand_where_they_are_drawn(spark):
    pages = paginate(spark.createDataFrame([(1, "one two\nthree  four \u00a0five")], "doc_id long, text string"))
    found = word_rows(pages).orderBy("seq").select("str", F.round("x", 3).alias("x"), "seq").collect()
    advance = 11.0 * 0.6
    places = [("one", 0, 0), ("two", 4, 1), ("three", 0, 1000), ("four", 7, 1001), ("five", 13, 1002)]
    assert [tuple(r) for r in found] == [(s, round(36.0 + at * advance, 3), seq) for s, at, seq in places]


def test_lines_and_paragraphs_of_pages_are_not_shuffled_again(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("layout_lines", "layout_blocks", "layout_slides", "layout_page_text", "layout_spaced_text"):
        plan = QUERIES[name](spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") <= 1 and "Window" not in plan, name  # the documents are spread, nothing more
    plan = QUERIES["table_cells"](spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan


def test_sections_of_pages_are_made_inside_the_row(spark):
    plan = QUERIES["html_sink"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") <= 1


def test_paragraphs_and_table_rows_read_the_lines_once(spark):
    plan = QUERIES["word_paragraphs"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
