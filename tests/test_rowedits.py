"""Edits of rows by their literal outcome; ties, trees and tables that lose hidden information."""

import random


from quire.operators import redact, rowedits, sanitize, trees

LINK = "doc_id long, page int, link string, ord long, kind string, x double, y double, width double, height double, target_page long, url string"


def test_links_are_refused_revived_and_put_last(spark):
    links = spark.createDataFrame(
        [(1, 1, "a", 1, None, 1.0, 1.0, 5.0, 5.0, 2, None), (1, 1, "b", 2, None, 2.0, 1.0, 5.0, 5.0, None, "https://b.org")], LINK
    ).drop("kind")
    log = spark.createDataFrame(
        [
            (1, 1, "a", 1, "update", None, None, None, None, None, "https://new.org/x"), (1, 1, "b", 2, "delete", None, None, None, None, None, None),
            (1, 1, "b", 3, "update", 9.0, None, None, None, None, None), (1, 1, "b", 4, "add", 3.0, 3.0, 1.0, 1.0, 99, None),
            (1, 1, "a", 5, "add", 0.0, 0.0, 1.0, 1.0, 1, None), (1, 4, "c", 6, "add", 0.0, 0.0, 1.0, 1.0, 1, None),
            (1, 2, "c", 7, "add", 0.0, 0.0, 1.0, 1.0, None, "javascript:x"), (1, 2, "c", 8, "delete", None, None, None, None, None, None),
        ], LINK,
    )
    pages = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    after, refused = rowedits.link_edits(links, log, pages)
    got = [(r.link, r.place, r.x, r.target_page, r.url) for r in after.orderBy("page", "place").collect()]
    assert got == [("a", 1, 1.0, None, "https://new.org/x"), ("b", 2, 3.0, 3, None)]
    assert {(r.ord, r.error) for r in refused.collect()} == {
        (3, rowedits.GONE_LINK), (5, "That link is already on the page."), (6, rowedits.GONE_PAGE), (7, rowedits.LINK_TARGET), (8, rowedits.GONE_LINK)
    }


def test_field_names_are_free_again_after_a_deletion(spark):
    schema = "doc_id long, name string, ord long, kind string, page long, type string"
    fields = spark.createDataFrame([(1, "f", 1, None, 1, "text")], schema).drop("kind")
    log = spark.createDataFrame(
        [
            (1, "f", 1, "add", 1, "check"), (1, "f", 2, "delete", None, None), (1, "f", 3, "update", None, "x"), (1, "f", 4, "add", 2, "check"),
            (1, "f", 5, "update", None, "radio"), (1, "g", 6, "delete", None, None), (1, "h", 7, "add", 3, "text"),
        ], schema,
    )
    after, refused = rowedits.field_edits(fields, log, spark.createDataFrame([(1, 2)], "doc_id long, page_count int"), ["type"])
    assert [(r.name, r.page, r.type) for r in after.collect()] == [("f", 2, "radio")]
    assert {(r.ord, r.error) for r in refused.collect()} == {(1, rowedits.NAME_TAKEN), (3, rowedits.GONE_FIELD), (7, rowedits.GONE_PAGE)}


def test_text_edits_repair_every_offset(spark):
    rng = random.Random(3)
    items, texts = [], {}
    for doc in range(4):
        at = 0
        for seq in range(6):
            text = "x" * rng.randrange(0, 9)
            items.append((doc, 1, seq, text, 10.0, 700.0 - 14 * seq, 6.6 * len(text), 11.0, at))
            texts[doc, seq] = text
            at += len(text) + 1
    frame = spark.createDataFrame(items, "doc_id long, page int, seq int, str string, x double, y double, width double, height double, offset long")
    log = [(0, 1, 2, 1, "editText", "longer text", None, None), (0, 1, 2, 2, "editText", "short", None, None), (1, 1, 0, 1, "replaceText", "over", None, None),
           (1, 1, 0, 2, "editText", "late", None, None), (2, 1, None, 1, "addText", "one", 1.0, 2.0), (2, 1, None, 2, "addText", "two", 1.0, 3.0), (3, 1, 1, 1, "editText", "日", None, None)]
    changes = spark.createDataFrame(log, "doc_id long, page int, seq int, ord int, kind string, text string, x double, y double")
    after, refused = rowedits.text_edits(frame, changes)
    got = {}
    for r in after.orderBy("doc_id", "seq").collect():
        got.setdefault(r.doc_id, []).append((r.str, r.offset))
    texts[0, 2], texts[1, 0] = "short", ""
    for doc, more in ((0, []), (1, ["over"]), (2, ["one", "two"]), (3, [])):
        strings = [texts[doc, s] for s in range(6)] + more
        assert got[doc] == [(t, sum(len(u) + 1 for u in strings[:n])) for n, t in enumerate(strings)]
    assert {(r.doc_id, r.ord) for r in refused.collect()} == {(1, 2), (3, 1)}


def test_tagged_blocks_go_with_what_they_hold(spark):
    def left(*ops):
        rows = [(1, 1, n, o.split(":")[0], o.partition(":")[2] or None) for n, o in enumerate(ops)]
        frame = spark.createDataFrame(rows, "doc_id long, page int, seq long, operator string, tag string")
        return [r.seq for r in rowedits.without_tagged(frame, ["H"]).orderBy("seq").collect()]

    assert left("Tj", "BDC:H", "Tj", "BMC:S", "Tj", "EMC", "EMC", "Tj") == [0, 7]
    assert left("BMC:S", "BDC:H", "EMC", "EMC", "EMC", "Tj") == [0, 3, 4, 5]
    assert left("BDC:H", "BDC:H", "EMC", "Tj") == [0, 1, 2, 3]  # the outer one never ends
    assert left("BDC:H", "EMC", "BDC:H", "BDC:S", "EMC", "Tj") == [2, 3, 4, 5]


def test_ties_go_in_chains_and_over_pages(spark):
    hits = spark.createDataFrame([(1, 10), (2, 10)], "doc_id long, object long")
    links = spark.createDataFrame([(1, 10, 11), (1, 12, 11), (1, 12, 13), (1, 20, 21), (2, 99, 98)], "doc_id long, object long, other long")
    widgets = spark.createDataFrame([(1, 13, "f"), (1, 14, "f"), (1, 15, "f"), (1, 16, "g"), (2, 14, "f")], "doc_id long, object long, field string")
    got = {(r.doc_id, r.object): r.by for r in redact.closed_under_marks(hits, links, widgets).collect()}
    assert got == {(1, 10): "mark", (2, 10): "mark", **{(1, n): "tie" for n in (11, 12, 13, 14, 15)}}


def test_plans_say_why_a_page_becomes_a_picture(spark):
    marks = spark.createDataFrame([(1, 1, "m"), (1, 2, "n"), (1, 9, "o")], "doc_id long, page int, mark string")
    pages = spark.createDataFrame([(1, 3)], "doc_id long, page_count int")
    found = [(1, 1, 5, "group"), (1, 1, 4, "picture"), (1, 1, 7, "uncut"), (1, 1, 9, "group"), (1, 1, 8, "unreadable"), (1, 3, 1, "inline")]
    plan = redact.plan_pages(marks, pages, spark.createDataFrame(found, "doc_id long, page int, ord long, reason string"))
    assert {(r.page, r["mode"], tuple(r.reasons)) for r in plan.collect()} == {(1, "raster", ("unreadable", "uncut", "picture", "group")), (2, "native", ())}


def test_names_are_found_in_trees_that_lead_back(spark):
    nodes = spark.createDataFrame(
        [(1, "r", None, None, None), (1, "a", "r", "a", "c"), (1, "b", "r", "d", "f"), (1, "r", "a", None, None), (1, "x", "x", None, None)],
        "doc_id long, node string, parent string, low string, high string",
    )
    entries = spark.createDataFrame([(1, "a", "b", 1), (1, "b", "d", 2), (1, "x", "e", 3), (1, "r", "b", 9)], "doc_id long, node string, name string, value long")
    wanted = spark.createDataFrame([(1, n) for n in "bdez"], "doc_id long, name string")
    got = {r.name: (r.value, r.steps) for r in trees.names_found(nodes, entries, wanted, ["doc_id"]).collect()}
    assert got == {"b": (9, 0), "d": (2, 1)}
    assert sorted(r.value for r in trees.names_of(nodes, entries, ["doc_id"]).collect()) == [1, 2, 9]


def test_chosen_categories_leave_every_table(spark):
    tables = {
        "actions": spark.createDataFrame([(1, 1, "JavaScript", "p"), (1, 2, "Launch", "p"), (1, 3, "GoTo", "p"), (2, 1, "JavaScript", "p")], "doc_id long, ord long, type string, place string"),
        "fields": spark.createDataFrame([(1, 1, "f", "v", None, "On"), (2, 1, "f", "v", "d", "On")], "doc_id long, ord long, name string, value string, default_value string, state string"),
        "annotations": spark.createDataFrame([(1, 1, 7, 2), (1, 2, 8, 4)], "doc_id long, ord long, id long, flags int"),
    }
    decisions = spark.createDataFrame(
        [(1, "documentJavaScript", 3), (1, "formData", 3), (1, "hiddenAnnotations", 2), (2, "formData", 1)], "doc_id long, category string, revision int"
    )
    revisions = spark.createDataFrame([(1, 3), (2, 1), (2, 0)], "doc_id long, revision int")
    after, refused = sanitize.sanitize(tables, decisions, revisions)
    assert {(r.doc_id, r.type) for r in after["actions"].collect()} == {(1, "Launch"), (1, "GoTo"), (2, "JavaScript")}
    assert {tuple(r)[2:] for r in after["fields"].collect()} == {("f", None, None, "Off")}
    assert after["annotations"].count() == 2 and [(r.doc_id, r.category) for r in refused.collect()] == [(1, "hiddenAnnotations")]
    assert sanitize.left_over(after, decisions, refused).count() == 0
    assert {(r.doc_id, r.category) for r in sanitize.findings(after).collect()} == {(1, "launchActions"), (2, "documentJavaScript"), (1, "hiddenAnnotations")}


def test_places_in_any_order_and_inherited_values(spark):
    from quire.operators.scale import placed_in_order

    rng = random.Random(8)
    rows = [(n % 3, rng.randrange(40), n) for n in range(400)]
    placed = placed_in_order(spark.createDataFrame(rows, "k long, v long, n long"), ["k"], ["v", "n"], "place").collect()
    for k in range(3):
        mine = sorted((r.v, r.n) for r in placed if r.k == k)
        assert [(r.v, r.n) for r in sorted((r for r in placed if r.k == k), key=lambda r: r.place)] == mine
        assert sorted(r.place for r in placed if r.k == k) == list(range(1, len(mine) + 1))
    chain = [(1, n, n - 1 if n else None, 5 if n == 0 else 70 if n == 50 else None) for n in range(100)] + [(1, 200, 201, None), (1, 201, 200, None)]
    got = {r.node: r.value for r in trees.inherited(spark.createDataFrame(chain, "k int, node long, parent long, page long"), ["k"], "page").collect()}
    assert all(got[n] == (5 if n < 50 else 70) for n in range(100)) and got[200] is None
