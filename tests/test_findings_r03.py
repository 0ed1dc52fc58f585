"""Findings of round 3: inputs on which queries and their SQL differed, and steps that multiplied rows."""

import datetime
import os
import re
import sys

import pyarrow as pa
import pyarrow.parquet as pq

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import check  # noqa: E402


def folder_with(small, folder, **tables):
    """The smallest corpus with some of its tables replaced."""
    for name in check.TABLES:
        if name not in tables:
            os.symlink(f"{small}/{name}.parquet", folder / f"{name}.parquet")
    for name, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows, pq.read_schema(f"{small}/{name}.parquet")), folder / f"{name}.parquet")
    return str(folder)


def agrees(spark, folder, name):
    ok, text = check.compare(spark, check.duck(folder), name, folder)
    assert ok, text


def test_file_changes_at_the_same_time(spark, small, tmp_path):
    """events of one time, an own write among them; the first by id tells the facts."""
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    row = lambda i, user, h, kind, value: {"event_id": i, "ts": at(h), "user_id": user, "event_type": kind, "value": value, "props": "{}"}
    kinds = ("view", "error", "signup", "click")
    rows = [
        row(u * 1000 + k, u, (k // 3) * 3, kinds[(k * 7 + u) % 4], float((k * 37 + u * 11) % 90)) for u in range(40) for k in range(24)
    ]
    agrees(spark, folder_with(small, tmp_path, events=rows), "file_changes")


def test_redaction_phrases_with_other_blanks(spark, small, tmp_path):
    """a phrase with a line break between its words is found nowhere, as on any page."""
    benchmark = [
        {"item_id": 1, "text": "alpha beta gamma\ndelta epsilon"}, {"item_id": 2, "text": "beta gamma delta epsilon zeta"},
        {"item_id": 3, "text": " gamma delta"}, {"item_id": 4, "text": "alpha  beta gamma"},
    ]
    documents = [
        {"doc_id": 1, "text": "alpha beta gamma\ndelta epsilon zeta", "lang": "en", "source": "s", "n_chars": 35},
        {"doc_id": 2, "text": "alpha  beta gamma delta epsilon", "lang": "en", "source": "s", "n_chars": 31},
    ]
    agrees(spark, folder_with(small, tmp_path, benchmark=benchmark, documents=documents), "redaction_phrases")


def test_glyphs_stay_in_their_page(spark, small):
    """marks come to the page row, so neither the text under them nor the proof deals out glyphs by bands."""
    from quire.plans import QUERIES

    for name in ("marked_text", "left_under_marks"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert "band" not in plan, name


def test_marks_of_one_name_take_a_glyph_once(spark):
    """two rectangles of one mark over an item that runs backwards."""
    from quire.operators import redact

    pages = spark.sql("SELECT 1 AS doc_id, 1 AS page, array(named_struct('seq', 0, 'str', 'abcd', 'x', 40d, 'y', 0d, 'width', -40d, 'height', 10d)) AS items")
    marks = spark.sql("SELECT 'm' AS id, 1 AS doc_id, 1 AS page, x, -5d AS y, width, 20d AS height FROM VALUES (0d, 22d), (8d, 22d), (500d, 9d) AS t(x, width)")
    found = redact.marked_glyphs(pages, marks)
    assert sorted(r.glyph for r in found.collect()) == [1, 2, 3]


def test_reach_writes_each_round_once(spark, tmp_path, monkeypatch):
    """a chain walked both ways; a node is written once and the edges once, however many rounds."""
    from quire.operators import trees

    steps = []
    cut = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: steps.append(cut(df)) or steps[-1])
    pairs = [(n, n + 1) for n in range(8)]
    edges = spark.createDataFrame([(1, a, b) for p in pairs for a, b in (p, p[::-1])] + [(2, 5, 6), (2, 6, 5)], "doc_id int, source int, target int")
    seeds = spark.createDataFrame([(1, 3), (1, 4)], "doc_id int, node int")
    found = sorted(tuple(r) for r in trees.reachable(seeds, edges, ["doc_id"], both_ways=True).collect())
    assert found == [(1, n) for n in range(9)]
    assert sum(s.count() for s in steps) == 9 + 18
    assert sorted(tuple(r) for r in trees.reachable(seeds, edges, ["doc_id"], most=1).collect()) == [(1, n) for n in (2, 3, 4, 5)]


def test_lines_of_no_document_are_counted_before_and_after(spark, small, tmp_path):
    """before and after are one count, so what no decision can reach stays; a document's choices are one row."""
    rows = pq.read_table(f"{small}/lineitem.parquet").slice(0, 400).to_pylist()
    rows = [r | {"l_orderkey": None if n % 3 == 0 else r["l_orderkey"]} for n, r in enumerate(rows)]
    folder = folder_with(small, tmp_path, lineitem=rows)
    agrees(spark, folder, "sanitized_tables")


def test_what_is_left_over_meets_one_row_a_document(spark):
    """the proof meets a document's choices as one number, and a category refused once is not asked for."""
    from quire.operators import sanitize

    tables = {"thumbnails": spark.sql("SELECT * FROM VALUES (1, 1, 7), (2, 1, 7), (3, 1, 7) AS t(doc_id, ord, page)")}
    decisions = spark.sql("SELECT * FROM VALUES (1, 'thumbnails', 5), (2, 'thumbnails', 5), (2, 'thumbnails', 4), (3, 'metadata', 5) AS t(doc_id, category, revision)")
    _, refused = sanitize.sanitize(tables, decisions, spark.sql("SELECT * FROM VALUES (1, 5), (2, 5), (3, 5) AS t(doc_id, revision)"))
    left = sanitize.left_over(tables, decisions, refused)
    assert [tuple(r) for r in left.collect()] == [(1, "thumbnails", 1, "page 7")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"category#\d+ = category#", plan)


def test_recognised_words_over_batches_without_a_shuffle(spark, small):
    """a page longer than a batch keeps its lines, text and mean, and nothing is dealt out again."""
    from quire.plans import QUERIES
    from quire.sources import ocr

    rows = [(d, n, f"5\t1\t1\t1\t{n // 3}\t{n}\t{'x' if n % 7 == 5 else n}\t+2.\t.5\t0x1F\t{n % 4 - 1}\tw{n}") for d in (1, 2) for n in range(25)]
    frame = spark.createDataFrame([(d, 1, d, *r) for d, *r in rows], "doc_id int, page int, page_row long, ord int, row string").coalesce(1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("4", "1000"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            words = ocr.words(frame)
            found, pages = words.orderBy("doc_id", "seq").collect(), ocr.page_texts(words).orderBy("doc_id").collect()
            spread_out = ocr.words(frame.drop("page_row").repartition(3)).orderBy("doc_id", "seq").collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        kept = [n for n in range(25) if n % 7 != 5]
        assert [(r.doc_id, r.seq, r.line, r.left, r.top, r.width, r.height) for r in found] == [(d, n, n // 3, n, 2, 1, 31) for d in (1, 2) for n in kept]
        assert [(r.doc_id, r.seq, r.line) for r in spread_out] == [(r.doc_id, r.seq, r.line) for r in found]
        sure = [n % 4 - 1 for n in kept if n % 4]
        lines = "\n".join(" ".join(f"w{n}" for n in kept if n // 3 == at) for at in range(9))
        assert [(r.text, r.confidence) for r in pages] == [(lines, int(sum(sure) / len(sure) * 10 + 0.5) / 10)] * 2
    for name in ("ocr_words", "ocr_pages", "ocr_placed"):
        plan = QUERIES[name](spark, small)._jdf.queryExecution().optimizedPlan().toString()
        assert not any(step in plan for step in ("Window", "Aggregate", "Join")), name


def test_least_runs_are_hashed_once(spark, small, tmp_path, monkeypatch):
    """Short, empty and missing texts, and repeated runs; no hash of a run is left to the plan's filters."""
    from quire.plans import compare

    texts = ["a b c d e f", "a b c d e f", "a b c d e  f", "a b", "a b", "", "", None, "x " * 30, "x " * 30 + "y", " ".join(map(str, range(40))), " ".join(map(str, range(41)))]
    rows = [{"doc_id": n + 1, "text": t, "lang": "en", "source": "s", "n_chars": len(t or "")} for n, t in enumerate(texts)]
    folder = folder_with(small, tmp_path, documents=rows)
    agrees(spark, folder, "page_pairs")
    plans = []
    cut = compare.cut_lineage
    monkeypatch.setattr(compare, "cut_lineage", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or cut(df))
    compare.revision_pairs(spark, folder)
    assert plans and not any("md5" in plan for plan in plans)


def test_outline_entries_take_little_and_leave_in_pieces():
    """a leaf is its title alone, and what a fold tells at its end is not gathered."""
    from quire.operators.editlog import OutlineEdits

    edit = lambda ord, kind, path, parent, index, title, expected=None: {
        "ord": ord, "kind": kind, "path": path, "parent": parent, "index": index, "title": title, "expected": expected
    }
    state = OutlineEdits()
    for n in range(4):
        assert state.step(edit(n, "open", None, "", None, f"t{n}")) == []
    assert state.top == ["t0", "t1", "t2", "t3"]
    assert state.step(edit(5, "addBookmark", None, "1", 0, "kid")) == []
    assert state.step(edit(6, "updateBookmark", "1", None, None, "new", "t1")) == []
    assert state.step(edit(7, "moveBookmark", "0", "1", 1, None, "t0")) == []
    assert state.step(edit(8, "deleteBookmark", "2", None, None, None, "gone"))[0][2] == 8
    told = state.finish()
    assert not isinstance(told, list)
    assert [r[:2] for r in told] == [("0", "new"), ("0.0", "kid"), ("0.1", "t0"), ("1", "t2"), ("2", "t3")]
    deep = OutlineEdits()
    for n in range(3000):
        deep.step(edit(n, "open", None, ".".join(["0"] * n), None, "t"))
    assert sum(1 for _ in deep.finish()) == 3000


def test_only_glyphs_near_a_mark_are_measured(spark):
    """pieces and glyphs as the rule has them for each glyph; an unknown mark takes nothing and no page row is sorted."""
    import random

    from quire.operators import redact

    luck = random.Random(19)
    items = [(s, "abcdefghijklmnopqrstuvwxyz"[: luck.randint(1, 26)], luck.choice([0.0, 40.0, 1e15, luck.uniform(-50, 300)]), luck.uniform(0, 60), luck.choice([0.0, -90.0, 1e-9, luck.uniform(1, 200)]), luck.choice([10.0, 0.0, -8.0])) for s in range(300)]
    marks = [(luck.choice([40.0, 1e15, luck.uniform(-50, 300)]), luck.uniform(-5, 60), luck.choice([0.5, 3.0, 80.0, 2e9]), luck.choice([1.0, 12.0, 40.0])) for _ in range(6)]

    def takes(item, i, mark):
        _, text, x, y, width, height = item
        w, h = width / len(text), height * (redact.ASCENT - redact.DESCENT)
        x, y = x + i * w, y + height * redact.DESCENT
        mx, my, mw, mh = mark
        across, up = min(x + w, mx + mw) - max(x, mx), min(y + h, my + mh) - max(y, my)
        area = max(0.0, w) * max(0.0, h)
        middle = mx <= x + w / 2 <= mx + mw and my <= y + h / 2 <= my + mh
        return middle or (area > 0 and (across * up if across > 0 and up > 0 else 0.0) / area >= 0.3)

    left, under = [], []
    for item in items:
        gone = [[n for n, mark in enumerate(marks) if takes(item, i, mark)] for i in range(len(item[1]))]
        under += [(str(n), item[0], i, item[1][i]) for i, ns in enumerate(gone) for n in ns]
        pieces = "".join("\n" if ns else c for c, ns in zip(item[1], gone)).split("\n")
        left += [(item[0], n, p) for n, p in enumerate(p for p in pieces if p)]
    shape = "doc_id int, page int, items array<struct<seq:int,str:string,x:double,y:double,width:double,height:double>>"
    pages = spark.createDataFrame([(1, 1, items)], shape)
    rows = [(str(n), 1, 1, *mark) for n, mark in enumerate(marks)] + [("none", 1, 1, None, 0.0, 9.0, 9.0)]
    marked = spark.createDataFrame(rows, "id string, doc_id int, page int, x double, y double, width double, height double")
    assert sorted((r.seq, r.piece, r.str) for r in redact.redacted_items(pages, marked).collect()) == left
    assert sorted((r.id, r.run, r.glyph, r.ch) for r in redact.marked_glyphs(pages, marked).collect()) == sorted(under)
    assert len(under) > 100 and any(piece for _, piece, _ in left)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = redact.redacted_items(pages, marked)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" in plan


def test_entries_that_have_arrived_are_written_once(spark, monkeypatch):
    """damaged outlines as walked one link at a time; short lists are not written again in the rounds of a long one."""
    import random

    from quire.operators import trees

    luck = random.Random(20)
    some = lambda n: luck.choice([None, *range(n + 3)])
    docs = {d: {n: (some(60), some(60), luck.random() < 0.1) for n in range(60)} for d in range(6)}
    docs |= {9: {n: (None, (n + 1) % 5, False) for n in range(5)}, 10: {0: (1, None, True), 1: (2, 3, None), 2: (1, None, False), 3: (None, 0, False)}}
    expected = []
    for d, nodes in docs.items():
        roots, parent, before = {n for n in nodes if nodes[n][2]}, {}, {}
        for n in sorted(nodes):
            parent.setdefault(nodes[n][0], n)
        for n in sorted(nodes):
            if nodes[n][1] not in roots and nodes[n][1] not in parent:
                before.setdefault(nodes[n][1], n)
        for n in nodes:
            at, order, steps = n, [0], 0
            while steps < 1000 and (at in before or at not in roots and at in parent):
                steps += 1
                if at in before:
                    at, order[0] = before[at], order[0] + 1
                else:
                    at, order = parent[at], [0, *order]
            if at in roots and steps < 1000:
                head = n
                while head in before:
                    head = before[head]
                expected.append((d, n, None if head in roots else parent[head], len(order), ".".join(map(str, order))))
    rows = [(d, n, *links) for d, nodes in docs.items() for n, links in nodes.items()]
    shape = "k int, node long, first long, next long, is_root boolean"
    found = trees.outline_rows(spark.createDataFrame(rows, shape), ["k"]).drop("order").collect()
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)
    assert len({level for *_, level, _ in expected}) > 2

    steps = []
    cut = trees.cut_lineage
    monkeypatch.setattr(trees, "cut_lineage", lambda df: steps.append(cut(df)) or steps[-1])
    monkeypatch.setattr(trees, "discard", lambda step: None)
    short = [(k, n, None, n + 1 if n < 3 else None, n == 0) for k in range(500) for n in range(4)]
    long = [(1000, n, None, n + 1 if n < 199 else None, n == 0) for n in range(200)]
    found = trees.outline_rows(spark.createDataFrame(short + long, shape), ["k"]).collect()
    assert sorted((r.k, r.node, r.path) for r in found) == [(k, n, str(n)) for k, n, *_ in short + long]
    assert sum(step.count() for step in steps) < 4 * len(short + long)
