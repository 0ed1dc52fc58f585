"""Edit scripts are replayed; their length is checked against a slow exact count."""

import random

import numpy as np
from pyspark.sql import functions as F

from quire.operators import compare, editlog
from quire.operators.sessions import RevisionLog


def numbered(a, b):
    seen = {}
    return (np.array([seen.setdefault(w, len(seen)) for w in side], dtype=np.int64) for side in (a, b))


def fewest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            table[i][j] = table[i - 1][j - 1] + 1 if x == y else max(table[i - 1][j], table[i][j - 1])
    return len(a) + len(b) - 2 * table[-1][-1]


def edits(a, b):
    """The runs of change, replayed; how many words they take away and add."""
    one, two = numbered(a, b)
    runs = compare._change_runs(compare._kept_runs(one, two), len(a), len(b))
    rebuilt, at = [], 0
    for run in runs:
        rebuilt += a[at : run["before_at"]] + b[run["after_at"] : run["after_at"] + run["after_n"]]
        at = run["before_at"] + run["before_n"]
    assert rebuilt + a[at:] == b
    return sum(r["before_n"] + r["after_n"] for r in runs)


def test_changes_are_fewest_and_replay():
    rng = random.Random(3)
    for letters in ("abcd", "abc", "ab"):
        for _ in range(200):
            a = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
            b = [rng.choice(letters) for _ in range(rng.randint(0, 14))]
            assert edits(a, b) == fewest(a, b)


def test_known_changes():
    a, b = "the quick brown fox jumps".split(), "the slow brown fox leaps high".split()
    assert edits(a, b) == 5
    assert edits(list("abcabba"), list("cbabac")) == 5


def test_a_limit_of_edits_is_asked_for():
    assert compare._kept_runs(np.arange(800), np.arange(800, 1600), most=1500) is None
    assert compare._kept_runs(np.arange(700), np.arange(700, 1400), most=1500) == []
    assert compare._kept_runs(np.arange(2000), np.arange(2000, 4000)) == []


def words(*texts):
    return [(t, 72.0 + 40 * i, 700.0, 30.0, 12.0) for i, t in enumerate(texts)]


def test_changes_between_versions(spark):
    frame = spark.createDataFrame(
        [(1, 1, words(*"Payment is due within 30 days of delivery".split()), words(*"Payment is due within 45 days of the delivery".split()))],
        f"pair_id long, index int, before array<{compare.WORD}>, after array<{compare.WORD}>",
    )
    got = compare.text_changes(frame).orderBy("change").collect()
    assert [(r.kind, [w.text for w in r.before], [w.text for w in r.after]) for r in got] == [
        ("changed", ["30"], ["45"]), ("added", [], ["the"]),
    ]


def test_page_pairs_keep_gaps(spark):
    pairs = spark.createDataFrame([(1, 10, 20, 3), (2, 10, 20, -1)], "pair_id int, original int, revised int, offset int")
    counts = spark.createDataFrame([(10, 1), (20, 1)], "doc_id int, page_count int")
    got = {(r.pair_id, r["index"]): (r.original_page, r.revised_page) for r in compare.page_pairs(pairs, counts).collect()}
    assert [got[1, i] for i in range(1, 5)] == [(None, 1), (None, None), (None, None), (1, None)]
    assert [got[2, i] for i in (1, 2)] == [(1, None), (None, 1)]


def test_pixel_regions(spark):
    def picture(marked):
        rows = [(1, x, y, 0 if (x, y) in marked else 255, 0 if (x, y) in marked else 255, 255) for x in range(80) for y in range(16)]
        return spark.createDataFrame(rows, "pair_id long, x int, y int, r int, g int, b int")

    marked = {(x, y) for x in (1, 2, 3) for y in (1, 2)} | {(x, y) for x in (70, 71, 72) for y in (9, 10)}
    cells = compare.pixel_cells(picture(set()), picture(marked))
    sizes = spark.createDataFrame([(1, 80, 16)], "pair_id long, width long, height long")
    got = compare.pixel_regions(cells, sizes).orderBy("region").collect()
    assert [(r.left, r.top, r.width, r.height) for r in got] == [(0, 0, 8, 8), (64, 8, 8, 8)]


def test_regions_explained_by_text_go(spark):
    regions = spark.createDataFrame(
        [(1, 1, 0, "a", 0.0, 0.0, 10.0, 10.0), (1, 1, 0, "b", 50.0, 50.0, 5.0, 5.0), (1, 1, 1, "a", 10.0, 0.0, 5.0, 5.0)],
        "pair_id int, index int, region int, side string, x double, y double, width double, height double",
    )
    explained = spark.createDataFrame([(1, 1, "b", 52.0, 52.0, 9.0, 9.0), (1, 1, "a", 0.0, 0.0, 0.0, 0.0)], "pair_id int, index int, side string, x double, y double, width double, height double")
    assert [r.region for r in compare.unexplained(regions, explained).collect()] == [1]


def test_page_edits_refuse_whole_transactions(spark):
    documents = spark.createDataFrame([(1, 4, 600.0, 800.0)], "doc_id long, page_count int, width double, height double")
    log = spark.createDataFrame(
        [
            (1, 1, 0, "deletePages", [2], None, None, None), (1, 1, 1, "rotatePages", [2], 90, None, None),
            (1, 2, 0, "duplicatePages", [1], None, None, None), (1, 2, 1, "deletePages", [1, 2, 3, 4], None, None, None),
            (1, 3, 0, "movePages", [3], 0, None, None), (1, 3, 1, "insertBlankPages", [1], 1, None, None),
            (1, 4, 0, "cropPages", [9], None, 10.0, 10.0), (1, 5, 0, "cropPages", [1], None, 10.0, 9999.0),
        ],
        "doc_id long, txn long, op_index int, kind string, pages array<long>, number long, width double, height double",
    )
    got = editlog.page_edits(documents, log).collect()
    pages = sorted((r for r in got if r.error is None), key=lambda r: r.position)
    assert [(r.ref, r.rotation) for r in pages] == [(4, 0), (-1, 0), (1, 0), (3, 90)]
    assert (pages[0].crop_width, pages[0].crop_height) == (10.0, 800.0)
    assert {r.txn: r.error for r in got if r.error} == {2: editlog.LAST_PAGE, 4: editlog.NO_PAGE}


def test_outline_edits(spark):
    marks = spark.createDataFrame([(1, p, i, f"t{p}") for i, p in enumerate(("0", "0.0", "1", "2"))], "doc_id long, path string, order long, title string")
    log = spark.createDataFrame(
        [
            (1, 1, "moveBookmark", "0", "t0", None, 2, None), (1, 2, "moveBookmark", "1", "t0", "1.0", 0, None),
            (1, 3, "deleteBookmark", "0", "wrong", None, None, None), (1, 4, "addBookmark", None, None, "1", 0, " "),
        ],
        "doc_id long, ord long, kind string, path string, expected string, parent string, index long, title string",
    )
    got = editlog.outline_edits(marks, log).collect()
    assert {r.path: r.title for r in got if r.error is None} == {"0": "t1", "1": "t0", "1.0": "Untitled", "1.1": "t0.0", "2": "t2"}
    assert sum(r.error is not None for r in got) == 2


def test_revision_log_trims_but_keeps_numbers():
    log = RevisionLog(most=3, most_bytes=100)

    def do(event, size=10, target=0):
        return log.step({"seq": 0, "event": event, "size_bytes": size, "target": target})[0][1:]

    assert do("push") == (0, False, False)
    do("push"), do("push")
    assert do("undo") == (1, True, True)
    assert do("push") == (3, True, False)
    assert do("push") == (4, True, False) and len(log.entries) == 3
    assert do("goto", target=0) == (4, True, False)
    assert do("push", size=95)[0] == 5 and len(log.entries) == 1
    assert do("undo") == (5, False, False)
    for _ in range(20_000):
        do("push", size=1)
    assert len(log.entries) == 3 and log.entries[-1][0] == 20_005


def test_near_copies_pair_whatever_their_opening(spark, tmp_path):
    from quire.plans import compare as plans

    rng = random.Random(5)
    text = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    other = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    docs = [
        " ".join(text), " ".join(["changed", *text[1:]]), " ".join(other), " ".join(other[:6] + [w + "x" for w in text]), "alone", None, "",
        " ".join(text[:-1]), "alone", "a b c", "",
    ]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.revision_pairs(spark, str(tmp_path)).collect()
    assert {(r.pair_id, r.original, r.revised) for r in got} == {(1, 0, 1), (7, 0, 7), (8, 4, 8), (10, 6, 10)}


def test_outline_edits_reach_every_level(spark, small):
    from quire.plans import QUERIES

    got = QUERIES["outline_edits"](spark, small).collect()
    assert any(r.error is None and r.path.count(".") == 2 for r in got)
