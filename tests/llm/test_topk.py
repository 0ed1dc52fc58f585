import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.llm import topk
from quire.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, label int, vector string, width int"


def brute(x, ids, q, names, k):
    out = {}
    for n, w in zip(names, q):
        scores = sorted((-int(v @ w), int(i)) for i, v in zip(ids, x) if i != n)[:k]
        out[int(n)] = [(i, -s) for s, i in scores]
    return out


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 300), st.integers(1, 6), st.integers(1, 9), st.integers(0, 2**32 - 1), st.sampled_from([1, 3, 200, 1 << 26]))
def test_blocks_are_exact_with_ties(n, width, m, seed, spread):
    rng = np.random.default_rng(seed)
    x, q = rng.integers(-spread, spread + 1, (n, width)), rng.integers(-spread, spread + 1, (m, width))
    ids = rng.permutation(n)
    names = np.arange(m)
    got = {}
    for a, b, s in topk.search_block(x, ids, q, names, 5):
        got.setdefault(a, []).append((b, s))
    expected = brute(x, ids, q, names, 5)
    assert got == {k: v for k, v in expected.items() if v}


def test_reading_stops_early_on_clustered_vectors():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 32))
    x = np.floor(256 * (centres[rng.integers(40, size=2000)] + 0.05 * rng.normal(size=(2000, 32)))).astype(np.int64)
    lists = topk.SortedLists(x.astype(float), np.arange(2000))
    seen, unseen, top, bottom = lists.read(1000)
    assert unseen.sum() == 2 * 32 * 1000  # half of each list from each end was read
    got = topk.search_block(x, np.arange(2000), x[:20], np.arange(20), 5)
    expected = brute(x, np.arange(2000), x[:20], np.arange(20), 5)
    assert {a: [(b, s) for c, b, s in got if c == a] for a in range(20)} == expected


def test_query_over_many_blocks(spark, small):
    rows = QUERIES["op3_no_random_access_topk"](spark, small).collect()
    table = spark.read.parquet(f"{small}/embeddings.parquet")
    small_blocks = topk.top_k(table, block=64, query_block=2).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, small_blocks))
    data = table.toPandas()
    x = np.floor(256 * np.stack(data["embedding"]).astype(np.float64)).astype(np.int64)
    ids = data["vec_id"].to_numpy()
    expected = brute(x, ids, x[ids % 50 == 0], ids[ids % 50 == 0], 5)
    assert {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows} == {
        (q, n + 1, i, s) for q, best in expected.items() for n, (i, s) in enumerate(best)
    }


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.0], 1, "v", 9), (1, [0.5, 0.5], 1, "v", 9), (2, [0.5, 0.5], 1, "v", 9), (3, None, 1, "v", 9),
        (4, [nan, 1.0], 1, "v", 9), (5, [inf, 1.0], 1, "v", 9), (6, [None, 1.0], 1, "v", 9), (None, [1.0, 1.0], 1, "v", 9),
        (7, [], 1, "v", 9), (8, [1.0, 1.0, 1.0], 1, "v", 9), (1, [0.5, 0.5], 1, "v", 9), (50, [9.0], 1, "v", 9), (9, [-0.001, 0.0], 1, "v", 9),
    ]
    out = topk.top_k(spark.createDataFrame(rows, SCHEMA)).collect()
    # The id 1 is there twice: every row is a candidate.
    assert sorted(map(tuple, out)) == [(0, 1, 1, 32768), (0, 2, 1, 32768), (0, 3, 2, 32768), (0, 4, 9, -256)]
    assert topk.top_k(spark.createDataFrame([], SCHEMA)).count() == 0


def test_rows_that_share_an_id_agree_with_the_sql(spark, tmp_path):
    import duckdb

    from quire.llm.queries import SQL

    rng = np.random.default_rng(3)
    rows = [(int(i), [float(v) for v in rng.integers(-4, 5, 6) / 4]) for i in [*range(120), *[7] * 40, 50, 50, 100]]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op3_no_random_access_topk"](spark, str(tmp_path)).collect()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert sorted(map(tuple, got)) == sorted(con.execute(SQL["op3_no_random_access_topk"]).fetchall())
    assert any(r["vec_id"] == 7 for r in got)
