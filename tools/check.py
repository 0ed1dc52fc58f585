"""Run queries beside their SQL in DuckDB and report every difference.

    python tools/check.py [--sf 0.01] [--time] [name ...]
"""

from __future__ import annotations

import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402

from quire.plans import QUERIES, SQL  # noqa: E402
from quire.session import local_session  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def cell(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return repr(value)


def kind(spark_type: str) -> str:
    return {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN",
            "timestamp": "TIMESTAMP", "date": "DATE"}.get(spark_type, spark_type.upper())


def compare(spark, con, name: str, folder: str) -> tuple[bool, str]:
    began = time.time()
    frame = QUERIES[name](spark, folder)
    rows = frame.collect()
    took = time.time() - began
    if name not in SQL:
        return True, f"{name}: {len(rows)} rows, {took:.1f}s, no SQL"
    began = time.time()
    relation = con.sql(SQL[name])
    types = dict(zip(relation.columns, [str(t) for t in relation.types]))
    other = relation.fetchall()
    sql_took = time.time() - began
    names = sorted(frame.columns)
    notes = []
    if sorted(types) != names:
        return False, f"{name}: columns {names} / {sorted(types)}"
    for n, t in frame.dtypes:
        if kind(t) != types[n]:
            notes.append(f"type of {n}: {t} / {types[n]}")
    at = [frame.columns.index(n) for n in names]
    left = sorted(tuple(cell(r[i]) for i in at) for r in rows)
    order = [list(types).index(n) for n in names]
    right = sorted(tuple(cell(r[i]) for i in order) for r in other)
    same = left == right
    text = f"{name}: {len(left)}/{len(right)} rows, {took:.1f}s / {sql_took:.1f}s"
    if not same:
        only_left = sorted(set(left) - set(right))[:3]
        only_right = sorted(set(right) - set(left))[:3]
        text += f"\n   DIFFERS {names}\n   spark {only_left}\n   sql   {only_right}"
    if len(left) == 0:
        text += "  EMPTY"
    return same and not notes, "; ".join([text, *notes])


def main(argv: list[str]) -> int:
    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        del argv[at : at + 2]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session()
    con = duck(folder)
    wanted = []
    for a in argv or list(QUERIES):
        if a in QUERIES:
            wanted.append(a)
        else:  # a module name: every query it registers
            wanted += [n for n, f in QUERIES.items() if getattr(f, "module", "") == a]
    bad = 0
    for name in wanted:
        try:
            ok, text = compare(spark, con, name, folder)
        except Exception as error:  # report and go on
            ok, text = False, f"{name}: {type(error).__name__} {str(error)[:900]}"
        bad += not ok
        print("ok  " if ok else "BAD ", text, flush=True)
    print(f"{len(wanted) - bad} of {len(wanted)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
