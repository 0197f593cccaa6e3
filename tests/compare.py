"""Compare registered queries with their SQL: python tests/compare.py [folder] [name ...]"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from read_parquet('{folder}/{name}.parquet')")
    return con


def _cell(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(_cell(v) for v in x)
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def difference(spark, con, folder: str, job, sql: str) -> str | None:
    """None if both give the same rows, else what differs."""
    df = job(spark, folder)
    names, mine = _rows(df.columns, df.collect())
    cursor = con.execute(sql)
    wanted_names, wanted = _rows([d[0] for d in cursor.description], cursor.fetchall())
    if names != wanted_names:
        return f"columns {names} and {wanted_names}"
    if len(mine) != len(wanted):
        left, right = set(mine), set(wanted)
        return f"{len(mine)} rows and {len(wanted)}; only here {list(left - right)[:3]}; only in SQL {list(right - left)[:3]}"
    for a, b in zip(mine, wanted):
        if a != b:
            both = [(x, y) for x, y in zip(mine, wanted) if x != y]
            return f"{len(both)} rows differ, first {both[0]}"
        if [type(x) for x in a] != [type(x) for x in b]:
            return f"types {[type(x) for x in a]} and {[type(x) for x in b]} for {names}"
    return None


def main() -> int:
    from logweir.plans import all_queries
    from logweir.session import build_session

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.001"
    spark = build_session("compare", "local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name, q in all_queries().items():
        if args and not any(name.startswith(a) for a in args):
            continue
        start = time.time()
        try:
            found = difference(spark, con, folder, q.job, q.sql) if q.sql else f"rows only: {q.job(spark, folder).count()}"
        except Exception as err:  # noqa: BLE001
            found = f"{type(err).__name__}: {str(err)[:600]}"
        ok = found is None or found.startswith("rows only")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - start:.1f}s {found or ''}"[:1500], flush=True)
    print("bad", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
