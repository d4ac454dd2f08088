"""Compare registered queries with their SQL: python -m tests.compare [folder] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return f"{float(v):.6f}"
    return str(v)


def table(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def sql_rows(folder, sql):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    cur = con.execute(sql)
    return table(cur.fetchall(), [d[0] for d in cur.description])


def main(folder, only):
    import __spark_entry__ as entry
    from lekhya.session import get_session
    spark = get_session(master="local[8]", **{"spark.sql.shuffle.partitions": "8",
                                              "spark.driver.memory": "12g",
                                              "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls, bad = entry.oracle_sql(), []
    for name, fn in entry.queries().items():
        if only and name not in only:
            continue
        t = time.time()
        try:
            df = fn(spark, folder)
            mine = table(df.collect(), df.columns)
            took = time.time() - t
            if name not in sqls:
                print(f"rows   {name}: {len(mine[1])} rows {took:.1f}s", flush=True)
                if only:
                    for r in mine[1][:6]:
                        print("      ", str(r)[:700])
                continue
            other = sql_rows(folder, sqls[name])
            ok = mine == other
            print(f"{'ok    ' if ok else 'DIFF  '} {name}: {len(mine[1])} vs {len(other[1])} rows "
                  f"{took:.1f}s", flush=True)
            if not ok:
                bad.append(name)
                print("   ", mine[0], other[0])
                a, b = set(mine[1]), set(other[1])
                print("    spark only", len(a - b), str(sorted(a - b)[:3])[:900])
                print("    sql only  ", len(b - a), str(sorted(b - a)[:3])[:900])
        except Exception as e:
            bad.append(name)
            print(f"ERROR  {name}: {str(e)[:1500]}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    args = sys.argv[1:]
    path = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    main(path, set(args))
