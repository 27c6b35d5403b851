"""Run registered queries beside their DuckDB statements and report differences.

    python -m tests.compare [--sf DIR] [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import math
import sys
import threading
import time
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        if math.isnan(x):
            return None
        return round(x, 6) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a message."""
    df = fn(spark, sf_dir)
    left = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    right = rows_of(rel.columns, rel.fetchall())
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        a, b = left[1] - right[1], right[1] - left[1]
        return (
            f"rows {sum(left[1].values())} vs {sum(right[1].values())}; only spark {sum(a.values())}: {list(a)[:2]}; "
            f"only duckdb {sum(b.values())}: {list(b)[:2]}"
        )
    if not left[1]:
        return "no rows"
    return None


_seen = []


def started(name, argv):
    """True from the query named after --from onwards."""
    if name == argv[1]:
        _seen.append(name)
    return bool(_seen)


def main(argv):
    from tests.conftest import make_session

    sf_dir = "/root/testdata/sf0.01"
    if argv[:1] == ["--sf"]:
        sf_dir, argv = argv[1], argv[2:]
    import __spark_entry__ as entry

    spark, con = make_session(), connect(sf_dir)
    sqls = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        wanted = started(name, argv) if argv[:1] == ["--from"] else not argv or name in argv
        if not wanted:
            continue
        t = time.time()
        watch = threading.Timer(60, spark.sparkContext.cancelAllJobs)
        watch.start()
        try:
            if name in sqls:
                msg = compare(spark, con, name, fn, sqls[name], sf_dir)
            else:
                msg = None if fn(spark, sf_dir).count() else "no rows"
        except Exception as exc:  # noqa: BLE001
            msg = f"{type(exc).__name__}: {str(exc)[:700]}"
        watch.cancel()
        bad += msg is not None
        print(f"{'ok  ' if msg is None else 'FAIL'} {name} {time.time() - t:.1f}s {msg or ''}", flush=True)
    print("failures:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
