"""Runs registered queries against their SQL in DuckDB. As a script: python -m tests.oracle [sf_dir] [name or prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return db


def plain(x):
    """Values that both engines write alike: numbers of equal worth, dates as text, floats to nine digits."""
    if x is None:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}") + 0.0
    if hasattr(x, "isoformat"):
        return x.isoformat()[:19].removesuffix("T00:00:00")
    if isinstance(x, list | tuple):
        return tuple(plain(v) for v in x)
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x)
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if hasattr(x, "as_integer_ratio"):
        return float(f"{float(x):.9g}")
    return x


def differences(df, db, sql: str) -> list[str]:
    """What tells the two results apart: names, row counts, rows; nothing if they agree."""
    got = db.execute(sql)
    names = [d[0] for d in got.description]
    want = got.fetchall()
    cols = sorted(df.columns)
    if cols != sorted(names):
        return [f"columns {cols} against {sorted(names)}"]
    at = [names.index(c) for c in cols]
    a = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in want), key=repr)
    if len(a) != len(b):
        return [f"{len(a)} rows against {len(b)}"]
    return [f"{x} against {y}" for x, y in zip(a, b, strict=True) if x != y][:3]


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    where, *wanted = sys.argv[1:] or ["/root/testdata/sf0.01"]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "8g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    db, sqls, bad = connect(where), entry.oracle_sql(), 0
    for name, query in entry.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        began = time.time()
        try:
            if name in sqls:
                df = query(spark, where)
                found = differences(df, db, sqls[name])
                said = "; ".join(found) if found else f"same, {df.count()} rows"
                bad += bool(found)
            else:
                said = f"no SQL, {query(spark, where).count()} rows"
        except Exception as e:
            said, bad = f"{type(e).__name__}: {str(e)[:600]}", bad + 1
        print(f"{name}: {said} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} differ or fail")
