"""Runs registered queries beside their SQL and compares the rows.

    python tests/oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def plain(value):
    """A comparable form; floats keep nine significant digits."""
    if isinstance(value, (float, Decimal)):
        value = float(value)
        return "nan" if value != value else f"{value:.9g}"
    if isinstance(value, dict):
        return tuple(sorted((str(k), plain(v)) for k, v in value.items()))
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return str(value)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(df, con, sql: str) -> str:
    """Empty when both results hold the same rows, else what differs."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(set(names) ^ set(df.columns))}"
    order = sorted(names)
    theirs = sorted(tuple(plain(r[names.index(c)]) for c in order) for r in result.fetchall())
    ours = sorted(tuple(plain(r[c]) for c in order) for r in df.collect())
    if len(ours) != len(theirs):
        return f"rows {len(ours)} != {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    if bad:
        a, b = bad[0]
        cells = [(c, x, y) for c, x, y in zip(order, a, b) if x != y]
        return f"{len(bad)} of {len(ours)} rows differ, first: {cells[:3]} in {a}"
    return ""


def main(sf_dir: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from ledgerlens.session import get_spark

    spark = get_spark(master="local[8]", **{"spark.ui.enabled": "false", "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("OFF")
    con, queries, oracle = duck(sf_dir), entry.queries(), entry.oracle_sql()
    failed = 0
    for name in names or queries:
        start = time.time()
        try:
            df = queries[name](spark, sf_dir)
            message = compare(df, con, oracle[name]) if name in oracle else f"rows only: {df.count()}"
        except Exception as exc:  # report and go on
            message = f"ERROR {type(exc).__name__}: {str(exc)[:700]}"
        ok = not message or message.startswith("rows only")
        failed += not ok
        print(f"{'ok ' if ok else 'BAD'} {name:32s} {time.time() - start:6.2f}s {message[:900]}", flush=True)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2:]))
