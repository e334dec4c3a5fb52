"""Run registered queries next to their SQL twins: python -m tests.compare SF_DIR [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "smallint": "SMALLINT", "tinyint": "TINYINT", "double": "DOUBLE", "float": "FLOAT",
    "string": "VARCHAR", "date": "DATE", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP",
}


def connect(folder):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def _rows(rows, order):
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if not isinstance(v, bool) else int(v)) for v in r))


def compare(df, con, sql):
    """None when equal, else what differs."""
    found = df.collect()
    compare.spark_done = time.time()
    result = con.execute(sql)
    names, kinds = [d[0] for d in result.description], [str(d[1]) for d in result.description]
    expected = result.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    found_kinds = {c: TYPES.get(k, k) for c, k in df.dtypes}
    wrong = {n: (found_kinds[n], k) for n, k in zip(names, kinds) if found_kinds[n] != k}
    order = sorted(names)
    left = _rows(found, [df.columns.index(c) for c in order])
    right = _rows(expected, [names.index(c) for c in order])
    problem = f"types {wrong} " if wrong else ""
    if len(left) != len(right):
        return problem + f"rows {len(left)} != {len(right)}; first {left[:2]} / {right[:2]}"
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        return problem + f"{len(bad)} of {len(left)} rows differ in {order}, first {bad[0]}"
    return problem or None


def main():
    from larder.registry import ORACLES, QUERIES
    from larder.session import build_session

    folder, names = sys.argv[1], sys.argv[2:] or list(QUERIES)
    spark = build_session("compare", f"local[{os.environ.get('BENCH_CPUS', '8')}]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name in names:
        started = compare.spark_done = time.time()
        try:
            df = QUERIES[name](spark, folder)
            if name in ORACLES:
                problem = compare(df, con, ORACLES[name])
            else:
                rows = len(df.collect())
                problem = None if rows else "no rows"
        except Exception as error:  # noqa: BLE001
            problem = f"{type(error).__name__}: {str(error)[:600]}"
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name} {compare.spark_done - started:.1f}s of {time.time() - started:.1f}s {problem or ''}", flush=True)
    print(f"{len(names) - failed} of {len(names)} good")


if __name__ == "__main__":
    main()
