"""Compare registered queries with their checking SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
    "boolean": "BOOLEAN", "date": "DATE", "timestamp": "TIMESTAMP", "timestamp_ntz": "TIMESTAMP",
    "array<string>": "VARCHAR[]",
}


def plain(value: object) -> object:
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, Decimal):
        return float(f"{float(value):.9g}")
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def difference(spark, con, name: str, folder: str) -> str | None:
    """Why the two results differ, or null when they agree."""
    df = entry.queries()[name](spark, folder)
    columns = sorted(df.columns)
    shape = df._jdf.queryExecution().executedPlan().toString()
    if "CartesianProduct" in shape or "BroadcastNestedLoopJoin" in shape:
        return "the plan joins without a key"
    mine = Counter(tuple(plain(v) for v in row) for row in df.select(*columns).collect())
    sql = entry.oracle_sql()[name]
    types = {row[0]: row[1] for row in con.execute(f"DESCRIBE {sql}").fetchall()}
    con.execute(sql)
    theirs_columns = [d[0] for d in con.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} != {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in con.fetchall())
    kinds = dict(df.dtypes)
    odd = [f"{c}: {kinds[c]} / {types[c]}" for c in columns if KINDS.get(kinds[c]) != types[c]]
    if odd:
        return f"types {odd}"
    if mine != theirs:
        only_mine = list((mine - theirs).elements())[:2]
        only_theirs = list((theirs - mine).elements())[:2]
        return (
            f"rows {sum(mine.values())} / {sum(theirs.values())}; only here {only_mine}; "
            f"only there {only_theirs}"
        )
    return None


def main(folder: str, names: list[str]) -> int:
    from postloom.session import local_session

    spark = local_session(8)
    con = connect(folder)
    bad = 0
    oracles = entry.oracle_sql()
    for name in names or list(entry.queries()):
        start = time.time()
        try:
            if name in oracles:
                fault = difference(spark, con, name, folder)
                empty = ""
            else:
                fault = None
                empty = f" ({entry.queries()[name](spark, folder).count()} rows, no SQL)"
        except Exception as error:  # noqa: BLE001
            fault, empty = f"{type(error).__name__}: {str(error)[:700]}", ""
        bad += fault is not None
        print(f"{'BAD ' if fault else 'ok  '} {name} {time.time() - start:.1f}s{empty} {fault or ''}", flush=True)
    print(f"{bad} differ")
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
