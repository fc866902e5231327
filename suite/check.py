"""Run registered queries and compare them with their SQL: ``python -m suite.check [sf_dir] [name ...]``."""

import math
import sys
import time

import duckdb

from suite import ALL
from tablewright.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    return repr(float(v)) if isinstance(v, float) else repr(v)


def table_of(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """What differs between a query and its SQL, or ``None``."""
    columns, rows = table_of(df.columns, df.collect())
    found = con.execute(sql)
    wanted_columns, wanted = table_of([d[0] for d in found.description], found.fetchall())
    if columns != wanted_columns:
        return f"columns {columns} != {wanted_columns}"
    if len(rows) != len(wanted):
        return f"rows {len(rows)} != {len(wanted)}"
    bad = [(a, b) for a, b in zip(rows, wanted) if a != b]
    return f"{len(bad)} rows differ, first {str(bad[0])[:600]}" if bad else None


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = set(sys.argv[2:])
    spark, con = local_session("check", cores=8, partitions=8), connect(sf_dir)
    failed = 0
    for q in ALL:
        if only and q.name not in only:
            continue
        start = time.time()
        try:
            df = q.run(spark, sf_dir)
            said = difference(df, con, q.sql) if q.sql else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:700]}"
        ok = said is None or said.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {q.name} {time.time() - start:.1f}s {said or ''}", flush=True)
    print(f"{failed} failed")


if __name__ == "__main__":
    main()
