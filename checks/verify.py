"""Run queries next to their SQL in DuckDB and compare: ``python -m checks.verify SF_DIR [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def duck(sf_dir: str):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, dt.datetime) and value.time() == dt.time():
        return value.isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, name, sf_dir):
    """(ok, message) for one query."""
    from . import ORACLES, QUERIES
    return compare_frame(QUERIES[name](spark, sf_dir), con, ORACLES.get(name))


def compare_frame(df, con, sql):
    columns, rows = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return bool(rows), f"{len(rows)} rows, no SQL"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    kinds = {d[0]: str(d[1]) for d in result.description}
    expected_columns, expected = table_of(names, result.fetchall())
    if columns != expected_columns:
        return False, f"columns {columns} expected {expected_columns}"
    if len(rows) != len(expected):
        return False, f"{len(rows)} rows, expected {len(expected)}; e.g. {rows[:1]} / {expected[:1]}"
    for got, want in zip(rows, expected):
        if got != want or [type(g) for g in got] != [type(w) for w in want]:
            return False, f"row {got} expected {want}"
    huge = {k: v for k, v in kinds.items() if v.startswith(("HUGEINT", "DECIMAL", "UINT", "UBIG"))}
    return bool(rows), f"{len(rows)} rows" + (f" types {huge}" if huge else "")


def main(sf_dir: str, names: list[str]) -> int:
    sys.path.insert(0, ".")
    from smelter.session import local_session

    from . import QUERIES
    spark = local_session("smelter-verify", cores=8, shuffle_partitions=8)
    con = duck(sf_dir)
    bad = 0
    for name in names or QUERIES:
        start = time.time()
        try:
            ok, message = compare(spark, con, name, sf_dir)
        except Exception as error:
            ok, message = False, f"{type(error).__name__}: {str(error)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:28s} {time.time() - start:6.2f}s {message[:900]}", flush=True)
    print(f"{bad} failed", flush=True)
    return bad


if __name__ == "__main__":
    raise SystemExit(min(main(sys.argv[1], sys.argv[2:]), 1))
