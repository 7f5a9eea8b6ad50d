"""Run the operators' queries next to their SQL in DuckDB: ``python -m smelter.llm.verify SF_DIR [name ...]``."""

from __future__ import annotations

import sys
import time

TABLES = ("documents", "embeddings", "labels", "benchmark")


def compare(df, con, sql: str | None) -> str:
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return f"{len(rows)} rows, no SQL; {df.columns}; {rows[:2]}"
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in df.columns]
    expected = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=repr)
    got = sorted(rows, key=repr)
    differs = [(g, e) for g, e in zip(got, expected) if g != e][:2]
    return f"ok {len(got)} rows" if got == expected else f"DIFFERS {len(got)} / {len(expected)}: {differs}"


def main(sf_dir: str, names: list[str]) -> None:
    import duckdb

    from ..session import local_session
    from .queries import ORACLES, QUERIES
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    spark = local_session("smelter-llm-verify", cores=8, shuffle_partitions=8)
    for name in names or QUERIES:
        start = time.time()
        message = compare(QUERIES[name](spark, sf_dir), con, ORACLES.get(name))
        print(f"{name:28s} {time.time() - start:6.1f}s {message[:600]}", flush=True)


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2:])
