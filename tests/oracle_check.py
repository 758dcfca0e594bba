"""Run queries beside their DuckDB oracles: ``python -m tests.oracle_check SF_DIR [NAME...]``."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

from lodegraph.sources.tables import closing


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _kind(t) -> str:
    t = str(t)
    return "text" if "string" in t else "time" if t.startswith("timestamp") else t


def canonical(rows: list[dict]) -> list[tuple]:
    """Rows with columns by name, values as comparable text, in any order."""
    one = lambda v: "null" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[c]) for c in sorted(r)) for r in rows)


def compare(spark, con, query, sql: str, sf_dir: str) -> str | None:
    """What differs, or nothing."""
    with closing(spark):
        got = query(spark, sf_dir).toArrow()
    want = con.execute(sql).to_arrow_table()
    if sorted(got.column_names) != sorted(want.column_names):
        return f"columns {sorted(got.column_names)} and {sorted(want.column_names)}"
    if kinds := [(c, got.schema.field(c).type, want.schema.field(c).type) for c in got.column_names if _kind(got.schema.field(c).type) != _kind(want.schema.field(c).type)]:
        return f"types {kinds}"
    a, b = canonical(got.to_pylist()), canonical(want.to_pylist())
    if a != b:
        left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only here {left}; only there {right}"
    return None


def main(sf_dir: str, names: list[str]) -> int:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "3g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, bad = connect(sf_dir), 0
    for name, sql in entry.oracle_sql().items():
        if names and name not in names:
            continue
        began = time.time()
        try:
            said = compare(spark, con, entry.queries()[name], sql, sf_dir)
        except Exception as e:  # noqa: BLE001
            said = f"{type(e).__name__}: {str(e)[:500]}"
        bad += said is not None
        print(f"{'ok ' if said is None else 'BAD'} {name} {time.time() - began:.1f}s {said or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]))
