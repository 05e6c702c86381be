"""Compares queries with their SQL as the driver does: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import math
import sys
import time
import traceback
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(columns: list[str], rows) -> list[tuple]:
    def plain(x):
        if isinstance(x, float):
            return "nan" if math.isnan(x) else round(x, 7) + 0.0
        return x

    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=repr)


def compare(spark, sf_dir: str, name: str, query, sql: str | None) -> str:
    import duckdb

    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return f"rows only: {len(got)}"
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    want = rows_of(names, out.fetchall())
    if sorted(names) != sorted(df.columns):
        return f"COLUMNS {sorted(df.columns)} / {sorted(names)}"
    if got != want:
        diff = [(a, b) for a, b in zip(got, want) if a != b][:2]
        return f"DIFFER {len(got)} / {len(want)} rows, {sum(a != b for a, b in zip(got, want))} unequal: {str(diff)[:600]}"
    return f"equal: {len(got)} rows"


def main() -> None:
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for n in names or queries:
        start = time.time()
        try:
            said = compare(spark, sf_dir, n, queries[n], oracles.get(n))
        except Exception:
            said = "ERROR " + traceback.format_exc().strip()[-700:] if names else "ERROR " + traceback.format_exc().strip().splitlines()[-1][:300]
        print(f"{n}: {said} ({time.time() - start:.1f} s)", flush=True)


if __name__ == "__main__":
    main()
