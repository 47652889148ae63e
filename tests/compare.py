"""Runs queries on Spark and their SQL on DuckDB and compares rows, as sorted text. python tests/compare.py [sf_dir] [name ...]"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

REPO = Path(__file__).resolve().parents[1]
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else repr(x + 0.0)
    if x.__class__.__name__ == "Decimal":
        return repr(float(x))
    return str(x)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def differences(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty if the rows are the same."""
    df = query(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows_of(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        a, b = [x for x in got if x not in set(want)][:2], [x for x in want if x not in set(got)][:2]
        return f"{len(got)} and {len(want)} rows; Spark {a}, SQL {b}"
    return ""


if __name__ == "__main__":
    sys.path.insert(0, str(REPO))
    import __spark_entry__ as entry
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    con, q, sql = connect(sf), entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or sorted(sql):
        began = time.time()
        try:
            what = differences(spark, con, sf, q[name], sql[name])
        except Exception as e:  # noqa: BLE001
            what = f"{type(e).__name__}: {str(e)[:700]}"
        bad += bool(what)
        print(f"{name}: {'ok' if not what else what} ({time.time() - began:.1f} s)", flush=True)
    print(f"{bad} of {len(sys.argv[2:] or sql)} differ")
