"""Run registered queries beside their SQL twins and compare the rows.

``python tests/compare.py [sf_dir] [name ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def plain(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else repr(round(number, 9) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    return str(value)


def normal(columns: list[str], rows) -> list[tuple[str, ...]]:
    places = [columns.index(c) for c in sorted(columns)]
    return sorted(tuple(plain(row[i]) for i in places) for row in rows)


def run_sql(con, sql: str):
    done = con.execute(sql)
    columns = [d[0] for d in done.description]
    kinds = {d[0]: str(d[1]) for d in done.description}
    return columns, kinds, done.fetchall()


SAME_KIND = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "float": "FLOAT",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
    "date": "DATE",
    "smallint": "SMALLINT",
    "tinyint": "TINYINT",
}


def check(spark, con, folder: str, name: str, queries, oracles):
    begin = time.time()
    df = queries[name](spark, folder)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - begin
    if name not in oracles:
        return ("rows" if rows else "EMPTY"), f"{len(rows)} rows", took
    columns, kinds, expected = run_sql(con, oracles[name])
    if sorted(columns) != sorted(df.columns):
        return "COLUMNS", f"{sorted(df.columns)} vs {sorted(columns)}", took
    mine, theirs = normal(df.columns, rows), normal(columns, expected)
    kind_notes = [
        f"{c}:{t} vs {kinds[c]}" for c, t in df.dtypes if SAME_KIND.get(t, t) != kinds[c]
    ]
    if mine != theirs:
        only_a = [r for r in mine if r not in set(theirs)][:2]
        only_b = [r for r in theirs if r not in set(mine)][:2]
        return "DIFFERENT", f"{len(mine)} vs {len(theirs)} rows; spark {only_a} sql {only_b} {kind_notes}", took
    if not rows:
        return "EMPTY", str(kind_notes), took
    return ("TYPES" if kind_notes else "ok"), f"{len(mine)} rows {kind_notes or ''}", took


def main():
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    from millrace.session import build_session

    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = sys.argv[2:] or sorted(queries)
    wanted = [n for n in queries if any(n == w or (w.endswith("*") and n.startswith(w[:-1])) for w in names)]
    if os.environ.get("PLAIN"):  # a session that knows nothing of this library
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config(
            "spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark = SparkSession.getActiveSession() or build_session("compare", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(folder)
    bad = 0
    for name in wanted:
        try:
            verdict, note, took = check(spark, con, folder, name, queries, oracles)
        except Exception as error:  # reported per query
            verdict, note, took = "FAILED", str(error)[:600], 0.0
        bad += verdict not in ("ok", "rows")
        print(f"{verdict:9} {took:6.2f}s {name}: {note}", flush=True)
    print(f"{len(wanted)} queries, {bad} not matching")


if __name__ == "__main__":
    main()
