"""Compare registered queries with their SQL twins: python tests/check_oracle.py [sf_dir] [name ...]"""

import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _key(value):
    if value is None:
        return (0, "")
    return (1, value) if isinstance(value, (int, float)) else (2, str(value))


def _clean(value):
    return value + 0.0 if isinstance(value, float) else value  # -0.0 -> 0.0


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cleaned = [tuple(_clean(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(cleaned, key=lambda r: [_key(v) for v in r])


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    start = time.time()
    frame = entry.queries()[name](spark, sf_dir)
    ours = sorted_rows(frame.columns, [tuple(r) for r in frame.collect()])
    middle = time.time()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"rows only: {len(ours[1])} rows, {middle - start:.1f}s"
    result = con.execute(sql)
    theirs = sorted_rows([d[0] for d in result.description], result.fetchall())
    note = f"{len(ours[1])} rows, spark {middle - start:.1f}s, sql {time.time() - middle:.1f}s"
    if ours == theirs:
        return True, note
    if ours[0] != theirs[0]:
        return False, f"{note}; columns {ours[0]} / {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return False, f"{note}; {len(theirs[1])} rows in SQL"
    bad = [(a, b) for a, b in zip(ours[1], theirs[1]) if a != b]
    return False, f"{note}; {len(bad)} differ, first: {str(bad[0])[:600]}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    failed = []
    for name in sys.argv[2:] or list(entry.queries()):
        try:
            ok, note = compare(spark, con, sf, name)
        except Exception as error:  # report and go on with the other queries
            ok, note = False, f"{type(error).__name__}: {str(error)[:700]}"
        print("ok  " if ok else "FAIL", name, note, flush=True)
        if not ok:
            failed.append(name)
    print("failed:", failed)
