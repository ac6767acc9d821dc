"""Compare registered queries with their check SQL in DuckDB.

    python tools/check_queries.py [--sf DIR] [name ...]
"""

from __future__ import annotations

import argparse
import os
import sys
import tempfile
import time
import traceback

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import duckdb  # noqa: E402
from pyspark.sql import SparkSession  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.10g}"
    if isinstance(v, (bytes, bytearray)):
        return bytes(v).hex()
    if isinstance(v, dict):
        return repr(sorted((k, _value(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return repr([_value(x) for x in v])
    if hasattr(v, "asDict"):
        return _value(v.asDict())
    return repr(v) if not hasattr(v, "isoformat") else v.isoformat()


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(_value(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    spark_cols, spark_rows = normal(df.columns, [tuple(r) for r in df.collect()])
    table = con.execute(sql).to_arrow_table()
    # Through DuckDB's own Python values, as Spark rows are Python values too.
    result = con.execute(sql)
    duck_cols, duck_rows = normal([d[0] for d in result.description], result.fetchall())
    problems = []
    if spark_cols != duck_cols:
        problems.append(f"columns {spark_cols} != {duck_cols}")
    elif spark_rows != duck_rows:
        problems.append(f"rows {len(spark_rows)} vs {len(duck_rows)}")
        a, b = set(spark_rows), set(duck_rows)
        problems.append(f"  spark only: {sorted(a - b)[:2]}"[:340])
        problems.append(f"  check only: {sorted(b - a)[:2]}"[:340])
    types = {n: str(t) for n, t in zip(table.schema.names, table.schema.types)}
    names = {"bigint": "int64", "int": "int32", "double": "double", "string": "string",
             "boolean": "bool", "timestamp_ntz": "timestamp[us]", "date": "date32[day]",
             "float": "float", "binary": "binary", "smallint": "int16"}
    for n, t in df.dtypes:
        got = names.get(t, t)
        if n in types and got != types[n] and not t.startswith(("array", "struct", "map")):
            problems.append(f"type of {n}: {t} != {types[n]}")
    return len(spark_rows), problems


def session():
    s = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-"))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("OFF")
    return s


def main():
    p = argparse.ArgumentParser()
    p.add_argument("--sf", default="/root/testdata/sf0.001")
    p.add_argument("--heavy", type=int, help="rows per task, to force the heavy-key path")
    p.add_argument("names", nargs="*")
    a = p.parse_args()
    from millrace import plans

    spark, con, bad = session(), connect(a.sf), []
    if a.heavy:
        spark.conf.set("spark.millrace.smallBytes", "0")
        spark.conf.set("spark.millrace.rowsPerTask", str(a.heavy))
    for name in a.names or list(plans.QUERIES):
        t = time.time()
        try:
            df = plans.QUERIES[name](spark, a.sf)
            if name in plans.CHECKS:
                n, problems = compare(df, con, plans.CHECKS[name])
                state = "ok" if not problems else "DIFF"
            else:
                n, problems, state = df.count(), [], "rows"
        except Exception as e:  # noqa: BLE001
            n, problems, state = 0, [f"{type(e).__name__}: {str(e)[:600]}"], "FAIL"
            if os.environ.get("TRACE"):
                traceback.print_exc()
        if n == 0 and state == "ok":
            state = "EMPTY"
        if state not in ("ok", "rows"):
            bad.append(name)
        print(f"{state:5} {name:28} {n:8} rows {time.time() - t:6.2f} s", flush=True)
        for line in problems:
            print("      ", line[:700], flush=True)
    print(f"{len(bad)} bad: {bad}")


if __name__ == "__main__":
    main()
