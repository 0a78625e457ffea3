"""Compares registered queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = "region nation customer supplier part orders lineitem events".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def product_in_plan(df) -> str | None:
    """The name of a join that compares all pairs, if the plan has one."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return next((n for n in ("CartesianProduct", "BroadcastNestedLoopJoin") if n in plan), None)


def compare(spark, con, fn, sql, sf_dir) -> str | None:
    """None when schema and rows agree, else what differs."""
    df = fn(spark, sf_dir)
    if product_in_plan(df):
        return f"the plan has a {product_in_plan(df)}"
    ours = df.select(*sorted(df.columns)).toArrow()
    theirs = con.sql(sql).to_arrow_table()
    theirs = theirs.select(sorted(theirs.column_names))
    if ours.column_names != theirs.column_names:
        return f"columns {ours.column_names} and {theirs.column_names}"
    types = [
        f"{f.name}: {f.type} and {g.type}"
        for f, g in zip(ours.schema, theirs.schema, strict=True)
        if f.type != g.type
    ]
    if types:
        return f"types {types}"

    def bag(table):
        columns = [table.column(i).to_pylist() for i in range(table.num_columns)]
        return Counter(tuple(_plain(v) for v in row) for row in zip(*columns, strict=True))

    a, b = bag(ours), bag(theirs)
    if a != b:
        return (
            f"rows {sum(a.values())} and {sum(b.values())}; "
            f"only ours {list((a - b).items())[:2]}; only theirs {list((b - a).items())[:2]}"
        )
    return None if a else "no rows"


def main() -> None:
    from millrace.plans import ORACLES, QUERIES
    from millrace.session import build_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    spark = build_session(
        master="local[8]",
        spark__sql__shuffle__partitions="8",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="8g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    for name, fn in QUERIES.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        start = time.time()
        try:
            if name in ORACLES:
                verdict = compare(spark, con, fn, ORACLES[name], sf_dir) or "ok"
            else:
                verdict = f"rows only: {fn(spark, sf_dir).count()}"
        except Exception as error:  # noqa: BLE001
            verdict = f"ERROR {type(error).__name__} {str(error)[:1500]}"
        print(f"{name:32} {time.time() - start:6.1f}s  {verdict}", flush=True)


if __name__ == "__main__":
    main()
