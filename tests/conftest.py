from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from millrace.session import build_session

    session = build_session(
        "tests",
        "local[8]",
        spark__sql__shuffle__partitions="4",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
        spark__driver__memory="6g",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def rows(df, *columns):
    """Rows as sorted tuples, nulls first."""
    df = df.select(*columns) if columns else df
    found = [tuple(r) for r in df.collect()]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) for v in r])


@pytest.fixture(scope="session")
def events(spark):
    """Events in which one user holds a third of the rows, with null values."""
    from pyspark.sql import functions as F

    from millrace.sources.tables import load_table

    events = load_table(spark, SF_DIR, "events")
    hot = F.when(F.col("event_id") % 3 == 0, None).otherwise(F.col("user_id") % 9)
    value = F.when(F.col("event_id") % 5 != 0, F.floor("value"))
    return events.select("event_id", "ts", hot.alias("user_id"), "event_type", value.alias("value"))
