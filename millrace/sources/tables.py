"""Parquet tables read under declared schemas."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def _schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)


# The declared columns of each table.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
    "c_mktsegment STRING",
    "supplier": "s_suppkey BIGINT, s_name STRING, s_nationkey INT, s_acctbal DOUBLE",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
    "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
    "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
    "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
    "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
    "value DOUBLE, props STRING",
}


class SchemaDrift(ValueError):
    """The files differ from the declared schema."""


def check_schema(found: T.StructType, declared: T.StructType, name: str) -> None:
    """Raise ``SchemaDrift`` on missing, extra or retyped columns."""
    have = {f.name: f.dataType for f in found}
    want = {f.name: f.dataType for f in declared}
    problems = [f"missing {n}" for n in want if n not in have]
    problems += [f"unexpected {n}" for n in have if n not in want]
    problems += [
        f"{n} is {have[n].simpleString()}, not {want[n].simpleString()}"
        for n in want
        if n in have and have[n] != want[n]
    ]
    if problems:
        raise SchemaDrift(f"{name}: {'; '.join(problems)}")


def load_table(
    spark: SparkSession,
    directory: str,
    name: str,
    schema: str | None = None,
    every_file: bool = True,
) -> DataFrame:
    """Read ``directory/name.parquet`` and insist on its declared schema.

    The footers of all files are merged in a Spark job first, which also finds a
    column that only some files have or that changes type between files. Without
    ``every_file`` only one footer is looked at. Columns come back in declared
    order.
    """
    declared = _schema(schema or SCHEMAS[name])
    reader = spark.read.option("mergeSchema", every_file)
    path = f"{directory.rstrip('/')}/{name}.parquet"
    try:
        df = reader.parquet(path)
    except (PySparkException, Py4JJavaError) as error:
        if "merge" not in str(error).lower():
            raise
        raise SchemaDrift(f"{name}: files differ in their columns' types") from error
    check_schema(df.schema, declared, name)
    return df.select(*declared.names)
