"""Queries that run every operator over the shared parquet tables.

The tables are not news, but each operator is generic over (key, source, date,
attributes), so a query maps a table's columns to those roles. Where an operator reads
payload text, the text is built from table rows on the fly, one payload per row. The SQL
next to a query computes its result straight from the tables.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function as a query under its own name."""
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, folder)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def wall(column):
    """A timestamp without zone for output, as the tables themselves hold them."""
    return F.col(column).cast("timestamp_ntz") if isinstance(column, str) else column.cast("timestamp_ntz")


from . import columns, inputs, joins, payloads, reading, runs, tables, views, streams  # noqa: E402,F401
