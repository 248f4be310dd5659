"""Registration of the queries and of the SQL each is checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return register


def split_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A table for CPU-heavy Python steps, in as many pieces as the caller asks for.

    ``jobquarry.read.pieces`` is unset by default: a table of many files or row groups is
    never shuffled. It serves sample tables that are one row group, and so one task.
    """
    df = table(spark, sf_dir, name)
    pieces = spark.conf.get("jobquarry.read.pieces", None)
    return df.repartition(int(pieces), key) if pieces else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
