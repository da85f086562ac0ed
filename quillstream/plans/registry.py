"""The registry of queries, each with the DuckDB SQL that checks it (none where SQL can't say it), and what the modules of plans share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window

from .bindings import UNITS, units

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


def by_doc():
    return Window.partitionBy("doc_id").orderBy("idx")


def before():
    return by_doc().rowsBetween(Window.unboundedPreceding, -1)


def by_speaker():
    return Window.partitionBy("doc_id", "speaker").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)


def units_query(name: str, cols: Callable[[], dict], sql_cols: str, where: str = "") -> None:
    """A query over units that adds window columns, maybe filtered by them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = units(spark, sf_dir).withColumns(cols())
        return (got.where(where) if where else got).select("event_id", *cols())

    query(f"WITH {UNITS} SELECT * FROM (SELECT event_id, {sql_cols} FROM units)" + (f" WHERE {where}" if where else ""), name)(run)
