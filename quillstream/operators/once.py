"""Columns that are worked out once a row, however often later expressions name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns behind a generator: the optimizer would copy a plain projection into every expression, lambdas included."""
    held = F.explode(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))).alias("_once")
    return df.select("*", held).select("*", *[F.col(f"_once.{name}").alias(name) for name in columns]).drop("_once")
