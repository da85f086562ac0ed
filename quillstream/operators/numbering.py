"""Rows numbered over a whole table, without putting it into one task."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.events import shared_dir


def numbered(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Add the place of each row, from 1, in an order over the whole table, which should be total.

    Rows are dealt by ranges of the order and sorted there; a row's place is its number within its part plus what the
    parts before it hold, and only the parts' counts are added up. The sorted rows are written to the shared folder, so
    that both steps see the same parts.
    """
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/numbered-{uuid.uuid4().hex}"
    # an id is the number of the part, then the number in it
    df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).write.parquet(at)
    rows = spark.read.parquet(at).withColumn("_part", F.shiftrightunsigned("_id", 33))
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.join(F.broadcast(counts.select("_part", before.alias("_before"))), "_part").withColumn(name, F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_id", "_part", "_before")
