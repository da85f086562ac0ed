"""Timed-text entities bound to the driver's tables; each has the same formula as a DataFrame and as DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task where rows are parted by their key; turns become a hundred words each and more.
TASK_ROWS = 2_500


def spread(df: DataFrame, *keys: str, rows_of: DataFrame | None = None) -> DataFrame:
    """Rows parted by keys into as many tasks as their number (or that of another table) asks for, where that is more than a shuffle has.

    Later windows, groupings and joins on these and further keys need no other shuffle, and a task's sorts don't grow
    with the table. The count of a plain scan comes from the files' footers.
    """
    parts = -(-(df if rows_of is None else rows_of).count() // TASK_ROWS)
    return df.repartition(parts, *keys) if parts > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


def micros(name: str) -> Column:
    """Microseconds since 1970 of a timestamp without time zone, taken as UTC whatever the session's zone is."""
    return F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(name)).cast("timestamp"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Timed units in milliseconds: the events of each user in time order."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    start = F.floor(micros("ts") / 1000)
    return e.select(
        F.col("user_id").alias("doc_id"), "event_id", (F.row_number().over(w) - 1).cast("long").alias("idx"), start.alias("start_ms"),
        (start + F.floor(F.col("value") * 600000)).alias("end_ms"), F.col("event_type").alias("text"), (F.col("event_id") % 4).alias("speaker"), ((F.col("event_id") * 7) % 100).alias("conf"),
    )


UNITS = """units AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS start_ms, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) + CAST(floor(value * CAST(600000 AS DOUBLE)) AS BIGINT) AS end_ms,
  event_type AS text, event_id % 4 AS speaker, (event_id * 7) % 100 AS conf FROM events)"""


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cue a turn; a word takes 400 ms, and turns follow each other."""
    c = spread(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")
    c = c.withColumn("n_words", F.regexp_count("text", F.lit(r"[^\s]+")).cast("long"))
    before = Window.partitionBy("doc_id").orderBy("idx", "speaker", "text").rowsBetween(Window.unboundedPreceding, -1)
    c = c.withColumn("start_ms", F.coalesce(F.sum("n_words").over(before), F.lit(0)) * 400)
    return c.withColumn("end_ms", F.col("start_ms") + F.col("n_words") * 400)


CUES = r"""cues AS (SELECT *, start_ms + n_words * 400 AS end_ms FROM (SELECT *, CAST(coalesce(sum(n_words) OVER (PARTITION BY doc_id ORDER BY idx, speaker, text ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) * 400 AS start_ms
  FROM (SELECT conv_id AS doc_id, turn AS idx, role AS speaker, text, CAST(len(regexp_extract_all(text, '[^\s]+')) AS BIGINT) AS n_words FROM conversations)))"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks of a customer's project; a task depends on the customer's order before it."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    state = F.when(F.col("o_orderstatus") == "F", "succeeded").when(F.col("o_orderstatus") == "P", "running").otherwise("queued")
    return o.select(F.col("o_orderkey").alias("task_id"), F.col("o_custkey").alias("project_id"), state.alias("state"), micros("o_orderdate").alias("created_us"), F.lag("o_orderkey").over(w).alias("depends_on"), F.col("o_orderpriority").alias("task_type"))


TASKS = """tasks AS (SELECT o_orderkey AS task_id, o_custkey AS project_id, CASE o_orderstatus WHEN 'F' THEN 'succeeded' WHEN 'P' THEN 'running' ELSE 'queued' END AS state,
  epoch_us(o_orderdate) AS created_us, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS depends_on, o_orderpriority AS task_type FROM orders)"""
