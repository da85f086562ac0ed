"""Streams over several files give what one batch gives, and stateful folds carry their state from batch to batch."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstream.streaming import events as st


@pytest.fixture()
def log(spark, tmp_path):
    at = lambda hour: dt.datetime(2024, 1, 1, tzinfo=None) + dt.timedelta(hours=hour)
    rows = [(1, at(0), 1, "view", 1.0), (2, at(1), 1, "purchase", 3.0), (3, at(2), 1, "click", 2.0), (4, at(30), 1, "purchase", 4.0), (5, at(31), 2, "error", 5.0), (6, at(200), 2, "view", 1.0)]
    for k, (event, ts, user, kind, value) in enumerate(rows):
        one = spark.createDataFrame([(event, ts, user, kind, value, "{}")], st.SCHEMA)
        one.coalesce(1).write.mode("append").parquet(str(tmp_path / "events"))
    return str(tmp_path / "events")


def drained(spark, stream, mode):
    return st.drain(stream, mode, spark)


def test_batches_agree(spark, log):
    out = drained(spark, st.progress(st.event_log(spark, log, 1)), "update")
    assert out.select("batch").distinct().count() > 1
    got = st.newest(out, ["user_id", "event_type"])
    want = spark.read.parquet(log).groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_state_machine(spark, log):
    got = {r.event_id: (r.was, r.ok) for r in drained(spark, st.state_machine(st.event_log(spark, log, 8)), "append").collect()}
    assert got == {1: (None, True), 2: ("view", False), 3: ("view", True), 4: ("click", True), 5: (None, True), 6: ("error", True)}


def test_monotone(spark, log):
    assert sorted(r.event_id for r in drained(spark, st.monotone(st.event_log(spark, log, 8)), "append").collect()) == [1, 2, 4, 5]


def test_bursts_close_behind_the_watermark(spark, log):
    # the watermark of a row's batch closes older windows in a later batch; the newest window stays open
    stream = st.event_log(spark, log, 8).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(spark, st.bursts(stream, "12 hours", "1 hour"), "append").collect()
    assert sorted((r.user_id, r.n) for r in got) == [(1, 1), (1, 3), (2, 1)]


def test_first_of_scope(spark, log):
    stream = st.event_log(spark, log, 8).withColumn("ts", F.col("ts").cast("timestamp"))
    got = drained(spark, st.first_of_scope(stream, ["user_id", "event_type"], "400 hours"), "append")
    assert got.count() == 5


def test_empty_log(spark, tmp_path):
    spark.createDataFrame([], st.SCHEMA).write.parquet(str(tmp_path / "events"))
    assert drained(spark, st.monotone(st.event_log(spark, str(tmp_path / "events"))), "append").count() == 0
