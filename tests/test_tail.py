"""A followed log: every event once over restarts, late readers in steps, state that lives on between micro-batches."""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from quillstream.streaming import tail

SCHEMA = "event_id long, user_id long, event_type string"


def append(folder, first: int, last: int, name: str) -> None:
    ids = [i for i in range(first, last) if i % 7 != 3]
    pq.write_table(pa.table({"event_id": ids, "user_id": [i % 3 for i in ids], "event_type": [f"k{i % 2}" for i in ids], "extra": ["x"] * len(ids)}), folder / f"{name}.parquet", row_group_size=5)


def run(stream, out, log, mode="append") -> list[int]:
    """One run over all that is there; the sizes of its batches."""
    sizes = []

    def write(rows, batch):
        sizes.append(rows.count())
        rows.write.mode("overwrite").parquet(f"file://{out}/batch={batch}")

    stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"file://{log}").start().processAllAvailable()
    for q in stream.sparkSession.streams.active:
        q.stop()
    return sizes


def test_restart_loses_and_repeats_nothing(spark, tmp_path):
    folder, out, log = tmp_path / "log", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    follow = lambda: tail.tail(spark, str(folder), SCHEMA, after=4, batch=10)
    append(folder, 0, 30, "a")
    (folder / "_half.parquet").write_bytes(b"not yet")
    first = run(follow(), out, log)
    assert len(first) >= 3 and max(first) <= 10
    append(folder, 30, 42, "b")
    append(folder, 60, 75, "c")
    second = run(follow(), out, log)
    assert len(second) >= 2 and run(follow(), out, log) in ([], [0])
    got = [r.event_id for r in spark.read.parquet(f"file://{out}").select("event_id").collect()]
    assert sorted(got) == [i for i in [*range(5, 42), *range(60, 75)] if i % 7 != 3]


def test_counts_live_on_between_batches(spark, tmp_path):
    folder, out, log = tmp_path / "log", tmp_path / "out", tmp_path / "cp"
    folder.mkdir()
    counts = lambda: tail.tail(spark, str(folder), SCHEMA, batch=8).groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))
    append(folder, 0, 20, "a")
    run(counts(), out, log, "update")
    append(folder, 20, 50, "b")
    run(counts(), out, log, "update")
    newest = spark.read.parquet(f"file://{out}").groupBy("user_id").agg(F.max_by(F.struct("n", "last"), "batch").alias("r")).collect()
    ids = [i for i in range(50) if i % 7 != 3]
    assert {r.user_id: tuple(r.r) for r in newest} == {u: (sum(i % 3 == u for i in ids), max(i for i in ids if i % 3 == u)) for u in range(3)}


def test_frames(spark):
    got = tail.encoded(spark.createDataFrame([(7, 1, "a\nb")], SCHEMA)).first().frame
    lines = got.split("\n")
    assert lines[:2] == ["id: 7", "event: a b"] and json.loads(lines[2].removeprefix("data: ")) == {"event_id": 7, "user_id": 1, "event_type": "a\nb"} and got.endswith("}\n\n")


def test_empty_log(spark, tmp_path):
    assert run(tail.tail(spark, str(tmp_path / "none"), SCHEMA), tmp_path / "out", tmp_path / "cp") in ([], [0])
