"""Task events as a stream: Structured Streaming operators, and the job that drains a stream into a table.

A stream's output lies in the shared folder, one folder a micro-batch, overwritten when a batch is run again; so a
lost driver or executor repeats a batch without repeating its rows.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
#: Allowed steps between states; a task may stay in its state.
STEPS = {("view", "click"), ("click", "purchase"), ("click", "error"), ("view", "error"), ("error", "view"), ("purchase", "view")}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, or the context's checkpoint folder; a local one only where neither is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    set_ = sc._jsc.sc().getCheckpointDir()
    found = spark.conf.get("spark.checkpoint.dir", None) or (None if set_.isEmpty() else set_.get())
    if not found and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found or tempfile.mkdtemp(prefix="quillstream-")


def event_log(spark: SparkSession, path: str, files_a_batch: int = 8) -> DataFrame:
    """The append-only log, read as files arrive; path is a folder or a single file. ts is in UTC."""
    folder, _, name = path.rstrip("/").rpartition("/")
    pattern = f"{folder}/{{{name}}}"  # a stream takes a single file only by a pattern
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(pattern)


def drain(stream: DataFrame, mode: str, spark: SparkSession) -> DataFrame:
    """Run a stream over all that is there and return its output with the number of the batch in ``batch``."""
    at = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])

    def write(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{at}/out/batch={batch}")

    job = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/log").trigger(availableNow=True).foreachBatch(write).start()
    job.awaitTermination()
    ran = job.lastProgress is not None
    return spark.read.schema(schema).option("basePath", f"{at}/out").parquet(f"{at}/out") if ran else spark.createDataFrame([], schema)


def newest(out: DataFrame, keys: list[str]) -> DataFrame:
    """The last row that was put out for each key of an updating stream."""
    rest = [c for c in out.columns if c not in keys and c != "batch"]
    return out.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def progress(events: DataFrame) -> DataFrame:
    """Counters of each task and kind of event, updated with every batch."""
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))


def first_of_scope(events: DataFrame, scope: list[str], late: str) -> DataFrame:
    """The first row of each scope that arrives; state of scopes older than ``late`` is dropped."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(scope)


def bursts(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Queued operations of a user in batches that a quiet ``gap`` ends."""
    window = F.session_window("ts", gap)
    return events.withWatermark("ts", late).groupBy("user_id", window.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def folded(step: Callable[[tuple, tuple], tuple[tuple, tuple | None]], start: tuple, fields: list[str], order: str):
    """A state function: fold the rows of a key in order, one at a time, and put out what ``step(state, row)`` gives beside the next state."""

    def run(key, batches, state: GroupState):
        held = state.get if state.exists else start
        rows = pd.concat(list(batches)).sort_values(order)
        put = []
        for row in rows[fields].itertuples(index=False, name=None):
            held, out = step(held, row)
            if out is not None:
                put.append((*key, *out))
        state.update(held)
        yield pd.DataFrame(put) if put else pd.DataFrame()

    return run


def state_machine(events: DataFrame) -> DataFrame:
    """Each event with the state before it and whether the step is allowed; a step that isn't leaves the state as it was."""

    def step(held, row):
        event_id, kind = row
        ok = held[0] is None or held[0] == kind or (held[0], kind) in STEPS
        return (kind if ok else held[0],), (event_id, held[0], kind, ok)

    return _stateful(events, step, (None,), ["event_id", "event_type"], "user_id long, event_id long, was string, event_type string, ok boolean", "state string")


def monotone(events: DataFrame) -> DataFrame:
    """Progress reports that don't fall behind the highest one of their task so far."""

    def step(held, row):
        event_id, value = row
        ok = held[0] is None or value >= held[0]
        return (value if ok else held[0],), ((event_id, value) if ok else None)

    return _stateful(events, step, (None,), ["event_id", "value"], "user_id long, event_id long, value double", "high double")


def _stateful(events, step, start, fields, out, state) -> DataFrame:
    names = [c.strip().split()[0] for c in out.split(",")]
    fold = folded(step, start, fields, "event_id")

    def run(key, batches, held):
        for got in fold(key, batches, held):
            yield got.set_axis(names, axis=1) if len(got) else pd.DataFrame({n: [] for n in names})

    return events.groupBy("user_id").applyInPandasWithState(run, out, state, "append", GroupStateTimeout.NoTimeout)
