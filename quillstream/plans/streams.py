"""Queries that run as streams over the event log, or as batches over its tasks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..streaming import events as st
from ..streaming import tail
from .bindings import TASKS, micros, table, tasks
from .registry import query


def _log(spark, sf_dir):
    return st.event_log(spark, f"{sf_dir}/events.parquet")


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def st_event_log(spark, sf_dir):
    return st.drain(_log(spark, sf_dir).where(F.col("event_type").isin("click", "purchase")).select("event_id", "user_id", "event_type"), "append", spark).drop("batch")


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1, 2")
def st_progress_rollup(spark, sf_dir):
    return st.newest(st.drain(st.progress(_log(spark, sf_dir)), "update", spark), ["user_id", "event_type"])


@query("SELECT DISTINCT user_id, event_type FROM events")
def st_idempotent_create(spark, sf_dir):
    """One creation for each scope, however often it is asked for; without a watermark the scopes are kept for good."""
    return st.drain(_log(spark, sf_dir).dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type"), "append", spark).drop("batch")


_STEPS = "steps(a, b) AS (VALUES ('view', 'click'), ('click', 'purchase'), ('click', 'error'), ('view', 'error'), ('error', 'view'), ('purchase', 'view'))"


@query(f"""WITH RECURSIVE {_STEPS}, e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
r AS (SELECT user_id, event_id, CAST(NULL AS VARCHAR) AS was, event_type, true AS ok, event_type AS state, k FROM e WHERE k = 1
UNION ALL SELECT user_id, event_id, was, event_type, ok, CASE WHEN ok THEN event_type ELSE was END, k FROM (SELECT e.user_id, e.event_id, r.state AS was, e.event_type, r.state = e.event_type OR s.a IS NOT NULL AS ok, e.k FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1 LEFT JOIN steps s ON s.a = r.state AND s.b = e.event_type))
SELECT user_id, event_id, was, event_type, ok FROM r""")
def st_state_machine(spark, sf_dir):
    return st.drain(st.state_machine(_log(spark, sf_dir)), "append", spark).drop("batch")


@query("SELECT user_id, event_id, value FROM (SELECT *, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high IS NULL OR value >= high")
def st_monotone_progress(spark, sf_dir):
    return st.drain(st.monotone(_log(spark, sf_dir)), "append", spark).drop("batch")


@query("""WITH m AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 12 HOUR THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m)
SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, count(*) AS n FROM g GROUP BY user_id, k""")
def st_queue_batching(spark, sf_dir):
    """Operations of a user batched until 12 quiet hours, as a batch query with the function that the stream uses."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.timestamp_micros(micros("ts")))
    w = e.groupBy("user_id", F.session_window("ts", "12 hours").alias("w")).agg(F.count("*").alias("n"))
    return w.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query(f"WITH {TASKS} SELECT project_id, count(*) AS attempts, arg_max(task_id, struct_pack(a := created_us, b := task_id)) AS latest_id FROM tasks GROUP BY 1")
def st_retry_attempts(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("project_id").agg(F.count("*").alias("attempts"), F.max(F.struct("created_us", "task_id"))["task_id"].alias("latest_id"))


@query(f"WITH {TASKS} SELECT t.task_id, t.depends_on IS NULL OR d.state = 'succeeded' AS claimable FROM tasks t LEFT JOIN tasks d ON d.task_id = t.depends_on")
def st_dependency_release(spark, sf_dir):
    t = tasks(spark, sf_dir)
    done = t.where("state = 'succeeded'").select(F.col("task_id").alias("depends_on"), F.lit(True).alias("_done"))
    return t.join(done, "depends_on", "left").select("task_id", (F.col("depends_on").isNull() | F.coalesce("_done", F.lit(False))).alias("claimable"))


@query(f"WITH {TASKS} SELECT task_id, CAST(coalesce(sum(task_id % 4 + 1) OVER (PARTITION BY project_id ORDER BY created_us, task_id), 0) AS BIGINT) <= 8 AS admitted FROM tasks WHERE state = 'queued'")
def st_resource_admission(spark, sf_dir):
    """Queued tasks of a project are let in, oldest first, while their demands fit its limit of 8."""
    order = Window.partitionBy("project_id").orderBy("created_us", "task_id").rowsBetween(Window.unboundedPreceding, 0)
    return tasks(spark, sf_dir).where("state = 'queued'").select("task_id", (F.sum(F.col("task_id") % 4 + 1).over(order) <= 8).alias("admitted"))


_NOW = "(SELECT max(created_us) - 30 * 86400000000 FROM tasks)"


@query(f"WITH {TASKS} SELECT task_id, CASE WHEN task_id % 5 = 0 THEN 'no_owner' WHEN task_id % 5 = 1 THEN 'other_owner' ELSE 'expired' END AS reason FROM tasks WHERE state = 'running' AND (task_id % 5 <= 1 OR created_us <= {_NOW})")
def st_lease_timeout(spark, sf_dir):
    """Running tasks without an owner, of another owner, or whose lease ended 30 days before the newest task."""
    t = tasks(spark, sf_dir)
    now = t.agg((F.max("created_us") - F.lit(30 * 86400000000)).alias("now"))  # one row
    owner = F.col("task_id") % 5
    gone = t.where("state = 'running'").join(F.broadcast(now), (owner <= 1) | (F.col("created_us") <= F.col("now")))
    return gone.select("task_id", F.when(owner == 0, "no_owner").when(owner == 1, "other_owner").otherwise("expired").alias("reason"))


@query("SELECT user_id, count(*) AS entries FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE event_type = 'error' AND p IS DISTINCT FROM 'error' GROUP BY 1 HAVING count(*) > 1")
def st_repair_once(spark, sf_dir):
    """Tasks that entered the repair phase more than once."""
    e = table(spark, sf_dir, "events").withColumn("_p", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.where("event_type = 'error' AND NOT (_p <=> 'error')").groupBy("user_id").agg(F.count("*").alias("entries")).where("entries > 1")


@query("SELECT event_id, user_id, k, coalesce(k > p, true) AS increasing FROM (SELECT *, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM (SELECT event_id, user_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))")
def st_jsonl_protocol(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.withColumn("increasing", F.coalesce(F.col("k") > F.lag("k").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(True)))


@query("WITH e AS (SELECT event_id, user_id, value, lag(event_id, 3) OVER (PARTITION BY user_id ORDER BY event_id) AS base, max(event_id) FILTER (event_type = 'purchase') OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS touched FROM events) SELECT event_id, CASE WHEN touched IS NULL OR base >= touched THEN 'apply' WHEN value < 50 THEN 'rebase' ELSE 'reject' END AS verdict FROM e")
def st_late_conflict(spark, sf_dir):
    """Operations on a base three events back: applied if nothing was committed since, rebased if small, else rejected."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    touched = F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    e = table(spark, sf_dir, "events").select("event_id", "value", F.lag("event_id", 3).over(w).alias("base"), touched.alias("touched"))
    return e.select("event_id", F.when(F.col("touched").isNull() | (F.col("base") >= F.col("touched")), "apply").when(F.col("value") < 50, "rebase").otherwise("reject").alias("verdict"))


@query("SELECT user_id, props, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def st_idempotent_receipt(spark, sf_dir):
    """A commit for each receipt (user and payload): the first event that asks for it."""
    return table(spark, sf_dir, "events").groupBy("user_id", "props").agg(F.min("event_id").alias("event_id"))


_AFTER = 500


@query(f"SELECT event_id, user_id, event_type FROM events WHERE event_id > {_AFTER}")
def st_cursor_tail(spark, sf_dir):
    """What the log has past a cursor, followed as a stream of a source of our own; tests/test_tail.py restarts it."""
    return st.drain(tail.tail(spark, f"{sf_dir}/events.parquet", "event_id long, user_id long, event_type string", after=_AFTER), "append", spark).drop("batch")


@query("SELECT event_id, sha256('id: ' || event_id || chr(10) || 'event: ' || event_type || chr(10) || 'data: ' || CAST(to_json({'event_id': event_id, 'user_id': user_id, 'event_type': event_type}) AS VARCHAR) || chr(10) || chr(10)) AS frame_sha256 FROM events")
def sink_sse(spark, sf_dir):
    """Events as frames of a browser's event stream."""
    return tail.encoded(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")).select("event_id", F.sha2("frame", 256).alias("frame_sha256"))
