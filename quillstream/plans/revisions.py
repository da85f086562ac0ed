"""Revisions of documents restored from snapshots and patches; the SQL replays the log itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import numbering, versions
from .bindings import TASKS, table, tasks
from .registry import query

_EVERY = 20


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a user as changes of rows: k of the event's properties names the row, an error removes it."""
    e = table(spark, sf_dir, "events")
    rev = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return e.select(F.col("user_id").alias("doc_id"), rev.alias("rev"), (F.get_json_object("props", "$.k").cast("long") % 12).alias("id"), (F.col("event_type") == "error").alias("removed"), "value")


_CHANGES = "changes AS (SELECT user_id AS doc_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rev, CAST(json_extract_string(props, '$.k') AS BIGINT) % 12 AS id, event_type = 'error' AS removed, value FROM events)"
#: Every document is wanted at three quarters of its revisions.
_WANTED = "wanted AS (SELECT doc_id, max(rev) * 3 // 4 AS wanted FROM changes GROUP BY doc_id HAVING max(rev) * 3 // 4 > 0)"


def _wanted(log: DataFrame) -> DataFrame:
    return log.groupBy("doc_id").agg(F.expr("max(rev) * 3 div 4").alias("rev")).where("rev > 0")


@query(f"""WITH {_CHANGES}, {_WANTED}, g AS (SELECT c.*, wanted, max(CASE WHEN removed THEN rev ELSE 0 END) OVER (PARTITION BY c.doc_id, id) AS gone FROM changes c JOIN wanted USING (doc_id) WHERE rev <= wanted),
l AS (SELECT doc_id, wanted AS rev, id, min(rev) AS since, arg_max(value, g.rev) AS value FROM g WHERE g.rev > gone GROUP BY doc_id, wanted, id)
SELECT doc_id, rev, row_number() OVER (PARTITION BY doc_id ORDER BY since, id) - 1 AS idx, id, value FROM l""")
def ver_apply_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document at a wanted revision: its nearest snapshot with the patches behind it."""
    log = changes(spark, sf_dir)
    return versions.restored(log, versions.snapshots(log, ["doc_id"], _EVERY), _wanted(log), ["doc_id"], _EVERY)


@query(f"""WITH {_CHANGES}, {_WANTED}, n AS (SELECT w.doc_id, w.wanted, max(c.rev) AS snapshot FROM wanted w JOIN changes c ON c.doc_id = w.doc_id AND c.rev <= w.wanted AND (c.rev = 1 OR c.rev % {_EVERY} = 0) GROUP BY w.doc_id, w.wanted),
a AS (SELECT n.doc_id, c.id, max(c.rev) AS last FROM n JOIN changes c ON c.doc_id = n.doc_id AND c.rev <= n.snapshot GROUP BY n.doc_id, c.id)
SELECT n.doc_id, wanted AS rev, snapshot, (SELECT count(*) FROM a JOIN changes c ON c.doc_id = a.doc_id AND c.rev = a.last AND NOT c.removed WHERE a.doc_id = n.doc_id) AS rows_kept, (SELECT count(*) FROM changes c WHERE c.doc_id = n.doc_id AND c.rev > snapshot AND c.rev <= wanted) AS patches FROM n""")
def source_revision_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read for a wanted revision: the nearest snapshot, the rows that it keeps, and the patches behind it."""
    log = changes(spark, sf_dir)
    at = versions.nearest(_wanted(log), _EVERY)
    rows = at.join(versions.snapshots(log, ["doc_id"], _EVERY), ["doc_id", "snapshot"]).groupBy("doc_id").agg(F.count("*").alias("rows_kept"))
    later = at.join(log.withColumnRenamed("rev", "_rev"), "doc_id").where("_rev > snapshot AND _rev <= rev").groupBy("doc_id").agg(F.count("*").alias("patches"))
    return at.join(rows, "doc_id", "left").join(later, "doc_id", "left").select("doc_id", "rev", "snapshot", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"), F.coalesce("patches", F.lit(0)).alias("patches"))


@query(f"""WITH {TASKS}, l AS (SELECT task_id, created_us, 'open' AS kind FROM tasks WHERE state = 'running' UNION ALL SELECT task_id, created_us, 'urgent' FROM tasks WHERE state = 'queued' AND task_type LIKE '1%')
SELECT task_id, created_us, kind, row_number() OVER (ORDER BY created_us DESC, task_id DESC, kind) AS place FROM l""")
def merge_sorted_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lists of tasks as one, the newest first, with each one's place."""
    t = tasks(spark, sf_dir)
    part = lambda where, kind: t.where(where).select("task_id", "created_us", F.lit(kind).alias("kind"))
    both = part("state = 'running'", "open").union(part("state = 'queued' AND task_type LIKE '1%'", "urgent"))
    return numbering.numbered(both, [F.col("created_us").desc(), F.col("task_id").desc(), F.col("kind")])
