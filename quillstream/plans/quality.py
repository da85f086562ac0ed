"""Data-quality rules: each query returns the rows that break a rule, or a verdict for each row."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as ivl
from .bindings import CUES, TASKS, UNITS, cues, table, tasks, units
from .registry import by_doc, query

HOUR = 3600000


@query(f"WITH {UNITS} SELECT event_id, high - start_ms AS overlap_ms FROM (SELECT *, max(end_ms) OVER (PARTITION BY doc_id, speaker ORDER BY start_ms, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM units WHERE conf >= 5) WHERE start_ms < high")
def dq_active_overlap(spark, sf_dir):
    """Active units that start before an earlier one of the same speaker ends."""
    w = Window.partitionBy("doc_id", "speaker").orderBy("start_ms", "idx").rowsBetween(Window.unboundedPreceding, -1)
    u = units(spark, sf_dir).where("conf >= 5").withColumn("_high", F.max("end_ms").over(w))
    return u.where("start_ms < _high").select("event_id", (F.col("_high") - F.col("start_ms")).alias("overlap_ms"))


@query("SELECT l_orderkey, l_linenumber, 'repeated' AS issue FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT l_orderkey, l_linenumber, 'unknown' FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')) UNION ALL SELECT o_orderkey, NULL, 'missing' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def dq_lineage_fk_unique_complete(spark, sf_dir):
    """Repeated, unknown and missing lineage; one pass over the lines feeds all three rules."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), (F.col("o_orderstatus") != "P").alias("known"))
    j = lines.join(orders, "l_orderkey", "full_outer")
    issues = F.array_compact(F.array(F.when(F.col("n") > 1, "repeated"), F.when(F.col("n").isNotNull() & ~F.coalesce("known", F.lit(False)), "unknown"), F.when(F.col("n").isNull(), "missing")))
    return j.select("l_orderkey", "l_linenumber", F.explode(issues).alias("issue"))


@query("SELECT p_name AS token, count(DISTINCT p_brand) AS groups FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def dq_shared_tokens(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_name").alias("token")).agg(F.countDistinct("p_brand").alias("groups")).where("groups > 1")


@query("SELECT o_custkey AS group_id FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'O') > 0 AND count(*) FILTER (o_orderstatus = 'O') < count(*)")
def dq_group_membership(spark, sf_dir):
    """Groups that are neither wholly open nor wholly closed."""
    g = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("group_id")).agg(F.count_if(F.col("o_orderstatus") == "O").alias("o"), F.count("*").alias("n"))
    return g.where("o > 0 AND o < n").select("group_id")


@query(f"WITH {CUES} SELECT doc_id, idx, speaker, md5(text) AS text_md5, CASE WHEN length(text) > 240 THEN 'error' ELSE 'warning' END AS severity FROM cues WHERE length(text) > 120")
def dq_revision_limits(spark, sf_dir):
    n = F.length("text")
    return cues(spark, sf_dir).where(n > 120).select("doc_id", "idx", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.when(n > 240, "error").otherwise("warning").alias("severity"))


@query("SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CASE lang WHEN 'en' THEN 1500 ELSE 1200 END AS most FROM documents WHERE length(text) > CASE lang WHEN 'en' THEN 1500 ELSE 1200 END")
def dq_target_over_limit(spark, sf_dir):
    most = F.when(F.col("lang") == "en", 1500).otherwise(1200)
    return table(spark, sf_dir, "documents").select("doc_id", F.length("text").cast("long").alias("n"), most.alias("most")).where("n > most")


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'missing' ELSE 'empty' END AS issue FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.doc_id IS NULL OR l.quality IS NULL UNION ALL SELECT doc_id, 'extra' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT doc_id, 'duplicate' FROM labels GROUP BY doc_id HAVING count(*) > 1")
def dq_translation_contract(spark, sf_dir):
    """Documents and labels must pair off: missing, extra, duplicate and empty rows, by one full join of grouped sides."""
    d = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.lit(True).alias("d"))
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.count("*").alias("n"), F.count_if(F.col("quality").isNull()).alias("empty"))
    j = d.join(labels, "doc_id", "full_outer")
    issues = F.array_compact(F.array(F.when(F.col("n").isNull(), "missing"), F.when(F.col("empty") > 0, "empty"), F.when(F.col("d").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate")))
    return j.select("doc_id", F.explode(issues).alias("issue"))


@query("SELECT user_id, event_id, value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS p FROM events) WHERE value < p")
def dq_monotone_progress(spark, sf_dir):
    w = Window.partitionBy("user_id", "event_type").orderBy("event_id")
    return table(spark, sf_dir, "events").withColumn("_p", F.lag("value").over(w)).where("value < _p").select("user_id", "event_id", "value")


@query("SELECT event_id, p AS was, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) WHERE (p, event_type) IN (('view', 'purchase'), ('error', 'purchase'))")
def dq_state_transition(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("was", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return e.where(F.col("was").isin("view", "error") & (F.col("event_type") == "purchase")).select("event_id", "was", "event_type")


@query("WITH a AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_quantity >= 10), b AS (SELECT l_orderkey AS k, l_partkey AS p FROM lineitem WHERE l_quantity <= 40) SELECT k, p, 'declared' AS only_in FROM (FROM a EXCEPT ALL FROM b) UNION ALL SELECT k, p, 'registered' FROM (FROM b EXCEPT ALL FROM a)")
def dq_artifact_match(spark, sf_dir):
    """Declared against registered rows as multisets: one grouping instead of two set differences."""
    low, high = F.count_if(F.col("l_quantity") >= 10), F.count_if(F.col("l_quantity") <= 40)
    g = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_partkey").alias("p")).agg((low - high).alias("d")).where("d <> 0")
    return g.select("k", "p", F.when(F.col("d") > 0, "declared").otherwise("registered").alias("only_in"), F.explode(F.sequence(F.lit(1), F.abs("d").cast("int")))).drop("col")


@query(f"WITH {UNITS} SELECT event_id FROM units WHERE start_ms < 0 OR end_ms <= start_ms OR conf % 50 = 0 OR text IS NULL")
def dq_timeline(spark, sf_dir):
    return units(spark, sf_dir).where("start_ms < 0 OR end_ms <= start_ms OR conf % 50 = 0 OR text IS NULL").select("event_id")


_ISSUES = f"WITH {UNITS}, m AS (SELECT *, lead(start_ms) OVER w AS next_ms, lag(idx) OVER w AS p FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) "


@query(_ISSUES + "SELECT event_id, 'overlap' AS issue FROM m WHERE next_ms < end_ms UNION ALL SELECT event_id, 'short' FROM m WHERE end_ms - start_ms < 600000 UNION ALL SELECT event_id, 'number' FROM m WHERE idx <> coalesce(p + 1, 0) UNION ALL SELECT event_id, 'limit' FROM m WHERE length(text) > 5")
def dq_srt_hard_errors(spark, sf_dir):
    """Several rules over one window pass; a row may break more than one."""
    m = units(spark, sf_dir).withColumns({"_next": F.lead("start_ms").over(by_doc()), "_p": F.lag("idx").over(by_doc())})
    rules = F.array(F.when(F.col("_next") < F.col("end_ms"), "overlap"), F.when(F.col("end_ms") - F.col("start_ms") < 600000, "short"), F.when(F.col("idx") != F.coalesce(F.col("_p") + 1, F.lit(0)), "number"), F.when(F.length("text") > 5, "limit"))
    return m.select("event_id", F.explode(F.array_compact(rules)).alias("issue"))


@query("SELECT p_brand AS boundary FROM part GROUP BY 1 HAVING bool_or(p_size >= 45) AND bool_or(p_size <= 5)")
def dq_candidate_coverage(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("boundary")).agg(F.bool_or(F.col("p_size") >= 45).alias("a"), F.bool_or(F.col("p_size") <= 5).alias("b")).where("a AND b").select("boundary")


@query(f"WITH {UNITS} SELECT u.event_id, v.event_id AS other_id FROM units u JOIN units v ON u.doc_id = v.doc_id AND u.speaker = v.speaker AND u.start_ms < v.start_ms AND v.start_ms < u.end_ms AND u.end_ms < v.end_ms")
def dq_hierarchy(spark, sf_dir):
    """Crossing intervals: each begins inside the other's span and neither holds the other."""
    u = units(spark, sf_dir).select("doc_id", "speaker", "event_id", "start_ms", "end_ms")
    hit = ivl.overlaps(u, u, ["doc_id", "speaker"], 6 * HOUR)
    return hit.where("start_ms < o_start_ms AND o_start_ms < end_ms AND end_ms < o_end_ms").select("event_id", F.col("o_event_id").alias("other_id"))


@query(f"WITH {TASKS} SELECT state, count(*) AS n, count(*) FILTER (depends_on IS NULL) AS roots, count(DISTINCT project_id) AS projects FROM tasks GROUP BY 1")
def task_status_projection(spark, sf_dir):
    return tasks(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("depends_on").isNull()).alias("roots"), F.countDistinct("project_id").alias("projects"))


@query(r"SELECT doc_id, CASE WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) > 20000 THEN 'long' WHEN regexp_matches(text, '[\x00-\x08]') THEN 'control' END AS issue FROM documents WHERE text IS NULL OR trim(text) = '' OR length(text) > 20000 OR regexp_matches(text, '[\x00-\x08]')")
def dq_draft(spark, sf_dir):
    t = F.col("text")
    issue = F.when(t.isNull() | (F.trim(t) == ""), "empty").when(F.length(t) > 20000, "long").when(t.rlike(r"[\x00-\x08]"), "control")
    return table(spark, sf_dir, "documents").select("doc_id", issue.alias("issue")).where("issue IS NOT NULL")
