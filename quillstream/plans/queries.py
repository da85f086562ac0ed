"""The reference's operators as queries over the driver's tables, each beside the DuckDB SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import intervals as ivl
from ..operators.once import once
from .bindings import CUES, TASKS, UNITS, cues, micros, table, tasks, units
from .registry import ORACLE_SQL, QUERIES, before, by_doc, by_speaker, query, units_query

_W = "(PARTITION BY doc_id ORDER BY idx)"
_P = "(PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
units_query("win_gap", lambda: {"gap_ms": F.greatest(F.lead("start_ms").over(by_doc()) - F.col("end_ms"), F.lit(0))}, f"CASE WHEN lead(start_ms) OVER {_W} IS NULL THEN 0 ELSE greatest(lead(start_ms) OVER {_W} - end_ms, 0) END AS gap_ms")
units_query("win_boundary_gap", lambda: {"gap_ms": F.coalesce(F.greatest(F.lead("start_ms").over(by_doc()) - F.col("end_ms"), F.lit(0)), F.lit(0))}, f"coalesce(greatest(lead(start_ms) OVER {_W} - end_ms, 0), 0) AS gap_ms")
units_query("win_running_max_end", lambda: {"reach_ms": F.max("end_ms").over(before()), "overlaps": F.coalesce(F.col("start_ms") < F.max("end_ms").over(before()), F.lit(False))}, f"max(end_ms) OVER {_P} AS reach_ms, coalesce(start_ms < max(end_ms) OVER {_P}, false) AS overlaps")
units_query("win_prev_end_per_speaker", lambda: {"prev_end_ms": F.max("end_ms").over(by_speaker())}, "max(end_ms) OVER (PARTITION BY doc_id, speaker ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end_ms")
units_query("win_pause_removal", lambda: {"pause_ms": F.greatest(F.col("start_ms") - F.max("end_ms").over(before()), F.lit(0))}, f"CASE WHEN max(end_ms) OVER {_P} IS NULL THEN 0 ELSE greatest(start_ms - max(end_ms) OVER {_P}, 0) END AS pause_ms")
units_query("win_snap_floor", lambda: {"floor_ms": F.least(F.coalesce(F.lag("end_ms").over(by_doc()), F.lit(0)), F.col("start_ms"))}, f"least(coalesce(lag(end_ms) OVER {_W}, 0), start_ms) AS floor_ms")
units_query("win_moving_average", lambda: {"mean_conf": F.round(F.avg("conf").over(by_doc().rowsBetween(-1, 1)), 6)}, "round(avg(conf) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS mean_conf")
units_query("win_sliding_ratio", lambda: {
    "quiet_before": F.round(F.avg(F.when(F.col("conf") < 30, 1.0).otherwise(0.0)).over(by_doc().rowsBetween(-4, -1)), 6), "voiced_after": F.round(F.avg(F.when(F.col("conf") >= 30, 1.0).otherwise(0.0)).over(by_doc().rowsBetween(1, 6)), 6)},
    "round(avg(CASE WHEN conf < 30 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), 6) AS quiet_before, round(avg(CASE WHEN conf >= 30 THEN 1.0::DOUBLE ELSE 0.0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND 6 FOLLOWING), 6) AS voiced_after")
units_query("filter_speaker_change", lambda: {"next_speaker": F.lead("speaker").over(by_doc()), "both_conf": F.least("conf", F.lead("conf").over(by_doc())), "speaker": F.col("speaker")}, f"lead(speaker) OVER {_W} AS next_speaker, CASE WHEN lead(conf) OVER {_W} IS NULL THEN conf ELSE least(conf, lead(conf) OVER {_W}) END AS both_conf, speaker", "next_speaker <> speaker AND both_conf >= 75")
units_query("filter_low_confidence", lambda: {"conf": F.col("conf"), "reason": F.when(F.col("text") == "error", "needs_review").when(F.col("conf") < 55, "low_confidence")}, "conf, CASE WHEN text = 'error' THEN 'needs_review' WHEN conf < 55 THEN 'low_confidence' END AS reason", "reason IS NOT NULL")
units_query("fn_time_valid", lambda: {"valid": (F.col("start_ms") >= 0) & (F.col("end_ms") > F.col("start_ms"))}, "start_ms >= 0 AND end_ms > start_ms AS valid")
units_query("win_sequence_number_check", lambda: {"contiguous": F.coalesce(F.col("idx") == F.lag("idx").over(by_doc()) + 1, F.col("idx") == 0)}, f"coalesce(idx = lag(idx) OVER {_W} + 1, idx = 0) AS contiguous")
units_query("dq_ordered_index", lambda: {"ordered": F.coalesce(F.col("start_ms") >= F.lag("start_ms").over(by_doc()), F.lit(True))}, f"coalesce(start_ms >= lag(start_ms) OVER {_W}, true) AS ordered")


@query(f"WITH {UNITS}, m AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER {_W} THEN 1 ELSE 0 END AS b FROM units), r AS (SELECT *, sum(b) OVER {_W} AS run FROM m) SELECT doc_id, CAST(run AS BIGINT) AS run, text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM r GROUP BY doc_id, run, text")
def win_merge_equal_adjacent(spark, sf_dir):
    m = units(spark, sf_dir).withColumn("b", F.when(F.lag("text").over(by_doc()).eqNullSafe(F.col("text")), 0).otherwise(1))
    m = m.withColumn("run", F.sum("b").over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy("doc_id", "run", "text").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n"))


@query(f"WITH {UNITS}, m AS (SELECT *, CASE WHEN speaker IS DISTINCT FROM lag(speaker) OVER {_W} OR start_ms - lag(start_ms) OVER {_W} > 86400000 THEN 1 ELSE 0 END AS b FROM units), r AS (SELECT *, sum(b) OVER {_W} AS component FROM m) SELECT doc_id, CAST(component AS BIGINT) AS component, count(*) AS n, min(idx) AS first_idx, max(idx) AS last_idx FROM r GROUP BY doc_id, component")
def win_components(spark, sf_dir):
    far = F.col("start_ms") - F.lag("start_ms").over(by_doc()) > 86400000
    m = units(spark, sf_dir).withColumn("b", F.when(~F.lag("speaker").over(by_doc()).eqNullSafe(F.col("speaker")) | far, 1).otherwise(0))
    m = m.withColumn("component", F.sum("b").over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    return m.groupBy("doc_id", "component").agg(F.count("*").alias("n"), F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


@query(f"WITH {UNITS}, r AS (SELECT doc_id, idx // 5 AS block, min(idx) AS a, max(idx) AS b FROM units GROUP BY 1, 2) SELECT u.event_id, r.block, CASE WHEN u.idx BETWEEN r.a AND r.b THEN 'review' ELSE 'context' END AS kind FROM units u JOIN r ON u.doc_id = r.doc_id AND u.idx BETWEEN r.a - 2 AND r.b + 2")
def win_context_halo(spark, sf_dir):
    """Blocks of five units with two neighbours on each side: a unit is exploded to the blocks near it, so nothing is joined."""
    u = units(spark, sf_dir)
    last = F.max("idx").over(Window.partitionBy("doc_id"))
    near = F.sequence(F.greatest(F.floor((F.col("idx") - 2) / 5), F.lit(0)), F.least(F.floor((F.col("idx") + 2) / 5), F.floor(last / 5)))
    return u.withColumn("own", F.floor(F.col("idx") / 5)).withColumn("near", near).select("event_id", "own", F.explode("near").alias("block")).select("event_id", "block", F.when(F.col("own") == F.col("block"), "review").otherwise("context").alias("kind"))


@query(f"WITH {UNITS} SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, event_id) - 1 AS position FROM units", "sort_cues")
def sort_cues(spark, sf_dir):
    return units(spark, sf_dir).select("doc_id", "event_id", (F.row_number().over(Window.partitionBy("doc_id").orderBy("start_ms", "end_ms", "event_id")) - 1).cast("long").alias("position"))




@query(f"WITH {UNITS}, i AS (SELECT * FROM units WHERE start_ms < end_ms), m AS (SELECT *, CASE WHEN start_ms <= max(end_ms) OVER w THEN 0 ELSE 1 END AS b FROM i WINDOW w AS (PARTITION BY doc_id ORDER BY start_ms, end_ms, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, event_id) AS k FROM m) SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY doc_id, k")
def ivl_union(spark, sf_dir):
    return ivl.union(units(spark, sf_dir).select("doc_id", "start_ms", "end_ms"), ["doc_id"])


_EDGES = f"{UNITS}, i AS (SELECT * FROM units WHERE start_ms < end_ms), e AS (SELECT DISTINCT doc_id, unnest([start_ms, end_ms]) AS a FROM i), s AS (SELECT doc_id, a AS start_ms, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS end_ms FROM e)"


@query(f"WITH {_EDGES} SELECT s.doc_id, s.start_ms, s.end_ms, count(*) AS active FROM s JOIN i ON i.doc_id = s.doc_id AND i.start_ms <= s.start_ms AND i.end_ms >= s.end_ms GROUP BY ALL")
def ivl_elementary_sweep(spark, sf_dir):
    return ivl.sweep(units(spark, sf_dir), ["doc_id"])


@query(f"""WITH {UNITS}, k AS (SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM units GROUP BY doc_id), c AS (SELECT * FROM units WHERE text IN ('error', 'purchase') AND start_ms < end_ms),
e AS (SELECT DISTINCT doc_id, a FROM (SELECT doc_id, unnest([start_ms, end_ms]) AS a FROM k UNION ALL SELECT doc_id, unnest([start_ms, end_ms]) AS a FROM c)), s AS (SELECT doc_id, a AS start_ms, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS end_ms FROM e),
p AS (SELECT s.* FROM s JOIN k ON k.doc_id = s.doc_id AND k.start_ms <= s.start_ms AND k.end_ms >= s.end_ms WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc_id = s.doc_id AND c.start_ms <= s.start_ms AND c.end_ms >= s.end_ms)),
m AS (SELECT *, CASE WHEN start_ms <= lag(end_ms) OVER (PARTITION BY doc_id ORDER BY start_ms) THEN 0 ELSE 1 END AS b FROM p), g AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY start_ms) AS n FROM m) SELECT doc_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY doc_id, n""")
def ivl_subtract(spark, sf_dir):
    u = units(spark, sf_dir)
    keep = u.groupBy("doc_id").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    return ivl.subtract(keep, u.where(F.col("text").isin("error", "purchase")).select("doc_id", "start_ms", "end_ms"), ["doc_id"])


@query(f"WITH {UNITS}, t AS (SELECT doc_id, start_ms // 21600000 AS h, min(start_ms) AS a, max(end_ms) AS b, min(speaker) AS sp FROM units GROUP BY 1, 2), o AS (SELECT u.event_id, least(u.end_ms, t.b) - greatest(u.start_ms, t.a) AS ov, t.a, t.sp, row_number() OVER (PARTITION BY u.event_id ORDER BY least(u.end_ms, t.b) - greatest(u.start_ms, t.a) DESC, t.a, t.sp DESC) AS r FROM units u JOIN t ON t.doc_id = u.doc_id AND u.start_ms < t.b AND u.end_ms > t.a AND u.start_ms < u.end_ms) SELECT u.event_id, coalesce(CAST(o.sp AS VARCHAR), 'speaker_unknown') AS speaker, coalesce(o.ov, 0) AS overlap_ms FROM units u LEFT JOIN o ON o.event_id = u.event_id AND r = 1")
def join_max_overlap(spark, sf_dir):
    u = units(spark, sf_dir)
    turns = u.groupBy("doc_id", F.floor(F.col("start_ms") / 21600000).alias("h")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min("speaker").alias("speaker"))
    return ivl.max_overlap(u, turns, "doc_id", 21600000)


@query("""WITH a AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS t, min(o_orderkey) AS id, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1, 2), b AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate) AS t, min(o_orderkey) AS id, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1, 2)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.n = 1 AND b.n = 1 THEN 'paired' ELSE 'unmatched' END AS state, CASE WHEN a.n = 1 AND b.n = 1 THEN a.id END AS source_id, CASE WHEN a.n = 1 AND b.n = 1 THEN b.id END AS target_id, epoch_us(coalesce(a.t, b.t)) AS at_us FROM a FULL JOIN b ON a.k = b.k AND a.t = b.t""")
def join_exact_time_unique(spark, sf_dir):
    """Pair two tracks on equal times where each side has exactly one row."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("at"), "o_orderkey", (F.col("o_orderstatus") == "F").alias("src"))
    o = o.withColumn("at_us", micros("at"))
    side = lambda s: F.count(F.when(s, 1)), lambda s: F.min(F.when(s, F.col("o_orderkey")))
    g = o.groupBy("k", "at_us").agg(side[0](F.col("src")).alias("a"), side[0](~F.col("src")).alias("b"), side[1](F.col("src")).alias("s"), side[1](~F.col("src")).alias("t"))
    one = (F.col("a") == 1) & (F.col("b") == 1)
    return g.select("k", F.when(one, "paired").otherwise("unmatched").alias("state"), F.when(one, F.col("s")).alias("source_id"), F.when(one, F.col("t")).alias("target_id"), "at_us")


@query(f"WITH {TASKS} SELECT t.task_id, t.project_id FROM tasks t WHERE t.state = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.task_id = t.depends_on AND d.state <> 'succeeded')")
def join_anti_dependency(spark, sf_dir):
    t = tasks(spark, sf_dir)
    open_ = t.where("state <> 'succeeded'").select(F.col("task_id").alias("open_id"))
    return t.where("state = 'queued'").join(open_, F.col("depends_on") == F.col("open_id"), "left_anti").select("task_id", "project_id")


@query(f"WITH {TASKS} SELECT project_id, arg_min(task_id, struct_pack(a := created_us, b := task_id)) AS task_id FROM tasks t WHERE state = 'queued' AND NOT EXISTS (SELECT 1 FROM tasks d WHERE d.task_id = t.depends_on AND d.state <> 'succeeded') GROUP BY project_id")
def topk_claim(spark, sf_dir):
    """The oldest task of each project that can be claimed."""
    ready = join_anti_dependency(spark, sf_dir).select("task_id").join(tasks(spark, sf_dir), "task_id")
    return ready.groupBy("project_id").agg(F.min(F.struct("created_us", "task_id")).alias("m")).select("project_id", F.col("m.task_id").alias("task_id"))


@query(f"WITH {TASKS} SELECT task_id, state, task_type, created_us FROM tasks WHERE state IN ('queued', 'running') AND task_type IN ('1-URGENT', '2-HIGH') ORDER BY created_us DESC, task_id DESC LIMIT 50", "filter_task_query")
def filter_task_query(spark, sf_dir):
    t = tasks(spark, sf_dir).where(F.col("state").isin("queued", "running") & F.col("task_type").isin("1-URGENT", "2-HIGH"))
    return t.orderBy(F.desc("created_us"), F.desc("task_id")).limit(50).select("task_id", "state", "task_type", "created_us")


@query(f"WITH {TASKS} SELECT task_id, created_us FROM tasks ORDER BY created_us DESC, task_id DESC LIMIT 100", "sort_tasks_recent")
def sort_tasks_recent(spark, sf_dir):
    return tasks(spark, sf_dir).orderBy(F.desc("created_us"), F.desc("task_id")).limit(100).select("task_id", "created_us")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey < 5000 ORDER BY o_orderkey DESC LIMIT 25", "page_keyset")
def page_keyset(spark, sf_dir):
    return table(spark, sf_dir, "orders").where("o_orderkey < 5000").orderBy(F.desc("o_orderkey")).limit(25).select("o_orderkey")


@query("SELECT event_id, user_id FROM events WHERE event_id > 400 AND user_id % 5 = 1 ORDER BY event_id LIMIT 100", "source_event_stream")
def source_event_stream(spark, sf_dir):
    """Events after a cursor, filtered, in order, one page."""
    return table(spark, sf_dir, "events").where("event_id > 400 AND user_id % 5 = 1").orderBy("event_id").limit(100).select("event_id", "user_id")


_REV = "r AS (SELECT l_orderkey AS doc_id, l_partkey % 5 AS entity, l_returnflag = 'R' AS removed, l_quantity AS body, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS rev FROM lineitem)"


def _revisions(spark, sf_dir):
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") % 5).alias("entity"), (F.col("l_returnflag") == "R").alias("removed"), F.col("l_quantity").alias("body"), F.row_number().over(w).cast("long").alias("rev"))


@query(f"WITH {_REV} SELECT doc_id, entity, body, rev FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, entity ORDER BY rev DESC) AS k FROM r) WHERE k = 1 AND NOT removed")
def ver_replay(spark, sf_dir):
    """State after all patches: the last version of each entity that isn't removed; a grouped maximum, no sort."""
    last = _revisions(spark, sf_dir).groupBy("doc_id", "entity").agg(F.max(F.struct("rev", "removed", "body")).alias("m"))
    return last.where("NOT m.removed").select("doc_id", "entity", "m.body", "m.rev")


@query(f"WITH {_REV} SELECT doc_id, max(rev) AS latest, max(CASE WHEN rev = 1 OR rev % 3 = 0 THEN rev END) AS snapshot FROM r GROUP BY doc_id")
def top1_latest(spark, sf_dir):
    return _revisions(spark, sf_dir).groupBy("doc_id").agg(F.max("rev").alias("latest"), F.max(F.when((F.col("rev") == 1) | (F.col("rev") % 3 == 0), F.col("rev"))).alias("snapshot"))


@query(f"WITH {_REV} SELECT doc_id, rev, rev = 1 OR rev % 50 = 0 OR removed AS is_snapshot FROM r")
def ver_checkpoint_rule(spark, sf_dir):
    return _revisions(spark, sf_dir).select("doc_id", "rev", ((F.col("rev") == 1) | (F.col("rev") % 50 == 0) | F.col("removed")).alias("is_snapshot"))


_AFTER = "b AS (SELECT p_partkey, p_name, p_size FROM part), a AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 5 = 0 THEN p_size + 1 ELSE p_size END AS p_size FROM part WHERE p_partkey % 7 <> 0)"


@query(f"WITH {_AFTER} SELECT coalesce(b.p_partkey, a.p_partkey) AS p_partkey, CASE WHEN a.p_partkey IS NULL THEN 'remove' ELSE 'upsert' END AS op, a.p_size FROM b FULL JOIN a ON a.p_partkey = b.p_partkey WHERE a.p_partkey IS NULL OR b.p_partkey IS NULL OR a.p_name IS DISTINCT FROM b.p_name OR a.p_size IS DISTINCT FROM b.p_size")
def ver_diff(spark, sf_dir):
    b = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    a = b.where("p_partkey % 7 <> 0").withColumn("p_size", F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")))
    j = b.alias("b").join(a.alias("a"), "p_partkey", "full_outer")
    changed = F.expr("a.p_name IS NULL OR b.p_name IS NULL OR NOT (a.p_name <=> b.p_name) OR NOT (a.p_size <=> b.p_size)")
    return j.where(changed).select("p_partkey", F.when(F.col("a.p_name").isNull(), "remove").otherwise("upsert").alias("op"), F.col("a.p_size").alias("p_size"))




@query("SELECT doc_id, count(*) AS n FROM (SELECT l_orderkey AS doc_id, l_linenumber AS k, count(*) AS c FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY doc_id")
def dq_unique_ids(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), "l_linenumber").agg(F.count("*").alias("c")).where("c > 1")
    return d.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT l_orderkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def join_missing_fk(spark, sf_dir):
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey").distinct().join(known, "l_orderkey", "left_anti")


for _name, _how, _sql in (("join_anti_receipts", "left_anti", "NOT EXISTS"), ("join_semi_receipts", "left_semi", "EXISTS")):

    def _receipts(spark, sf_dir, how=_how):
        done = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
        return table(spark, sf_dir, "orders").join(done, F.col("o_orderkey") == F.col("l_orderkey"), how).select("o_orderkey", "o_custkey")

    query(f"SELECT o_orderkey, o_custkey FROM orders WHERE {_sql} (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')", _name)(_receipts)


@query(r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 5), ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 4)) AS i FROM d)), bg AS (SELECT DISTINCT item_id, array_to_string(list_slice(w, i, i + 5), ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 4)) AS i FROM b))
SELECT doc_id, item_id, count(*) AS shared FROM dg JOIN bg USING (g) GROUP BY 1, 2""")
def join_ngram_overlap(spark, sf_dir):
    """Distinct 6-grams that documents share with benchmark items, by 128 bits of their hashes.

    The items' grams are counted; if they are few they are broadcast, so that only shared grams leave the scan of the
    documents, else both sides are shuffled by the gram.
    """

    def grams(name, key):
        t = once(table(spark, sf_dir, name).select(key, "text"), w=F.transform(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: F.xxhash64(x))).where("size(w) >= 6")
        own = lambda i: F.struct(F.xxhash64(F.slice("w", i, 6)).alias("g"), F.xxhash64(F.lit(1), F.slice("w", i, 6)).alias("g2"))
        return t.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 5), own)).alias("x")).select(key, "x.g", "x.g2")

    items = grams("benchmark", "item_id").distinct()
    items = F.broadcast(items) if items.count() <= 1_000_000 else items
    return grams("documents", "doc_id").join(items, ["g", "g2"]).distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))


@query("SELECT source, lang, count(*) AS n, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS good, CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS toxic FROM documents LEFT JOIN labels USING (doc_id) GROUP BY GROUPING SETS ((source), (lang), (source, lang))")
def agg_corpus_counts(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    flag = lambda c: F.sum(F.when(F.col(c) == 1, 1).otherwise(0))
    return d.groupingSets([["source"], ["lang"], ["source", "lang"]], "source", "lang").agg(F.count("*").alias("n"), flag("quality").alias("good"), flag("toxic").alias("toxic"))


@query("SELECT l_returnflag AS stage, count(*) AS calls, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt, CAST(sum(CAST(floor(l_tax * 100) AS BIGINT)) AS BIGINT) AS completion, round(sum(CAST(l_quantity AS BIGINT)) / CAST(count(*) AS DOUBLE), 6) AS per_call, CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS failed FROM lineitem GROUP BY 1")
def agg_usage_summary(spark, sf_dir):
    q = F.sum(F.col("l_quantity").cast("long"))
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("stage")).agg(F.count("*").alias("calls"), q.alias("prompt"), F.sum(F.floor(F.col("l_tax") * 100)).alias("completion"), F.round(q / F.count("*"), 6).alias("per_call"), F.sum(F.when(F.col("l_linestatus") == "F", 1).otherwise(0)).alias("failed"))


@query(r"WITH w AS (SELECT conv_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM conversations), g AS (SELECT n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS gram FROM (SELECT w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4, 5, 6]) AS n))) SELECT n, gram, count(*) AS freq FROM g GROUP BY 1, 2 HAVING count(*) > 1")
def agg_ngram_frequency(spark, sf_dir):
    w = table(spark, sf_dir, "conversations").select(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"), F.explode(F.array(*map(F.lit, range(2, 7)))).alias("n")).where("size(w) >= n")
    g = w.select("n", F.explode(F.expr("transform(sequence(1, size(w) - n + 1), i -> array_join(slice(w, i, n), ' '))")).alias("gram"))
    return g.groupBy("n", "gram").agg(F.count("*").alias("freq")).where("freq > 1")


@query("SELECT md5(text) AS text_md5, count(*) AS n FROM documents GROUP BY text HAVING count(*) > 1")
def agg_duplicate_target(spark, sf_dir):
    """Texts are counted by their digest, so whole texts aren't shuffled."""
    return table(spark, sf_dir, "documents").groupBy(F.md5(F.col("text").cast("binary")).alias("text_md5")).agg(F.count("*").alias("n")).where("n > 1")


@query("WITH p AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings) SELECT vec_id, CAST(i // 8 AS BIGINT) AS bucket, round(max(abs(CAST(v AS DOUBLE))), 4) AS peak FROM p GROUP BY 1, 2")
def agg_peak_bucket(spark, sf_dir):
    p = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return p.groupBy("vec_id", F.floor(F.col("i") / 8).alias("bucket")).agg(F.round(F.max(F.abs(F.col("v").cast("double"))), 4).alias("peak"))


@query(f"WITH {UNITS} SELECT doc_id, round(quantile_cont(CAST(conf AS DOUBLE), 0.25), 6) AS p25, round(quantile_cont(CAST(conf AS DOUBLE), 0.9), 6) AS p90 FROM units GROUP BY doc_id")
def agg_percentile(spark, sf_dir):
    """Interpolated percentiles."""
    return units(spark, sf_dir).groupBy("doc_id").agg(F.round(F.percentile("conf", F.lit(0.25)), 6).alias("p25"), F.round(F.percentile("conf", F.lit(0.9)), 6).alias("p90"))


@query(f"WITH {UNITS}, f AS (SELECT doc_id, text, min(idx) AS i FROM units GROUP BY 1, 2) SELECT doc_id, array_to_string(list(text ORDER BY i), ',') AS texts FROM f GROUP BY doc_id")
def agg_distinct_ordered(spark, sf_dir):
    f = units(spark, sf_dir).groupBy("doc_id", "text").agg(F.min("idx").alias("i"))
    return f.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "text")))["text"], ",").alias("texts"))


@query(f"WITH {UNITS}, x AS (SELECT doc_id, idx // 7 AS block, min(idx) AS a, max(idx) AS b FROM units GROUP BY 1, 2) SELECT doc_id, block, greatest(a - 2, 0) AS first_idx, least(b + 2, max(b) OVER (PARTITION BY doc_id)) AS last_idx FROM x")
def agg_owner_block_extent(spark, sf_dir):
    x = units(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 7).alias("block")).agg(F.min("idx").alias("a"), F.max("idx").alias("b"))
    return x.select("doc_id", "block", F.greatest(F.col("a") - 2, F.lit(0)).alias("first_idx"), F.least(F.col("b") + 2, F.max("b").over(Window.partitionBy("doc_id"))).alias("last_idx"))


@query("WITH a AS (SELECT lower(p_name) AS k, p_partkey AS id, 1 AS pr FROM part WHERE p_size % 2 = 0 UNION ALL SELECT lower(p_name), p_partkey, 2 FROM part WHERE p_size % 3 = 0) SELECT k, id, pr FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pr, id) AS r FROM a) WHERE r = 1", "set_union_priority")
def set_union_priority(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.lower("p_name").alias("k"), F.col("p_partkey").alias("id"), "p_size")
    a = p.where("p_size % 2 = 0").select("k", "id", F.lit(1).alias("pr")).union(p.where("p_size % 3 = 0").select("k", "id", F.lit(2).alias("pr")))
    return a.groupBy("k").agg(F.min(F.struct("pr", "id")).alias("m")).select("k", "m.id", "m.pr")


@query("SELECT lower(p_name) AS k, min(p_partkey) AS first_id, count(*) AS merged, max(p_size) AS weight FROM part GROUP BY 1")
def set_upsert_dedupe(spark, sf_dir):
    return table(spark, sf_dir, "part").groupBy(F.lower("p_name").alias("k")).agg(F.min("p_partkey").alias("first_id"), F.count("*").alias("merged"), F.max("p_size").alias("weight"))


@query("WITH a AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus <> 'O') SELECT CASE WHEN a.k IS NULL THEN 'gained' WHEN b.k IS NULL THEN 'lost' ELSE 'retained' END AS state, count(*) AS n FROM a FULL JOIN b ON a.k = b.k AND a.d = b.d GROUP BY 1")
def set_difference(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("d"), (F.col("o_orderstatus") == "F").alias("a"), (F.col("o_orderstatus") != "O").alias("b"))
    g = o.groupBy("o_custkey", "d").agg(F.max("a").alias("a"), F.max("b").alias("b")).where("a OR b")
    return g.groupBy(F.when(~F.col("a"), "gained").when(~F.col("b"), "lost").otherwise("retained").alias("state")).agg(F.count("*").alias("n"))


@query(f"WITH {CUES} SELECT doc_id, idx, speaker, md5(text) AS text_md5, start_ms, end_ms FROM cues WHERE length(text) > 120")
def filter_hard_limit(spark, sf_dir):
    return cues(spark, sf_dir).where(F.length("text") > 120).select("doc_id", "idx", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"), "start_ms", "end_ms")


_STAMP = "printf('%02d:%02d:%02d,%03d', {c} // 3600000, ({c} // 60000) % 60, ({c} // 1000) % 60, {c} % 1000)"


@query(f"WITH {CUES}, n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY idx, speaker, text) AS k FROM cues WHERE n_words > 0), t AS (SELECT doc_id, k, CAST(k AS VARCHAR) || chr(10) || {_STAMP.format(c='start_ms')} || ' --> ' || {_STAMP.format(c='end_ms')} || chr(10) || text AS block FROM n) SELECT doc_id, string_agg(block, chr(10) || chr(10) ORDER BY k) || chr(10) AS srt FROM t GROUP BY doc_id")
def sink_srt(spark, sf_dir):
    """One SRT text for each conversation."""
    n = cues(spark, sf_dir).where("n_words > 0").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "speaker", "text")))
    block = F.concat(F.col("k").cast("string"), F.lit("\n"), fn.stamp_srt(F.col("start_ms")), F.lit(" --> "), fn.stamp_srt(F.col("end_ms")), F.lit("\n"), F.col("text"))
    return n.select("doc_id", F.struct("k", block.alias("block")).alias("b")).groupBy("doc_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list("b"))["block"], "\n\n"), F.lit("\n")).alias("srt"))


@query(f"WITH {CUES} SELECT doc_id, string_agg(text, chr(10) ORDER BY idx, speaker, text) AS txt FROM cues GROUP BY doc_id")
def sink_txt(spark, sf_dir):
    return cues(spark, sf_dir).groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "speaker", "text")))["text"], "\n").alias("txt"))


@query(f"WITH {CUES} SELECT doc_id, idx, speaker, md5(text) AS text_md5, {_STAMP.format(c='start_ms')} AS stamp, start_ms AS parsed_ms FROM cues")
def fn_stamp_srt(spark, sf_dir):
    c = cues(spark, sf_dir).withColumn("stamp", fn.stamp_srt(F.col("start_ms")))
    return c.select("doc_id", "idx", "speaker", F.md5(F.col("text").cast("binary")).alias("text_md5"), "stamp", fn.parse_stamp(F.col("stamp")).alias("parsed_ms"))



_TEXT_FUNCTIONS = {
    "fn_visible_length": (fn.visible_length, r"CAST(length(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS BIGINT)"),
    "fn_nonspace_length": (fn.nonspace_length, r"CAST(length(regexp_replace(text, '\s+', '', 'g')) AS BIGINT)"),
    "fn_compact_key": (lambda c: F.md5(fn.compact_key(c).cast("binary")), "md5(regexp_replace(lower(text), '[^a-z0-9]+', '', 'g'))"),
    "fn_sha256": (lambda c: F.sha2(c, 256), "sha256(text)"),
    "fn_detect_language": (fn.script, r"CASE WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'ja' WHEN regexp_matches(text, '[\x{AC00}-\x{D7AF}]') THEN 'ko' WHEN regexp_matches(text, '[\x{3400}-\x{9FFF}]') AND regexp_matches(text, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(text, '[\x{3400}-\x{9FFF}]') THEN 'zh' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'other' END"),
    "fn_han_count": (lambda c: F.regexp_count(c, F.lit(fn.HAN)).cast("long"), r"CAST(len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]')) AS BIGINT)"),
    "fn_words_en": (lambda c: F.regexp_count(F.lower(c), F.lit("[a-z]+('[a-z]+)?")).cast("long"), "CAST(len(regexp_extract_all(lower(text), '[a-z]+(''[a-z]+)?')) AS BIGINT)"),
}
for _name, (_f, _sql) in _TEXT_FUNCTIONS.items():

    def _text_function(spark, sf_dir, f=_f):
        return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("result"))

    query(f"SELECT doc_id, {_sql} AS result FROM documents", _name)(_text_function)


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json_decode(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT event_id, CAST(least(60, pow(2, least(event_id % 10, 30))) AS INTEGER) AS wait_s FROM events")
def fn_retry_backoff(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", fn.retry_backoff(F.col("event_id") % 10 + 1).alias("wait_s"))


@query(r"SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages")
def fn_connection_url(spark, sf_dir):
    part = lambda p: F.regexp_extract("url", p, 1)
    return table(spark, sf_dir, "pages").select("page_id", part("^([a-z]+)://").alias("scheme"), F.lower(part("^[a-z]+://([^/?#]+)")).alias("host"), part("^[a-z]+://[^/?#]+([^?#]*)").alias("path"))


@query(r"SELECT page_id, regexp_replace(url, '[\\/:*?\"<>|\x00-\x1F]+', '_', 'g') AS name FROM pages")
def fn_safe_filename(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", fn.safe_filename(F.col("url")).alias("name"))
