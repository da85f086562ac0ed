"""Edits of cues and tokens, versions, intervals, sets and pages, each stated in SQL over the bound entities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bindings import table
from .common_sql import stated
from .registry import query

# Cues with what edits need: every seventh is deleted, every fifth was made by hand; three neighbours make a group; targets and their states.
_C = """c AS (SELECT doc_id, idx, speaker, text, n_words, start_ms, end_ms, (idx + doc_id) % 7 = 3 AS deleted, idx % 5 = 2 AS manual, idx ~/ 3 AS grp,
  CASE WHEN idx % 4 = 3 THEN '' ELSE 'T: ' || replace(text, 'e', '3') END AS target, CASE (idx * 5 + doc_id) % 3 WHEN 0 THEN 'translated' WHEN 1 THEN 'needs_review' ELSE 'manual_required' END AS status FROM {cues})"""
_K = "doc_id, idx, speaker"
_BY = "(PARTITION BY doc_id ORDER BY idx, speaker)"

# --- cues ---
stated("cue_reference_script", f"""WITH f AS (SELECT *, CASE WHEN pos = 0 OR lag(word) OVER (PARTITION BY {_K} ORDER BY pos) LIKE '%.' OR lag(word) OVER (PARTITION BY {_K} ORDER BY pos) LIKE '%,' THEN 1 ELSE 0 END AS starts FROM {{words}}),
r AS (SELECT *, sum(starts) OVER (PARTITION BY {_K} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cue FROM f)
SELECT {_K}, cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, JOINED(word SEP ' ' BY pos) AS text FROM r GROUP BY {_K}, cue""")
stated("filter_eligible_pair", f"""WITH n AS (SELECT *, lead(event_id) OVER w AS next_id, lead(speaker) OVER w AS speaker2, lead(conf) OVER w AS conf2, (lead(start_ms) OVER w) - end_ms AS gap FROM {{units}} WINDOW w AS (PARTITION BY doc_id ORDER BY idx))
SELECT event_id, next_id, gap FROM n WHERE next_id IS NOT NULL AND conf >= 10 AND conf2 >= 10 AND speaker = speaker2 AND gap BETWEEN 0 AND 86400000""")
stated("seg_regroup_window", f"""WITH g AS (SELECT doc_id, grp, min(idx) AS first_idx, max(idx) AS last_idx FROM (SELECT *, idx ~/ 6 AS grp FROM {{cues}}) x GROUP BY doc_id, grp),
n AS (SELECT *, lag(first_idx) OVER w AS before_first, lead(last_idx) OVER w AS after_last, lead(first_idx) OVER w AS next_first FROM g WINDOW w AS (PARTITION BY doc_id ORDER BY grp))
SELECT doc_id, grp, greatest(last_idx - 4, (first_idx + last_idx) ~/ 2 + 1) AS low, least(last_idx + 4, (next_first + after_last) ~/ 2) AS high FROM n WHERE next_first IS NOT NULL""")
stated("seg_display_breaks", """WITH b AS (SELECT doc_id, idx FROM {cues} WHERE idx % 3 = 2 UNION SELECT doc_id, idx FROM {cues} WHERE idx % 4 = 3), m AS (SELECT doc_id, max(idx) AS last_idx FROM {cues} GROUP BY doc_id)
SELECT b.doc_id, b.idx FROM b JOIN m ON b.doc_id = m.doc_id WHERE b.idx < m.last_idx""")
stated("seg_group_needs_opt", f"""WITH {_C} SELECT doc_id, grp, count(*) AS cues, sum(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) AS violations, sum(CASE WHEN n_words = 1 OR end_ms - start_ms < 800 THEN 1 ELSE 0 END) AS risks,
  sum(CASE WHEN length(text) > 400 THEN 1 ELSE 0 END) + sum(CASE WHEN n_words = 1 OR end_ms - start_ms < 800 THEN 1 ELSE 0 END) > 0 AS needed FROM c WHERE NOT deleted GROUP BY doc_id, grp""")
for _name, _mark in (("seg_number_join", "%,"), ("seg_fragment_join", "%-")):
    # pieces that belong together: a token joins the one before it if that one ends with the mark (a grouped number, a hyphenated word)
    stated(_name, f"""WITH t AS (SELECT {_K}, pos, CASE WHEN pos % 4 = 1 THEN '1{_mark[1:]}' WHEN pos % 4 = 2 THEN '234' ELSE word END AS token, start_ms, end_ms FROM {{words}}),
f AS (SELECT *, CASE WHEN lag(token) OVER w LIKE '1{_mark}' AND token = '234' THEN 0 ELSE 1 END AS starts FROM t WINDOW w AS (PARTITION BY {_K} ORDER BY pos)),
r AS (SELECT *, sum(starts) OVER (PARTITION BY {_K} ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS unit FROM f)
SELECT {_K}, unit, JOINED(token SEP '' BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM r GROUP BY {_K}, unit""")

# --- edits ---
stated("op_delete", f"WITH {_C} SELECT {_K}, CASE WHEN deleted OR idx % 6 = 1 THEN 'deleted' ELSE 'active' END AS state, NOT deleted AND idx % 6 = 1 AS changed FROM c")
stated("op_frozen_guard", f"WITH {_C}, o AS (SELECT doc_id AS d, idx AS i FROM {{cues}} WHERE idx % 6 = 1) SELECT DISTINCT {_K} FROM c JOIN o ON doc_id = d AND idx = i WHERE deleted")
stated("op_set_cue_time", f"""WITH {_C}, e AS (SELECT {_K}, manual, deleted, CASE WHEN idx % 4 = 1 AND NOT deleted THEN start_ms + 100 ELSE start_ms END AS start_ms, CASE WHEN idx % 4 = 1 AND NOT deleted THEN end_ms + 250 ELSE end_ms END AS end_ms FROM c),
n AS (SELECT *, lead(start_ms) OVER (PARTITION BY doc_id, speaker ORDER BY idx) AS next_start FROM e WHERE NOT deleted) SELECT {_K}, start_ms, end_ms, coalesce(end_ms > next_start AND NOT manual, false) AS overlaps FROM n""")
stated("op_set_cue_times", f"""WITH {_C}, e AS (SELECT {_K}, start_ms, end_ms, start_ms + (idx % 3) * 50 AS new_start, end_ms - (idx % 2) * 60 AS new_end FROM c WHERE NOT deleted), b AS (SELECT doc_id, bool_and(new_start < new_end) AS legal FROM e GROUP BY doc_id)
SELECT e.doc_id, idx, speaker, CASE WHEN legal THEN new_start ELSE start_ms END AS start_ms, CASE WHEN legal THEN new_end ELSE end_ms END AS end_ms FROM e JOIN b ON e.doc_id = b.doc_id""")
stated("op_set_cue_speaker", f"WITH {_C} SELECT {_K}, CASE WHEN NOT deleted AND idx % 8 = 0 THEN 'narrator' ELSE speaker END AS new_speaker FROM c")
stated("op_set_speaker_names", f"WITH {_C}, m AS (SELECT 'user' AS speaker, 'Guest' AS name UNION ALL SELECT 'assistant', 'Host') SELECT c.doc_id, c.idx, c.speaker, coalesce(m.name, c.speaker) AS shown FROM c LEFT JOIN m ON c.speaker = m.speaker")
stated("op_set_source_text", f"WITH {_C} SELECT {_K}, CASE WHEN deleted OR idx % 3 <> 0 THEN text WHEN trim(text) = '' OR length(text) > 20000 THEN text ELSE lower(text) END AS text, NOT deleted AND idx % 3 = 0 AND trim(text) <> '' AND length(text) <= 20000 AND lower(text) <> text AS changed FROM c")
stated("op_set_target", f"""WITH {_C}, o AS (SELECT {_K}, target AS seen, CASE WHEN idx % 6 = 0 THEN '' ELSE target || '!' END AS new_target, idx % 12 = 8 AS stale FROM c WHERE idx % 2 = 0)
SELECT c.doc_id, c.idx, c.speaker, CASE WHEN o.idx IS NULL OR o.stale OR c.deleted THEN c.target ELSE o.new_target END AS target, coalesce(o.stale, false) AS rejected, o.idx IS NOT NULL AND NOT o.stale AND NOT c.deleted AND o.new_target = '' AS cleared
FROM c LEFT JOIN o ON c.doc_id = o.doc_id AND c.idx = o.idx AND c.speaker = o.speaker""")
stated("op_set_target_unit", f"WITH {_C}, e AS (SELECT {_K}, CASE WHEN idx % 5 = 1 THEN '' WHEN idx % 5 = 3 THEN lower(target) ELSE target END AS text FROM c WHERE NOT deleted) SELECT {_K}, text FROM e WHERE text <> ''")
stated("op_set_target_units", f"""WITH {_C}, new AS (SELECT doc_id, grp, min(idx) AS idx, 'all of ' || count(*) AS text FROM c WHERE NOT deleted AND grp % 2 = 0 GROUP BY doc_id, grp)
SELECT doc_id, grp, idx, target AS text FROM c WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM new WHERE new.doc_id = c.doc_id AND new.grp = c.grp) UNION ALL SELECT doc_id, grp, idx, text FROM new""")
stated("op_insert_cue", f"""WITH {_C}, n AS (SELECT {_K}, grp, end_ms, lead(start_ms) OVER {_BY} AS next_start, lead(grp) OVER {_BY} AS next_grp FROM c WHERE NOT deleted), i AS (SELECT *, end_ms AS new_start, end_ms + 300 AS new_end FROM n WHERE idx % 4 = 2)
SELECT {_K}, new_start, new_end, CASE WHEN next_grp = grp THEN 'group ' || grp ELSE 'manual ' || idx END AS in_group, coalesce(next_start < new_end, false) AS rejected FROM i""")
stated("op_merge_tokens", f"""WITH m AS (SELECT {_K}, pos ~/ 3 AS span, JOINED(word SEP ' ' BY pos) AS text, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n FROM {{words}} WHERE NOT deleted AND pos % 3 < 2 GROUP BY {_K}, pos ~/ 3)
SELECT {_K}, span, text, start_ms, end_ms, n > 1 AS merged FROM m""")
stated("op_mark_dirty", f"WITH {_C} SELECT doc_id, grp, max(CASE WHEN idx % 6 = 1 THEN 'cue_deleted' ELSE '' END) AS deleted_flag, max(CASE WHEN idx % 9 = 4 THEN 'text_changed' ELSE '' END) AS text_flag FROM c GROUP BY doc_id, grp HAVING max(CASE WHEN idx % 6 = 1 OR idx % 9 = 4 THEN 1 ELSE 0 END) = 1")
stated("op_set_timeline", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND o_orderstatus = 'O' THEN 'replaced' WHEN o_orderkey % 3 = 0 THEN 'conflict' ELSE 'kept' END AS timeline FROM {orders}")
stated("op_set_presentation", "SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'target_first' WHEN c_mktsegment = 'BUILDING' THEN 'source_only' ELSE 'source_first' END AS display_order, c_custkey % 4 = 0 AS changed FROM {customer}")
stated("filter_expected_text", "WITH o AS (SELECT p_partkey, p_brand, p_name, CASE WHEN p_partkey % 40 = 0 THEN 'old' ELSE p_name END AS expected FROM {part} WHERE p_partkey % 5 = 0), b AS (SELECT p_brand, max(CASE WHEN expected <> p_name THEN 1 ELSE 0 END) AS failed FROM o GROUP BY p_brand) SELECT o.p_partkey, o.p_brand, b.failed = 0 AS applied FROM o JOIN b ON o.p_brand = b.p_brand")
stated("filter_stale_base", "WITH l AS (SELECT project_id, max(task_id) AS latest FROM {tasks} GROUP BY project_id) SELECT t.task_id, t.task_id = l.latest AS current, t.task_id <> l.latest AND t.state = 'queued' AS rebased FROM {tasks} t JOIN l ON t.project_id = l.project_id WHERE t.task_id = l.latest OR t.state IN ('queued', 'running')")
stated("filter_lease_expired", "WITH x AS (SELECT task_id, state, CASE task_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'me' ELSE 'other' END AS owner, task_id % 100 AS lease FROM {tasks}) SELECT task_id FROM x WHERE state = 'running' AND (owner IS NULL OR owner <> 'me' OR lease IS NULL OR lease <= 40)")
stated("filter_revision_page", "SELECT o_orderkey AS revision_number, o_orderstatus AS status FROM {orders} WHERE o_orderkey < 1200 ORDER BY o_orderkey DESC LIMIT 20")
stated("page_offset", f"SELECT {_K}, 40 AS next_offset FROM (SELECT {_K}, row_number() OVER (ORDER BY doc_id, idx, speaker) AS n FROM {{cues}} ORDER BY doc_id, idx, speaker LIMIT 40) x WHERE n > 20")
stated("topk_hotwords", "WITH v AS (SELECT lower(p_type) AS form, min(p_partkey) AS pos, least(greatest(max(p_size) ~/ 10, 1), 5) AS weight FROM {part} WHERE length(p_type) <= 60 GROUP BY lower(p_type)) SELECT form, pos, weight FROM v ORDER BY pos LIMIT 20")
stated("project_reindex", "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_quantity, l_linenumber) - 1 AS idx FROM {lineitem}")
stated("project_public_task", "SELECT task_id, project_id, task_type, state, state IN ('succeeded', 'failed', 'cancelled') AS finished, depends_on IS NOT NULL AS waits FROM {tasks}")
stated("project_token_times", """WITH s AS (SELECT l_orderkey, l_linenumber ~/ 2 AS token, min(l_partkey) AS start_ms, max(l_partkey + CAST(l_quantity AS BIGINT)) AS end_ms FROM {lineitem} GROUP BY l_orderkey, l_linenumber ~/ 2), o AS (SELECT o_orderkey, o_custkey AS start_ms FROM {orders} WHERE o_orderkey % 10 = 0)
SELECT s.l_orderkey, s.token, coalesce(least(o.start_ms, s.end_ms), s.start_ms) AS start_ms, s.end_ms FROM s LEFT JOIN o ON s.l_orderkey = o.o_orderkey AND s.token = 0""")
stated("project_track_lines", f"WITH {_C} SELECT {_K}, CASE WHEN speaker = 'user' THEN text ELSE target END AS upper_line, CASE WHEN speaker = 'user' THEN target ELSE text END AS lower_line FROM c")
stated("project_cue_lines", f"WITH {_C}, r AS (SELECT *, speaker = 'user' AS source_upper FROM c) SELECT {_K}, CASE WHEN source_upper THEN replace(text, ',', '') ELSE replace(text, '.', '') END AS source_line, CASE WHEN source_upper THEN replace(target, '.', '') ELSE replace(target, ',', '') END AS target_line FROM r")
stated("project_route_text", "WITH l AS (SELECT 'en' AS lang, 'zh-CN' AS target, true AS source_upper UNION ALL SELECT 'de', 'en', false UNION ALL SELECT 'fr', 'en', true) SELECT d.doc_id, d.lang AS source_language, coalesce(l.source_upper, false) AS source_upper, coalesce(l.target, 'en') AS target_language FROM {documents} d LEFT JOIN l ON d.lang = l.lang")

# --- versions ---
stated("ver_restore_fields", """WITH old AS (SELECT p_partkey, lower(p_name) AS name, p_size + 1 AS size FROM {part} WHERE p_partkey % 4 <> 0) SELECT p.p_partkey, CASE WHEN p.p_partkey % 3 = 0 AND o.p_partkey IS NOT NULL THEN o.name ELSE p.p_name END AS name, CASE WHEN p.p_partkey % 5 = 0 AND o.p_partkey IS NOT NULL THEN o.size ELSE p.p_size END AS size,
  p.p_partkey % 15 = 0 AND o.p_partkey IS NULL AS missing FROM {part} p LEFT JOIN old o ON p.p_partkey = o.p_partkey""")
stated("ver_delta_hash", f"SELECT doc_id, SHA(JOINED(idx || ':' || speaker || ':' || text SEP '|' BY idx, speaker, text)) AS content_hash, count(*) AS cues FROM {{cues}} GROUP BY doc_id")
stated("manifest_listing", "WITH r AS (SELECT project_id, task_id, row_number() OVER (PARTITION BY project_id ORDER BY created_us, task_id) AS revision FROM {tasks}) SELECT project_id, revision, task_id, max(revision) OVER (PARTITION BY project_id) AS latest, count(*) OVER (PARTITION BY project_id) AS revisions FROM r")
stated("audit_order_history", "WITH o AS (SELECT doc_id, idx ~/ 20 AS revision, CASE WHEN lag(start_ms) OVER w > start_ms OR lag(end_ms) OVER w > end_ms THEN 1 ELSE 0 END AS issue FROM {units} WINDOW w AS (PARTITION BY doc_id, idx ~/ 20 ORDER BY event_id)) SELECT doc_id, revision, count(*) AS cues, sum(issue) AS issues FROM o GROUP BY doc_id, revision")

# --- intervals ---
stated("ivl_laminar_tree", """WITH s AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_partkey % 40 AS a, l_partkey % 40 + CAST(l_quantity AS BIGINT) AS b FROM {lineitem}),
p AS (SELECT x.grp, x.id, max(CASE WHEN y.a < x.a AND x.a < y.b AND y.b < x.b OR x.a < y.a AND y.a < x.b AND x.b < y.b THEN 1 ELSE 0 END) AS crosses, min(CASE WHEN y.a <= x.a AND x.b <= y.b AND (y.b - y.a > x.b - x.a OR y.b - y.a = x.b - x.a AND y.id < x.id) THEN (y.b - y.a) * 100 + y.id END) AS best
  FROM s x LEFT JOIN s y ON x.grp = y.grp AND x.id <> y.id GROUP BY x.grp, x.id) SELECT grp, id, crosses = 1 AS crosses, best % 100 AS parent FROM p""")
stated("ivl_unit_nonoverlap", "WITH n AS (SELECT *, lag(end_ms) OVER (PARTITION BY doc_id, speaker, text ORDER BY start_ms, event_id) AS before_end FROM {units}) SELECT event_id, before_end - start_ms AS overlap_ms FROM n WHERE before_end > start_ms")
stated("ivl_collapse_zero", """WITH z AS (SELECT doc_id, idx, speaker, start_ms, CASE WHEN idx % 4 = 1 THEN start_ms ELSE end_ms END AS end_ms FROM {cues}), g AS (SELECT *, greatest(sum(CASE WHEN end_ms > start_ms THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS span FROM z)
SELECT doc_id, span, min(idx) AS first_idx, max(idx) AS last_idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM g GROUP BY doc_id, span""")
stated("ivl_restore_gap", f"""WITH {_C}, cut AS (SELECT doc_id, idx, start_ms, end_ms FROM c WHERE idx % 3 = 1 AND end_ms - start_ms > 1000) SELECT doc_id, idx, 'left' AS part, start_ms, start_ms + 200 AS end_ms FROM cut UNION ALL SELECT doc_id, idx, 'right', start_ms + 800, end_ms FROM cut""")
stated("win_context_overlap", f"WITH n AS (SELECT doc_id, idx, speaker, start_ms, end_ms, row_number() OVER w AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM {{cues}} WINDOW w AS (PARTITION BY doc_id ORDER BY idx, speaker)) SELECT {_K}, CASE WHEN k = 1 THEN start_ms ELSE start_ms - 500 END AS window_start, CASE WHEN k = n THEN end_ms ELSE end_ms + 500 END AS window_end FROM n")
stated("win_balanced_targets", "WITH d AS (SELECT doc_id, min(start_ms) AS a, max(end_ms) AS b, (max(end_ms) - min(start_ms)) ~/ 30000 + 1 AS n, 1 AS one FROM {cues} GROUP BY doc_id), t AS (SELECT doc_id, a, b, SERIES(one TO n) AS k FROM d) SELECT doc_id, k, a + k * 30000 AS target_ms FROM t WHERE a + k * 30000 < b AND b - (a + k * 30000) >= 7500")

# --- sets ---
stated("set_union_plans", f"WITH {_C} SELECT doc_id, plan, idx, row_number() OVER (PARTITION BY doc_id ORDER BY plan, idx, speaker) AS number FROM (SELECT doc_id, 1 AS plan, idx, speaker FROM c WHERE idx % 2 = 0 UNION ALL SELECT doc_id, 2, idx, speaker FROM c WHERE idx % 3 = 0) x")
stated("set_symmetric_cover", f"""WITH {_C}, own AS (SELECT doc_id, idx FROM c WHERE NOT deleted), res AS (SELECT doc_id, idx FROM c WHERE idx % 10 <> 7 UNION ALL SELECT doc_id, idx FROM c WHERE idx % 13 = 5), n AS (SELECT doc_id, idx, count(*) AS n FROM res GROUP BY doc_id, idx)
SELECT coalesce(own.doc_id, n.doc_id) AS doc_id, coalesce(own.idx, n.idx) AS idx, CASE WHEN n.n IS NULL THEN 'missing' WHEN own.idx IS NULL THEN 'foreign' ELSE 'repeated' END AS issue FROM own FULL OUTER JOIN n ON own.doc_id = n.doc_id AND own.idx = n.idx WHERE n.n IS NULL OR own.idx IS NULL OR n.n > 1""")
stated("set_candidate_merge", "WITH known AS (SELECT DISTINCT p_type || p_size AS form FROM {part} WHERE p_partkey % 2 = 0), new AS (SELECT p_type || p_size AS form, p_brand AS origin FROM {part} WHERE p_partkey % 2 = 1) SELECT new.form, count(DISTINCT origin) AS origins, min(origin) AS first_origin FROM new LEFT JOIN known ON new.form = known.form WHERE known.form IS NULL GROUP BY new.form")
stated("set_uncovered_ranges", """WITH a AS (SELECT doc_id, idx FROM {cues} WHERE idx % 7 NOT IN (2, 3, 5)), m AS (SELECT c.doc_id, c.idx FROM {cues} c LEFT JOIN a ON c.doc_id = a.doc_id AND c.idx = a.idx WHERE a.idx IS NULL GROUP BY c.doc_id, c.idx),
i AS (SELECT doc_id, idx, idx - row_number() OVER (PARTITION BY doc_id ORDER BY idx) AS island FROM m) SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx FROM i GROUP BY doc_id, island""")
stated("set_cover_check", """WITH g AS (SELECT doc_id, idx ~/ 4 AS grp, min(idx) AS a, max(idx) AS b FROM {cues} WHERE idx % 9 <> 8 GROUP BY doc_id, idx ~/ 4), n AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM g), e AS (SELECT doc_id, min(idx) AS first_idx, max(idx) AS last_idx FROM {cues} GROUP BY doc_id)
SELECT e.doc_id, min(a) = min(e.first_idx) AND max(b) = max(e.last_idx) AND bool_and(before IS NULL OR before + 1 = a) AS covered FROM e JOIN n ON e.doc_id = n.doc_id GROUP BY e.doc_id""")
stated("set_opinion_merge", f"""WITH {_C}, mine AS (SELECT {_K}, text FROM c WHERE idx % 3 <> 0), theirs AS (SELECT {_K}, CASE WHEN idx % 5 = 0 THEN upper(text) ELSE text END AS text FROM c WHERE idx % 4 <> 0)
SELECT coalesce(m.doc_id, t.doc_id) AS doc_id, coalesce(m.idx, t.idx) AS idx, coalesce(m.speaker, t.speaker) AS speaker, CASE WHEN t.idx IS NULL THEN 'kept' WHEN m.idx IS NULL THEN 'added' WHEN m.text = t.text THEN 'unchanged' ELSE 'conflict' END AS outcome, coalesce(m.text, t.text) AS text
FROM mine m FULL OUTER JOIN theirs t ON m.doc_id = t.doc_id AND m.idx = t.idx AND m.speaker = t.speaker""")

# --- aggregations ---
stated("agg_span_statistics", """WITH s AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_returnflag AS level, l_partkey % 40 AS a, l_partkey % 40 + CAST(l_quantity AS BIGINT) AS b FROM {lineitem}), x AS (SELECT grp, level, SERIES(a TO b - 1) AS boundary FROM s WHERE b > a)
SELECT grp, count(*) AS covered, count(DISTINCT boundary) AS distinct_covered, count(DISTINCT CASE WHEN level = 'R' THEN boundary END) AS hard, count(DISTINCT level) AS levels FROM x GROUP BY grp""")


@query(None, "agg_span_statistics")
def agg_span_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same without a row a boundary: in order of their starts, each span adds what lies beyond the furthest end before it."""
    a = F.col("l_partkey") % 40
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("grp"), F.col("l_returnflag").alias("level"), a.alias("a"), (a + F.col("l_quantity").cast("long")).alias("b")).where("b > a")
    before = Window.partitionBy("grp").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    hard = F.when(F.col("level") == "R", F.col("b"))
    beyond = lambda end: F.greatest(F.lit(0), F.col("b") - F.greatest("a", F.coalesce(F.max(end).over(before), F.col("a"))))
    own = spans.withColumns({"_new": beyond(F.col("b")), "_hard": F.when(hard.isNotNull(), beyond(hard)).otherwise(0)})
    return own.groupBy("grp").agg(F.sum(F.col("b") - F.col("a")).alias("covered"), F.sum("_new").alias("distinct_covered"), F.sum("_hard").alias("hard"), F.size(F.collect_set("level")).cast("long").alias("levels"))


stated("agg_review_required", f"WITH {_C} SELECT doc_id, sum(CASE WHEN status = 'needs_review' THEN 1 ELSE 0 END) AS needs_review, sum(CASE WHEN status = 'manual_required' THEN 1 ELSE 0 END) AS manual_required, sum(CASE WHEN deleted THEN 0 WHEN status <> 'translated' THEN 1 ELSE 0 END) AS attention FROM c GROUP BY doc_id")
stated("agg_progress_fraction", "WITH s AS (SELECT project_id, count(*) AS planned, sum(CASE WHEN state = 'succeeded' THEN 1 ELSE 0 END) AS done, sum(CASE WHEN state = 'running' THEN 1 ELSE 0 END) AS running FROM {tasks} GROUP BY project_id) SELECT project_id, planned, done, least(greatest(CASE WHEN done = planned THEN 100 WHEN done = 0 THEN least(running, 1) * 10 ELSE 10 + done * 80 ~/ planned END, 0), 100) AS percent FROM s")
stated("creation_status_rollup", """WITH a AS (SELECT o_custkey AS project, max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) AS first_state, max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END) AS second_state, max(o_orderkey % 100) AS raw FROM {orders} GROUP BY o_custkey)
SELECT project, CASE WHEN second_state = 'F' THEN 'ready' WHEN second_state IS NOT NULL THEN 'segmenting' WHEN first_state IS NOT NULL THEN 'transcribing' ELSE 'empty' END AS status, CASE WHEN second_state = 'F' THEN 100 WHEN second_state IS NOT NULL THEN 33 + raw * 66 ~/ 100 ELSE raw * 33 ~/ 100 END AS percent FROM a""")
stated("agg_group_blocks", f"""WITH {_C}, g AS (SELECT doc_id, grp, grp ~/ 3 AS owner, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) AS place FROM c GROUP BY doc_id, grp), o AS (SELECT doc_id, owner, min(place) AS a, max(place) AS b FROM g GROUP BY doc_id, owner)
SELECT o.doc_id, o.owner, g.grp, g.place < o.a OR g.place > o.b AS halo FROM o JOIN g ON o.doc_id = g.doc_id AND g.place BETWEEN o.a - 1 AND o.b + 1""")
