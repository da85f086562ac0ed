"""Range filters, reports, revisions to append, rendered exports and votes, each stated in SQL over the bound entities."""

from __future__ import annotations

from .common_sql import stated

_K = "doc_id, idx, speaker"
_C = "c AS (SELECT doc_id, idx, speaker, text, n_words, start_ms, end_ms, (idx + doc_id) % 7 = 3 AS deleted, idx ~/ 3 AS grp, 'T: ' || replace(text, 'e', '3') AS target FROM {cues})"

# a point meets the ranges of its own bucket only, so the join is on equal keys
stated("filter_in_ranges", """WITH x AS (SELECT event_id, event_id * 37 % 10000 AS place FROM {events}), inc AS (SELECT s_suppkey % 20 AS bucket, min(s_suppkey % 20) * 500 + 50 AS a, min(s_suppkey % 20) * 500 + 350 AS b FROM {supplier} GROUP BY s_suppkey % 20), exc AS (SELECT n_nationkey % 20 AS bucket, (n_nationkey % 20) * 500 + 100 AS a, (n_nationkey % 20) * 500 + 160 AS b FROM {nation} WHERE n_nationkey < 20)
SELECT event_id, place FROM x WHERE EXISTS (SELECT 1 FROM inc WHERE inc.bucket = x.place ~/ 500 AND inc.a <= x.place AND x.place < inc.b) AND NOT EXISTS (SELECT 1 FROM exc WHERE exc.bucket = x.place ~/ 500 AND exc.a <= x.place AND x.place < exc.b)""")
stated("filter_punctuation_only_edit", """WITH e AS (SELECT p_partkey, p_name AS before_text, CASE p_partkey % 5 WHEN 0 THEN upper(p_name) || '.' WHEN 1 THEN p_name || ' more' WHEN 2 THEN ' ' || p_name WHEN 3 THEN '' ELSE p_name || '!' END AS after_text FROM {part})
SELECT p_partkey, after_text <> '' AND after_text = trim(after_text) AND length(after_text) <= length(before_text) + 16 AND lower(replace(replace(after_text, '.', ''), '!', '')) = lower(replace(replace(before_text, '.', ''), '!', '')) AS allowed FROM e""")
stated("agg_median_floor", """WITH m AS (SELECT l_orderkey, median(l_quantity) AS mid FROM {lineitem} GROUP BY l_orderkey), r AS (SELECT l.l_orderkey, l.l_linenumber, row_number() OVER (PARTITION BY l.l_orderkey ORDER BY greatest(l.l_quantity - m.mid, 0) * 2 + abs(l.l_linenumber - 3), l.l_linenumber) AS k, m.mid FROM {lineitem} l JOIN m ON l.l_orderkey = m.l_orderkey)
SELECT l_orderkey, l_linenumber AS quietest, mid FROM r WHERE k = 1""")
stated("win_prefix_energy", "WITH p AS (SELECT event_id, doc_id, idx, sum(conf * conf) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM {units}) SELECT event_id, upto - coalesce(lag(upto, 6) OVER (PARTITION BY doc_id ORDER BY idx), 0) AS energy FROM p")
stated("fn_infer_format", "WITH v AS (SELECT doc_id, count(*) AS n, sum(CASE WHEN text LIKE '%.' THEN 1 ELSE 0 END) AS sentences, sum(CASE WHEN length(text) > 200 THEN 1 ELSE 0 END) AS long_rows FROM {cues} GROUP BY doc_id) SELECT doc_id, CASE WHEN sentences * 100 >= n * 80 THEN 'sentences' WHEN long_rows * 100 >= n * 60 THEN 'paragraphs' ELSE 'mixed' END AS format FROM v")
stated("fn_extract_target", f"WITH t AS (SELECT {_K}, text AS source, CASE WHEN idx % 3 = 0 THEN text || ' | T' ELSE 'T ' || speaker END AS line FROM {{cues}}) SELECT {_K}, CASE WHEN substr(line, 1, length(source)) = source THEN trim(substr(line, length(source) + 1)) ELSE line END AS target FROM t")
stated("join_reference_annotations", f"WITH r AS (SELECT {_K}, pos, CASE pos % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'replaced' ELSE 'uncertain' END AS decision FROM {{words}} WHERE pos % 5 <> 2) SELECT w.doc_id, w.idx, w.speaker, w.pos, r.decision, r.decision IS NULL AS unreferenced FROM {{words}} w LEFT JOIN r ON w.doc_id = r.doc_id AND w.idx = r.idx AND w.speaker = r.speaker AND w.pos = r.pos WHERE NOT w.deleted")
stated("join_reference_report", f"""WITH expected AS (SELECT {_K}, pos FROM {{words}} WHERE pos % 18 = 4), kept AS (SELECT w.* FROM {{words}} w LEFT JOIN expected e ON w.doc_id = e.doc_id AND w.idx = e.idx AND w.speaker = e.speaker AND w.pos = e.pos WHERE NOT w.deleted OR e.pos IS NOT NULL), r AS (SELECT {_K}, pos, 'R' || pos AS text FROM {{words}} WHERE pos % 7 = 2)
SELECT k.doc_id, k.idx, k.speaker, k.pos, coalesce(r.text, k.word) AS text, k.deleted AS hidden FROM kept k LEFT JOIN r ON k.doc_id = r.doc_id AND k.idx = r.idx AND k.speaker = r.speaker AND k.pos = r.pos""")
stated("join_opinion_overlap", """WITH mine AS (SELECT l_orderkey AS cue, l_linenumber AS id, l_partkey % 30 AS a, l_partkey % 30 + 5 AS b FROM {lineitem}), theirs AS (SELECT o_orderkey AS cue, o_orderkey % 9 AS id, o_custkey % 30 AS a, o_custkey % 30 + 4 AS b FROM {orders}),
m AS (SELECT t.cue, t.id, m.id AS mine_id, row_number() OVER (PARTITION BY t.cue, t.id ORDER BY CASE WHEN m.id = t.id THEN 0 ELSE 1 END, m.id) AS k, m.id = t.id AS by_id FROM theirs t JOIN mine m ON m.cue = t.cue AND (m.id = t.id OR m.a < t.b AND t.a < m.b)) SELECT cue, id, mine_id, by_id FROM m WHERE k = 1""")
stated("sink_revision_append", """WITH r AS (SELECT project_id, task_id, row_number() OVER (PARTITION BY project_id ORDER BY created_us, task_id) AS n, lag(task_id) OVER (PARTITION BY project_id ORDER BY created_us, task_id) AS latest, CASE WHEN task_id % 9 = 4 THEN NULL ELSE depends_on END AS expected FROM {tasks})
SELECT project_id, task_id, CASE WHEN task_id % 11 = 7 THEN 'replayed' WHEN expected IS DISTINCT FROM latest THEN 'conflict' ELSE 'appended' END AS outcome, n = 1 OR n % 50 = 0 AS is_snapshot FROM r""")
stated("sink_revision_sequence", "WITH s AS (SELECT project_id, count(*) AS stages, min(task_id) AS first_stage, max(task_id) AS last_stage, max(CASE WHEN state = 'queued' AND task_id % 13 = 0 THEN 1 ELSE 0 END) AS failed FROM {tasks} GROUP BY project_id) SELECT project_id, CASE WHEN failed = 1 THEN 0 ELSE stages END AS committed, first_stage, last_stage FROM s")
_STAMP = "({0} ~/ 360000) || ':' || lpad(CAST({0} ~/ 6000 % 60 AS VARCHAR(9)), 2, '0') || ':' || lpad(CAST({0} ~/ 100 % 60 AS VARCHAR(9)), 2, '0') || '.' || lpad(CAST({0} % 100 AS VARCHAR(9)), 2, '0')"
stated("sink_ass", f"WITH t AS (SELECT {_K}, text, start_ms ~/ 10 AS a, end_ms ~/ 10 AS b FROM {{cues}}) SELECT {_K}, 'Dialogue: 0,' || {_STAMP.format('a')} || ',' || {_STAMP.format('b')} || ',Default,,0,0,0,,' || text AS line FROM t")
stated("sink_fcp_xml", f"WITH t AS (SELECT {_K}, start_ms * 30 ~/ 1001 AS a, end_ms * 30 ~/ 1001 AS b, coalesce(sum(end_ms * 30 ~/ 1001 - start_ms * 30 ~/ 1001) OVER (PARTITION BY doc_id ORDER BY idx, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM {{cues}} WHERE idx % 3 <> 1) SELECT {_K}, '<clipitem><start>' || base || '</start><end>' || (base + b - a) || '</end><in>' || a || '</in><out>' || b || '</out></clipitem>' AS clip FROM t WHERE b > a")
stated("scan_bilingual_corpus", f"WITH {_C} SELECT doc_id, idx, speaker, text AS source, target, 'timed' AS kind, CASE WHEN idx % 4 = 0 THEN 'reviewed' ELSE 'draft' END AS status FROM c WHERE NOT deleted UNION ALL SELECT item_id, 0, 'benchmark', text, upper(substr(text, 1, 1)), 'untimed', 'reference' FROM {{benchmark}}")
stated("dq_translation_atoms", f"WITH {_C}, a AS (SELECT doc_id, grp, idx, idx % 8 = 6 AS lost, idx % 10 = 3 AS twice FROM c) SELECT doc_id, grp, sum(CASE WHEN lost THEN 1 ELSE 0 END) AS missing, sum(CASE WHEN twice THEN 1 ELSE 0 END) AS repeated, sum(CASE WHEN lost OR twice THEN 1 ELSE 0 END) = 0 AS valid FROM a GROUP BY doc_id, grp")
stated("wire_split_plan", """WITH b AS (SELECT doc_id, idx, speaker, pos, end_ms, lead(start_ms) OVER (PARTITION BY doc_id, idx, speaker ORDER BY pos) AS next_start FROM {words} WHERE NOT deleted)
SELECT doc_id, idx, speaker, pos AS boundary, (end_ms + next_start) ~/ 2 AS at_ms, row_number() OVER (PARTITION BY doc_id, idx, speaker ORDER BY pos) AS cue FROM b WHERE pos % 6 = 5 AND next_start IS NOT NULL""")
stated("calibration_inspect", """WITH r AS (SELECT doc_id, idx, speaker, pos, word, CASE pos % 8 WHEN 1 THEN replace(word, 'e', 'E') WHEN 3 THEN word || '.' WHEN 5 THEN 'other' ELSE word END AS said FROM {words} WHERE NOT deleted)
SELECT doc_id, idx, speaker, sum(CASE WHEN said <> word AND lower(said) = lower(word) THEN 1 ELSE 0 END) AS case_only, sum(CASE WHEN said = word || '.' THEN 1 ELSE 0 END) AS marks_only, sum(CASE WHEN lower(said) <> lower(word) AND said <> word || '.' THEN 1 ELSE 0 END) AS replaced FROM r GROUP BY doc_id, idx, speaker""")
stated("agg_tokenization_diag", "WITH d AS (SELECT doc_id, idx, speaker, count(*) AS tokens, sum(length(word)) AS chars, sum(CASE WHEN lower(word) <> upper(word) THEN length(word) ELSE 0 END) AS lettered FROM {words} GROUP BY doc_id, idx, speaker) SELECT doc_id, idx, speaker, tokens, lettered * 1000 ~/ chars AS coverage, lettered * 1000 ~/ chars < 500 AS mismatch FROM d")
