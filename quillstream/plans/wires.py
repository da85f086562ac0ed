"""Requests and replies as rows, timing of fragments, notes, imports and the rules that check plans, each stated in SQL over the bound entities."""

from __future__ import annotations

from .common_sql import stated

_K = "doc_id, idx, speaker"
_W = "(PARTITION BY doc_id, idx, speaker ORDER BY pos)"
_UP = "(PARTITION BY doc_id, idx, speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_C = """c AS (SELECT doc_id, idx, speaker, text, n_words, start_ms, end_ms, (idx + doc_id) % 7 = 3 AS deleted, idx % 5 = 2 AS manual, idx ~/ 3 AS grp, 'T: ' || replace(text, 'e', '3') AS target FROM {cues})"""

# --- requests and replies ---
# own rows and their context of two on both sides, with the furthest word that a line of 55 characters may reach
stated("wire_segment_request", f"""WITH e AS (SELECT *, sum(length(word) + 1) OVER {_UP} AS upto FROM {{words}}), m AS (SELECT a.doc_id, a.idx, a.speaker, a.pos, max(b.pos) AS max_end FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.idx = b.idx AND a.speaker = b.speaker AND b.pos BETWEEN a.pos AND a.pos + 55 AND b.upto - (a.upto - length(a.word) - 1) - 1 <= greatest(55, length(a.word)) GROUP BY a.doc_id, a.idx, a.speaker, a.pos)
SELECT e.doc_id, e.idx, e.speaker, e.pos, CASE WHEN e.pos % 20 BETWEEN 2 AND 17 THEN 'OWN' ELSE 'CONTEXT' END || ' W' || e.pos || ' ' || e.word || ' MAX_END=W' || m.max_end AS line FROM e JOIN m ON e.doc_id = m.doc_id AND e.idx = m.idx AND e.speaker = m.speaker AND e.pos = m.pos""")
stated("wire_cue_request", f"WITH {_C} SELECT doc_id, JOINED('C' || idx || ' | ' || speaker || ' | ' || text SEP '~' BY idx, speaker) AS body, count(*) AS n_rows FROM c WHERE NOT deleted GROUP BY doc_id")
stated("wire_translation_request", f"WITH {_C} SELECT doc_id, grp, JOINED('C' || idx || ' (' || least(length(text), 55) || ') ' || text SEP '~' BY idx, speaker) AS body, sum(least(length(text), 55)) AS room FROM c WHERE NOT deleted GROUP BY doc_id, grp")
stated("wire_units_payload", f"WITH n AS (SELECT *, pos BETWEEN 6 AND 14 AS own FROM {{words}} WHERE pos BETWEEN 3 AND 17) SELECT {_K}, sum(CASE WHEN own THEN 1 ELSE 0 END) AS owned, JOINED(CASE WHEN own THEN word ELSE '(' || word || ')' END SEP ' ' BY pos) AS payload FROM n GROUP BY {_K}")
# replies repeat and miss aliases: the first of a repeated alias wins, missing ones are listed
stated("wire_parse_cue_text", """WITH r AS (SELECT doc_id, idx, speaker, 'C' || idx || CASE WHEN idx % 6 = 5 THEN ' ' ELSE ': ' END || text AS line, idx AS seq FROM {cues} WHERE idx % 5 <> 4 UNION ALL SELECT doc_id, idx, speaker, 'C' || idx || ': again', idx + 1000 FROM {cues} WHERE idx % 7 = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, idx, speaker ORDER BY seq) AS n FROM r WHERE line LIKE 'C%: %'), f AS (SELECT * FROM p WHERE n = 1)
SELECT c.doc_id, c.idx, c.speaker, CASE WHEN f.idx IS NULL THEN 'missing' ELSE 'parsed' END AS outcome, substr(f.line, length('C' || c.idx || ': ') + 1) AS text FROM {cues} c LEFT JOIN f ON c.doc_id = f.doc_id AND c.idx = f.idx AND c.speaker = f.speaker""")
stated("wire_compile_units", """WITH n AS (SELECT doc_id, max(idx) AS top FROM {cues} GROUP BY doc_id), u AS (SELECT doc_id, idx AS first_idx, idx + idx % 3 AS last_idx, 'U' || idx AS unit FROM {cues} WHERE idx % 2 = 0 GROUP BY doc_id, idx), x AS (SELECT doc_id, unit, SERIES(first_idx TO last_idx) AS idx FROM u)
SELECT x.doc_id, x.idx, count(*) AS units, JOINED(x.unit SEP ',' BY x.unit) AS unit_list FROM x JOIN n ON x.doc_id = n.doc_id WHERE x.idx <= n.top GROUP BY x.doc_id, x.idx""")
stated("wire_units_from_plans", """WITH u AS (SELECT doc_id, idx AS first_idx, idx + idx % 3 AS last_idx FROM {cues} WHERE idx % 2 = 0 GROUP BY doc_id, idx), x AS (SELECT doc_id, first_idx, SERIES(first_idx TO last_idx) AS idx FROM u), t AS (SELECT doc_id, idx, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM {cues} GROUP BY doc_id, idx)
SELECT x.doc_id, 'U' || x.first_idx AS unit, min(t.start_ms) AS start_ms, max(t.end_ms) AS end_ms, count(*) AS cues FROM x JOIN t ON x.doc_id = t.doc_id AND x.idx = t.idx GROUP BY x.doc_id, x.first_idx""")
stated("wire_candidate_targets", f"WITH {_C} SELECT doc_id, grp, JOINED(target SEP '~' BY idx, speaker) AS candidate FROM c WHERE NOT deleted AND trim(target) <> '' AND idx % 4 <> 1 GROUP BY doc_id, grp")
stated("wire_error_patch", f"""WITH {_C}, bad AS (SELECT DISTINCT doc_id, grp FROM c WHERE idx % 8 = 5), patch AS (SELECT doc_id, grp, idx, speaker, 'fixed ' || idx AS text FROM c WHERE grp % 2 = 1), whole AS (SELECT p.doc_id, p.grp FROM patch p JOIN bad ON p.doc_id = bad.doc_id AND p.grp = bad.grp GROUP BY p.doc_id, p.grp)
SELECT c.doc_id, c.idx, c.speaker, CASE WHEN w.grp IS NOT NULL THEN 'fixed ' || c.idx WHEN b.grp IS NOT NULL THEN '' ELSE c.text END AS text, b.grp IS NOT NULL AND w.grp IS NULL AS rejected FROM c LEFT JOIN bad b ON c.doc_id = b.doc_id AND c.grp = b.grp LEFT JOIN whole w ON c.doc_id = w.doc_id AND c.grp = w.grp""")
stated("wire_salvage_groups", f"WITH {_C} SELECT doc_id, grp, count(*) AS cues, max(idx) - min(idx) + 1 = count(*) AS contiguous FROM c GROUP BY doc_id, grp HAVING max(length(text)) <= 2000 AND max(CASE WHEN deleted THEN 1 ELSE 0 END) = 0 AND max(idx) - min(idx) + 1 = count(*)")
stated("wire_repair_blocks", f"""WITH {_C}, i AS (SELECT doc_id, grp, 'over_limit' AS issue FROM c WHERE length(target) > 600 UNION SELECT doc_id, grp, 'missing' FROM c WHERE idx % 9 = 4 UNION SELECT doc_id, grp, 'deleted' FROM c WHERE deleted)
SELECT doc_id, grp ~/ 4 AS block, count(DISTINCT grp) AS bad_groups, count(DISTINCT issue) AS kinds, min(issue) AS first_issue FROM i GROUP BY doc_id, grp ~/ 4""")
stated("wire_language_blocks", f"WITH {_C}, b AS (SELECT doc_id, idx, speaker, dense_rank() OVER (PARTITION BY doc_id ORDER BY grp) AS request FROM c WHERE NOT deleted) SELECT doc_id, (request - 1) ~/ 4 AS batch, count(*) AS cues, min(request) AS first_request, max(request) AS last_request FROM b GROUP BY doc_id, (request - 1) ~/ 4")
stated("wire_inspect_prooftranslation", """WITH r AS (SELECT doc_id, idx, speaker, text, CASE WHEN idx % 6 = 2 THEN 'other' ELSE text END AS seen, CASE WHEN idx % 5 = 4 THEN '' ELSE upper(speaker) END AS target FROM {cues} WHERE idx % 7 <> 6), n AS (SELECT doc_id, idx, count(*) AS n FROM r GROUP BY doc_id, idx)
SELECT c.doc_id, c.idx, c.speaker, CASE WHEN r.idx IS NULL THEN 'absent' WHEN n.n > 1 OR r.target = '' THEN 'invalid' WHEN SHA(r.seen) <> SHA(c.text) THEN 'content_changed' ELSE 'applicable' END AS outcome FROM {cues} c LEFT JOIN r ON c.doc_id = r.doc_id AND c.idx = r.idx AND c.speaker = r.speaker LEFT JOIN n ON c.doc_id = n.doc_id AND c.idx = n.idx""")
stated("wire_materialize_presentation", f"WITH {_C}, p AS (SELECT doc_id, idx, speaker, target FROM c WHERE idx % 4 <> 3) SELECT c.doc_id, c.idx, c.speaker, p.target, p.idx IS NULL AS unresolved FROM c LEFT JOIN p ON c.doc_id = p.doc_id AND c.idx = p.idx AND c.speaker = p.speaker WHERE NOT c.deleted")
stated("wire_glossary_preview", "WITH a AS (SELECT lower(p_type) AS form, p_size AS weight, 1 AS rank FROM {part} WHERE p_partkey % 10 = 0 UNION ALL SELECT lower(p_type), p_size, 2 FROM {part} WHERE p_partkey % 10 <> 0), n AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY rank, weight) AS k FROM a) SELECT form, weight, rank = 1 AS temporary FROM n WHERE k = 1")

# --- timing of fragments ---
stated("expand_timed_fragments", """WITH u AS (SELECT event_id, start_ms, end_ms, length(text) AS n, 0 AS zero FROM {units} WHERE end_ms > start_ms), x AS (SELECT *, SERIES(zero TO n - 1) AS k FROM u)
SELECT event_id, k, start_ms + (end_ms - start_ms) * k ~/ n AS part_start, CASE WHEN k = n - 1 THEN end_ms ELSE start_ms + (end_ms - start_ms) * (k + 1) ~/ n END AS part_end FROM x""")
stated("fallback_timing", f"""WITH n AS (SELECT w.*, c.start_ms AS a, c.end_ms AS b, sum(length(word)) OVER (PARTITION BY w.doc_id, w.idx, w.speaker ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(length(word)) OVER (PARTITION BY w.doc_id, w.idx, w.speaker) AS total FROM {{words}} w JOIN {{cues}} c ON w.doc_id = c.doc_id AND w.idx = c.idx AND w.speaker = c.speaker)
SELECT {_K}, pos, a + (b - a) * (upto - length(word)) ~/ total AS word_start, a + (b - a) * upto ~/ total AS word_end FROM n""")
stated("clamp_monotone_timing", f"""WITH j AS (SELECT w.doc_id, w.idx, w.speaker, w.pos, c.start_ms AS a, c.end_ms AS b, w.start_ms + (w.pos * 37 % 5) * 300 - 600 AS s FROM {{words}} w JOIN {{cues}} c ON w.doc_id = c.doc_id AND w.idx = c.idx AND w.speaker = c.speaker),
m AS (SELECT {_K}, pos, a, b, greatest(a, least(b, max(s) OVER {_UP})) AS clamped FROM j) SELECT {_K}, pos, CASE WHEN pos = 0 THEN a ELSE clamped END AS word_start, coalesce(lead(clamped) OVER {_W}, b) AS word_end FROM m""")
# every word of a cue, 150 ms late, meets all of the cue's sentences; Spark finds overlaps in stretches of 3.6 s and the nearest middles on both sides by running bounds
_SENTENCES = f"s AS (SELECT {_K}, pos ~/ 9 AS sentence, min(start_ms) AS a, max(end_ms) AS b FROM {{words}} GROUP BY {_K}, pos ~/ 9), u AS (SELECT {_K}, pos, start_ms + 150 AS s, end_ms + 150 AS e FROM {{words}})"
_ENDS = f"{_K}, pos, sentence, row_number() OVER (PARTITION BY {_K}, sentence ORDER BY pos) = 1 AS first_of, lead(pos) OVER (PARTITION BY {_K}, sentence ORDER BY pos) IS NULL AS last_of"
stated("sentence_by_overlap", f"""WITH {_SENTENCES},
o AS (SELECT u.doc_id, u.idx, u.speaker, u.pos, s.sentence, row_number() OVER (PARTITION BY u.doc_id, u.idx, u.speaker, u.pos ORDER BY CASE WHEN least(u.e, s.b) - greatest(u.s, s.a) > 0 THEN greatest(u.s, s.a) - least(u.e, s.b) ELSE abs(u.s + u.e - s.a - s.b) + 10000000 END, s.sentence) AS k
  FROM u JOIN s ON u.doc_id = s.doc_id AND u.idx = s.idx AND u.speaker = s.speaker)
SELECT {_ENDS} FROM o WHERE k = 1""", f"""WITH {_SENTENCES},
x AS (SELECT *, SERIES(s ~/ 3600 TO e ~/ 3600) AS bin FROM u), y AS (SELECT *, SERIES(a ~/ 3600 TO b ~/ 3600) AS bin FROM s),
o AS (SELECT {_K}, pos, sentence, row_number() OVER (PARTITION BY {_K}, pos ORDER BY least(e, b) - greatest(s, a) DESC, sentence) AS k FROM x JOIN y USING ({_K}, bin) WHERE least(e, b) - greatest(s, a) > 0),
f AS (SELECT {_K}, pos, s + e AS middle FROM u LEFT ANTI JOIN o USING ({_K}, pos)), m AS (SELECT {_K}, a + b AS middle, min(sentence) AS sentence FROM s GROUP BY {_K}, a + b),
z AS (SELECT *, max(CASE WHEN pos IS NULL THEN middle END) OVER (PARTITION BY {_K} ORDER BY middle) AS low, min(CASE WHEN pos IS NULL THEN middle END) OVER (PARTITION BY {_K} ORDER BY middle DESC) AS high FROM (SELECT {_K}, pos, middle FROM f UNION ALL SELECT {_K}, NULL AS pos, middle FROM m) e),
n AS (SELECT {_K}, pos, m.sentence, row_number() OVER (PARTITION BY {_K}, pos ORDER BY abs(at - middle), m.sentence) AS k FROM (SELECT {_K}, pos, middle AS at, low AS middle FROM z WHERE pos IS NOT NULL UNION ALL SELECT {_K}, pos, middle AS at, high AS middle FROM z WHERE pos IS NOT NULL) c JOIN m USING ({_K}, middle))
SELECT {_ENDS} FROM (SELECT {_K}, pos, sentence FROM o WHERE k = 1 UNION ALL SELECT {_K}, pos, sentence FROM n WHERE k = 1) r""")
stated("win_snap_candidates", f"WITH {_C}, n AS (SELECT *, max(end_ms) OVER (PARTITION BY doc_id ORDER BY idx, speaker ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS floor_ms FROM c WHERE NOT deleted) SELECT {_K}, start_ms, greatest(coalesce(floor_ms, 0), start_ms - 300) AS search_from FROM n WHERE NOT manual")
stated("logical_rows", f"""WITH s AS (SELECT {_K}, pos AS a, pos + 2 AS b, 'span ' || pos AS text FROM {{words}} WHERE pos % 8 = 3) SELECT w.doc_id, w.idx, w.speaker, w.pos, coalesce(s.text, w.word) AS text, s.a IS NOT NULL AS canonical
FROM {{words}} w LEFT JOIN s ON w.doc_id = s.doc_id AND w.idx = s.idx AND w.speaker = s.speaker AND w.pos = s.a WHERE NOT (w.pos % 8 IN (4, 5) AND w.pos >= 4)""")
stated("display_token_build", f"""WITH s AS (SELECT {_K}, pos ~/ 4 AS span, 'first' AS source, 1 AS rank FROM {{words}} WHERE pos % 4 = 0 UNION ALL SELECT {_K}, pos ~/ 4, 'second', 2 FROM {{words}} WHERE pos % 12 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY {_K}, span ORDER BY rank DESC) AS k FROM s)
SELECT w.doc_id, w.idx, w.speaker, b.span, max(b.source) AS source, JOINED(w.word SEP ' ' BY w.pos) AS text, count(*) AS tokens FROM {{words}} w JOIN b ON w.doc_id = b.doc_id AND w.idx = b.idx AND w.speaker = b.speaker AND w.pos ~/ 4 = b.span WHERE b.k = 1 GROUP BY w.doc_id, w.idx, w.speaker, b.span""")
stated("split_material", f"WITH n AS (SELECT *, row_number() OVER {_W} AS place, count(*) OVER (PARTITION BY {_K}) AS n FROM {{words}} WHERE NOT deleted) SELECT {_K}, max(n) AS tokens, count(DISTINCT pos) AS different, min(start_ms) AS start_ms, max(end_ms) AS end_ms, SHA(JOINED(pos || ':' || word SEP ' ' BY pos)) AS fingerprint FROM n GROUP BY {_K}")
stated("split_apply", f"""WITH f AS (SELECT *, CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END AS starts FROM {{words}} WHERE NOT deleted), r AS (SELECT *, sum(starts) OVER {_UP} AS cue FROM f)
SELECT {_K}, cue, min(pos) AS first_pos, max(pos) AS last_pos, min(start_ms) AS start_ms, max(end_ms) AS end_ms, JOINED(word SEP ' ' BY pos) AS text FROM r GROUP BY {_K}, cue""")
stated("text_apply_edits", f"""WITH e AS (SELECT {_K}, pos, conf, CASE WHEN pos % 5 = 1 THEN '' WHEN pos % 5 = 3 THEN 'fixed' END AS edit FROM {{words}}), a AS (SELECT w.doc_id, w.idx, w.speaker, w.pos, CASE WHEN e.edit IS NOT NULL AND e.conf >= 50 THEN e.edit ELSE w.word END AS word FROM {{words}} w JOIN e ON w.doc_id = e.doc_id AND w.idx = e.idx AND w.speaker = e.speaker AND w.pos = e.pos)
SELECT {_K}, JOINED(word SEP ' ' BY pos) AS text FROM a WHERE word <> '' GROUP BY {_K}""")
stated("draft_render", f"WITH l AS (SELECT {_K}, pos ~/ 8 AS line, JOINED(word SEP ' ' BY pos) AS text FROM {{words}} GROUP BY {_K}, pos ~/ 8) SELECT {_K}, JOINED(text SEP '~' BY line) AS draft, count(*) AS n_lines FROM l GROUP BY {_K}")
stated("bracket_repair", f"""WITH b AS (SELECT {_K}, pos, word, CASE WHEN pos % 10 = 2 THEN 1 WHEN pos % 10 = 6 THEN -1 ELSE 0 END AS step FROM {{words}}), d AS (SELECT *, sum(step) OVER {_UP} AS depth FROM b)
SELECT {_K}, pos, depth, depth > 0 OR step = -1 AS inside, step = 1 AND max(pos) OVER (PARTITION BY {_K}) < pos + 4 AS unclosed FROM d""")
stated("win_repeat_suffix", "WITH s AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_partkey % 40 AS a, l_partkey % 40 + CAST(l_quantity AS BIGINT) AS b FROM {lineitem}), n AS (SELECT *, lead(a) OVER w AS next_a, lead(id) OVER w AS next_id FROM s WINDOW w AS (PARTITION BY grp ORDER BY a, b, id)) SELECT grp, id, next_id, b AS boundary, next_a - b AS apart FROM n WHERE next_a >= b")

# --- records, notes and imports ---
stated("cancel_request", "SELECT task_id, state, CASE state WHEN 'queued' THEN 'cancelled' WHEN 'running' THEN 'cancelling' ELSE state END AS new_state, state IN ('queued', 'running') AS accepted FROM {tasks} WHERE task_id % 4 = 0")
stated("artifact_register", """WITH a AS (SELECT l_orderkey AS task, l_linenumber AS attempt, l_partkey % 3 AS path, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ~/ 3, l_partkey % 3 ORDER BY l_linenumber) AS k FROM {lineitem})
SELECT a.task, a.attempt, a.path, CASE WHEN o.o_orderstatus = 'F' THEN 'not_owner' WHEN a.k > 1 THEN 'conflict' ELSE 'registered' END AS outcome FROM a JOIN {orders} o ON a.task = o.o_orderkey""")
stated("task_status_projection", "SELECT t.task_id, CASE WHEN t.state = 'succeeded' THEN 'done' WHEN d.state IS NOT NULL AND d.state <> 'succeeded' THEN 'waiting' WHEN t.state = 'running' THEN 'working' ELSE 'ready' END AS status, t.task_type AS kind FROM {tasks} t LEFT JOIN {tasks} d ON t.depends_on = d.task_id")
stated("note_project", f"""WITH n AS (SELECT doc_id, idx, speaker, CASE WHEN idx % 6 = 1 THEN 'old text' ELSE text END AS snapshot FROM {{cues}} WHERE idx % 3 = 1), c AS (SELECT * FROM {{cues}} WHERE idx % 9 <> 7)
SELECT n.doc_id, n.idx, n.speaker, CASE WHEN c.idx IS NULL THEN 'needs_relocation' WHEN c.text = n.snapshot THEN 'current' ELSE 'text_changed' END AS state FROM n LEFT JOIN c ON n.doc_id = c.doc_id AND n.idx = c.idx AND n.speaker = c.speaker""")
stated("note_change", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'resolved' WHEN event_id % 4 = 1 AND event_type = 'error' THEN 'reopened' WHEN event_id % 4 = 2 THEN 'replied' ELSE 'open' END AS status, CASE WHEN event_id % 4 = 2 THEN 1 ELSE 0 END AS replies FROM {events}")
stated("note_upsert", """WITH mine AS (SELECT l_orderkey AS cue, l_linenumber AS token, l_linenumber ~/ 2 AS note FROM {lineitem}), asked AS (SELECT o_orderkey AS cue, o_orderkey % 5 + 1 AS token FROM {orders} WHERE o_orderkey % 3 = 0)
SELECT a.cue, a.token, count(DISTINCT m.note) AS hits, CASE count(DISTINCT m.note) WHEN 0 THEN 'inserted' WHEN 1 THEN 'updated' ELSE 'conflict' END AS outcome FROM asked a LEFT JOIN mine m ON a.cue = m.cue AND m.token BETWEEN a.token AND a.token + 1 GROUP BY a.cue, a.token""")
stated("import_subtitle_document", f"""WITH a AS (SELECT {_K}, start_ms, end_ms, text FROM {{cues}} WHERE idx % 4 <> 3), b AS (SELECT {_K}, start_ms, end_ms, 'T ' || speaker AS target FROM {{cues}} WHERE idx % 5 <> 4)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY start_ms, end_ms, speaker) - 1 AS idx, start_ms, end_ms, text, target FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.speaker, b.speaker) AS speaker, coalesce(a.start_ms, b.start_ms) AS start_ms, coalesce(a.end_ms, b.end_ms) AS end_ms, a.text, b.target FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id AND a.start_ms = b.start_ms AND a.end_ms = b.end_ms AND a.speaker = b.speaker) x""")
stated("import_clean_document", f"WITH e AS (SELECT {_K}, replace(replace(replace(CASE WHEN idx % 6 = 4 THEN '...' ELSE text END, ',', ''), '.', ''), '!', '') AS text FROM {{cues}}) SELECT {_K}, trim(text) AS text, trim(text) = '' AS tombstone FROM e")
stated("import_srt_commit", f"WITH {_C}, p AS (SELECT {_K}, 'imported ' || idx AS target, idx % 3 <> 2 AS importable FROM c) SELECT c.doc_id, c.idx, c.speaker, CASE WHEN p.importable AND NOT c.deleted THEN p.target ELSE c.target END AS target FROM c JOIN p ON c.doc_id = p.doc_id AND c.idx = p.idx AND c.speaker = p.speaker")
stated("glossary_library_normalize", "WITH g AS (SELECT DISTINCT p_brand AS id FROM {part} WHERE p_size % 7 <> 0), e AS (SELECT p_partkey, p_brand, trim(p_name) AS source FROM {part}) SELECT e.p_partkey, e.p_brand, e.source FROM e WHERE e.source <> '' AND length(e.source) <= 200 AND EXISTS (SELECT 1 FROM g WHERE g.id = e.p_brand)")
stated("filter_glossary_active", "WITH allowed AS (SELECT DISTINCT p_brand AS id FROM {part} WHERE p_size > 45) SELECT p.p_partkey, p.p_brand FROM {part} p JOIN allowed a ON p.p_brand = a.id WHERE p.p_size % 2 = 0 AND p.p_partkey % 3 <> 0")
stated("set_hotword_normalize", "WITH n AS (SELECT lower(p_type) AS form, p_size, row_number() OVER (PARTITION BY lower(p_type) ORDER BY p_partkey) AS k FROM {part}), f AS (SELECT form, CASE WHEN p_size BETWEEN 1 AND 5 OR p_size = 50 THEN p_size ELSE 3 END AS weight FROM n WHERE k = 1) SELECT form, CASE WHEN weight = 50 AND row_number() OVER (PARTITION BY weight ORDER BY form) > 2 THEN 5 ELSE weight END AS weight FROM f")
stated("fn_entry_normalize", "SELECT p_partkey, trim(p_name) AS source, CASE WHEN p_type LIKE '%BRASS%' THEN 'term' WHEN p_type LIKE '%STEEL%' THEN 'name' ELSE 'other' END AS kind, least(greatest(p_size ~/ 8, 1), 5) AS weight FROM {part}")
stated("style_apply", f"WITH {_C}, a AS (SELECT {_K}, CASE WHEN idx % 6 = 0 THEN 'bold' WHEN idx % 6 = 3 THEN NULL ELSE 'plain' END AS style FROM c), u AS (SELECT style, count(*) AS used FROM a WHERE style IS NOT NULL GROUP BY style) SELECT a.doc_id, a.idx, a.speaker, a.style, u.used FROM a LEFT JOIN u ON a.style = u.style")
stated("organize_apply", """WITH now AS (SELECT doc_id, idx AS b FROM {cues} WHERE idx % 3 = 0 GROUP BY doc_id, idx), want AS (SELECT doc_id, idx AS b FROM {cues} WHERE idx % 4 = 0 GROUP BY doc_id, idx)
SELECT coalesce(n.doc_id, w.doc_id) AS doc_id, coalesce(n.b, w.b) AS boundary, CASE WHEN w.b IS NULL THEN 'merge' ELSE 'split' END AS step FROM now n FULL OUTER JOIN want w ON n.doc_id = w.doc_id AND n.b = w.b WHERE n.b IS NULL OR w.b IS NULL""")
stated("corpus_record", f"WITH {_C} SELECT doc_id, grp, 'rec_' || substr(SHA(doc_id || ':' || grp), 1, 16) AS record_id, JOINED(text SEP ' ' BY idx, speaker) AS source, JOINED(target SEP ' ' BY idx, speaker) AS target FROM c WHERE NOT deleted GROUP BY doc_id, grp")
stated("log_recover_latest", "WITH l AS (SELECT user_id % 20 AS block, event_id, CASE WHEN event_id % 6 = 5 THEN 'broken' ELSE props END AS line FROM {events}), n AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY event_id DESC) AS k FROM l WHERE line <> 'broken') SELECT block, event_id, line AS response FROM n WHERE k = 1")
stated("language_policy_resolve", "WITH s AS (SELECT source, count(*) AS docs, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS english FROM {documents} GROUP BY source) SELECT source, CASE WHEN english * 100 >= docs * 80 THEN 'en' WHEN english * 100 >= docs * 20 THEN 'mixed' ELSE 'other' END AS policy, CASE WHEN english * 100 >= docs * 80 THEN 55 WHEN english * 100 >= docs * 20 THEN 25 ELSE 60 END AS most_chars FROM s")

# --- rules ---
stated("dq_plan_structure", f"""WITH {_C}, g AS (SELECT doc_id, grp, min(idx) AS a, max(idx) AS b, count(DISTINCT idx) AS n FROM c WHERE idx % 5 <> 3 GROUP BY doc_id, grp), p AS (SELECT *, lag(b) OVER (PARTITION BY doc_id ORDER BY a) AS before, row_number() OVER (PARTITION BY doc_id ORDER BY a) - 1 AS number FROM g)
SELECT doc_id, grp, 'gap' AS issue FROM p WHERE before IS NOT NULL AND before + 1 <> a UNION ALL SELECT doc_id, grp, 'hole' FROM p WHERE b - a + 1 <> n UNION ALL SELECT doc_id, grp, 'number' FROM p WHERE number <> grp UNION ALL SELECT doc_id, grp, 'late_start' FROM p WHERE before IS NULL AND a > 0""")
stated("dq_semantic_notices", f"WITH {_C} SELECT doc_id, grp, sum(length(text) - length(replace(text, '.', ''))) AS sentence_marks, count(DISTINCT speaker) AS centers FROM c WHERE NOT deleted GROUP BY doc_id, grp HAVING sum(length(text) - length(replace(text, '.', ''))) > 1 OR count(DISTINCT speaker) >= 3")
stated("dq_cue_quality", f"""WITH {_C}, n AS (SELECT *, lead(text) OVER (PARTITION BY doc_id ORDER BY idx, speaker) AS after FROM c WHERE NOT deleted) SELECT {_K}, 'short' AS issue FROM n WHERE n_words < 3 UNION ALL SELECT {_K}, 'brief' FROM n WHERE end_ms - start_ms < 800 UNION ALL SELECT {_K}, 'dangling' FROM n WHERE lower(text) LIKE '% the' OR lower(text) LIKE '% and'
UNION ALL SELECT {_K}, 'crossed_sentence' FROM n WHERE text LIKE '%. %' AND text NOT LIKE '%.' UNION ALL SELECT {_K}, 'repeated' FROM n WHERE text = after UNION ALL SELECT {_K}, 'over_limit' FROM n WHERE length(text) > 400""")
stated("dq_direct_plan", f"""WITH {_C}, i AS (SELECT doc_id, 'over_limit' AS issue FROM c WHERE length(text) > 400 UNION ALL SELECT doc_id, 'deleted' FROM c WHERE deleted UNION ALL SELECT doc_id, 'low_confidence' FROM c WHERE idx * 7 % 100 < 20) SELECT doc_id, count(*) AS issues, count(DISTINCT issue) AS kinds, sum(CASE WHEN issue = 'over_limit' THEN 1 ELSE 0 END) = 0 AS passes FROM i GROUP BY doc_id""")
stated("dq_segmentation_wire", f"""WITH r AS (SELECT {_K}, pos ~/ 6 AS row_no, min(pos) AS a, max(pos) AS b FROM {{words}} WHERE pos % 17 <> 12 GROUP BY {_K}, pos ~/ 6), n AS (SELECT *, lag(b) OVER (PARTITION BY {_K} ORDER BY row_no) AS before FROM r), m AS (SELECT {_K}, max(pos) AS top FROM {{words}} GROUP BY {_K})
SELECT n.doc_id, n.idx, n.speaker, bool_and(before IS NULL OR before + 1 = a) AND min(a) = 0 AND max(b) = max(m.top) AS covered FROM n JOIN m ON n.doc_id = m.doc_id AND n.idx = m.idx AND n.speaker = m.speaker GROUP BY n.doc_id, n.idx, n.speaker""")
stated("dq_plan_hard_errors", """WITH s AS (SELECT l_orderkey AS grp, l_linenumber AS id, l_returnflag AS level, l_partkey % 40 AS a, l_partkey % 40 + CAST(l_quantity AS BIGINT) AS b FROM {lineitem}), cut AS (SELECT o_orderkey AS grp, o_custkey % 60 AS at FROM {orders})
SELECT cut.grp, s.id, cut.at FROM cut JOIN s ON cut.grp = s.grp AND s.a < cut.at AND cut.at < s.b WHERE s.level = 'R'""")
stated("dq_canonicalization", f"""WITH r AS (SELECT {_K}, pos AS a, pos + pos % 3 AS b, word AS text FROM {{words}} WHERE pos % 4 = 1), n AS (SELECT *, lag(b) OVER (PARTITION BY {_K} ORDER BY a) AS before FROM r) SELECT {_K}, a, CASE WHEN before >= a THEN 'overlap' WHEN length(text) = 1 THEN 'single_letter' WHEN b > a + 1 THEN 'too_wide' ELSE 'legal' END AS verdict FROM n""")
stated("dq_source_tokens", f"""WITH t AS (SELECT {_K}, pos, word, lag(pos) OVER {_W} AS before, 'tok_' || substr(SHA(doc_id || ':' || idx || ':' || pos), 1, 12) AS own_id, CASE WHEN pos % 10 = 9 THEN 'tok_stale' ELSE 'tok_' || substr(SHA(doc_id || ':' || idx || ':' || pos), 1, 12) END AS given_id FROM {{words}} WHERE pos % 13 <> 7)
SELECT {_K}, pos, CASE WHEN word = '' THEN 'empty' WHEN before + 1 <> pos THEN 'not_contiguous' ELSE 'stale_id' END AS issue FROM t WHERE word = '' OR before + 1 <> pos OR own_id <> given_id""")
stated("dq_grouping_result", f"WITH {_C}, g AS (SELECT doc_id, grp, count(*) AS n, sum(length(text)) AS chars, max(CASE WHEN deleted THEN 1 ELSE 0 END) AS foreign_rows FROM c GROUP BY doc_id, grp) SELECT doc_id, grp, n > 0 AND foreign_rows = 0 AS bound, chars <= 1200 AS within_limit FROM g")
stated("dq_presentation_plan", f"""WITH u AS (SELECT doc_id, idx ~/ 3 AS grp, 'U' || (idx - idx % 2) AS unit, idx FROM {{cues}}), n AS (SELECT doc_id, grp, unit, min(idx) AS a, max(idx) AS b, count(*) AS n FROM u GROUP BY doc_id, grp, unit), o AS (SELECT *, lag(b) OVER (PARTITION BY doc_id, grp ORDER BY a) AS before FROM n)
SELECT doc_id, grp, count(*) AS units, bool_and(before IS NULL OR before < a) AS ordered, count(DISTINCT unit) = count(*) AS unique_units FROM o GROUP BY doc_id, grp""")
stated("dq_target_clause", f"WITH {_C} SELECT {_K}, target LIKE '%. %' AS several, target LIKE '%,' OR target LIKE '%;' AS open_clause, lower(target) LIKE '% the' OR lower(target) LIKE '% and' AS dangling, upper(trim(target)) IN ('SKIP', 'NONE', 'N/A') AS control FROM c")
stated("dq_overflow_scope", f"""WITH {_C}, first_try AS (SELECT doc_id, grp, count(*) AS breaks, max(length(text)) > 400 AS affected FROM c GROUP BY doc_id, grp), repaired AS (SELECT doc_id, grp, breaks + CASE WHEN affected AND grp % 3 <> 2 THEN 1 WHEN grp % 5 = 4 THEN 1 ELSE 0 END AS breaks, affected FROM first_try)
SELECT f.doc_id, f.grp, CASE WHEN f.affected AND r.breaks <= f.breaks THEN 'no_break_added' WHEN NOT f.affected AND r.breaks <> f.breaks THEN 'unaffected_changed' ELSE 'legal' END AS verdict FROM first_try f JOIN repaired r ON f.doc_id = r.doc_id AND f.grp = r.grp""")
