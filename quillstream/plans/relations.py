"""Joins and aggregations on timed text: bands, overlaps, lineage, coverage and levels of arrays."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as ivl
from .bindings import CUES, UNITS, cues, table, units
from .registry import by_doc, query

HOUR = 3600000


def _blocks(spark, sf_dir):
    return units(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 5).alias("block")).agg(F.collect_list("event_id").alias("ids"))


@query(f"WITH {UNITS} SELECT doc_id, idx // 5 AS block, event_id, start_ms FROM units")
def join_lineage_equi(spark, sf_dir):
    """Blocks hold arrays of unit ids; the arrays are exploded and joined with the units on the id."""
    own = _blocks(spark, sf_dir).select("doc_id", "block", F.explode("ids").alias("event_id"))
    return own.join(units(spark, sf_dir).select("event_id", "start_ms"), "event_id").select("doc_id", "block", "event_id", "start_ms")


@query(f"WITH {UNITS} SELECT doc_id, idx // 5 AS block, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM units WHERE conf >= 10 GROUP BY 1, 2")
def project_source_bounds(spark, sf_dir):
    """Envelope of the active units that a block's id list names."""
    own = _blocks(spark, sf_dir).select("doc_id", "block", F.explode("ids").alias("event_id"))
    active = units(spark, sf_dir).where("conf >= 10").select("event_id", "start_ms", "end_ms")
    return own.join(active, "event_id").groupBy("doc_id", "block").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))


@query(rf"WITH {CUES}, w AS (SELECT doc_id, idx, speaker, regexp_extract_all(text, '[^\s]+') AS w FROM cues) SELECT doc_id, idx, speaker, CAST(p AS BIGINT) - 1 AS pos, w[p] AS token FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM w)")
def join_cue_token(spark, sf_dir):
    got = cues(spark, sf_dir).select("doc_id", "idx", "speaker", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("pos", "token"))
    return got.withColumn("pos", F.col("pos").cast("long"))


_KEPT = f"k AS (SELECT DISTINCT doc_id, start_ms // {6 * HOUR} * {6 * HOUR} AS a, start_ms // {6 * HOUR} * {6 * HOUR} + {3 * HOUR} AS b FROM units)"


def _kept(u):
    a = F.floor(F.col("start_ms") / (6 * HOUR)) * 6 * HOUR
    return u.select("doc_id", a.alias("a"), (a + 3 * HOUR).alias("b")).distinct()


@query(f"WITH {UNITS}, {_KEPT} SELECT u.event_id, k.a AS keep_ms, greatest(u.start_ms, k.a) AS start_ms, least(u.end_ms, k.b) AS end_ms FROM units u JOIN k ON u.doc_id = k.doc_id AND u.start_ms < k.b AND u.end_ms > k.a")
def join_halfopen_overlap(spark, sf_dir):
    """Parts of the units inside the kept intervals."""
    u = units(spark, sf_dir)
    hit = ivl.overlaps(u, _kept(u).withColumnRenamed("a", "start_ms").withColumnRenamed("b", "end_ms"), ["doc_id"], 6 * HOUR)
    return hit.select("event_id", F.col("o_start_ms").alias("keep_ms"), F.greatest("start_ms", "o_start_ms").alias("start_ms"), F.least("end_ms", "o_end_ms").alias("end_ms"))


@query(f"WITH {UNITS}, {_KEPT}, n AS (SELECT *, coalesce(CAST(sum(b - a) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS off FROM k) SELECT u.event_id, n.off + greatest(u.start_ms, n.a) - n.a AS start_ms, n.off + least(u.end_ms, n.b) - n.a AS end_ms FROM units u JOIN n ON u.doc_id = n.doc_id AND u.start_ms < n.b AND u.end_ms > n.a")
def project_range(spark, sf_dir):
    """Units on the output clock, which runs through the kept intervals only; a unit may give several parts."""
    u = units(spark, sf_dir)
    before = Window.partitionBy("doc_id").orderBy("a").rowsBetween(Window.unboundedPreceding, -1)
    keep = _kept(u).withColumn("offset", F.coalesce(F.sum(F.col("b") - F.col("a")).over(before), F.lit(0)))
    hit = ivl.overlaps(u, keep.select("doc_id", F.col("a").alias("start_ms"), F.col("b").alias("end_ms"), "offset"), ["doc_id"], 6 * HOUR)
    on = lambda c: F.col("o_offset") + c - F.col("o_start_ms")
    return hit.select("event_id", on(F.greatest("start_ms", "o_start_ms")).alias("start_ms"), on(F.least("end_ms", "o_end_ms")).alias("end_ms"))


@query(f"WITH {UNITS} SELECT u.event_id, count(v.event_id) AS n, min(v.event_id) AS first_id FROM units u LEFT JOIN units v ON u.doc_id = v.doc_id AND u.speaker = v.speaker AND u.event_id <> v.event_id AND u.start_ms < v.end_ms AND v.start_ms < u.end_ms GROUP BY 1")
def join_evidence_window(spark, sf_dir):
    """Units of the same document and speaker that overlap each unit in time."""
    u = units(spark, sf_dir).select("doc_id", "speaker", "event_id", "start_ms", "end_ms")
    hit = ivl.overlaps(u, u, ["doc_id", "speaker"], 6 * HOUR).where("event_id <> o_event_id").groupBy("event_id").agg(F.count("*").alias("n"), F.min("o_event_id").alias("first_id"))
    return u.select("event_id").join(hit, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), "first_id")


@query(f"WITH {UNITS} SELECT u.event_id, count(v.event_id) AS n, CASE WHEN count(v.event_id) = 1 THEN min(v.event_id) END AS match_id FROM units u LEFT JOIN units v ON u.doc_id = v.doc_id AND v.text = 'purchase' AND abs(u.start_ms - v.start_ms) <= {HOUR} WHERE u.text = 'view' GROUP BY 1")
def join_band_120ms(spark, sf_dir):
    """Rows of two tracks whose starts lie within a tolerance; only a single partner counts as a match."""
    u = units(spark, sf_dir).select("doc_id", "event_id", "start_ms", "text")
    a = u.where("text = 'view'")
    hit = ivl.band(a, u.where("text = 'purchase'"), ["doc_id"], HOUR).groupBy("event_id").agg(F.count("*").alias("n"), F.min("o_event_id").alias("m"))
    return a.join(hit, "event_id", "left").select("event_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") == 1, F.col("m")).alias("match_id"))


@query(f"WITH {UNITS}, p AS (SELECT * FROM units WHERE text = 'purchase') SELECT u.event_id, arg_min(p.event_id, struct_pack(d := abs(u.start_ms - p.start_ms), i := p.idx)) AS nearest_id FROM units u LEFT JOIN p ON p.doc_id = u.doc_id WHERE u.text <> 'purchase' GROUP BY 1")
def join_nearest(spark, sf_dir):
    """The nearest purchase of each other unit: the last one before and the first one after it, by two windows and no join."""
    u = units(spark, sf_dir)
    at = F.when(F.col("text") == "purchase", F.struct("start_ms", "idx", "event_id"))
    order = Window.partitionBy("doc_id").orderBy("start_ms", "idx")
    last = F.last(at, True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(at, True).over(order.rowsBetween(1, Window.unboundedFollowing))
    near = lambda p: F.when(p.isNotNull(), F.struct(F.abs(F.col("start_ms") - p["start_ms"]).alias("d"), p["idx"].alias("i"), p["event_id"].alias("id")))
    got = u.withColumns({"_a": last, "_b": first}).where("text <> 'purchase'")
    return got.select("event_id", F.least(near(F.col("_a")), near(F.col("_b")))["id"].alias("nearest_id"))


@query(f"WITH {UNITS} SELECT u.event_id FROM units u WHERE EXISTS (SELECT 1 FROM units v WHERE v.doc_id = u.doc_id AND v.text = 'error' AND abs(v.idx - u.idx) <= 2)")
def join_tolerance_any(spark, sf_dir):
    near = F.max((F.col("text") == "error").cast("int")).over(by_doc().rowsBetween(-2, 2))
    return units(spark, sf_dir).withColumn("_near", near).where("_near = 1").select("event_id")


_RANGES = "a AS (SELECT doc_id, idx AS x, idx + 3 AS y FROM units WHERE idx % 5 = 0), b AS (SELECT doc_id, idx - 1 AS x, idx + 1 AS y FROM units WHERE idx % 7 = 0)"


@query(f"WITH {UNITS}, {_RANGES} SELECT a.doc_id, a.x AS first_idx, array_to_string(list(b.x + 1 ORDER BY b.x), ',') AS ids FROM a JOIN b ON a.doc_id = b.doc_id AND a.x <= b.y AND b.x <= a.y GROUP BY 1, 2")
def join_index_overlap(spark, sf_dir):
    """Closed index ranges that overlap: both sides are exploded to positions, so the join has equal keys only."""
    u = units(spark, sf_dir)
    a = u.where("idx % 5 = 0").select("doc_id", F.col("idx").alias("first_idx"), F.explode(F.expr("sequence(idx, idx + 3)")).alias("p"))
    b = u.where("idx % 7 = 0").select("doc_id", F.col("idx").alias("id"), F.explode(F.expr("sequence(idx - 1, idx + 1)")).alias("p"))
    return a.join(b, ["doc_id", "p"]).groupBy("doc_id", "first_idx").agg(F.array_join(F.sort_array(F.collect_set("id")).cast("array<string>"), ",").alias("ids"))


@query(f"WITH {UNITS}, g AS (SELECT doc_id, idx // 5 AS block, min(start_ms) AS a, max(end_ms) AS b FROM units GROUP BY 1, 2) SELECT u.event_id, min(g.block) AS block FROM units u JOIN g ON g.doc_id = u.doc_id AND g.a <= u.start_ms AND u.end_ms <= g.b GROUP BY 1")
def join_covering_group(spark, sf_dir):
    """The first block whose envelope holds the whole unit."""
    u = units(spark, sf_dir)
    g = u.groupBy("doc_id", F.floor(F.col("idx") / 5).alias("block")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    hit = ivl.covers(u, g, ["doc_id"], 24 * HOUR)
    return hit.groupBy("event_id").agg(F.min("o_block").alias("block"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, n_name) AS style, coalesce(CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END, n_regionkey) AS layer FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def join_style_resolve(spark, sf_dir):
    """Per-row settings laid over a default profile."""
    n = F.broadcast(table(spark, sf_dir, "nation"))  # 25 rows by the schema's definition
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return c.select("c_custkey", F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), "n_name").alias("style"), F.coalesce(F.when(F.col("c_custkey") % 3 == 0, F.col("c_nationkey")), "n_regionkey").alias("layer"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'manual_required' WHEN l.quality = 1 THEN 'accepted' ELSE 'needs_review' END AS status FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_accepted_rows(spark, sf_dir):
    j = table(spark, sf_dir, "documents").select("doc_id").join(table(spark, sf_dir, "labels").select("doc_id", "quality", F.lit(True).alias("known")), "doc_id", "left")
    return j.select("doc_id", F.when(F.col("known").isNull(), "manual_required").when(F.col("quality") == 1, "accepted").otherwise("needs_review").alias("status"))


@query(f"WITH {UNITS}, m AS (SELECT *, idx // 5 AS block, lag(text) OVER (PARTITION BY doc_id, idx // 5 ORDER BY idx) AS p FROM units) SELECT doc_id, block, string_agg(text, ' ' ORDER BY idx) AS target FROM m WHERE p IS DISTINCT FROM text GROUP BY 1, 2")
def join_translation_lineage(spark, sf_dir):
    """Texts of a block in order, without consecutive repeats."""
    m = units(spark, sf_dir).withColumn("block", F.floor(F.col("idx") / 5))
    m = m.withColumn("_p", F.lag("text").over(Window.partitionBy("doc_id", "block").orderBy("idx"))).where("NOT (_p <=> text)")
    return m.groupBy("doc_id", "block").agg(F.array_join(F.array_sort(F.collect_list(F.struct("idx", "text")))["text"], " ").alias("target"))


@query("SELECT user_id, count(*) AS calls, count(DISTINCT sha256(props)) AS prompts, CAST(sum(length(props)) AS BIGINT) AS chars, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS failed, epoch_us(max(ts)) - epoch_us(min(ts)) AS wall_us FROM events GROUP BY 1")
def agg_usage_by_task(spark, sf_dir):
    wall = F.timestamp_diff("MICROSECOND", F.min("ts"), F.max("ts"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("calls"), F.countDistinct("props").alias("prompts"), F.sum(F.length("props")).alias("chars"), F.count_if(F.col("event_type") == "error").alias("failed"), wall.alias("wall_us"))


@query("SELECT lang, count(*) AS n, CAST(max(length(text)) AS BIGINT) AS longest, count(*) FILTER (length(text) BETWEEN 1000 AND 2000) AS soft, count(*) FILTER (length(text) > 2000) AS hard FROM documents GROUP BY 1")
def agg_line_stats(spark, sf_dir):
    n = F.length("text")
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.max(n).cast("long").alias("longest"), F.count_if(n.between(1000, 2000)).alias("soft"), F.count_if(n > 2000).alias("hard"))


@query(r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents WHERE text IS NOT NULL), g AS (SELECT doc_id, len(w) AS n, unnest(range(1, greatest(len(w) - 6, 1))) AS i, w FROM w), r AS (SELECT doc_id, count(DISTINCT array_to_string(list_slice(w, i, i + 7), ' ')) AS d, count(*) AS c FROM g GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, round(1 - coalesce(d, 1) / coalesce(c, 1)::DOUBLE, 6) AS repeated, len(w) < 20 AS short FROM w LEFT JOIN r USING (doc_id)""")
def agg_transcript_quality(spark, sf_dir):
    """Words and the share of repeated 8-grams of each document; the grams stay in the row."""
    w = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)).alias("w"))
    grams = F.when(F.size("w") >= 8, F.transform(F.sequence(F.lit(1), F.size("w") - 7), lambda i: F.xxhash64(F.array_join(F.slice("w", i, 8), " "))))
    g = w.select("doc_id", F.size("w").cast("long").alias("n_words"), grams.alias("g"))
    return g.select("doc_id", "n_words", F.round(F.coalesce(1 - F.size(F.array_distinct("g")) / F.size("g"), F.lit(0.0)), 6).alias("repeated"), (F.col("n_words") < 20).alias("short"))


@query("SELECT l_orderkey, max(l_linestatus) AS status, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 3 AND count(DISTINCT l_linestatus) = 1")
def agg_lexical_consensus(spark, sf_dir):
    """Keys whose observations all agree; equal extremes say so without a distinct count."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.max("l_linestatus").alias("status"), F.min("l_linestatus").alias("_low"), F.count("*").alias("n"))
    return g.where("n >= 3 AND status = _low").drop("_low")


@query(r"""WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{3040}-\x{30FF}]')) AS ja, len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]')) AS zh, len(regexp_extract_all(text, '[\x{AC00}-\x{D7AF}]')) AS ko, len(regexp_extract_all(text, '[A-Za-z]')) AS en FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN greatest(ja, zh, ko, en) = 0 THEN 'other' WHEN ja = 0 AND zh >= greatest(en, ko) THEN 'zh' WHEN en >= greatest(CASE WHEN ja > 0 THEN ja + zh ELSE 0 END, ko) THEN 'en' WHEN ja > 0 AND ja + zh >= ko THEN 'ja' ELSE 'ko' END AS primary_script, CAST(en AS BIGINT) AS latin FROM c""")
def agg_script_ratio(spark, sf_dir):
    """The script with most letters, ties in the order zh, en, ja, ko; Han letters count as Japanese where there is kana."""
    n = lambda p: F.regexp_count("text", F.lit(p))
    c = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", n(r"[\x{3040}-\x{30FF}]").alias("kana"), n(r"[\x{3400}-\x{9FFF}]").alias("han"), n(r"[\x{AC00}-\x{D7AF}]").alias("ko"), n("[A-Za-z]").alias("en"))
    ja, zh = F.when(F.col("kana") > 0, F.col("kana") + F.col("han")).otherwise(0), F.when(F.col("kana") > 0, 0).otherwise(F.col("han"))
    best = F.greatest(zh, "en", ja, "ko")
    name = F.when(best == 0, "other").when(zh == best, "zh").when(F.col("en") == best, "en").when(ja == best, "ja").otherwise("ko")
    return c.select("doc_id", name.alias("primary_script"), F.col("en").cast("long").alias("latin"))


@query(f"WITH {UNITS}, m AS (SELECT *, CASE WHEN text IS DISTINCT FROM lag(text) OVER w THEN 1 ELSE 0 END AS b FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY idx)), r AS (SELECT *, sum(b) OVER (PARTITION BY doc_id ORDER BY idx) AS seg FROM m), s AS (SELECT doc_id, seg, max(CASE WHEN conf >= 75 THEN 1 ELSE 0 END) AS ok FROM r GROUP BY 1, 2) SELECT doc_id, count(*) AS segments, round(avg(ok), 6) AS coverage FROM s GROUP BY 1")
def agg_segment_coverage(spark, sf_dir):
    """Share of segments (runs of equal text) with a trusted unit."""
    m = units(spark, sf_dir).withColumn("_b", F.when(F.lag("text").over(by_doc()).eqNullSafe(F.col("text")), 0).otherwise(1))
    m = m.withColumn("seg", F.sum("_b").over(by_doc().rowsBetween(Window.unboundedPreceding, 0)))
    s = m.groupBy("doc_id", "seg").agg(F.max((F.col("conf") >= 75).cast("int")).alias("ok"))
    return s.groupBy("doc_id").agg(F.count("*").alias("segments"), F.round(F.avg("ok"), 6).alias("coverage"))


_LEVELS = "e AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings)"


def _levels(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v")).select("vec_id", "i", F.col("v").cast("double").alias("v"))


@query(f"WITH {_LEVELS}, b AS (SELECT vec_id, CAST(i // 8 AS BIGINT) AS bucket, sqrt(avg(v * v)) AS rms FROM e GROUP BY 1, 2) SELECT vec_id, bucket, round(avg(rms) OVER (PARTITION BY vec_id ORDER BY bucket ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 6) AS level FROM b")
def agg_rms_bucket(spark, sf_dir):
    b = _levels(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 8).alias("bucket")).agg(F.sqrt(F.avg(F.col("v") * F.col("v"))).alias("rms"))
    return b.select("vec_id", "bucket", F.round(F.avg("rms").over(Window.partitionBy("vec_id").orderBy("bucket").rowsBetween(-1, 1)), 6).alias("level"))


@query(f"WITH {_LEVELS} SELECT vec_id, CAST(i // 32 AS BIGINT) AS bucket, round(max(abs(v)), 4) AS peak FROM e GROUP BY 1, 2")
def agg_peak_reaggregate(spark, sf_dir):
    """Peaks of fine buckets aggregated again to coarse ones."""
    fine = _levels(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 8).alias("fine")).agg(F.max(F.abs("v")).alias("peak"))
    return fine.groupBy("vec_id", F.floor(F.col("fine") / 4).alias("bucket")).agg(F.round(F.max("peak"), 4).alias("peak"))


@query(f"WITH {_LEVELS} SELECT vec_id, CAST(i // 8 AS BIGINT) AS bucket, CAST(greatest(-127, least(127, floor(min(v) * 127))) AS BIGINT) AS low, CAST(greatest(-127, least(127, ceil(max(v) * 127))) AS BIGINT) AS high FROM e GROUP BY 1, 2")
def agg_minmax_i8(spark, sf_dir):
    clamp = lambda c: F.greatest(F.lit(-127), F.least(F.lit(127), c)).cast("long")
    return _levels(spark, sf_dir).groupBy("vec_id", F.floor(F.col("i") / 8).alias("bucket")).agg(clamp(F.floor(F.min("v") * 127)).alias("low"), clamp(F.ceil(F.max("v") * 127)).alias("high"))


@query(f"WITH {UNITS}, r AS (SELECT doc_id, conf, row_number() OVER (PARTITION BY doc_id ORDER BY conf) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM units) SELECT doc_id, max(conf) AS p90 FROM r WHERE k = CAST(floor(n * 0.9::DOUBLE) AS BIGINT) + 1 GROUP BY 1")
def agg_percentile_nearest(spark, sf_dir):
    """Nearest-rank percentile; equal values are counted first, so a group's state is its distinct values."""
    n = units(spark, sf_dir).groupBy("doc_id", "conf").agg(F.count("*").alias("c"))
    order = Window.partitionBy("doc_id").orderBy("conf")
    r = n.withColumns({"_upto": F.sum("c").over(order), "_all": F.sum("c").over(Window.partitionBy("doc_id"))})
    return r.where(F.col("_upto") >= F.floor(F.col("_all") * F.lit(0.9)) + 1).groupBy("doc_id").agg(F.min("conf").alias("p90"))


@query("SELECT user_id, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, CASE WHEN sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) > 0 THEN 'failed' WHEN sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) > 0 THEN 'done' ELSE 'running' END AS status FROM events GROUP BY 1")
def agg_stage_progress(spark, sf_dir):
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    return table(spark, sf_dir, "events").groupBy("user_id").agg(n("click").alias("clicks"), n("error").alias("errors"), F.when(n("error") > 0, "failed").when(n("purchase") > 0, "done").otherwise("running").alias("status"))


@query(f"WITH {UNITS} SELECT doc_id, idx // 4 AS unit, string_agg(text, chr(10) ORDER BY start_ms, event_id) AS target, max(CASE WHEN conf < 20 THEN 1 ELSE 0 END) = 1 AS needs_review FROM units GROUP BY 1, 2")
def agg_unit_target_text(spark, sf_dir):
    texts = F.array_sort(F.collect_list(F.struct("start_ms", "event_id", "text")))["text"]
    return units(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 4).alias("unit")).agg(F.array_join(texts, "\n").alias("target"), F.bool_or(F.col("conf") < 20).alias("needs_review"))


@query("SELECT source, count(*) AS documents, CAST(sum(strlen(text)) AS BIGINT) AS bytes, CAST(max(strlen(text)) AS BIGINT) AS largest FROM documents GROUP BY 1")
def agg_storage_sizes(spark, sf_dir):
    size = F.octet_length("text")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("documents"), F.sum(size).alias("bytes"), F.max(size).cast("long").alias("largest"))


_CUTS = "r AS (SELECT DISTINCT doc_id, idx FROM units WHERE conf >= 60), c AS (SELECT DISTINCT doc_id, idx FROM units WHERE text IN ('error', 'view'))"


@query(f"WITH {UNITS}, {_CUTS}, m AS (SELECT coalesce(r.doc_id, c.doc_id) AS doc_id, CASE WHEN r.idx IS NOT NULL AND c.idx IS NOT NULL THEN 1 ELSE 0 END AS both_, CASE WHEN r.idx IS NOT NULL THEN 1 ELSE 0 END AS r, CASE WHEN c.idx IS NOT NULL THEN 1 ELSE 0 END AS c FROM r FULL JOIN c ON r.doc_id = c.doc_id AND r.idx = c.idx) SELECT doc_id, CAST(sum(both_) AS BIGINT) AS matched, round(CASE WHEN sum(c) = 0 THEN 0 ELSE sum(both_) / sum(c)::DOUBLE END, 6) AS precision_, round(CASE WHEN sum(r) = 0 THEN 0 ELSE sum(both_) / sum(r)::DOUBLE END, 6) AS recall_ FROM m GROUP BY 1")
def agg_boundary_metrics(spark, sf_dir):
    """Matched boundaries, precision and recall of two boundary sets over the same units, without a join."""
    r, c = F.col("conf") >= 60, F.col("text").isin("error", "view")
    n = lambda cond: F.count_if(cond)
    ratio = lambda whole: F.round(F.coalesce(F.try_divide(n(r & c), n(whole)), F.lit(0.0)), 6)
    return units(spark, sf_dir).where(r | c).groupBy("doc_id").agg(n(r & c).alias("matched"), ratio(c).alias("precision_"), ratio(r).alias("recall_"))
