"""Edits, versions, cue building and alignment: keyed updates, splices, islands and merges."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import intervals as ivl
from .bindings import UNITS, table, units
from .registry import by_doc, query

HOUR = 3600000
_UP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


def _upto(*order):
    return Window.partitionBy("doc_id").orderBy(*(order or ("idx",))).rowsBetween(Window.unboundedPreceding, 0)


#: Edits of parts: every fifth part is asked for, with the text that the editor saw; every tenth saw an old one.
_OPS = "ops AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 = 0 THEN 'old' ELSE p_name END AS expected, upper(p_name) AS new_text FROM part WHERE p_partkey % 5 = 0)"


def _ops(spark, sf_dir):
    p = table(spark, sf_dir, "part").where("p_partkey % 5 = 0")
    return p.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 10 == 0, "old").otherwise(F.col("p_name")).alias("expected"), F.upper("p_name").alias("new_text"))


@query(f"WITH {_OPS} SELECT p_partkey, coalesce(new_text, p_name) AS text, new_text IS NOT NULL AS edited FROM part LEFT JOIN ops ON id = p_partkey AND expected = p_name")
def op_replace(spark, sf_dir):
    j = table(spark, sf_dir, "part").join(_ops(spark, sf_dir), (F.col("id") == F.col("p_partkey")) & (F.col("expected") == F.col("p_name")), "left")
    return j.select("p_partkey", F.coalesce("new_text", "p_name").alias("text"), F.col("new_text").isNotNull().alias("edited"))


@query(f"WITH {_OPS}, b AS (SELECT p_brand FROM part JOIN ops ON id = p_partkey GROUP BY 1 HAVING bool_and(expected = p_name)) SELECT p_partkey, CASE WHEN new_text IS NOT NULL AND b.p_brand IS NOT NULL THEN new_text ELSE p_name END AS text FROM part LEFT JOIN ops ON id = p_partkey LEFT JOIN b USING (p_brand)")
def op_batch_replace(spark, sf_dir):
    """The edits of a batch (a brand) hold only if all of them met the text that they expected.

    Whether they did is one row a batch, aggregated before the shuffle and joined back; batches are never gathered.
    """
    j = table(spark, sf_dir, "part").join(_ops(spark, sf_dir), F.col("id") == F.col("p_partkey"), "left")
    met = j.where("id IS NOT NULL").groupBy("p_brand").agg(F.bool_and(F.col("expected") == F.col("p_name")).alias("all_met"))
    return j.join(met, "p_brand", "left").select("p_partkey", F.when(F.col("new_text").isNotNull() & F.col("all_met"), F.col("new_text")).otherwise(F.col("p_name")).alias("text"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') THEN 'needs_review' ELSE o_orderstatus END AS status FROM orders")
def op_status_propagation(spark, sf_dir):
    """Translated rows whose source changed need review."""
    changed = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("_changed", F.lit(True))
    j = table(spark, sf_dir, "orders").join(changed, "o_orderkey", "left")
    return j.select("o_orderkey", F.when((F.col("o_orderstatus") == "F") & F.col("_changed"), "needs_review").otherwise(F.col("o_orderstatus")).alias("status"))


@query(f"WITH {UNITS} SELECT doc_id, event_id, row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1 AS idx FROM units WHERE text <> 'error'")
def op_purge_cue(spark, sf_dir):
    u = units(spark, sf_dir).where("text <> 'error'")
    return u.select("doc_id", "event_id", (F.row_number().over(by_doc()) - 1).cast("long").alias("idx"))


@query(f"WITH {UNITS}, a AS (SELECT *, text = 'error' AS gone FROM units) SELECT event_id, gone AND conf >= 50 AS restored, NOT gone AND EXISTS (SELECT 1 FROM a b WHERE b.doc_id = a.doc_id AND b.gone AND b.conf >= 50 AND b.start_ms < a.end_ms AND a.start_ms < b.end_ms) AS displaced FROM a")
def op_restore(spark, sf_dir):
    """Deleted units that come back displace the active ones that they overlap."""
    u = units(spark, sf_dir).select("doc_id", "event_id", "start_ms", "end_ms", "conf", (F.col("text") == "error").alias("gone"))
    back = u.where("gone AND conf >= 50").select("doc_id", "start_ms", "end_ms")
    hit = ivl.overlaps(u.where("NOT gone"), back, ["doc_id"], 6 * HOUR).select("event_id").distinct().withColumn("_hit", F.lit(True))
    return u.join(hit, "event_id", "left").select("event_id", F.expr("gone AND conf >= 50").alias("restored"), F.coalesce("_hit", F.lit(False)).alias("displaced"))


@query(f"WITH {UNITS}, n AS (SELECT doc_id, event_id, idx + 0.0::DOUBLE AS place, text FROM units UNION ALL SELECT doc_id, -event_id, idx + 0.5::DOUBLE, 'manual' FROM units WHERE conf >= 90) SELECT doc_id, event_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY place) - 1 AS position FROM n")
def op_insert_token(spark, sf_dir):
    """A manual token behind every anchor; both come from one explode, and positions are dealt anew."""
    u = units(spark, sf_dir)
    rows = F.array(F.struct("event_id", "text", F.lit(0).alias("half")), F.when(F.col("conf") >= 90, F.struct((-F.col("event_id")).alias("event_id"), F.lit("manual").alias("text"), F.lit(1).alias("half"))))
    n = u.select("doc_id", "idx", F.inline(F.array_compact(rows)))
    return n.select("doc_id", "event_id", "text", (F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "half")) - 1).cast("long").alias("position"))


@query("WITH c AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS a FROM events), n AS (SELECT user_id AS doc_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS b FROM events WHERE event_type <> 'error') SELECT c.doc_id, count(*) AS before_n, count(n.event_id) AS after_n, coalesce(min(c.a) FILTER (n.b IS NULL OR n.b <> c.a), count(*)) AS same_prefix FROM c LEFT JOIN n USING (doc_id, event_id) GROUP BY 1")
def ver_order_splice(spark, sf_dir):
    """Order before and after removals: how long the common prefix is; both positions come from one window."""
    kept = F.col("event_type") != "error"
    order = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), kept.alias("kept"), (F.count("*").over(order) - 1).alias("a"), (F.sum(kept.cast("int")).over(order) - 1).alias("b"))
    g = e.groupBy("doc_id").agg(F.count("*").alias("before_n"), F.count_if("kept").alias("after_n"), F.min(F.when(~F.col("kept") | (F.col("a") != F.col("b")), F.col("a"))).alias("p"))
    return g.select("doc_id", "before_n", "after_n", F.coalesce("p", "before_n").alias("same_prefix"))


@query("SELECT coalesce(a.url, b.url) AS url, CASE WHEN a.url IS NULL THEN 'added' WHEN b.url IS NULL THEN 'removed' WHEN a.h <> b.h THEN 'changed' ELSE 'same' END AS state FROM (SELECT url, min(sha256(html)) AS h FROM pages WHERE page_id % 4 <> 0 GROUP BY 1) a FULL JOIN (SELECT url, max(sha256(html)) AS h FROM pages WHERE page_id % 5 <> 0 GROUP BY 1) b ON a.url = b.url")
def ver_file_delta(spark, sf_dir):
    """Two inventories of path and hash, by one grouping."""
    p, h = table(spark, sf_dir, "pages"), F.sha2("html", 256)
    g = p.where("page_id % 4 <> 0 OR page_id % 5 <> 0").groupBy("url").agg(F.min(F.when(F.col("page_id") % 4 != 0, h)).alias("a"), F.max(F.when(F.col("page_id") % 5 != 0, h)).alias("b"))
    return g.select("url", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(F.col("a") != F.col("b"), "changed").otherwise("same").alias("state"))


@query(f"WITH {UNITS} SELECT doc_id, sha256(string_agg(CAST(idx AS VARCHAR), ',' ORDER BY idx)) AS fingerprint FROM units WHERE conf >= 60 GROUP BY 1")
def ver_fingerprint_cuts(spark, sf_dir):
    cuts = F.sort_array(F.collect_list("idx")).cast("array<string>")
    return units(spark, sf_dir).where("conf >= 60").groupBy("doc_id").agg(F.sha2(F.array_join(cuts, ","), 256).alias("fingerprint"))


@query(f"WITH {UNITS}, r AS (SELECT *, coalesce(CAST(sum(CASE WHEN conf >= 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS cue FROM units) SELECT doc_id, cue, min(start_ms) AS start_ms, max(end_ms) AS end_ms, CASE WHEN count(DISTINCT speaker) = 1 THEN min(speaker) END AS speaker, count(*) AS n FROM r GROUP BY 1, 2")
def cue_build(spark, sf_dir):
    """Cues between cuts, with their envelope and their speaker if there is just one."""
    cut = F.sum((F.col("conf") >= 60).cast("long")).over(by_doc().rowsBetween(Window.unboundedPreceding, -1))
    g = units(spark, sf_dir).withColumn("cue", F.coalesce(cut, F.lit(0))).groupBy("doc_id", "cue")
    one = F.when(F.min("speaker") == F.max("speaker"), F.min("speaker"))
    return g.agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), one.alias("speaker"), F.count("*").alias("n"))


@query(f"WITH {UNITS}, m AS (SELECT *, lead(start_ms) OVER w - end_ms AS gap, text = 'purchase' AS stop, bool_or(text = 'purchase') OVER (PARTITION BY doc_id) AS stops FROM units WINDOW w AS (PARTITION BY doc_id ORDER BY idx)) SELECT event_id, CASE WHEN stops THEN stop ELSE coalesce(gap >= {6 * HOUR}, false) END AS boundary FROM m")
def cue_sentence_boundary(spark, sf_dir):
    """Boundaries at sentence ends; in documents without any, at long gaps."""
    stop = F.col("text") == "purchase"
    far = F.coalesce(F.lead("start_ms").over(by_doc()) - F.col("end_ms") >= 6 * HOUR, F.lit(False))
    return units(spark, sf_dir).select("event_id", F.when(F.bool_or(stop).over(Window.partitionBy("doc_id")), stop).otherwise(far).alias("boundary"))


@query(f"WITH {UNITS} SELECT u.event_id, k AS part, CASE k WHEN 0 THEN u.start_ms ELSE greatest(u.start_ms, x.b) END AS start_ms, CASE k WHEN 0 THEN least(u.end_ms, x.a) ELSE u.end_ms END AS end_ms FROM units u, (SELECT doc_id, min(start_ms) + {24 * HOUR} AS a, min(start_ms) + {96 * HOUR} AS b FROM units GROUP BY 1) x, (VALUES (0), (1)) AS t(k) WHERE x.doc_id = u.doc_id AND CASE k WHEN 0 THEN u.start_ms < least(u.end_ms, x.a) ELSE greatest(u.start_ms, x.b) < u.end_ms END")
def ivl_crop(spark, sf_dir):
    """One half-open range taken out of all units of a document; a unit across it leaves two parts."""
    u = units(spark, sf_dir)
    first = F.min("start_ms").over(Window.partitionBy("doc_id"))
    u = u.withColumns({"_a": first + 24 * HOUR, "_b": first + 96 * HOUR})
    parts = F.array(F.struct(F.lit(0).alias("part"), F.col("start_ms"), F.least("end_ms", "_a").alias("end_ms")), F.struct(F.lit(1).alias("part"), F.greatest("start_ms", "_b").alias("start_ms"), F.col("end_ms")))
    return u.select("event_id", F.inline(F.filter(parts, lambda p: p["start_ms"] < p["end_ms"])))


@query(f"WITH {UNITS}, p AS (SELECT *, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx {_UP}) AS BIGINT) AS upto FROM units) SELECT a.event_id, max(b.idx) AS last_idx FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.idx >= a.idx AND b.upto - a.upto + length(a.text) <= 30 GROUP BY 1")
def seg_max_end(spark, sf_dir):
    """The furthest unit that fits with each one into 30 letters: a window by running length, not a join."""
    p = units(spark, sf_dir).withColumn("_upto", F.sum(F.length("text")).over(_upto()))
    p = p.withColumn("_from", F.col("_upto") - F.length("text"))
    # rows whose running length lies at most 30 beyond what came before this one
    reach = Window.partitionBy("doc_id").orderBy("_at")
    starts = p.select("doc_id", "event_id", F.col("_from").alias("_at"), F.lit(None).cast("long").alias("_end"))
    ends = p.select("doc_id", F.lit(None).cast("long").alias("event_id"), (F.col("_upto") - 30).alias("_at"), F.col("idx").alias("_end"))
    got = starts.unionByName(ends).withColumn("last_idx", F.max("_end").over(reach.rangeBetween(Window.unboundedPreceding, 0)))
    return got.where("event_id IS NOT NULL").select("event_id", "last_idx")


@query(f"WITH {UNITS}, c AS (SELECT doc_id, idx // 10 AS chunk, min(start_ms) AS core_a, max(start_ms) AS core_b FROM units GROUP BY 1, 2) SELECT c.doc_id, c.chunk, count(*) AS n, count(*) FILTER (u.start_ms BETWEEN c.core_a AND c.core_b) AS core FROM c JOIN units u ON u.doc_id = c.doc_id AND u.start_ms BETWEEN c.core_a - {12 * HOUR} AND c.core_b + {12 * HOUR} GROUP BY 1, 2")
def seg_adaptive_chunks(spark, sf_dir):
    """Disjoint cores with analysis windows that reach twelve hours further on both sides."""
    u = units(spark, sf_dir).select("doc_id", "idx", "start_ms", (F.col("start_ms") + 1).alias("end_ms"))
    c = u.groupBy("doc_id", F.floor(F.col("idx") / 10).alias("chunk")).agg(F.min("start_ms").alias("core_a"), F.max("start_ms").alias("core_b"))
    wide = c.withColumns({"start_ms": F.col("core_a") - 12 * HOUR, "end_ms": F.col("core_b") + 12 * HOUR + 1})
    hit = ivl.overlaps(u, wide, ["doc_id"], 24 * HOUR)
    return hit.groupBy("doc_id", F.col("o_chunk").alias("chunk")).agg(F.count("*").alias("n"), F.count_if(F.col("start_ms").between(F.col("o_core_a"), F.col("o_core_b"))).alias("core"))


@query(f"WITH {UNITS}, c AS (SELECT doc_id, idx // 10 AS chunk, min(start_ms) - {12 * HOUR} AS a, max(start_ms) + {12 * HOUR} AS b FROM units GROUP BY 1, 2), n AS (SELECT *, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY chunk)) SELECT doc_id, chunk, greatest(a, na) AS start_ms, least(b, nb) AS end_ms FROM n WHERE greatest(a, na) < least(b, nb) AND na IS NOT NULL")
def seg_seam_windows(spark, sf_dir):
    c = units(spark, sf_dir).groupBy("doc_id", F.floor(F.col("idx") / 10).alias("chunk")).agg((F.min("start_ms") - 12 * HOUR).alias("a"), (F.max("start_ms") + 12 * HOUR).alias("b"))
    w = Window.partitionBy("doc_id").orderBy("chunk")
    n = c.withColumns({"na": F.lead("a").over(w), "nb": F.lead("b").over(w)}).where("na IS NOT NULL")
    return n.select("doc_id", "chunk", F.greatest("a", "na").alias("start_ms"), F.least("b", "nb").alias("end_ms")).where("start_ms < end_ms")


@query(f"WITH {UNITS}, m AS (SELECT *, max(CASE WHEN conf >= 80 THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx {_UP}) AS pa, min(CASE WHEN conf >= 80 THEN idx END) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS na FROM units) SELECT m.event_id, CASE WHEN m.pa IS NULL OR m.na IS NULL THEN NULL WHEN m.pa = m.na THEN p.start_ms ELSE p.start_ms + CAST(floor((n.start_ms - p.start_ms) * (m.idx - m.pa) / (m.na - m.pa)::DOUBLE) AS BIGINT) END AS mapped_ms FROM m LEFT JOIN units p ON p.doc_id = m.doc_id AND p.idx = m.pa LEFT JOIN units n ON n.doc_id = m.doc_id AND n.idx = m.na")
def aln_coord_map(spark, sf_dir):
    """Piecewise linear map through anchors: the anchor before and after each unit by two windows, no join."""
    at = F.when(F.col("conf") >= 80, F.struct("idx", "start_ms"))
    m = units(spark, sf_dir).withColumns({"_p": F.last(at, True).over(_upto()), "_n": F.first(at, True).over(by_doc().rowsBetween(0, Window.unboundedFollowing))})
    between = F.floor((F.col("_n.start_ms") - F.col("_p.start_ms")) * (F.col("idx") - F.col("_p.idx")) / (F.col("_n.idx") - F.col("_p.idx")))
    value = F.when(F.col("_p.idx") == F.col("_n.idx"), F.col("_p.start_ms")).when(F.col("_p").isNotNull() & F.col("_n").isNotNull(), F.col("_p.start_ms") + between)
    return m.select("event_id", value.alias("mapped_ms"))


@query(f"WITH {UNITS}, r AS (SELECT DISTINCT doc_id, idx FROM units WHERE conf >= 60), c AS (SELECT DISTINCT doc_id, idx FROM units WHERE text = 'view') SELECT doc_id, count(*) AS matched FROM r JOIN c USING (doc_id, idx) GROUP BY 1")
def aln_exact_match(spark, sf_dir):
    return units(spark, sf_dir).where("conf >= 60 AND text = 'view'").groupBy("doc_id").agg(F.count("*").alias("matched"))


@query(f"WITH {UNITS}, s AS (SELECT doc_id, avg(conf) AS a, avg(CASE WHEN text = 'error' THEN 1.0::DOUBLE ELSE 0 END) AS e FROM units GROUP BY 1) SELECT doc_id, CASE WHEN a >= 50 AND e <= 0.1 THEN 'good' WHEN a >= 40 AND e <= 0.25 THEN 'warning' ELSE 'failed' END AS grade FROM s")
def aln_quality_grade(spark, sf_dir):
    s = units(spark, sf_dir).groupBy("doc_id").agg(F.avg("conf").alias("a"), F.avg((F.col("text") == "error").cast("double")).alias("e"))
    return s.select("doc_id", F.when(F.expr("a >= 50 AND e <= 0.1"), "good").when(F.expr("a >= 40 AND e <= 0.25"), "warning").otherwise("failed").alias("grade"))


@query(f"WITH {UNITS} SELECT r.event_id, min(a.idx) AS break_idx FROM units r LEFT JOIN units a ON a.doc_id = r.doc_id AND a.conf >= 70 AND a.idx >= r.idx AND a.idx <= r.idx + 4 WHERE r.text = 'click' GROUP BY 1")
def aln_break_reconcile(spark, sf_dir):
    """The next recognised break within four units of each reference break."""
    near = F.min(F.when(F.col("conf") >= 70, F.col("idx"))).over(by_doc().rowsBetween(0, 4))
    return units(spark, sf_dir).withColumn("break_idx", near).where("text = 'click'").select("event_id", "break_idx")


@query(f"WITH {UNITS} SELECT event_id, 'W' || lpad(CAST(idx + 1 AS VARCHAR), CAST(greatest(4, length(CAST(idx + 1 AS VARCHAR))) AS INTEGER), '0') AS alias, 'u_' || substr(sha256(CAST(doc_id AS VARCHAR) || '|' || CAST(idx AS VARCHAR) || '|' || text), 1, 24) AS stable_id FROM units")
def project_alias(spark, sf_dir):
    """Short aliases of a request, and ids that follow from the content."""
    return units(spark, sf_dir).select("event_id", F.format_string("W%04d", F.col("idx") + 1).alias("alias"), F.concat(F.lit("u_"), F.substring(F.sha2(F.concat_ws("|", "doc_id", "idx", "text"), 256), 1, 24)).alias("stable_id"))


@query(f"WITH {UNITS}, c AS (SELECT *, CAST(sum(end_ms - start_ms) OVER (PARTITION BY doc_id ORDER BY idx {_UP}) AS BIGINT) AS upto FROM units), f AS (SELECT *, (upto * 3 + 50) // 100 AS g FROM c) SELECT event_id, g - coalesce(lag(g) OVER (PARTITION BY doc_id ORDER BY idx), 0) AS frames FROM f")
def project_frame_grid(spark, sf_dir):
    """Lengths on a grid of 30 frames a second: the running sum is rounded, so no drift adds up; whole numbers only."""
    f = units(spark, sf_dir).withColumn("_upto", F.sum(F.col("end_ms") - F.col("start_ms")).over(_upto())).withColumn("_g", F.expr("(_upto * 3 + 50) div 100"))
    return f.select("event_id", (F.col("_g") - F.coalesce(F.lag("_g").over(by_doc()), F.lit(0))).alias("frames"))


@query("""
WITH ops AS (SELECT l_orderkey AS doc, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey % 80, l_partkey % 80 + CAST(l_quantity AS BIGINT), l_returnflag = 'R') AS op, l_returnflag = 'R' AS restore, l_partkey % 80 AS a, l_partkey % 80 + CAST(l_quantity AS BIGINT) AS b FROM lineitem),
e AS (SELECT doc, a AS edge FROM ops UNION SELECT doc, b FROM ops UNION SELECT doc, 0 FROM ops UNION SELECT doc, 140 FROM ops),
s AS (SELECT doc, edge AS a, lead(edge) OVER (PARTITION BY doc ORDER BY edge) AS b FROM e),
w AS (SELECT s.doc, s.a, s.b, arg_max(o.restore, o.op) AS restore FROM s LEFT JOIN ops o ON o.doc = s.doc AND o.a <= s.a AND s.b <= o.b WHERE s.b IS NOT NULL GROUP BY s.doc, s.a, s.b),
i AS (SELECT *, CASE WHEN lag(b) OVER (PARTITION BY doc ORDER BY a) = a THEN 0 ELSE 1 END AS starts FROM w WHERE restore IS NULL OR restore),
r AS (SELECT *, sum(starts) OVER (PARTITION BY doc ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM i)
SELECT doc, min(a) AS kept_from, max(b) AS kept_to FROM r GROUP BY doc, island""")
def ivl_apply_ops(spark, sf_dir):
    """Lines of an order cut its span or, if returned, restore it, in the order of their numbers; the SQL lets the last line of each smallest segment decide."""
    start = F.col("l_partkey") % 80
    ops = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("n"), (F.col("l_returnflag") == "R").alias("restore"), start.alias("start_ms"), (start + F.col("l_quantity").cast("long")).alias("end_ms"))
    return ivl.applied(ops, ["doc"], 0, 140).select("doc", F.col("start_ms").alias("kept_from"), F.col("end_ms").alias("kept_to"))
