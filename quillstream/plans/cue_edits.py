"""Splitting and merging of spoken turns; the SQL finds both sides by filters and self-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import cues as ops
from ..operators import intervals as ivl
from .registry import query
from .segmentation import SPEECH, speech

_TURN = ["doc_id", "idx", "speaker"]


@query(f"""WITH {SPEECH}, t AS (SELECT doc_id, idx, speaker, min(start_ms) AS s, max(end_ms) AS e, min(n) FILTER (mark) AS after_n, max(n) AS top FROM speech GROUP BY doc_id, idx, speaker),
c AS (SELECT t.*, p.doc_id || '/' || p.idx || '/' || p.speaker || '/' || after_n || '/right' AS named, max(p.end_ms) FILTER (p.n <= after_n) AS l, min(p.start_ms) FILTER (p.n > after_n) AS r, min(p.n) AS low, string_agg(p.word, ' ' ORDER BY p.n) FILTER (p.n <= after_n) AS lt, string_agg(p.word, ' ' ORDER BY p.n) FILTER (p.n > after_n) AS rt
  FROM t JOIN speech p ON p.doc_id = t.doc_id AND p.idx = t.idx AND p.speaker = t.speaker WHERE after_n < top GROUP BY ALL)
SELECT doc_id, idx, speaker, 0 AS part, low AS first_n, after_n AS last_n, CAST(s AS DOUBLE) AS start_ms, CAST(least(greatest(l, s + 1), e - 1) AS DOUBLE) AS end_ms, lt AS text, NULL AS cue_id FROM c
UNION ALL SELECT doc_id, idx, speaker, 1, after_n + 1, top, CAST(least(greatest(r, least(greatest(l, s + 1), e - 1)), e - 1) AS DOUBLE), CAST(e AS DOUBLE), rt, 'cue_' || substr(sha256(named), 1, 24) FROM c""")
def cue_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns split behind their first sentence."""
    words = speech(spark, sf_dir)
    turns = words.groupBy(*_TURN).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.min(F.when(F.col("mark"), F.col("n"))).alias("after_n")).where("after_n IS NOT NULL")
    return ops.split(words.select(*_TURN, "n", F.col("word").alias("text"), "start_ms", "end_ms"), turns, _TURN)


#: Turns with the turn behind them as translation: none at the end, to be done by hand if it is empty of marks, to be looked at if it is shorter.
_TURNS = f"""{SPEECH}, turns AS (SELECT doc_id, idx, speaker, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY n) AS text, count(*) FILTER (mark) AS marks FROM speech GROUP BY doc_id, idx, speaker),
cues AS (SELECT *, row_number() OVER w AS k, lead(text) OVER w AS target, CASE WHEN lead(marks) OVER w < 2 THEN 'manual_required' WHEN length(lead(text) OVER w) < length(text) THEN 'needs_review' WHEN lead(text) OVER w IS NOT NULL THEN 'translated' END AS status, marks // 3 AS grp FROM turns WINDOW w AS (PARTITION BY doc_id ORDER BY idx, speaker))"""


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    marks = F.count_if("mark")
    t = speech(spark, sf_dir).groupBy(*_TURN).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_join(F.sort_array(F.collect_list(F.struct("n", "word")))["word"], " ").alias("text"), marks.alias("marks"))
    w = Window.partitionBy("doc_id").orderBy("idx", "speaker")
    status = F.when(F.lead("marks").over(w) < 2, "manual_required").when(F.length(F.lead("text").over(w)) < F.length("text"), "needs_review").when(F.lead("text").over(w).isNotNull(), "translated")
    return t.withColumns({"k": F.row_number().over(w).cast("long"), "target": F.lead("text").over(w), "status": status, "grp": F.expr("marks div 3")})


@query(rf"""WITH RECURSIVE {_TURNS}, p AS (SELECT doc_id, k, speaker = 'user' AND EXISTS (SELECT 1 FROM cues d WHERE d.doc_id = c.doc_id AND d.k = c.k + 1) AS pick FROM cues c),
m(doc_id, k, takes) AS (SELECT doc_id, k, pick FROM p WHERE k = 1 UNION ALL SELECT p.doc_id, p.k, p.pick AND NOT m.takes FROM m JOIN p ON p.doc_id = m.doc_id AND p.k = m.k + 1),
j AS (SELECT a.*, m.takes, b.end_ms AS e2, b.speaker AS s2, b.text AS t2, b.target AS g2, b.status AS u2, b.grp AS r2 FROM cues a JOIN m ON m.doc_id = a.doc_id AND m.k = a.k LEFT JOIN cues b ON b.doc_id = a.doc_id AND b.k = a.k + 1 AND m.takes
  WHERE NOT EXISTS (SELECT 1 FROM m q WHERE q.doc_id = a.doc_id AND q.k = a.k - 1 AND q.takes)),
o AS (SELECT doc_id, k, start_ms, coalesce(e2, end_ms) AS end_ms, CASE WHEN NOT takes OR speaker = s2 THEN speaker END AS speaker, CASE WHEN takes THEN CASE WHEN regexp_matches(t2, '^[,.!?;:%)\]}}]') OR regexp_matches(text, '[(\[{{]$') THEN text || t2 ELSE text || ' ' || t2 END ELSE text END AS text,
  CASE WHEN NOT takes OR g2 IS NULL THEN coalesce(target, g2) WHEN target IS NULL THEN g2 WHEN target = g2 THEN target WHEN regexp_matches(g2, '^[,.!?;:%)\]}}]') OR regexp_matches(target, '[(\[{{]$') THEN target || g2 ELSE target || ' ' || g2 END AS target,
  CASE WHEN 'manual_required' IN (coalesce(status, ''), coalesce(u2, '')) THEN 'manual_required' WHEN 'needs_review' IN (coalesce(status, ''), coalesce(u2, '')) THEN 'needs_review' ELSE coalesce(status, u2) END AS status,
  CASE WHEN takes AND r2 <> grp THEN grp || ',' || r2 ELSE CAST(grp AS VARCHAR) END AS sources, takes AS merged FROM j)
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS n FROM o""")
def cue_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a user merged with the reply behind it."""
    got = ops.merge(turns(spark, sf_dir), ["doc_id"], "k", F.col("speaker") == "user")
    return got.withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


_LONG, _WORDS, _BIN = 5, 8, 5000
#: Sentences of five words and more are kept, one after the other; cues are eight words each, wherever sentences end.
_KEPT = f"""{SPEECH}, numbered AS (SELECT *, coalesce(sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence, n // {_WORDS} AS cue FROM speech),
kept AS (SELECT *, coalesce(sum(b - a) OVER (PARTITION BY doc_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM (SELECT doc_id, CAST(sentence AS BIGINT) AS kept, min(start_ms) AS a, max(end_ms) AS b FROM numbered GROUP BY doc_id, sentence HAVING count(*) >= {_LONG}))"""


def _numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = Window.partitionBy("doc_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    return speech(spark, sf_dir).withColumns({"sentence": F.coalesce(F.sum(F.col("mark").cast("long")).over(before), F.lit(0)), "cue": F.expr(f"n div {_WORDS}")})


def _kept(words: DataFrame) -> DataFrame:
    rows = words.groupBy("doc_id", F.col("sentence").alias("kept")).agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("words")).where(F.col("words") >= _LONG).drop("words")
    before = Window.partitionBy("doc_id").orderBy("start_ms").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum(F.col("end_ms") - F.col("start_ms")).over(before), F.lit(0)))


@query(f"""WITH {_KEPT}, c AS (SELECT doc_id, cue, min(start_ms) AS s, max(end_ms) AS e FROM numbered GROUP BY doc_id, cue)
SELECT c.doc_id, cue, kept, CAST(base + greatest(s, a) - a AS BIGINT) AS out_start, CAST(base + least(e, b) - a AS BIGINT) AS out_end, s < a OR e > b AS partial, row_number() OVER (PARTITION BY c.doc_id ORDER BY base + greatest(s, a) - a, cue) - 1 AS idx FROM c JOIN kept k ON k.doc_id = c.doc_id AND s < b AND a < e""")
def ivl_projected_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues on the timeline that only the kept sentences make, in pieces where they reach over an edge; cues and sentences meet by bins of time."""
    words = _numbered(spark, sf_dir)
    cues = words.groupBy("doc_id", "cue").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"))
    hit = ivl.overlaps(cues, _kept(words), ["doc_id"], _BIN)
    shift = F.col("o_base") - F.col("o_start_ms")
    out = hit.select("doc_id", "cue", F.col("o_kept").alias("kept"), (F.greatest("start_ms", "o_start_ms") + shift).cast("long").alias("out_start"), (F.least("end_ms", "o_end_ms") + shift).cast("long").alias("out_end"), ((F.col("start_ms") < F.col("o_start_ms")) | (F.col("end_ms") > F.col("o_end_ms"))).alias("partial"))
    return out.withColumn("idx", (F.row_number().over(Window.partitionBy("doc_id").orderBy("out_start", "cue")) - 1).cast("long"))


@query(f"""WITH {_KEPT}, v AS (SELECT w.doc_id, w.cue, k.kept, count(*) AS visible, string_agg(word, ' ' ORDER BY n) AS text, min(greatest(start_ms, a)) AS start_ms, max(least(end_ms, b)) AS end_ms FROM numbered w JOIN kept k ON k.doc_id = w.doc_id AND w.start_ms < b AND a < w.end_ms GROUP BY w.doc_id, w.cue, k.kept)
SELECT v.*, v.visible < (SELECT count(*) FROM numbered n WHERE n.doc_id = v.doc_id AND n.cue = v.cue) AS partial FROM v""")
def kept_material_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each kept sentence shows of each cue: its words, their clipped times, and whether some are missing."""
    words = _numbered(spark, sf_dir)
    hit = ivl.overlaps(words.select("doc_id", "cue", "n", "word", "start_ms", "end_ms"), _kept(words), ["doc_id"], _BIN)
    shown = hit.groupBy("doc_id", "cue", F.col("o_kept").alias("kept")).agg(F.count("*").alias("visible"), F.array_join(F.sort_array(F.collect_list(F.struct("n", "word")))["word"], " ").alias("text"),
                                                                           F.min(F.greatest("start_ms", "o_start_ms")).alias("start_ms"), F.max(F.least("end_ms", "o_end_ms")).alias("end_ms"))
    whole = words.groupBy("doc_id", "cue").agg(F.count("*").alias("_all"))
    return shown.join(whole, ["doc_id", "cue"]).withColumn("partial", F.col("visible") < F.col("_all")).drop("_all")
