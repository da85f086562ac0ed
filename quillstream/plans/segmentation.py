"""Blocks and line breaks of spoken documents by bounded shortest paths; the SQL finds them layer by layer or pick by pick."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..operators import planning
from .bindings import spread, table
from .registry import query

_MARK, _PAUSE = r"[.!?][\"')]*$", r"[,;:]$"


def speech(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each conversation as they would be spoken: a word takes 120 ms and 45 a character, and marks are followed by pauses."""
    c = spread(table(spark, sf_dir, "conversations"), "conv_id").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")
    w = c.select("doc_id", "idx", "speaker", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+\n?"), F.lit(0))).alias("pos", "word"))
    w = w.withColumn("line_end", F.col("word").endswith("\n")).withColumn("word", F.regexp_replace("word", "\n", ""))
    took = F.length("word") * 45 + 120
    pause = F.when(F.col("word").rlike(_MARK), 600).when(F.col("word").rlike(_PAUSE), 250).otherwise(0)
    order = Window.partitionBy("doc_id").orderBy("idx", "speaker", "pos")
    end = F.sum(took + pause).over(order.rowsBetween(Window.unboundedPreceding, 0)) - pause
    return w.select("doc_id", "idx", "speaker", F.col("pos").cast("long").alias("pos"), "word", (F.row_number().over(order) - 1).cast("long").alias("n"), (end - took).alias("start_ms"), end.alias("end_ms"), F.col("word").rlike(_MARK).alias("mark"), "line_end")


SPEECH = rf"""speech AS (SELECT doc_id, idx, speaker, pos, word, n, CAST(until - pause - took AS BIGINT) AS start_ms, CAST(until - pause AS BIGINT) AS end_ms, mark, line_end
  FROM (SELECT *, sum(took + pause) OVER o AS until, row_number() OVER o - 1 AS n FROM (SELECT *, length(word) * 45 + 120 AS took, regexp_matches(word, '{_MARK.replace("'", "''")}') AS mark,
    CASE WHEN regexp_matches(word, '{_MARK.replace("'", "''")}') THEN 600 WHEN regexp_matches(word, '{_PAUSE}') THEN 250 ELSE 0 END AS pause
    FROM (SELECT * REPLACE (replace(word, chr(10), '') AS word), ends_with(word, chr(10)) AS line_end FROM (SELECT conv_id AS doc_id, turn AS idx, role AS speaker, unnest(regexp_extract_all(text, '[^\s]+\n?')) AS word, CAST(unnest(range(len(regexp_extract_all(text, '[^\s]+\n?')))) AS BIGINT) AS pos FROM conversations)))
  WINDOW o AS (PARTITION BY doc_id ORDER BY idx, speaker, pos)))"""

_LIMITS = {"target": 90_000, "least": 75_000, "most": 100_000}
_BLOCKS = """
WITH RECURSIVE {speech},
u AS (SELECT *, lead(start_ms) OVER w AS next_start, lead(n) OVER w IS NULL AS last, mark AS cut,
  coalesce(CASE WHEN speaker <> lead(speaker) OVER w THEN 150000 ELSE 0 END + least(greatest(0, lead(start_ms) OVER w - end_ms), 2000) * 70 + CASE WHEN mark THEN 65000 ELSE 0 END, 0) AS bonus FROM speech WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
d AS (SELECT doc_id, min(n) AS first_n, max(n) AS last_n, arg_min(start_ms, n) AS first_start, arg_max(end_ms, n) AS finish FROM u GROUP BY doc_id),
x AS (SELECT * FROM u WHERE cut OR last),
p(doc_id, n, from_ms, last, cost, path) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), first_start, false, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM d
  UNION ALL
  SELECT doc_id, n, any_value(next_start), any_value(last), min(o).cost, min(o).path FROM (
    SELECT p.doc_id, x.n, x.next_start, x.last, {{'cost': CAST(p.cost + 1000 * abs(x.end_ms - p.from_ms - {target}) + CASE WHEN x.last THEN 0 ELSE abs(x.end_ms - p.from_ms - {target}) - x.bonus END AS BIGINT),
      'path': CASE WHEN x.last THEN p.path ELSE list_append(p.path, x.n) END}} AS o
    FROM p JOIN x ON p.doc_id = x.doc_id AND NOT p.last AND x.n > p.n AND x.end_ms - p.from_ms BETWEEN {least} AND {most}) GROUP BY doc_id, n),
s AS (SELECT doc_id, min({{'cost': cost, 'path': path}}).path AS path FROM p WHERE last GROUP BY doc_id),
b AS (SELECT d.*, finish - first_start AS total, greatest(1, ceil((finish - first_start) / CAST({most} AS DOUBLE))) AS fewest, greatest(1, floor((finish - first_start) / CAST({least} AS DOUBLE))) AS many FROM d WHERE doc_id NOT IN (SELECT doc_id FROM s)),
g(doc_id, prev, from_ms, finish, blocks, path) AS (
  SELECT doc_id, CAST(-1 AS BIGINT), first_start, finish, CAST(CASE WHEN fewest <= many THEN least(many, greatest(fewest, round_even(total / CAST({target} AS DOUBLE), 0))) ELSE 0 END AS BIGINT), CAST([] AS BIGINT[]) FROM b
  UNION ALL
  SELECT doc_id, n, next_start, finish, greatest(1, blocks - 1), list_append(path, n) FROM (
    SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tier DESC, bonus * goal - away DESC, away, n) AS k FROM (
      SELECT *, CASE WHEN fits AND room THEN 2 WHEN fits THEN 1 ELSE 0 END AS tier FROM (
        SELECT g.*, x.n, x.next_start, x.bonus, greatest(blocks, 1) AS goal, abs(x.end_ms * greatest(blocks, 1) - CASE WHEN blocks > 1 THEN from_ms * blocks + finish - from_ms ELSE from_ms + {target} END) AS away,
          x.end_ms - from_ms BETWEEN {least} AND {most} AS fits, CASE WHEN blocks > 1 THEN finish - x.next_start BETWEEN {least} * (blocks - 1) AND {most} * (blocks - 1) ELSE finish - x.next_start >= {least} END AS room
        FROM g JOIN x ON g.doc_id = x.doc_id AND NOT x.last AND x.n > g.prev AND finish - from_ms > {most}))) WHERE k = 1),
f AS (SELECT doc_id, path, true AS bounded FROM s UNION ALL SELECT doc_id, path, false FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY len(path) DESC) = 1),
e AS (SELECT d.*, f.bounded, list_concat([first_n - 1], path, [last_n]) AS ends FROM f JOIN d ON f.doc_id = d.doc_id),
r AS (SELECT doc_id, bounded, first_start, finish, CAST(k AS BIGINT) AS block, ends[k] + 1 AS first_n, ends[k + 1] AS last_n FROM (SELECT *, unnest(range(1, len(ends))) AS k FROM e))
SELECT r.doc_id, r.block, r.first_n, r.last_n, a.start_ms, z.end_ms, r.bounded, finish - first_start > {most} AND NOT z.end_ms - a.start_ms BETWEEN {least} AND {most} AS exception
FROM r JOIN u a ON a.doc_id = r.doc_id AND a.n = r.first_n JOIN u z ON z.doc_id = r.doc_id AND z.n = r.last_n"""


def _spoken(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).withColumns({"conf": F.lit(100), "quiet": F.col("mark"), "cut": F.col("mark")})


@query(_BLOCKS.format(speech=SPEECH, **_LIMITS))
def seg_execution_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 75 to 100 seconds, 90 if it can be, of each conversation, cut at ends of sentences."""
    return planning.execution_blocks(_spoken(spark, sf_dir), ["doc_id"], **_LIMITS)


_MARKS = r"[,.;:!?\"')\]]*$"
_CUES = 6


def _said(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


_UNITS = rf"""
WITH RECURSIVE {SPEECH},
t AS (SELECT *, regexp_extract(word, '{_MARKS.replace("'", "''")}') AS marks, regexp_replace(word, '{_MARKS.replace("'", "''")}', '') AS text, word AS shown FROM speech),
e AS (SELECT *, regexp_extract_all(text, '{rules.ENGLISH_WORD.replace("'", "''")}') AS english FROM t),
b AS (SELECT *, CASE WHEN len(english) = 1 THEN lower(replace(english[1], '’', '''')) ELSE '' END AS bare, len(english) AS words, lower(replace(english[-1], '’', '''')) IN {_said(rules.DANGLING)} AS dangling FROM e),
c AS (SELECT *, lead(start_ms) OVER w AS next_start, lead(start_ms) OVER w IS NULL AS final, greatest(0, lead(start_ms) OVER w - end_ms) AS gap, regexp_matches(marks, '{rules.TERMINAL}') AS ended,
  coalesce(lag(bare) OVER w, '') AS b0, bare AS b1, coalesce(lead(bare) OVER w, '') AS b2, coalesce(lead(bare, 2) OVER w, '') AS b3, lead(text) OVER w AS next_text, lead(end_ms) OVER w AS next_end FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY n)),
u AS (SELECT *, NOT guarded AND NOT place AND NOT shared AND NOT incomplete AS free FROM (SELECT *,
  coalesce(regexp_matches(text, '[-‐‑‒]$') OR (NOT ended AND gap < 400 AND (b2 IN {_said(rules.PARTICLES)} OR concat(b1, ' ', b2) IN {_said(rules.EXPRESSIONS)} OR concat(b0, ' ', b1, ' ', b2) IN {_said(rules.EXPRESSIONS)} OR concat(b1, ' ', b2, ' ', b3) IN {_said(rules.EXPRESSIONS)})), false) AS guarded,
  coalesce(lower(next_text) IN {_said(rules.COUNTRIES)} AND regexp_matches(text, '^[A-Z]') AND contains(marks, ','), false) AS place, coalesce(next_start = start_ms AND next_end = end_ms, false) AS shared, NOT ended AND b1 IN {_said(rules.DEPENDENT)} AS incomplete,
  CASE WHEN final THEN 0 ELSE CASE WHEN line_end THEN -25 ELSE 0 END + CASE WHEN ended THEN -90 WHEN regexp_matches(marks, '{rules.CLAUSE}') THEN -40 ELSE 0 END + CASE WHEN gap >= 400 THEN -80 WHEN gap >= 200 THEN -40 WHEN gap >= 80 THEN -15 ELSE 0 END END AS cut_cost,
  coalesce(sum(CASE WHEN mark THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, idx, speaker ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM c))"""
_CUTS = rf"""{_UNITS},
g AS (SELECT *, row_number() OVER o AS k, count(*) OVER (PARTITION BY doc_id, idx, speaker, grp) AS size FROM u WINDOW o AS (PARTITION BY doc_id, idx, speaker, grp ORDER BY n)),
s AS (SELECT a.doc_id, a.idx, a.speaker, a.grp, a.k AS a, z.k AS z, z.n, z.size, z.free, z.cut_cost, any_value(z.end_ms) - any_value(a.start_ms) AS took, sum(length(x.shown) + 1) - 1 AS chars, sum(x.words) AS words, any_value(regexp_matches(z.shown, '[?!？！]$')) AS called,
    sum(len(regexp_extract_all(x.shown, '[A-Za-z]'))) AS letters, sum(len(regexp_extract_all(x.shown, '[\x{{3400}}-\x{{9FFF}}]'))) AS han, arg_max(x.dangling, x.k) FILTER (WHERE x.words > 0) AS dangles
  FROM g a JOIN g z ON a.doc_id = z.doc_id AND a.idx = z.idx AND a.speaker = z.speaker AND a.grp = z.grp AND z.k BETWEEN a.k AND a.k + {rules.ENGLISH_LIMIT}
  JOIN g x ON x.doc_id = a.doc_id AND x.idx = a.idx AND x.speaker = a.speaker AND x.grp = a.grp AND x.k BETWEEN a.k AND z.k WHERE z.free OR z.k = z.size GROUP BY ALL HAVING sum(length(x.shown) + 1) - 1 <= {rules.ENGLISH_LIMIT}),
l AS (SELECT *, letters >= greatest(1, han) AS latin FROM s),
q AS (SELECT doc_id, idx, speaker, grp, a, z, n, size, CAST(15 + CASE WHEN z = size THEN 0 ELSE cut_cost + CASE WHEN dangles THEN 180 ELSE 0 END END + CASE WHEN latin THEN CASE WHEN chars < 16 AND words > 1 THEN (16 - chars) * 12 ELSE 0 END + CASE WHEN words = 1 AND NOT called THEN 180 ELSE 0 END
    + CASE WHEN words > 1 AND took < {rules.SHORTEST} THEN 400 WHEN words > 1 AND took < 800 THEN 140 ELSE 0 END WHEN took < {rules.SHORTEST} AND han > 2 THEN 400 ELSE 0 END AS BIGINT) AS cost FROM l WHERE chars <= CASE WHEN latin THEN {rules.ENGLISH_LIMIT} ELSE {rules.OTHER_LIMIT} END),
p(doc_id, idx, speaker, grp, done, size, cues, cost, path) AS (
  SELECT doc_id, idx, speaker, grp, CAST(0 AS BIGINT), any_value(size), 0, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM g GROUP BY doc_id, idx, speaker, grp
  UNION ALL
  SELECT doc_id, idx, speaker, grp, z, any_value(size), cues + 1, min(o).cost, min(o).path FROM (
    SELECT q.doc_id, q.idx, q.speaker, q.grp, q.z, q.size, p.cues, {{'cost': p.cost + q.cost, 'a': q.a, 'path': CASE WHEN q.z = q.size THEN p.path ELSE list_append(p.path, q.n) END}} AS o
    FROM p JOIN q ON q.doc_id = p.doc_id AND q.idx = p.idx AND q.speaker = p.speaker AND q.grp = p.grp AND q.a = p.done + 1 WHERE p.cues < {_CUES}) GROUP BY doc_id, idx, speaker, grp, z, cues),
f AS (SELECT doc_id, idx, speaker, grp, min({{'cost': cost, 'cues': cues, 'path': path}}) AS best FROM p WHERE done = size AND cues > 0 GROUP BY doc_id, idx, speaker, grp)
SELECT d.doc_id, d.idx, d.speaker, CAST(d.grp AS BIGINT) AS grp, CAST(best.cues AS BIGINT) AS cues, best.cost AS cost, array_to_string(best.path, ',') AS breaks
FROM (SELECT DISTINCT doc_id, idx, speaker, grp FROM g) d LEFT JOIN f ON f.doc_id = d.doc_id AND f.idx = d.idx AND f.speaker = d.speaker AND f.grp = d.grp"""


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return speech(spark, sf_dir).withColumns({"text": F.regexp_replace("word", _MARKS, ""), "marks": F.regexp_extract("word", _MARKS, 0), "breaks": F.col("line_end")})


def _cut_query(name: str, column: str, sql: str) -> None:
    """A query of what the rules say of a cut after each word."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        got = planning.cuts(_units(spark, sf_dir), ["doc_id"])
        return got.withColumn("cost", F.col("cut_cost") + F.when(F.coalesce("dangling", F.lit(False)) & F.col("next_start").isNotNull(), 180).otherwise(0)).select("doc_id", "n", F.col(column))

    query(f"{_UNITS} SELECT doc_id, n, {sql} FROM u", name)(run)


_cut_query("fn_shared_envelope", "shared", "shared")
_cut_query("fn_geo_apposition", "place", "place")
_cut_query("fn_incomplete_cut", "incomplete", "incomplete")
_cut_query("fn_lexical_protected", "guarded", "guarded")
_cut_query("fn_boundary_cost", "cost", "CAST(cut_cost + CASE WHEN coalesce(dangling, false) AND NOT final THEN 180 ELSE 0 END AS BIGINT) AS cost")


@query(_CUTS)
def seg_optimize_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest line breaks of each sentence of a turn, in six cues at most; none where words are too long for a line."""
    turn = Window.partitionBy("doc_id", "idx", "speaker").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    said = _units(spark, sf_dir).withColumn("grp", F.coalesce(F.sum(F.col("mark").cast("long")).over(turn), F.lit(0)))
    got = planning.line_breaks(said, ["doc_id"], ["idx", "speaker", "grp"], most_cues=_CUES)
    return got.withColumn("breaks", F.array_join("breaks", ","))
