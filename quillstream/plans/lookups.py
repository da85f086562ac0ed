"""Searches in turns, blocks of turns, wrapped lines, differences of versions, track languages and stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import searching, versions
from .bindings import CUES, cues, table
from .registry import query
from .revisions import _CHANGES, _EVERY, changes
from .segmentation import SPEECH, speech

_TURN = ["doc_id", "idx", "speaker"]


@query(f"""WITH RECURSIVE {SPEECH}, t AS (SELECT doc_id, idx, speaker, lower(string_agg(word, ' ' ORDER BY n)) AS hay, lower(substr(arg_min(word, n), 1, 2)) AS q FROM speech GROUP BY doc_id, idx, speaker),
s AS (SELECT doc_id, idx, speaker, n, sum(length(word) + 1) OVER (PARTITION BY doc_id, idx, speaker ORDER BY n) - length(word) - 1 AS a, sum(length(word) + 1) OVER (PARTITION BY doc_id, idx, speaker ORDER BY n) - 1 AS z FROM speech),
m(doc_id, idx, speaker, hay, q, k, place) AS (SELECT doc_id, idx, speaker, hay, q, 0, CAST(instr(hay, q) - 1 AS BIGINT) FROM t
  UNION ALL SELECT doc_id, idx, speaker, hay, q, k + 1, CASE WHEN instr(substr(hay, place + length(q) + 1), q) > 0 THEN place + length(q) + instr(substr(hay, place + length(q) + 1), q) - 1 ELSE -1 END FROM m WHERE place >= 0),
c AS (SELECT m.doc_id, m.idx, m.speaker, k, min(s.n) AS first_n, max(s.n) AS last_n, min(s.a) AS a, any_value(place) AS place, any_value(length(q)) AS size FROM m JOIN s ON s.doc_id = m.doc_id AND s.idx = m.idx AND s.speaker = m.speaker AND s.z > place AND s.a < place + length(q) WHERE place >= 0 GROUP BY m.doc_id, m.idx, m.speaker, k)
SELECT doc_id, idx, speaker, CAST(row_number() OVER (PARTITION BY doc_id, idx, speaker ORDER BY k) - 1 AS BIGINT) AS match, first_n, last_n, CAST(place - a AS BIGINT) AS start_offset, CAST(place - a + size AS BIGINT) AS end_offset FROM c""")
def fn_search_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first two letters of a turn stand in its words, joined by spaces."""
    turns = speech(spark, sf_dir).groupBy(*_TURN).agg(F.sort_array(F.collect_list(F.struct("n", F.col("word").alias("text")))).alias("tokens"))
    return searching.matches(turns.withColumn("query", F.substring(F.col("tokens")[0]["text"], 1, 2)), _TURN, " ")


@query(rf"""WITH RECURSIVE {CUES}, o AS (SELECT doc_id, row_number() OVER w AS k, n_words > 8 AS active, speaker, start_ms, length(text) AS size, lag(speaker) OVER w AS before, lag(n_words > 8) OVER w AS was FROM cues WINDOW w AS (PARTITION BY doc_id ORDER BY idx, speaker)),
g AS (SELECT *, sum(CASE WHEN active AND NOT coalesce(was AND before = speaker, false) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS segment FROM o),
a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS j FROM g WHERE active),
b(doc_id, j, block, from_ms, held) AS (SELECT doc_id, j, CAST(1 AS BIGINT), start_ms, CAST(size AS BIGINT) FROM a WHERE j = 1
  UNION ALL SELECT a.doc_id, a.j, CASE WHEN a.start_ms - b.from_ms >= 90000 OR b.held + a.size > 1200 THEN b.block + 1 ELSE b.block END, CASE WHEN a.start_ms - b.from_ms >= 90000 OR b.held + a.size > 1200 THEN a.start_ms ELSE b.from_ms END,
    CASE WHEN a.start_ms - b.from_ms >= 90000 OR b.held + a.size > 1200 THEN a.size ELSE b.held + a.size END FROM b JOIN a ON a.doc_id = b.doc_id AND a.j = b.j + 1)
SELECT a.doc_id, a.k, CAST(a.segment AS BIGINT) AS segment, b.block FROM a JOIN b ON b.doc_id = a.doc_id AND b.j = a.j""")
def seg_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the turns of more than eight words, 90 seconds and 1,200 characters at most."""
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("idx", "speaker")).cast("long")
    own = cues(spark, sf_dir).select("doc_id", order.alias("k"), (F.col("n_words") > 8).alias("active"), "speaker", "start_ms", "text")
    return searching.text_blocks(own, ["doc_id"], 90_000, 1200)


@query(None)
def fn_wrap_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with explicit breaks for lines of 21.5 em; tests/test_searching.py has the rule step by step."""
    return cues(spark, sf_dir).select(*_TURN, searching.wrapped(F.regexp_replace("text", "\n", r"\\N"), 2150).alias("text"))


@query(f"""WITH {_CHANGES}, n AS (SELECT doc_id, max(rev) // 2 AS a, max(rev) * 3 // 4 AS b FROM changes GROUP BY doc_id),
x AS (SELECT doc_id, id, arg_max(value, rev) AS value, arg_max(removed, rev) AS removed FROM changes JOIN n USING (doc_id) WHERE rev <= a GROUP BY doc_id, id), y AS (SELECT doc_id, id, arg_max(value, rev) AS value, arg_max(removed, rev) AS removed FROM changes JOIN n USING (doc_id) WHERE rev <= b GROUP BY doc_id, id)
SELECT doc_id, id, 'remove' AS change, CAST(NULL AS DOUBLE) AS value FROM x WHERE NOT removed AND NOT EXISTS (SELECT 1 FROM y WHERE y.doc_id = x.doc_id AND y.id = x.id AND NOT y.removed)
UNION ALL SELECT doc_id, id, 'upsert', value FROM y WHERE NOT removed AND NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = y.doc_id AND x.id = y.id AND NOT x.removed AND x.value = y.value)""")
def join_full_outer_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed in each document between half and three quarters of its revisions."""
    log = changes(spark, sf_dir)
    kept = versions.snapshots(log, ["doc_id"], _EVERY)
    at = lambda share: versions.restored(log, kept, log.groupBy("doc_id").agg(F.expr(f"{share} AS rev")).where("rev > 0"), ["doc_id"], _EVERY).select("doc_id", "id", "value")
    return searching.difference(at("max(rev) div 2"), at("max(rev) * 3 div 4"), ["doc_id", "id"], ["value"])


@query(r"""WITH l AS (SELECT doc_id, text, CASE lang WHEN 'en' THEN '' ELSE lang END AS hint FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(text, '\p{Han}|\p{Hiragana}|\p{Katakana}|\p{Hangul}|\p{Greek}|\p{Cyrillic}|\p{Arabic}|\p{Hebrew}|\p{Thai}|\p{Devanagari}') THEN 'mixed' WHEN NOT regexp_matches(text, '\p{L}') THEN CASE WHEN hint IN ('zh', 'en', 'ja', 'ko') THEN hint ELSE 'other' END
  WHEN coalesce(hint, '') = '' THEN 'en' ELSE 'other' END AS language FROM l""")
def fn_cue_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document as a displayed track, with its own as a hint unless it is English; the SQL knows Latin texts only."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    return docs.select("doc_id", fn.cue_language(F.col("text"), F.when(F.col("lang") == "en", "").otherwise(F.col("lang"))).alias("language"))


@query(f"WITH {SPEECH} SELECT doc_id, n, start_ms AS srt_ms, CAST(round_even(start_ms / 10.0, 0) AS BIGINT) * 10 AS ass_ms, CAST(NULL AS BIGINT) AS bad FROM speech")
def fn_parse_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of words as stamps of both kinds, read back; a stamp without its hours is none."""
    s = speech(spark, sf_dir)
    srt = fn.stamp_srt(F.col("start_ms"))
    return s.select("doc_id", "n", fn.parse_stamp(srt).alias("srt_ms"), fn.parse_stamp(F.concat(fn.stamp_ass(F.col("start_ms")), F.lit("0"))).alias("ass_ms"), fn.parse_stamp(F.substring(srt, 4, 9)).alias("bad"))
