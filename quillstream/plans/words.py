"""Operators on the words of turns: cue texts, boundary evidence, costs and flags of cuts, annotations, language classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules
from ..functions import text as fn
from .bindings import CUES, cues, table
from .registry import query

KEY = ["doc_id", "idx", "speaker"]
HAN = r"[\x{3400}-\x{9FFF}]"
_FINAL = r"[.!?]+[\"')]*$"

# Words that begin a line well.
LINE_STARTS = ["and", "because", "but", "for", "if", "or", "so", "then", "when", "where", "which", "while", "who", "with"]

# Words of a turn take 400 ms each; a word whose hash says so is followed by a pause, and some are deleted.
WORDS = rf"""{CUES}, words AS (SELECT doc_id, idx, speaker, pos, word, start_ms + pos * 400 AS start_ms, start_ms + pos * 400 + CASE WHEN (pos + idx) % 5 = 0 THEN 100 WHEN (pos + idx) % 3 = 0 THEN 250 ELSE 400 END AS end_ms,
  (pos + doc_id) % 3 AS voice, (pos * 7 + idx) % 100 AS conf, pos % 9 = 4 AS deleted, -20 - (pos * 13 + idx) % 30 AS db
  FROM (SELECT doc_id, idx, speaker, start_ms, CAST(unnest(range(len(w))) AS BIGINT) AS pos, unnest(w) AS word FROM (SELECT *, regexp_extract_all(text, '[^\s]+') AS w FROM cues)))"""
_IN = "(PARTITION BY doc_id, idx, speaker ORDER BY pos"


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir).select(*KEY, "start_ms", F.posexplode(F.regexp_extract_all("text", F.lit(r"[^\s]+"), F.lit(0))).alias("pos", "word"))
    pos, idx = F.col("pos").cast("long"), F.col("idx")
    length = F.when((pos + idx) % 5 == 0, 100).when((pos + idx) % 3 == 0, 250).otherwise(400)
    return c.select(*KEY, pos.alias("pos"), "word", (F.col("start_ms") + pos * 400).alias("start_ms"), (F.col("start_ms") + pos * 400 + length).alias("end_ms"), ((pos + F.col("doc_id")) % 3).alias("voice"),
                    ((pos * 7 + idx) % 100).alias("conf"), (pos % 9 == 4).alias("deleted"), (F.lit(-20) - (pos * 13 + idx) % 30).alias("db"))


def _w(*order):
    return Window.partitionBy(*KEY).orderBy(*(order or ("pos",)))


def _upto():
    return _w().rowsBetween(Window.unboundedPreceding, 0)


def _bare(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z']", ""))


_BARE = "lower(regexp_replace({0}, '[^A-Za-z'']', '', 'g'))"


def _list(values: list[str]) -> str:
    return "(" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + ")"


def words_query(name: str, cols, sql: str, where: str = "") -> None:
    """A query over words with columns that may look at neighbours, maybe filtered by them."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = cols()
        got = words(spark, sf_dir).withColumns(own)
        return (got.where(where) if where else got).select(*KEY, "pos", *own)

    query(f"WITH {WORDS}, w AS (SELECT doc_id, idx, speaker, pos, {sql}" + (", deleted" if where == "NOT deleted" else "") + f" FROM words) SELECT * {'EXCLUDE (deleted) ' if where == 'NOT deleted' else ''}FROM w" + (f" WHERE {where}" if where else ""), name)(run)


def _next(name: str) -> Column:
    return F.lead(name).over(_w())


_GAP = f"greatest(0, coalesce(lead(start_ms) OVER {_IN}), end_ms) - end_ms)"


def _gap() -> Column:
    return F.greatest(F.lit(0), F.coalesce(_next("start_ms"), F.col("end_ms")) - F.col("end_ms"))


def _change() -> Column:
    return F.coalesce((_next("voice") != F.col("voice")) & (F.least("conf", _next("conf")) >= 75), F.lit(False))


_CHANGE = f"coalesce(lead(voice) OVER {_IN}) <> voice AND least(conf, lead(conf) OVER {_IN})) >= 75, false)"
_LAST = f"lead(word) OVER {_IN}) IS NULL"

#: Twelve points for each second of pause up to two, eighteen for a sentence's end, twelve for its mark, a hundred for another voice; function words never end a line.
words_query(
    "win_boundary_quality",
    lambda: {"quality": F.when(F.col("pos") % 11 == 10, -18).otherwise(0) - F.when(F.col("word").rlike(_FINAL), 12).otherwise(0) - F.expr("0") - F.floor(F.least(_gap(), F.lit(2000)) * 12 / 1000) - F.when(_change(), 100).otherwise(0)
             + F.when(_next("word").isNotNull() & ~F.col("word").rlike(_FINAL) & _bare(F.col("word")).isin(rules.DANGLING), 1000).otherwise(0)},
    rf"""CAST(CASE WHEN pos % 11 = 10 THEN -18 ELSE 0 END - CASE WHEN regexp_matches(word, '{_FINAL.replace("'", "''")}') THEN 12 ELSE 0 END - least({_GAP}, 2000) * 12 // 1000 - CASE WHEN {_CHANGE} THEN 100 ELSE 0 END
      + CASE WHEN lead(word) OVER {_IN}) IS NOT NULL AND NOT regexp_matches(word, '{_FINAL.replace("'", "''")}') AND {_BARE.format('word')} IN {_list(rules.DANGLING)} THEN 1000 ELSE 0 END AS BIGINT) AS quality""",
)
#: Evidence for a seam near a target, in thousandths: distance against, another voice, the pause up to two seconds and quiet for it.
words_query(
    "win_evidence_score",
    lambda: {"score": -F.abs(F.col("end_ms") - 6000) + F.when(_change(), 150000).otherwise(0) + F.least(_gap(), F.lit(2000)) * 70 + F.when(F.least("db", F.coalesce(_next("db"), F.col("db"))) <= -42, 65000).otherwise(0)},
    f"-abs(end_ms - 6000) + CASE WHEN {_CHANGE} THEN 150000 ELSE 0 END + least({_GAP}, 2000) * 70 + CASE WHEN least(db, coalesce(lead(db) OVER {_IN}), db)) <= -42 THEN 65000 ELSE 0 END AS score",
)
words_query("filter_low_volume", lambda: {"low": F.least("db", F.coalesce(_next("db"), F.col("db")))}, f"least(db, coalesce(lead(db) OVER {_IN}), db)) AS low", where="low <= -42")
words_query("filter_active", lambda: {"token": F.col("word")}, "word AS token", where="NOT deleted")
words_query("fn_unpunctuated_word", lambda: {"bare": F.regexp_replace("word", r"^[.,;:!?\"'()]+|[.,;:!?\"'()]+$", "")}, r"""regexp_replace(word, '^[.,;:!?"''()]+|[.,;:!?"''()]+$', '', 'g') AS bare""")
words_query(
    "fn_boundary_flags",
    lambda: {"flags": F.concat_ws(",", F.when(_bare(F.col("word")).isin(rules.DANGLING), F.concat(F.lit("open-end:"), _bare(F.col("word")))), F.when(_bare(F.col("word")).endswith("'s"), F.lit("possessive-head-split")),
             F.when(_bare(F.col("word")).endswith("ing") & _bare(_next("word")).isin("a", "an", "the", "this", "that", "these", "those"), F.lit("verb-object-split")))},
    rf"""concat_ws(',', CASE WHEN {_BARE.format('word')} IN {_list(rules.DANGLING)} THEN 'open-end:' || {_BARE.format('word')} END, CASE WHEN ends_with({_BARE.format('word')}, '''s') THEN 'possessive-head-split' END,
      CASE WHEN ends_with({_BARE.format('word')}, 'ing') AND {_BARE.format(f'lead(word) OVER {_IN})')} IN ('a', 'an', 'the', 'this', 'that', 'these', 'those') THEN 'verb-object-split' END) AS flags""",
)
#: The place of each unit in the text that the words make without spaces.
words_query(
    "win_char_ranges",
    lambda: {"last_char": F.sum(F.length("word")).over(_upto()), "first_char": F.sum(F.length("word")).over(_upto()) - F.length("word")},
    f"CAST(sum(length(word)) OVER {_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS last_char, CAST(sum(length(word)) OVER {_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(word) AS BIGINT) AS first_char",
)


def _islands(flag: Column, name: str = "run") -> Column:
    return F.sum(flag.cast("int")).over(_upto()).alias(name)


@query(rf"WITH {WORDS}, f AS (SELECT *, CASE WHEN pos % 13 = 0 OR lag(pos % 11 = 10) OVER {_IN}) OR lag(pos) OVER {_IN}) IS NULL THEN 1 ELSE 0 END AS starts FROM words), r AS (SELECT *, sum(starts) OVER {_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f) SELECT doc_id, idx, speaker, CAST(run AS BIGINT) AS segment, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(word, ' ' ORDER BY pos) AS text FROM r GROUP BY 1, 2, 3, 4")
def win_recognition_segments(spark, sf_dir):
    """Segments that begin at a sentence's start (every 13th word) and after a sentence's end (every 11th)."""
    starts = (F.col("pos") % 13 == 0) | F.coalesce(F.lag(F.col("pos") % 11 == 10).over(_w()), F.lit(True))
    r = words(spark, sf_dir).withColumn("starts", starts.cast("int")).withColumn("segment", F.sum("starts").over(_upto()))
    g = r.groupBy(*KEY, "segment").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("w"))
    return g.select(*KEY, "segment", "start_ms", "end_ms", F.array_join("w.word", " ").alias("text"))


@query(rf"WITH {WORDS}, f AS (SELECT *, CASE WHEN coalesce(lag(voice) OVER {_IN}), -1) <> voice THEN 1 ELSE 0 END AS starts FROM words WHERE conf >= 30), r AS (SELECT *, sum(starts) OVER {_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM f) SELECT doc_id, idx, speaker, CAST(run AS BIGINT) AS run, max(voice) AS voice, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM r GROUP BY 1, 2, 3, 4")
def win_runs_by_action(spark, sf_dir):
    """Runs of consecutive rows of one action (voice), among the rows that are sure enough."""
    r = words(spark, sf_dir).where("conf >= 30").withColumn("starts", (F.coalesce(F.lag("voice").over(_w()), F.lit(-1)) != F.col("voice")).cast("int")).withColumn("run", F.sum("starts").over(_upto()))
    return r.groupBy(*KEY, "run").agg(F.max("voice").alias("voice"), F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


@query(rf"WITH {WORDS}, k AS (SELECT *, pos - row_number() OVER {_IN}) AS island FROM words WHERE NOT deleted AND conf % 10 <> 3) SELECT doc_id, idx, speaker, min(pos) AS first_pos, max(pos) AS last_pos, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM k GROUP BY doc_id, idx, speaker, island")
def win_keep_runs(spark, sf_dir):
    """Kept units that follow each other collapse to one run."""
    k = words(spark, sf_dir).where("NOT deleted AND conf % 10 <> 3").withColumn("island", F.col("pos") - F.row_number().over(_w()))
    return k.groupBy(*KEY, "island").agg(F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")).drop("island")


_SEP = f"CASE WHEN lag(word) OVER {_IN}) IS NULL THEN '' WHEN regexp_matches(right(lag(word) OVER {_IN}), 1), '{HAN}') AND regexp_matches(left(word, 1), '{HAN}') THEN '' ELSE ' ' END"


@query(rf"WITH {WORDS}, s AS (SELECT *, {_SEP} || word AS part FROM words WHERE NOT deleted) SELECT doc_id, idx, speaker, string_agg(part, '' ORDER BY pos) AS text FROM s GROUP BY 1, 2, 3")
def project_cue_text(spark, sf_dir):
    """The text of each cue from its active tokens: no space between Han characters, one elsewhere."""
    before = F.lag("word").over(_w())
    apart = F.when(before.isNull() | F.substring(before, -1, 1).rlike(HAN) & F.substring("word", 1, 1).rlike(HAN), "").otherwise(" ")
    s = words(spark, sf_dir).where("NOT deleted").withColumn("part", F.concat(apart, "word"))
    return s.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("p")).select(*KEY, F.array_join("p.part", "").alias("text"))


@query(rf"WITH {WORDS} SELECT doc_id, idx, speaker, string_agg(word, ' ' ORDER BY pos) AS text, sha256(string_agg(word, ' ' ORDER BY pos)) AS source_hash FROM words WHERE NOT deleted GROUP BY 1, 2, 3")
def project_cue_text_spaced(spark, sf_dir):
    s = words(spark, sf_dir).where("NOT deleted").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("p")).select(*KEY, F.array_join("p.word", " ").alias("text"))
    return s.withColumn("source_hash", F.sha2("text", 256))


@query(rf"WITH {WORDS} SELECT doc_id, idx, speaker, 'cue_' || substr(sha256(concat_ws('|', doc_id, idx, speaker, string_agg(word, ' ' ORDER BY pos))), 1, 24) AS stable_id, count(*) AS n_tokens, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS tokens FROM words WHERE NOT deleted GROUP BY 1, 2, 3")
def project_external_rows(spark, sf_dir):
    """A cue as a record to exchange: an id derived from its content, and its tokens."""
    s = words(spark, sf_dir).where("NOT deleted").groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "word"))).alias("p"))
    own = F.concat(F.lit("cue_"), F.substring(F.sha2(F.concat_ws("|", *KEY, F.array_join("p.word", " ")), 256), 1, 24))
    return s.select(*KEY, own.alias("stable_id"), F.size("p").cast("long").alias("n_tokens"), F.array_join(F.col("p.pos").cast("array<string>"), ",").alias("tokens"))


@query("SELECT page_id, 'page_' || substr(sha256(concat_ws('|', 'pages', page_id, url)), 1, 24) AS stable_id FROM pages")
def project_stable_id(spark, sf_dir):
    """A key derived from the namespace and content: the first 24 hex digits of SHA-256."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.concat(F.lit("page_"), F.substring(F.sha2(F.concat_ws("|", F.lit("pages"), "page_id", "url"), 256), 1, 24)).alias("stable_id"))


_MARKED = "CASE WHEN pos % 6 = 1 THEN word || '//' WHEN pos % 6 = 3 THEN word || '/fixed/' WHEN pos % 6 = 5 THEN 'uh//' || word ELSE word END"
_PLAIN = r"CASE WHEN ends_with(t, '//') THEN '' WHEN regexp_matches(t, '^[^/]+//[^/].*$') THEN regexp_extract(t, '^[^/]+//([^/].*)$', 1) WHEN regexp_matches(t, '^[^/]+/[^/]+/$') THEN regexp_extract(t, '^[^/]+/([^/]+)/$', 1) ELSE t END"


def _marked(spark, sf_dir) -> DataFrame:
    """Turns whose words carry marks: 'word//' deletes a word, 'old/new/' corrects it, 'cut//word' deletes what stands before."""
    word = F.col("word")
    mark = F.when(F.col("pos") % 6 == 1, F.concat(word, F.lit("//"))).when(F.col("pos") % 6 == 3, F.concat(word, F.lit("/fixed/"))).when(F.col("pos") % 6 == 5, F.concat(F.lit("uh//"), word)).otherwise(word)
    return words(spark, sf_dir).where("word NOT LIKE '%/%'").withColumn("marked", mark).groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("pos", "marked"))).alias("m")).select(*KEY, F.col("m.marked").alias("raw"))


def plain_token(t: Column) -> Column:
    """What an annotated token shows: nothing, the correction or the token itself."""
    return F.when(t.endswith("//"), "").when(t.rlike("^[^/]+//[^/].*$"), F.regexp_extract(t, "^[^/]+//([^/].*)$", 1)).when(t.rlike("^[^/]+/[^/]+/$"), F.regexp_extract(t, "^[^/]+/([^/]+)/$", 1)).otherwise(t)


_RAW = rf"{WORDS}, raw AS (SELECT doc_id, idx, speaker, list({_MARKED} ORDER BY pos) AS raw FROM words WHERE word NOT LIKE '%/%' GROUP BY 1, 2, 3), shown AS (SELECT *, list_filter(list_transform(raw, lambda t: {_PLAIN}), lambda t: t <> '') AS shown FROM raw)"


@query(rf"WITH {_RAW} SELECT doc_id, idx, speaker, array_to_string(raw, ' ') AS raw_text, array_to_string(shown, ' ') AS display, CAST(len(raw) - len(shown) AS BIGINT) AS n_deleted FROM shown")
def project_annotations(spark, sf_dir):
    shown = _marked(spark, sf_dir).withColumn("shown", F.filter(F.transform("raw", plain_token), lambda t: t != ""))
    return shown.select(*KEY, F.array_join("raw", " ").alias("raw_text"), F.array_join("shown", " ").alias("display"), (F.size("raw") - F.size("shown")).cast("long").alias("n_deleted"))


@query(rf"WITH {_RAW} SELECT doc_id, idx, speaker, CAST(length(array_to_string(shown, '')) AS BIGINT) AS n FROM shown")
def fn_display_length(spark, sf_dir):
    """The length that annotated text shows, without spaces."""
    return _marked(spark, sf_dir).select(*KEY, F.length(F.array_join(F.transform("raw", plain_token), "")).cast("long").alias("n"))


_COUNT = "len(regexp_extract_all(text, '{0}'))"
_SCRIPTS = {"han": HAN, "kana": r"[\x{3040}-\x{30FF}\x{31F0}-\x{31FF}]", "hangul": r"[\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{AC00}-\x{D7AF}]", "latin": "[A-Za-z]"}


def language_class(c: Column) -> Column:
    """Class by counted scripts: a few Latin letters don't make a Chinese line English."""
    n = {k: F.regexp_count(c, F.lit(p)) for k, p in _SCRIPTS.items()}
    mixed = F.when(n["han"] >= F.greatest(F.lit(2.0), n["latin"] * 0.55), "mixed_zh").otherwise("mixed_en")
    return F.when(n["hangul"] > 0, "ko").when(n["kana"] > 0, "ja").when((n["han"] == 0) & (n["latin"] == 0), "neutral").when(n["latin"] == 0, "zh").when(n["han"] == 0, "en").otherwise(mixed)


def _class_sql() -> str:
    n = {k: _COUNT.format(p) for k, p in _SCRIPTS.items()}
    return f"CASE WHEN {n['hangul']} > 0 THEN 'ko' WHEN {n['kana']} > 0 THEN 'ja' WHEN {n['han']} = 0 AND {n['latin']} = 0 THEN 'neutral' WHEN {n['latin']} = 0 THEN 'zh' WHEN {n['han']} = 0 THEN 'en' WHEN {n['han']} >= greatest(2.0, {n['latin']} * 0.55) THEN 'mixed_zh' ELSE 'mixed_en' END"


#: Documents with a Chinese ending of varying length, so that every class occurs.
_TEXTS = "t AS (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN text || repeat('汉字', CAST(length(text) AS INTEGER)) WHEN 1 THEN '汉字' WHEN 2 THEN '12 %' WHEN 3 THEN text || ' 한국' WHEN 4 THEN text || 'カナ' ELSE text END AS text FROM documents WHERE text IS NOT NULL)"


def _texts(spark, sf_dir) -> DataFrame:
    d, t = table(spark, sf_dir, "documents").where("text IS NOT NULL"), F.col("text")
    k = F.col("doc_id") % 6
    return d.select("doc_id", F.when(k == 0, F.concat(t, F.expr("repeat('汉字', cast(length(text) as int))"))).when(k == 1, "汉字").when(k == 2, "12 %").when(k == 3, F.concat(t, F.lit(" 한국"))).when(k == 4, F.concat(t, F.lit("カナ"))).otherwise(t).alias("text"))


@query(rf"WITH {_TEXTS} SELECT doc_id, {_class_sql()} AS class FROM t")
def fn_classify_language(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", language_class(F.col("text")).alias("class"))


@query(rf"WITH {_TEXTS} SELECT doc_id, CASE {_class_sql()} WHEN 'zh' THEN 'zh-CN' WHEN 'mixed_zh' THEN 'zh-CN' WHEN 'ja' THEN 'ja' WHEN 'ko' THEN 'ko' WHEN 'neutral' THEN 'neutral' ELSE 'en' END AS base FROM t")
def fn_base_language(spark, sf_dir):
    c = language_class(F.col("text"))
    return _texts(spark, sf_dir).select("doc_id", F.when(c.isin("zh", "mixed_zh"), "zh-CN").when(c.isin("ja", "ko", "neutral"), c).otherwise("en").alias("base"))


_FAMILIES = {"ar": r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}]", "th": r"[\x{0E00}-\x{0E7F}]", "ru": r"[\x{0400}-\x{052F}]", "el": r"[\x{0370}-\x{03FF}]", "hi": r"[\x{0900}-\x{097F}]"}


@query(rf"WITH {_TEXTS}, f AS (SELECT doc_id, regexp_matches(text, '{_SCRIPTS['kana']}') AS kana, regexp_matches(text, '{HAN}') AS han, regexp_matches(text, '{_SCRIPTS['hangul']}') AS hangul, regexp_matches(text, '[A-Za-z]') AS latin, {', '.join(f"regexp_matches(text, '{p}') AS f_{k}" for k, p in _FAMILIES.items())} FROM t) SELECT doc_id, CASE WHEN CAST(kana OR han AS INTEGER) + CAST(hangul AS INTEGER) + CAST(latin AS INTEGER) + {' + '.join(f'CAST(f_{k} AS INTEGER)' for k in _FAMILIES)} > 1 THEN 'mixed' {' '.join(f"WHEN f_{k} THEN '{k}'" for k in _FAMILIES)} WHEN kana THEN 'ja' WHEN hangul THEN 'ko' WHEN han THEN 'zh-CN' ELSE 'en' END AS route FROM f")
def fn_route_language(spark, sf_dir):
    """One script family gives its language, several give 'mixed'; kana and Han are one family."""
    has = {k: F.col("text").rlike(p) for k, p in (_SCRIPTS | _FAMILIES).items()}
    n = (has["kana"] | has["han"]).cast("int") + has["hangul"].cast("int") + has["latin"].cast("int") + sum(has[k].cast("int") for k in _FAMILIES)
    out = F.when(n > 1, "mixed")
    for k in _FAMILIES:
        out = out.when(has[k], k)
    return _texts(spark, sf_dir).select("doc_id", out.when(has["kana"], "ja").when(has["hangul"], "ko").when(has["han"], "zh-CN").otherwise("en").alias("route"))


_PAIRS = rf"{CUES}, p AS (SELECT doc_id, idx, speaker, trim(text) AS l, trim(coalesce(lead(text) OVER (PARTITION BY doc_id ORDER BY idx, speaker), '')) AS r FROM cues)"


def _pairs(spark, sf_dir) -> DataFrame:
    after = F.lead("text").over(Window.partitionBy("doc_id").orderBy("idx", "speaker"))
    return cues(spark, sf_dir).select(*KEY, F.trim("text").alias("l"), F.trim(F.coalesce(after, F.lit(""))).alias("r"))


_CLOSING, _OPENING = r"^[，。！？、；：,.!?;:%)\]}”’》〉」』]", r"[(\[{“‘《〈「『]$"


@query(rf"WITH {_PAIRS} SELECT doc_id, idx, speaker, CASE WHEN l = '' THEN r WHEN r = '' THEN l WHEN regexp_matches(r, '{_CLOSING}') OR regexp_matches(l, '{_OPENING}') OR (regexp_matches(l, '{HAN}$') AND regexp_matches(r, '^{HAN}')) THEN l || r ELSE l || ' ' || r END AS joined FROM p")
def fn_join_parts(spark, sf_dir):
    """Two texts joined with a space where the scripts and marks at the seam ask for one."""
    tight = F.col("r").rlike(_CLOSING) | F.col("l").rlike(_OPENING) | F.col("l").rlike(f"{HAN}$") & F.col("r").rlike(f"^{HAN}")
    return _pairs(spark, sf_dir).select(*KEY, F.when(F.col("l") == "", F.col("r")).when(F.col("r") == "", F.col("l")).when(tight, F.concat("l", "r")).otherwise(F.concat_ws(" ", "l", "r")).alias("joined"))


@query(rf"WITH {_PAIRS} SELECT doc_id, idx, speaker, CAST(-greatest(0, length(l) - 50) * 3 + CASE WHEN regexp_matches(l, '[,;:，；：]$') THEN 160 ELSE 0 END + CASE WHEN lower(regexp_extract(r, '^[\x22''(]*([^\s\x22''(]*)', 1)) IN {_list(LINE_STARTS)} THEN 110 ELSE 0 END - greatest(0, 18 - length(l)) * 30 - greatest(0, 12 - length(r)) * 30 AS BIGINT) AS score FROM p")
def fn_candidate_score(spark, sf_dir):
    """How well a split stands between two parts, in tenths: clause marks and line starters for it, long and short parts against it."""
    n = lambda c: F.length(c).cast("long")
    first = F.lower(F.regexp_extract("r", r"^[\x22'(]*([^\s\x22'(]*)", 1))
    score = -F.greatest(F.lit(0), n("l") - 50) * 3 + F.when(F.col("l").rlike("[,;:，；：]$"), 160).otherwise(0) + F.when(first.isin(LINE_STARTS), 110).otherwise(0) - F.greatest(F.lit(0), 18 - n("l")) * 30 - F.greatest(F.lit(0), 12 - n("r")) * 30
    return _pairs(spark, sf_dir).select(*KEY, score.alias("score"))


@query(rf"WITH {CUES} SELECT doc_id, idx, speaker, CAST(CASE WHEN length(text) < 16 AND n_words > 1 THEN (16 - length(text)) * 12 ELSE 0 END + CASE WHEN n_words = 1 AND NOT regexp_matches(text, '[?!]\s*$') THEN 180 ELSE 0 END + CASE WHEN n_words > 1 AND end_ms - start_ms < 700 THEN 400 WHEN n_words > 1 AND end_ms - start_ms < 800 THEN 140 ELSE 0 END AS BIGINT) AS cost FROM cues")
def fn_segment_cost(spark, sf_dir):
    """What a line costs, in tenths: short lines, lone words and brief times."""
    n, words_, took = F.length("text").cast("long"), F.col("n_words"), F.col("end_ms") - F.col("start_ms")
    cost = F.when((n < 16) & (words_ > 1), (16 - n) * 12).otherwise(0) + F.when((words_ == 1) & ~F.col("text").rlike(r"[?!]\s*$"), 180).otherwise(0) + F.when((words_ > 1) & (took < 700), 400).when((words_ > 1) & (took < 800), 140).otherwise(0)
    return cues(spark, sf_dir).select(*KEY, cost.cast("long").alias("cost"))


@query(rf"SELECT doc_id, struct_extract(list_sort(list_transform(string_split(text, chr(10)), lambda x: struct_pack(d := len(regexp_extract_all(x, '[A-Za-z]')) - len(regexp_extract_all(x, '{HAN}')), l := len(regexp_extract_all(x, '[A-Za-z]')), line := x)), 'DESC')[1], 'line') AS line FROM documents WHERE text IS NOT NULL")
def fn_source_line_choice(spark, sf_dir):
    """Of a text's lines the one with the most Latin letters over Han characters."""
    count = lambda x, p: F.regexp_count(x, F.lit(p))
    lines = F.transform(F.split("text", "\n"), lambda x: F.struct((count(x, "[A-Za-z]") - count(x, HAN)).alias("d"), count(x, "[A-Za-z]").alias("l"), x.alias("line")))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.array_max(lines)["line"].alias("line"))


@query(rf"WITH f AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\s+', '', 'g'))) AS n, text FROM documents WHERE text IS NOT NULL) SELECT doc_id, concat_ws(',', CASE WHEN list_max(n) > 42 THEN 'source_over_42_soft' END, CASE WHEN list_max(n) > 49 THEN 'source_over_49_hard' END, CASE WHEN len(regexp_extract_all(text, '{HAN}')) > 18 THEN 'target_over_18_soft' END, CASE WHEN len(regexp_extract_all(text, '{HAN}')) > 24 THEN 'target_over_24_hard' END, CASE WHEN regexp_matches(text, '[,.]') THEN 'requires_lower_punctuation_normalization' END) AS flags FROM f")
def fn_legacy_flags(spark, sf_dir):
    longest, han = F.array_max(F.transform(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, r"\s+", "")))), F.regexp_count("text", F.lit(HAN))
    flags = [(longest > 42, "source_over_42_soft"), (longest > 49, "source_over_49_hard"), (han > 18, "target_over_18_soft"), (han > 24, "target_over_24_hard"), (F.col("text").rlike("[,.]"), "requires_lower_punctuation_normalization")]
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.concat_ws(",", *[F.when(c, F.lit(name)) for c, name in flags]).alias("flags"))


_PIECE = r"[A-Za-z0-9']+|" + HAN + r"|[^A-Za-z0-9'\x{3400}-\x{9FFF}]+"


@query(rf"""WITH {CUES}, p AS (SELECT doc_id, idx, speaker, unnest(regexp_extract_all(text, '{_PIECE.replace("'", "''")}')) AS piece, unnest(range(len(regexp_extract_all(text, '{_PIECE.replace("'", "''")}')))) AS pos FROM cues), o AS (SELECT *, sum(length(piece)) OVER {_IN} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - length(piece) AS first_char FROM p) SELECT doc_id, idx, speaker, CAST(first_char AS BIGINT) AS first_char, CAST(first_char + length(piece) AS BIGINT) AS last_char, lower(piece) AS token FROM o WHERE regexp_matches(piece, '[A-Za-z0-9'']|{HAN}')""")
def fn_lexical_tokens(spark, sf_dir):
    """Words and single Han characters, folded, with their places in the text."""
    p = cues(spark, sf_dir).select(*KEY, F.posexplode(F.regexp_extract_all("text", F.lit(_PIECE), F.lit(0))).alias("pos", "piece"))
    p = p.withColumn("last_char", F.sum(F.length("piece")).over(_upto()))
    return p.where(F.col("piece").rlike(f"[A-Za-z0-9']|{HAN}")).select(*KEY, (F.col("last_char") - F.length("piece")).alias("first_char"), "last_char", F.lower("piece").alias("token"))


_ABBREVIATED = ["dr", "e", "etc", "g", "i", "jr", "mr", "mrs", "ms", "no", "prof", "sr", "st", "vs"]


@query(rf"SELECT doc_id, len(list_filter(regexp_extract_all(text, '([A-Za-z]+)[.!?]+\s+[A-Z]', 1), lambda w: lower(w) NOT IN {_list(_ABBREVIATED)})) > 0 AS inside FROM documents WHERE text IS NOT NULL")
def fn_internal_sentence_boundary(spark, sf_dir):
    """Whether a sentence ends inside the text; abbreviations don't end one."""
    ends = F.filter(F.regexp_extract_all("text", F.lit(r"([A-Za-z]+)[.!?]+\s+[A-Z]"), F.lit(1)), lambda w: ~F.lower(w).isin(_ABBREVIATED))
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", (F.size(ends) > 0).alias("inside"))


_NUMBERS = "n AS (SELECT o_orderkey, 'sums ' || format('{:,}', o_orderkey * 7919 * 1000003) || ', then ' || format('{:,}', o_orderkey) || ',000,12 and 1,2' AS text FROM orders)"
_GROUPED = "^[0-9]{1,3}(,[0-9]{3})+,*$"


def without_grouping_commas(c: Column) -> Column:
    """Takes the commas out of numbers that are grouped by threes throughout; other commas stay."""
    pieces = F.regexp_extract_all(c, F.lit("[0-9,]+|[^0-9,]+"), F.lit(0))
    bare = lambda p: F.concat(F.regexp_replace(p, ",", ""), F.regexp_extract(p, ",*$", 0))
    return F.array_join(F.transform(pieces, lambda p: F.when(p.rlike(_GROUPED), bare(p)).otherwise(p)), "")


@query(rf"WITH {_NUMBERS} SELECT o_orderkey, array_to_string(list_transform(regexp_extract_all(text, '[0-9,]+|[^0-9,]+'), lambda p: CASE WHEN regexp_matches(p, '{_GROUPED}') THEN replace(p, ',', '') || regexp_extract(p, ',*$') ELSE p END), '') AS text FROM n")
def fn_remove_grouping_commas(spark, sf_dir):
    k = F.col("o_orderkey")
    text = F.concat(F.lit("sums "), F.format_number(k * 7919 * 1000003, 0), F.lit(", then "), F.format_number(k, 0), F.lit(",000,12 and 1,2"))
    return table(spark, sf_dir, "orders").select("o_orderkey", without_grouping_commas(text).alias("text"))


@query("SELECT event_id, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 360000000 AS ms, printf('%d:%02d:%02d.%02d', cs // 360000, cs // 6000 % 60, cs // 100 % 60, cs % 100) AS stamp FROM (SELECT *, CAST(round_even((CAST(floor(epoch_us(ts) / 1000) AS BIGINT) % 360000000) / 10.0, 0) AS BIGINT) AS cs FROM events)")
def fn_stamp_ass(spark, sf_dir):
    from .bindings import micros

    ms = F.floor(micros("ts") / 1000) % 360000000
    return table(spark, sf_dir, "events").select("event_id", ms.alias("ms"), fn.stamp_ass(ms).alias("stamp"))


_NORMAL = r"lower(trim(regexp_replace(regexp_replace({0}, '[\x{{2018}}\x{{2019}}]', '''', 'g'), '\s+', ' ', 'g')))"


def comparison_key(c: Column) -> Column:
    """Text for comparison: apostrophes of one kind, decimals kept, other marks and all spaces gone."""
    one = F.regexp_replace(F.regexp_replace(c, r"[\x{2018}\x{2019}]", "'"), r"([0-9])\.([0-9])", "$1·$2")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(one), r"[.,;:!?\"]", ""), r"\s+", ""), "·", ".")


def display_normal(c: Column) -> Column:
    """Text for display: apostrophes of one kind, sentence and clause marks become spaces, decimals stay, spaces squeezed."""
    one = F.regexp_replace(F.regexp_replace(c, r"[\x{2018}\x{2019}]", "'"), r"([0-9])\.([0-9])", "$1·$2")
    return F.regexp_replace(F.trim(F.regexp_replace(F.regexp_replace(one, r"[.,;:!?]", " "), r"\s+", " ")), "·", ".")


_ONE = r"regexp_replace(regexp_replace(text, '[\x{2018}\x{2019}]', '''', 'g'), '([0-9])\.([0-9])', '\1·\2', 'g')"


@query(rf"""SELECT doc_id, md5(replace(regexp_replace(regexp_replace(lower({_ONE}), '[.,;:!?"]', '', 'g'), '\s+', '', 'g'), '·', '.')) AS result FROM documents WHERE text IS NOT NULL""")
def project_comparison_key(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(comparison_key(F.col("text")).cast("binary")).alias("result"))


@query(rf"SELECT doc_id, md5(replace(trim(regexp_replace(regexp_replace({_ONE}, '[.,;:!?]', ' ', 'g'), '\s+', ' ', 'g')), '·', '.')) AS result FROM documents WHERE text IS NOT NULL")
def project_display_normalize(spark, sf_dir):
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(display_normal(F.col("text")).cast("binary")).alias("result"))


@query(rf"SELECT doc_id, md5(replace(trim(regexp_replace(regexp_replace(regexp_replace(replace({_ONE}, '—', ' '), '[.!?]', '', 'g'), '[,;:]', ' ', 'g'), '\s+', ' ', 'g')), '·', '.')) AS result FROM documents WHERE text IS NOT NULL")
def project_line_punctuation(spark, sf_dir):
    """A track's rules: sentence marks go, clause marks and dashes become spaces, decimal points stay."""
    one = F.regexp_replace(F.regexp_replace("text", r"[\x{2018}\x{2019}]", "'"), r"([0-9])\.([0-9])", "$1·$2")
    bare = F.regexp_replace(F.regexp_replace(F.replace(one, F.lit("—"), F.lit(" ")), "[.!?]", ""), "[,;:]", " ")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), "·", ".").cast("binary")).alias("result"))


_SECRET = "(?i)(secret|token|password|api_?key|^k$)"


@query("SELECT event_id, len(list_filter(json_keys(props), lambda x: regexp_matches(x, '(?i)(secret|token|password|api_?key|^k$)'))) > 0 AND event_id % 3 = 0 AS rejected FROM events")
def fn_secret_reject(spark, sf_dir):
    """Records whose JSON has a key named like a secret are rejected (asked of every third record)."""
    keys = F.filter(F.json_object_keys("props"), lambda x: x.rlike(_SECRET))
    return table(spark, sf_dir, "events").select("event_id", (F.size(keys) > 0).__and__(F.col("event_id") % 3 == 0).alias("rejected"))


@query(r"SELECT doc_id, md5(regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[email]', 'g'), '(sk|AKIA|ghp)[-_A-Za-z0-9]{8,}', '[secret]', 'g')) AS result FROM documents WHERE text IS NOT NULL")
def fn_runtime_safe(spark, sf_dir):
    """Text with mail addresses and keys redacted."""
    safe = F.regexp_replace(F.regexp_replace("text", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[email]"), "(sk|AKIA|ghp)[-_A-Za-z0-9]{8,}", "[secret]")
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.md5(safe.cast("binary")).alias("result"))


@query(r"SELECT event_id, CAST(json_extract_string(regexp_extract(reply, '(\{[^{}]*\})', 1), '$.k') AS BIGINT) AS k FROM (SELECT event_id, 'Sure:' || chr(10) || '```json' || chr(10) || props || chr(10) || '```' AS reply FROM events)")
def fn_extract_json_reply(spark, sf_dir):
    """The JSON object of a fenced reply."""
    reply = F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object(F.regexp_extract(reply, r"(\{[^{}]*\})", 1), "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, sha256('{\"brand\":\"' || p_brand || '\",\"size\":' || p_size || ',\"type\":\"' || p_type || '\"}') AS fingerprint FROM part")
def fn_fingerprint(spark, sf_dir):
    """SHA-256 of a record as compact JSON with sorted keys."""
    own = F.struct(F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), F.col("p_type").alias("type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.sha2(F.to_json(own), 256).alias("fingerprint"))


@query("SELECT p_brand, sha256(string_agg(sha256(p_partkey || ':' || p_name), '' ORDER BY p_partkey)) AS tree FROM part GROUP BY 1")
def fn_tree_hash(spark, sf_dir):
    """One digest over the digests of a tree's entries in the order of their names."""
    own = F.sha2(F.concat_ws(":", "p_partkey", "p_name"), 256)
    g = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.struct("p_partkey", own.alias("h")))).alias("e"))
    return g.select("p_brand", F.sha2(F.array_join("e.h", ""), 256).alias("tree"))
