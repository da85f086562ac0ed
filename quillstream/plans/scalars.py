"""Text functions over the driver's texts, each beside its SQL; patterns keep to what both engines read alike."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .bindings import CUES, UNITS, cues, table, units
from .registry import query

#: (column expression of the text, DuckDB SQL of it)
_FUNCTIONS = {
    "fn_token_fragments": (lambda c: F.size(F.regexp_extract_all(c, F.lit(r"[\x{3400}-\x{9FFF}]|[^\s\x{3400}-\x{9FFF}]+"), F.lit(0))).cast("long"), r"CAST(len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]|[^\s\x{3400}-\x{9FFF}]+')) AS BIGINT)"),
    "fn_english_dominant": (lambda c: F.regexp_count(c, F.lit("[A-Za-z]")) >= F.greatest(F.lit(1), F.regexp_count(c, F.lit(r"[\x{3400}-\x{9FFF}]"))), r"len(regexp_extract_all(text, '[A-Za-z]')) >= greatest(1, len(regexp_extract_all(text, '[\x{3400}-\x{9FFF}]')))"),
    "fn_format_text": (lambda c: F.md5(F.trim(F.regexp_replace(c, r"\s+", " ")).cast("binary")), r"md5(trim(regexp_replace(text, '\s+', ' ', 'g')))"),
    "fn_normalized_chars": (lambda c: F.md5(F.regexp_replace(F.lower(c), r"[^0-9a-z\x{3400}-\x{9FFF}]", "").cast("binary")), r"md5(regexp_replace(lower(text), '[^0-9a-z\x{3400}-\x{9FFF}]', '', 'g'))"),
    "fn_trailing_punct": (lambda c: F.regexp_extract(c, r"([.,;:!?]*)\s*$", 1), r"regexp_extract(text, '([.,;:!?]*)\s*$', 1)"),
    "fn_calibration_signature": (lambda c: F.concat_ws("|", F.md5(F.lower(c).cast("binary")), F.md5(F.regexp_replace(c, "[.,;:!?]", "").cast("binary"))), "md5(lower(text)) || '|' || md5(regexp_replace(text, '[.,;:!?]', '', 'g'))"),
    "fn_split_sentences": (lambda c: F.regexp_count(c, F.lit(r"[.!?]+(\s|$)")).cast("long"), r"CAST(len(regexp_extract_all(text, '[.!?]+(\s|$)')) AS BIGINT)"),
    "fn_clean_text": (lambda c: F.md5(F.substring(F.trim(F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")), 1, 500).cast("binary")), r"md5(substr(trim(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')), 1, 500))"),
    "fn_escape_ass": (lambda c: F.md5(F.regexp_replace(F.regexp_replace(c, r"([{}])", r"\\$1"), "\n", r"\\N").cast("binary")), r"md5(replace(regexp_replace(text, '([{}])', '\\\1', 'g'), chr(10), '\N'))"),
    "filter_hotword_valid": (lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.length(c) <= 15).otherwise(F.regexp_count(c, F.lit(r"[^\s]+")) <= 7), r"CASE WHEN regexp_matches(text, '[^\x00-\x7F]') THEN length(text) <= 15 ELSE len(regexp_extract_all(text, '[^\s]+')) <= 7 END"),
    "filter_unsupported_symbol": (lambda c: c.rlike(r"[\x{2190}-\x{21FF}\x{2600}-\x{27BF}]"), r"regexp_matches(text, '[\x{2190}-\x{21FF}\x{2600}-\x{27BF}]')"),
}
for _name, (_f, _sql) in _FUNCTIONS.items():

    def _run(spark, sf_dir, f=_f):
        return table(spark, sf_dir, "documents").select("doc_id", f(F.col("text")).alias("result"))

    query(f"SELECT doc_id, {_sql} AS result FROM documents", _name)(_run)


@query("SELECT event_id, CAST(least(greatest(event_id % 40 - 3, 1), 30) AS BIGINT) AS low, CAST(least(greatest(event_id % 17, 1), 30) AS BIGINT) AS high FROM events WHERE event_id % 40 - 3 <= event_id % 17 UNION ALL SELECT event_id, CAST(least(greatest(event_id % 17, 1), 30) AS BIGINT), CAST(least(greatest(event_id % 40 - 3, 1), 30) AS BIGINT) FROM events WHERE event_id % 40 - 3 > event_id % 17")
def fn_cue_range_expr(spark, sf_dir):
    """Ranges 'a:b' clamped to [1, 30], reversed ends swapped."""
    e = table(spark, sf_dir, "events").select("event_id", F.concat_ws(":", F.col("event_id") % 40 - 3, F.col("event_id") % 17).alias("expr"))
    ends = [F.least(F.greatest(F.split("expr", ":")[k].cast("long"), F.lit(1)), F.lit(30)) for k in (0, 1)]
    return e.select("event_id", F.least(*ends).alias("low"), F.greatest(*ends).alias("high"))


@query("SELECT p_partkey, printf('&H%02X%02X%02X%02X', p_partkey % 256, (p_partkey * 7) % 256, (p_partkey * 5) % 256, (p_partkey * 3) % 256) AS color FROM part")
def fn_ass_color(spark, sf_dir):
    """RRGGBB and an alpha as &HAABBGGRR."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select("p_partkey", F.format_string("%02X%02X%02X", (k * 3) % 256, (k * 5) % 256, (k * 7) % 256).alias("rgb"), F.format_string("%02X", k % 256).alias("alpha"))
    part = lambda at: F.substring("rgb", at, 2)
    return p.select("p_partkey", F.concat(F.lit("&H"), "alpha", part(5), part(3), part(1)).alias("color"))


@query(rf"WITH {CUES}, w AS (SELECT doc_id, idx, speaker, start_ms, end_ms, regexp_extract_all(text, '[^\s]+') AS w, n_words FROM cues WHERE n_words > 0) SELECT doc_id, idx, speaker, CAST(p AS BIGINT) - 1 AS part, start_ms + (end_ms - start_ms) * (p - 1) // n_words AS part_start, CASE WHEN p = n_words THEN end_ms ELSE start_ms + (end_ms - start_ms) * p // n_words END AS part_end FROM (SELECT *, unnest(range(1, len(w) + 1)) AS p FROM w)")
def win_split_tokens_time(spark, sf_dir):
    """A cue's time dealt to its words in equal parts; the last takes what is left. No window is needed, as the count is in the row."""
    c = cues(spark, sf_dir).where("n_words > 0").select("doc_id", "idx", "speaker", "start_ms", "end_ms", "n_words", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_words"))).alias("p"))
    at = lambda k: F.expr(f"start_ms + (end_ms - start_ms) * ({k}) div n_words")
    return c.select("doc_id", "idx", "speaker", (F.col("p") - 1).alias("part"), at("p - 1").alias("part_start"), F.when(F.col("p") == F.col("n_words"), F.col("end_ms")).otherwise(at("p")).alias("part_end"))


@query(f"WITH {UNITS} SELECT event_id, CAST(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS offset_chars FROM units")
def win_running_char_offset(spark, sf_dir):
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return units(spark, sf_dir).select("event_id", F.sum(F.length("text")).over(w).alias("offset_chars"))


@query(f"WITH {UNITS} SELECT doc_id, max(conf) AS best_conf, arg_max(event_id, struct_pack(a := conf, b := -idx)) AS event_id FROM units GROUP BY 1")
def top1_score(spark, sf_dir):
    """The best unit of each document, the earliest of equals."""
    m = units(spark, sf_dir).groupBy("doc_id").agg(F.max(F.struct("conf", (-F.col("idx")).alias("b"), "event_id")).alias("m"))
    return m.select("doc_id", F.col("m.conf").alias("best_conf"), "m.event_id")
