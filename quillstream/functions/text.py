"""Text, time and key functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HAN = r"[\x{3400}-\x{9FFF}]"


def formatted(c: Column) -> Column:
    """White space squeezed and trimmed; none between Han characters."""
    return F.regexp_replace(F.trim(F.regexp_replace(c, r"\s+", " ")), rf"(?<={HAN}) (?={HAN})", "")


def visible_length(c: Column) -> Column:
    return F.length(formatted(c)).cast("long")


def nonspace_length(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"\s+", "")).cast("long")


def compact_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def stamp_srt(ms: Column) -> Column:
    """Milliseconds as HH:MM:SS,mmm."""
    part = lambda unit, most: F.floor(ms / unit) % most
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), part(60000, 60), part(1000, 60), ms % 1000)


def stamp_ass(ms: Column) -> Column:
    """Milliseconds as H:MM:SS.cc, hundredths rounded half to even."""
    cs = F.bround(ms / 10).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60, F.floor(cs / 100) % 60, cs % 100)


def parse_stamp(c: Column) -> Column:
    """HH:MM:SS,mmm as milliseconds; null if it isn't one."""
    got = F.split(c, "[:,.]")
    n = lambda k: got[k].cast("long")
    return F.when(c.rlike(r"^\d+:\d{2}:\d{2}[,.]\d{3}$"), ((n(0) * 60 + n(1)) * 60 + n(2)) * 1000 + n(3))


def script(c: Column) -> Column:
    """Language by script: kana, Hangul, Han with or without Latin letters, else other."""
    han, latin = c.rlike(HAN), c.rlike("[A-Za-z]")
    return F.when(c.rlike(r"[\x{3040}-\x{30FF}]"), "ja").when(c.rlike(r"[\x{AC00}-\x{D7AF}]"), "ko").when(han & latin, "mixed").when(han, "zh").when(latin, "en").otherwise("other")


def retry_backoff(attempt: Column, most: int = 60) -> Column:
    """Seconds before a retry: doubling from 1, at most ``most``."""
    return F.least(F.lit(most), F.pow(F.lit(2), F.least(attempt - 1, F.lit(30))).cast("int"))


def safe_filename(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r'[\\/:*?"<>|\x00-\x1F]+', "_"), r"[ .]+$", "")


#: Scripts that a track's language is told from, as their letters' classes; letters of scripts that aren't named count as one more.
SCRIPTS = {"zh": "Han", "ja": "Hiragana|Katakana", "ko": "Hangul", "latin": "Latin", "greek": "Greek", "cyrillic": "Cyrillic", "arabic": "Arabic", "hebrew": "Hebrew", "thai": "Thai", "devanagari": "Devanagari"}


def cue_language(text: Column, hint: Column) -> Column:
    """The language of a displayed track by its letters' scripts: zh, ja, ko, en, mixed or other; a hint decides where there are none or Latin ones."""
    named = "".join(rf"\p{{Is{s}}}" for own in SCRIPTS.values() for s in own.split("|"))
    h = F.lower(F.regexp_replace(F.coalesce(hint, F.lit("")), "_", "-"))
    has = {k: text.rlike("[" + "".join(rf"\p{{Is{s}}}" for s in own.split("|")) + r"&&[\p{L}]]") for k, own in SCRIPTS.items()} | {"rest": text.rlike(rf"[\p{{L}}&&[^{named}]]")}
    others = [has[k] for k in has if k not in ("zh", "ja")]
    only_han = has["zh"] & ~has["ja"] & ~F.greatest(*others)
    ja = has["ja"] | h.startswith("ja") & only_han
    zh = has["zh"] & ~ja & ~has["ko"]
    found = {**has, "ja": ja, "zh": zh}
    n = sum((found[k].cast("int") for k in found), F.lit(0))
    silent = F.when(h.isin("zh", "zh-cn"), "zh").when(h.isin("en", "ja", "ko"), h).otherwise("other")
    latin = F.when(h.isin("", "auto", "automatic", "mixed", "en", "zh", "zh-cn", "ja", "ko"), "en").otherwise("other")
    return F.when(n > 1, "mixed").when(n == 0, silent).when(found["latin"], latin).when(zh, "zh").when(ja, "ja").when(found["ko"], "ko").otherwise("other")
