"""Written text as tokens, without its punctuation, and as numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The scripts whose characters are tokens of their own, Hangul, and marks that may stand inside a word.
_SINGLE = r"\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{20000}-\x{323AF}\x{3040}-\x{30FF}\x{31F0}-\x{31FF}\x{1B000}-\x{1B16F}"
_HANGUL = r"\x{1100}-\x{11FF}\x{3130}-\x{318F}\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}"
_INNER = r"'’\-‐‑‒–—"
_LETTER = rf"[\p{{L}}\p{{N}}&&[^{_SINGLE}{_HANGUL}]]"
_URL_END = r".,!?;:，。！？；："

#: Tokens that are taken whole, in this order: addresses of pages and of mail, versions, grouped numbers, times, abbreviations.
PROTECTED = [
    r"(?i:https?://)(?=[^\s<>\[\]{}\"“”])" + rf"(?:[^\s<>\[\]{{}}\"“”]*[^\s<>\[\]{{}}\"“”{_URL_END}])?",
    rf"(?i:www)\.[^\s<>\[\]{{}}\"“”]*[^\s<>\[\]{{}}\"“”{_URL_END}]",
    r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    r"[vV]?\p{Nd}+(?:\.\p{Nd}+)+[%‰]?",
    r"\p{Nd}{1,3}(?:,\p{Nd}{3})+(?:\.\p{Nd}+)?[%‰]?",
    r"\p{Nd}{1,2}:\p{Nd}{2}(?::\p{Nd}{2})?",
    r"(?:[A-Za-z]\.){2,}",
]
#: A token: a protected one, else a single character of its script with its marks, a run of Hangul, or a word.
TOKEN = "|".join([*PROTECTED, rf"[{_SINGLE}]\p{{M}}*", rf"[{_HANGUL}][{_HANGUL}\p{{M}}]*", rf"{_LETTER}(?:\p{{M}}|{_LETTER}|[{_INNER}](?={_LETTER}))*"])


def spans(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key, place, first, last, token): the tokens of each text with the code points [first, last) that they take.

    What lies between two tokens is what splitting at tokens leaves, so places are running sums of lengths.
    """
    both = F.arrays_zip(F.slice(F.split(text, TOKEN, -1), 1, F.size(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))).alias("gap"), F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)).alias("token"))
    each = texts.select(*key, F.posexplode(both).alias("place", "_x")).select(*key, F.col("place").cast("long").alias("place"), F.length("_x.gap").alias("_gap"), F.col("_x.token").alias("token"))
    upto = Window.partitionBy(*key).orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    last = F.sum(F.col("_gap") + F.length("token")).over(upto).cast("long")
    return each.select(*key, "place", (last - F.length("token")).alias("first"), last.alias("last"), "token")


_ALNUM, _MARKS_END = r"[\p{L}\p{N}]", r".,!?;:"
#: Kept whole when punctuation goes, and marks that stay where letters or digits stand beside them.
_WHOLE = r"https?://(?=[^\s<>\"“”，。！？；：])" + rf"(?:[^\s<>\"“”，。！？；：]*[^\s<>\"“”，。！？；：{_MARKS_END}])?|www\.[^\s<>\"“”，。！？；：]*[^\s<>\"“”，。！？；：{_MARKS_END}]" + r"|[\p{L}\p{N}_.+\-]+@[\p{L}\p{N}_.\-]+\.[A-Za-z]{2,}|(?:[A-Za-z]\.){2,}"
_STAYS = [
    rf"(?<={_ALNUM})['’ʼ\-‐‑_/&](?={_ALNUM})", rf"(?<={_ALNUM})[*#@]", rf"[*#@](?={_ALNUM})", r"(?<=\p{Nd})[.,，:/\-–](?=\p{Nd})", r"(?<=\p{Nd})[\-+%]", r"[\-+%](?=\p{Nd})", r"(?<=\p{Nd})％",
]


def without_punctuation(text: Column) -> Column:
    """A text without punctuation, but for addresses, abbreviations, marks inside words and those of numbers."""
    kept = F.regexp_replace(text, f"({_WHOLE}|{'|'.join(_STAYS)})|\\p{{P}}", "$1")
    return F.regexp_replace(kept, r"^(?U:\s)+|(?U:\s)+$", "")


# Digits and scales as they are written.
_DIGITS = {c: n for n, c in enumerate("零一二三四五六七八九")} | {"〇": 0, "两": 2, "兩": 2}
_SCALES = {"十": 10, "百": 100, "千": 1000, "万": 10_000, "萬": 10_000, "亿": 100_000_000, "億": 100_000_000}
_WIDE, _NARROW = "０１２３４５６７８９．，＋－", "0123456789.,+-"


def _lookup(values: dict[str, int]) -> Column:
    return F.create_map(*[F.lit(x).cast("long") if isinstance(x, int) else F.lit(x) for item in values.items() for x in item])


def written_number(text: Column) -> Column:
    """The value of a number in Arabic digits, with grouping commas, or in Chinese numerals; null for anything else.

    Numerals are folded from the left: a digit waits for its scale; tens to thousands add to the section, ten thousand
    closes it, and a hundred million multiplies all before it. Digits alone are read one by one. A value that a decimal
    of 20 digits before the point and 18 behind it can't hold is null.
    """
    plain = F.regexp_replace(F.translate(text, _WIDE, _NARROW), ",", "")
    numerals, values = "".join(_DIGITS), "".join(str(n) for n in _DIGITS.values())
    whole = lambda t: F.when(~t.rlike(r"\.[0-9]{19}"), t.try_cast("decimal(38,18)"))
    state = lambda total, section, number: F.struct(total.alias("total"), section.alias("section"), number.alias("number"))
    zero, myriad = F.lit(0).cast("long"), F.lit(10_000).cast("long")

    def step(s: Column, c: Column) -> Column:
        digit, scale = F.try_element_at(_lookup(_DIGITS), c), F.try_element_at(_lookup(_SCALES), c)
        part = F.try_add(s["section"], F.try_multiply(F.when(s["number"] == 0, F.lit(1)).otherwise(s["number"]).cast("long"), scale))
        closed = F.try_add(s["section"], s["number"])
        return (
            F.when(digit.isNotNull(), state(s["total"], s["section"], digit)).when(scale < myriad, state(s["total"], part, zero))
            .when(scale == myriad, state(F.try_add(s["total"], F.try_multiply(closed, myriad)), zero, zero))
            .otherwise(state(F.try_multiply(F.try_add(s["total"], closed), scale), zero, zero))
        )

    folded = F.aggregate(F.split(plain, ""), state(zero, zero, zero), step, lambda s: F.try_add(F.try_add(s["total"], s["section"]), s["number"]))
    return (
        F.when(plain.rlike(r"^[+-]?[0-9]+(\.[0-9]+)?$"), whole(plain)).when(plain.rlike(f"^[{numerals}]+$"), whole(F.translate(plain, numerals, values)))
        .when(plain.rlike(f"^[{numerals}{''.join(_SCALES)}]+$"), folded.cast("decimal(38,18)"))
    )


def numerals(number: Column) -> Column:
    """A whole number from 0 to 9,999,999,999,999,999 in Chinese numerals: sections of four digits, each zero between digits said once."""
    chars = list(_DIGITS)[:10]

    def section(n: Column) -> Column:
        """Four digits with their scales; a run of zeros before another digit is one zero."""
        said = F.concat(*[F.when(F.floor(n / 10**k) % 10 > 0, F.concat(F.element_at(F.array(*map(F.lit, chars)), (F.floor(n / 10**k) % 10 + 1).cast("int")), F.lit(u))).otherwise(chars[0]) for k, u in ((3, "千"), (2, "百"), (1, "十"), (0, ""))])
        return F.regexp_replace(F.regexp_replace(said, f"{chars[0]}+", chars[0]), f"{chars[0]}$", "")

    parts = [(F.floor(number / 10**k) % 10_000, u) for k, u in ((12, "万"), (8, "亿"), (4, "万"), (0, ""))]
    high = F.concat(*[F.when(n > 0, F.concat(section(n), F.lit(u))).otherwise(F.lit(chars[0])) for n, u in parts[:2]])
    high = F.when(parts[0][0] + parts[1][0] == 0, "").when(parts[1][0] == 0, F.concat(section(parts[0][0]), F.lit("万亿"))).otherwise(high)
    low = F.concat(*[F.when(n > 0, F.concat(section(n), F.lit(u))).otherwise(F.lit(chars[0])) for n, u in parts[2:]])
    said = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.concat(high, low), f"{chars[0]}+", chars[0]), f"^{chars[0]}|{chars[0]}$", ""), f"^{chars[1]}十", "十")
    return F.when(number == 0, chars[0]).otherwise(said)
