"""Tokens, cleaned punctuation and written numbers against scanners that follow their definitions step by step."""

from __future__ import annotations

import random
import re
import unicodedata
from decimal import Decimal

from pyspark.sql import functions as F

from quillstream.functions import lexical

PROTECTED = [
    re.compile(r"(?:https?://|www\.)[^\s<>\[\]{}\"“”]+", re.IGNORECASE), re.compile(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"), re.compile(r"[vV]?\d+(?:\.\d+)+[%‰]?"),
    re.compile(r"\d{1,3}(?:,\d{3})+(?:\.\d+)?[%‰]?"), re.compile(r"\d{1,2}:\d{2}(?::\d{2})?"), re.compile(r"(?:[A-Za-z]\.){2,}"),
]
SINGLE = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x1B000, 0x1B16F)]
HANGUL = [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)]


def scanned(text: str) -> list[tuple[int, int, str]]:
    """Character by character: the first protected pattern that fits, else the longest token that its script allows."""
    within = lambda c, ranges: any(a <= ord(c) <= z for a, z in ranges)
    mark, plain = (lambda c: unicodedata.category(c)[0] == "M"), (lambda c: unicodedata.category(c)[0] in "LN" and not within(c, SINGLE + HANGUL))
    out, i = [], 0
    while i < len(text):
        z = i
        for k, pattern in enumerate(PROTECTED):
            found = pattern.match(text, i)
            if found:
                z = found.end()
                while k == 0 and text[z - 1] in ".,!?;:，。！？；：":
                    z -= 1
                break
        if z == i and within(text[i], SINGLE):
            z += 1
            while z < len(text) and mark(text[z]):
                z += 1
        elif z == i and within(text[i], HANGUL):
            z += 1
            while z < len(text) and (within(text[z], HANGUL) or mark(text[z])):
                z += 1
        elif z == i and plain(text[i]):
            z += 1
            while z < len(text) and (mark(text[z]) or plain(text[z]) or text[z] in "'’-‐‑‒–—" and z + 1 < len(text) and plain(text[z + 1])):
                z += 1
        if z > i:
            out.append((i, z, text[i:z]))
        i = max(z, i + 1)
    return out


CASES = [
    "See https://a.example/x?y=1, or www.b.example.", "mail me.now+x@site.co.uk!", "v1.2.3 and 3.5% of 1,234,567.80 at 12:30:05", "the U.S.A. isn't a semi-colon—well, rock'n'roll-", "中文が混ざる한국어 텍스트éáb",
    "www.,, https:// https://.,", "'quoted' -dash 5-6 1,23 99:5", "", "…", "x²½ Ⅻ ३५", "a.b.c. d.e", "http://[x]", "v2 V2.0‰ 1:23:45:67", "\U00020000︀x",
]


def mixed(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    parts = [*"abZé中ㄱ한がっ0129.,:'’-–@/%+ ‰́\"[_&*#％，。！－", "www.", "http://", "1,000", "a.b.", "x@y.zz", "12:30", "３"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(n)]


def test_tokens_by_scanning(spark):
    texts = CASES + mixed(1, 1500)
    got = lexical.spans(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), ["id"]).collect()
    found: dict = {}
    for r in sorted(got, key=lambda r: (r.id, r.place)):
        found.setdefault(r.id, []).append((r.first, r.last, r.token))
    for k, text in enumerate(texts):
        assert found.get(k, []) == scanned(text), text


WHOLE = re.compile(r"(?:https?://|www\.)[^\s<>\"“”，。！？；：]+|[\w.+-]+@[\w.-]+\.[A-Za-z]{2,}|(?:[A-Za-z]\.){2,}")


def cleaned(text: str) -> str:
    kept = set()
    for m in WHOLE.finditer(text):
        end = m.end()
        if not re.fullmatch(r"(?:[A-Za-z]\.){2,}", m.group()):
            while end > m.start() and text[end - 1] in ".,，。!?！？;；:：":
                end -= 1
        kept.update(range(m.start(), end))
    out = []
    for i, c in enumerate(text):
        a, z = text[i - 1 : i] if i else "", text[i + 1 : i + 2]
        stays = c in "'’ʼ-‐‑_/&" and a.isalnum() and z.isalnum() or c in "*#@" and (a.isalnum() or z.isalnum())
        stays = stays or c in ".,，:/-–" and a.isdigit() and z.isdigit() or c in "-+%" and (a.isdigit() or z.isdigit()) or c == "％" and a.isdigit()
        if i in kept or stays or unicodedata.category(c)[0] != "P":
            out.append(c)
    return "".join(out).strip()


def test_punctuation_by_scanning(spark):
    texts = [t for t in CASES if "²" not in t] + ["Don't stop - it's 50%, no?", "C# and F*ck & R&D; AT&T.", "“Hi,” (she) said: 3:45—4:50…", "10％的，人。", "www.x.com, ok!", "a_b _c_ d/e /f", " . "] + [t for t in mixed(2, 1500) if "́" not in t]
    got = spark.createDataFrame(list(enumerate(texts)), "id int, text string").select("id", lexical.without_punctuation(F.col("text")).alias("c")).collect()
    for r in got:
        assert r.c == cleaned(texts[r.id]), texts[r.id]


def test_written_numbers(spark):
    digits, units = "零一二三四五六七八九", [(10**8, "亿"), (10**4, "万"), (1000, "千"), (100, "百"), (10, "十")]

    def say(n: int, first: bool = True) -> str:
        if n < 10:
            return digits[n]
        size, unit = next(u for u in units if n >= u[0])
        head, rest = divmod(n, size)
        gap = digits[0] if rest and rest < size // 10 else ""
        return ("" if n < 20 and first else say(head, first)) + unit + (gap + say(rest, False) if rest else "")

    rng = random.Random(3)
    numbers = [*range(0, 1200), *(10**k for k in range(16)), *(rng.randrange(10 ** rng.randint(3, 15)) for _ in range(3000)), 10**9, 100_000_008, 2_0000_0000_0000, 305_0060_0708]
    literal = [("二十", 20), ("两千", 2000), ("兩萬億", 2 * 10**12), ("二〇二四", 2024), ("一千零八", 1008), ("十", 10), ("百", 100), ("零", 0), ("1,234.50", Decimal("1234.5")), ("-７", -7), ("＋3", 3), ("１２．５", Decimal("12.5")), ("", None), ("abc", None), ("二x", None),
               ("1.2.3", None), ("九" * 25, None), ("亿亿亿", 0), ("九千亿亿亿", None), (None, None), ("3.", None)]
    rows = [(say(n), Decimal(n)) for n in numbers] + [(t, None if v is None else Decimal(v)) for t, v in literal]
    got = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "id int, text string").select("id", lexical.written_number(F.col("text")).alias("n")).collect()
    wrong = [(rows[r.id], r.n) for r in got if r.n != rows[r.id][1]]
    assert not wrong, wrong[:5]
    back = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", lexical.numerals(F.col("n")).alias("t")).collect()
    assert not [(r.n, r.t, say(r.n)) for r in back if r.t != say(r.n) and r.n < 10**8][:5]
    again = spark.createDataFrame([(n,) for n in numbers], "n long").where((lexical.written_number(lexical.numerals(F.col("n"))) != F.col("n")) | lexical.written_number(lexical.numerals(F.col("n"))).isNull())
    assert not again.take(5)
