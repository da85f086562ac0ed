"""Glossary matches, seams, located parts and alignment by sound against brute force."""

from __future__ import annotations

import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from quillstream.operators import glossary, transcripts
from quillstream.plans import QUERIES

SF = "/root/testdata/sf0.001"

TOKEN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:['’][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*|[㐀-鿿぀-ヿ가-힯]")


def tokens(text: str) -> list[str]:
    return [t.replace("’", "'").lower() for t in TOKEN.findall(text)]


def test_aliases_are_of_the_first_entry(spark):
    rows = [(1, "c a t l", "CATL", [], True), (2, "CATL", "Other", ["u.s."], True), (3, "US", "United States", None, False), (4, "x", "X", ["x1", None], True), (5, None, None, ["zz"], True), (6, "only", "", [], None)]
    got = glossary.alias_map(spark.createDataFrame(rows, "place int, source string, standard string, aliases array<string>, enabled boolean"))
    assert {tuple(r) for r in got.collect()} == {("catl", "CATL"), ("other", "Other"), ("us", "Other"), ("x1", "X"), ("only", "only")}


def matches_by_force(units: list[str], aliases: dict[str, str]) -> list[tuple]:
    out, at = [], 0
    single = lambda k: re.fullmatch("[A-Za-z]", units[k].strip()) is not None
    while at < len(units):
        if not single(at):
            at += 1
            continue
        end = at
        while end + 1 < len(units) and single(end + 1):
            end += 1
        hit = next((z for z in range(end, at, -1) if "".join(u.strip() for u in units[at : z + 1]).lower() in aliases), None)
        if hit is None:
            at = end + 1
            continue
        said = [u.strip() for u in units[at : hit + 1]]
        out.append((at, hit, aliases["".join(said).lower()], " ".join(said)))
        at = hit + 1
    return out


def test_glossary_by_force(spark):
    rng = random.Random(1)
    aliases = {"".join(rng.choice("abc") for _ in range(rng.randint(2, 5))): f"T{k}" for k in range(60)}
    docs = {d: [rng.choice([*"aabbccAB", " b ", "word", "ab", "é", "1"]) for _ in range(rng.randint(0, 40))] for d in range(60)}
    rows = [(d, n * 3, u) for d, own in docs.items() for n, u in enumerate(own)]
    got = glossary.longest_matches(spark.createDataFrame(rows, "d int, n int, text string"), spark.createDataFrame(list(aliases.items()), "alias string, canonical string"), ["d"])
    want = {(d, a * 3, z * 3, c, s) for d, own in docs.items() for a, z, c, s in matches_by_force(own, aliases)}
    assert len(want) > 100 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert glossary.longest_matches(spark.createDataFrame(rows, "d int, n int, text string"), spark.createDataFrame([], "alias string, canonical string"), ["d"]).count() == 0


def seam_by_force(left: str, right: str, reach: int) -> tuple:
    """Every run of equal tokens that can't be made longer, scored by its definition."""
    l, r = tokens(left), tokens(right)  # noqa: E741
    if not l or not r:
        return ("right_only" if not l else "left_only", 10_000, 0, None, None, None, None)
    first = max(0, len(l) - reach)
    tail, head = l[first:], r[:reach]
    best = None
    for i, j in itertools.product(range(len(tail)), range(len(head))):
        if tail[i] != head[j] or (i and j and tail[i - 1] == head[j - 1]):
            continue
        size = next(k for k in range(1, len(tail) + 1) if i + k >= len(tail) or j + k >= len(head) or tail[i + k] != head[j + k])
        away = len(tail) - i - size + j
        got = (size * (len(tail) + len(head)) - 3 * away, -i, -j, size, away)
        best = max(best or got, got)
    if not best:
        return ("no_anchor", 0, 0, None, None, None, None)
    _, i, j, size, away = best
    n = len(tail) + len(head)
    confidence = int(min(1.0, size / 8 * 0.65 + max(0, n - away) / n * 0.35) * 10_000 + 0.5)
    return ("merged" if size >= 3 and confidence >= 4500 else "weak_anchor", confidence, size, first - i, -j, len(tail) + i - size, -j)


def text_by_force(left: str, right: str, reach: int) -> str:
    status, _, size, at, j, *_ = seam_by_force(left, right, reach)
    l, r = left.strip(" "), right.strip(" ")  # noqa: E741
    if status in ("left_only", "right_only"):
        return l if status == "left_only" else r
    if status in ("merged", "weak_anchor"):
        spans_l, spans_r = [m.span() for m in TOKEN.finditer(left)], [m.span() for m in TOKEN.finditer(right)]
        middle = max(0, (size - 1) // 2)
        l = left[: spans_l[at + middle][1]].strip(" ")  # noqa: E741
        after = j + middle + 1
        r = right[spans_r[after][0] if after < len(spans_r) else len(right) :].strip(" ")
    if not l or not r:
        return l or r
    tight = r[0] in "，。！？、；：,.!?;:%)]}”’》〉」』" or l[-1] in "([{“‘《〈「『" or ("㐀" <= l[-1] <= "鿿" and "㐀" <= r[0] <= "鿿")
    return l + r if tight else f"{l} {r}"


@pytest.mark.parametrize("reach", [500, 7])
def test_seams_by_force(spark, reach):
    rng = random.Random(reach)
    vocab = ["one", "Two", "it’s", "it's", "été", "字", "幕", "7", "...", "(", "—", "four"]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    rows = [(0, "", "a b"), (1, "a b", " ,"), (2, "a b c", "d e f"), (3, "字字", "。 幕"), (4, "x", "x"), (5, "we went home then", "home then we ate")]
    for k in range(6, 120):
        left, more = say(rng.randint(0, 14)), say(rng.randint(0, 10))
        rows.append((k, left, rng.choice([left[-rng.randint(1, 40) :], say(3)]) + " " + more))
    pairs = spark.createDataFrame(rows, "k int, left string, right string")
    got = {r[0]: tuple(r)[1:] for r in transcripts.seams(pairs, ["k"], reach).collect()}
    assert got == {k: seam_by_force(a, b, reach) for k, a, b in rows}
    assert len({v[0] for v in got.values()}) == 5
    assert {r.k: r.text for r in transcripts.merged(pairs, ["k"], reach).collect()} == {k: text_by_force(a, b, reach) for k, a, b in rows}


def chain_by_force(own: list[str], master: list[str], low: int, high: int) -> tuple[int, int, int] | None:
    """Length, start and end of the longest increasing chain of equal tokens with the smallest end; its start is that of the chain which the smallest ends make."""
    tails: list[tuple[int, int]] = []
    for t in own:
        for j in reversed([j for j in range(low, high) if master[j] == t]):
            k = sum(x < j for x, _ in tails)
            tails[k : k + 1] = [(j, j if k == 0 else tails[k - 1][1])]
    return (len(tails), tails[-1][1], tails[-1][0] + 1) if tails else None


def common_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *itertools.accumulate(range(1, len(b) + 1), lambda left, j, row=row, x=x: row[j - 1] + 1 if x == b[j - 1] else max(row[j], left), initial=0)][1:]
    return row[-1]


def test_located_by_force(spark):
    rng = random.Random(4)
    vocab = [f"w{k}" for k in range(60)]
    masters, parts, want = [], [], {}
    for doc in range(12):
        master = [rng.choice(vocab) for _ in range(rng.choice([0, 3, 90, 700, 1500]))]
        total, count = len(master) * 400, rng.randint(1, 6)
        masters.append((doc, " ".join(master), total))
        size = max(1, len(master) // count)
        for part in range(count):
            a, z = part * size, min(len(master), (part + 1) * size)
            own = rng.choice([master[a:z][5:60], master[a : a + 9], ["none", "of", "these"], [], [t for t in master[a:z][:50] if rng.random() < 0.7], rng.sample(vocab, 8)])
            parts.append((doc, part, " ".join(own), a * 400, z * 400))
            n = len(master)
            margin = max(80, round(n * 0.08))
            first, last = round(n * (a * 400) / max(total, 1)), round(n * (z * 400) / max(total, 1))
            low, high = max(0, first - margin), min(n, last + margin)
            got = chain_by_force(own, master, low, high)
            if got:
                assert got[0] == common_length(own, master[low:high])
            status = "proportional_fallback" if not got else "matched" if got[0] >= 3 and got[0] * 100 >= len(own) * 45 else "weak"
            s = min(n, got[1] if got else first)
            want[doc, part] = (s, max(s, min(n, got[2] if got else last)), got[0] if got else 0, len(own), int((got[0] if got else 0) * 10_000 / len(own) + 0.5) if own else 0, status, n, min(n, last))
    found = transcripts.located(spark.createDataFrame(masters, "d int, text string, total_ms long"), spark.createDataFrame(parts, "d int, part int, text string, start_ms long, end_ms long"), ["d"])
    assert {(r[0], r[1]): tuple(r)[2:] for r in found.collect()} == want and len({w[5] for w in want.values()}) == 3
    cuts = {(r.d, r.part): r.cut for r in transcripts.bounds(found, ["d"]).collect()}
    expected = {}
    for doc in range(12):
        own = sorted(k for k in want if k[0] == doc)
        prev = 0
        for k, (here, after) in enumerate(itertools.pairwise(own), 1):
            x, y = want[here], want[after]
            wish = round((x[1] + y[0]) / 2) if x[5] == y[5] == "matched" else x[7]
            prev = expected[here] = max(prev + 1, min(x[6] - (len(own) - k), wish))
    assert cuts == expected


def align_by_force(a: list[tuple], b: list[tuple]) -> tuple[int, str]:
    cost = {}
    price = lambda x, y: 0 if x[0] == y[0] else 1 if x[1] and x[1] == y[1] else 4
    for i, j in itertools.product(range(len(a) + 1), range(len(b) + 1)):
        ways = ([cost[i - 1, j] + 4] if i else []) + ([cost[i, j - 1] + 4] if j else []) + ([cost[i - 1, j - 1] + price(a[i - 1], b[j - 1])] if i and j else [])
        cost[i, j] = min(ways, default=0)
    i, j, steps = len(a), len(b), ""
    while i or j:
        if i and j and cost[i, j] == cost[i - 1, j - 1] + price(a[i - 1], b[j - 1]):
            steps, i, j = ("e" if a[i - 1][0] == b[j - 1][0] else "r") + steps, i - 1, j - 1
        elif i and cost[i, j] == cost[i - 1, j] + 4:
            steps, i = "d" + steps, i - 1
        else:
            steps, j = "i" + steps, j - 1
    return cost[len(a), len(b)], steps


def test_aligned_by_force(spark):
    rng = random.Random(6)
    vocab = [("平", "ping"), ("凭", "ping"), ("主", "zhu"), ("诸", "zhu"), ("x", None), ("y", None), ("若", "ruo")]
    rows = [([rng.choice(vocab) for _ in range(rng.randint(0, 7))], [rng.choice(vocab) for _ in range(rng.randint(0, 7))]) for _ in range(200)]
    rows.append(([("平", "ping")] * 4, [("凭", "ping")] * 4))
    spans = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<struct<text:string,sound:string>>, b array<struct<text:string,sound:string>>")
    got = {r.k: (r.cost, r.steps) for r in transcripts.aligned(spans).collect()}
    assert got == {k: align_by_force(a, b) for k, (a, b) in enumerate(rows)} and got[200] == (4, "rrrr")


def test_sound_keys(spark):
    got = spark.createDataFrame([("Píng",), ("pīng",), ("nǚ",), ("don't",), ("平",), ("",)], "w string").select(transcripts.sound_key(F.col("w")).alias("s")).collect()
    assert [r.s for r in got] == ["ping", "ping", "nv", None, None, None]


def test_hits_by_force(spark):
    rng = random.Random(9)
    texts = {k: "".join(rng.choice("abAB é\n") for _ in range(rng.randint(0, 40))) for k in range(150)} | {900: None, 901: ""}
    terms = {("".join(rng.choice("abA é") for _ in range(rng.randint(0, 6))), rng.random() < 0.5) for _ in range(80)}
    got = glossary.hits(spark.createDataFrame(list(texts.items()), "k int, text string"), spark.createDataFrame(sorted(terms), "term string, exact boolean"), ["k"])
    want = {(k, t, e) for k, text in texts.items() for t, e in terms if text and t.strip() and (t in text if e else t.lower() in text.lower())}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want) > 200


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_located_moves_texts_once(spark):
    """Masters and parts cross the network as texts, not token by token with a master beside each part."""
    assert exchanges(QUERIES["aln_locate_spans"](spark, SF)) <= 4


def test_chain_by_force():
    rng = random.Random(3)
    for _ in range(300):
        own, window = ([rng.choice("abcd") for _ in range(rng.randrange(7))] for _ in range(2))
        first, last, got = transcripts.chain(own, window)
        ways = [js for r in range(len(own) + 1) for at in itertools.combinations(range(len(own)), r) for js in itertools.combinations(range(len(window)), r) if all(own[i] == window[j] for i, j in zip(at, js, strict=True))]
        longest = max(map(len, ways))
        assert got == longest and (not got or any(w[0] == first and w[-1] == last for w in ways if len(w) == longest) and last == min(w[-1] for w in ways if len(w) == longest))


@pytest.mark.parametrize("name", ["aln_merge_overlap", "aln_merged_text"])
def test_seams_stay_in_their_rows(spark, name):
    assert exchanges(QUERIES[name](spark, SF)) == 0


def test_seam_by_force():
    rng = random.Random(5)
    for _ in range(300):
        a, b = ([rng.choice("abc") for _ in range(rng.randrange(8))] for _ in range(2))
        runs = []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            if a[i] == b[j] and not (i and j and a[i - 1] == b[j - 1]):
                size = next(k for k in range(1, 9) if i + k >= len(a) or j + k >= len(b) or a[i + k] != b[j + k])
                away = len(a) - i - size + j
                runs.append((size * (len(a) + len(b)) - 3 * away, -i, -j, size, away))
        want = max(runs, default=None)
        assert transcripts.seam(a, b) == (want and (want[3], -want[1], -want[2], want[4]))
