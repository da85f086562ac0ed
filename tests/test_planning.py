"""Bounded paths against brute force over all cuts."""

from __future__ import annotations

import itertools
import random
import re

import pytest

from quillstream.functions import rules
from quillstream.operators import planning

UNIT = "doc_id long, n long, start_ms long, end_ms long, speaker string, conf long, quiet boolean, cut boolean"


def bonus(a, b) -> int:
    return (150_000 if a[4] != b[4] and a[4] and b[4] and min(a[5], b[5]) >= 75 else 0) + min(max(0, b[2] - a[3]), 2000) * 70 + (65_000 if a[6] else 0)


def by_force(units: list[tuple], target: int, least: int, most: int) -> list[int] | None:
    cuts = [k for k, u in enumerate(units[:-1]) if u[7]]
    best = None
    for path in itertools.chain.from_iterable(itertools.combinations(cuts, k) for k in range(len(cuts) + 1)):
        cost, first = 0, 0
        for k in [*path, len(units) - 1]:
            took = units[k][3] - units[first][2]
            if not least <= took <= most:
                break
            cost += 1000 * abs(took - target) + (abs(took - target) - bonus(units[k], units[k + 1]) if k < len(units) - 1 else 0)
            first = k + 1
        else:
            best = min(best or (cost, list(path)), (cost, list(path)))
    return best and [units[k][1] for k in best[1]]


def picked(units: list[tuple], target: int, least: int, most: int) -> list[int]:
    at, prev, path, finish = units[0][2], -1, [], units[-1][3]
    fewest, many = max(1, -(-(finish - at) // most)), max(1, (finish - at) // least)
    blocks = min(many, max(fewest, round((finish - at) / target))) if fewest <= many else None
    while finish - at > most:
        goal = at + (finish - at) / blocks if blocks and blocks > 1 else at + target
        free = [k for k in range(prev + 1, len(units) - 1) if units[k][7]]
        fits = [k for k in free if least <= units[k][3] - at <= most]
        rest = lambda k: finish - units[k + 1][2]  # noqa: E731, B023
        room = [k for k in fits if (least * (blocks - 1) <= rest(k) <= most * (blocks - 1) if blocks and blocks > 1 else rest(k) >= least)]
        found = room or fits or free
        if not found:
            break
        prev = max(found, key=lambda k: (bonus(units[k], units[k + 1]) - abs(units[k][3] - goal), -abs(units[k][3] - goal), -k))  # noqa: B023
        path.append(units[prev][1])
        at, blocks = units[prev + 1][2], blocks and max(1, blocks - 1)
    return path


def test_blocks_by_force(spark):
    rng = random.Random(7)
    docs, kinds = [], {True: 0, False: 0}
    for doc in range(150):
        at, units = rng.randrange(1000), []
        for n in range(rng.randint(1, 11)):
            end = at + rng.choice([300, 700, 1000, 2500])
            units.append((doc, n * 2, at, end, rng.choice(["a", "b", None]), rng.choice([50, 90]), rng.random() < 0.2, rng.random() < 0.8))
            at = end + rng.choice([0, 0, 100, 400, 3000, -200])
        docs.append(units)
    want = set()
    for units in docs:
        path = by_force(units, 3000, 2200, 4000)
        bounded = path is not None
        kinds[bounded] += 1
        path = path if bounded else picked(units, 3000, 2200, 4000)
        place = {u[1]: k for k, u in enumerate(units)}
        first = 0
        for block, last in enumerate([*(place[p] for p in path), len(units) - 1], 1):
            took = units[last][3] - units[first][2]
            first_n = units[0][1] if first == 0 else units[first - 1][1] + 1
            want.add((units[0][0], bounded, block, first_n, units[last][1], units[first][2], units[last][3], units[-1][3] - units[0][2] > 4000 and not 2200 <= took <= 4000))
            first = last + 1
    rows = [u for units in docs for u in units]
    rng.shuffle(rows)
    got = planning.execution_blocks(spark.createDataFrame(rows, UNIT), ["doc_id"], 3000, 2200, 4000)
    assert min(kinds.values()) > 20 and {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def seconds(count: int, **more) -> list[tuple]:
    """One word a second, of 0.8 seconds."""
    return [(0, k, k * 1000, k * 1000 + 800, "s", 100, k in more.get("quiet", ()), k in more.get("allowed", range(count))) for k in range(count)]


def test_blocks_of_a_long_document(spark):
    got = planning.execution_blocks(spark.createDataFrame(seconds(487), UNIT), ["doc_id"]).collect()
    assert all(r.bounded and not r.exception and 75_000 <= r.end_ms - r.start_ms <= 100_000 for r in got) and got[0].first_n == 0 and max(r.last_n for r in got) == 486
    allowed = {79, 159, 239, 319, 409}
    got = planning.execution_blocks(spark.createDataFrame(seconds(487, allowed=allowed), UNIT), ["doc_id"]).collect()
    assert {r.last_n for r in got} - {486} <= allowed and not any(r.exception for r in got)
    got = planning.execution_blocks(spark.createDataFrame(seconds(240, quiet={176}), UNIT), ["doc_id"], 180_000, 150_000, 210_000).collect()
    assert sorted(r.last_n for r in got) == [176, 239]
    assert planning.execution_blocks(spark.createDataFrame([], UNIT), ["doc_id"]).collect() == []


WORD = "doc_id long, n long, grp long, text string, marks string, start_ms long, end_ms long, breaks boolean"


def breaks_by_force(units: list[dict], following: list[dict], most: int | None, english: int, other: int) -> tuple | None:
    """Every set of legal cuts, priced by its definition; of equal ones the fewest cues, then the earliest last cuts."""
    words = lambda t: re.findall(rules.ENGLISH_WORD, t)
    bare = lambda u: words(u["text"])[0].lower().replace("’", "'") if u and len(words(u["text"])) == 1 else ""

    def cut(k: int) -> tuple[bool, int]:
        u, v = units[k], units[k + 1]
        at = lambda i: following[units[0]["at"] + i] if 0 <= units[0]["at"] + i < len(following) else None
        gap, ended = max(0, v["start_ms"] - u["end_ms"]), bool(re.search(rules.TERMINAL, u["marks"]))
        near = [bare(at(k + i)) for i in (-1, 0, 1, 2)]
        phrases = [near[1:3], near[0:3], near[1:4]]
        legal = not re.search("[-‐‑‒]$", u["text"]) and (u["start_ms"], u["end_ms"]) != (v["start_ms"], v["end_ms"])
        legal &= ended or gap >= 400 or not (near[2] in rules.PARTICLES or any(" ".join(p) in rules.EXPRESSIONS for p in phrases))
        legal &= not (v["text"].lower() in rules.COUNTRIES and u["text"][:1].isupper() and "," in u["marks"])
        legal &= ended or near[1] not in rules.DEPENDENT
        cost = -25 * u["breaks"] + (-90 if ended else -40 if re.search(rules.CLAUSE, u["marks"]) else 0) + (-80 if gap >= 400 else -40 if gap >= 200 else -15 if gap >= 80 else 0)
        return legal, cost

    def cue(a: int, z: int) -> int | None:
        text = " ".join(u["text"] + u["marks"] for u in units[a : z + 1])
        found = words(" ".join(u["text"] for u in units[a : z + 1]))
        latin, han = len(re.findall("[A-Za-z]", text)), len(re.findall("[㐀-鿿]", text))
        took = max(0, units[z]["end_ms"] - units[a]["start_ms"])
        if not text or len(text) > (english if latin >= max(1, han) else other):
            return None
        if latin < max(1, han):
            cost = 400 if took < 700 and han > 2 else 0
        else:
            cost = (16 - len(text)) * 12 if len(text) < 16 and len(found) > 1 else 0
            cost += 180 if len(found) == 1 and not text.endswith(("?", "!", "？", "！")) else 0
            cost += 400 if took < 700 and len(found) > 1 else 140 if took < 800 and len(found) > 1 else 0
        if z < len(units) - 1:
            cost += 180 if found and found[-1].lower().replace("’", "'") in rules.DANGLING else 0
        return cost + 15

    best = None
    free = [k for k in range(len(units) - 1) if cut(k)[0]]
    for path in itertools.chain.from_iterable(itertools.combinations(free, k) for k in range(len(free) + 1)):
        if most is not None and len(path) >= most:
            continue
        costs = [cue(a + 1, z) for a, z in itertools.pairwise([-1, *path, len(units) - 1])]
        if None not in costs:
            got = (sum(costs) + sum(cut(k)[1] for k in path), len(path) + 1, path[::-1])
            best = min(best or got, got)
    return best and (best[1], best[0], [units[k]["n"] for k in best[2][::-1]])


@pytest.mark.parametrize(("most", "english", "other"), [(None, 24, 6), (3, 30, 8)])
def test_line_breaks_by_force(spark, most, english, other):
    rng = random.Random(english)
    vocab = ["one", "of", "the", "such", "as", "set", "up", "Paris", "france", "well-", "don't", "a", "lot", "字", "幕字幕", "7.5", "because", "unless", "Go", "extraordinarily"]
    rows, want = [], set()
    for doc in range(70):
        at, own = 0, []
        for n in range(rng.randint(1, 16)):
            took = rng.choice([0, 150, 300, 600])
            own.append({"doc_id": doc, "n": n, "grp": n // 9, "text": rng.choice(vocab), "marks": rng.choice(["", "", "", "", ",", ".", "?", ";"]), "start_ms": at, "end_ms": at + took, "breaks": rng.random() < 0.2})
            at += took + rng.choice([0, 0, 100, 250, 500])
        for grp, units in itertools.groupby(own, key=lambda u: u["grp"]):
            units = list(units)
            units[0] = {**units[0], "at": units[0]["n"]}
            got = breaks_by_force(units, own, most, english, other)
            want.add((doc, grp, *(got[:2] if got else (None, None)), tuple(got[2]) if got else None))
        rows += [tuple(u[c.split()[0]] for c in WORD.split(", ")) for u in own]
    rng.shuffle(rows)
    got = planning.line_breaks(spark.createDataFrame(rows, WORD), ["doc_id"], ["grp"], english, other, most_cues=most).collect()
    found = {(r.doc_id, r.grp, r.cues, r.cost, None if r.breaks is None else tuple(r.breaks)) for r in got}
    assert found == want and len(got) == len(want) and any(r.breaks is None for r in got) and sum(bool(r.breaks) for r in got) > 40


def test_line_breaks_of_many_groups_at_a_time(spark, monkeypatch):
    """How many groups are worked out together changes nothing; groups of very different sizes and such without a way stand side by side."""
    rng = random.Random(4)
    rows = []
    for doc in range(60):
        at = 0
        for n in range(rng.choice([1, 2, 7, 30, 200])):
            word = rng.choice(["a", "of", "wonder", "set", "up", "字", "unless", "x" * 60 if doc % 7 == 0 else "go"])
            rows.append((doc, n, 0, word, rng.choice(["", "", ",", "."]), at, at + 200, rng.random() < 0.1))
            at += rng.choice([200, 300, 700])
    units = spark.createDataFrame(rows, WORD).repartition(1)
    runs = []
    for together, most in ((1, 6), (7, 6), (10_000, 6), (3, None), (10_000, None)):
        monkeypatch.setattr(planning, "GROUPS", together)
        runs.append(sorted(map(str, planning.line_breaks(units, ["doc_id"], ["grp"], most_cues=most).collect())))
    assert len(runs[0]) == 60 and runs[0] == runs[1] == runs[2] and runs[3] == runs[4] and runs[0] != runs[3]
