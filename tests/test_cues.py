"""Splitting and merging of cues against the rules followed one cue at a time."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillstream.operators import cues


def split_by_rule(tokens: list[tuple], start: int, end: int, after: int) -> list[tuple] | None:
    left, right = [t for t in tokens if t[0] <= after], [t for t in tokens if t[0] > after]
    if not left or not right:
        return None
    z, a = max((t[3] for t in left if t[3] is not None), default=None), min((t[2] for t in right if t[2] is not None), default=None)
    within = lambda x, low: min(max(x, low), end - 1)
    if z is not None and a is not None and z <= a:
        e = within(z, start + 1)
        s = within(a, e)
    else:
        e = s = within((z + a) / 2 if z is not None and a is not None else (start + end) / 2, start + 1)
    return [(0, left[0][0], left[-1][0], float(start), float(e), " ".join(t[1] for t in left)), (1, right[0][0], right[-1][0], float(s), float(end), " ".join(t[1] for t in right))]


def test_split(spark):
    rng = random.Random(1)
    tokens, bounds, want = [], [], {}
    for c in range(200):
        at, own = rng.randrange(100), []
        start = at
        for n in range(rng.randint(1, 6)):
            z = at + rng.choice([0, 5, 100])
            own.append((n * 2, f"t{n}", None if rng.random() < 0.15 else at, None if rng.random() < 0.15 else z))
            at = max(0, z + rng.choice([-60, 0, 0, 50]))
        end, after = max(at, start + 2, *(t[3] or 0 for t in own)), rng.randrange(-1, 11)
        tokens += [(c, *t) for t in own]
        bounds.append((c, start, end, after))
        if got := split_by_rule(own, start, end, after):
            want[c] = got
    found: dict = {}
    for r in cues.split(spark.createDataFrame(tokens, "c int, n int, text string, start_ms long, end_ms long"), spark.createDataFrame(bounds, "c int, start_ms long, end_ms long, after_n int"), ["c"]).orderBy("c", "part").collect():
        assert (r.cue_id is not None) == (r.part == 1)
        found.setdefault(r.c, []).append((r.part, r.first_n, r.last_n, r.start_ms, r.end_ms, r.text))
    assert found == want and len(want) > 80


def merge_by_rule(rows: list[dict]) -> list[tuple]:
    out, i = [], 0
    while i < len(rows):
        x = rows[i]
        if not x["pick"] or i + 1 == len(rows):
            out.append((x["k"], x["start_ms"], x["end_ms"], x["speaker"], x["text"], x["target"], x["status"] if x["target"] is not None else None, [x["grp"]], False))
            i += 1
            continue
        y = rows[i + 1]
        tracks = [(t["target"], t["status"]) for t in (x, y) if t["target"] is not None]
        target = None if not tracks else tracks[0][0] if len({t for t, _ in tracks}) == 1 else f"{tracks[0][0]} {tracks[1][0]}"
        status = next((s for s in ("manual_required", "needs_review") if s in [u for _, u in tracks]), "translated") if tracks else None
        out.append((x["k"], x["start_ms"], y["end_ms"], x["speaker"] if x["speaker"] == y["speaker"] else None, f"{x['text']} {y['text']}", target, status, list(dict.fromkeys([x["grp"], y["grp"]])), True))
        i += 2
    return out


def test_merge(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for d in range(60):
        own = []
        for k in range(rng.randint(1, 8)):
            target = rng.choice([None, "one", "two", "one"])
            own.append({"d": d, "k": k * 3, "start_ms": k * 10, "end_ms": k * 10 + 9, "speaker": rng.choice("ab"), "text": f"t{k}", "target": target, "status": rng.choice(["translated", "needs_review", "manual_required"]) if target else None, "grp": rng.randrange(2), "pick": rng.random() < 0.6})
        rows += own
        want[d] = [(*r, i) for i, r in enumerate(merge_by_rule(own))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], "d int, k int, start_ms long, end_ms long, speaker string, text string, target string, status string, grp int, pick boolean")
    found: dict = {}
    for r in cues.merge(df, ["d"], "k", F.col("pick")).orderBy("d", "k").collect():
        found.setdefault(r.d, []).append((r.k, r.start_ms, r.end_ms, r.speaker, r.text, r.target, r.status, r.sources, r.merged, r.n))
    assert found == want
