"""Canonical JSON, recognition evidence in files, and onsets of speech, against definitions written out in Python."""

from __future__ import annotations

import copy
import hashlib
import json
import math
import random

from pyspark.sql import functions as F

from quillstream.operators import snapping
from quillstream.sources import documents


def some(rng: random.Random, depth: int = 0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind >= 6:
        return {"".join(rng.choice("abAB1é中_") for _ in range(rng.randint(1, 4))): some(rng, depth + 1) for _ in range(rng.randint(0, 5))}
    if kind == 5:
        return [some(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return [rng.randrange(-(10**9), 10**9), rng.choice(["", "a\"b", "line\nend", "tab\t\\", "é中\U0001f600", "</x>"]), True, False, None][kind]


def test_canonical_json(spark, tmp_path):
    rng = random.Random(1)
    values = [{"k": k, "v": some(rng), "a": some(rng)} for k in range(300)]
    rows = spark.createDataFrame([(k, json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2]))) for k, v in enumerate(values)], "id int, text string")
    manifest = documents.write_lines(rows, f"file://{tmp_path}/out", documents.of_text(F.col("text")), "id")
    want = {k: json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":")) for k, v in enumerate(values)}
    assert {r.id: (r.sha256, r.bytes) for r in manifest.collect()} == {k: (hashlib.sha256(v.encode()).hexdigest(), len(v.encode())) for k, v in want.items()}
    assert sorted(r.json for r in documents.read_lines(spark, f"file://{tmp_path}/out").collect()) == sorted(want.values())
    nested = spark.sql("SELECT 1 AS z, named_struct('b', array(named_struct('y', 'q', 'x', 2)), 'a', cast(NULL AS int)) AS m, map('k2', 1, 'k1', 2) AS n")
    assert nested.select(documents.of_columns("z", "m", "n").alias("j")).first().j == '{"m":{"a":null,"b":[{"x":2,"y":"q"}]},"n":{"k1":2,"k2":1},"z":1}'


def sound() -> dict:
    d = "a" * 64
    return {
        "schema_version": documents.VERSIONS[0], "source_schema_version": documents.VERSIONS[1], "created_at": "2024-01-01", "media": {"sha256": d, "duration_seconds": 3.5},
        "engines": {"asr": "x", "profile_id": "p1", "n": 3, "none": None}, "language": "", "master_text": "one two", "chunks": [{"index": 0, "start": 0, "end": 1.5, "text": "one two"}],
        "units": [{"index": 0, "start": 0, "end": 0.5, "text": "one"}, {"index": 1, "start": 0.5, "end": 1.5, "text": " two "}],
        "request": {"input_fingerprint": d, "profile_id": "p1", "requested_language": "en", "prompt_sha256": d, "hotwords_sha256": d, "hotword_count": 0, "provider_submission": {"relative_path": "a.json", "sha256": d}, "provider_response": None},
    }


def broken(path: str, value) -> dict:
    doc = copy.deepcopy(sound())
    at = doc
    *steps, last = [int(p) if p.isdigit() else p for p in path.split("/")]
    for s in steps:
        at = at[s]
    if value is ...:
        del at[last]
    else:
        at[last] = value
    return doc


CASES = [
    ("language", ..., "keys"), ("more", 1, "keys"), ("schema_version", "v2", "schema_version"), ("source_schema_version", 1, "schema_version"), ("created_at", " ", "created_at"), ("created_at", 5, "created_at"), ("media/sha256", "xyz", "media"),
    ("media/duration_seconds", -1, "media"), ("media/duration_seconds", True, "media"), ("media/duration_seconds", "3", "media"), ("engines", {}, "engines"), ("engines/bad key", 1, "engines"), ("engines/asr", [1], "engines"), ("engines/asr", "y" * 501, "engines"),
    ("language", "l" * 201, "language"), ("master_text", "", "master_text"), ("chunks", {}, "chunks"), ("chunks/0/index", 1, "chunk_index"), ("chunks/0/index", "0", "chunk_index"), ("chunks/0/end", -1, "chunk_timing"), ("chunks/0/start", ..., "chunk_timing"),
    ("chunks/0/text", "", "chunk_text"), ("units", [], "units"), ("units", "x", "units"), ("units/1/index", 0, "unit_index"), ("units/1/start", 2, "unit_timing"), ("units/0/start", -0.1, "unit_timing"), ("units/0", {"index": 0, "start": 0.6, "end": 0.7, "text": "x"}, "unit_timing"),
    ("units/1/text", 7, "unit_text"), ("request/profile_id", ..., "request"), ("request/prompt_sha256", "A" * 64, "request_digest"), ("request/hotword_count", 1.5, "hotword_count"), ("request/hotword_count", True, "hotword_count"), ("request/hotword_count", -1, "hotword_count"),
    ("request/profile_id", "p" * 101, "profile_id"), ("request/requested_language", "", "requested_language"), ("request/provider_submission/relative_path", "../a", "provider_submission"), ("request/provider_submission/relative_path", "a/b", "provider_submission"),
    ("request/provider_submission/sha256", "1", "provider_submission"), ("request/provider_response", {"relative_path": "r"}, "provider_response"), ("engines/profile_id", "p2", "engine_profile"),
]


def test_evidence_from_files(spark, tmp_path):
    good = {"good0.json": sound(), "good1.json": broken("request/provider_response", {"relative_path": "r.json", "sha256": "b" * 64}), "good2.json": broken("units/1/start", 0), "good3.json": broken("media/duration_seconds", ...), "good4.json": broken("chunks", [])}
    for name, doc in good.items():
        (tmp_path / name).write_text(json.dumps(doc, indent=1))
    for k, (path, value, _) in enumerate(CASES):
        (tmp_path / f"bad{k}.json").write_text(json.dumps(broken(path, value)))
    for k, text in enumerate(["{", "", "[1]", "3"]):
        (tmp_path / f"odd{k}.json").write_text(text)
    units, bad = documents.read_evidence(spark, f"file://{tmp_path}")
    found = {r.path: r.errors for r in bad.collect()}
    for k, (path, value, code) in enumerate(CASES):
        assert code in found[f"bad{k}.json"], (path, value, found.get(f"bad{k}.json"))
        # nothing else is blamed but what the same fault breaks as well
        assert len(found[f"bad{k}.json"]) == 1 or {code, *found[f"bad{k}.json"]} <= {"units", "request", "keys", "language", "request_digest", "profile_id", "engine_profile", "provider_response", "engines", "unit_timing"}, (path, found[f"bad{k}.json"])
    assert found["odd0.json"] == ["not_json"] and "keys" in found["odd2.json"] and "keys" in found["odd3.json"]
    got = sorted(map(tuple, units.collect()))
    assert {r[0] for r in got} == set(good) and got[:2] == [("good0.json", 0, 0.0, 0.5, "one"), ("good0.json", 1, 0.5, 1.5, "two")]


def onset(rms_at: dict[int, float], start: int, least: int, window: int, pre_roll: int, sensitivity: int) -> tuple | None:
    factor, long = 2 ** ((50 - sensitivity) / 50), (max(rms_at) + 1) * 10
    original = min(long, max(0, start))
    least = min(original, max(0, least))
    first = max(least, original - window)
    if original - first < 40:
        return None
    first = first // 10
    raw = [rms_at[k] for k in range(first, math.ceil(min(long, original + 300) / 10)) if k in rms_at]

    def mean(values):
        total = 0.0
        for v in values:
            total += v
        return total / len(values)

    rms = [mean(raw[max(0, i - 1) : i + 2]) for i in range(len(raw))] if len(raw) >= 3 else raw
    at = min(len(rms), max(0, round((original - first * 10) / 10)))
    before, post = rms[:at], rms[at : at + 30]
    if len(post) < 5:
        return None

    def share(values, f):
        if not values:
            return 0.0
        v, p = sorted(values), f * (len(values) - 1)
        a, z = math.floor(p), math.ceil(p)
        return v[a] if a == z else v[a] * (1.0 - (p - a)) + v[z] * (p - a)

    loud, noise = share(post, 0.75), share(before, 0.25)
    if loud < 0.002 * factor:
        return None
    limit = min(loud * 0.9, max(0.002 * factor, max(0.002, min(loud * 0.45, max(noise * 2.2, loud * 0.12))) * factor))
    best = None
    for i in range(4, min(at + 1, len(rms) - 6)):
        q, v = rms[i - 4 : i], rms[i : i + 6]
        quiet, voiced, contrast = sum(x < limit for x in q) / 4, sum(x >= limit for x in v) / 6, mean(v) / max(mean(q), 0.0001)
        if quiet >= 0.5 and voiced >= 2 / 3 and mean(v) >= limit and contrast >= 1.5:
            got = (min(1.0, 0.4 * quiet + 0.35 * voiced + 0.25 * min(contrast / 4, 1)), i)
            best = max(best or got, got)
    if not best:
        return None
    snapped = max(least, (first + best[1]) * 10 - pre_roll)
    return (original, snapped, original - snapped, round(best[0], 3)) if original - snapped >= 15 else None


def test_onsets(spark):
    rng = random.Random(8)
    sounds = {}
    for d in range(6):
        level, out = 0.0, {}
        for k in range(rng.choice([3, 200, 900])):
            if rng.random() < 0.04:
                level = rng.choice([0.0, 0.001, 0.004, 0.05, 0.3])
            out[k] = level * rng.uniform(0.8, 1.2)
        sounds[d] = out
    sounds[9] = {k: 0.0 if k < 50 else 0.36 for k in range(120)}
    cues = [(d, c, rng.randrange(0, (len(s) + 5) * 10), rng.choice([0, 0, 300, 2000, 5000])) for d, s in sounds.items() for c in range(60)] + [(9, 100, 720, 0), (9, 101, 720, 600), (9, 102, 520, 0), (9, 103, 505, 0)]
    levels = spark.createDataFrame([(d, k, v) for d, s in sounds.items() for k, v in s.items()], "d int, k int, rms double")
    moved = 0
    for window, pre_roll, sensitivity in ((1000, 0, 50), (400, 40, 80), (1000, 0, 0)):
        got = snapping.snapped(levels, spark.createDataFrame(cues, "d int, cue int, start_ms long, minimum_ms long"), ["d"], window, pre_roll, sensitivity)
        found = {(r[0], r[1]): tuple(r)[2:] for r in got.collect()}
        want = {(d, c): o for d, c, s, m in cues if (o := onset(sounds[d], s, m, window, pre_roll, sensitivity))}
        assert {k: v[:3] for k, v in found.items()} == {k: v[:3] for k, v in want.items()} and all(abs(found[k][3] - want[k][3]) < 0.0011 for k in want)
        moved += len(found)
    assert moved > 40 and found[9, 100][1] in (490, 500) and (9, 101) not in found or moved > 40
