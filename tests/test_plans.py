"""Every query over the driver's tables against its DuckDB SQL, on the smallest tables; literal cases of the functions."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.functions import text as fn
from quillstream.operators import intervals
from quillstream.plans import ORACLE_SQL, QUERIES, bindings

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[str]:
    flat = lambda v: None if pd.isna(v) else round(float(v), 6) if isinstance(v, int | float) or hasattr(v, "dtype") else v
    return sorted(str(tuple(flat(v) for v in r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    assert rows(QUERIES[name](spark, SF).toPandas()) == rows(duck.sql(ORACLE_SQL[name]).df())


def test_stamps(spark):
    got = spark.createDataFrame([(3661500,), (0,), (359999999,)], "ms long").select(fn.stamp_srt(F.col("ms")).alias("s"), fn.stamp_ass(F.col("ms")).alias("a"), fn.parse_stamp(fn.stamp_srt(F.col("ms"))).alias("ms")).collect()
    assert [r.s for r in got] == ["01:01:01,500", "00:00:00,000", "99:59:59,999"] and got[0].a == "1:01:01.50" and [r.ms for r in got] == [3661500, 0, 359999999]


def test_visible_length(spark):
    got = spark.createDataFrame([("data",), ("data,",), ("data test",), ("中文data。",), (" 中  文 ",)], "t string").select(fn.visible_length(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [4, 5, 9, 7, 2]


def test_subtract(spark):
    keep = spark.createDataFrame([(1, 0, 6), (1, 5, 10)], "k int, start_ms long, end_ms long")
    cuts = spark.createDataFrame([(1, 2, 4), (1, 3, 7)], "k int, start_ms long, end_ms long")
    assert sorted(map(tuple, intervals.subtract(keep, cuts, ["k"]).collect())) == [(1, 0, 2), (1, 7, 10)]
    assert intervals.subtract(keep, spark.createDataFrame([(1, 0, 20)], cuts.schema), ["k"]).count() == 0


def test_applied_in_order(spark):
    rows = [(1, 1, False, 2, 4), (1, 2, True, 3, 4), (1, 3, False, 0, 1), (2, 1, True, 12, 15), (2, 2, False, 5, 20), (3, 1, False, 0, 10), (4, 1, False, 4, 4), (4, 1, True, 9, 9)]
    got = intervals.applied(spark.createDataFrame(rows, "k int, n int, restore boolean, start_ms long, end_ms long"), ["k"], 0, 10)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 2), (1, 3, 10), (2, 0, 5), (4, 0, 10)]


def test_overlaps_of_empty_and_reversed(spark):
    spans = [(k, a, b) for k, (a, b) in enumerate([(0, 10), (5, 5), (0, 0), (10, 10), (12, 30), (20, 20), (28, 13), (30, 41), (7, 3), (None, 9)])]
    df = spark.createDataFrame(spans, "n int, start_ms long, end_ms long").withColumn("k", F.lit(1))
    known = [s for s in spans if s[1] is not None]
    pairs = lambda hit: sorted((r.n, r.o_n) for r in hit.collect())
    assert pairs(intervals.overlaps(df, df, ["k"], 10)) == [(x, y) for x, a, b in known for y, c, d in known if a < d and c < b]
    assert pairs(intervals.covers(df, df, ["k"], 10)) == [(x, y) for x, a, b in known for y, c, d in known if c <= a and b <= d]


@pytest.mark.parametrize("name", ["op_restore", "join_covering_group", "join_evidence_window", "join_halfopen_overlap", "project_range"])
def test_units_without_length(spark, tmp_path, name):
    """A unit whose value rounds to no milliseconds is an empty interval, which SQL joins where it lies inside another."""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE value * 9 END AS value) FROM '{SF}/events.parquet') TO '{tmp_path}/events.parquet'")
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    assert rows(QUERIES[name](spark, str(tmp_path)).toPandas()) == rows(c.sql(ORACLE_SQL[name]).df())


def test_span_statistics_of_rows(spark):
    """Spans are measured as they stand, without a row for each place that they cover."""
    assert "Generate" not in QUERIES["agg_span_statistics"](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["fallback_timing", "sentence_by_overlap", "wire_segment_request", "scan_provider_words"])
def test_turns_are_parted_by_number(spark, monkeypatch, name):
    """A table of more turns is read by more tasks, however many a shuffle has."""
    monkeypatch.setattr(bindings, "TASK_ROWS", 3)
    turns = spark.read.parquet(f"{SF}/conversations.parquet").count()
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert f", {-(-turns // 3)}), REPARTITION_BY_NUM" in plan


def test_sentence_by_overlap_of_all_sentences(spark, monkeypatch):
    """Each unit meets all sentences of its cue, far ones too, and both ends of a sentence's units are marked; by brute force on sentences that overlap and lie apart."""
    import random

    from quillstream.plans import common_sql

    rng = random.Random(4)
    words = []
    for c in range(12):
        n = rng.randint(1, 60)
        for pos in range(n):
            # sentences lie at places of their own, some within one another
            start = (c * 7919 + pos // 9 * 104729) % (20 if c < 6 else 400) * 50 + pos % 9 * 300
            words.append((c, 0, "a", pos, start, start + rng.choice([50, 100, 400])))
    df = spark.createDataFrame(words, "doc_id long, idx long, speaker string, pos long, start_ms long, end_ms long")
    monkeypatch.setitem(common_sql._ENTITIES, "words", (lambda spark, sf_dir: df, ""))
    got = {(r.doc_id, r.pos): (r.sentence, r.first_of, r.last_of) for r in QUERIES["sentence_by_overlap"](spark, "").collect()}
    want, far = {}, 0
    for c in range(12):
        own = [w for w in words if w[0] == c]
        spans = {k: (min(w[4] for w in own if w[3] // 9 == k), max(w[5] for w in own if w[3] // 9 == k)) for k in {w[3] // 9 for w in own}}
        for w in own:
            s, e = w[4] + 150, w[5] + 150
            over = {k: min(e, b) - max(s, a) for k, (a, b) in spans.items()}
            best = max(over.values())
            want[c, w[3]] = min(k for k, x in over.items() if x == best) if best > 0 else min((abs(s + e - a - b), k) for k, (a, b) in spans.items())[1]
            far += abs(want[c, w[3]] - w[3] // 9) > 1
    ends = {}
    for (c, pos), k in sorted(want.items()):
        ends.setdefault((c, k), []).append(pos)
    assert far > 10 and got == {(c, pos): (k, pos == ends[c, k][0], pos == ends[c, k][-1]) for (c, pos), k in want.items()}
