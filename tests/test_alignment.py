"""Sequential operators against brute force over all choices."""

from __future__ import annotations

import itertools
import random

import pyarrow as pa

from quillstream.plans import ORACLE_SQL, QUERIES, alignment

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n, f in QUERIES.items() if n not in ORACLE_SQL and f.__module__ == alignment.__name__)


def test_opcodes_rebuild_the_reference():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(2))
        out, at = [], 0
        for tag, i1, i2, j1, j2 in alignment.opcodes(a, b):
            assert i1 == at and (tag != "equal" or a[i1:i2] == b[j1:j2])
            at, out = i2, out + (a[i1:i2] if tag == "equal" else b[j1:j2])
        assert out == b and at == len(a)


def test_fewest_breaks_by_force():
    rng = random.Random(2)
    for _ in range(200):
        sizes, limit = [rng.randint(1, 9) for _ in range(rng.randint(1, 8))], rng.randint(5, 16)
        best = None
        for cuts in itertools.chain.from_iterable(itertools.combinations(range(len(sizes) - 1), k) for k in range(len(sizes))):
            ends = [*cuts, len(sizes) - 1]
            rows = [sizes[a + 1 : b + 1] for a, b in zip([-1, *ends], ends, strict=False)]
            full = [sum(r) + len(r) - 1 for r in rows]
            if all(f <= limit or len(r) == 1 for f, r in zip(full, rows, strict=True)):
                got = (len(rows), sum(max(limit - f, 0) ** 2 for f in full), ends)
                best = min(best or got, got)
        assert alignment.fewest_breaks(sizes, limit) == best[2]
    assert alignment.fewest_breaks([], 5) == []


def test_greedy_matches():
    assert alignment.greedy_matches([1000, 1300], [1200], 500) == [(1000, 1200), (1300, None)]  # in the order of the reference, not the nearest pair
    assert alignment.greedy_matches([10], [5, 15], 5) == [(10, 5)] and alignment.greedy_matches([], [1], 5) == []


def test_groups_and_absorbing():
    assert alignment.fallback_groups(["One.", "Two", "three", "four"], [0, 4, 8, 20], [3, 7, 11, 23], 9, 9) == [0, 1, 1, 2]
    assert alignment.fallback_groups(["ab"] * 5, [0] * 5, [0] * 5, 9, 5) == [0, 0, 1, 1, 2]
    rows = [(0, 1, "a", "one two three"), (2, 3, "a", "four"), (3, 4, "b", "five"), (9, 10, "b", "six")]
    assert alignment.absorbed(rows, 2, 3) == [(0, 3, "a", "one two three four"), (3, 4, "b", "five"), (9, 10, "b", "six")]
    assert alignment.normalized_lexical("Ｗell’ness–Straße") == "well'ness-strasse"


def test_queries_run(spark):
    turns = spark.read.parquet(f"{SF}/conversations.parquet").count()
    assert len(NAMES) == 8
    for name in NAMES:
        got = QUERIES[name](spark, SF)
        assert got.columns[:3] == ["doc_id", "idx", "speaker"] and got.count() > 0, name
    assert QUERIES["aln_text_ratio"](spark, SF).where("ratio > 0 AND ratio < 1").count() > turns / 2
    kept = QUERIES["aln_sequence_map"](spark, SF).groupBy("doc_id", "idx", "speaker").count().count()
    assert kept > turns / 2


def test_rows_of_few_turns_at_once():
    """A worker makes the rows of a slice of turns at a time, however many turns a batch has."""

    class Frame:
        def mapInArrow(self, run, schema):
            return run

    n = 1000
    turns = pa.RecordBatch.from_pydict({"doc_id": range(n), "idx": range(n), "speaker": ["a"] * n, "words": [["x", "y"]] * n})
    got = list(alignment._rows(Frame(), "word string", lambda r: [(w,) for w in r.words])(iter([turns])))
    assert max(b.num_rows for b in got) <= 2 * 64 and sum(b.num_rows for b in got) == 2 * n
