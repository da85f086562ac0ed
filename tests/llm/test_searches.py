"""Hard negatives, bottom-k near-duplicates and the divergence audit against brute force, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from quillstream.llm import bottom_k, divergence, dual_tree, queries
from quillstream.llm.oracles import ORACLE_SQL

CLASH = "_row string, `a.b` string, rank string, component_id string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def got(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


# hard negatives


def negatives_by_force(rows: list[tuple]) -> list[tuple]:
    own = []
    for vec_id, vector, label in dict.fromkeys((v, None if x is None else tuple(x), y) for v, x, y in rows):
        if label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        own.append((vec_id, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in vector), (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label))
    own = list(dict.fromkeys(own))
    dot = lambda x, y: sum(a * b for a, b in zip(x, y))  # noqa: E731, B905  zeros follow the shorter one
    last = float("inf")
    out = []
    for a, x, label in own:
        if a is None or a % 100:
            continue
        best = lambda same: sorted((-dot(x, y), last if b is None else b) for b, y, z in own if (z == label) == same and b != a)  # noqa: E731, B023
        for p, b in [r for r in best(True) if r[1] != last][:5]:
            band = [(-s, n) for s, n in best(False) if 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, b, k, None if n == last else n, -p, s) for k, (s, n) in enumerate(band, 1)]
    return sorted(out, key=str)


def vectors(seed: int, n: int, width: int, spread: float) -> list[tuple]:
    rng = np.random.default_rng(seed)
    middles = rng.normal(0, 1, (5, width))
    rows = [(i, [float(np.float32(x)) for x in middles[rng.integers(5)] + spread * rng.normal(0, 1, width)], int(rng.integers(10))) for i in range(n)]
    return [(i, rows[i % 9][1], rows[i % 9][2]) if i % 3 == 1 else (i, v, y) for i, v, y in rows]


def negatives(spark, rows: list[tuple]) -> list[tuple]:
    return got(dual_tree.hard_negatives(spark.createDataFrame([(*r, "", "", "", "") for r in rows], f"vec_id long, embedding array<float>, label int, {CLASH}")))


@pytest.mark.parametrize(("seed", "n", "width", "spread"), [(1, 700, 4, 0.3), (2, 450, 16, 1.0), (3, 320, 2, 0.01)])
def test_negatives_by_force(spark, monkeypatch, seed, n, width, spread):
    for name, value in (("ANCHORS", 3), ("CANDIDATES", 16), ("LEAF", 20), ("SMALL", 0 if seed == 1 else 1 << 20)):
        monkeypatch.setattr(dual_tree, name, value)
    rows = vectors(seed, n, width, spread)
    nan, none = float("nan"), None
    rows += [(100, none, 3), (200, rows[0][1], none), (800, [nan] * width, 1), (900, [none] * width, 1), (1000, [float("inf")] * width, 1), (1100, [], 2), (1200, [0.0], 2), (none, rows[5][1], 4), (none, rows[6][1], 5), rows[0], rows[0], (300, rows[1][1], 7)]
    want = negatives_by_force(rows)
    assert len(want) >= 100 and negatives(spark, rows) == want


def test_negatives_of_nothing_and_of_ties(spark):
    assert negatives(spark, []) == [] and negatives(spark, [(1, [1.0], 1)]) == [] and negatives(spark, [(100, [1.0], 1)]) == []
    same = [(i, [1.0, 0.0], 1) for i in range(0, 340, 2)] + [(i, [0.5, 0.5], 2) for i in range(1, 340, 2)]
    assert negatives(spark, same) == negatives_by_force(same)
    opposite = [(0, [1.0], 1), (1, [-1.0], 1), (2, [-0.5], 2), (3, [0.0], 1), (4, [0.0], 2)]
    assert negatives(spark, opposite) == negatives_by_force(opposite)


def test_pruning_is_safe_and_prunes(monkeypatch):
    monkeypatch.setattr(dual_tree, "LEAF", 12)
    rng = np.random.default_rng(4)
    middles = rng.integers(-2000, 2000, (40, 6))
    x = np.concatenate([m + rng.integers(-30, 30, (50, 6)) for m in middles])
    cuts = dual_tree.Cuts(x)
    leaf, _ = cuts.place(x)
    nodes = {int(k): dual_tree.Node(x[leaf == k].min(axis=0), x[leaf == k].max(axis=0), {0}) for k in set(leaf)}
    s = dual_tree.scores(x, x)
    least = np.sort(s, axis=1)[:, -5]
    anchors = {k: dual_tree.Node(n.low, n.high, {0}, int(least[leaf == k].min())) for k, n in nodes.items()}
    open_ = set(dual_tree.open_leaves(anchors, nodes, cuts.depth, True))
    needed = {(int(leaf[i]), int(leaf[j])) for i, j in zip(*np.nonzero(s >= least[:, None]), strict=True)}
    assert needed <= open_ and len(open_) < len(nodes) ** 2 / 2
    wide = np.array([[1 << 27, -(1 << 27), 5]])
    assert dual_tree.scores(wide, wide).tolist() == [[2 * (1 << 54) + 25]]


# near-duplicates


def shingle_set(text: str | None) -> set[str]:
    own = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {f"{a} {b}" for a, b in zip(own, own[1:], strict=False)} or set(own[:1])


def duplicates_by_force(rows: list[tuple]) -> list[tuple]:
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                root[find(i)] = find(j)
    low: dict = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        low[find(i)] += [doc_id] if doc_id is not None else []
    ids = [min(low[find(i)], default=None) for i in range(len(rows))]
    return sorted(((doc_id, len(s), k, doc_id == k) for (doc_id, _), s, k in zip(rows, sets, ids, strict=True)), key=str)


def texts(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefÉé") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    passage = [rng.choice(vocab) for _ in range(60)]
    rows: list[tuple] = []
    for i in range(n):
        own = [rng.choice(vocab) for _ in range(rng.choice([2, 3, 5, 9, 30, 70, 150, 400]))]
        if i % 4 == 0:
            own = own[:20] + passage + own[20:]
        if rows and i % 2:
            own = (rng.choice(rows)[1]).split(" ")
            for _ in range(int(len(own) * rng.choice([0, 0.01, 0.03, 0.05, 0.07, 0.1]))):
                own[rng.randrange(len(own))] = rng.choice(vocab)
        rows.append((i, " ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    long = " ".join(rng.choice(vocab) for _ in range(20_000))
    return [*rows, (5000, None), (5001, ""), (5002, " \n\t"), (5003, "one"), (5004, "One"), (None, "one"), (None, None), (5005, long), (5006, f"{long} end"), (3, rows[40][1]), rows[7], rows[7], (None, rows[9][1]), (5007, "a\x1cb c"), (5008, "a\x1cb\x0bC")]


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_by_force(spark, seed):
    rows = texts(seed, 240)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], f"doc_id long, text string, {CLASH}")
    want = duplicates_by_force(rows)
    assert len({r[2] for r in want}) < 0.8 * len(rows)
    assert got(bottom_k.near_duplicates(docs)) == want


def test_near_duplicates_joined_by_a_row_without_id(spark):
    words = [f"w{i}" for i in range(60)]
    a, b, c = words[:50], words[:56], words
    assert 100 * 49 >= 80 * 55 and 100 * 49 < 83.1 * 59
    rows = [(9, " ".join(words[5:])), (None, " ".join(words[:58])), (4, " ".join(words[:50])), (8, " ".join(a + b[:0] + c[:0]))]
    got_ = got(bottom_k.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got_ == duplicates_by_force(rows) and {r[2] for r in got_} == {4}
    assert bottom_k.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_share_enough_values():
    """Sets of similarity 0.8 and their sketches, at all sizes about that of a sketch."""
    rng = random.Random(5)
    for n in [*range(1, 90), 400]:
        for _ in range(20):
            both = [f"b{rng.random()} x" for _ in range(n)]
            more = [f"m{rng.random()} x" for _ in range(n // 4)]
            cut = rng.randint(0, len(more))
            x, y = ({k: bottom_k.xxhash.xxh64_intdigest(k) for k in own} for own in (both + more[:cut], both + more[cut:]))
            a, b = (sorted(v.values())[: bottom_k.RETAINED] for v in (x, y))
            assert n + n // 4 < bottom_k.RETAINED or len(set(a) & set(b)) >= bottom_k.SHARED
            runs = [{tuple(own[k : k + size]) for size in ((2, 3) if len(own) <= bottom_k.SMALL else (3,)) for k in range(len(own) - size + 1)} for own in (a, b)]
            least = max(1, min(bottom_k.RUNS, (max(len(x), len(y)) * 4 - 11) // 10))
            assert set(x) == set(y) or len(runs[0] & runs[1]) >= least
            assert bottom_k.likely(*(np.array(own, dtype=np.uint64) for own in (a, b)), len(x), len(y))


# divergence


def audit_by_force(rows: list[tuple], least_docs: int, most: int) -> list[tuple]:
    counts: dict = defaultdict(Counter)
    having: dict = defaultdict(Counter)
    groups = {(lang or "", source or "") for lang, source, _ in rows}
    for lang, source, text in rows:
        own = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang or "", source or ""].update(own)
        having[lang or ""].update(set(own))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in having[lang].items() if n >= least_docs]
        own = {s: counts[lang, s] for x, s in groups if x == lang}
        whole = sum(own.values(), Counter())
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 5) // (sum(c[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        ps, q = {s: p(c) for s, c in own.items()}, p(whole)
        for s in own:
            pairs = sorted((-sum(abs(ps[s][t] - ps[o][t]) for t in kept), o.encode(), o) for o in own if o != s)
            terms = sorted((q[t] - ps[s][t], t.encode(), t) for t in kept if own[s][t] and ps[s][t] > q[t])[:most]
            for part, found in (("pair", pairs), ("term", terms)):
                out += [(lang, s, part, item, -v, k) for k, (v, _, item) in enumerate(found, 1)]
    return sorted(out, key=str)


def said(seed: int, n: int) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcÉéß中") for _ in range(rng.randint(1, 4))) for _ in range(120)]
    rows = []
    for i in range(n):
        own = [rng.choice(vocab[: rng.choice([10, 40, 120])]) for _ in range(rng.randint(0, 60))]
        source = "hot" if i % 3 else rng.choice(["s0", "s1", "s2", "É", None])
        rows.append((rng.choice(["en", "en", "fr", None]), source, rng.choice([" ", "1", "_\x00"]).join(own).upper() if i % 4 == 0 else " ".join(own)))
    return [*rows, ("de", "alone", "only a few"), ("de", "other", None), ("xx", "single", "a b c"), ("en", "silent", "1 2 3"), ("en", "silent", None), *rows[:5]]


@pytest.mark.parametrize(("least", "most", "held"), [(5, 50, 200_000), (12, 4, 50)])
def test_audit_by_force(spark, monkeypatch, least, most, held):
    monkeypatch.setattr(divergence, "HELD", held)
    rows = said(least, 200)
    docs = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], f"lang string, source string, text string, {CLASH}")
    want = audit_by_force(rows, least, most)
    assert len(want) > 60 and got(divergence.audit(docs, least, most)) == want


def test_audit_of_few_pairs_at_a_time_and_of_nothing(spark, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS", 3)
    rows = said(9, 80)
    assert got(divergence.audit(spark.createDataFrame(rows, "lang string, source string, text string"), 3, 50)) == audit_by_force(rows, 3, 50)
    assert divergence.audit(spark.createDataFrame([], "lang string, source string, text string")).collect() == []


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_minhash", "op13_divergence"])
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for table in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf}/{table}.parquet'")
    df = queries.QUERIES[name](spark, sf)
    assert got(df) == sorted(map(tuple, con.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()), key=str)


def test_near_duplicate_stage_with_odd_column_names(spark):
    """The stage keeps one row an id whatever other columns are called, and repeated ids with several texts keep the first text."""
    import corpus_pipeline

    same = " ".join(f"w{k}" for k in range(40))
    rows = [(1, same, "a", "b", "c"), (1, same, "a", "b", "c"), (1, "another text", "x", "y", "z"), (2, same + " end", "d", "e", "f"), (3, "alone", None, None, None), (None, "no id", "g", "h", "i")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row string, `a.b` string, `c``d` string")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([rows[2], rows[4], rows[5]], key=str)


def test_stage_is_the_minhash_operator_with_five_words(spark, monkeypatch):
    """The stage's documents come from op12's operator; what it links at five words is what all pairs of five-word sets do."""
    import corpus_pipeline

    rng = random.Random(11)
    texts = []
    for _ in range(5):
        base = [f"w{rng.randrange(400)}" for _ in range(rng.randint(20, 150))]
        texts += [" ".join(w if rng.random() > 0.01 else f"x{rng.randrange(400)}" for w in base) for _ in range(6)]
    rows = [*enumerate(texts), (100, None), (101, " "), (102, "one two"), (103, "One  two"), (200, "left text"), (201, "left text"), (201, "right text"), (202, "right text")]
    sets = [(i, frozenset(" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if (w := (t or "").lower().split()) else frozenset()) for i, t in rows]
    comp = {i: i for i, _ in sets}
    for _ in comp:
        for i, a in sets:
            for j, b in sets:
                if 100 * len(a & b) >= 80 * len(a | b):
                    comp[i] = comp[j] = min(comp[i], comp[j])
    asked = []
    operator = bottom_k.near_duplicates
    monkeypatch.setattr(bottom_k, "near_duplicates", lambda docs, words: asked.append(words) or operator(docs, words))
    got = [r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert asked == [5] and sorted(got) == sorted(i for i in comp if comp[i] == i) and len(got) < 25
