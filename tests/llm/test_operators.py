"""The corpus operators against brute-force versions on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import pytest
import xxhash

from quillstream.llm import decontaminate, html_text, imatch, language, licenses, line_dedup, mixing, near_sets, queries, simhash, suffix_dedup, warc
from quillstream.llm.common import components
from quillstream.llm.oracles import ORACLE_SQL

DOC = "doc_id long, text string, lang string, source string, n_chars long, component_id string"


def corpus(seed: int = 1, n: int = 60) -> list[tuple]:
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)] + ["É", "Été", "ü"]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    passage, line = say(60), say(12)
    rows = []
    for i in range(n):
        lines = [say(rng.randint(1, 40)) for _ in range(rng.randint(1, 5))]
        if i % 5 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if i % 3 == 0:
            lines.append(line)
        text = "\n".join(lines)
        if rows and i % 7 == 0:
            text = rows[rng.randrange(len(rows))][1]
        if rows and i % 11 == 0:
            words = (rows[rng.randrange(len(rows))][1] or "x").split(" ")
            words[rng.randrange(len(words))] = "Edited"
            text = " ".join(words)
        rows.append((i * 3, text, rng.choice(["en", "fr"]), f"s{i % 3}", len(text or ""), "clash"))
    rows += [(1000, None, None, None, None, None), (1001, "", "en", None, 0, None), (1002, " \n\t", "en", "s1", 3, ""), (1003, "one", "en", "s1", 3, ""), (None, passage, "en", "s0", 1, ""), (1004, passage * 30, "fr", "s0", 1, "")]
    return [*rows, rows[3], (rows[4][0], "another text under a known id", "en", "s2", 1, "")]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOC)


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(0, 120)] + [(-5, k) for k in range(1000, 1100)] + [(rng.randrange(-(2**62), 2**62) * 2, k) for k in range(2000, 2050)] + [(2000, 2010), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = sorted((find(u), find(v)))
        root[b] = a
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: find(x) for x in root}


def empty(spark):
    return spark.createDataFrame([], DOC)


def test_simhash_brute_force(spark, docs, rows):
    def fp(text):
        w = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        parts = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] * bool(w)
        h = [xxhash.xxh64_intdigest(p, 42) for p in parts]
        return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))

    fps = [(r[0], fp(r[1])) for r in rows]
    comp = {i: i for i, _ in fps if i is not None}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in fps:
        for j, b in fps:
            if i is not None and j is not None and (a ^ b).bit_count() <= 2:
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    got = simhash.near_duplicates(docs).collect()
    want = []
    for i, a in fps:
        same = [j for j, b in fps if b == a and j is not None]
        want.append((i, f"{a:016x}", find(min(same)) if same else None))
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    kept = simhash.keep_one(docs).collect()
    assert len({r.doc_id for r in kept}) == len([r for r in kept if r.doc_id is not None]) + (1 if any(r.doc_id is None for r in kept) else 0)
    assert {r.doc_id for r in kept if r.doc_id is not None} == {find(i) for i in comp}
    assert simhash.near_duplicates(empty(spark)).count() == 0


def test_pipeline_near_duplicates_of_five_words(spark, docs, rows):
    """The stage keeps the smallest document of chains of similarity 0.8 or more over sets of five-word shingles."""
    import corpus_pipeline

    rng = random.Random(6)
    more = []
    for _ in range(6):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randint(40, 120))]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, len(base) // 25)):
                own[rng.randrange(len(own))] = f"x{rng.randrange(500)}"
            more.append((5000 + len(more), " ".join(own), "en", "s0", 1, ""))
    every = [*rows, *more]

    def shingles(text):
        w = (text or "").lower().split()
        return frozenset(" ".join(w[i : i + 5]) for i in range(len(w) - 4)) or frozenset([" ".join(w)] * bool(w))

    sets = [(r[0], shingles(r[1])) for r in every if r[0] is not None]
    comp = {i: i for i, _ in sets}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for i, a in sets:
        for j, b in sets:
            if a == b or len(a & b) >= 0.8 * len(a | b):
                x, y = sorted((find(i), find(j)))
                comp[y] = x
    got = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(every, DOC), "").collect()}
    assert got - {None} == {find(i) for i in comp} and len({find(r[0]) for r in more}) <= len(more) // 2
    assert corpus_pipeline.drop_near_duplicates(spark, empty(spark), "").count() == 0


def removed_by_force(rows):
    first: dict[bytes, int] = {}
    none = 2**63 - 1
    data = [(none if r[0] is None else r[0], (r[1] or "").encode()) for r in rows]
    for i, t in data:
        for k in range(len(t) - 49):
            first[t[k : k + 50]] = min(first.get(t[k : k + 50], none), i)
    out = []
    for (i, t), r in zip(data, rows, strict=True):
        gone = bytearray(len(t))
        for k in range(len(t) - 49):
            if first[t[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(t, gone, strict=True) if not g)
        out.append((r[0], len(t), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_brute_force(spark, docs, rows):
    got = [tuple(r) for r in suffix_dedup.removals(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, removed_by_force(rows)))
    assert suffix_dedup.removals(empty(spark)).count() == 0


def test_suffix_periodic_and_partial_overlap(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(400))
    rows = [(i, base[rng.randrange(300) :][: rng.randint(10, 120)] + "x" * rng.randint(0, 80), "", "", 0, "") for i in range(40)]
    docs = spark.createDataFrame(rows, DOC)
    assert sorted(map(str, map(tuple, suffix_dedup.removals(docs).collect()))) == sorted(map(str, removed_by_force(rows)))


def test_transform_gives_common_prefixes():
    import numpy as np

    text = np.array([ord(c) for c in "mississippi_mississippi"] + [0], dtype=np.int16)
    order, prev, psi = suffix_dedup.transform(text, 4)
    same = suffix_dedup.repeated(text, prev, psi, 4)
    cyclic = [bytes(np.roll(text, -k).astype(np.uint8)[:4]) for k in order]
    assert [False] + [a == b for a, b in zip(cyclic, cyclic[1:])] == same.tolist()


def test_mixing_targets(spark, docs, rows):
    got = mixing.mix(docs, mixing.word_count()).collect()
    assert len(got) == len(rows)
    sizes = {s: sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows if r[3] == s) for s in {r[3] for r in rows}}
    room, caps, weights = 1.5 * sum(sizes.values()), {s: 2 * v for s, v in sizes.items()}, {}
    for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s))):
        weights[s] = (3, 1, 2)[k % 3]
    full: set = set()
    while True:
        left = room - sum(caps[s] for s in full)
        open_ = [s for s in sizes if s not in full]
        goal = {s: left * weights[s] / sum(weights[x] for x in open_) for s in open_} | {s: float(caps[s]) for s in full}
        over = {s for s in open_ if goal[s] > caps[s]}
        if not over:
            break
        full |= over
    for s in sizes:
        own = [r for r in got if r.source == s]
        assert {r.source_size for r in own} == {sizes[s]}
        assert all(abs(r.target - goal[s]) < 1e-6 and r.taken <= 2 * r.size for r in own)
        assert abs(sum(r.taken for r in own) - goal[s]) <= max(r.size for r in own)
    assert got and sorted(map(str, got)) == sorted(map(str, mixing.mix(docs, mixing.word_count()).collect()))
    assert mixing.mix(empty(spark), mixing.word_count()).count() == 0


def test_sql_agrees(spark, rows, tmp_path):
    import pandas as pd

    pages = [(0, "u", None), (1, "u", ""), (2, None, "<p>é</p>"), (3, "v", "<p>é</p>"), (4, "w", "other" * 5000)]
    unique = list({r[0]: (*r[:2], "x" if r[3] is None else r[3]) for r in rows if r[0] is not None}.values())
    extra = [(2000, "Released under the MIT License. cc by nc 4", "s0"), (2001, "under the mit license under the mit license", "s0"), (2002, "This work is licensed under\nthe GNU General Public License, version 3", "s1"),
             (2003, "work licensed under the GNU General Public License: version 3", "s1")]
    langs = [(*r, ["en", "fr", None][r[0] % 3]) for r in unique + extra]
    spark.createDataFrame(langs, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rng = random.Random(8)
    vectors = [(i, [rng.gauss(0, 1) for _ in range(6)] if i % 5 else None, rng.randrange(4) if i % 9 else None) for i in range(301)]
    spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name, sql in ORACLE_SQL.items():
        a, b = queries.QUERIES[name](spark, str(tmp_path)).toPandas(), c.sql(sql).df()
        assert set(a.columns) == set(b.columns), name
        key = [a.columns[0], *sorted(a.columns)]
        a, b = (x[sorted(a.columns)].sort_values(key).reset_index(drop=True) for x in (a, b))
        pd.testing.assert_frame_equal(a, b, check_dtype=False, obj=name)


def test_imatch_order_and_ties(spark, docs, rows):
    got = imatch.fingerprints(docs).collect()
    assert len(got) == len(rows)
    by_text: dict = {}
    one = {r[0]: r[1] or "" for r in rows}
    for r in got:
        if sum(x[0] == r.doc_id for x in rows) == 1:
            assert by_text.setdefault(one[r.doc_id], r.fingerprint) == r.fingerprint and 0 <= r.near_edited <= 1
    assert imatch.fingerprints(empty(spark)).count() == 0


def test_license_ties(spark, docs, rows):
    assert licenses.scan(docs).count() == len(rows)
    assert licenses.scan(empty(spark)).count() == 0


def test_warc_ranges_and_rivals(spark, tmp_path):
    rng = random.Random(2)
    pages = [(i, f"http://x/{i}", "".join(rng.choice("abc \n") for _ in range(rng.randint(0, 3000)))) for i in range(200)]
    pages += [(300, None, None), (301, "u\r\nX: y", ""), (302, "v", pages[5][2]), (302, "v", pages[5][2]), (None, "n", pages[5][2]), (None, "n", "alone")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    warc.write(df, str(tmp_path / "w"))
    whole = warc.read(spark, f"file://{tmp_path}/w").collect()
    assert len({r.record_id for r in whole if r.page_id is not None}) == len({(r.page_id, r.payload_digest) for r in whole if r.page_id is not None})
    small = warc.read(spark, f"file://{tmp_path}/w", size=777).collect()
    key = lambda r: (str(r.page_id), r.record_type, r.payload_digest)
    assert len(whole) == len(pages) and sorted(whole, key=key) == sorted(small, key=key)
    by = {}
    for r in whole:
        by.setdefault(r.page_id, []).append(r)
    assert [r.record_type for r in by[302]] == ["response"] * 2 and by[5][0].refers_to == 302 and by[5][0].payload is None
    assert {(r.record_type, r.refers_to) for r in by[None]} == {("revisit", 302), ("response", None)}
    assert by[300][0].refers_to == 301 and bytes(by[7][0].payload) == pages[7][2].encode()
    assert by[5][0].payload_bytes == len(pages[5][2])
    assert warc.round_trip(df.where("false")).count() == 0


def test_foreign_and_damaged_archives(spark, tmp_path):
    import gzip

    def member(kind: str, block: bytes, more: str = "", name: str = "urn:uuid:8f5e6c1a") -> bytes:
        return gzip.compress(f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <{name}>\r\n{more}\r\n".encode() + block + b"\r\n\r\n")

    rng = random.Random(1)
    page = b"HTTP/1.1 200 OK\r\nServer: x\r\n\r\n" + bytes(rng.randrange(256) for _ in range(3_000_000))
    http = lambda b: f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(b)}\r\n"
    records = [member("warcinfo", b"software: x", "Content-Length: 11\r\n"), member("request", b"GET / HTTP/1.1\r\n\r\n", http(b"GET / HTTP/1.1\r\n\r\n")), member("response", page, http(page), "urn:page:7:X"), member("metadata", b"no length")]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.warc.gz").write_bytes(b"".join(records))
    for size in (1 << 24, 100_000):
        got = {r.record_type: r for r in warc.read(spark, f"file://{tmp_path}/a", size).collect()}
        assert {k: (r.page_id, r.payload_bytes) for k, r in got.items()} == {"warcinfo": (None, 11), "request": (None, 0), "response": (7, 3_000_000), "metadata": (None, 9)}
        assert bytes(got["response"].payload) == page[len(page) - 3_000_000 :] and got["warcinfo"].record_id == "urn:uuid:8f5e6c1a"
    for k, broken in enumerate([b"".join(records)[:-9], records[0] + records[2][:1_000_000] + b"!" + records[2][1_000_001:] + records[3], records[0] + b"junk" + records[3]]):
        (tmp_path / f"b{k}").mkdir()
        (tmp_path / f"b{k}" / "x.warc.gz").write_bytes(broken)
        kept = warc.read(spark, f"file://{tmp_path}/b{k}", payload=False, damaged="keep").collect()
        assert sum(r.record_type == warc.DAMAGED for r in kept) >= 1 and {r.record_type for r in kept} >= {"warcinfo"}
        with pytest.raises(Exception, match="Damaged|decoded|cut off|no member"):
            warc.read(spark, f"file://{tmp_path}/b{k}").collect()


def test_lines(spark):
    a = "the quick brown fox jumps over the lazy dog and runs away into the dark green forest again"
    near = a.replace("forest", "forests")
    rows = [(1, f"{a}\nshort one\nunique line number one has many other words in it", "", "", 0, ""), (2, f"Totally different opening words stand here today\n{near.upper()}", "", "", 0, ""),
            (3, f"{a}!\nshort one\n\n-", "", "", 0, ""), (4, None, "", "", 0, ""), (5, "", "", "", 0, ""), (3, f"{a}!\nshort one\n\n-", "", "", 0, ""), (None, a, "", "", 0, "")]
    docs = spark.createDataFrame(rows, DOC)
    got = line_dedup.without_repeats(docs).collect()
    texts = [(r.doc_id, r.text) for r in got]
    assert (None, a) in texts and (4, None) in texts and (5, "") in texts  # a null id comes first
    # blank lines stay; rows that are equal in doc_id and text lose the same lines
    assert (1, "short one\nunique line number one has many other words in it") in texts and texts.count((3, "\n-")) == 2
    assert sum(r.n_removed for r in line_dedup.report(docs).collect()) >= 3
    assert line_dedup.report(empty(spark)).count() == 0


def test_lines_repeated_exactly(spark):
    """Exact repeats go whatever the words: short ones, few, parted by tabs or not at all. Each text's own line stays."""
    lines = ["Released under the MIT License.", "a b c", "one\ttwo\tthree\tfour", "这是一行没有空格的文字", "これは日本語の行です", "copyrighted", "ok", "x"]
    own = ["zebra grazes quietly", "purple mountains", "seven tin soldiers"]
    rows = [(i, "\n".join([own[i], *lines, "", ""]), "", "", 0, "") for i in range(3)]
    got = {r.doc_id: r.text for r in line_dedup.without_repeats(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {0: rows[0][1], 1: f"{own[1]}\n\n", 2: f"{own[2]}\n\n"}


def all_pairs(texts: list[str], least: float = 0.8) -> dict[str, str]:
    """Groups of distinct normalised lines over all pairs of edit similarity ``least`` or more; knows nothing of blocks."""
    import numpy as np

    own = sorted({line.strip(" ").lower() for t in texts for line in t.split("\n")} - {""}, key=lambda x: (len(x), x))
    size = np.array([len(x) for x in own])
    bag = np.zeros((len(own), 256), dtype=np.int32)
    for k, x in enumerate(own):
        np.add.at(bag[k], [ord(c) % 256 for c in x], 1)
    a, b = [], []
    for k in range(len(own)):
        end = int(np.searchsorted(size, size[k] / least + 1e-9, side="right"))
        apart = bag[k + 1 : end] - bag[k]
        apart = np.maximum(np.maximum(apart, 0).sum(axis=1), np.maximum(-apart, 0).sum(axis=1))  # at most the edit distance
        at = np.flatnonzero(apart <= np.floor(size[k + 1 : end] * (1 - least) + 1e-9)) + k + 1
        a += [own[k]] * len(at)
        b += [own[j] for j in at]
    import pandas as pd

    # DuckDB's distance counts bytes, so the commonest other characters get ASCII ones that lower-cased lines don't have
    count: dict[str, int] = {}
    for x in own:
        for c in set(x):
            if ord(c) > 127:
                count[c] = count.get(c, 0) + 1
    free = [chr(c) for c in [*range(65, 91), *range(1, 9), *range(14, 32)]]
    stand = str.maketrans(dict(zip(sorted(count, key=count.get, reverse=True), free, strict=False)))
    short = {x: x.translate(stand) for x in own}
    plain = [(x, y, short[x], short[y]) for x, y in zip(a, b, strict=True) if short[x].isascii() and short[y].isascii()]
    asked = pd.DataFrame(plain, columns=["x", "y", "a", "b"], dtype=str)  # noqa: F841
    close = duckdb.sql("SELECT x, y FROM asked WHERE levenshtein(a, b) <= floor(greatest(length(a), length(b)) * 0.2 + 1e-9)").fetchall()
    for x, y in zip(a, b, strict=True):
        if not (short[x].isascii() and short[y].isascii()):
            d = list(range(len(y) + 1))
            for i, c in enumerate(x, 1):
                last, d[0] = d[0], i
                for j, e in enumerate(y, 1):
                    last, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, last + (c != e))
            if d[-1] <= int(max(len(x), len(y)) * (1 - least) + 1e-9):
                close.append((x, y))
    root = {x: x for x in own}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in close:
        root[find(x)] = find(y)
    return {x: find(x) for x in own}


def line_recall(spark, rows: list[tuple]) -> tuple[int, int, int]:
    """(lines that should go, those of them that went, lines that went though no line before is in their group)."""
    root = all_pairs([r[1] for r in rows])
    gone = {(r.doc_id, int(k)) for r in line_dedup.report(spark.createDataFrame(rows, DOC)).collect() for k in r.removed.split(",") if k}
    seen, want, wrong = set(), set(), 0
    for r in sorted(rows):
        for k, line in enumerate(r[1].split("\n")):
            if line := line.strip(" ").lower():
                if root[line] in seen:
                    want.add((r[0], k))
                elif (r[0], k) in gone:
                    wrong += 1
                seen.add(root[line])
    return len(want), len(want & gone), wrong


def test_lines_recall_against_all_pairs(spark):
    """Of the lines that plain edit similarity over all pairs would take out, nine tenths go at least, and no other."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("text is not null").select("doc_id", "text").collect()
    want, went, wrong = line_recall(spark, [(r.doc_id, r.text, "", "", 0, "") for r in docs])
    assert wrong == 0 and want > 200 and went >= 0.95 * want
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    lines = []
    for size in (3, 5, 8, 12, 20, 40, 90):
        for _ in range(6):
            base = " ".join(rng.choice(vocab) for _ in range(size))
            for _ in range(5):
                own = list(base)
                for _ in range(rng.randint(0, max(1, len(base) // 20))):
                    own[rng.randrange(len(own))] = rng.choice("abcdefgh ")
                lines.append("".join(own))
    for _ in range(6):
        base = [chr(0x4E00 + rng.randrange(3000)) for _ in range(rng.randint(20, 60))]
        for _ in range(5):
            own = list(base)
            own[rng.randrange(len(own))] = chr(0x4E00 + rng.randrange(3000))
            lines.append("".join(own))
    want, went, wrong = line_recall(spark, [(i, t, "", "", 0, "") for i, t in enumerate(lines)])
    assert wrong == 0 and want > 150 and went >= 0.9 * want, (want, went, wrong)


def test_long_lines_have_a_block_at_each_word(spark):
    """A line of many words has all runs of its sorted words as blocks, so changed words cost only the runs that they touch."""
    words = [f"word{k}x" for k in range(90)]
    one = spark.createDataFrame([(" ".join(words),), (" ".join(words[:24]),)], "norm string")
    assert [r.n for r in one.select(line_dedup.F.size(line_dedup.blocks(line_dedup.F.col("norm"))).alias("n")).collect()] == [87, 21]
    # a changed word takes the runs that hold it, and parts those that its successor falls into
    rng = random.Random(12)
    for changed in (1, 4, 10):
        own = list(words)
        for k in rng.sample(range(90), changed):
            own[k] = f"other{k}x"
        first, second = (set(r.b) for r in spark.createDataFrame([(" ".join(words),), (" ".join(own),)], "norm string").select(line_dedup.blocks(line_dedup.F.col("norm")).alias("b")).collect())
        assert len(first & second) >= 87 - 7 * changed


def test_blocks_are_shuffled_once_a_distinct_line(spark, monkeypatch):
    """Each distinct line has one number and its blocks once, in one long; blocks in two columns give the same candidates."""
    F = line_dedup.F
    docs = spark.createDataFrame([(1, f"{LINE_A}\n\n{LINE_B}", "", "", 0, ""), (2, f"{LINE_A} too\n{LINE_A}", "", "", 0, ""), (None, None, "", "", 0, ""), (None, LINE_B, "", "", 0, "")], DOC)
    rows = line_dedup.lines(docs).select("doc_id", "tag", "pos", F.xxhash64("norm").alias("h"))
    texts = line_dedup.texts_of(rows, docs)
    assert sorted(r.norm for r in texts.collect()) == sorted([LINE_A, f"{LINE_A} too", LINE_B]) and texts.select("line").distinct().count() == 3
    held = line_dedup.candidates(texts)
    assert held.count() > 0 and {r.norm for r in held.join(texts, "line").collect()} == {LINE_A, f"{LINE_A} too"}
    exchange = next(x for x in held._jdf.queryExecution().optimizedPlan().toString().splitlines() if "RepartitionByExpression" in x)
    assert "both" in exchange
    pairs = {(r.line, r.lead) for r in held.collect()}
    monkeypatch.setattr(line_dedup, "PACKED", -1)
    assert {(r.line, r.lead) for r in line_dedup.candidates(texts).collect()} == pairs


def test_lines_are_compared_in_parts(spark, monkeypatch):
    """Rows of blocks and pairs of texts are shuffled in parts of bounded bytes, all rows once; the lines that go are the same."""
    F, parted, table = line_dedup.F, line_dedup._parted, line_dedup._table
    ids = spark.range(1000).select("id", (F.col("id") % 7).alias("key"))
    parts = parted(ids, ids.agg(F.count("*") * 10), 3000, "key")
    assert len(parts) == 4 and sorted(r.id for p in parts for r in p.collect()) == list(range(1000)) and sum(len({r.key for r in p.collect()}) for p in parts) == 7
    assert len(parted(ids, ids.where("id < 0").agg(F.sum("id")), 0, "key")) == 1
    rng = random.Random(21)
    vocab = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 8))) for _ in range(60)]
    lines = []
    for size in (6, 9, 30):
        for _ in range(12):
            base = [rng.choice(vocab) for _ in range(size)]
            lines += [" ".join(base), " ".join([*base[:-1], "other"]), " ".join([*base[: size // 2], *(rng.choice(vocab) for _ in range(size // 2))])]
    docs = spark.createDataFrame([(k, t, "", "", 0, "") for k, t in enumerate(lines)], DOC)
    got = lambda: sorted((r.doc_id, r.n_removed, r.removed) for r in line_dedup.report(docs).collect())
    whole, met = got(), []
    monkeypatch.setattr(line_dedup, "_parted", lambda df, load, room, *keys: parted(df, load, (load.first()[0] or 0) // 3 + 1, *keys))
    monkeypatch.setattr(line_dedup, "_table", lambda df: met.append(table(df)) or met[-1])
    assert got() == whole and sum(n for _, n, _ in whole) >= 30
    assert 2 <= len([t for t in met if "sure" in t.columns]) <= 4


LINE_A, LINE_B = "the quick brown foxes jumped over twelve lazy sleeping hounds yesterday", "completely other words standing within another paragraph entirely without anything shared"


def test_sketches_rule_out_no_similar_lines(spark):
    """Edits that stay within the similarity never fail the sketch, astral characters included; most lines of other words do."""
    rng = random.Random(8)
    letters = "abcdefghijklmnop \U0001F600ü"
    say = lambda n: "".join(rng.choice(letters) for _ in range(n))
    pairs = [("a", "b"), ("ab", "ab"), ("x" * 129, "y" * 129)]
    for _ in range(150):
        own = list(base := say(rng.randint(2, 128)))
        for _ in range(len(own) // 5):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], [rng.choice(letters)], [own[k], rng.choice(letters)]])
            own = own or ["a"]
        pairs.append((base, "".join(own)))
    pairs += [(say(70), say(70)) for _ in range(100)]
    F = line_dedup.F
    both = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k long, x string, y string")
    side = lambda c: both.select(F.col("k").alias("h"), F.col(c).alias("norm"))
    sketch = lambda c: side(c).select("h", F.length("norm").alias("size")).join(line_dedup.sketched(side(c)), "h", "left")
    got = both.alias("p").join(sketch("x").alias("a"), F.col("a.h") == F.col("p.k")).join(sketch("y").alias("b"), F.col("b.h") == F.col("p.k"))
    got = {r.k: r for r in got.select("k", line_dedup.similar(F.col("x"), F.col("y")).alias("similar"), line_dedup.may_be_similar("a", "b").alias("may")).collect()}
    assert len(got) == len(pairs) and sum(r.similar for r in got.values()) > 100 and all(r.may for r in got.values() if r.similar)
    assert sum(not got[k].may for k in range(len(pairs) - 100, len(pairs))) > 50 and got[2].may


def test_very_long_lines(spark):
    """Lines over LONG characters are compared by words; a line of one long word is compared as a whole."""
    rng = random.Random(3)
    base = [f"w{rng.randrange(50000)}" for _ in range(12000)]
    near = [*base[:5000], "changed", *base[5001:]]
    other = [f"v{rng.randrange(50000)}" for _ in range(12000)]
    rows = [(i, t, "", "", 0, "") for i, t in enumerate([" ".join(base), " ".join(near), " ".join(other), "x" * 100_000, "x" * 100_000])]
    got = {r.doc_id: r.n_removed for r in line_dedup.report(spark.createDataFrame(rows, DOC)).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0, 4: 1}


def test_similar_is_edit_distance(spark):
    pairs = [("", ""), ("abc", "abd"), ("kitten sitting", "sitting kitten"), ("a" * 500, "a" * 450 + "b" * 50), ("x" + "ab" * 300, "ab" * 300), ("ab" * 300, "ba" * 300), ("abc" * 100, "abd" * 100)]
    got = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string").select("k", line_dedup.similar(line_dedup.F.col("a"), line_dedup.F.col("b")).alias("s")).collect()
    assert [r.s for r in sorted(got)] == [True, False, False, True, True, True, False]


ITEM = "item_id long, text string"


def test_tiles(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    bench = spark.createDataFrame([(7, words), (8, "short item"), (9, ""), (3, words), (None, "x"), (50, None), (3, words)], ITEM)
    texts = ["x Alpha, beta gamma delta EPSILON zeta eta theta iota kappa y", "zeta eta theta iota kappa and then alpha beta gamma delta epsilon", "alpha beta gamma delta epsilon alpha beta gamma delta epsilon",
             "a short item here", "", None, "x"]
    docs = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in enumerate(texts)] + [(None, texts[0], "", 0.0), (0, texts[0], "", 0.0), (0, "other", "", 0.0)], "doc_id long, text string, item_id string, coverage double")
    got = [(r.doc_id, r.leaked, r.coverage, r.item_id, r.n_tiles) for r in decontaminate.leaks(docs, bench).collect()]
    want = [(0, True, 1.0, 3, 1), (1, True, 1.0, 3, 2), (2, True, 0.5, 3, 1), (3, True, 1.0, 8, 1), (4, False, 0.0, None, 0), (5, False, 0.0, None, 0), (6, False, 0.0, None, 0),
            (None, True, 1.0, 3, 1), (0, True, 1.0, 3, 1), (0, False, 0.0, None, 0)]
    assert sorted(map(str, got)) == sorted(map(str, want))
    kept = decontaminate.without_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [0, 4, 5, 6]
    assert decontaminate.tiles([(0, 0, 3), (1, 1, 3), (5, 1, 3), (6, 2, 3), (7, 3, 3)], 8) == [(5, 1, 5)]
    names = bench.select(bench.item_id.cast("string").alias("item_id"), "text")
    assert {r.item_id for r in decontaminate.leaks(docs, names).collect()} == {"3", "8", None}
    assert decontaminate.leaks(docs, bench.where("false")).where("leaked").count() == 0 and decontaminate.leaks(docs.where("false"), bench).count() == 0


def covered_by_force(text: str, item: str, least: int = 5) -> float:
    """Greedy string tiling as it is defined: look through all places for the longest match of unmarked words, mark it, and again."""
    split = lambda t: re.findall("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    a, b = split(text), split(item)
    least, free_a, free_b = min(least, len(b)), [True] * len(a), [True] * len(b)
    while b:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < max(least, 1):
            break
        n, i, j = best
        free_a[i : i + n], free_b[j : j + n] = [False] * n, [False] * n
    return free_b.count(False) / len(b) if b else 0.0


def test_leaks_by_force(spark, monkeypatch):
    rng = random.Random(4)
    items = [(i, " ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 8, 30])))) for i in range(12)]
    rows = []
    for i in range(40):
        words = [f"v{rng.randrange(60)}" for _ in range(50)]
        for _ in range(rng.randrange(4)):
            own = items[rng.randrange(12)][1].split()
            x, at = rng.randrange(len(own)), rng.randrange(len(words))
            words[at:at] = own[x : x + rng.randint(1, 20)]
        rows.append((i, ", ".join(words)))
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, ITEM)
    want = {}
    for i, text in rows:
        share = [(covered_by_force(text, t), -k) for k, t in items]
        want[i] = round(max(share)[0], 6)
    got = {r.doc_id: r.coverage for r in decontaminate.leaks(docs, bench).collect()}
    assert got == want and sum(x >= 0.5 for x in want.values()) > 5
    monkeypatch.setattr(decontaminate, "CHUNK", 40)
    for size in (1, 3, 5):
        whole = decontaminate.word_hashes([rows[0][1].encode()])[0]
        pieces = [(f + k, g) for f, h in decontaminate.hashed_words(rows[0][1].encode(), size - 1) for k, g in enumerate(decontaminate.grams(h, size).tolist())]
        assert pieces == list(enumerate(decontaminate.grams(whole, size).tolist()))


PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a></li></ul></nav>
<div class="ad">Buy now</div><div id="cookie-notice"><p>We use cookies on this site to give you the best experience of all.</p></div><main><article><header><h1>A &amp; B</h1></header><p><b>Lead
 text<br>goes on here for a while so that there is some text.<p>Second   paragraph &eacute; with more words than markup, as articles have.</p>
<div class="advert">Advert</div><ul><li>Item one</li><li>Item two</li></ul><p>End.</p></article><section class="comments"><p>First comment is long enough to look like real text of an article.</p></section></main>
<aside><p>Related story with a long text in it, so that it looks like content.</p></aside><form><p>Subscribe</p></form><footer>&copy; x</footer></body></html>"""


def test_html():
    want = "A & B\nLead text goes on here for a while so that there is some text.\nSecond paragraph é with more words than markup, as articles have.\nItem one\nItem two\nEnd."
    assert html_text.extract(PAGE) == want
    assert html_text.extract("") == "" and html_text.extract("<nav>x</nav>") == ""
    assert html_text.extract("plain text") == "plain text"
    assert html_text.extract("<p>" * 3000 + "deep" + "</p>" * 10) == "deep"
    assert html_text.extract("<div>a<div>b</div>c</div>") == "a\nb\nc"


def test_html_wrappers_and_open_head():
    text = "<p>Lead text that goes on for a while so that there is more text than markup in it.</p><p>Another paragraph of the article with words enough to be its text.</p>"
    want = "Lead text that goes on for a while so that there is more text than markup in it.\nAnother paragraph of the article with words enough to be its text."
    menu = "<nav><a href=x>Home</a></nav><div class=sidebar><p>Side note.</p></div>"
    for page in (f"<html><head><title>T</title><meta charset=x><body>{menu}{text}</html>", f"<head><title>T</title><style>p{{}}</style>{menu}<div>{text}</div>",
                 f"<head><title>T</title><noscript><img src=x></noscript><body>{menu}<main>{text}</main>", f"<div class='has-sidebar'>{menu}<div>{text}</div></div>",
                 f"<body><div id='content-sidebar-wrap'><article>{text}</article>{menu}</div>"):
        assert html_text.extract(page) == want, page
    assert html_text.extract("<head>plain words") == "plain words"
    said = f"<div class='comments'><article>{text * 3}</article></div>"
    assert html_text.extract(f"<div>{text}</div>{said}") == want


LONG = "A long paragraph of the article that has many more characters than tags, as running text has."


@pytest.mark.parametrize(("page", "want"), [
    ("<p>hello<![foo[bar]]></p>", "hello"),
    ("<p>a <![CDATA[x]]> b <!x> c <?y z> d</p>", "a b c d"),
    (f"<article><h2>Head</h2><div class='body'><p>{LONG}</p></div><p>Closing line.</p></article>", f"Head\n{LONG}\nClosing line."),
    (f"<body><nav>Menu</nav><h1>Title</h1><div class='story'><p>{LONG}</p><p>{LONG}</p></div></body>", f"Title\n{LONG}\n{LONG}"),
    (f"<body><h1>Title</h1><article><p>{LONG}</p></article><p>Not of it.</p></body>", f"Title\n{LONG}"),
    (f"<article><p class='social-history'>Social.</p><div class='share-price'>Up.</div><p id='notice'>{LONG}</p></article>", f"Social.\nUp.\n{LONG}"),
    (f"<article><p>One <script>var x='</p>';</script>two <style>p{{}}</style>three. {LONG}</p></article>", f"One two three. {LONG}"),
    (f"<body><title>Late title</title><p>{LONG}</p></body>", LONG),
    (f"<form id='aspnetForm'><div class='main-nav'>Menu</div><div><p>{LONG}</p></div></form>", LONG),
    (f"<article><p>{LONG}</p><p class='ad'>Buy.</p></article><div class='site-footer'>Foot</div><div id='cookie-notice'>{LONG}</div>", LONG),
    (f"<p>{LONG}<button>Press</button> More.</p>", f"{LONG} More."),
])
def test_html_cases(page, want):
    assert html_text.extract(page) == want


def test_html_is_linear_in_depth():
    import time

    def took(page: str) -> float:
        began = time.process_time()
        html_text.extract(page)
        return time.process_time() - began

    for part in ("<div>a", "<b><p>x", "<div class=sidebar>a", "</b><i>x", "<a><li>x"):
        took(part * 500)
        assert took(part * 16000) < 40 * max(took(part * 1000), 0.01), part


def test_html_ratios_by_force():
    """Smoothing and clustering against plain sums over each block's neighbours and over all borders of two clusters."""
    import math

    import numpy as np

    rng = random.Random(2)
    for _ in range(20):
        ratio = [rng.choice([0.0, rng.random() * 5, 20 + rng.random() * 100]) for _ in range(rng.randint(1, 30))]
        reach = int(3 * html_text.SIGMA)
        kernel = [math.exp(-0.5 * (k / html_text.SIGMA) ** 2) for k in range(-reach, reach + 1)]
        want = [sum(kernel[j + reach] * ratio[min(max(i + j, 0), len(ratio) - 1)] for j in range(-reach, reach + 1)) / sum(kernel) for i in range(len(ratio))]
        got = html_text._smooth(np.array(ratio))
        assert np.allclose(got, want)
        cut = html_text._threshold(got)
        low, high = [x for x in want if x < cut], [x for x in want if x >= cut]
        assert high and cut <= sum(want) / len(want) + 1e-9 and (not low or max(low) < min(high))


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert language.words_of("Été² x_3 हिन्दी ٣") == ["été", "x", "हिन्दी"] and max(map(len, language.words_of("字" * 1000))) <= language.PIECE
    rows = [(0, "the and with", "en", "", 0, ""), (1, None, "fr", "", 0, ""), (2, "123 ! ²", "en", "", 0, ""), (None, "le la", None, "", 0, "")]
    small = spark.createDataFrame(rows, DOC)
    assert {(r.doc_id, r.lang_pred) for r in language.identify(small).collect()} >= {(1, "und"), (2, "und"), (0, "en")}
    assert language.identify(empty(spark)).count() == 0


def test_forward_backward_is_exact():
    import numpy as np

    rng = np.random.default_rng(0)
    model = language.Crf(["a", "b", "c"], rng.normal(size=(language.BUCKETS, 3)) * 0.3, rng.normal(size=(3, 3)))
    words = [[f"w{rng.integers(50)}" for _ in range(n)] for n in (1, 63, 64, 65, 200)]
    for own, got in zip(words, model.posteriors(words), strict=True):
        e, m = model.emissions(own), np.exp(model.move)
        alpha, beta = [np.full(3, 1 / 3) @ m * e[0]], [np.ones(3)]
        for x in e[1:]:
            alpha.append((alpha[-1] @ m) * x)
            alpha[-1] /= alpha[-1].sum()
        for x in e[:0:-1]:
            beta.append(m @ (x * beta[-1]))
            beta[-1] /= beta[-1].sum()
        p = np.array(alpha) * np.array(beta[::-1])
        assert np.allclose(got, p / p.sum(axis=1, keepdims=True), atol=1e-9)


def test_pipeline(spark, rows, tmp_path):
    import corpus_pipeline

    cols = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([r[:5] for r in rows], cols).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() <= docs.count(), name
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert got and rows[1][0] not in {r.doc_id for r in got}


def test_pipeline_clashing_columns_and_empty_tables(spark, rows, tmp_path):
    """Columns of the operators' own names pass through; those that the last stage adds give way. Empty tables give empty ones."""
    import corpus_pipeline

    extra = "coverage double, item_id long, n_tiles long, size long, source_size string, Target double, taken string, _lang string, _score int, _tag long, _h long, tag long, gone string, lead int, key string, component_id int"
    names = [x.split()[0] for x in extra.split(", ")]
    cols = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    own = [(*r[:5], 0.5, 1, 2, 3, "four", 5.0, "six", "seven", 8, 9, 10, 11, "twelve", 13, "fourteen", 15) for r in rows[:40]]
    spark.createDataFrame([(1, rows[1][1])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(own, cols).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.select(*names).distinct().collect()
        assert [tuple(r) for r in got] == [own[0][5:]], name
    mixed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert len({c.lower() for c in mixed.columns}) == len(mixed.columns) and mixed.select("_lang", "gone").distinct().count() == 1
    (tmp_path / "e").mkdir()
    docs.where("false").write.parquet(f"{tmp_path}/e/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/e/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/e").count() == 0
