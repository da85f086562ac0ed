"""Removal of repeated byte strings across documents: sampled anchors find candidate contexts, and a Burrows-Wheeler
transform of each bucket of contexts decides, by breadth-first backward extension up to the minimum length."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string, and of the grams of which each such string holds an anchor.
LENGTH, GRAM = 50, 16
#: Bytes of anchors or contexts that a bucket is meant to hold, and bytes of text handled at once.
BUCKET, CHUNK = 16 << 20, 1 << 20
#: What an anchor takes in a bucket, and the anchors in each byte of text.
ANCHOR_BYTES, DENSITY = 24, 0.06
#: Bytes next to a gram on the side where a string that holds the gram has more of its bytes.
SIDE = (LENGTH - GRAM) // 2
#: Bytes of contexts that are transformed at once, if no key alone has more.
TRANSFORM = 1 << 20
NO_ID = 2**63 - 1

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def _slide(x: np.ndarray, n: int, op) -> np.ndarray:
    """op over every n neighbours, by doubling."""
    done = 1
    while done < n:
        step = min(done, n - done)
        x = op(x[: len(x) - step], x[step:])
        done += step
    return x


def gram_hashes(buf: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A 64-bit hash of each 16 bytes, from two 8-byte words at every offset."""
    n = len(buf) - gram + 1
    word = np.ndarray((len(buf) - 7,), dtype="<u8", buffer=buf, strides=(1,))
    return _mix(word[:n] * _A + _mix(word[8 : 8 + n] * _C))


def anchors(buf: np.ndarray, owner_end: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that have the smallest hash in a string of LENGTH bytes of one text.

    Equal strings have their smallest grams at the same places, so two equal strings share an anchor.
    """
    per = LENGTH - GRAM + 1
    places, hashes = [], []
    if len(buf) < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = gram_hashes(buf)
    low = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)
    smallest = _slide(low, per, np.minimum)
    # strings that run over the end of their text have no smallest gram
    over = np.zeros(len(buf) + LENGTH + 1, dtype=np.int32)
    np.add.at(over, np.maximum(starts, owner_end - LENGTH + 1), 1)
    np.add.at(over, owner_end + 1, -1)
    smallest[np.cumsum(over)[: len(smallest)] > 0] = 0
    padded = np.concatenate([np.zeros(per - 1, np.uint32), smallest, np.zeros(per - 1, np.uint32)])
    best = _slide(padded, per, np.maximum)
    at = np.flatnonzero((best[: len(low)] == low) & (low > 0))
    return at, h[at]


class _Sums:
    """Karp-Rabin hashes of any stretch of a buffer."""

    up = down = np.ones(0, dtype=np.uint64)

    def __init__(self, buf: np.ndarray):
        n = len(buf) + 1
        if len(_Sums.up) < n:
            size = max(n, CHUNK + 4096)
            _Sums.up, _Sums.down = (np.cumprod(np.array([1] + [b] * (size - 1), dtype=np.uint64)) for b in (int(_A), pow(int(_A), -1, 1 << 64)))
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * _Sums.up[: len(buf)])])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[b] - self.sums[a]) * _Sums.down[a] + (b - a).astype(np.uint64) * _C)


#: An anchor: document, place, gram hash, hashes of the bytes next to it and of those farther off that its strings can hold.
ANCHOR = np.dtype([("doc", "<i8"), ("tag", "<u2"), ("pos", "<u4"), ("h", "<u8"), ("pre", "<u4"), ("post", "<u4"), ("far", "<u8")])


def anchor_rows(texts: list[bytes], docs: np.ndarray, tags: np.ndarray) -> np.ndarray:
    raw = b"\0".join(texts) + b"\0"
    buf = np.frombuffer(raw, dtype=np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    at, h = anchors(buf, ends, starts)
    d = np.searchsorted(ends, at)
    out = np.zeros(len(at), dtype=ANCHOR)
    sums, lo, hi = _Sums(buf), starts[d], ends[d]
    out["doc"], out["tag"], out["pos"], out["h"] = docs[d], tags[d], at - lo, h
    left, right = np.maximum(at - SIDE, lo), np.minimum(at + GRAM + SIDE, hi)
    out["pre"], out["post"] = sums.of(left, at) >> np.uint64(32), sums.of(at + GRAM, right) >> np.uint64(32)
    reach = LENGTH - GRAM
    out["far"] = _mix(sums.of(np.maximum(at - reach, lo), left) * _B + sums.of(right, np.minimum(at + LENGTH, hi)))
    return out


def _pack(rows: np.ndarray) -> bytes:
    """Columns one after the other, integers by byte plane, so that bytes alike stand together; rows are sorted by document."""
    new = np.concatenate([[True], (rows["doc"][1:] != rows["doc"][:-1]) | (rows["tag"][1:] != rows["tag"][:-1])])
    first = np.flatnonzero(new)
    counts = np.diff(np.concatenate([first, [len(rows)]])).astype("<u4")
    planes = lambda x: np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T).tobytes()
    head = np.array([len(rows), len(first)], dtype="<u4").tobytes()
    return b"".join([head, *(planes(rows[c][first]) for c in ("doc", "tag")), planes(counts), *(planes(rows[c]) for c in ("pos", "h", "pre", "post", "far"))])


def _unpack(data: bytes) -> np.ndarray:
    n, docs = np.frombuffer(data, dtype="<u4", count=2)
    at = 8

    def take(k: int, kind: str) -> np.ndarray:
        nonlocal at
        size = np.dtype(kind).itemsize
        got = np.frombuffer(data, dtype=np.uint8, count=k * size, offset=at).reshape(size, k).T
        at += k * size
        return np.ascontiguousarray(got).view(kind).reshape(-1)

    doc, tag, counts = take(docs, "<i8"), take(docs, "<u2"), take(docs, "<u4")
    out = np.zeros(n, dtype=ANCHOR)
    out["doc"], out["tag"] = np.repeat(doc, counts), np.repeat(tag, counts)
    for c in ("pos", "h", "pre", "post", "far"):
        out[c] = take(n, ANCHOR[c].str)
    return out


def _later_copies(rows: np.ndarray) -> np.ndarray:
    """True for anchors whose whole surroundings also stand in a document with a smaller id among these rows."""
    key = _mix(rows["h"] * _A + _mix(rows["far"] + (rows["pre"].astype(np.uint64) << np.uint64(32)) * _C + rows["post"] * _B))
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    low = np.minimum.reduceat(rows["doc"][order], np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(rows), dtype=bool)
    out[order] = rows["doc"][order] > low
    return out


def _shared(rows: np.ndarray, side: str) -> tuple[np.ndarray, np.ndarray]:
    """(key, whether several documents have it) of the gram with the bytes on one side."""
    key = _mix(rows["h"] * _C + rows[side].astype(np.uint64) * _A + np.uint64(side == "pre"))
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    own = rows["doc"][order]
    several = np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)
    out = np.zeros(len(rows), dtype=bool)
    out[order] = np.repeat(several, np.diff(np.concatenate([first, [len(rows)]])))
    return key, out


_RANGES = [("doc", pa.int64()), ("tag", pa.int32()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())]


def _found(doc: np.ndarray, tag: np.ndarray, key: np.ndarray | None, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
    """Rows for removed ranges (key null) or for contexts to compare under a key. hi may pass the text's end."""
    keys = pa.nulls(len(doc), pa.int64()) if key is None else pa.array(key.view(np.int64))
    return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(tag.astype(np.int32)), keys, pa.array(lo.astype(np.int64)), pa.array(hi.astype(np.int64))], names=[n for n, _ in _RANGES])


def _around(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(rows["pos"].astype(np.int64) - (LENGTH - GRAM), 0), rows["pos"].astype(np.int64) + LENGTH


def compare(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Ranges of one bucket's anchors that are known to repeat, and contexts that may."""
    if not len(rows):
        return
    later = _later_copies(rows)
    if later.any():
        yield _found(rows["doc"][later], rows["tag"][later], None, *_around(rows[later]))
    rows = rows[~later]
    for side in ("pre", "post"):
        key, several = _shared(rows, side)
        if several.any():
            # a string that holds the gram has SIDE bytes or more of its own on one side; only such strings count here
            at = rows["pos"][several].astype(np.int64)
            lo, hi = (at - (LENGTH - GRAM), at + LENGTH - SIDE) if side == "pre" else (at - SIDE, at + LENGTH)
            yield _found(rows["doc"][several], rows["tag"][several], key[several], np.maximum(lo, 0), hi)


def repeated(text: np.ndarray, prev: np.ndarray, psi: np.ndarray, length: int) -> np.ndarray:
    """Rows of a Burrows-Wheeler matrix whose first ``length`` symbols equal the row's before, by interval expansion.

    prev: the transform, the symbol before each row's suffix. Intervals of a common prefix are widened to the left by
    one symbol at a time, all of one length together: psi leads from a row to that of its suffix without the first
    symbol, so the rows that part at ``k + 1`` are those that differ in that symbol or whose followers part at ``k``.
    A row that parts at k has the common prefix k with the row before; expansion stops at ``length``.
    """
    first = np.sort(prev, kind="stable")
    psi = psi.astype(np.int32)
    edge = np.concatenate([[True], first[1:] != first[:-1]])
    parts = edge
    for _ in range(length - 1):
        interval = np.cumsum(parts, dtype=np.int32)[psi]
        parts = edge | np.concatenate([[True], interval[1:] != interval[:-1]])
    return ~parts


def transform(text: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffix order, Burrows-Wheeler transform, psi) of a cyclic text, suffixes sorted by at least ``length`` symbols."""
    n, many = len(text), 63 // int(text.max(initial=1)).bit_length()
    rank = np.zeros(n, dtype=np.int64)
    for k in range(many):
        rank = (rank << int(text.max(initial=1)).bit_length()) | np.roll(text, -k)
    done = many
    while True:
        order = np.argsort(rank)
        if done >= length:
            break
        dense = np.cumsum(np.concatenate([[0], rank[order][1:] != rank[order][:-1]]))
        rank[order] = dense
        if dense[-1] == n - 1:
            break
        rank, done = rank * n + np.roll(rank, -done), done * 2
    prev = np.roll(text, 1)[order]
    return order, prev, np.argsort(prev, kind="stable")


def _distinct(key: np.ndarray, doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, pieces: list[bytes]) -> tuple[np.ndarray, pa.RecordBatch | None]:
    """The contexts to transform, sorted by key: of equal ones under a key those of the smallest document. The others repeat."""
    low: dict[tuple[int, bytes], int] = {}
    for k, d, p in zip(key.tolist(), doc.tolist(), pieces, strict=True):
        if low.get((k, p), NO_ID) >= d:
            low[k, p] = d
    later = np.array([low[k, p] < d for k, d, p in zip(key.tolist(), doc.tolist(), pieces, strict=True)], dtype=bool)
    kept = np.flatnonzero(~later)
    # a key that is left with one context has nothing to compare
    _, which, n = np.unique(key[kept], return_inverse=True, return_counts=True)
    kept = kept[n[which] > 1]
    gone = None
    if later.any():
        size = np.array([len(p) for p in pieces])[later]
        at = lo[later][size >= LENGTH]
        gone = _found(doc[later][size >= LENGTH], tag[later][size >= LENGTH], None, at, at + size[size >= LENGTH])
    return kept[np.argsort(key[kept], kind="stable")], gone


def settle(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, pieces: list[bytes]) -> pa.RecordBatch | None:
    """Removed ranges among contexts: strings of LENGTH bytes that another context of a smaller document also holds."""
    sizes = np.array([len(p) + 1 for p in pieces])
    text = np.zeros(int(sizes.sum()), dtype=np.int16)
    owner = np.repeat(np.arange(len(pieces)), sizes)
    starts = np.cumsum(sizes) - sizes
    inside = np.arange(len(text)) - starts[owner]
    data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    text[inside < sizes[owner] - 1] = data.astype(np.int16) + 1  # 0 ends a context
    order, prev, psi = transform(text)
    same = repeated(text, prev, psi, LENGTH)
    whole = inside[order] + LENGTH < sizes[owner[order]]
    group = np.cumsum(~same) - 1
    d = np.where(whole, doc[owner[order]], NO_ID)
    low = np.minimum.reduceat(d, np.flatnonzero(~same))[group]
    hit = whole & (d > low)
    if not hit.any():
        return None
    at, own = inside[order][hit] + lo[owner[order]][hit], owner[order][hit]
    return _found(doc[own], tag[own], None, at, at + LENGTH)


def _merged(ranges: list[tuple[int, int]], size: int) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        b = min(b, size)
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        elif a < b:
            out.append((a, b))
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id; the largest one for null), tag (16 bits of the text's hash, to tell rows with one id apart) and the text's bytes."""
    rows = docs.select("doc_id", common.text_or_empty().alias("text"))
    return rows.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc"), F.xxhash64("text").bitwiseAND(F.lit(0xFFFF)).cast("int").alias("tag"), F.encode("text", "UTF-8").alias("data"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list]:
    """The rows' data, one list for each bucket of a partition that is sorted by bucket."""
    bucket, held = None, []
    for b in batches:
        for k, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if k != bucket and held:
                yield held
                held = []
            bucket = k
            held.append(data)
    if held:
        yield held


def repeated_ranges(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents with doc, tag and data; (doc, tag, lo, hi) byte ranges that repeat strings of smaller documents)."""
    keyed = _keyed(docs)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(32, int(size * DENSITY * ANCHOR_BYTES) // BUCKET)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, doc, tag = b.column("data").to_pylist(), b.column("doc").to_numpy(), b.column("tag").to_numpy().astype(np.uint16)
            k = 0
            while k < len(data):
                e, held = k, 0
                while e < len(data) and (e == k or held + len(data[e]) < CHUNK):
                    held += len(data[e]) + 1
                    e += 1
                rows = anchor_rows(data[k:e], doc[k:e], tag[k:e])
                k = e
                if not len(rows):
                    continue
                later = _later_copies(rows)
                bucket = ((rows["h"] >> np.uint64(33)) % np.uint64(n)).astype(np.int32)
                bucket[later] = -1
                order = np.argsort(bucket, kind="stable")
                cuts = np.flatnonzero(np.diff(bucket[order], prepend=-2))
                for x, y in zip(cuts, [*cuts[1:], len(order)], strict=True):
                    part, to = rows[order[x:y]], int(bucket[order[x]])
                    if to < 0:  # known to repeat: the ranges travel merged, a row for each document
                        for own in np.split(part, np.flatnonzero(np.diff(part["doc"]) | np.diff(part["tag"].astype(np.int32))) + 1):
                            got = np.array(_merged(list(zip(*(v.tolist() for v in _around(own)), strict=True)), 1 << 62), dtype="<i8")
                            head = np.array([own["doc"][0], own["tag"][0]], dtype="<i8").tobytes()
                            yield pa.RecordBatch.from_arrays([pa.array([int(own["h"][0] % np.uint64(n))], pa.int32()), pa.array([b"r" + head + got.tobytes()], pa.binary())], names=["bucket", "data"])
                    else:
                        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), pa.array([b"a" + _pack(part)], pa.binary())], names=["bucket", "data"])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            known = [np.frombuffer(x, dtype="<i8", offset=1) for x in held if x[:1] == b"r"]
            if known:
                count = [len(x) // 2 - 1 for x in known]
                both = np.concatenate([x[2:].reshape(-1, 2) for x in known])
                yield _found(np.repeat([x[0] for x in known], count), np.repeat([x[1] for x in known], count), None, both[:, 0], both[:, 1])
            yield from compare(np.concatenate([np.zeros(0, ANCHOR), *(_unpack(x[1:]) for x in held if x[:1] == b"a")]))

    kind = "doc long, tag int, key long, lo long, hi long"
    sent = keyed.select("doc", "tag", "data").mapInArrow(send, "bucket int, data binary")
    first = common.saved_table(sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(receive, kind))

    contexts = first.where("key is not null")
    m = max(32, contexts.count() * 2 * LENGTH // BUCKET)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[int, list] = {}
            for r in b.to_pylist():
                for x in r["at"]:
                    out.setdefault(x["key"] % m, []).append((x["key"], r["doc"], r["tag"], x["lo"], r["data"][x["lo"] : x["hi"]]))
            keys = list(out)
            blobs = []
            for k in keys:
                key, doc, tag, lo, piece = zip(*out[k], strict=True)
                head = np.array([key, doc, tag, lo, [len(p) for p in piece]], dtype="<i8")
                blobs.append(np.array([len(key)], dtype="<i8").tobytes() + head.tobytes() + b"".join(piece))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "data"])

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _groups(batches):
            heads, pieces = [], []
            for x in held:
                count = int(np.frombuffer(x, dtype="<i8", count=1)[0])
                heads.append(np.frombuffer(x, dtype="<i8", count=5 * count, offset=8).reshape(5, count))
                at = 8 + 40 * count
                for size in heads[-1][4].tolist():
                    pieces.append(x[at : at + size])
                    at += size
            key, doc, tag, lo, _ = np.concatenate(heads, axis=1)
            order, gone = _distinct(key, doc, tag, lo, pieces)
            if gone is not None:
                yield gone
            if not len(order):
                continue
            edges = np.flatnonzero(np.diff(key[order], prepend=key[order[:1]] - 1))
            begin = total = 0
            for x, y in zip(edges, [*edges[1:], len(order)], strict=True):
                if total and total + (y - x) * 2 * LENGTH > TRANSFORM:
                    if (got := settle(doc[o := order[begin:x]], tag[o], lo[o], [pieces[i] for i in o])) is not None:
                        yield got
                    begin, total = x, 0
                total += (y - x) * 2 * LENGTH
            if (got := settle(doc[o := order[begin:]], tag[o], lo[o], [pieces[i] for i in o])) is not None:
                yield got

    asked = contexts.groupBy("doc", "tag").agg(F.collect_list(F.struct("key", "lo", "hi")).alias("at"))
    pieces = keyed.join(asked, ["doc", "tag"]).mapInArrow(cut, "bucket int, data binary")
    second = pieces.repartition(m, "bucket").sortWithinPartitions("bucket").mapInArrow(decide, kind)
    return keyed, first.where("key is null").union(second).select("doc", "tag", "lo", "hi")


def removals(docs: DataFrame) -> DataFrame:
    """One row a document: bytes, bytes removed, maximal removed runs and the SHA-256 of what is left.

    Null text is empty; a document without id counts as larger than all others; rows with one doc_id never remove
    bytes from each other, and equal ones have equal results. Only doc_id and text are read, so other columns of any
    name don't matter; an empty table gives an empty one. A very long text is one row of a task.
    """
    keyed, ranges = repeated_ranges(docs)
    own = ranges.groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("at"))
    both = keyed.join(own, ["doc", "tag"], "left").select("doc", "data", "at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for doc, data, at in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = _merged([(x["lo"], x["hi"]) for x in at or ()], len(data))
                kept, last = hashlib.sha256(), 0
                for x, y in spans:
                    kept.update(data[last:x])
                    last = y
                kept.update(data[last:])
                rows.append((None if doc == NO_ID else doc, len(data), sum(y - x for x, y in spans), len(spans), kept.hexdigest()))
            cols = zip(*rows, strict=True) if rows else [()] * 5
            kinds = [pa.int64()] * 4 + [pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return both.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
