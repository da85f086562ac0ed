"""Benchmark decontamination by greedy string tiling over word sequences."""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Words of a seed and of the shortest tile; share of an item's words that tiles must cover.
WORDS, COVERAGE = 5, 0.5
#: Bits of the filter that keeps seeds of the documents that no item has from being shuffled, and bits of one of its parts.
FILTER, PART = 1 << 22, 1 << 15
#: Bytes of text that are hashed at once.
CHUNK = 1 << 21

_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1


def _byte_table() -> np.ndarray:
    """Lower-cases ASCII letters and maps what parts words to 0; digits and bytes of non-ASCII characters stay."""
    t = np.zeros(256, dtype=np.uint64)
    for b in range(256):
        if b >= 128 or chr(b).isalnum():
            t[b] = ord(chr(b).lower()) if b < 128 else b
    return t


_BYTES = _byte_table()


class _Powers:
    """Powers of the Karp-Rabin base and of its inverse modulo 2**64, as long as was needed so far."""

    up = down = np.ones(0, dtype=np.uint64)

    @classmethod
    def get(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, CHUNK + 4096)
            cls.up, cls.down = (np.cumprod(np.array([1] + [b] * (size - 1), dtype=np.uint64)) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
        return cls.up, cls.down


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Karp-Rabin hash of every word of the texts, and for each text where its words start (one more entry at the end)."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    up, down = _Powers.get(len(buf) + 1)
    b = _BYTES[buf]
    sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(b * up[: len(b)])])
    inside = np.concatenate([[False], b != 0, [False]])
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    starts, stops = turns[::2], turns[1::2]
    h = (sums[stops] - sums[starts]) * down[starts]
    h ^= h >> np.uint64(29)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.concatenate([[0], np.searchsorted(starts, ends)])


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hash of each n words."""
    if len(h) < n:
        return h[:0]
    g = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for k in range(n):
        g = g * np.uint64(_STEP) + h[k : len(h) - n + 1 + k]
    return g ^ (g >> np.uint64(31))


_PARTING = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def hashed_words(text: bytes, carry: int = WORDS - 1) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first word, word hashes) of overlapping pieces of a text, which are cut between words.

    Neighbouring pieces share ``carry`` words, so each run of carry + 1 words lies in one piece.
    """
    at, first, kept = 0, 0, np.zeros(0, dtype=np.uint64)
    while at < len(text) or not first and not len(kept):
        end = len(text)
        if end - at > CHUNK and (cut := _PARTING.search(text, at + CHUNK)):
            end = cut.start()
        own = np.concatenate([kept, word_hashes([text[at:end]])[0]])
        yield first, own
        kept = own[max(0, len(own) - carry) :] if carry else own[:0]
        first, at = first + len(own) - len(kept), end
        if at >= len(text):
            return


def tiles(seeds: list[tuple[int, int, int]], item_words: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in text, place in item, words), longest first, never overlapping.

    Seeds that follow each other on a diagonal form maximal matches. The longest match is marked; one that marks cut
    into is split into its free parts, which compete again while they have a seed's length.
    """
    runs, last = [], {}
    for i, j, m in sorted(seeds):
        if (run := last.get((i - j, m))) and run[1] + run[0] - m + 1 == i:
            run[0] += 1
        else:
            runs.append(run := [m, i, j, m])
            last[i - j, m] = run
    heap = [(-n, i, j, m) for n, i, j, m in runs]
    heapq.heapify(heap)
    in_text, in_item, out = set(), np.zeros(item_words, dtype=bool), []
    while heap:
        n, i, j, m = heapq.heappop(heap)
        free = [not in_item[j + k] and i + k not in in_text for k in range(-n)]
        if all(free):
            in_text.update(range(i, i - n))
            in_item[j : j - n] = True
            out.append((i, j, -n))
            continue
        k = 0
        while k < -n:
            e = k
            while e < -n and free[e]:
                e += 1
            if e - k >= m:
                heapq.heappush(heap, (k - e, i + k, j + k, m))
            k = max(e, k + 1)
    return out


def _seeds(bench: DataFrame, words: int) -> DataFrame:
    """(g, m, item_id, j, size): the seeds of each item, runs of ``words`` words (of all words for shorter items), with their places."""
    kind = bench.schema["item_id"].dataType
    schema = T.StructType([T.StructField("g", T.LongType()), T.StructField("m", T.IntegerType()), T.StructField("item_id", kind), T.StructField("j", T.LongType()), T.StructField("size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, text in enumerate(b.column(1).to_pylist()):
                h = word_hashes([(text or "").encode("utf-8", "surrogatepass")])[0]
                if len(h):
                    g = grams(h, m := min(words, len(h)))
                    yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(np.full(len(g), m, dtype=np.int32)), b.column(0).take(pa.array([k] * len(g), pa.int64())), pa.array(np.arange(len(g))), pa.array(np.full(len(g), len(h)))], names=schema.names)

    return bench.where("item_id is not null").select("item_id", "text").distinct().mapInArrow(run, schema)


def _filter(seeds: DataFrame) -> np.ndarray:
    """A bit for each remainder of a seed's hash; FILTER / 8 bytes, whatever the benchmark's size."""
    place = F.pmod(F.col("g"), F.lit(FILTER))
    parts = seeds.groupBy(F.floor(place / PART).alias("part")).agg(F.bitmap_construct_agg(F.pmod(place, F.lit(PART))).alias("bits")).collect()
    out = np.zeros((FILTER // PART, PART // 8), dtype=np.uint8)
    for r in parts:
        out[r.part] = np.frombuffer(bytes(r.bits), dtype=np.uint8)
    return np.unpackbits(out.reshape(-1), bitorder="little").astype(bool)


def _hits(docs: DataFrame, seeds: DataFrame, words: int) -> DataFrame:
    """(doc_id, tag, g, m, i): the runs of words of the documents that may be seeds of an item, with their places."""
    sizes = sorted(r.m for r in seeds.select("m").distinct().collect())  # WORDS values at most
    shared = docs.sparkSession.sparkContext.broadcast(_filter(seeds)) if sizes else None
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, k) for n, k in (("tag", T.LongType()), ("g", T.LongType()), ("m", T.IntegerType()), ("i", T.LongType())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, common.SLICE) for k in range(0, whole.num_rows, common.SLICE)):
                row, g, m, i = [], [], [], []
                for k, text in enumerate(b.column(2).to_pylist()):
                    for size in sizes:
                        for first, h in hashed_words((text or "").encode("utf-8", "surrogatepass"), size - 1):
                            own = grams(h, size)
                            at = np.flatnonzero(shared.value[(own % np.uint64(FILTER)).astype(np.int64)])
                            row.append(np.full(len(at), k)), g.append(own[at].view(np.int64)), m.append(np.full(len(at), size, dtype=np.int32)), i.append(at + first)
                cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.zeros(0, kind)
                take = pa.array(cat(row, np.int64))
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(cat(g, np.int64)), pa.array(cat(m, np.int32)), pa.array(cat(i, np.int64))], names=schema.names)

    return docs.select("doc_id", _tag().alias("tag"), "text").mapInArrow(run, schema)


def _tag(text: Column | None = None) -> Column:
    """What tells rows with one doc_id apart; null and empty texts are the same."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def coverages(docs: DataFrame, bench: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tag, coverage, item_id, n_tiles) of the item that tiles cover most (ties: smallest id), for documents that share a seed with one.

    Seeds are joined on the hashes of their words; only those that pass a filter of fixed size leave the scan of the
    documents. Each pair of a document and an item is tiled on its own. An item of fewer than ``words`` words is one
    seed; items without a word or id are never found. Rows that are equal in doc_id and text count once.
    """
    seeds = common.saved_table(_seeds(bench, words))
    n = seeds.count()
    hits = _hits(docs, seeds, words).join(common.broadcast_if_small(seeds, n, 1_000_000), ["g", "m"])
    # seeds that several rows of one doc_id and text give are the same
    pairs = hits.groupBy("doc_id", "tag", "item_id", "size").agg(F.collect_set(F.struct("i", "j", "m")).alias("seeds"))
    schema = T.StructType([pairs.schema["doc_id"], pairs.schema["tag"], pairs.schema["item_id"], T.StructField("coverage", T.DoubleType()), T.StructField("n_tiles", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for size, own in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                found = tiles([(x["i"], x["j"], x["m"]) for x in own], size)
                got.append((sum(k for _, _, k in found) / size, len(found)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([x for x, _ in got], pa.float64()), pa.array([x for _, x in got], pa.int64())], names=schema.names)

    tiled = pairs.mapInArrow(run, schema)
    best = tiled.groupBy("doc_id", "tag").agg(F.min(F.struct((-F.col("coverage")).alias("less"), "item_id", "n_tiles")).alias("b"))
    return best.select("doc_id", "tag", (-F.col("b.less")).alias("coverage"), F.col("b.item_id").alias("item_id"), F.col("b.n_tiles").alias("n_tiles"))


def _same(d: str, f: str) -> Column:
    return F.col(f"{d}.doc_id").eqNullSafe(F.col(f"{f}.doc_id")) & (_tag(F.col(f"{d}.text")) == F.col(f"{f}.tag"))


def leaks(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row a document: doc_id, leaked, coverage (0 to 1), item_id and n_tiles; null or empty texts and an empty benchmark give coverage 0."""
    found = common.saved_table(coverages(docs.select("doc_id", "text"), bench))
    got = docs.select("doc_id", "text").alias("d").join(common.broadcast_if_small(found).alias("f"), _same("d", "f"), "left")
    share = F.coalesce(F.col("f.coverage"), F.lit(0.0))
    return got.select("d.doc_id", (share >= coverage).alias("leaked"), F.round(share, 6).alias("coverage"), F.col("f.item_id").alias("item_id"), F.coalesce("f.n_tiles", F.lit(0)).cast("long").alias("n_tiles"))


def without_leaks(docs: DataFrame, bench: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """The documents of which no item is covered by ``coverage`` or more; their columns, of any name, are as before."""
    found = common.saved_table(coverages(docs.select("doc_id", "text"), bench).where(F.col("coverage") >= coverage).select("doc_id", "tag"))
    return docs.alias("d").join(common.broadcast_if_small(found).alias("f"), _same("d", "f"), "left_anti")
