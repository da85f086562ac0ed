"""SimHash near-duplicates by segment popcounts: a grid over bit counts finds candidates, midpoints verify them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

SHINGLE, SEED = 3, 42
#: 64 bits in 16 segments of 4 bits: a popcount vector packs into one long, a hex digit for each segment.
SEGMENTS, WIDTH = 16, 4
#: Hashes whose bits are counted at once, to bound memory for very long texts.
BLOCK = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash: a bit is 1 if set in over half the XXH64 of the word shingles, repeats included."""
    # bytes.lower() and bytes.split() know ASCII only, which is what is asked for
    got = text.encode("utf-8", "surrogatepass").lower().split()
    if not got:
        return 0
    line = b" ".join(got)
    ends = np.cumsum([len(w) + 1 for w in got]).tolist()
    starts = [0, *ends[: len(got) - shingle]] if len(got) > shingle else [0]
    stops = ends[shingle - 1 :] if len(got) > shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        h = np.array([digest(line[a : b - 1], SEED) for a, b in zip(starts[k : k + BLOCK], stops[k : k + BLOCK], strict=True)], dtype="<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (counts * 2 > len(starts)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<i8")[0])


def with_fingerprint(docs: DataFrame, column: str = "text", name: str = "_fp") -> DataFrame:
    return common.map_texts(docs, column, lambda texts: [pa.array([fingerprint(t) for t in texts], pa.int64())], [T.StructField(name, T.LongType())])


def popcounts(fp: Column) -> Column:
    """The bit count of each 4-bit segment, in the segment's own hex digit."""
    ones = F.lit(0x1111111111111111)
    # sums stay below 5 in each digit, so that the sign bit is never reached
    return sum((F.shiftrightunsigned(fp, k).bitwiseAND(ones) for k in range(1, WIDTH)), fp.bitwiseAND(ones))


def cells(fp: Column) -> Column:
    """(cell, segment, step) of the grid cells at Manhattan distance 0 or 1 from the fingerprint's popcount vector.

    Two vectors at distance 2 or less share such a cell, and the Manhattan distance of popcount vectors never
    exceeds the Hamming distance.
    """
    v = popcounts(fp)
    own = F.array(F.struct(v.alias("cell"), F.lit(-1).alias("seg"), F.lit(0).alias("step")))

    def moved(i: int, up: int) -> Column:
        # a segment can gain a bit if it has a 0 and lose one if it has a 1
        digit = F.shiftright(fp, i * WIDTH).bitwiseAND(F.lit(15))
        can = digit != (15 if up > 0 else 0)
        one = F.shiftleft(F.lit(1).cast("long"), i * WIDTH)
        return F.when(can, F.struct((v + one if up > 0 else v - one).alias("cell"), F.lit(i).alias("seg"), F.lit(up).alias("step")))

    steps = F.array_compact(F.array(*[moved(i, up) for i in range(SEGMENTS) for up in (1, -1)]))
    return F.concat(own, steps)


def midpoints(fp: Column, seg: Column, step: Column) -> Column:
    """The fingerprints at Hamming distance 0 or 1 whose popcount vector is the cell reached by that step."""
    flips = F.transform(F.sequence(F.lit(0), F.lit(WIDTH - 1)), lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), (seg * WIDTH + b).cast("int")))
    held = F.when(step > 0, F.lit(0)).otherwise(F.lit(1))
    near = F.filter(flips, lambda m: F.when(fp.bitwiseAND(m) != 0, 1).otherwise(0) == held)
    return F.when(seg < 0, F.array(fp)).otherwise(F.transform(near, lambda m: fp.bitwiseXOR(m)))


def near_groups(fps: DataFrame) -> DataFrame:
    """(_fp, component_id) for rows (doc_id, _fp): the smallest doc_id over chains of fingerprints 2 or fewer bits apart.

    Equal fingerprints are grouped first. A grid cell that only one fingerprint reaches yields no pair. In the other
    cells, two fingerprints are 2 or fewer bits apart exactly if they share a midpoint there (a fingerprint one bit
    or less from both); each is linked with the smallest one of the midpoint, so the links are as many as the
    fingerprints' midpoints, never the pairs of a group. Rows with one doc_id count as one document; a group with null
    doc_ids alone has a null component.
    """
    groups = common.saved(fps.groupBy("_fp").agg(F.min("doc_id").alias("id")))
    reached = groups.where("id is not null").select("_fp", "id", F.explode(cells(F.col("_fp"))).alias("c")).select("_fp", "id", "c.*")
    shared = reached.groupBy("cell").agg(F.count("*").alias("n")).where("n > 1").select("cell")
    near = reached.join(shared, "cell").select("id", F.explode(midpoints(F.col("_fp"), F.col("seg"), F.col("step"))).alias("mid"))
    near = common.saved(near)
    first = near.groupBy("mid").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("mid", "low")
    edges = near.join(first, "mid").where("id <> low").select(F.col("id").alias("u"), F.col("low").alias("v"))
    root = common.components(edges)
    return groups.join(root, groups.id == root.node, "left").select("_fp", F.coalesce("root", "id").alias("component_id"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document; null and empty texts have fingerprint 0.

    Repeated rows each have a row. Only doc_id and text are read, so other columns of any name don't matter; an empty
    table gives an empty one. A very long text is hashed BLOCK shingles at a time.
    """
    fps = common.saved(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "_fp"))
    out = fps.join(near_groups(fps), "_fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component; of rows that are equal in doc_id and text, one stays.

    Rows that share the component's smallest doc_id but differ in text are told apart by the text, of which the first
    in code-point order stays. Documents without a doc_id are never dropped for another.
    """
    fps = common.saved(with_fingerprint(docs.select("doc_id", "text")).select("doc_id", "_fp", F.xxhash64("text").alias("_t")))
    ids = near_groups(fps.select("doc_id", "_fp")).where("component_id is not null").select("component_id").distinct()
    kept = docs.join(ids, docs.doc_id == ids.component_id, "left_semi").union(docs.where("doc_id is null"))
    return common.one_per_id(kept)
