"""MinHash near-duplicates by bottom-k sketches of one hash function, with every link confirmed on whole shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Words of a shingle, and the similarity of linked documents as 100 * intersection >= SIMILARITY * union.
SHINGLE, SIMILARITY, SEED = 2, 80, 42
#: Hash values that a sketch retains at most, and how many of the smallest values of a union two linked documents share at least.
#: Of 64 values drawn from the union of two sets of similarity 0.8, fewer than 25 are shared with a probability of 1.5e-13.
RETAINED, SHARED = 64, 25
#: Inverted lists are kept by so many neighbouring retained values; sets of four and five shingles (SMALL) share two at times.
#: Of 64 values of such a union less than RUNS lists are shared with a probability of 2e-9; sets of n shingles that are
#: retained whole share 0.4 n - 2 at least.
NEIGHBOURS, SMALL, RUNS = 3, 5, 2
#: The commonest shingles of documents whose links are still open, which are put last in their order; it bounds what is broadcast.
COMMON = 200_000
#: Lists with several sets, up to which they are broadcast to find their sets.
LISTS = 1_000_000


def _line(text: bytes, words: int) -> tuple[bytes, list[int], list[int]]:
    """The words of a text, lower-cased (A-Z) and joined by spaces, with the starts and ends of its shingles."""
    # bytes.lower() and bytes.split() know ASCII only, which is what is asked for
    own = text.lower().split()
    ends = np.cumsum([len(w) + 1 for w in own]).tolist()
    if len(own) <= words:
        return b" ".join(own), [0] * bool(own), ends[-1:]
    return b" ".join(own), [0, *ends[:-words]], ends[words - 1 :]


def shingles(text: bytes, words: int = SHINGLE) -> set[bytes]:
    """The distinct shingles; a text of fewer words has its whole sequence, one without words none."""
    line, starts, ends = _line(text, words)
    return {line[a : b - 1] for a, b in zip(starts, ends, strict=True)}


def hashes(text: bytes, words: int = SHINGLE) -> np.ndarray:
    """The distinct hashes of the shingles in ascending order; the first RETAINED are the sketch."""
    line, starts, ends = _line(text, words)
    digest = xxhash.xxh64_intdigest
    got = np.fromiter((digest(line[a : b - 1], SEED) for a, b in zip(starts, ends, strict=True)), dtype="<u8", count=len(starts))
    return np.unique(got.view("<i8"))


def sketched(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, n, k1, k2, sketch) a document: its text's digest, the number of its shingles, 128 bits of its set, and the sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, common.SLICE) for whole in batches for k in range(0, whole.num_rows, common.SLICE)):
            own = [hashes(t, words) for t in b.column(2).to_pylist()]
            keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in own), dtype="<i8").reshape(-1, 2)
            ends = np.cumsum([0] + [min(len(s), RETAINED) for s in own])
            flat = np.concatenate([s[:RETAINED] for s in own])
            sketch = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int64()))
            more = [pa.array([len(s) for s in own], pa.int64()), pa.array(keys[:, 0].copy()), pa.array(keys[:, 1].copy()), sketch]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *more], names=["doc_id", "digest", "n", "k1", "k2", "sketch"])

    text = F.coalesce("text", F.lit(""))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.md5(text).alias("digest"), F.encode(text, "utf-8")).mapInArrow(run, f"doc_id {kind}, digest string, n long, k1 long, k2 long, sketch array<long>")


def postings(groups: DataFrame) -> DataFrame:
    """(key, node, lead, weight): inverted lists of neighbouring retained values with several sets, and each list's leading node.

    A single value of a common shingle would be in very many sketches; that the next retained values are the same ones
    too needs similar sets. A list is led by the node whose lists are the longest, for it is the one that the others are
    copies of, if there is one: copies with few changes each link with it more surely than with each other.
    """
    run = lambda size: f"transform(sequence(1, greatest(1, size(sketch) - {size - 1})), k -> xxhash64({', '.join(f'sketch[k + {i - 1}]' for i in range(size))}))"
    keys = F.expr(f"if(size(sketch) <= {SMALL}, concat({run(NEIGHBOURS - 1)}, if(size(sketch) < {NEIGHBOURS}, array(), {run(NEIGHBOURS)})), {run(NEIGHBOURS)})")
    kept = groups.where(F.size("sketch") >= NEIGHBOURS - 1).select("node", F.explode(keys).alias("key"))
    often = common.saved_table(kept.groupBy("key").agg(F.count("*").alias("often")).where("often > 1"))
    listed = common.saved_table(kept.join(common.broadcast_if_small(often, most=LISTS), "key"))
    weight = listed.groupBy("node").agg(F.sum("often").alias("weight"))
    lead = listed.join(weight, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).alias("lead"))
    return common.saved_table(listed.join(lead, "key").select("key", "node", F.col("lead.node").alias("lead"), F.col("lead.weight").alias("weight")))


def likely(u: np.ndarray, v: np.ndarray, n: int, m: int) -> bool:
    """Whether two sketches allow a link: sets retained whole are compared, else SHARED of the union's values must be in both."""
    both = np.concatenate([u, v])
    both.sort()
    twice = both[1:][both[1:] == both[:-1]]
    if max(n, m) < RETAINED:
        return len(twice) * 100 >= (len(both) - len(twice)) * SIMILARITY
    if len(twice) < SHARED:
        return False
    # the union's RETAINED-th value: of the values up to x, those that are in both stand there twice
    values = np.unique(both)
    return np.searchsorted(twice, values[min(RETAINED, len(values)) - 1], side="right") >= SHARED


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, m = (b.column(k).to_numpy() for k in (2, 3))
        sketches = []
        for k in (4, 5):
            ends = b.column(k).offsets.to_numpy()
            sketches.append((b.column(k).flatten().to_numpy(), ends - ends[0]))
        (x, i), (y, j) = sketches
        keep = [likely(x[i[k] : i[k + 1]], y[j[k] : j[k + 1]], n[k], m[k]) for k in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _sizes(n: Column, m: Column) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * SIMILARITY


def _confirmed(words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int | None, set[bytes]] = None, set()
        for b in (whole.slice(k, common.SLICE) for whole in batches for k in range(0, whole.num_rows, common.SLICE)):
            keep = []
            for v, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if last[0] != v:
                    last = v, shingles(y, words)
                own, other = shingles(x, words), last[1]
                same = len(own & other)
                keep.append(same * 100 >= (len(own) + len(other) - same) * SIMILARITY)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def open_nodes(near: DataFrame, root: DataFrame, sizes: DataFrame) -> DataFrame:
    """(node, root): nodes that may still be linked with a node of another component.

    Such a node shares RUNS lists at least with the other one (as many as its size makes sure), whose size is near its
    own. Sizes are near if they lie in the same step of a scale of factor 1.26, or in neighbouring ones, so each node is
    counted in its own and in the next step.
    """
    state = near.select("key", "node").join(root, "node", "left").join(sizes, "node").select("key", "node", "n", F.coalesce("root", "node").alias("root"))
    step = F.floor(F.log(F.col("n")) / float(np.log(1.26)))
    steps = common.saved_table(state.withColumn("step", F.explode(F.array(step, step + 1))))
    several = steps.groupBy("key", "step").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key", "step")
    lists = steps.join(several, ["key", "step"]).select("key", "node", "root", "n").distinct().groupBy("node", "root", "n").agg(F.count("*").alias("lists"))
    least = F.greatest(F.lit(1), F.least(F.lit(RUNS), F.call_function("div", F.col("n") * 4 - 11, F.lit(10))))
    return common.saved_table(lists.where(F.col("lists") >= least).select("node", "root"))


def open_pairs(whole: DataFrame, state: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(u, v): pairs of nodes of different roots that may be similar by an exact filter on their whole shingle sets.

    Nodes are rows (node, root) of ``state``, with their texts in ``whole``. Shingles are put in one order, the commonest
    last. Two similar sets share one of the first n - 0.8 n + 1 of each, and the first one that they share stands so
    early that enough are left behind it in both: that bounds what the join makes where a passage is in very many texts.
    """
    own = whole.join(state, "node")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, common.SLICE) for x in batches for k in range(0, x.num_rows, common.SLICE)):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([hashes(t, words) for t in b.column(0).to_pylist()]))], names=["value"])

    often = own.select("text").mapInArrow(sets, "value long").groupBy("value").agg(F.count("*").alias("often")).where("often > 2")
    last = np.array([r.value for r in often.orderBy(F.col("often").desc(), "value").limit(COMMON).collect()][::-1], dtype=np.int64)
    place = np.argsort(last)
    shared = whole.sparkSession.sparkContext.broadcast((last[place], place))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, place = shared.value
        for b in (x.slice(k, common.SLICE) for x in batches for k in range(0, x.num_rows, common.SLICE)):
            values, at, sizes = [], [], []
            for t in b.column(2).to_pylist():
                own = hashes(t, words)
                if len(known):
                    found = np.minimum(np.searchsorted(known, own), len(known) - 1)
                    own = own[np.argsort(np.where(known[found] == own, place[found], -1), kind="stable")]
                size = len(own) - -(-len(own) * SIMILARITY // 100) + 1
                values.append(own[:size])
                at.append(np.arange(size))
                sizes.append(len(own))
            of = np.repeat(np.arange(len(sizes)), [len(v) for v in values])
            cols = [b.column(0).take(pa.array(of)), b.column(1).take(pa.array(of)), *(pa.array(x.astype(np.int64)) for x in (np.concatenate(values), np.concatenate(at), np.array(sizes)[of]))]
            yield pa.RecordBatch.from_arrays(cols, names=["node", "root", "value", "at", "n"])

    listed = own.select("node", "root", "text").mapInArrow(first, "node long, root long, value long, at long, n long")
    listed = common.saved_table(listed)
    several = listed.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("value")
    listed = common.saved_table(listed.join(several, "value"))
    a, b = listed.alias("a"), listed.alias("b")
    # of sets of n and m shingles 80 / 180 of n + m are shared at least
    left = (F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))) * (100 + SIMILARITY) >= (F.col("a.n") + F.col("b.n")) * SIMILARITY
    both = a.join(b, (F.col("a.value") == F.col("b.value")) & (F.col("a.root") < F.col("b.root")) & left)
    return both.select(F.col("a.node").alias("u"), F.col("b.node").alias("v"))


def links(docs: DataFrame, groups: DataFrame, words: int = SHINGLE) -> DataFrame:
    """(u, v): confirmed links between nodes (sets) whose chains connect all linked ones.

    Each set is first compared with the heaviest lead that it meets in any list, then with the leads of all its lists.
    What is connected by then needs no comparison. Sets of lists that still hold several components are compared by an
    exact filter on their whole shingle sets.
    """
    near = postings(groups)
    met = near.select("node").distinct()
    sketch = common.saved_table(groups.select("node", "n", "digest", "sketch").join(met, "node", "left_semi"))
    text = F.coalesce("text", F.lit(""))

    def texts(nodes: DataFrame) -> DataFrame:
        """(node, text); texts are shuffled only if very many are asked for."""
        digests = common.saved_table(sketch.select("node", "digest").join(nodes, "node", "left_semi"))
        asked = docs.select(F.md5(text).alias("digest"), F.encode(text, "utf-8").alias("text")).join(common.broadcast_if_small(digests.select("digest"), most=LISTS), "digest", "left_semi")
        return common.saved_table(asked.groupBy("digest").agg(F.first("text").alias("text")).join(digests, "digest").select("node", "text"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        a, b = (sketch.select(F.col("node").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in ("u", "v"))
        met = pairs.distinct().join(a, "u").join(b, "v").where(_sizes(F.col("n_u"), F.col("n_v")))
        open_ = common.saved_table(met.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(_likely, "u long, v long"))
        whole = texts(open_.select(F.col("u").alias("node")).union(open_.select("v")).distinct())
        x, y = (whole.select(F.col("node").alias(k), F.col("text").alias(f"t_{k}")) for k in ("u", "v"))
        return common.saved_table(open_.join(x, "u").join(y, "v").select("u", "v", "t_u", "t_v").mapInArrow(_confirmed(words), "u long, v long"))

    first = common.saved_table(near.where("node <> lead").groupBy(F.col("node").alias("u")).agg(F.max(F.struct("weight", "lead")).alias("best")).select("u", F.col("best.lead").alias("v")))
    star = confirmed(first)
    root = common.components(star)
    of = lambda k: root.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"))
    more = near.where("node <> lead").select(F.col("node").alias("u"), F.col("lead").alias("v")).distinct().join(of("u"), "u", "left").join(of("v"), "v", "left")
    star = star.union(confirmed(more.where(F.coalesce("u_root", "u") != F.coalesce("v_root", "v")).select("u", "v").join(first, ["u", "v"], "left_anti")))
    state = open_nodes(near, common.components(star), sketch.select("node", "n"))
    return star.union(confirmed(open_pairs(texts(state.select("node")), state, words)))


def near_duplicates(docs: DataFrame, words: int = SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row; documents link if 100 * intersection >= 80 * union of their sets of shingles of so many words.

    Null and empty texts and texts without words have no shingles and link with nothing, not with each other. Rows with
    equal sets are one node, so exact copies are never compared. Each row counts for its text: rows that repeat a
    doc_id with another text aren't linked by the id. A row without doc_id links like any other and can join two
    others; its component is the smallest id reachable, null if there is none, and then it is kept. Texts of any length
    are hashed whole. Only doc_id and text are read, so other columns of any name don't matter; an empty table gives an
    empty one.
    """
    docs = docs.select("doc_id", "text")
    rows = common.saved_table(sketched(docs, words))
    groups = rows.where("n > 0").groupBy("k1", "k2").agg(F.min("doc_id").alias("id"), F.first("n").alias("n"), F.first("digest").alias("digest"), F.first("sketch").alias("sketch"))
    groups = common.saved_table(groups.withColumn("node", F.monotonically_increasing_id()))
    root = common.components(links(docs, groups, words))
    found = common.saved_table(groups.join(root, "node", "left").select("k1", "k2", "id", F.coalesce("root", "node").alias("root")))
    low = found.groupBy("root").agg(F.min("id").alias("component_id"))
    whole = rows.where("n > 0").join(found.join(low, "root").select("k1", "k2", "component_id"), ["k1", "k2"])
    out = whole.select("doc_id", "n", "component_id").union(rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
