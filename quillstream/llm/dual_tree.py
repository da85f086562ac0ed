"""Hard negatives by dual-tree search: one tree over anchors, one over candidates, and intervals of inner products that prune node pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Fixed values of the report: positives of an anchor, negatives of a positive, and the band of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, LEAST, MOST = 5, 10, 30, 90
SCALE, EVERY, LABELS, SHIFTED = 256, 100, 10, 7
#: The trees' cuts are fitted on so many vectors at most; a leaf has about LEAF of them, and the tree DEPTH levels at most.
SAMPLE, LEAF, DEPTH = 4096, 64, 8
#: Vectors of a block, which is a tree's lowest node and the unit of exact scoring, and bytes of anchor blocks that may be broadcast.
ANCHORS, CANDIDATES, SMALL = 256, 1024, 16 << 20
#: The share of an anchor block's open candidate blocks, those of the highest bounds, that is scored before the rest.
FIRST = 0.125
#: Scores and thresholds are longs; this one is below all.
LOWEST = -(1 << 63)
#: Inner products below this are exact in doubles; above the next, a hundred times the score may not fit in a long.
EXACT, WIDEST = 1 << 53, 1 << 56


def quantised(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, label, vec): the rows that take part, with whole-number components and the labels shifted."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    label = F.when(F.col("vec_id") % SHIFTED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    return rows.where(F.col("label").isNotNull() & F.col(vector).isNotNull() & ~bad).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), whole.alias("vec"))


def entities(rows: DataFrame, most: int) -> DataFrame:
    """(eid, label, vec, ids): rows of one label and vector are one, with the smallest ids that any result can need.

    Window limits keep so many ids a key in each task before the shuffle, so a vector with very many copies is cheap.
    """
    first = Window.partitionBy("label", "vec").orderBy(F.col("vec_id").asc_nulls_last())
    few = rows.distinct().withColumn("place", F.row_number().over(first)).where(F.col("place") <= most)
    ids = F.sort_array(F.collect_list(F.struct(F.col("vec_id").isNull().alias("none"), F.col("vec_id").alias("id"))))
    return few.groupBy("label", "vec").agg(ids.alias("ids")).withColumn("eid", F.monotonically_increasing_id())


def matrix(vectors: pa.ListArray, width: int) -> np.ndarray:
    """The vectors as rows; shorter ones count as followed by zeros."""
    lens = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(lens) and (lens == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(lens), width), dtype=np.int64)
    out[np.arange(width) < lens[:, None]] = flat
    return out


class Cuts:
    """A binary tree of hyperplanes in heap order; leaf numbers count from 0."""

    def __init__(self, sample: np.ndarray):
        self.depth = int(np.clip(np.log2(max(len(sample), 1) / LEAF), 0, DEPTH))
        self.ways, self.cuts = np.zeros(((1 << self.depth) - 1, sample.shape[1])), np.zeros((1 << self.depth) - 1)
        parts = {0: sample.astype(np.float64)}
        for node in range(len(self.cuts)):
            own = parts.pop(node)
            if len(own):
                self.ways[node] = self._widest(own)
                at = own @ self.ways[node]
                self.cuts[node] = np.median(at)
                parts[2 * node + 1], parts[2 * node + 2] = own[at <= self.cuts[node]], own[at > self.cuts[node]]
            else:
                parts[2 * node + 1] = parts[2 * node + 2] = own

    @staticmethod
    def _widest(own: np.ndarray) -> np.ndarray:
        """About the direction of the largest variance, by power iteration."""
        own = own - own.mean(axis=0)
        way = own[np.argmax((own**2).sum(axis=1))] if len(own) else own.sum(axis=0)
        for _ in range(10):
            size = np.linalg.norm(way)
            if not size:
                break
            way = own.T @ (own @ (way / size))
        size = np.linalg.norm(way)
        return way / size if size else way

    def place(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The leaf of each vector, and where the last cut of its path sees it, by which a leaf's vectors are put in order."""
        node, at, x = np.zeros(len(vectors), dtype=np.int64), np.zeros(len(vectors)), vectors.astype(np.float64)
        for _ in range(self.depth):
            at = np.einsum("ij,ij->i", x, self.ways[node])
            node = 2 * node + 1 + (at > self.cuts[node])
        return node - ((1 << self.depth) - 1), at


BLOCK = "block long, leaf long, vecs binary, eids array<long>, labels array<long>, owner array<int>, ids array<long>, low array<double>, high array<double>, middle array<double>, radius double, kinds array<long>"


def blocks(own: DataFrame, cuts: Cuts, width: int, size: int) -> DataFrame:
    """The lowest nodes of a tree: ``size`` vectors of one leaf at most, with their box, their ball and their labels.

    The ids of a block's vectors stand in ascending order, those without id last, each with the place of its vector.
    A large leaf is parted by ranges of its place along the last cut, so that no task holds more than its share.
    """

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            leaf, at = cuts.place(matrix(b.column(2), width))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf), pa.array(at)], names=["eid", "label", "vec", "ids", "leaf", "at"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        held: list[pa.RecordBatch] = []

        def block(rows: pa.Table) -> pa.RecordBatch:
            nonlocal number
            rows = rows.combine_chunks()
            column = lambda name: rows[name].chunk(0)
            x = matrix(column("vec"), width)
            if np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()) >= np.sqrt(WIDEST):
                raise ValueError("components so large that inner products don't fit in a long")
            ids = column("ids")
            owner = np.repeat(np.arange(len(x)), np.diff(ids.offsets.to_numpy()))
            none, num = ids.flatten().field("none").to_numpy(zero_copy_only=False), ids.flatten().field("id").to_pylist()
            order = sorted(range(len(num)), key=lambda k: (none[k], num[k] if num[k] is not None else 0))
            middle = x.mean(axis=0)
            radius = float(np.sqrt(((x - middle) ** 2).sum(axis=1).max())) * (1 + 1e-9) + 1e-6
            number += 1
            one = lambda v, kind: pa.array([v], kind)
            floats, longs = pa.list_(pa.float64()), pa.list_(pa.int64())
            labels = column("label").to_pylist()
            cols = [
                one(number, pa.int64()), one(column("leaf")[0].as_py(), pa.int64()), one(x.tobytes(), pa.binary()), one(column("eid").to_pylist(), longs), one(labels, longs),
                one(owner[order].tolist(), pa.list_(pa.int32())), one([num[k] for k in order], longs), one(x.min(axis=0).tolist(), floats), one(x.max(axis=0).tolist(), floats),
                one(middle.tolist(), floats), one(radius, pa.float64()), one(sorted(set(labels)), longs),
            ]
            return pa.RecordBatch.from_arrays(cols, names=[c.split(" ")[0] for c in BLOCK.split(", ")])

        def out(last: bool) -> Iterator[pa.RecordBatch]:
            """Blocks of the leaves that are complete, or long enough; the rest is held."""
            nonlocal held
            rows = pa.Table.from_batches(held)
            held = []
            leaf = rows["leaf"].to_numpy()
            ends = [*np.flatnonzero(np.diff(leaf)) + 1, len(leaf)]
            for a, z in zip([0, *ends[:-1]], ends, strict=True):
                while a < z and (z - a >= size or z < len(leaf) or last):
                    yield block(rows.slice(a, min(size, z - a)))
                    a += min(size, z - a)
                if a < z:
                    held = rows.slice(a).to_batches()

        for b in (whole.slice(k, size) for whole in batches for k in range(0, whole.num_rows, size)):
            held.append(b)
            if sum(x.num_rows for x in held) >= 2 * size:
                yield from out(False)
        if held:
            yield from out(True)

    parts = max(1, -(-own.count() // (4 * size)))
    rows = own.select("eid", "label", "vec", "ids").mapInArrow(placed, "eid long, label long, vec array<long>, ids array<struct<none:boolean,id:long>>, leaf long, at double")
    return common.saved_table(rows.repartitionByRange(parts, "leaf", "at", "eid").sortWithinPartitions("leaf", "at", "eid").mapInArrow(packed, BLOCK))


def products(a_low: np.ndarray, a_high: np.ndarray, b_low: np.ndarray, b_high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The interval of inner products of a vector of one box with a vector of the other."""
    ends = np.stack([a_low * b_low, a_low * b_high, a_high * b_low, a_high * b_high])
    return ends.min(axis=0).sum(axis=-1), ends.max(axis=0).sum(axis=-1)


class Node:
    """A node of the upper tree: its box, labels and, of an anchors' tree, the lowest and highest score that any anchor of it looks for."""

    def __init__(self, low: np.ndarray, high: np.ndarray, kinds: set[int], least: int = LOWEST, most: int = -LOWEST - 1):
        self.low, self.high, self.kinds, self.least, self.most = low, high, kinds, least, most

    @staticmethod
    def over(x: Node | None, y: Node | None) -> Node | None:
        if not x or not y:
            return x or y
        return Node(np.minimum(x.low, y.low), np.maximum(x.high, y.high), x.kinds | y.kinds, min(x.least, y.least), max(x.most, y.most))


def open_leaves(anchors: dict[int, Node], candidates: dict[int, Node], depth: int, same: bool) -> list[tuple[int, int]]:
    """Pairs of leaves that a simultaneous descent of both trees can't prune: their interval meets what the anchors look for."""
    first = (1 << depth) - 1

    def tree(leaves: dict[int, Node]) -> list[Node | None]:
        out = [None] * first + [leaves.get(k) for k in range(1 << depth)]
        for k in reversed(range(first)):
            out[k] = Node.over(out[2 * k + 1], out[2 * k + 2])
        return out

    left, right = tree(anchors), tree(candidates)
    found, todo = [], [(0, 0)]
    while todo:
        a, c = todo.pop()
        x, y = left[a], right[c]
        if not x or not y or not (x.kinds & y.kinds if same else len(x.kinds | y.kinds) > 1):
            continue
        low, high = products(x.low, x.high, y.low, y.high)
        slack = 1 + 1e-9 * max(abs(low), abs(high))
        if high + slack < x.least or low - slack > x.most:
            continue
        if a >= first:
            found.append((a - first, c - first))
        else:
            todo += [(i, j) for i in (2 * a + 1, 2 * a + 2) for j in (2 * c + 1, 2 * c + 2)]
    return found


def leaves(tree: DataFrame) -> dict[int, Node]:
    """The upper trees' leaves, which are as many as the cuts make at most, from the blocks' boxes and labels."""
    sides = tree.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("k", "x")).groupBy("leaf", "k").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    boxes = {r.leaf: Node(np.array([x.low for x in r.s]), np.array([x.high for x in r.s]), set()) for r in sides.groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("k", "low", "high"))).alias("s")).collect()}
    # two labels tell as much as all: whether another one than a given one occurs; same labels are looked up in the blocks
    for r in tree.select("leaf", F.explode("kinds").alias("kind")).groupBy("leaf").agg(F.min("kind").alias("a"), F.max("kind").alias("b")).collect():
        boxes[r.leaf].kinds = {r.a, r.b}
    return boxes


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals of inner products of block pairs, from boxes and balls; pairs whose interval misses what the anchors look for go."""
    for b in batches:
        a_low, a_high, a_mid, c_low, c_high, c_mid = (b.column(k).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for k in (2, 3, 4, 6, 7, 8))
        a_rad, c_rad, least, most = (b.column(k).to_numpy(zero_copy_only=False) for k in (5, 9, 10, 11))
        low, high = products(a_low, a_high, c_low, c_high)
        at = (a_mid * c_mid).sum(axis=1)
        wide = a_rad * np.linalg.norm(c_mid, axis=1) + c_rad * np.linalg.norm(a_mid, axis=1) + a_rad * c_rad
        low, high = np.maximum(low, at - wide), np.minimum(high, at + wide)
        slack = 1 + 1e-9 * np.maximum(abs(low), abs(high))
        keep = (high + slack >= least) & (low - slack <= most)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(low - slack), pa.array(high + slack)], names=["a", "c", "low", "high"]).filter(pa.array(keep))


def scores(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """All inner products, exactly."""
    size = np.sqrt((x.astype(np.float64) ** 2).sum(axis=1).max()) * np.sqrt((y.astype(np.float64) ** 2).sum(axis=1).max())
    return (x.astype(np.float64) @ y.T.astype(np.float64)).astype(np.int64) if size < EXACT else x @ y.T


def best(values: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of the ``most`` highest values of each row above LOWEST; of equal ones the leftmost."""
    least = np.full(len(values), LOWEST + 1)
    if values.shape[1] > most:
        least = np.maximum(least, np.partition(values, -most, axis=1)[:, -most])
    i, j = np.nonzero(values >= least[:, None])
    order = np.lexsort((j, -values[i, j], i))
    i, j = i[order], j[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    return i[place < most], j[place < most]


class _Found:
    """The best rows so far of what one anchor block looks for, in one task."""

    def __init__(self, least: np.ndarray, most: int):
        self.least, self.most = least.copy(), most
        self.of, self.score, self.id, self.none = (np.zeros(0, dtype=np.int64) for _ in range(4))

    def add(self, of: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        of, score, ids, none = (np.concatenate(x) for x in ((self.of, of), (self.score, score), (self.id, ids), (self.none, none)))
        order = np.lexsort((ids, none, -score, of))
        place = np.arange(len(of)) - np.searchsorted(of[order], of[order])
        order = order[place < self.most]
        self.of, self.score, self.id, self.none = of[order], score[order], ids[order], none[order]
        place = place[place < self.most]
        last = np.flatnonzero(place == self.most - 1)
        self.least[self.of[last]] = np.maximum(self.least[self.of[last]], self.score[last])


def _scored(width: int, most: int, same: bool):
    """Score leaf pairs exactly: the best ``most`` rows that each anchor looks for, over all the pairs that a task has of an anchor block."""
    columns = ["a", "a_vecs", "a_eids", "a_labels", "asks", "c_vecs", "c_labels", "c_owner", "c_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}

        def out(a: int) -> pa.RecordBatch:
            eid, ask, found = held.pop(a)
            ids = pa.array(found.id, pa.int64(), mask=found.none.astype(bool))
            return pa.RecordBatch.from_arrays([pa.array(eid[found.of]), pa.array(ask[found.of]), ids, pa.array(found.score)], names=["eid", "ask", "id", "score"])

        for row in (r for b in batches for k in range(b.num_rows) for r in b.slice(k, 1).select(columns).to_pylist()):
            x, y = (np.frombuffer(row[k], dtype="<i8").reshape(-1, width) for k in ("a_vecs", "c_vecs"))
            asks = row["asks"]
            at, ask, least, top = (np.array([q[k] for q in asks], dtype=np.int64) for k in ("at", "ask", "least", "most"))
            if row["a"] not in held:
                if len(held) >= 16:
                    yield out(next(iter(held)))
                held[row["a"]] = np.array(row["a_eids"], dtype=np.int64)[at], ask, _Found(least, most)
            found = held[row["a"]][2]
            owner, none = np.array(row["c_owner"], dtype=np.int64), np.array([i is None for i in row["c_ids"]], dtype=np.int64)
            ids = np.array([i or 0 for i in row["c_ids"]], dtype=np.int64)
            alike = np.array(row["a_labels"], dtype=np.int64)[:, None] == np.array(row["c_labels"], dtype=np.int64)
            got = np.where(alike if same else ~alike, scores(x, y), LOWEST)
            for k in range(0, len(at), ANCHORS):
                own = slice(k, k + ANCHORS)
                values = got[at[own]]
                values = np.where((values >= found.least[own, None]) & (values <= top[own, None]), values, LOWEST)[:, owner]
                i, j = best(values, most)
                if len(i):
                    found.add(i + k, values[i, j], ids[j], none[j])
        for a in list(held):
            yield out(a)

    return run


class Search:
    """Both trees of one table."""

    def __init__(self, spark: SparkSession, own: DataFrame, anchors: DataFrame):
        self.spark = spark
        self.width = max(1, own.agg(F.max(F.size("vec"))).first()[0] or 0)
        sample = [r.vec for r in own.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()]
        cuts = Cuts(matrix(pa.array(sample, pa.list_(pa.int64())), self.width))
        self.depth = cuts.depth
        self.candidates = blocks(own, cuts, self.width, CANDIDATES)
        self.anchors = blocks(own.join(anchors.select("eid").distinct(), "eid", "left_semi"), cuts, self.width, ANCHORS)
        self.places = common.saved_table(self.anchors.select("block", "leaf", F.posexplode("eids").alias("at", "eid")))
        self.left, self.right = leaves(self.anchors), leaves(self.candidates)
        few = self.anchors.count() * ANCHORS * self.width * 8 <= SMALL
        self.hint = F.broadcast if few else lambda df: df

    def _run(self, pairs: DataFrame, asks: DataFrame, most: int, same: bool) -> DataFrame:
        grouped = asks.groupBy("block").agg(F.collect_list(F.struct("at", "ask", "least", "most")).alias("asks"))
        a = self.anchors.select(F.col("block").alias("a"), F.col("vecs").alias("a_vecs"), F.col("eids").alias("a_eids"), F.col("labels").alias("a_labels")).join(grouped, F.col("a") == grouped.block).drop("block")
        c = self.candidates.select(F.col("block").alias("c"), F.col("vecs").alias("c_vecs"), F.col("labels").alias("c_labels"), F.col("owner").alias("c_owner"), F.col("ids").alias("c_ids"))
        both = pairs.select("a", "c").join(c, "c").join(self.hint(a), "a")
        return common.saved_table(both.mapInArrow(_scored(self.width, most, same), "eid long, ask long, id long, score long"))

    def top(self, asks: DataFrame, most: int, same: bool) -> DataFrame:
        """(eid, ask, id, score, rank): the best ``most`` rows for each of asks (eid, ask, least, most), the scores in its band.

        A row's label is the anchor's if ``same``, else another. Each anchor block is first scored against the
        candidates of its own leaf; what it finds raises the lowest scores looked for. Then both trees are descended
        together, and of the block pairs left those of the highest bounds come first, and the rest after another cut.
        """
        order = Window.partitionBy("eid", "ask").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
        ranked = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
        asks = common.saved_table(asks.join(self.places, "eid"))
        mine = self.anchors.select(F.col("block").alias("a"), "leaf").join(self.candidates.select(F.col("block").alias("c"), "leaf"), "leaf")
        found = self._run(mine, asks, most, same)

        def raised(found: DataFrame) -> DataFrame:
            reached = ranked(found).where(F.col("rank") == most).select("eid", "ask", F.col("score").alias("reached"))
            higher = asks.join(reached, ["eid", "ask"], "left").withColumn("least", F.greatest("least", F.coalesce("reached", "least"))).drop("reached")
            return common.saved_table(higher)

        now = raised(found)
        sought = now.groupBy("leaf").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect()
        left = {r.leaf: Node(x.low, x.high, x.kinds, r.least, r.most) for r in sought if (x := self.left[r.leaf])}
        # a leaf's labels are known as two only, so leaves are pruned by intervals alone where labels must agree
        pairs = [p for p in open_leaves({k: Node(x.low, x.high, {0}, x.least, x.most) for k, x in left.items()} if same else left, {k: Node(x.low, x.high, {0}) for k, x in self.right.items()} if same else self.right, self.depth, same) if p[0] != p[1]]
        if not pairs:
            return ranked(found)
        band = now.groupBy(F.col("block").alias("a")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        box = lambda df, x: df.select(F.col("block").alias(x), F.col("leaf").alias(f"{x}_leaf"), *[F.col(k).alias(f"{x}_{k}") for k in ("low", "high", "middle", "radius", "kinds")])
        open_ = F.broadcast(self.spark.createDataFrame(pairs, "a_leaf long, c_leaf long"))
        both = box(self.anchors, "a").join(band, "a").join(open_, "a_leaf").join(box(self.candidates, "c"), "c_leaf")
        kinds = F.arrays_overlap("a_kinds", "c_kinds") if same else F.size(F.array_union("a_kinds", "c_kinds")) > 1
        near = both.where(kinds).select("a", "c", "a_low", "a_high", "a_middle", "a_radius", "c_low", "c_high", "c_middle", "c_radius", "least", "most")
        near = common.saved_table(near.mapInArrow(_bounded, "a long, c long, low double, high double"))
        cut = near.groupBy("a").agg(F.percentile_approx("high", 1 - FIRST).alias("cut"))
        near = common.saved_table(near.join(cut, "a"))
        found = found.union(self._run(near.where("high >= cut"), now, most, same))
        now = raised(found)
        band = now.groupBy(F.col("block").alias("a")).agg(F.min("least").alias("least"), F.max("most").alias("most"))
        rest = near.where("high < cut").join(band, "a").where("high >= least and low <= most")
        return ranked(found.union(self._run(rest, now, most, same)))


def hard_negatives(rows: DataFrame) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: the best negatives in the band below each positive.

    Rows without label or vector, or with a null or non-finite component, take no part. Rows that agree in vec_id, label
    and vector count once; rows that share a vec_id only are each a row, and none is another's positive. A row without
    vec_id is nobody's anchor and no positive, and as a negative comes last among equal scores. Vectors of different
    lengths are held against each other as if zeros followed the shorter one. Ties go to the smaller vec_id. An anchor
    without positives, or a positive without negatives in its band, has no rows; an empty table gives an empty one.
    Only vec_id, embedding and label are read, so other columns of any name don't matter. A component so large that
    scores don't fit in a long fails the job.
    """
    spark = rows.sparkSession
    own = quantised(rows)
    asking = common.saved_table(own.where(F.col("vec_id") % EVERY == 0).distinct())
    # an anchor, and rows that share its id, may be among its own best, so as many more are asked for
    more = asking.groupBy("vec_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    groups = common.saved_table(entities(own, max(NEGATIVES, POSITIVES + more)))
    anchors = common.saved_table(asking.join(groups, ["label", "vec"]).select(F.col("vec_id").alias("anchor_id"), "eid"))
    empty = anchors.where("false")
    if anchors.isEmpty():
        nothing = F.lit(None).cast("long")
        return empty.select("anchor_id", nothing.alias("positive_id"), nothing.cast("int").alias("rank"), nothing.alias("negative_id"), nothing.alias("positive_score"), nothing.alias("negative_score"))
    search = Search(spark, groups, anchors)
    long = lambda k: F.lit(k).cast("long")
    asked = anchors.select("eid").distinct().select("eid", long(0).alias("ask"), long(LOWEST + 1).alias("least"), long(-LOWEST - 1).alias("most"))
    alike = search.top(asked, POSITIVES + more, True).select("eid", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    alike = common.saved_table(alike)
    # none but a positive score of 0 or more has a band
    bands = alike.where("positive_score >= 0").select("eid", F.col("positive_score").alias("ask")).distinct()
    floor, ceil = (lambda c: F.call_function("div", c, long(100))), (lambda c: F.call_function("div", c + 99, long(100)))
    bands = bands.select("eid", "ask", ceil(F.col("ask") * LEAST).alias("least"), floor(F.col("ask") * MOST).alias("most")).where("least <= most")
    unlike = search.top(bands, NEGATIVES, False).select("eid", F.col("ask").alias("positive_score"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    mine = Window.partitionBy("anchor_id", "eid").orderBy(F.col("positive_score").desc(), "positive_id")
    positives = anchors.join(alike, "eid").where(F.col("positive_id") != F.col("anchor_id")).withColumn("place", F.row_number().over(mine)).where(F.col("place") <= POSITIVES)
    return positives.join(unlike, ["eid", "positive_score"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
