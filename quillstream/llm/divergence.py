"""Audit of sources against their language: smoothed term probabilities, the terms that stand out, and distances between sources."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Documents of a language that a kept term occurs in at least, what is added to each count, the scale of a probability, and ranks of terms.
LEAST_DOCS, ADDED, SCALE, TERMS = 30, 5, 1_000_000_000, 50
#: Letters are ASCII letters, lower-cased, and all bytes of other characters; the rest parts terms.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Terms that a task counts before it hands its sums on, and pairs of sources whose sums it holds.
HELD, PAIRS = 200_000, 1 << 20


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term in each group, and documents that have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(lambda: (Counter(), Counter()))
        size = 0

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, df) in held.items():
                terms = [t.decode("utf-8", "replace") for t in n]
                cols = [pa.array([lang] * len(n)), pa.array([source] * len(n)), pa.array(terms, pa.string()), pa.array(n.values(), pa.int64()), pa.array([df[t] for t in n], pa.int64())]
                if terms:
                    yield pa.RecordBatch.from_arrays(cols, names=["lang", "source", "term", "n", "docs"])
            held.clear()

        for b in (whole.slice(k, common.SLICE) for whole in batches for k in range(0, whole.num_rows, common.SLICE)):
            for lang, source, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                own = text.translate(_LETTERS).split()
                n, df = held[lang, source]
                size -= len(n)
                n.update(own)
                df.update(set(own))
                size += len(n)
                if size > HELD:
                    yield from out()
                    size = 0
        yield from out()

    got = docs.select("lang", "source", F.encode("text", "utf-8")).mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return got.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def probability(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(SCALE * (n + ADDED) / (total + ADDED * kept)), exactly."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", wide(F.lit(SCALE)) * wide(n + ADDED), wide(total + kept * ADDED))


def _common_terms(flat: DataFrame) -> DataFrame:
    """(lang, a, b, part): what the terms that both of two groups (numbers a < b) have add to their distance, beyond what they add one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = defaultdict(list)

        def pressed(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, at = np.unique(np.concatenate([k for k, _ in held[lang]]), return_inverse=True)
            sums = np.zeros(len(keys), dtype=np.int64)
            np.add.at(sums, at, np.concatenate([v for _, v in held[lang]]))
            return keys, sums

        def out(lang: str) -> pa.RecordBatch:
            keys, sums = pressed(lang)
            del held[lang]
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(sums)], names=["lang", "a", "b", "part"])

        for b in batches:
            langs = np.array(b.column(0).to_pylist(), dtype=object)
            post = b.column(1)
            lens = np.diff(post.offsets.to_numpy())
            ends = np.repeat(np.cumsum(lens), lens)
            of = np.repeat(langs, lens)
            num, p, p0 = (post.flatten().field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3))
            for lang in set(langs):
                own = np.flatnonzero(of == lang)
                step = 1
                while len(own := own[own + step < ends[own]]):
                    for k in range(0, len(own), PAIRS):
                        i, j = own[k : k + PAIRS], own[k : k + PAIRS] + step
                        more = abs(p[i] - p[j]) - abs(p[i] - p0[j]) - abs(p0[i] - p[j]) + abs(p0[i] - p0[j])
                        held[lang].append((num[i] << 32 | num[j], more))
                        if sum(len(x) for x, _ in held[lang]) >= 2 * PAIRS:
                            held[lang] = [pressed(lang)]
                            if len(held[lang][0][0]) >= PAIRS:
                                yield out(lang)
                    step += 1
        for lang in list(held):
            yield out(lang)

    # numbers ascend within a posting, so that a < b
    posts = flat.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("num", "p", "p0"))).alias("post"))
    return posts.where(F.size("post") > 1).select("lang", "post").mapInArrow(run, "lang string, a long, b long, part long")


def _distances(groups: DataFrame, buckets: DataFrame, flat: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every ordered pair of sources of a language.

    Were no term common, each group's terms would be held against the other's probability of an absent term, which
    needs the group's counts alone; terms that neither has add the distance of the two absent ones. Postings add what
    common terms change. Parts are summed by unordered pair.
    """
    own = groups.join(buckets.groupBy("lang", "num").agg(F.collect_list(F.struct("p", "terms")).alias("counts")), ["lang", "num"], "left")
    other = groups.select("lang", F.col("num").alias("other"), F.col("p0").alias("other_p0"))
    one_by_one = F.aggregate(F.coalesce("counts", F.array().cast("array<struct<p:bigint,terms:bigint>>")), F.lit(0).cast("long"), lambda s, x: s + x.terms * F.abs(x.p - F.col("other_p0")))
    # each group's share of the terms that neither has: the common ones are taken away twice here and once in the postings' part
    rest = F.abs(F.col("p0") - F.col("other_p0")) * (F.when(F.col("num") < F.col("other"), F.col("kept")).otherwise(F.lit(0)) - F.col("terms"))
    alone = own.join(other, "lang").where("num <> other").select("lang", F.least("num", "other").alias("a"), F.greatest("num", "other").alias("b"), F.when(F.col("kept") > 0, one_by_one + rest).otherwise(F.lit(0)).alias("part"))
    total = alone.union(_common_terms(flat)).groupBy("lang", "a", "b").agg(F.sum("part").alias("value"))
    both = total.union(total.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = lambda num, name: groups.select("lang", F.col("num").alias(num), F.col("source").alias(name))
    return both.join(names("a", "source"), ["lang", "a"]).join(names("b", "item"), ["lang", "b"]).select("lang", "source", "item", "value")


def _outstanding(buckets: DataFrame, flat: DataFrame, most: int) -> DataFrame:
    """(lang, source, item, value, rank) of the ``most`` terms of each group whose probability exceeds the language's by most.

    The terms of a group with one count have one probability, and the smallest probability that the language gives any
    of them bounds what they exceed it by. Buckets are taken by descending bound: those that hold the first ``most``
    terms are evaluated for a threshold, then all whose bound isn't below that, so the long tail of rare terms is
    never looked at where its bound is below.
    """
    own = ["lang", "source"]
    bound = buckets.select(*own, "n", "terms", (F.col("p") - F.col("least_q")).alias("bound")).where("bound > 0")
    best_first = Window.partitionBy(*own).orderBy(F.col("bound").desc(), "n")
    first = bound.withColumn("_before", F.sum("terms").over(best_first) - F.col("terms")).where(F.col("_before") < most).select(*own, "n")
    exceeds = flat.withColumn("value", F.col("p") - F.col("q")).where("value > 0").select(*own, "n", F.col("term").alias("item"), "value")
    ranked = Window.partitionBy(*own).orderBy(F.col("value").desc(), "item")
    least = exceeds.join(first, [*own, "n"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).where(F.col("rank") == most).select(*own, F.col("value").alias("least"))
    open_ = bound.join(least, own, "left").where(F.col("bound") >= F.coalesce("least", F.lit(1))).select(*own, "n")
    return exceeds.join(open_, [*own, "n"]).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= most).select(*own, "item", "value", "rank")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, most: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: part ``pair`` has each other source of the language by distance, part ``term`` the outstanding terms.

    Reads lang, source and text, null as empty; other columns of any name don't matter. Every row counts as a document,
    so repeated rows count again. A group without terms has its pairs; a language that keeps no term has pairs of value
    0 and no terms; a language of one source has no pairs; an empty table gives an empty one. Ties in value go by item
    in byte order. A text is cut into terms whole, whatever its length. The pairs are as many as the squares of the
    languages' numbers of sources, and a term's posting has one entry a source at most.
    """
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    counts = term_counts(docs)
    posts = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n"), F.collect_list(F.struct("source", "n")).alias("post"))
    posts = common.saved_table(posts.where(F.col("docs") >= least_docs).drop("docs"))
    long = posts.select("lang", "term", "lang_n", F.explode("post").alias("x")).select("lang", "term", "lang_n", "x.*")
    langs = posts.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    sums = long.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left").fillna(0, ["total", "terms", "kept", "lang_total"])
    groups = groups.withColumn("num", F.row_number().over(Window.partitionBy("lang").orderBy("source")).cast("long"))
    zero = F.lit(0).cast("long")
    groups = common.saved_table(groups.withColumn("p0", F.when(F.col("kept") > 0, probability(zero, F.col("total"), F.col("kept"))).otherwise(zero)))
    flat = long.join(groups, ["lang", "source"]).withColumn("p", probability(F.col("n"), F.col("total"), F.col("kept"))).withColumn("q", probability(F.col("lang_n"), F.col("lang_total"), F.col("kept")))
    flat = common.saved_table(flat.select("lang", "source", "term", "n", "num", "p0", "p", "q"))
    buckets = common.saved_table(flat.groupBy("lang", "source", "num", "n", "p").agg(F.min("q").alias("least_q"), F.count("*").alias("terms")))
    pairs = _distances(groups, buckets, flat).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")))
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs, "pair").union(part(_outstanding(buckets, flat, most), "term"))
