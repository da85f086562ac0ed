"""Mixing sources to target weights by hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Hex digits of a document's hash that each histogram level resolves, and the number of levels.
DIGITS, LEVELS = 3, 3


def targets(totals: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Water-fill the budget ``share`` x all words over sources: weight x level, at most ``most`` x the source's words.

    totals: one row a source (source, source_size). Sources are weighted in code-point order, null last. The level is
    found in closed form: sources whose cap is reached first stand first, and running sums give the level at which
    the remaining ones share what is left. One row a source, so the windows see as many rows as there are sources.
    """
    n = len(weights)
    w = totals.withColumn("_k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = w.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), (F.col("_k") % n + 1).cast("int")).cast("long"))
    w = w.withColumn("_cap", F.col("source_size") * most)
    order = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k").asc())
    before, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    w = w.withColumn("_level", (F.sum("source_size").over(everything) * F.lit(share) - F.coalesce(F.sum("_cap").over(before), F.lit(0)))
                     / (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0))))
    # a source is capped if its cap lies under the level that holds once all sources before it are capped
    open_ = F.col("_w") * F.col("_level") < F.col("_cap")
    level = F.min(F.when(open_, F.struct("_k2", "_level"))).over(everything)["_level"]
    w = w.withColumn("_k2", F.row_number().over(order)).withColumn("_final", level)
    full = F.col("_cap").cast("double")
    target = F.when(F.col("_final").isNull(), full).otherwise(F.least(full, F.col("_w") * F.col("_final")))
    return w.select("source", "source_size", target.alias("target"))


def mix(docs: DataFrame, size: Column, key: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Columns of ``docs`` plus size, source_size, target and taken; columns of these names (whatever their case) give way to the new ones.

    Each document has a hash (``key``, hex digits; by default of doc_id). Whole copies come first; what is left of a
    source's budget goes to its documents of the smallest hashes: a histogram of words by source and leading digits
    gives the boundary bucket, whose documents alone are split by the next digits, and so on. At the last level the
    documents of the boundary value are taken if that brings the source nearer to its target. Nothing is sorted but
    the histograms, which have 16**DIGITS rows a source at most. Rows with equal keys (repeated ids) are taken
    together; null text has size 0; null source is a source; null doc_id hashes as the empty string. An empty table
    gives an empty one.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) if key is None else key
    n, k = common.fresh(docs, "size"), common.fresh(docs, "key")
    rows = docs.withColumns({n: size.cast("long"), k: F.substring(key, 1, DIGITS * LEVELS)})
    small = common.saved(rows.select("source", F.col(n).alias("size"), F.col(k).alias("_key")))
    goals = targets(small.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))
    goals = common.saved(goals.withColumn("_whole", F.least(whole, F.lit(most))).withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size")))
    # cut: for each source, documents with key < cut are taken (keys are hex digits: text order is numeric order)
    open_ = goals.select("source", F.col("_left").alias("_room"), F.lit("").alias("_prefix"))
    for level in range(1, LEVELS + 1):
        near = common.broadcast_if_small(open_)
        inside = small.alias("s").join(near.alias("o"), F.col("s.source").eqNullSafe(F.col("o.source")) & F.startswith(F.col("s._key"), F.col("o._prefix")))
        hist = inside.groupBy(F.col("s.source").alias("source"), F.col("o._room").alias("_room"), F.substring("s._key", 1, DIGITS * level).alias("_prefix")).agg(F.sum("size").alias("_n"))
        upto = Window.partitionBy("source").orderBy("_prefix")
        hist = hist.withColumn("_before", F.sum("_n").over(upto) - F.col("_n"))
        crossing = (F.col("_before") + F.col("_n") > F.col("_room")) if level < LEVELS else (F.col("_before") + F.col("_n") / 2 > F.col("_room"))
        found = hist.where(crossing).groupBy("source").agg(F.min(F.struct("_prefix", (F.col("_room") - F.col("_before")).alias("_room"))).alias("b"))
        # without a crossing, everything under this prefix fits: "g" follows all hex digits
        open_ = common.saved(open_.alias("o").join(found.alias("f"), F.col("o.source").eqNullSafe(F.col("f.source")), "left").select(
            "o.source", F.coalesce("f.b._room", "o._room").alias("_room"), F.coalesce(F.col("f.b._prefix"), F.concat("o._prefix", F.lit("g"))).alias("_prefix")))
    cuts = common.broadcast_if_small(goals.alias("g").join(open_.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source"))).select("g.*", F.col("c._prefix").alias("_cut")), goals.count())
    out = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
    once = F.col(f"r.{k}") < F.col("c._cut")
    copies = F.col("c._whole") + F.when((F.col("c._left") > 0) & once, 1).otherwise(0)
    taken = (F.least(copies, F.lit(most)) * F.col(f"r.{n}")).cast("long")
    added = {"size": F.col(f"r.{n}"), "source_size": F.col("c.source_size"), "target": F.col("c.target"), "taken": taken}
    return out.select(*[F.col(f"r.`{c}`") for c in docs.columns if c.lower() not in added], *[c.alias(x) for x, c in added.items()])


def word_count(name: str = "text") -> Column:
    return F.regexp_count(common.text_or_empty(name), F.lit(r"[^\x20\x09-\x0D]+"))
