"""Documents as a log of changes: snapshots at some revisions, patches between them, and any revision restored from both."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A snapshot is kept at the first revision and at every one that this divides.
EVERY = 50


def snapshots(log: DataFrame, keys: list[str], every: int = EVERY) -> DataFrame:
    """(keys, snapshot, id, value, since): the rows of the document at each revision that keeps a snapshot.

    The log has rows (rev, id, removed, value). A row lives from its change until the next change of its id, so it
    stands in the snapshots of that stretch; since is the revision at which it was put in after it was last away, which
    gives its place. Nothing is replayed.
    """
    own = Window.partitionBy(*keys, "id").orderBy("rev")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    life = F.sum(F.col("removed").cast("int")).over(upto)
    rows = log.withColumns({"_next": F.lead("rev").over(own), "_life": life})
    rows = rows.withColumn("since", F.min(F.when(~F.col("removed"), F.col("rev"))).over(Window.partitionBy(*keys, "id", "_life"))).where("NOT removed")
    last = log.groupBy(*keys).agg(F.max("rev").alias("_last"))
    ends = rows.join(last, keys).withColumn("_until", F.coalesce(F.col("_next") - 1, F.col("_last")))
    kept = F.expr(f"array_distinct(concat(if(rev = 1, array(rev), array()), transform(if(_until div {every} > (rev - 1) div {every}, sequence((rev - 1) div {every} + 1, _until div {every}), array()), s -> s * {every})))")
    return ends.select(*keys, F.explode(kept).alias("snapshot"), "id", "value", "since")


def nearest(wanted: DataFrame, every: int = EVERY) -> DataFrame:
    """Wanted revisions (rev) with the latest one that keeps a snapshot, which may be of an empty document."""
    return wanted.withColumn("snapshot", F.expr(f"greatest(1L, rev div {every} * {every})"))


def patched(rows: DataFrame, patches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, idx, id, value): documents (keys, id, value, since) after ordered patches (keys, rev, id, removed, value).

    Of the patches of an id only the last counts, and whether the id was away in between: then, or if it is new, it goes
    to the end, else it keeps its place. Both sides are aggregated by id and joined once; nothing is applied step by step.
    """
    away = Window.partitionBy(*keys, "id")
    last_gone = F.max(F.when(F.col("removed"), F.col("rev"))).over(away)
    ids = patches.withColumn("_gone", last_gone).groupBy(*keys, "id").agg(
        F.max_by(F.struct("removed", "value"), "rev").alias("_last"), F.max("_gone").alias("_gone"),
        F.min(F.when(~F.col("removed") & (F.col("rev") > F.coalesce("_gone", F.lit(0))), F.col("rev"))).alias("_back"),
    )
    both = rows.join(ids, [*keys, "id"], "full").where("_last IS NULL OR NOT _last.removed")
    since = F.when(F.col("_last").isNull() | F.col("_gone").isNull() & F.col("since").isNotNull(), F.col("since")).otherwise(F.col("_back"))
    out = both.select(*keys, "id", F.when(F.col("_last").isNull(), F.col("value")).otherwise(F.col("_last.value")).alias("value"), since.alias("since"))
    return out.withColumn("idx", (F.row_number().over(Window.partitionBy(*keys).orderBy("since", "id")) - 1).cast("long")).select(*keys, "idx", "id", "value")


def restored(log: DataFrame, kept: DataFrame, wanted: DataFrame, keys: list[str], every: int = EVERY) -> DataFrame:
    """(keys, rev, idx, id, value): the documents at the wanted revisions, from the nearest snapshot and the patches behind it."""
    at = nearest(wanted, every)
    rows = at.join(kept, [*keys, "snapshot"]).select(*keys, F.col("rev").alias("_wanted"), "id", "value", "since")
    later = at.withColumnRenamed("rev", "_wanted").join(log, keys).where("rev > snapshot AND rev <= _wanted").select(*keys, "_wanted", "rev", "id", "removed", "value")
    return patched(rows, later, [*keys, "_wanted"]).withColumnRenamed("_wanted", "rev")
