"""Cues split at a token and merged with their neighbour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .transcripts import joined

#: The shortest cue that a split leaves, in milliseconds.
LEAST = 1


def split(tokens: DataFrame, cues: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, first_n, last_n, start_ms, end_ms, text, cue_id): both parts of each cue that is split after its token ``after_n``.

    Tokens have n, text, start_ms and end_ms (null if unknown); cues have start_ms, end_ms and after_n. A pause at the
    seam belongs to neither part. If the tokens' times overlap there, or a side has none, the parts meet halfway between
    the edges that there are. Both parts last a millisecond at least. A cue that has no token on one side isn't split.
    The right part's id is a digest of its key and place, the left one keeps its own (null).
    """
    t = tokens.join(cues.select(*key, F.col("start_ms").alias("_start"), F.col("end_ms").alias("_end"), "after_n"), key).withColumn("part", (F.col("n") > F.col("after_n")).cast("int"))
    own = t.groupBy(*key, "part", "_start", "_end", "after_n").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"), F.min("start_ms").alias("a"), F.max("end_ms").alias("z"), F.sort_array(F.collect_list(F.struct("n", "text"))).alias("_t"))
    w = Window.partitionBy(*key)
    both = own.withColumns({"parts": F.count("*").over(w), "left": F.max(F.when(F.col("part") == 0, F.col("z"))).over(w), "right": F.max(F.when(F.col("part") == 1, F.col("a"))).over(w)}).where("parts = 2")
    within = lambda c, low: F.least(F.greatest(c, low), F.col("_end") - LEAST)
    lowest = F.col("_start") + LEAST
    middle = within(F.coalesce((F.col("left") + F.col("right")) / 2, (F.col("_start") + F.col("_end")) / 2), lowest)
    apart = F.coalesce(F.col("left") <= F.col("right"), F.lit(False))
    left = F.when(apart, within(F.col("left"), lowest)).otherwise(middle)
    right = F.when(apart, within(F.col("right"), left)).otherwise(middle)
    double = lambda c: c.cast("double")
    name = F.when(F.col("part") == 1, F.concat(F.lit("cue_"), F.substring(F.sha2(F.concat_ws("/", *[F.col(k).cast("string") for k in key], F.col("after_n").cast("string"), F.lit("right")), 256), 1, 24)))
    return both.select(*key, "part", "first_n", "last_n", F.when(F.col("part") == 0, double(F.col("_start"))).otherwise(double(right)).alias("start_ms"), F.when(F.col("part") == 0, double(left)).otherwise(double(F.col("_end"))).alias("end_ms"),
                       F.array_join("_t.text", " ").alias("text"), name.alias("cue_id"))


def worst(*states: Column) -> Column:
    """The state of a joined translation: what must be done by hand comes before what needs a look."""
    has = lambda s: F.coalesce(*[F.when(c == s, F.lit(s)) for c in states])
    return F.coalesce(has("manual_required"), has("needs_review"), F.lit("translated"))


def merge(cues: DataFrame, key: list[str], order: str, chosen: Column) -> DataFrame:
    """Cues after merging each chosen one with its follower: (key, order, start_ms, end_ms, speaker, text, target, status, sources, n).

    Reads start_ms, end_ms, speaker, text, target and status (null without a translation) and grp. A chosen cue whose
    predecessor took it in merges no further. The time reaches from the left's start to the right's end; the speaker
    stays if both agree. A single translation is kept; two equal ones are copies and stay one; others are joined, with
    the worse state. ``sources`` are the distinct groups in order, ``n`` the new place.
    """
    w = Window.partitionBy(*key).orderBy(order)
    after = lambda c: F.lead(c).over(w)
    c = cues.withColumn("_pick", chosen & F.lead(order).over(w).isNotNull())
    # in a run of chosen cues every second one is taken in by the one before it
    run = F.sum((~F.col("_pick")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    c = c.withColumn("_run", run).withColumn("_takes", F.col("_pick") & (F.row_number().over(Window.partitionBy(*key, "_run", "_pick").orderBy(order)) % 2 == 1))
    c = c.withColumns({f"_{x}": after(x) for x in ("end_ms", "speaker", "text", "target", "status", "grp")}).withColumn("_taken", F.coalesce(F.lag("_takes").over(w), F.lit(False)))
    takes = F.col("_takes")
    target = F.when(F.col("target").isNull(), F.col("_target")).when(F.col("_target").isNull() | (F.col("target") == F.col("_target")), F.col("target")).otherwise(joined(F.col("target"), F.col("_target")))
    status = F.when(F.col("target").isNull() & F.col("_target").isNull(), F.lit(None)).otherwise(worst(F.col("status"), F.col("_status")))
    merged = {
        "end_ms": F.col("_end_ms"), "speaker": F.when(F.col("speaker") == F.col("_speaker"), F.col("speaker")), "text": joined(F.col("text"), F.col("_text")), "target": target, "status": status,
        "sources": F.array_distinct(F.array("grp", "_grp")),
    }
    alone = {**{x: F.col(x) for x in merged if x != "sources"}, "sources": F.array("grp")}
    out = c.where("NOT _taken").select(*key, order, "start_ms", *[F.when(takes, merged[x]).otherwise(alone[x]).alias(x) for x in merged], takes.alias("merged"))
    return out.withColumn("n", (F.row_number().over(w) - 1).cast("long"))
