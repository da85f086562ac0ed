"""Starts of cues moved forward to the onset of speech that their sound shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .once import once

#: Milliseconds of a level, levels of a bin by which cues meet their sound, and levels after a start that tell how loud speech is.
STEP, BIN, AFTER = 10, 128, 30
#: The faintest speech, and the least move that is made.
FAINTEST, LEAST_MS = 0.002, 15


def snapped(levels: DataFrame, cues: DataFrame, key: list[str], window_ms: int = 1000, pre_roll_ms: int = 0, sensitivity: int = 50) -> DataFrame:
    """(key, cue, original_ms, snapped_ms, offset_ms, confidence) of the cues whose start moves.

    Levels are rows (k, rms) of 10 ms, cues rows (cue, start_ms, minimum_ms); a start is never moved before its minimum,
    which is where the cue before it ends, nor further back than the window. An onset is a level with at least half of
    the four levels before it below a threshold between the noise before the start and the speech behind it, and four
    of the six from it on above, half as loud again. The one of the highest confidence is taken, of equal ones the last.
    Levels and cues meet by bins of levels, so a cue reads the 1.3 seconds around it however long the sound is.
    """
    factor = 2 ** ((50 - max(0, min(100, sensitivity))) / 50)
    window, pre_roll, faintest = max(100, min(1000, window_ms)), max(0, min(100, pre_roll_ms)), FAINTEST * factor
    long = levels.groupBy(*key).agg(((F.max("k") + 1) * STEP).alias("_long"))
    c = cues.join(long, key).withColumn("original_ms", F.least("_long", F.greatest(F.lit(0), "start_ms")).cast("long"))
    c = c.withColumn("_least", F.least("original_ms", F.greatest(F.lit(0), "minimum_ms"))).withColumn("_from", F.greatest(F.col("_least"), F.col("original_ms") - window))
    c = c.where(F.col("original_ms") - F.col("_from") >= 4 * STEP).withColumn("_first", F.expr(f"_from div {STEP}"))
    c = c.withColumn("_end", F.expr(f"(least(_long, original_ms + {AFTER * STEP}) + {STEP - 1}) div {STEP}"))
    own = c.select(*key, "cue", "original_ms", "_least", "_first", "_end", F.explode(F.expr(f"sequence(_first div {BIN}, (_end - 1) div {BIN})")).alias("_bin"))
    met = own.join(levels.select(*key, F.col("k").alias("_k"), F.col("rms").cast("double").alias("_rms"), F.expr(f"k div {BIN}").alias("_bin")), [*key, "_bin"]).where("_k >= _first AND _k < _end")
    got = met.groupBy(*key, "cue", "original_ms", "_least", "_first").agg(F.sort_array(F.collect_list(F.struct("_k", "_rms"))).alias("_raw")).withColumn("_raw", F.col("_raw._rms"))
    smooth = "if(size(_raw) < 3, _raw, transform(_raw, (x, i) -> transform(array(slice(_raw, greatest(1, i), if(i = 0, 2, 3))), near -> aggregate(near, 0D, (s, y) -> s + y) / size(near))[0]))"
    got = once(got, _r=F.expr(smooth), _at=F.expr(f"cast(least(size(_raw), greatest(0, bround((original_ms - _first * {STEP}) / {STEP}))) AS int)"))
    part = lambda values, share: f"""transform(array(array_sort({values})), v -> if(size(v) = 0, 0D, transform(array({share} * (size(v) - 1)), p -> if(floor(p) = ceil(p), v[cast(p AS int)],
      v[cast(floor(p) AS int)] * (1.0D - (p - floor(p))) + v[cast(ceil(p) AS int)] * (p - floor(p))))[0]))[0]"""  # noqa: E731
    got = once(got, _post=F.expr(f"slice(_r, _at + 1, {AFTER})")).where("size(_post) >= 5")
    got = once(got, _loud=F.expr(part("_post", "0.75D")), _noise=F.expr(part("slice(_r, 1, _at)", "0.25D"))).where(F.col("_loud") >= faintest)
    base = f"greatest({FAINTEST}D, least(_loud * 0.45D, greatest(_noise * 2.2D, _loud * 0.12D)))"
    got = once(got, _limit=F.expr(f"least(_loud * 0.9D, greatest({faintest!r}D, {base} * {factor!r}D))"))
    mean = lambda a: f"aggregate({a}, 0D, (s, y) -> s + y) / size({a})"
    facts = f"""transform(if(least(_at, size(_r) - 7) < 4, cast(array() AS array<int>), sequence(4, least(_at, size(_r) - 7))), i -> transform(array(named_struct('q', slice(_r, i - 3, 4), 'v', slice(_r, i + 1, 6))), w -> named_struct('i', i,
      'quiet', size(filter(w.q, y -> y < _limit)) / 4D, 'voiced', size(filter(w.v, y -> y >= _limit)) / 6D, 'mean', {mean("w.v")}, 'contrast', ({mean("w.v")}) / greatest({mean("w.q")}, 0.0001D)))[0])"""
    onset = f"array_max(transform(filter({facts}, f -> f.quiet >= 0.5D AND f.voiced >= 2D / 3D AND f.mean >= _limit AND f.contrast >= 1.5D), f -> named_struct('confidence', least(1D, 0.4D * f.quiet + 0.35D * f.voiced + 0.25D * least(f.contrast / 4D, 1D)), 'i', f.i)))"
    got = once(got, _onset=F.expr(onset)).where("_onset IS NOT NULL")
    got = got.withColumn("snapped_ms", F.greatest(F.col("_least"), (F.col("_first") + F.col("_onset.i")) * STEP - pre_roll).cast("long")).withColumn("offset_ms", F.col("original_ms") - F.col("snapped_ms"))
    return got.where(F.col("offset_ms") >= LEAST_MS).select(*key, "cue", "original_ms", "snapped_ms", "offset_ms", F.round("_onset.confidence", 3).alias("confidence"))


def barrier(previous_start: str, previous_end: str, start: str):
    """Where the search for a cue's onset ends: at the end of the cue before it, or at its start where the two overlap."""
    return F.when(F.col(previous_end).isNull(), F.lit(0)).otherwise(F.greatest(F.col(previous_start), F.least(previous_end, start)))
