"""Transcripts that overlap or repeat each other: the seam of two neighbours, short texts found in a long one, and alignment by sound."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once

#: Words of Latin letters and digits with inner apostrophes, and single Han, kana and Hangul characters.
TOKEN = r"[A-Za-zÀ-ÖØ-öø-ÿ0-9]+(?:['’][A-Za-zÀ-ÖØ-öø-ÿ0-9]+)*|[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Tokens of the left text's end and of the right text's beginning among which a seam is looked for.
REACH = 500


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), lambda t: F.lower(F.translate(t, "’", "'")))


def seam(tail: list[str], head: list[str]) -> tuple[int, int, int, int] | None:
    """(size, i, j, away) of the best run of tokens that the tail has from i on and the head from j on; None if they share no token."""
    places: dict[str, list[int]] = {}
    for j, token in enumerate(head):
        places.setdefault(token, []).append(j)
    whole, best = len(tail) + len(head), None
    # runs that end at the token before, by their place in the head; one that isn't continued is as long as it gets
    running: dict[int, int] = {}
    for i in range(len(tail) + 1):
        longer = {j: running.get(j - 1, 0) + 1 for j in places.get(tail[i], ())} if i < len(tail) else {}
        for j, size in running.items():
            if j + 1 not in longer:
                a, b = i - size, j - size + 1
                away = len(tail) - i + b
                # whole numbers: the score times the tokens of both stretches
                found = (size * whole - 3 * away, -a, -b, size, away)
                best = found if best is None or found > best else best
        running = longer
    return best and (best[3], -best[1], -best[2], best[4])


def seams(pairs: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """(key, status, confidence, matched, left_at, right_at, left_rest, right_rest): where two overlapping texts (left, right) meet best.

    Of all runs of tokens that the left's end and the right's beginning share, longest as they stand, the best is long
    and near the seam: its tokens, less three times the share of both stretches that lies between it and the seam. Ties
    go to the earlier place, left first. Each row is judged on its own, where it stands; runs grow token by token along
    places of equal tokens, so unequal ones are never compared. The confidence is in ten thousandths.
    """
    return _with_seams(pairs, reach).select(*key, *_SEAM)


_SEAM = ["status", "confidence", "matched", "left_at", "right_at", "left_rest", "right_rest"]


def _with_seams(pairs: DataFrame, reach: int) -> DataFrame:
    """The rows with the columns of their seam."""

    @F.pandas_udf("size int, i int, j int, away int")
    def best(tail: pd.Series, head: pd.Series) -> pd.DataFrame:
        got = [seam(a.split("\n") if a else [], b.split("\n") if b else []) or (None,) * 4 for a, b in zip(tail, head, strict=True)]
        return pd.DataFrame(got, columns=["size", "i", "j", "away"], dtype="Int32")

    own = once(pairs, _l=tokens(F.col("left")), _r=tokens(F.col("right")))
    # tokens have no line ends
    tail, head = F.slice("_l", F.greatest(F.lit(1), F.size("_l") - reach + 1), reach), F.slice("_r", 1, reach)
    own = once(own, _nl=F.size("_l"), _nr=F.size("_r"), _tail=F.array_join(tail, "\n"), _head=F.array_join(head, "\n")).drop("_l", "_r")
    out = own.withColumn("_b", best("_tail", "_head")).drop("_tail", "_head")
    nl, nr, size = F.col("_nl"), F.col("_nr"), F.col("_b.size")
    both = F.least(nl, F.lit(reach)) + F.least(nr, F.lit(reach))
    quality = F.greatest(F.lit(0), both - F.col("_b.away")) / both
    confidence = F.when(nl * nr == 0, 10_000).when(size.isNull(), 0).otherwise(F.floor(F.least(F.lit(1.0), size / 8 * 0.65 + quality * 0.35) * 10_000 + 0.5))
    status = F.when(nl == 0, "right_only").when(nr == 0, "left_only").when(size.isNull(), "no_anchor").when((size >= 3) & (confidence >= 4500), "merged").otherwise("weak_anchor")
    at = F.greatest(F.lit(0), nl - reach) + F.col("_b.i")
    return out.withColumns({
        "status": status, "confidence": confidence.cast("long"), "matched": F.coalesce(size.cast("long"), F.lit(0)), "left_at": at.cast("long"), "right_at": F.col("_b.j").cast("long"),
        "left_rest": (nl - at - size).cast("long"), "right_rest": F.col("_b.j").cast("long"),
    }).drop("_nl", "_nr", "_b")


def joined(left: Column, right: Column) -> Column:
    """Two texts with a space between them, but for marks and characters that stand together."""
    l, r = F.trim(left), F.trim(right)  # noqa: E741
    tight = r.rlike(r"^[，。！？、；：,.!?;:%)\]}”’》〉」』]") | l.rlike(r"[(\[{“‘《〈「『]$") | l.rlike(r"[\x{3400}-\x{9FFF}]$") & r.rlike(r"^[\x{3400}-\x{9FFF}]")
    return F.when(l == "", r).when(r == "", l).when(tight, F.concat(l, r)).otherwise(F.concat_ws(" ", l, r))


def merged(pairs: DataFrame, key: list[str], reach: int = REACH) -> DataFrame:
    """Pairs with their seam and the merged text: the left one to the middle of the anchor, the right one from behind it."""
    got = _with_seams(pairs, reach)
    middle = F.expr("greatest(0, (matched - 1) div 2)").cast("int")

    def stretch(text: str, first: Column | int, size: Column, after: bool) -> Column:
        """Tokens from a place on, each with what stands before or after it."""
        toks, seps = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), F.split(text, TOKEN, -1)
        each = F.zip_with(F.slice(toks, first + 1, size), F.slice(seps, first + 1 + int(after), size), (lambda t, s: F.concat(t, s)) if after else (lambda t, s: F.concat(s, t)))
        return F.array_join(each, "")

    begun = stretch("left", F.lit(0), (F.col("left_at") + middle + 1).cast("int"), False)
    ended = stretch("right", (F.col("right_at") + middle + 1).cast("int"), F.length("right") + 1, True)
    # joined names its texts many times
    anchored = F.col("left_at").isNotNull()
    got = once(got, _begun=F.when(anchored, begun), _ended=F.when(anchored, ended))
    text = F.when(F.col("status") == "right_only", F.trim("right")).when(F.col("status") == "left_only", F.trim("left")).when(F.col("status") == "no_anchor", joined(F.col("left"), F.col("right")))
    return got.withColumn("text", text.otherwise(joined(F.col("_begun"), F.col("_ended")))).drop("_begun", "_ended")


def chain(own: list[str], window: list[str]) -> tuple[int, int, int]:
    """(first, last, got) of the longest chain of equal tokens that increases in both lists, the one with the earliest ends; got 0 if there is none."""
    places: dict[str, list[int]] = {}
    for j in range(len(window) - 1, -1, -1):
        places.setdefault(window[j], []).append(j)
    # lasts[k] is the smallest end of a chain of k + 1 tokens, firsts[k] its start; places of one token come from the back
    lasts: list[int] = []
    firsts: list[int] = []
    for token in own:
        for j in places.get(token, ()):
            k = bisect_left(lasts, j)
            first = firsts[k - 1] if k else j
            if k == len(lasts):
                lasts.append(j)
                firsts.append(first)
            else:
                lasts[k], firsts[k] = j, first
    return (firsts[-1], lasts[-1], len(lasts)) if lasts else (0, 0, 0)


def located(masters: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, first_token, last_token, matched, tokens, coverage, status) of short texts in the long one that they were cut from.

    Masters have a text and its total_ms, parts a number, a text, and start_ms and end_ms of the sound it belongs to,
    which say about where it stands: a window of the master that is a twelfth (80 tokens at least) wider on both sides.
    A part's place is that of the longest increasing chain of equal tokens, the chain with the earliest ends if there
    are several. Of a chain less than three tokens long, or under 0.45 of the part, the match is weak; a part without
    any has the place that its times give. Coverage is in ten thousandths.
    """
    own = parts.groupBy(*key).agg(F.collect_list(F.struct("part", "start_ms", "end_ms", "text")).alias("_parts"))
    both = own.join(masters.select(*key, "total_ms", F.col("text").alias("_text")), key)
    p = once(both, master=tokens(F.col("_text"))).select(*key, "total_ms", "master", F.inline("_parts"))
    p = once(p, n=F.size("master"), own=tokens(F.col("text")))
    place = lambda ms: F.bround(F.col("n") * F.col(ms) / F.greatest(F.col("total_ms"), F.lit(1))).cast("int")
    p = p.withColumns({"expected_start": place("start_ms"), "expected_end": place("end_ms"), "margin": F.greatest(F.lit(80), F.bround(F.col("n") * 0.08).cast("int"))})
    p = p.withColumns({"low": F.greatest(F.lit(0), F.col("expected_start") - F.col("margin")), "high": F.least("n", F.col("expected_end") + F.col("margin"))})
    # tokens have no line ends; only a part's window goes on from here, not its master
    window = F.array_join(F.slice("master", F.col("low") + 1, F.greatest(F.lit(0), F.col("high") - F.col("low"))), "\n")
    p = once(p.select(*key, "part", "n", "expected_start", "expected_end", "low", "high", "own", "master"), said=F.array_join("own", "\n"), size=F.size("own"), window=window).drop("own", "master")

    @F.pandas_udf("first int, last int, got int")
    def chains(own: pd.Series, window: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([chain(a.split("\n") if a else [], b.split("\n") if b else []) for a, b in zip(own, window, strict=True)], columns=["first", "last", "got"], dtype="int32")

    out = p.withColumn("found", chains("said", "window"))
    out = out.select(*key, "part", "n", "expected_start", "expected_end", "low", F.col("size").alias("_size"), "found.*")
    got, size = F.col("got"), F.col("_size")
    none = got == 0
    covered = F.when(size > 0, F.floor(got * 10_000 / size + 0.5)).otherwise(0)
    status = F.when(none, "proportional_fallback").when((got >= 3) & (got * 100 >= size * 45), "matched").otherwise("weak")
    first = F.least("n", F.when(none, F.col("expected_start")).otherwise(F.col("low") + F.col("first")))
    return out.select(*key, "part", first.cast("long").alias("first_token"), F.greatest(first, F.least("n", F.when(none, F.col("expected_end")).otherwise(F.col("low") + F.col("last") + 1))).cast("long").alias("last_token"),
                      got.cast("long").alias("matched"), size.cast("long").alias("tokens"), covered.cast("long").alias("coverage"), status.alias("status"), F.col("n").cast("long").alias("n"), F.least("n", "expected_end").cast("long").alias("expected_end"))


def bounds(places: DataFrame, key: list[str]) -> DataFrame:
    """(key, part, cut): the token before which each part but the first begins, ascending, so that the parts cover the master once.

    Between two matched neighbours the cut lies halfway between them, else where the times put it; each part keeps a
    token at least if there are enough. Cuts ascend through a running maximum of what each leaves for those before it.
    """
    return with_cuts(places, key).where("cut IS NOT NULL").select(*key, "part", "cut")


def with_cuts(places: DataFrame, key: list[str]) -> DataFrame:
    """The places with their cut as bounds has it; null for the last part."""
    w = Window.partitionBy(*key).orderBy("part")
    rest = Window.partitionBy(*key)
    nxt = lambda c: F.lead(c).over(w)
    sure = (F.col("status") == "matched") & (nxt("status") == "matched")
    wish = F.when(sure, F.bround((F.col("last_token") + nxt("first_token")) / 2).cast("long")).otherwise(F.col("expected_end"))
    own = places.withColumns({"_k": F.row_number().over(w).cast("long"), "_parts": F.count("*").over(rest), "_wish": wish})
    # the least cut that leaves each earlier part one token, and the last that leaves each later one
    held = F.least(F.col("_wish"), F.col("n") - (F.col("_parts") - F.col("_k")))
    reached = F.max(held - F.col("_k")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + F.col("_k")
    return own.withColumn("cut", F.when(F.col("_k") < F.col("_parts"), F.greatest(reached, F.col("_k")))).drop("_k", "_parts", "_wish")


def aligned(spans: DataFrame) -> DataFrame:
    """Spans (a, b: arrays of text and sound) with the cost of the cheapest alignment and its steps.

    A step is e (equal) or r (replaced), which cost nothing, one (the same sound) or four; or d (deleted) or i
    (inserted), which cost four. From the end on, the first of these that the cheapest way allows is taken. One fold over
    a's tokens holds a row of the table; spans should be short, for the table is as large as the product of both.
    """
    cell = """transform(array(named_struct('diagonal', r[j - 1].cost + if(x.text = b[j - 1].text, 0, if(coalesce(x.sound = b[j - 1].sound, false), 1, 4)), 'up', r[j].cost + 4, 'left', acc[j - 1].cost + 4)),
      c -> if(c.diagonal <= c.up AND c.diagonal <= c.left, named_struct('cost', c.diagonal, 'steps', concat(r[j - 1].steps, if(x.text = b[j - 1].text, 'e', 'r'))),
        if(c.up <= c.left, named_struct('cost', c.up, 'steps', concat(r[j].steps, 'd')), named_struct('cost', c.left, 'steps', concat(acc[j - 1].steps, 'i')))))[0]"""
    row = f"aggregate(if(size(b) > 0, sequence(1, size(b)), cast(array() AS array<int>)), array(named_struct('cost', r[0].cost + 4, 'steps', concat(r[0].steps, 'd'))), (acc, j) -> concat(acc, array({cell})))"
    first = "transform(sequence(0, size(b)), j -> named_struct('cost', 4 * j, 'steps', repeat('i', j)))"
    got = F.expr(f"element_at(aggregate(a, {first}, (r, x) -> {row}), -1)")
    return once(spans, best=got).withColumns({"cost": F.col("best.cost").cast("long"), "steps": F.col("best.steps")}).drop("best")


# Vowels with the marks of the four tones, and what they are without.
TONED, TONELESS = "āáǎàēéěèīíǐìōóǒòūúǔùǖǘǚǜü", "aaaaeeeeiiiioooouuuuvvvvv"


def sound_key(text: Column) -> Column:
    """The syllables of a romanised word without their tones; null for what has other characters than letters."""
    plain = F.translate(F.lower(text), TONED, TONELESS)
    return F.when(plain.rlike("^[a-zçêëâîïôûœæñß]+$"), plain)
