"""Bounded shortest paths over the units of a document: execution blocks of a bounded duration, and the cheapest line breaks of a group.

Blocks are one fold over the candidate boundaries of a document, in Spark's own expressions. The fold holds only the
boundaries that a later one can still reach, so its state is as wide as the longest block, not as the document. Line
breaks are found for many groups at a time, boundary by boundary, on arrays of what Spark has summed up at each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import rules
from .once import once

_PATH = "struct<cost:bigint,path:array<bigint>>"
#: Groups whose line breaks are worked out at a time; what a unit of cost counts beside a cue, and the value of no way.
GROUPS = 8192
_CUE, _NONE = 1 << 24, 1 << 62
_WHOLE = ["n", "start_ms", "end_ms", "next_start", "chars", "all_words", "letters", "han", "cut_cost", "dangling_k"]
_TRUTHS = ["called", "free"]


def boundaries(units: DataFrame, key: list[str]) -> DataFrame:
    """Units with what the boundary after each offers: where the next block starts, whether it is the document's last, and its bonus.

    Reads n (order), start_ms, end_ms, speaker, conf (hundredths) and quiet. The bonus is in milliseconds of distance:
    150 seconds for another speaker of whom both sides are sure, 70 for each second of pause up to two, 65 for quiet.
    """
    w = Window.partitionBy(*key).orderBy("n")
    after = lambda c: F.lead(c).over(w)
    gap = F.greatest(F.lit(0), after("start_ms") - F.col("end_ms"))
    other = (F.col("speaker") != after("speaker")) & (F.least("conf", after("conf")) >= 75)
    bonus = F.when(other, 150_000).otherwise(0) + F.least(gap, F.lit(2000)) * 70 + F.when(F.col("quiet"), 65_000).otherwise(0)
    return units.withColumns({"next_start": after("start_ms"), "last": after("n").isNull(), "bonus": F.coalesce(bonus, F.lit(0)).cast("long")})


def _bounded(target: int, least: int, most: int) -> Column:
    """The cheapest path of blocks within the limits, as the places of its boundaries; null if there is none.

    A block costs a thousand a millisecond off the target, and the boundary after it one more, less its bonus. Of equal
    paths the one with the earliest boundaries is taken.
    """
    took = "x.end_ms - o.from_ms"
    option = f"""transform(filter(s.open, o -> {took} BETWEEN {least} AND {most}), o -> named_struct(
      'cost', o.cost + 1000 * abs({took} - {target}) + if(x.last, 0, abs({took} - {target}) - x.bonus), 'path', if(x.last, o.path, concat(o.path, array(x.n)))))"""
    kept = f"filter(s.open, o -> o.from_ms >= x.later_end - {most})"
    step = f"""transform(array(array_min({option})), b -> named_struct(
      'open', if(b IS NULL OR x.last, {kept}, concat({kept}, array(named_struct('from_ms', x.next_start, 'cost', b.cost, 'path', b.path)))), 'best', b))[0]"""
    start = f"named_struct('open', array(named_struct('from_ms', first_start, 'cost', 0L, 'path', cast(array() AS array<bigint>))), 'best', cast(NULL AS {_PATH}))"
    return F.expr(f"aggregate(nodes, {start}, (s, x) -> {step}, s -> s.best.path)")


def _nearest(target: int, least: int, most: int) -> Column:
    """The places of boundaries picked one after another, for documents that no path within the limits covers.

    While more than the longest block is left, the boundary with the best score near the target is taken: of those that
    leave room for the blocks to come, else of those within the limits, else of all.
    """
    r = "s.blocks"
    goal = f"if({r} > 1, {r}, 1)"
    # distances and bonuses are multiplied by the number of blocks left, so that shares of the rest stay whole numbers
    away = f"abs(x.end_ms * {goal} - if({r} > 1, s.from_ms * {r} + finish - s.from_ms, s.from_ms + {target}))"
    fits = f"x.end_ms - s.from_ms BETWEEN {least} AND {most}"
    room = f"if({r} > 1, finish - x.next_start BETWEEN {least} * ({r} - 1) AND {most} * ({r} - 1), finish - x.next_start >= {least})"
    pick = f"""array_max(transform(filter(nodes, x -> NOT x.last AND x.n > s.prev), x -> named_struct('tier', CASE WHEN {fits} AND {room} THEN 2 WHEN {fits} THEN 1 ELSE 0 END,
      'score', x.bonus * {goal} - {away}, 'near', -{away}, 'first', -x.n, 'n', x.n, 'next_start', x.next_start)))"""
    step = f"""if(s.done OR finish - s.from_ms <= {most}, named_struct('prev', s.prev, 'from_ms', s.from_ms, 'blocks', {r}, 'path', s.path, 'done', true),
      transform(array({pick}), b -> if(b IS NULL, named_struct('prev', s.prev, 'from_ms', s.from_ms, 'blocks', {r}, 'path', s.path, 'done', true),
        named_struct('prev', b.n, 'from_ms', b.next_start, 'blocks', greatest(1, {r} - 1), 'path', concat(s.path, array(b.n)), 'done', false)))[0])"""
    total = "(finish - first_start)"
    fewest, many = f"greatest(1, ceil({total} / {most}))", f"greatest(1, floor({total} / {least}))"
    blocks = f"cast(if({fewest} <= {many}, least({many}, greatest({fewest}, bround({total} / {target}))), 0) AS bigint)"
    start = f"named_struct('prev', -1L, 'from_ms', first_start, 'blocks', {blocks}, 'path', cast(array() AS array<bigint>), 'done', false)"
    return F.expr(f"aggregate(sequence(1, size(nodes)), {start}, (s, i) -> {step}, s -> s.path)")


def execution_blocks(units: DataFrame, key: list[str], target: int = 90_000, least: int = 75_000, most: int = 100_000) -> DataFrame:
    """(key, block, first_n, last_n, start_ms, end_ms, bounded, exception): blocks that cover each document, cut only where ``cut`` is true.

    The blocks are the cheapest ones within the limits if there are such, else picked one by one, as ``bounded`` tells.
    An exception is a block outside the limits in a document longer than one block may be. A document's candidate
    boundaries stand in one row.
    """
    rows = boundaries(units, key)
    later = F.min("end_ms").over(Window.partitionBy(*key).orderBy("n").rowsBetween(1, Window.unboundedFollowing))
    rows = rows.withColumn("later_end", F.coalesce(later, F.col("end_ms")))
    node = F.struct(*[F.col(c).cast("long").alias(c) for c in ("n", "end_ms", "next_start")], "last", "bonus", F.col("later_end").cast("long").alias("later_end"))
    first = F.struct("n", "start_ms")
    docs = rows.groupBy(*key).agg(F.sort_array(F.collect_list(F.when(F.col("cut") | F.col("last"), node))).alias("nodes"), F.min(first).alias("first"), F.max(F.struct("n", "end_ms")).alias("end"))
    docs = docs.withColumns({"first_n": F.col("first.n").cast("long"), "first_start": F.col("first.start_ms").cast("long"), "last_n": F.col("end.n").cast("long"), "finish": F.col("end.end_ms").cast("long")})
    docs = once(once(docs, shortest=_bounded(target, least, most)), path=F.when(F.col("shortest").isNull(), _nearest(target, least, most)).otherwise(F.col("shortest")))
    seams = F.expr("concat(array(named_struct('n', first_n - 1, 'end_ms', 0L, 'next_start', first_start)), transform(path, p -> filter(transform(nodes, x -> named_struct('n', x.n, 'end_ms', x.end_ms, 'next_start', x.next_start)), x -> x.n = p)[0]), array(named_struct('n', last_n, 'end_ms', finish, 'next_start', 0L)))")
    cut = docs.select(*key, (F.col("finish") - F.col("first_start")).alias("total"), F.col("shortest").isNotNull().alias("bounded"), seams.alias("seams"))
    block = F.expr("transform(sequence(1, size(seams) - 1), k -> named_struct('block', cast(k AS bigint), 'first_n', seams[k - 1].n + 1, 'last_n', seams[k].n, 'start_ms', seams[k - 1].next_start, 'end_ms', seams[k].end_ms))")
    out = cut.select(*key, "total", "bounded", F.explode(block).alias("b")).select(*key, "total", "bounded", "b.*")
    took = F.col("end_ms") - F.col("start_ms")
    return out.withColumn("exception", (F.col("total") > most) & ~took.between(least, most)).drop("total")


def cuts(units: DataFrame, key: list[str]) -> DataFrame:
    """Units with what a cut after each would cost, in tenths, and whether the rules allow it.

    Reads n (order within key), text (without its marks), marks (what follows the text), start_ms, end_ms and breaks
    (whether a line ends there already). No cut parts units of one time, a place from its country, a word from the
    hyphen's other half, a verb from its particle or an expression; the last two only where nothing separates them.
    """
    w = Window.partitionBy(*key).orderBy("n")
    found = F.regexp_extract_all("text", F.lit(rules.ENGLISH_WORD), F.lit(0))
    rows = units.withColumn("english", found).withColumn("bare", F.when(F.size("english") == 1, F.lower(F.translate(F.col("english")[0], "’", "'"))).otherwise(""))
    at = lambda c, k: F.lead(c, k).over(w) if k > 0 else F.lag(c, -k).over(w)
    bare = {k: F.coalesce(at("bare", k), F.lit("")) if k else F.col("bare") for k in (-1, 0, 1, 2)}
    phrase = lambda a, z: F.concat_ws(" ", *[bare[k] for k in range(a, z + 1)])
    gap = F.greatest(F.lit(0), at("start_ms", 1) - F.col("end_ms"))
    ended = F.col("marks").rlike(rules.TERMINAL)
    together = phrase(0, 1).isin(rules.EXPRESSIONS) | phrase(-1, 1).isin(rules.EXPRESSIONS) | phrase(0, 2).isin(rules.EXPRESSIONS)
    guarded = F.col("text").rlike("[-‐‑‒]$") | ~ended & (gap < 400) & (bare[1].isin(rules.PARTICLES) | together)
    place = F.lower(at("text", 1)).isin(rules.COUNTRIES) & F.col("text").rlike("^[A-Z]") & F.col("marks").contains(",")
    shared = (at("start_ms", 1) == F.col("start_ms")) & (at("end_ms", 1) == F.col("end_ms"))
    incomplete = ~ended & bare[0].isin(rules.DEPENDENT)
    cost = F.when(F.col("breaks"), -25).otherwise(0) + F.when(ended, -90).when(F.col("marks").rlike(rules.CLAUSE), -40).otherwise(0) + F.when(gap >= 400, -80).when(gap >= 200, -40).when(gap >= 80, -15).otherwise(0)
    last_word = F.lower(F.translate(F.expr("try_element_at(english, -1)"), "’", "'"))
    return rows.withColumns({
        "guarded": F.coalesce(guarded, F.lit(False)), "place": F.coalesce(place, F.lit(False)), "shared": F.coalesce(shared, F.lit(False)), "legal": ~F.coalesce(guarded | place | shared, F.lit(False)), "incomplete": incomplete, "cut_cost": F.when(at("n", 1).isNull(), 0).otherwise(cost).cast("long"),
        "words": F.size("english").cast("long"), "dangling": F.when(F.size("english") > 0, last_word.isin(rules.DANGLING)), "next_start": at("start_ms", 1),
    }).drop("english", "bare")


def line_breaks(units: DataFrame, key: list[str], group: list[str], english: int = rules.ENGLISH_LIMIT, other: int = rules.OTHER_LIMIT, shortest: int = rules.SHORTEST, most_cues: int | None = None, incomplete: bool = False) -> DataFrame:
    """(key, group, cues, cost, breaks): the cheapest cuts of each group into cues that fit the limits, as places n; null if none do.

    The cost is in tenths: 15 a cue, what the cuts cost, and what short lines, lone words and brief cues cost. The best way
    to each boundary is kept for each number of cues, since the cheaper way may use cues that ``most_cues`` doesn't
    leave; of equal ways the one with the earlier boundary before, at the end the one with fewer cues. A group's units
    stand in one row, GROUPS groups are worked out at a time.
    """
    own = Window.partitionBy(*key, *group).orderBy("n")
    upto = lambda c: F.sum(c).over(own.rowsBetween(Window.unboundedPreceding, 0)).cast("long")
    rows = cuts(units, key).withColumn("shown", F.concat("text", "marks")).withColumn("k", F.row_number().over(own).cast("long"))
    rows = rows.withColumns({
        "chars": upto(F.length("shown") + 1), "all_words": upto("words"), "letters": upto(F.regexp_count("shown", F.lit("[A-Za-z]"))), "han": upto(F.regexp_count("shown", F.lit(r"[\x{3400}-\x{9FFF}]"))),
        "called": F.col("shown").rlike("[?!？！]$"), "free": F.col("legal") & (F.lit(incomplete) | ~F.col("incomplete")),
        "dangles": F.last(F.when(F.col("words") > 0, F.struct("k", "dangling")), True).over(own.rowsBetween(Window.unboundedPreceding, 0)),
    })
    whole = [F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c) for c in _WHOLE if c != "dangling_k"]
    dangling = F.coalesce(F.when(F.col("dangles.dangling"), F.col("dangles.k")), F.lit(0)).alias("dangling_k")
    unit = F.struct("k", *whole, dangling, *[F.coalesce(F.col(c), F.lit(False)).alias(c) for c in _TRUTHS])
    groups = rows.groupBy(*key, *group).agg(F.sort_array(F.collect_list(unit)).alias("units"))
    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in groups.schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(k, GROUPS) for x in batches for k in range(0, x.num_rows, GROUPS)):
            found = _cheapest(b.column(b.num_columns - 1), english, other, shortest, most_cues)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *found], names=[*b.schema.names[:-1], "cues", "cost", "breaks"])

    return groups.mapInArrow(run, ", ".join([*kinds, "cues long", "cost long", "breaks array<long>"]))


def _cheapest(units: pa.ListArray, english: int, other: int, shortest: int, most: int | None) -> list[pa.Array]:
    """(cues, cost, breaks) of each group of units. A way's cost and cues stand in one whole number, so that it orders ways."""
    ends = units.offsets.to_numpy()
    ends, size = ends[:-1] - ends[0], np.diff(ends)
    flat = dict(zip(["k", *_WHOLE, *_TRUTHS], (c.to_numpy(zero_copy_only=False) for c in units.flatten().flatten()), strict=True))
    longest = int(size.max(initial=0))
    # a limit that no group reaches needs no state of its own for each number of cues
    several = most is not None and most < longest
    columns = most + 1 if several else 1
    # boundary 0 of a group stands before its first unit, so group g's boundaries begin at ends[g] + g
    at, unit_at = ends + np.arange(len(size)), np.arange(len(flat["k"]))
    after = unit_at + np.repeat(np.arange(len(size)), size) + 1
    total = {c: np.zeros(len(unit_at) + len(size), dtype=np.int64) for c in ("chars", "all_words", "letters", "han")}
    for c, v in total.items():
        v[after] = flat[c]
    start = np.zeros(len(unit_at) + len(size), dtype=np.int64)
    start[after], start[at] = flat["next_start"], flat["start_ms"][ends]
    best = np.full((len(start), columns), _NONE, dtype=np.int64)
    back = np.zeros((len(start), columns), dtype=np.int64)
    best[at, 0] = 0
    order = np.argsort(-size, kind="stable")
    for k in range(1, longest + 1):
        g = order[: np.searchsorted(-size[order], -k, side="right")]
        g = g[(size[g] == k) | flat["free"][ends[g] + k - 1]]
        for j in range(k - 1, -1, -1):
            x, to, of = ends[g] + k - 1, at[g] + k, at[g] + j
            chars, words, letters, han = (total[c][to] - total[c][of] for c in ("chars", "all_words", "letters", "han"))
            chars, took, latin = chars - 1, np.maximum(0, flat["end_ms"][x] - start[of]), letters >= np.maximum(1, han)
            line = np.where((chars < 16) & (words > 1), (16 - chars) * 12, 0) + np.where((words == 1) & ~flat["called"][x], 180, 0)
            line += np.where(words > 1, np.where(took < shortest, 400, np.where(took < 800, 140, 0)), 0)
            cost = 15 + np.where(latin, line, np.where((took < shortest) & (han > 2), 400, 0))
            cost += np.where(size[g] == k, 0, flat["cut_cost"][x] + np.where(flat["dangling_k"][x] > j, 180, 0))
            fits = (chars >= 1) & (chars <= np.where(latin, english, other))
            way = best[of[fits]]
            way = np.where(way < _NONE // 2, way + (cost[fits] * _CUE + 1)[:, None], _NONE)
            if several:
                way = np.concatenate([np.full((len(way), 1), _NONE), way[:, :-1]], axis=1)
            # of equal ways the later one in this loop has the earlier boundary before
            better = (way <= best[to[fits]]) & (way < _NONE)
            row, column = np.nonzero(better)
            best[to[fits][row], column], back[to[fits][row], column] = way[row, column], j
            g = g[chars < max(english, other)]
            if not len(g):
                break
    last = best[at + size]
    column = last.argmin(axis=1)
    value = last[np.arange(len(size)), column]
    none = value >= _NONE // 2
    group, place, step = np.flatnonzero(~none), size[~none], 0
    column, cut = column[~none], []
    while len(group):
        place = back[at[group] + place, column]
        group, place, column = group[place > 0], place[place > 0], column[place > 0] - several
        cut.append((group, np.full(len(group), step), flat["n"][ends[group] + place - 1]))
        step -= 1
    group, step, n = (np.concatenate([c[i] for c in cut]) if cut else np.zeros(0, dtype=np.int64) for i in range(3))
    first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=len(size)))]).astype(np.int32)
    breaks = pa.ListArray.from_arrays(pa.array(first, mask=np.append(none, False)), pa.array(n[np.lexsort((step, group))].astype(np.int64)))
    return [pa.array(value % _CUE, mask=none), pa.array(value // _CUE, mask=none), breaks]
