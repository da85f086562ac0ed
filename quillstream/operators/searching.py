"""Searches in joined tokens, blocks of turns, wrapped lines and differences of two versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .once import once


def matches(texts: DataFrame, key: list[str], separator: str = "") -> DataFrame:
    """(key, match, first_n, last_n, start_offset, end_offset): where a query stands in the joined tokens, in any case, with the tokens that it covers.

    Texts have tokens (n, text) in their order and a query; matches don't overlap and are found from the left. Offsets
    count from the first covered token's beginning. What splitting at the query leaves gives all places at once.
    """
    spans = F.expr(f"aggregate(tokens, named_struct('at', 0, 's', cast(array() AS array<struct<n:bigint,a:int,z:int>>)), (s, t) -> named_struct('at', s.at + length(t.text) + {len(separator)}, 's', concat(s.s, array(named_struct('n', cast(t.n AS bigint), 'a', s.at, 'z', s.at + length(t.text))))), s -> s.s)")
    own = texts.withColumn("_needle", F.lower(F.trim("query"))).where("_needle <> '' AND size(tokens) > 0")
    own = once(own, _spans=spans, _parts=F.split(F.lower(F.array_join("tokens.text", separator)), F.concat(F.lit("\\Q"), F.replace("_needle", F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), -1))
    places = F.expr("aggregate(slice(_parts, 1, size(_parts) - 1), named_struct('at', 0, 'p', cast(array() AS array<int>)), (s, x) -> named_struct('at', s.at + length(x) + length(_needle), 'p', concat(s.p, array(s.at + length(x)))), s -> s.p)")
    each = once(own.select(*key, "_spans", "_needle", places.alias("_places")).select(*key, "_spans", "_needle", F.posexplode("_places").alias("match", "_at")), _hit=F.expr("filter(_spans, s -> s.z > _at AND s.a < _at + length(_needle))"))
    first = F.col("_hit")[0]
    return each.where("size(_hit) > 0").select(*key, F.col("match").cast("long").alias("match"), first["n"].alias("first_n"), F.element_at("_hit", -1)["n"].alias("last_n"), (F.col("_at") - first["a"]).cast("long").alias("start_offset"), (F.col("_at") - first["a"] + F.length("_needle")).cast("long").alias("end_offset"))


def text_blocks(cues: DataFrame, key: list[str], most_ms: int = 90_000, most_chars: int = 12_000) -> DataFrame:
    """(key, k, segment, block) of the active cues (k, active, speaker, start_ms, text), in their order k.

    A segment ends at another speaker and at a cue that isn't active. A block ends before a cue that starts most_ms after
    the block's first one or would bring its text over most_chars; a cue is never parted. Blocks are one fold a document.
    """
    w = Window.partitionBy(*key).orderBy("k")
    same = F.coalesce(F.lag("active").over(w) & F.lag("speaker").over(w).eqNullSafe(F.col("speaker")), F.lit(False))
    rows = cues.withColumn("_new", (F.col("active") & ~same).cast("int")).withColumn("segment", F.sum("_new").over(w)).where("active")
    cue = F.struct("k", "segment", "start_ms", F.length("text").cast("long").alias("size"))
    state = "struct<block:bigint,from_ms:bigint,size:bigint,out:array<struct<k:bigint,segment:bigint,block:bigint>>>"
    full = f"(s.block = 0 OR c.start_ms - s.from_ms >= {most_ms} OR s.size + c.size > {most_chars})"
    step = f"transform(array(if({full}, s.block + 1, s.block)), b -> named_struct('block', b, 'from_ms', if(b = s.block, s.from_ms, c.start_ms), 'size', if(b = s.block, s.size, 0L) + c.size, 'out', concat(s.out, array(named_struct('k', c.k, 'segment', c.segment, 'block', b)))))[0]"
    fold = F.expr(f"aggregate(_cues, cast(named_struct('block', 0L, 'from_ms', 0L, 'size', 0L, 'out', array()) AS {state}), (s, c) -> {step}, s -> s.out)")
    docs = rows.groupBy(*key).agg(F.sort_array(F.collect_list(cue)).alias("_cues"))
    return docs.select(*key, F.explode(fold).alias("_o")).select(*key, "_o.*")


def wrapped(text: Column, budget: int) -> Column:
    """A subtitle's text with explicit breaks (\\N) so that no line is wider than the budget, in hundredths of an em.

    ASCII is 65 wide but for W, M and @, all else 100; control tags and marks on letters take no room. A line breaks at
    its last space, which goes, else where it is full; breaks that are there already stay.
    """
    tokens = F.regexp_extract_all(text, F.lit(r"\{[^{}]*\}|\\[Nnh]|."), F.lit(0))
    weight = lambda t: F.when(t.startswith("{") | (t == "⁠") | t.rlike(r"^\p{M}"), 0).when(t.rlike(r"^[\x00-\x7F]+$") & ~t.isin("W", "M", "@"), 65).otherwise(100).cast("long")
    strings = lambda *items: F.array(*items) if items else F.array().cast("array<string>")
    state = lambda done, line, used, space: F.struct(done.alias("done"), line.alias("line"), used.cast("long").alias("used"), space.cast("int").alias("space"))
    none, zero = F.lit(None), F.lit(0)

    def step(s: Column, t: Column) -> Column:
        size = weight(t)
        at = F.coalesce(s["space"], F.lit(0))
        rest = F.slice(s["line"], at + 2, F.size(s["line"]) + 1)
        over = (s["used"] + size > budget) & (s["used"] > 0)
        broken = F.when(~over, state(s["done"], s["line"], s["used"], s["space"])).when(
            s["space"].isNotNull(), state(F.concat(s["done"], F.array(F.array_join(F.slice(s["line"], 1, at), ""))), rest, F.aggregate(rest, F.lit(0).cast("long"), lambda n, x: n + weight(x)), none)
        ).otherwise(state(F.concat(s["done"], F.array(F.array_join(s["line"], ""))), strings(), zero, none))
        put = F.transform(F.array(broken), lambda b: state(b["done"], F.concat(b["line"], F.array(t)), b["used"] + size, F.when(t == " ", F.size(b["line"])).otherwise(b["space"])))[0]
        return F.when(t.isin(r"\N", r"\n"), state(F.concat(s["done"], F.array(F.array_join(s["line"], ""))), strings(), zero, none)).otherwise(put)

    folded = F.aggregate(tokens, state(strings(), strings(), zero, none), step, lambda s: F.concat(s["done"], F.array(F.array_join(s["line"], ""))))
    return F.array_join(folded, r"\N")


def difference(before: DataFrame, after: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """(key, change, values): rows to put in (upsert) or take out (remove) so that ``before`` becomes ``after``; values are those to be."""
    a = before.select(*key, F.struct(*values).alias("_a"))
    b = after.select(*key, F.struct(*values).alias("_b"))
    both = a.join(b, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b")))
    return both.select(*key, F.when(F.col("_b").isNull(), "remove").otherwise("upsert").alias("change"), *[F.col(f"_b.{v}").alias(v) for v in values])
