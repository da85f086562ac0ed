"""Longest matches of a glossary's aliases in runs of letters that were spoken one by one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def compact(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def alias_map(entries: DataFrame) -> DataFrame:
    """(alias, canonical) of entries (place, source, standard, aliases, enabled): the first entry that has an alias gives its text.

    An entry's canonical text is its standard source, else its source; entries without either are left out. Its source,
    standard source and aliases are aliases if two letters or digits are left of them.
    """
    standard = F.trim(F.coalesce(F.when(F.col("standard") != "", F.col("standard")), F.col("source"), F.lit("")))
    own = entries.where(F.coalesce("enabled", F.lit(True))).withColumn("canonical", standard).where("canonical <> ''")
    forms = F.concat(F.array("source", "standard"), F.coalesce("aliases", F.array().cast("array<string>")))
    each = own.select("place", "canonical", F.posexplode(forms).alias("form", "alias")).withColumn("alias", compact(F.col("alias")))
    return each.where(F.length("alias") >= 2).groupBy("alias").agg(F.min_by("canonical", F.struct("place", "form")).alias("canonical"))


def longest_matches(units: DataFrame, aliases: DataFrame, key: list[str]) -> DataFrame:
    """(key, first_n, last_n, canonical, source): aliases found in runs of single letters, without overlaps.

    Units have an order n and a text. From a run's first letter on the longest alias is taken, then the longest one
    behind it; a letter that begins no alias ends the run. All stretches of a run as long as some alias may be are
    joined with the aliases by equality, so a glossary of any size costs one join; a match then needs only the matches
    of its own run, which stand in one row.
    """
    text = F.trim("text")
    letter = text.rlike("^[A-Za-z]$")
    w = Window.partitionBy(*key).orderBy("n")
    own = units.select(*key, "n", text.alias("text"), letter.alias("letter")).withColumn("run", F.sum((~F.col("letter")).cast("long")).over(w))
    own = own.where("letter").withColumn("k", F.row_number().over(Window.partitionBy(*key, "run").orderBy("n")))
    runs = own.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("k", "n", "text"))).alias("units")).where(F.size("units") > 1)
    runs = runs.withColumn("said", F.lower(F.array_join("units.text", "")))
    longest = aliases.agg(F.coalesce(F.max(F.length("alias")), F.lit(0))).first()[0]
    starts = runs.select(*key, "run", "said", F.explode(F.sequence(F.lit(1), F.length("said") - 1)).alias("k"))
    ends = starts.select(*key, "run", "k", "said", F.explode(F.expr(f"filter(sequence(2, {max(2, longest)}), x -> x <= length(said) - k + 1)")).alias("size"))
    hits = ends.withColumn("alias", F.expr("substring(said, k, size)")).join(aliases, "alias")
    best = hits.groupBy(*key, "run", "k").agg(F.max(F.struct("size", "canonical")).alias("hit"))
    found = best.groupBy(*key, "run").agg(F.sort_array(F.collect_list(F.struct("k", "hit.size", "hit.canonical"))).alias("hits"))
    walked = F.expr("aggregate(hits, named_struct('at', 1, 'taken', cast(array() AS array<struct<k:int,size:int,canonical:string>>)), (s, h) -> if(h.k = s.at, named_struct('at', h.k + h.size, 'taken', concat(s.taken, array(h))), s), s -> s.taken)")
    taken = found.select(*key, "run", F.explode(walked).alias("t")).join(runs.select(*key, "run", "units"), [*key, "run"])
    part = F.slice("units", F.col("t.k"), F.col("t.size"))
    return taken.select(*key, part[0]["n"].alias("first_n"), F.element_at(part, -1)["n"].alias("last_n"), F.col("t.canonical").alias("canonical"), F.array_join(F.transform(part, lambda u: u["text"]), " ").alias("source"))


#: Characters of a term's longest word by which words and terms meet.
GRAM = 4


def hits(texts: DataFrame, terms: DataFrame, key: list[str]) -> DataFrame:
    """(key, term, exact): which terms (term, exact) stand anywhere in a text, in any case unless exact.

    A term without spaces lies within one word of a text, of one with spaces the longest piece does. So terms are looked
    up in the distinct words of all texts, which words and terms meet by equal stretches of four characters, and what is
    found goes back to the texts that have the word. Only terms with spaces are then looked up in texts. Empty terms and
    null texts have no hits.
    """
    pieces = F.filter(F.split(F.lower("term"), r"\s+"), lambda p: p != "")
    piece = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("n"), p.alias("p"))))["p"]
    known = terms.withColumn("_piece", piece).where("_piece IS NOT NULL").withColumns({"_gram": F.expr(f"left(_piece, {GRAM})"), "_spaced": F.col("term").rlike(r"\s")})
    sizes = sorted(r["n"] for r in known.select(F.length("_gram").alias("n")).distinct().collect())
    if not sizes:
        return texts.select(*key, F.lit("").alias("term"), F.lit(False).alias("exact")).where("false")
    words = texts.where("text IS NOT NULL").select(*key, F.explode(F.array_distinct(F.split("text", r"\s+"))).alias("_word"))
    grams = F.array_distinct(F.flatten(F.array(*[F.expr(f"if(length(_word) < {n}, cast(array() AS array<string>), transform(sequence(1, length(_word) - {n - 1}), i -> lower(substring(_word, i, {n}))))") for n in sizes])))
    met = words.select("_word").distinct().select("_word", F.explode(grams).alias("_gram")).join(known, "_gram")
    held = F.when(F.col("exact") & ~F.col("_spaced"), F.contains("_word", "term")).otherwise(F.contains(F.lower("_word"), "_piece"))
    found = words.join(met.where(held).select("_word", "term", "exact", "_spaced").distinct(), "_word").select(*key, "term", "exact", "_spaced").distinct()
    spaced = found.where("_spaced").join(texts.select(*key, "text"), key).where(F.when(F.col("exact"), F.contains("text", "term")).otherwise(F.contains(F.lower("text"), F.lower("term"))))
    return found.where("NOT _spaced").select(*key, "term", "exact").union(spaced.select(*key, "term", "exact").distinct())
