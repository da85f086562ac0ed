"""License scans: an exact set-similarity join of text blocks with license templates (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the scan's contract: label and phrase.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Statements by which texts are licensed, lower-cased, words only.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license apache"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl-3", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
]
#: Share of a template's distinct words that a block must contain.
CONTAINMENT = 0.8


def phrase_starts(words: Column, phrase: str) -> Column:
    """Places (from 0) where the phrase's words stand consecutively."""
    want = phrase.split()
    last = F.size(words) - len(want)
    here = lambda i: F.array_join(F.slice(words, i + 1, len(want)), " ") == phrase
    return F.when(F.array_contains(words, want[-1]) & (last >= 0), F.filter(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: (F.element_at(words, (i + 1).cast("int")) == want[0]) & here(i))).otherwise(F.array().cast("array<int>"))


def _templates(docs: DataFrame, share: float) -> tuple[DataFrame, dict[str, int]]:
    """(token, label, tokens, n, need, at) for the prefix of each template; the global order, rarest token first.

    Counted over all documents; only the templates' own tokens, whose number is fixed, come back to the driver.
    """
    spark, vocab = docs.sparkSession, sorted({w for _, t in TEMPLATES for w in t.split()})
    said = F.filter(common.words(common.ascii_lower(common.text_or_empty())), lambda w: w.isin(vocab))
    freq = {r.w: r.n for r in docs.select(F.explode(said).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    order = {w: k for k, w in enumerate(sorted(vocab, key=lambda w: (freq.get(w, 0), w)))}
    rows = []
    for label, text in TEMPLATES:
        own = sorted(set(text.split()), key=order.get)
        need = math.ceil(share * len(own) - 1e-9)
        rows += [(w, label, own, len(own), need, k) for k, w in enumerate(own[: len(own) - need + 1])]
    return spark.createDataFrame(rows, "token string, label string, tokens array<string>, n int, need int, at int"), order


def containing_blocks(docs: DataFrame, share: float = CONTAINMENT) -> DataFrame:
    """(doc_id, _text, label, score) for every block (line) that contains a share of a template's words.

    Prefix filter: a block that holds ``need`` of a template's n tokens holds one of its n - need + 1 rarest. Length
    filter: a block has that many of the templates' tokens. Positional filter: what stands after the shared token
    in both orders suffices. What remains is verified by intersection. Lines with no prefix token yield no row.
    """
    prefix, order = _templates(docs, share)
    vocab = list(order)
    rank = F.create_map(*[F.lit(x) for w, k in order.items() for x in (w, k)])
    least = min(math.ceil(share * len(set(t.split())) - 1e-9) for _, t in TEMPLATES)
    rare = sorted({r.token for r in prefix.select("token").collect()})
    lines = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.explode(F.split(common.ascii_lower(common.text_or_empty()), "\n")).alias("line"))
    own = F.array_distinct(F.filter(common.words(F.col("line")), lambda w: w.isin(vocab)))
    lines = lines.select("doc_id", "_text", own.alias("own")).where((F.size("own") >= least) & F.exists("own", lambda w: w.isin(rare)))
    lines = lines.withColumn("own", F.array_sort("own", lambda a, b: F.element_at(rank, a) - F.element_at(rank, b)))
    tokens = lines.select("*", F.posexplode("own").alias("pos", "token"))
    hit = tokens.join(F.broadcast(prefix), "token").where(F.lit(1) + F.least(F.col("n") - F.col("at") - 1, F.size("own") - F.col("pos") - 1) >= F.col("need"))
    shared = F.size(F.array_intersect("own", "tokens"))
    return hit.where(shared >= F.col("need")).select("doc_id", "_text", "label", (shared / F.col("n")).alias("score"))


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: words, places of the base phrases, labels and the best containment (1 for a base phrase).

    Null text is empty. Rows that share doc_id and text share their labels; rows that share doc_id alone don't. Only
    doc_id and text are read, so other columns of any name don't matter; an empty table gives an empty one. Of equal
    scores the labels all stay. A very long text costs its length; it is never cut.
    """
    base = docs.select("doc_id", F.xxhash64("text").alias("_text"), common.words(common.ascii_lower(common.text_or_empty())).alias("w"))
    base = base.select("doc_id", "_text", F.size("w").cast("long").alias("n_words"), *[phrase_starts(F.col("w"), p).alias(f"p{k}") for k, (_, p) in enumerate(PHRASES)])
    at = F.concat(*[F.col(f"p{k}") for k in range(len(PHRASES))])
    own = F.array_compact(F.array(*[F.when(F.size(f"p{k}") > 0, F.lit(label)) for k, (label, _) in enumerate(PHRASES)]))
    base = base.select("doc_id", "_text", "n_words", F.size(at).cast("long").alias("n_base"), F.array_min(at).cast("long").alias("first_word"), F.array_max(at).cast("long").alias("last_word"), own.alias("own"))
    found = containing_blocks(docs).groupBy("doc_id", "_text").agg(F.collect_set("label").alias("more"), F.max("score").alias("best"))
    none = F.array().cast("array<string>")
    both = base.alias("b").join(found.alias("f"), F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & F.col("b._text").eqNullSafe(F.col("f._text")), "left")
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return both.select("b.doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join(F.sort_array("own"), ",").alias("base_labels"),
                       F.array_join(F.sort_array(F.array_distinct(F.concat("own", F.coalesce("more", none)))), ",").alias("labels"), score.alias("score"))
