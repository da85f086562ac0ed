"""I-Match document fingerprints (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Inverse document frequency band, as shares of the documents a term occurs in.
RARE, COMMON = 0.005, 0.2
#: Randomised lexicons; each leaves out the terms whose hash has a digit below "5" at its place (5 of 16).
LEXICONS = 8
#: Ids of a block in which the next document is found.
IDS = 256


def terms(text: Column) -> Column:
    return common.words(common.ascii_lower(text))


def lexicon(docs: DataFrame, rare: float = RARE, most: float = COMMON) -> list[str]:
    """The terms within the band, over all documents.

    A term of the lexicon occurs in a share ``rare`` of the documents at least, so the lexicon has at most (mean
    distinct terms a document) / rare terms, however many documents there are: about 70,000 at 350 terms.
    """
    n = docs.count()
    df = docs.select(F.explode(F.array_distinct(terms(common.text_or_empty()))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    return sorted(r.term for r in df.where((F.col("n") >= n * rare) & (F.col("n") <= n * most)).select("term").collect())


def signature(text: Column, lex: list[str]) -> Column:
    """One digest for each lexicon: MD5 of the text's sorted distinct terms in it.

    If a lexicon has none of the text's terms, all its terms in the band count, and if the band has none, all its terms.
    """
    own = terms(text)
    band = F.filter(own, lambda t: t.isin(lex)) if lex else F.filter(own, lambda t: F.lit(False))

    def parts(pair: Column) -> Column:
        every = pair["every"]
        kept = F.sort_array(F.array_distinct(F.when(F.size(pair["band"]) > 0, pair["band"]).otherwise(every)))
        marked = F.transform(kept, lambda t: F.struct(t.alias("t"), F.md5(t.cast("binary")).alias("h")))

        def subset(rows: Column, k: int) -> Column:
            return F.filter(rows, lambda r: F.substring(r["h"], k, 1) >= "5")

        def digest(rows: Column) -> Column:
            return F.md5(F.array_join(rows["t"], " ").cast("binary"))

        def one(rows: Column) -> Column:
            subs = [subset(rows, k) for k in range(1, LEXICONS + 1)]
            return F.array(*[F.substring(F.when(F.size(sub) > 0, digest(sub)).otherwise(digest(rows)), 1, 16) for sub in subs])

        return F.transform(F.array(marked), one)[0]

    return F.transform(F.array(F.struct(own.alias("every"), band.alias("band"))), parts)[0]


def likeness(a: Column, b: Column) -> Column:
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.lit(float(LEXICONS))


def _next_blocks(blocks: DataFrame) -> DataFrame:
    """(block, next): the next lower block that has documents; after the lowest, the highest.

    Windows see 65,536 blocks at most, and at the top one row for each 65,536 blocks of ids.
    """
    b = blocks.withColumn("_s", F.floor(F.col("block") / 65536)).withColumn("next", F.lead("block").over(Window.partitionBy("_s").orderBy(F.col("block").desc())))
    tops = b.groupBy("_s").agg(F.max("block").alias("_top"))
    down = Window.orderBy(F.col("_s").desc())
    tops = tops.withColumn("_after", F.coalesce(F.lead("_top").over(down), F.max("_top").over(Window.partitionBy())))
    return b.join(tops, "_s").select("block", F.coalesce("next", "_after").alias("next"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness and that of the next document's.

    Texts are shuffled once, by block of ids; only the last document of a block takes its next one from another block.
    Documents without doc_id form a block of their own after all others; rows with one doc_id stand in text order. Null
    and empty texts are equal and have the digest of no term. Only doc_id and text are read, so other columns of any
    name don't matter; an empty table gives an empty one. A text is one value of a row, however long it is.
    """
    lex = lexicon(docs)
    base = docs.select("doc_id", common.text_or_empty().alias("text"))
    base = base.withColumn("_fp", signature(F.col("text"), lex)).withColumn("_block", F.coalesce(F.floor(F.col("doc_id") / IDS), F.lit(-(2**62))))
    base = base.repartition("_block")
    order = Window.partitionBy("_block").orderBy(F.col("doc_id").desc_nulls_last(), "text")
    lead = F.lead(F.struct("text", "_fp")).over(order)
    rows = base.withColumn("_next", lead)
    top = base.withColumn("_row", F.row_number().over(order)).where("_row = 1").select(F.col("_block").alias("next"), F.struct("text", "_fp").alias("_first"))
    blocks = docs.select(F.coalesce(F.floor(F.col("doc_id") / IDS), F.lit(-(2**62))).alias("block")).distinct()
    after = _next_blocks(blocks).join(top, "next").select(F.col("block").alias("_block"), "_first")
    rows = rows.join(after, "_block", "left").withColumn("_next", F.coalesce("_next", "_first"))
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring(F.col("_next.text"), F.lit(1), half))
    out = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.col("_fp"), F.col("_next._fp").alias("_nfp"), edited.alias("_edited"))
    out = out.withColumn("_efp", signature(F.col("_edited"), lex))
    return out.select(
        "doc_id", "n_chars", F.sha2(F.col("_edited"), 256).alias("edited_sha256"), F.array_join("_fp", "-").alias("fingerprint"), F.array_join("_efp", "-").alias("edited_fingerprint"),
        likeness(F.col("_fp"), F.col("_efp")).alias("near_edited"), likeness(F.col("_fp"), F.col("_nfp")).alias("near_next"),
    )
