"""Tokens, cleaned punctuation and written numbers of the driver's texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexical
from .bindings import table
from .registry import query


@query(None)
def fn_lexical_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each turn; SQL engines without lookahead can't say the rule, tests/test_lexical.py scans it."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("idx"), F.col("role").alias("speaker"), "text")
    return lexical.spans(turns, ["doc_id", "idx", "speaker"])


@query(None)
def fn_clean_sentence_punct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(lexical.without_punctuation(F.col("text")), 256).alias("cleaned_sha256"))


@query("SELECT o_orderkey, CAST(o_orderkey * 1009 + o_custkey AS BIGINT) AS value, CAST(CAST(o_totalprice AS DECIMAL(18, 2)) AS DOUBLE) AS price FROM orders")
def fn_written_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order numbers written in numerals and prices written with grouping commas, read back; the SQL has the numbers themselves."""
    o = table(spark, sf_dir, "orders")
    said, price = lexical.numerals(F.col("o_orderkey") * 1009 + F.col("o_custkey")), F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    return o.select("o_orderkey", lexical.written_number(said).cast("long").alias("value"), lexical.written_number(price).cast("double").alias("price"))
