"""Queries over the driver's tables for the corpus operators, and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bottom_k, decontaminate, divergence, dual_tree, html_text, imatch, language, licenses, line_dedup, mixing, simhash, suffix_dedup, warc
from .common import table
from .oracles import ORACLE_SQL  # noqa: F401


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(table(spark, sf_dir, "documents"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).drop("url")


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs.select("doc_id", "source", mixing.word_count().alias("_words")), F.col("_words")).select("doc_id", "size", "source_size", "target", "taken")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = html_text.with_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return got.select("page_id", "url", F.col("_main").alias("text"), F.length("_main").cast("long").alias("n_chars"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removals(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dual_tree.hard_negatives(table(spark, sf_dir, "embeddings"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bottom_k.near_duplicates(table(spark, sf_dir, "documents"))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_fingerprints, op2_warc, op3_licenses, op4_line_dedup, op5_decontaminate, op6_simhash, op7_language, op8_mixing, op9_main_text, op10_suffix_dedup, op11_hard_negatives, op12_minhash, op13_divergence)}
