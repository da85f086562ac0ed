"""Word times of a speech service's response files, as units in time order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SCHEMA = """transcripts array<struct<text:string, sentences:array<struct<begin_time:double, end_time:double, text:string, language:string, speaker_id:string,
  words:array<struct<begin_time:double, end_time:double, text:string, punctuation:string>>>>>>"""
#: Marks that join the word before them.
_ONLY_MARKS = r"^(?:[…，、,；;!?！？]+|\.{2,})$"
_CHARACTER = r"[\x{3400}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"


def _seconds(ms: Column) -> Column:
    return F.round(ms / 1000, 3)


def read_words(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Units of response files, one JSON object each, with the file that they stand in, as words_of has them, and files without any."""
    raw = spark.read.schema(SCHEMA).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("file", F.col("_metadata.file_path"))
    out = words_of(raw, "file")
    return out, raw.select("file").distinct().join(out.select("file").distinct(), "file", "left_anti")


def words_of(raw: DataFrame, key: str) -> DataFrame:
    """Units (key, idx, sentence, start_s, end_s, text, kind, speaker, sentence_start, sentence_end) of responses (key, transcripts).

    A word with its punctuation is a unit; marks alone join the unit before them in their sentence. A word without
    letters or marks is left out; one without times has its sentence's. Sentences are numbered in the order of the file
    if they have units; units are then put in the order of their starts, and of the file where these are equal, since
    sentences of different speakers may overlap. A single Han, kana or Hangul character is of kind character. Pieces of
    one word that a tokenizer parted aren't joined, which needs the provider's own rules.
    """
    said = raw.select(key, F.posexplode("transcripts").alias("t", "x")).select(key, "t", F.posexplode("x.sentences").alias("s", "y"))
    words = said.select(key, "t", "s", "y.begin_time", "y.end_time", "y.speaker_id", F.posexplode("y.words").alias("k", "w"))
    core, marks = F.trim(F.coalesce("w.text", F.lit(""))), F.trim(F.coalesce("w.punctuation", F.lit("")))
    words = words.select(key, "t", "s", "k", F.when(F.col("speaker_id") != "", F.col("speaker_id")).alias("speaker"), core.alias("core"), F.concat(core, marks).alias("text"),
                         _seconds(F.coalesce("w.begin_time", "begin_time", F.lit(0.0))).alias("start_s"), _seconds(F.coalesce("w.end_time", "end_time", F.lit(0.0))).alias("end_s")).where("text <> ''")
    own = Window.partitionBy(key, "t", "s").orderBy("k")
    # marks alone belong to the unit before; the first of a sentence stands for itself
    joins = F.col("text").rlike(_ONLY_MARKS) & F.lag("text").over(own).isNotNull()
    words = words.withColumn("unit", F.sum((~joins).cast("int")).over(own))
    units = words.groupBy(key, "t", "s", "unit", "speaker").agg(F.array_join(F.sort_array(F.collect_list(F.struct("k", "text")))["text"], "").alias("text"), F.min_by("core", "k").alias("core"), F.min_by("start_s", "k").alias("start_s"), F.max("end_s").alias("end_s"))
    sentence = F.dense_rank().over(Window.partitionBy(key).orderBy("t", "s")) - 1
    both = Window.partitionBy(key, "t", "s")
    units = units.withColumns({"sentence": sentence.cast("long"), "sentence_start": F.col("unit") == F.min("unit").over(both), "sentence_end": F.col("unit") == F.max("unit").over(both), "kind": F.when(F.col("core").rlike(f"^{_CHARACTER}$"), "character").otherwise("word")})
    idx = F.row_number().over(Window.partitionBy(key).orderBy("start_s", "t", "s", "unit")) - 1
    return units.select(key, idx.cast("long").alias("idx"), "sentence", "start_s", "end_s", "text", "kind", "speaker", "sentence_start", "sentence_end")
