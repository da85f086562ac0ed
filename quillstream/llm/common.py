"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Runs of anything but ASCII digits, ASCII lower-case letters and non-ASCII characters.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPACES = r"[\x20\x09-\x0D]+"
#: Rows of a batch whose texts are Python objects at one time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share; a temporary one only where none is set and all runs on one machine, as in tests."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None)
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not found and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = found or f"file://{tempfile.mkdtemp(prefix='quillstream-')}"
        sc.setCheckpointDir(found)
    return found or sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage by a checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, most: int = 100_000) -> DataFrame:
    """A broadcast hint only if the rows, counted (or given), are few; else Spark plans a shuffled join."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


def saved_table(df: DataFrame) -> DataFrame:
    """Cut the lineage by a Parquet table in the shared folder (smaller than a checkpoint; remove it with the folder)."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that no column of the table has (names are compared without regard to case, as Spark does)."""
    taken = {c.lower() for c in df.columns}
    return next(x for x in (f"_{name}", *(f"_{name}_{k}" for k in range(len(taken) + 1))) if x.lower() not in taken)


def quoted(df: DataFrame) -> list[Column]:
    """The table's columns, whatever characters their names have."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words(c: Column, separators: str = SEPARATORS) -> Column:
    """Words of an already lower-cased text, in order, without empty ones."""
    return F.filter(F.split(c, separators), lambda w: w != "")


def one_per_id(docs: DataFrame) -> DataFrame:
    """Of rows with one doc_id, the one with the first text; rows without doc_id stay.

    The rows are joined with the first text of those ids that repeat, which are counted before any text moves.
    """
    ids = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if ids.isEmpty():
        return docs
    several, row = docs.join(ids, "doc_id", "left_semi"), fresh(docs, "row")
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in docs.columns}
    order = Window.partitionBy("doc_id").orderBy(*[quoted[c].asc_nulls_last() for c in sorted(docs.columns, key=lambda c: (c != "text", c))])
    first = several.withColumn(row, F.row_number().over(order)).where(F.col(row) == 1).drop(row)
    alone = docs.where("doc_id is null").union(docs.where("doc_id is not null").join(ids, "doc_id", "left_anti").select(*quoted.values()))
    return alone.union(first.select(*quoted.values()))


def map_texts(df: DataFrame, column: str, fn: Callable[[list[str]], list[pa.Array]], fields: list[T.StructField]) -> DataFrame:
    """Append columns that ``fn`` derives from a text column, batch by batch; other columns pass through. Null counts as empty."""
    schema = T.StructType(df.schema.fields + fields)
    names, at = schema.names, df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(k, SLICE) for whole in batches for k in range(0, whole.num_rows, SLICE)):
            got = fn([x or "" for x in b.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*b.columns, *got], names=names)

    return df.mapInArrow(run, schema)


#: Half of a long, for the mixing of node ids.
_HALF = 0xFFFFFFFF


def _mixed(c: Column, back: bool = False) -> Column:
    """A one-to-one map of longs that looks random (four rounds on the two halves), and the way back."""
    hi, lo = F.shiftrightunsigned(c, 32), c.bitwiseAND(F.lit(_HALF))
    for k in (3, 2, 1, 0) if back else (0, 1, 2, 3):
        if back:
            hi, lo = lo.bitwiseXOR(F.xxhash64(hi, F.lit(k)).bitwiseAND(F.lit(_HALF))), hi
        else:
            hi, lo = lo, hi.bitwiseXOR(F.xxhash64(lo, F.lit(k)).bitwiseAND(F.lit(_HALF)))
    return F.shiftleft(hi, 32).bitwiseOR(lo)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v): (node, root), root being the component's smallest node.

    Each round every node moves to the smallest node next to it or itself, in an order that is random with respect to
    the ids, and the edges between the nodes moved to make the next round's graph, until none is left. The smallest
    neighbour is a grouped minimum, combined before the shuffle, and moves are joined on single nodes, so a hub is never
    gathered in one place. The rounds needed grow with the logarithm of the largest component.
    """
    e = saved(edges.where("u <> v").select(_mixed(F.col("u")).alias("u"), _mixed(F.col("v")).alias("v")).distinct())
    moved = None
    while not e.isEmpty():
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = saved(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("dest")))
        first, second = step.select("u", F.col("dest").alias("a")), step.select(F.col("u").alias("v"), F.col("dest").alias("b"))
        e = saved(e.join(first, "u").join(second, "v").where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
        if moved is None:
            moved = step
        else:
            later = step.select(F.col("u").alias("w"), F.col("dest").alias("end"))
            moved = moved.join(later, moved.dest == later.w, "left").select("u", F.coalesce("end", "dest").alias("dest"))
    if moved is None:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).where("false")
    moved = saved(moved.select(_mixed(F.col("u"), back=True).alias("node"), "dest"))
    low = moved.groupBy("dest").agg(F.min("node").alias("root"))
    return moved.join(low, "dest").select("node", "root")
