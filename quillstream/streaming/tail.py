"""An append-only log of numbered events that is followed from a cursor on, as a stream source of Spark's."""

from __future__ import annotations

import json
import sys
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

#: Files that one task of a batch reads.
FILES = 16


def _folder(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that pyarrow knows; a bare path is local."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(path: str) -> list[str]:
    """The log's complete Parquet files by name; files of a writer that hasn't finished begin with a dot or underscore."""
    fs, folder = _folder(path)
    if fs.get_file_info(folder).is_file:
        return [folder]
    found = fs.get_file_info(pafs.FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._")


class _Part(InputPartition):
    def __init__(self, files: list[str], after: int, upto: int):
        self.files, self.after, self.upto = files, after, upto


class _Reader(DataSourceStreamReader):
    """Offsets are cursors: the highest event number of a batch. A batch is the events past the last cursor up to its own.

    A cursor moves by ``batch`` events' numbers at most, so a reader that comes late takes the log in steps. Which files a
    batch needs is read from their statistics; events that a later file brings with numbers up to the cursor are late
    and are not delivered, which is what a cursor means: writers must append in the order of numbers.
    """

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.key, self.names = options["path"], options.get("key", "event_id"), schema.names
        self.after, self.step = int(options.get("after", -1)), int(options.get("batch", 1 << 40))
        self.last = self.after

    def initialOffset(self) -> dict:
        return {"cursor": self.after}

    def _spans(self) -> list[tuple[str, int, int]]:
        """(file, lowest, highest number) from the files' footers."""
        fs, _ = _folder(self.path)
        out = []
        for f in _files(self.path):
            with fs.open_input_file(f) as at:
                meta = pq.ParquetFile(at).metadata
            column = meta.schema.names.index(self.key)
            stats = [s for g in range(meta.num_row_groups) if (s := meta.row_group(g).column(column).statistics) and s.has_min_max]
            if stats:
                out.append((f, min(s.min for s in stats), max(s.max for s in stats)))
        return out

    def latestOffset(self) -> dict:
        """The next cursor: numbers may have gaps, so a step that holds none goes on to the next number that there is."""
        spans = self._spans()
        top = max((z for _, _, z in spans), default=self.last)
        if top > self.last:
            low = min(max(a, self.last + 1) for _, a, z in spans if z > self.last)
            self.last = min(top, low + self.step - 1)
        return {"cursor": self.last}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self.last = max(self.last, end["cursor"])
        files = [f for f, a, z in self._spans() if z > start["cursor"] and a <= end["cursor"]]
        return [_Part(files[k : k + FILES], start["cursor"], end["cursor"]) for k in range(0, len(files), FILES)] or [_Part([], 0, 0)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.files:
            fs, _ = _folder(self.path)
            number = pc.field(self.key)
            yield from ds.dataset(partition.files, filesystem=fs, format="parquet").to_batches(columns=self.names, filter=(number > partition.after) & (number <= partition.upto))

    def commit(self, end: dict) -> None:
        """Nothing to do: the log keeps its events."""


class CursorTail(DataSource):
    """Source ``cursor_tail``: options path, key (the column of numbers), after (the first cursor) and batch (numbers a batch at most)."""

    @classmethod
    def name(cls) -> str:
        return "cursor_tail"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(schema, self.options)


def tail(spark: SparkSession, path: str, schema: str, after: int = -1, batch: int | None = None, key: str = "event_id") -> DataFrame:
    """The events of a log with numbers above a cursor, as they are appended."""
    # the source is made by workers of its own, which needn't have this package
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    spark.dataSource.register(CursorTail)
    reader = spark.readStream.format("cursor_tail").schema(schema).option("path", path).option("key", key).option("after", after)
    return (reader.option("batch", batch) if batch else reader).load()


def encoded(events: DataFrame, key: str = "event_id", kind: str = "event_type") -> DataFrame:
    """Events as text frames that a browser's event stream reads: id, event and data lines, with a blank line behind."""
    data = F.to_json(F.struct(*[c for c in events.columns]))
    return events.select(key, F.concat(F.lit("id: "), F.col(key).cast("string"), F.lit("\nevent: "), F.regexp_replace(kind, "[\r\n]", " "), F.lit("\ndata: "), data, F.lit("\n\n")).alias("frame"))


def offsets_of(progress: dict) -> tuple[int, int]:
    """The cursors between which a batch of a running query lay, from its progress."""
    source = progress["sources"][0]
    cursor = lambda v: (json.loads(v) if isinstance(v, str) else v)["cursor"]
    return cursor(source["startOffset"]) if source["startOffset"] else -1, cursor(source["endOffset"])
