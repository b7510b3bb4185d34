"""Inputs that are no files of Spark's: callables that give bytes, pieces up to a delimiter, and a data source for spark.read.format."""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..operators.kernel import Lexer
from ..operators.parse import EVENT, OUTPUTS, to_arrow
from ..plans.schema import LogSchema
from .pieces import event_batches, located, pieces_of, range_batches
from .split import splittable

RANGE = 16 << 20


def read_callback(spark: SparkSession, readers: dict[str, Callable[[], Iterable[bytes]]], schema: LogSchema, outputs: tuple[str, ...] = OUTPUTS) -> DataFrame:
    """(source, and the outputs) of each event. readers: by name, what gives an input's bytes in pieces of any size; each is called on an executor, in a task of
    its own, and again if that task is. An input without bytes has no events."""
    lexer, wanted = Lexer(schema), tuple(c for c in OUTPUTS if c in outputs)
    result = T.StructType([T.StructField("source", T.StringType()), *(f for f in EVENT.fields if f.name in wanted)])
    arrow = to_arrow(result)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column("source").to_pylist():
                yield from event_batches(lexer, readers[name](), arrow, name)

    if not readers:
        return spark.createDataFrame([], result)
    names = spark.createDataFrame([(n, i) for i, n in enumerate(readers)], "source string, i int")
    return names.repartitionById(len(readers), "i").select("source").mapInArrow(kernel, result)


def read_until(spark: SparkSession, path: str, delimiter: str = "\n", **options: str) -> DataFrame:
    """(source, piece) of files: the text between delimiters (one to three characters), without them. Files split, and text behind the last delimiter is a piece."""
    pieces = spark.read.format("text").options(**{"lineSep": delimiter} | options).load(path)
    return pieces.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("piece"))


class LogSource(DataSource):
    """spark.dataSource.register(LogSource), then spark.read.format("timberline").option("rules", schema text).load(path): the files of a folder, or one
    file; any file system that Arrow reads.

    Only what the reader's schema names is made: spark.read.schema("raw string, tokens array<struct<text string>>") leaves out other columns and other fields
    of tokens. Counts over a file (event_idx, line_start, a token's line) make it one task's work, as do compression and rules that can match a line feed;
    without them, ranges of files are read by tasks of their own (option rangeBytes, 16 MB).
    """

    @classmethod
    def name(cls) -> str:
        return "timberline"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("source", T.StringType()), *EVENT.fields])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _LogReader(self.options["path"], self.options["rules"], schema, int(self.options.get("rangeBytes", RANGE)))


@functools.lru_cache(maxsize=8)
def _lexer(rules: str) -> Lexer:
    return Lexer(LogSchema.parse(rules))


class _LogReader(DataSourceReader):
    def __init__(self, path: str, rules: str, schema: T.StructType, step: int):
        self.path, self.rules, self.schema, self.step = path, rules, schema, step

    def _split(self) -> bool:
        tokens = self.schema["tokens"].dataType.elementType.names if "tokens" in self.schema.names else []
        counts = {"event_idx", "line_start"} & {*self.schema.names} or "line" in tokens
        return not counts and splittable(LogSchema.parse(self.rules))

    def partitions(self) -> list[InputPartition]:
        system, path = located(self.path)
        info = system.get_file_info(path)
        found = [info] if info.is_file else system.get_file_info(fs.FileSelector(path, recursive=True))
        split = self._split()
        files = [f for f in sorted(found, key=lambda f: f.path) if f.is_file and not f.base_name.startswith(("_", "."))]
        return [InputPartition((f.path, at)) for f in files for at in (range(0, f.size, self.step) if split and not _compressed(f.path) else [None])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        (system, _), (path, at) = located(self.path), partition.value
        lexer, arrow = _lexer(self.rules), to_arrow(self.schema)
        if at is None:
            with system.open_input_stream(path) as file:
                yield from event_batches(lexer, pieces_of(file), arrow, path)
        else:
            with system.open_input_file(path) as file:
                yield from range_batches(lexer, file, at, self.step, arrow, path)


def _compressed(path: str) -> bool:
    """Whether Arrow opens a path through a codec."""
    try:
        return bool(pa.Codec.detect(path))
    except (TypeError, ValueError):
        return False
