"""Log files as events."""

from __future__ import annotations

from collections.abc import Iterator
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kernel import Lexer
from ..operators.parse import EVENT, OUTPUTS, parse_column, to_arrow
from ..plans.schema import LogSchema
from .pieces import event_batches, located, pieces_of


def read_logs(spark: SparkSession, path: str, schema: LogSchema, outputs: tuple[str, ...] = OUTPUTS, **options: str) -> DataFrame:
    """Events of all files under a path, with their file as `source`. Each file is one input and one task's work, read piece by piece: no more than a piece
    and an undecided event is held. `read_split` cuts files. What Arrow can't open is read by Spark, and held as a whole."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    if not all(map(_opens, _one_of_each(files.inputFiles()))):
        return parse_column(files.select(F.col("path").alias("source"), "content"), schema, "content", ["source"], outputs)
    lexer, wanted = Lexer(schema), tuple(c for c in OUTPUTS if c in outputs)
    result = T.StructType([T.StructField("source", T.StringType()), *(f for f in EVENT.fields if f.name in wanted)])
    arrow = to_arrow(result)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                system, place = located(name)
                with system.open_input_file(place) as file:
                    yield from event_batches(lexer, pieces_of(file), arrow, name)

    return files.select(F.col("path").alias("source")).mapInArrow(kernel, result)


def _one_of_each(paths: tuple[str, ...]) -> list[str]:
    """A path of each file system."""
    return [*{urlsplit(p)[:2]: p for p in paths}.values()]


def _opens(path: str) -> bool:
    """path: a URI."""
    try:
        system, place = located(unquote(path))
        return system.get_file_info(place).is_file
    except (OSError, ValueError, NotImplementedError):
        return False


def write_raw(events: DataFrame, path: str) -> None:
    """The events' text, as it was read: each event's last line feed is the one that the writer sets. An event without one, which can only be the last of
    its input, gets one."""
    text = F.when(F.col("raw").endswith("\n"), F.substring("raw", F.lit(1), F.length("raw") - 1)).otherwise(F.col("raw"))
    events.select(text.alias("value")).write.option("lineSep", "\n").text(path)
