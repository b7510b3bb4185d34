"""Large log files, cut into byte ranges that are parsed by themselves.

Where no rule can match a line feed, each line is tokenised alone, so a file can be cut at any line that surely opens an event: a header line or, in schemas
without headers, a line after one that isn't blank. Between its first and its last such line a range is parsed where it lies, without a shuffle. What is left
between the ranges, an event or two each, is found in a second, cheaper reading, and parsed file by file in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.kernel import LF, Lexer, StreamParser
from ..operators.parse import EVENT, OUTPUTS, describe, to_arrow
from ..plans import regex
from ..plans.schema import LogSchema

PIECE = 256 << 10
ROWS = 512
FRAGMENT = "source string, block long, part int, size long, byte_start long, line_start int, text binary, ahead binary"


def splittable(schema: LogSchema) -> bool:
    """No rule can match a line feed behind its first byte."""
    return not any(regex.holds(regex.parse(r.pattern, regex.ALL_BYTES & ~(1 << LF)), 1 << LF) for r in schema.rules)


class Cuts:
    """Tells the lines that open an event, whatever stands before the range."""

    def __init__(self, lexer: Lexer):
        self.lexer, self.after_text = lexer, False

    def __call__(self, line: bytes) -> bool:
        if self.lexer.header is None:
            opens, self.after_text = self.after_text, bool(line)
            return opens
        token, _ = next(self.lexer.scan(b"\n" + line + b"\n", False))
        return bool(token.rules) and token.rules[0] == self.lexer.header


def _parser(lexer: Lexer, at_start: bool) -> StreamParser:
    """at_start: of a file; elsewhere the line feed that closed the event before stands first."""
    return StreamParser(lexer) if at_start else StreamParser(lexer, b"\n", 1, True)


class _Writer:
    """Events of one stretch of whole lines, whose first byte is number `base` of its range."""

    def __init__(self, lexer: Lexer, outputs: tuple[str, ...], at_start: bool, base: int, line: int):
        self.lexer, self.outputs, self.shift = lexer, outputs, base - (0 if at_start else 2)
        self.parser, self.line, self.waiting, self.held = _parser(lexer, at_start), line, [], 0
        self.length = base

    def add(self, text: bytes) -> list[dict]:
        self.waiting.append(text)
        self.held += len(text)
        self.length += len(text)
        return self._feed() if self.held >= max(PIECE, len(self.parser.tail)) else []

    def end(self, ahead: bytes) -> list[dict]:
        """ahead: the line that follows, which may decide the last event and isn't part of the stretch."""
        self.waiting.append(ahead)
        return self._feed(True)

    def _feed(self, finished: bool = False) -> list[dict]:
        out, text = [], b"".join(self.waiting)
        self.waiting, self.held = [], 0
        for base, data, event in self.parser.feed(text, finished):
            if base + self.shift + event.start < self.length:
                out.append(describe(self.lexer, data, event, base + self.shift, self.line, self.outputs))
                self.line += data.count(b"\n", event.start, event.end)
        return out


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int, int], Iterator[bytes]]]:
    """(source, block, size of the file) and lines of each range; the lines of a range follow each other."""
    rows = ((key, line) for b in batches for key, line in zip(zip(*(b.column(i).to_pylist() for i in range(3))), b.column(3).cast(pa.binary()).to_pylist()))
    ahead = next(rows, None)

    def of(key) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead[0] == key:
            line = ahead[1]
            ahead = next(rows, None)
            yield line

    while ahead is not None:
        key = ahead[0]
        lines = of(key)
        yield key, lines
        for _ in lines:
            pass


def read_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(source, block, size, value): lines of files with the first byte of their range and the size of the file."""
    lines = spark.read.format("text").options(**{"lineSep": "\n"} | options).load(path)
    return lines.select(F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("size"), "value")


def read_split(spark: SparkSession, path: str, schema: LogSchema, outputs: tuple[str, ...] = OUTPUTS, **options: str) -> DataFrame:
    """(source, block, byte_start, byte_end, ...) of each event. Files are read in ranges of spark.sql.files.maxPartitionBytes.

    byte_start, byte_end and line_start count from the first line that begins in the range at `block`, so events are in order by (source, block,
    byte_start). event_idx, a count over a whole file, isn't given. An empty file has no events; a byte order mark at a file's start is skipped. Of a
    compressed file the last line counts as ended. Of a schema with headers, lines between the first and the last header line of a range are parsed
    there; a file without any header is parsed by one task, in pieces.
    """
    if not splittable(schema):
        raise ValueError("a rule can match a line feed")
    lexer, wanted = Lexer(schema), tuple(c for c in OUTPUTS if c in {"byte_start", "byte_end", *outputs} and c != "event_idx")
    result = T.StructType([T.StructField("source", T.StringType()), T.StructField("block", T.LongType()), *(f for f in EVENT.fields if f.name in wanted)])
    arrow, lines = to_arrow(result), read_lines(spark, path, **options)

    def batch(rows: list[dict], source: str | None = None, block: int = 0) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"source": source, "block": block} | r for r in rows], arrow)

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, block, _), lines in _ranges(batches):
            cuts, writer, pending, rows, at, number = Cuts(lexer), None, [], [], 0, 0
            for line in lines:
                if cuts(line) or not at and block == 0:
                    if writer is None:
                        writer = _Writer(lexer, wanted, block == 0, at, number)
                    else:
                        rows += writer.add(b"".join(pending))
                    pending = []
                if writer is not None:
                    pending.append(line + b"\n")
                at, number = at + len(line) + 1, number + 1
                while len(rows) >= ROWS:
                    yield batch(rows[:ROWS], source, block)
                    rows = rows[ROWS:]
            if writer is not None:
                rows += writer.end(pending[0])
            if rows:
                yield batch(rows, source, block)

    fragment = to_arrow(T.StructType.fromDDL(FRAGMENT))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (source, block, size), lines in _ranges(batches):
            cuts, texts, held, first, start, at, number = Cuts(lexer), [], 0, None, (0, 0), 0, 0

            def row(part: int, start: tuple[int, int], ahead: bytes | None = None) -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((source, block, part, size, *start, b"".join(texts), ahead), fragment)], schema=fragment)

            for line in lines:
                if cuts(line) or not at and block == 0:
                    if first is None:
                        first = line + b"\n"
                        yield row(0, (at, number), first)
                    texts, start = [], (at, number)
                texts.append(line + b"\n")
                at, number, held = at + len(line) + 1, number + 1, held + len(line) + 1
                if first is None and held >= PIECE:
                    yield row(0, (at, number))
                    texts, held = [], 0
            yield row(0, (at, number)) if first is None else row(1, start)
            texts = []
            yield row(2, (at, number))  # how many bytes and lines the range has

    def stitched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, writer, block, total, size, last = None, None, 0, 0, 0, b""

        def close(ahead: bytes) -> Iterator[pa.RecordBatch]:
            rows = writer.add(last) + writer.end(ahead)
            for i in range(0, len(rows), ROWS):
                yield batch(rows[i : i + ROWS], now, block)

        def finish() -> Iterator[pa.RecordBatch]:
            nonlocal last
            if writer is not None:
                if size - total in (-1, 2):  # with a byte order mark: three bytes more
                    last = last[:-1]
                yield from close(b"")

        for b in batches:
            for r in b.to_pylist():
                if r["source"] != now:
                    yield from finish()
                    now, writer, total, size, last = r["source"], None, 0, r["size"], b""
                if r["part"] == 2:
                    total += r["byte_start"]
                elif r["part"] == 1:
                    writer, block, last = _Writer(lexer, wanted, r["block"] == 0 and r["byte_start"] == 0, r["byte_start"], r["line_start"]), r["block"], r["text"]
                elif writer is not None:
                    rows = writer.add(last)
                    if rows:
                        yield batch(rows, now, block)
                    last = r["text"]
                    if r["ahead"] is not None:
                        yield from close(r["ahead"])
                        writer = None
        yield from finish()

    gaps = lines.mapInArrow(edges, FRAGMENT).repartition("source").sortWithinPartitions("source", "block", "part", "byte_start")
    return lines.mapInArrow(inside, result).unionByName(gaps.mapInArrow(stitched, result))
