"""Events of streamed pieces, one ordered input per key. The state of a key is what the pieces so far leave undecided."""

from __future__ import annotations

import heapq
import pickle
import tempfile
from collections.abc import Iterable, Iterator
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.kernel import Lexer, StreamParser
from ..operators.parse import EVENT, OUTPUTS, describe
from ..plans.schema import LogSchema

STATE = "tail binary, offset long, carried boolean, line int, next long"
FIELDS = ("raw", "has_header", "timestamp", "is_multiline", "logtype")
MAX_TAIL = 64 << 20
PIECE, ROWS = 256 << 10, 2048
RUN, CHUNK, WIDTH = 8 << 20, 64 << 10, 64


def _written(rows: Iterable[tuple]) -> IO[bytes]:
    """A run of sorted rows in a file without a name."""
    file, held, size = tempfile.TemporaryFile(), [], 0
    for row in rows:
        held.append(row)
        size += len(row[1]) + 64
        if size >= CHUNK:
            pickle.dump(held, file, pickle.HIGHEST_PROTOCOL)
            held, size = [], 0
    if held:
        pickle.dump(held, file, pickle.HIGHEST_PROTOCOL)
    file.seek(0)
    return file


def _read(file: IO[bytes]) -> Iterator[tuple]:
    with file:
        try:
            while True:
                yield from pickle.load(file)
        except EOFError:
            return


def _merged(runs: list[IO[bytes]]) -> Iterator[tuple]:
    return heapq.merge(*map(_read, runs), key=lambda r: r[0])


def in_order(frames: Iterable[pd.DataFrame], order: str, text: str) -> Iterator[str]:
    """Texts of all frames by a column, nulls last and ties as they came. What goes beyond RUN bytes is sorted by runs on the executor's disk."""
    held: list[pd.DataFrame] = []
    size, levels = 0, [[]]  # runs of level n are merged from WIDTH of the level below; older runs are in higher levels

    def rows() -> Iterator[tuple]:
        whole = pd.concat(held).sort_values(order, kind="stable")
        for missing, value, t in zip(whole[order].isna(), whole[order].tolist(), whole[text].fillna("")):
            yield (missing, 0 if missing else value), t

    for frame in frames:
        held.append(frame)
        size += int(frame.memory_usage(deep=True).sum())
        if size >= RUN:
            levels[0].append(_written(rows()))
            held, size = [], 0
            for n in range(len(levels)):
                if len(levels[n]) == WIDTH:
                    levels += [[]] if n + 1 == len(levels) else []
                    levels[n + 1].append(_written(_merged(levels[n])))
                    levels[n] = []
    if not any(levels):
        yield from (t for _, t in rows()) if held else ()
        return
    if held:
        levels[0].append(_written(rows()))
        held = []
    yield from (t for _, t in _merged([run for level in reversed(levels) for run in level]))


def parse_stream(df: DataFrame, schema: LogSchema, key: str, text: str = "text", order: str = "seq", idle: str | None = None, outputs: tuple[str, ...] = FIELDS) -> DataFrame:
    """(key, event_idx, byte_start, byte_end, line_start, and the outputs) of complete events.

    order: a column by which the pieces of a key in a batch are put in order, on disk where they are many; pieces of later batches follow. idle: after so many milliseconds
    without a piece the input counts as finished, and its last event comes out. An undecided event beyond MAX_TAIL bytes is an error.
    """
    lexer = Lexer(schema)
    wanted = tuple(c for c in OUTPUTS if c in {"event_idx", "byte_start", "byte_end", "line_start", *outputs})
    result = T.StructType([df.schema[key], *(f for f in EVENT.fields if f.name in wanted)])

    def step(keys: tuple, pieces: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tail, offset, carried, line, count = state.get if state.exists else (b"", 0, False, 0, 0)
        parser = StreamParser(lexer, bytes(tail), offset, carried)
        finished = state.hasTimedOut
        out, waiting, held = [], [], 0

        def fed() -> None:
            nonlocal line, count, held
            data = "".join(waiting).encode()
            waiting.clear()
            held = 0
            for base, data, event in parser.feed(data, finished):
                out.append(describe(lexer, data, event, base, line, wanted) | {key: keys[0], "event_idx": count})
                count += 1
                line += data.count(b"\n", event.start, event.end)

        for piece in () if finished else in_order(pieces, order, text):
            waiting.append(piece)
            held += len(piece)
            if held >= max(PIECE, len(parser.tail)):  # an undecided event is read again only once it has doubled
                fed()
                while len(out) >= ROWS:
                    yield pd.DataFrame(out[:ROWS])[result.names]
                    del out[:ROWS]
        fed()
        if finished:
            state.remove()
        else:
            if len(parser.tail) > MAX_TAIL:
                raise ValueError(f"an event of {keys[0]!r} is longer than {MAX_TAIL} bytes")
            state.update((parser.tail, parser.offset, parser.carried, line, count))
            if idle:
                state.setTimeoutDuration(int(idle))
        for at in range(0, len(out), ROWS):
            yield pd.DataFrame(out[at : at + ROWS])[result.names]

    timeout = GroupStateTimeout.ProcessingTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return df.select(key, order, text).groupBy(key).applyInPandasWithState(step, result, STATE, "append", timeout)
