"""Inputs read piece by piece, whatever their size: the events of a whole input, or of the byte ranges of a file, as Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs

from ..operators.kernel import Lexer, StreamParser
from ..operators.parse import Columns
from .split import PIECE, ROWS, Cuts


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system that Arrow has for a path as Spark writes it, and the path there."""
    return fs.FileSystem.from_uri(quote(path if "://" in path or path.startswith(("/", "file:")) else f"file:{path}", safe="/:@"))


def pieces_of(file: pa.NativeFile, length: int | None = None) -> Iterator[bytes]:
    """A file's bytes from where it stands, up to so many."""
    while piece := file.read(PIECE if length is None else min(PIECE, length)):
        yield piece
        length = None if length is None else length - len(piece)


def event_batches(lexer: Lexer, pieces: Iterable[bytes], arrow: pa.Schema, source: str | None = None, base: int = 0, end: int | None = None, ahead: bytes = b"") -> Iterator[pa.RecordBatch]:
    """The events of an input, with the outputs (and `source`) that arrow names; no more than a piece and an undecided event is held.

    base: where the input begins in its file, which is a line that opens an event; end: where it ends; ahead: the line that follows it, which may decide
    the last event.
    """
    outputs = tuple(f.name for f in arrow if f.name != "source")
    made = pa.schema([f for f in arrow if f.name != "source"])
    parts = tuple(f.name for f in made.field("tokens").type.value_type) if "tokens" in outputs else ()
    counted = "line_start" in outputs or "line" in parts
    # Elsewhere than at the start of a file, the line feed that closed the event before stands first.
    parser, shift = (StreamParser(lexer), 0) if base == 0 else (StreamParser(lexer, b"\n", 1, True), base - 2)
    number = line = held = 0
    built, waiting = Columns(lexer, outputs, None, parts), []

    def flushed() -> pa.RecordBatch:
        nonlocal built
        columns = dict(zip(outputs, built.arrays(made)))
        if "source" in arrow.names:
            columns["source"] = pa.repeat(pa.scalar(source, pa.string()), len(built.places))
        built = Columns(lexer, outputs, None, parts)
        return pa.RecordBatch.from_arrays([columns[n] for n in arrow.names], schema=arrow)

    def fed(finished: bool = False) -> Iterator[pa.RecordBatch]:
        nonlocal number, line, held
        text = b"".join(waiting)
        waiting.clear()
        held = 0
        for at, data, event in parser.feed(text, finished):
            if end is not None and at + shift + event.start >= end:
                break
            built.add(number, data, event, line, at + shift)
            number += 1
            if counted:
                line += data.count(b"\n", event.start, event.end)
            if len(built.places) == ROWS:
                yield flushed()

    for piece in pieces:
        waiting.append(piece)
        held += len(piece)
        if held >= max(PIECE, len(parser.tail)):  # an undecided event is read again only once it has doubled
            yield from fed()
    waiting.append(ahead)
    yield from fed(True)
    if built.places:
        yield flushed()


def _lines_behind(file: pa.NativeFile, at: int) -> Iterator[tuple[int, bytes | None]]:
    """Where each line begins that begins at a byte or behind it, and the line without its line feed; None as long as an earlier line goes on."""
    file.seek(at - 1)
    place, held, skipping = at - 1, [], True
    while piece := file.read(PIECE):
        *ended, left = piece.split(b"\n")
        for part in ended:
            line, held = b"".join([*held, part]), []
            if not skipping:
                yield place, line
            place, skipping = place + len(line) + 1, False
        if skipping:
            place += len(left)
            yield place, None
        else:
            held.append(left)
    if any(held):
        yield place, b"".join(held)


def first_cut(lexer: Lexer, file: pa.NativeFile, start: int, stop: int, step: int) -> tuple[int, bytes] | None:
    """Where the first line from start to stop begins that opens an event, and the line. Each range of so many bytes is judged by itself, as by its own task."""
    for at in range(start, stop, step):
        cuts = Cuts(lexer)
        for place, line in _lines_behind(file, at):
            if place >= min(at + step, stop):
                break
            if line is not None and cuts(line):
                return place, line + b"\n"
    return None


def range_batches(lexer: Lexer, file: pa.NativeFile, at: int, step: int, arrow: pa.Schema, source: str) -> Iterator[pa.RecordBatch]:
    """The events from the first line in a range that surely opens one up to the next such line behind the range, so ranges need nothing from each other."""
    size = file.size()
    begin, _ = (0, b"") if at == 0 else first_cut(lexer, file, at, min(at + step, size), step) or (None, b"")
    if begin is not None:
        end, ahead = first_cut(lexer, file, at + step, size, step) or (size, b"")
        file.seek(begin)
        yield from event_batches(lexer, pieces_of(file, end - begin), arrow, source, begin, end, ahead)
