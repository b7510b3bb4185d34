"""Logs as DataFrames: events of a text column, their variables, and searches over them."""

from __future__ import annotations

import functools
import itertools
import operator
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.schema import LogSchema
from ..plans.wildcard import logtype_patterns, to_like
from .kernel import Capture, Event, Lexer, Token

CAPTURE = T.StructType([T.StructField("name", T.StringType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("text", T.StringType()), T.StructField("leaf", T.BooleanType())])
TOKEN = T.StructType([
    T.StructField("pos", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("rule", T.StringType()), T.StructField("rules", T.ArrayType(T.StringType())),
    T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("line", T.IntegerType()), T.StructField("captures", T.ArrayType(CAPTURE)), T.StructField("delimiter", T.StringType()),
])
EVENT = T.StructType([
    T.StructField("event_idx", T.LongType()), T.StructField("byte_start", T.LongType()), T.StructField("byte_end", T.LongType()), T.StructField("line_start", T.IntegerType()), T.StructField("raw", T.StringType()),
    T.StructField("has_header", T.BooleanType()), T.StructField("timestamp", T.StringType()), T.StructField("is_multiline", T.BooleanType()), T.StructField("logtype", T.StringType()), T.StructField("tokens", T.ArrayType(TOKEN)),
])
OUTPUTS = tuple(EVENT.names)
SLICE_ROWS = 256


def without(columns: list[str], names) -> list[str]:
    """The columns that aren't named like a new one; names count as alike whatever their case."""
    taken = {n.lower() for n in names}
    return [c for c in columns if c.lower() not in taken]


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def describe(lexer: Lexer, data: bytes, event: Event, base: int, line: int, outputs: tuple[str, ...], rules: frozenset[str] | None = None) -> dict:
    """The chosen outputs of an event; base and line: where the data starts in its source; rules: only tokens of these."""
    out: dict = {"byte_start": base + event.start, "byte_end": base + event.end, "line_start": line}
    if "raw" in outputs:
        out["raw"] = _text(data[event.start : event.end])
    if "has_header" in outputs:
        out["has_header"] = lexer.has_header(event)
    if "timestamp" in outputs:
        out["timestamp"] = lexer.timestamp(data, event)
    if "is_multiline" in outputs:
        out["is_multiline"] = lexer.is_multiline(data, event)
    if "logtype" in outputs:
        out["logtype"] = _text(lexer.logtype(data, event))
    if "tokens" in outputs:
        tokens, at = [], event.start
        for pos, t in enumerate(event.tokens):
            line, at = line + data.count(b"\n", at, t.start), t.start
            names = [lexer.names[r] for r in t.rules]
            if rules is not None and (not names or names[0] not in rules):
                continue
            found = [{"name": c.name, "byte_start": base + c.start, "byte_end": base + c.end, "text": _text(data[c.start : c.end]), "leaf": c.leaf} for c in lexer.captures_of(data, t)]
            tokens.append({"pos": pos, "text": _text(data[t.start : t.end]), "rule": names[0] if names else None, "rules": names, "byte_start": base + t.start, "byte_end": base + t.end, "line": line, "captures": found, "delimiter": _text(data[t.start : t.start + t.prefixed])})
        out["tokens"] = tokens
    return out


def strings(found: list[bytes | None]) -> pa.Array:
    """Texts of bytes; what isn't UTF-8 is replaced."""
    try:
        return pa.array(found, pa.binary()).cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if x is None else _text(x) for x in found], pa.string())


def _lists(sizes: list[int], values: pa.Array, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(itertools.accumulate(sizes, initial=0), pa.int32()), values, type=kind)


def _structs(columns: list, kind: pa.DataType) -> pa.Array:
    fields = [kind.field(i) for i in range(kind.num_fields)]
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)


class Columns:
    """The outputs of `describe` for many events, built column by column, without an object for each token."""

    def __init__(self, lexer: Lexer, outputs: tuple[str, ...], rules: frozenset[str] | None, parts: tuple[str, ...] = tuple(TOKEN.names)):
        """parts: the fields of tokens that will be asked for."""
        self.lexer, self.outputs, self.captured = lexer, outputs, "captures" in parts
        self.chosen = None if rules is None else {n for n, name in enumerate(lexer.names) if name in rules}
        self.places: list[tuple[int, int, int, int]] = []
        self.values: dict[str, list] = {c: [] for c in ("raw", "has_header", "timestamp", "is_multiline", "logtype") if c in outputs}
        self.sizes: list[int] = []
        self.tokens: list[tuple[bytes, Token, int, int, int]] = []  # with their data, place, line and where the data starts
        self.found: list[tuple[bytes, Capture, int]] = []
        self.held: list[int] = []  # captures of each token

    def add(self, number: int, data: bytes, event: Event, line: int, base: int = 0) -> None:
        """base: where the data starts in its source."""
        lexer, values = self.lexer, self.values
        self.places.append((number, base + event.start, base + event.end, line))
        if "raw" in values:
            values["raw"].append(data[event.start : event.end])
        if "has_header" in values:
            values["has_header"].append(lexer.has_header(event))
        if "timestamp" in values:
            values["timestamp"].append(lexer.timestamp(data, event))
        if "is_multiline" in values:
            values["is_multiline"].append(lexer.is_multiline(data, event))
        if "logtype" in values:
            values["logtype"].append(lexer.logtype(data, event))
        if "tokens" in self.outputs:
            before, at, chosen = len(self.tokens), event.start, self.chosen
            for pos, t in enumerate(event.tokens):
                if chosen is None or t.rules and t.rules[0] in chosen:
                    line, at = line + data.count(b"\n", at, t.start), t.start
                    self.tokens.append((data, t, pos, line, base))
                    if self.captured:
                        own = lexer.captures_of(data, t)
                        self.held.append(len(own))
                        self.found += [(data, c, base) for c in own]
            self.sizes.append(len(self.tokens) - before)

    def _captures(self, kind: pa.DataType) -> pa.Array:
        made = {
            "name": lambda: [c.name for _, c, _ in self.found], "byte_start": lambda: [base + c.start for _, c, base in self.found], "byte_end": lambda: [base + c.end for _, c, base in self.found],
            "text": lambda: strings([d[c.start : c.end] for d, c, _ in self.found]), "leaf": lambda: [c.leaf for _, c, _ in self.found],
        }
        return _lists(self.held, _structs([made[f.name]() for f in kind.value_type], kind.value_type), kind)

    def _tokens(self, kind: pa.DataType) -> pa.Array:
        names, of, held = pa.array(self.lexer.names, pa.string()), {f.name: f.type for f in kind.value_type}, self.tokens
        made = {
            "pos": lambda: [pos for _, _, pos, _, _ in held], "text": lambda: strings([d[t.start : t.end] for d, t, _, _, _ in held]),
            "rule": lambda: names.take(pa.array([t.rules[0] if t.rules else None for _, t, _, _, _ in held], pa.int32())),
            "rules": lambda: _lists([len(t.rules) for _, t, _, _, _ in held], names.take(pa.array([n for _, t, _, _, _ in held for n in t.rules], pa.int32())), of["rules"]),
            "byte_start": lambda: [base + t.start for _, t, _, _, base in held], "byte_end": lambda: [base + t.end for _, t, _, _, base in held], "line": lambda: [line for _, _, _, line, _ in held],
            "captures": lambda: self._captures(of["captures"]), "delimiter": lambda: strings([d[t.start : t.start + t.prefixed] for d, t, _, _, _ in held]),
        }
        return _lists(self.sizes, _structs([made[f.name]() for f in kind.value_type], kind.value_type), kind)

    def arrays(self, arrow: pa.Schema) -> list[pa.Array]:
        out = []
        for c in arrow:
            if c.name == "tokens":
                out.append(self._tokens(c.type))
            elif c.name in ("raw", "logtype"):
                out.append(strings(self.values[c.name]))
            elif c.name in self.values:
                out.append(pa.array(self.values[c.name], c.type))
            else:
                i = ("event_idx", "byte_start", "byte_end", "line_start").index(c.name)
                out.append(pa.array([p[i] for p in self.places], c.type))
        return out


def parse_column(df: DataFrame, schema: LogSchema, text: str = "text", keep: list[str] | None = None, outputs: tuple[str, ...] = OUTPUTS, rules: list[str] | None = None, terminal: bool = False) -> DataFrame:
    """A row for each event of each row's text, which is a whole input; with the columns of `keep` (without ones named like an output) and the outputs
    asked for.

    Only what `outputs` names is computed, and `tokens` has only those of the named rules where `rules` is given: Catalyst can't look into the
    kernel, so what a query doesn't need is left out here. A null text has no events. terminal: an empty event follows where a text without headers
    ends with the line feed that closes its last event.
    """
    lexer, wanted = Lexer(schema), tuple(c for c in OUTPUTS if c in outputs)
    keep = without([c for c in df.columns if c != text] if keep is None else keep, wanted)
    made = T.StructType([f for f in EVENT.fields if f.name in wanted])
    result = T.StructType([*(df.schema[c] for c in keep), *made.fields])
    arrow, chosen = to_arrow(made), None if rules is None else frozenset(rules)
    events, counted = lexer.events if {"tokens", "logtype"} & {*wanted} else lexer.bare_events, "tokens" in wanted or "line_start" in wanted

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(at, SLICE_ROWS)
                built, owner = Columns(lexer, wanted, chosen), []
                for i, data in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
                    line = 0
                    for n, event in enumerate(events(data or b"", terminal=terminal)):
                        built.add(n, data, event, line)
                        owner.append(i)
                        line += data.count(b"\n", event.start, event.end) if counted else 0
                if owner:
                    taken = pa.array(owner, pa.int64())
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keep), *built.arrays(arrow)], names=result.names)

    return df.select(*keep, text).mapInArrow(kernel, result)


def dealt(df: DataFrame, per_core: int = 128 << 20) -> DataFrame:
    """A table of fewer files than there are cores is dealt out to all of them, if it has no more than per_core bytes for each. A larger one is read as
    it lies, without a shuffle: its files split.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    held = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return df.repartition(cores) if held <= cores * per_core and len(df.inputFiles()) < cores else df


def variables(events: DataFrame, rule: str | None = None) -> DataFrame:
    """A row for each variable token of events with `tokens`: their other columns, without ones named like a token's field, and these. rule: only this one."""
    held = F.filter("tokens", lambda t: (t["rule"] == rule) if rule else t["rule"].isNotNull() & (t["rule"] != "newLine"))
    keep = without(events.columns, ["tokens", "token", *TOKEN.names])
    return events.select(*keep, F.explode(held).alias("token")).select(*keep, "token.*")


def capture(name: str, rule: str | None = None) -> Column:
    """The first match of a capture in an event, as text."""
    chosen = F.filter("tokens", lambda t: t["rule"] == rule) if rule else F.col("tokens")
    found = F.filter(F.flatten(F.transform(chosen, lambda t: t["captures"])), lambda c: c["name"] == name)
    return F.try_element_at(found, F.lit(1))["text"]


POSITIONS = "name string, starts array<long>, ends array<long>"


def capture_positions(df: DataFrame, schema: LogSchema, rule: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each capture of each token of a rule, in each row's text: the columns of `keep`, event_idx, pos (of the token) and all positions.

    starts and ends hold the newest round of a repetition first, and -1 for a round or an alternative that skipped the capture.
    """
    lexer = Lexer(schema)
    wanted = lexer.names.index(rule)
    made = T.StructType.fromDDL("event_idx long, pos int, " + POSITIONS)
    keep = without([c for c in df.columns if c != text] if keep is None else keep, made.names)
    result = T.StructType([*(df.schema[c] for c in keep), *made.fields])
    arrow = to_arrow(made)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, owner = [], []
            for i, data in enumerate(batch.column(text).cast(pa.binary()).to_pylist()):
                for n, event in enumerate(lexer.events(data or b"")):
                    for pos, t in enumerate(event.tokens):
                        if t.rules and t.rules[0] == wanted:
                            for name, own in lexer.positions_of(data, t):
                                rows.append({"event_idx": n, "pos": pos, "name": name, "starts": [a for a, _ in own], "ends": [b for _, b in own]})
                                owner.append(i)
            if rows:
                taken = pa.array(owner, pa.int64())
                columns = [pa.array([r[f.name] for r in rows], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(taken) for c in keep), *columns], names=result.names)

    return df.select(*keep, text).mapInArrow(kernel, result)


def without_delimiter(token: Column, schema: LogSchema) -> Column:
    """A variable's text without the delimiter before it; of a text alone, the first character, if it is a delimiter."""
    return F.when(F.substring(token, 1, 1).isin(*schema.delimiters), F.substring(token, 2, 2**31 - 1)).otherwise(token)


def delimiter_of(token: Column) -> Column:
    """The delimiter with which a token (a struct of `tokens`) starts; empty for static text, and for a variable at the start of its input or line."""
    return token["delimiter"]


def body_of(token: Column) -> Column:
    """A token's text behind its delimiter."""
    return F.substring(token["text"], F.length(token["delimiter"]) + 1, F.lit(2**31 - 1))


def bytes_of(token: Column) -> Column:
    """A token's length in bytes, its delimiter included."""
    return token["byte_end"] - token["byte_start"]


def part_of(token: Column, start: int | Column, end: int | Column) -> Column:
    """The token between two byte positions counted from its first byte, the end exclusive; positions beyond its ends are cut."""
    low = F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(0))
    high = F.least(F.lit(end) if isinstance(end, int) else end, bytes_of(token))
    return F.decode(F.substring(token["text"].cast("binary"), (low + 1).cast("int"), F.greatest(high - low, F.lit(0)).cast("int")), "UTF-8")


def pivot_variables(events: DataFrame, names: list[str]) -> DataFrame:
    """The first variable of each name, as a column of that name."""
    first = lambda n: F.try_element_at(F.filter("tokens", lambda t: t["rule"] == n), F.lit(1))["text"]
    return events.select(*without(events.columns, names), *[first(n).alias(n) for n in names])


def multiline(events: DataFrame) -> DataFrame:
    return events.where("is_multiline")


def logtype_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("logtype").agg(F.count("*").alias("n"))


def search(events: DataFrame, query: str, column: str = "raw") -> DataFrame:
    """Events that a wildcard query matches as a whole. On a raw column of a table the filter reaches the scan."""
    return events.where(F.col(column).like(to_like(query)))


def search_by_logtype(events: DataFrame, query: str, schema: LogSchema, column: str = "raw", logtype: str = "logtype") -> DataFrame:
    """The events of `search`, found by reading the query first: only events whose log type some reading allows are looked at. On a table that is
    stored with its log types, both filters reach the scan, and the log type, which has few values, decides cheaply."""
    patterns = logtype_patterns(query, schema)
    if patterns is not None:
        events = events.where(functools.reduce(operator.or_, (F.col(logtype).like(p) for p in patterns)) if patterns else F.lit(False))
    return search(events, query, column)
