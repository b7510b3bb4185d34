"""Register SQL functions for a schema: logtype(text), log_tokens(text), and the table function log_parse(text)."""

from __future__ import annotations

import functools
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.kernel import Event, Lexer
from ..operators.parse import strings
from ..plans.schema import LogSchema

KEPT = 200_000  # tokens


@functools.lru_cache(maxsize=8)
def _lexer(schema: LogSchema) -> Lexer:
    return Lexer(schema)


# In a worker: the last batch of some schemas with the events of its rows, as far as they are kept.
_SEEN: dict[LogSchema, tuple[pa.Array, list[list[Event] | None]]] = {}


def lexed(schema: LogSchema, texts: pa.Array) -> Iterator[tuple[bytes, list[Event]] | None]:
    """Data and events of each text. A query's functions get the same batches in turn, so events are kept for the next one, up to a bound."""
    lexer, (last, known) = _lexer(schema), _SEEN.pop(schema, (None, []))
    if last is None or not last.equals(texts):
        known = []
    kept, room = [], KEPT
    for n, text in enumerate(texts.to_pylist()):
        if text is None:
            kept.append(None)
            yield None
            continue
        data = text.encode()
        events = known[n] if n < len(known) and known[n] is not None else list(lexer.events(data))
        room -= sum(len(e.tokens) for e in events)
        kept.append(events if room >= 0 else None)
        yield data, events
    if len(_SEEN) >= 8:
        _SEEN.clear()
    _SEEN[schema] = texts, kept


def register(spark: SparkSession, schema: LogSchema, prefix: str = "") -> None:
    """logtype and log_tokens, array<struct<text, rule>>, take a text of one event; log_parse gives (event_idx, raw, timestamp, is_multiline, logtype) of each event of a text."""
    lexer = _lexer(schema)
    names, kind = pa.array(lexer.names, pa.string()), pa.list_(pa.struct([("text", pa.string()), ("rule", pa.string())]))

    @F.arrow_udf("string")
    def logtype(texts: pa.Array) -> pa.Array:
        return strings([None if x is None else b"".join(_lexer(schema).logtype(x[0], e) for e in x[1]) for x in lexed(schema, texts)])

    @F.arrow_udf("array<struct<text:string,rule:string>>")
    def log_tokens(texts: pa.Array) -> pa.Array:
        ends, found, rules = [0], [], []
        for x in lexed(schema, texts):
            for e in x[1] if x else ():
                found += [x[0][t.start : t.end] for t in e.tokens]
                rules += [t.rules[0] if t.rules else None for t in e.tokens]
            ends.append(len(found))
        held = pa.StructArray.from_arrays([strings(found), names.take(pa.array(rules, pa.int32()))], fields=[*kind.value_type])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), held, type=kind, mask=texts.is_null())

    class LogParse:
        def eval(self, text: str):
            lexer = _lexer(schema)
            data = (text or "").encode()
            for n, e in enumerate(lexer.events(data)):
                yield n, data[e.start : e.end].decode("utf-8", "replace"), lexer.timestamp(data, e), lexer.is_multiline(data, e), lexer.logtype(data, e).decode("utf-8", "replace")

    spark.udf.register(f"{prefix}logtype", logtype)
    spark.udf.register(f"{prefix}log_tokens", log_tokens)
    spark.udtf.register(f"{prefix}log_parse", F.udtf(LogParse, returnType="event_idx long, raw string, timestamp string, is_multiline boolean, logtype string"))
