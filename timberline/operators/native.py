"""Events and tokens in Catalyst expressions alone, where a schema allows it.

Tokens: its rules can't match a delimiter, so the stretches between delimiters are the tokens. Events: its rules can't match a line feed, so each line
is looked at alone.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import automaton, regex
from ..plans.schema import HEADER, LogSchema
from .parse import without

HIGH = regex.ALL_BYTES & ~((1 << 128) - 1)


class NotNative(ValueError):
    """The schema needs the kernel."""


#: Rounds of a repetition of more than one character that Java's matcher, which takes a stack frame for each, is given at most.
MOST_ROUNDS = 64


def _single(tree):
    """The set that a pattern is, if it is one character: alternatives of characters are one set."""
    if tree[0] == "cap":
        return _single(tree[2])
    if tree[0] == "alt":
        parts = [_single(p) for p in tree[1]]
        return None if None in parts else ("set", functools.reduce(operator.or_, (p[1] for p in parts)))
    return tree if tree[0] == "set" else None


def _java(tree, unbounded: bool = False) -> str:
    kind = tree[0]
    if kind in ("alt", "cap") and (one := _single(tree)):
        return _java(one, unbounded)
    if kind == "rep" and _single(tree[1]) is None and (tree[3] is None or tree[3] > MOST_ROUNDS):
        raise NotNative("a long repetition of more than one character")
    if kind == "set":
        high = tree[1] & HIGH
        if high and (high != HIGH or not unbounded):
            raise NotNative("a bounded pattern over bytes beyond ASCII")
        return "[" + "".join(f"\\x{{{i:x}}}" for i in range(128) if tree[1] >> i & 1) + ("\\x{80}-\\x{10ffff}" if high else "") + "]"
    if kind == "cat":
        return "".join(_java(p) for p in tree[1])
    if kind == "alt":
        return "(?:" + "|".join(_java(p) for p in tree[1]) + ")"
    if kind == "cap":
        return f"(?:{_java(tree[2])})"
    if tree[3] is None and tree[2] <= 1:
        return f"{_java(tree[1], True)}{'*+'[tree[2]]}"
    return f"(?:{_java(tree[1])}){{{tree[2]},{'' if tree[3] is None else tree[3]}}}"


def delimiter_class(schema: LogSchema) -> str:
    chars = schema.delimiters if "\n" in schema.delimiters else schema.delimiters + "\n"
    return "".join(f"\\x{{{ord(c):x}}}" for c in sorted(chars))


def rule_patterns(schema: LogSchema) -> list[tuple[str, str]]:
    """(name, Java pattern) in order of priority; NotNative where the kernel is needed."""
    chars = schema.delimiters if "\n" in schema.delimiters else schema.delimiters + "\n"
    mask = regex.mask_of(chars.encode())
    out = []
    for r in schema.rules:
        tree = regex.parse(r.pattern, regex.ALL_BYTES & ~mask)
        if r.name == HEADER or regex.holds(tree, mask):
            raise NotNative(f"{r.name} can match a delimiter")
        out.append((r.name, _java(tree)))
    if not out:
        raise NotNative("no rules")
    return out


def tokens(text: str, schema: LogSchema) -> Column:
    """array<struct<text, rule>> of a text; rule is null for static text. The same tokens as the kernel's, events joined."""
    d, rules = delimiter_class(schema), rule_patterns(schema)
    chunks = F.regexp_extract_all(F.col(text), F.lit(f"\\A[^{d}]+|[{d}][^{d}]*"), F.lit(0))

    def named(chunk: Column, index: Column) -> Column:
        rule = F.lit(None).cast("string")
        for name, pattern in reversed(rules):
            rule = F.when(chunk.rlike(f"\\A[{d}]?(?:{pattern})\\z"), F.lit(name)).otherwise(rule)
        # A rule can begin at the start of the input or at a delimiter, not at both.
        at_first = (index == 0) & chunk.rlike(f"\\A[{d}]") & ~chunk.startswith("\n")
        rule = F.when(at_first, F.lit(None).cast("string")).otherwise(rule)
        # The inner lambda binds the rule, which the patterns would else be tested for at each use.
        return F.element_at(F.transform(F.array(rule), lambda r: made(chunk, r)), 1)

    def made(chunk: Column, rule: Column) -> Column:
        token = lambda t, r: F.struct(t.alias("text"), r.alias("rule"))
        line = F.array(token(F.lit("\n"), F.lit("newLine")))
        rest = F.substring(chunk, 2, 2**31 - 1)
        split = F.when(F.length(chunk) > 1, F.concat(line, F.array(token(rest, F.lit(None).cast("string"))))).otherwise(line)
        return F.when(rule.isNull() & chunk.startswith("\n"), split).otherwise(F.array(token(chunk, rule)))

    return F.flatten(F.transform(chunks, named))


def _first_bytes(trees: list) -> set[int]:
    return {c for t in trees for c, to in enumerate(automaton.build([(0, t)]).table[0]) if to != automaton.DEAD}


def _header(schema: LogSchema) -> str | None:
    """A Java pattern for what opens an event of a schema with headers; NotNative where the kernel is needed."""
    chars = schema.delimiters if "\n" in schema.delimiters else schema.delimiters + "\n"
    trees = [(r.name, regex.parse(r.pattern, regex.ALL_BYTES & ~regex.mask_of(chars.encode()))) for r in schema.rules]
    if any(regex.holds(t, 1 << 10) for _, t in trees):
        raise NotNative("a rule can match a line feed")
    headers, others = [t for n, t in trees if n == HEADER], [t for n, t in trees if n != HEADER]
    if _first_bytes(headers) & _first_bytes(others):
        raise NotNative("another rule could be longer than a header")
    return f"(?:{'|'.join(map(_java, headers))})(?:[{delimiter_class(schema)}]|\\z)" if headers else None


def events(text: str, schema: LogSchema) -> Column:
    """array<string>: the events of a text, the same as the kernel's."""
    header = _header(schema)
    lines = lambda c: F.filter(F.regexp_extract_all(c, F.lit("\n?[^\n]*(?:\n|\\z)"), F.lit(0)), lambda x: x != "")
    if header is None:
        return lines(F.col(text))
    parts = F.split(F.col(text), f"(?<=\n)(?={header})")
    # Text before the first header goes by lines.
    return F.when(parts[0].rlike(f"\\A{header}"), parts).otherwise(F.concat(lines(parts[0]), F.slice(parts, F.lit(2), F.size(parts))))


def event_rows(df: DataFrame, schema: LogSchema, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """A row for each event: the columns of `keep` (without ones named like the new ones), event_idx and raw. A null text has no events."""
    keep = without([c for c in df.columns if c != text] if keep is None else keep, ["event_idx", "raw"])
    found = df.select(*keep, F.posexplode(events(text, schema)).alias("event_idx", "raw"))
    return found.select(*keep, F.col("event_idx").cast("long").alias("event_idx"), "raw")


def rule_counts(text: str, schema: LogSchema, rules: list[str | None]) -> list[Column]:
    """How many tokens of a text have each rule (None: static ones), counted on the text as it is: each pattern finds whole tokens of its rule, which no rule
    before it matches. The static ones are what is left of all stretches, whose number the delimiters give."""
    d, patterns = delimiter_class(schema), rule_patterns(schema)
    whole = [f"(?:{p})(?=[{d}]|\\z)" for _, p in patterns]
    unless = lambda own: "".join(f"(?!{w})" for w in own)
    matches = lambda pattern: F.regexp_count(F.col(text), F.lit(pattern)).cast("long")
    once = lambda pattern: F.col(text).rlike(pattern).cast("long")
    held: dict[str, Column] = {}
    for i, (name, _) in enumerate(patterns):
        token = unless(whole[:i]) + whole[i]
        # After delimiters; and at the start of the input, where a rule begins without one.
        n = matches(f"[{d}]{token}") + once(f"\\A(?=[^{d}]){token}") - once(f"\\A(?!\n)[{d}]{token}")
        held[name] = held[name] + n if name in held else n
    # A delimiter is a character, so without it a text is shorter by as many as there were.
    chars = sorted({*schema.delimiters, "\n"})
    stretches = sum((F.length(text) - F.length(F.replace(F.col(text), F.lit(c), F.lit(""))) for c in chars), F.lit(0)) + once(f"\\A[^{d}]")
    bare = matches(f"\n{unless(whole)}(?=[{d}]|\\z)")  # a line feed alone is no static token, and one before static text is a token beside it
    static = functools.reduce(operator.sub, held.values(), stretches.cast("long")) - bare
    none = F.when(F.col(text).isNotNull(), F.lit(0).cast("long"))
    lines = matches(f"\n{unless(whole)}")
    if "newLine" in held:
        lines = lines + held["newLine"]
    return [static if r is None else lines if r == "newLine" else held.get(r, none) for r in rules]


def template(text: str, schema: LogSchema) -> Column:
    """The log types of a text's events, joined, for schemas without captures: static text as it is, variables as their rule's name."""
    if any(schema.capture_names(n) for n in schema.names):
        raise NotNative("a rule has captures")
    opened = f"\\A[{delimiter_class(schema)}]"

    def shown(t: Column) -> Column:
        before = F.when(t["text"].rlike(opened), F.substring(t["text"], 1, 1)).otherwise("")
        return F.when(t["rule"].isNull(), t["text"]).when(t["rule"] == "newLine", "<newLine>").otherwise(F.concat(before, F.lit("<"), t["rule"], F.lit(">")))

    return F.array_join(F.transform(tokens(text, schema), shown), "")
