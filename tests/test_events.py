"""Events of written-down logs, the token rules by brute force, and laws that hold for any input."""

import re

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.operators.kernel import Lexer, StreamParser
from timberline.operators.parse import EVENT, OUTPUTS, Columns, describe, to_arrow
from timberline.plans import regex
from timberline.plans.schema import DEFAULT, HEADER, NEWLINE, LogSchema

COMMON = "delimiters: \\n\\r;,@\n"
COUNT = "count:[0-9]+"
CLOCK = r"(?<timestamp>\d{2}h\d{2}m)"
STATION = r"""header:(?<timestamp>\d{2}/\d{2} \d{2}:\d{2}:\d{2}) (?<level>low|high)
celsius:-{0,1}\d+\.\d+C
count:\d+
pair:[a-z]+=(?<val>[a-z0-9]+)
odd:[a-z]*\d[a-z0-9]*"""
FERRY = r"header:(?<timestamp>\d{2}\.\d{2}) pier\[(?<pier>[A-F])(?<berth>\d)\] {2}(?<ship>[a-z]+)"
TRIPLE = "\n".join("header:" + h for h in (rf"{CLOCK} (?<who>[a-z]+)", rf"(?<who>[a-z]+) {CLOCK}({CLOCK}){{0,1}}", r"#{2,0}")) + "\nmass:\\d+kg"
TRIPLE_HEADS = [("07h15m anna", "<timestamp> <who>", "07h15m"), ("bo 08h00m", "<who> <timestamp>", "08h00m"), ("bo 08h00m09h30m", "<who> <timestamp><timestamp>", "08h00m"), ("##", "##", None), ("####", "####", None)]
GOLDEN = [
    ("door:gate7", "gate7 gate8 gate7;7 gate7", ["<door> gate8 <door>;7 <door>"]),
    ("door:gate(?<no>7)", "gate7 gate8,gate7", ["gate<no> gate8,gate<no>"]),
    ("door:gate(?<no>7){0,1}", "gate7 gate gate9", ["gate<no> gate gate9"]),
    (r"lot:L(?<whole>x(?<part>\d\d))", "Lx12 Lx7 Lx34", ["Lx<part> Lx7 Lx<part>"]),
    (STATION, "03/04 10:20:30 high -2.5C 17 mode=dry x9 wind \n03/04 10:20:31 low", ["<timestamp> <level> <celsius> <count> mode=<val> <odd> wind \n", "<timestamp> <level>"]),
    (COUNT, "42\nsheep 43", ["<count><newLine>", "sheep <count>"]),
    (COUNT, "42 sheep\ngoats 43", ["<count> sheep<newLine>", "goats <count>"]),
    (COUNT, "42 sheep\n43", ["<count> sheep\n", "<count>"]),
    (COUNT, "42 sheep\n43\n", ["<count> sheep\n", "<count><newLine>"]),
    (COUNT, "42 \n43", ["<count> \n", "<count>"]),
    (COUNT, "up\n\n\ndown\n", ["up<newLine>", "<newLine><newLine>", "down<newLine>"]),
    ("route:[a-z]+@[a-z]+9\nfile:[a-z]+/[a-z/]+", "ab@cd ef@gh9 @ef@gh9 see;to/the/shed\nby to/it", ["ab@cd <route> @<route> see;<file><newLine>", "by <file>"]),
    (FERRY, "12.45 pier[C3]  swan is late", ["<timestamp> pier[<pier><berth>]  <ship> is late"]),
    ("one:(?<w>[a-z]+7) or (?<w>[a-z]+7)\ntwo:(?<w>[a-z]+7) or or", "take red7 or blue7 and then green7 or or", ["take <w> or <w> and then <w> or or"]),
    (TRIPLE, "\n".join(h + " 12kg\nb" for h, _, _ in TRIPLE_HEADS), [w + " <mass><newLine>b" + "\n" * (i < 4) for i, (_, w, _) in enumerate(TRIPLE_HEADS)]),
    ("any:x", "", []),
]


def lexer(rules, delimiters=COMMON):
    return Lexer(LogSchema.parse(delimiters + rules))


def logtypes(lx, data):
    return [lx.logtype(data, e).decode() for e in lx.events(data)]


@pytest.mark.parametrize("rules,text,want", GOLDEN)
def test_logtypes(rules, text, want):
    assert logtypes(lexer(rules), text.encode()) == want


@pytest.mark.parametrize("number,want", [("77", "row:55<newLine>"), (r"\d+", "row:<number><newLine>")])
def test_backtracking_at_a_delimiter(number, want):
    """A rule that began before a delimiter and failed behind it leaves the delimiter to the next token."""
    lx = lexer(f"mark:[a-z]+:[0-9]*[a-z][a-z0-9]*\nnumber:{number}", "delimiters::\\n\n")
    assert logtypes(lx, b"row:55\n") == [want]


def test_tokens_and_captures():
    lx, data = lexer(GOLDEN[3][0]), GOLDEN[3][1].encode()
    (event,) = lx.events(data)
    assert [(c.name, c.start, c.end, c.leaf) for t in event.tokens for c in lx.captures_of(data, t)] == [("whole", 1, 4, False), ("part", 2, 4, True), ("whole", 10, 13, False), ("part", 11, 13, True)]
    lx, data = lexer(FERRY), GOLDEN[12][1].encode()
    assert [data[t.start : t.end] for t in next(lx.events(data)).tokens][1:] == [b" is late"]  # a schema of headers only
    lx, data = lexer(STATION), GOLDEN[4][1].encode()
    first, second = lx.events(data)
    assert [data[t.start : t.end] for t in first.tokens][-2:] == [b" ", b"\n"] and second.start == 47
    assert [lx.timestamp(data, e) for e in (first, second)] == ["03/04 10:20:30", "03/04 10:20:31"]


def test_timestamps_and_multiline():
    lx, data = lexer(TRIPLE), GOLDEN[14][1].encode()
    events = list(lx.events(data))
    assert [lx.timestamp(data, e) for e in events] == [t for _, _, t in TRIPLE_HEADS]
    assert all(lx.has_header(e) and lx.is_multiline(data, e) for e in events)
    assert not any(lx.is_multiline(b"1\n2\n", e) for e in lexer(COUNT).events(b"1\n2\n"))


def test_text_before_the_first_header_goes_by_lines():
    lx, data = lexer(STATION), b"boot 5\nready\n03/04 10:20:30 low x\n y"
    assert [data[e.start : e.end] for e in lx.events(data)] == [b"boot 5\n", b"ready\n", b"03/04 10:20:30 low x\n y"]


def test_priority_goes_by_order():
    assert logtypes(lexer("a:\\d+\nb:[0-9]+"), b"x 1") == ["x <a>"] and logtypes(lexer("b:[0-9]+\na:\\d+"), b"x 1") == ["x <b>"]
    lx = lexer("a:\\d+\nb:[0-9]+")
    assert [[lx.names[r] for r in t.rules] for t in next(lx.events(b"x 1")).tokens] == [[], ["a", "b"]]


OPENING_LINES = [
    "2024-05-06T07:08:09.123Z up", "2024-05-06 07:08:09,12 +02:00 up", "[2024-05-06 07:08:09] up", "[WARN ] 2024-05-06 07:08:09 up", "20240506T070809Z up", "2024/05/06 07:08:09 up", "24/05/06 07:08:09 up",
    "5/6/2024, 7:08:09 AM up", "06.05.2024 07:08:09 up", "May  6 07:08:09 up", "<34>May  6 07:08:09 up", "<34>1 2024-05-06T07:08:09Z up", "Mon May  6 07:08:09 2024 up", "[Mon May  6 07:08:09.5 2024] up",
    "Mon, 06 May 2024 07:08:09 GMT up", "May 6, 2024 7:08:09 AM up", "6-May-2024 07:08:09.5 up", "10.0.0.1 - me [06/May/2024:07:08:09 +0000] up", "W0506 07:08:09.123456 up", "05-06 07:08:09.123 up",
    "240506 07:08:09 up", "240506 070809  up", "[   12.345678] up", "1714979289.123 up", "1714979289123 up", "[07:08:09] up", "07:08:09.123 up", '{"time":"2024-05-06T07:08:09Z" up',
]


@pytest.mark.parametrize("line", OPENING_LINES)
def test_the_default_schema_opens_events(line):
    lx, data = LEXERS[6], f"{line}\n  more\n{line}".encode()
    events = list(lx.events(data))
    assert [lx.has_header(e) for e in events] == [True, True] and lx.timestamp(data, events[1]) and lx.is_multiline(data, events[0])


def test_the_default_schema_names_variables():
    line = b"2024-05-06 07:08:09 ERROR 10.1.2.3:80 took 12ms (-3, 4.5) id=7 from /var/x9/log 0xfF 123e4567-e89b-12d3-a456-426614174000 x-2y"
    want = "<timestamp> <level> <ip>:<port> took <size> (<number>, <decimal>) <name>=<value> from <file> <hexadecimal> <uuid> <mixed>"
    assert logtypes(LEXERS[6], line) == [want]


SCHEMAS = [COUNT, STATION, TRIPLE, GOLDEN[11][0], "door:gate7\nroom:gate(?<no>8)", "has:[^ \\r\\n;,@]*\\d[^ \\r\\n;,@]*\ncount:\\d+"]
LEXERS = [lexer(s) for s in SCHEMAS] + [Lexer(LogSchema.parse(DEFAULT)), Lexer(LogSchema(" ")), Lexer(LogSchema(" \n").with_rule(r"two:[a-z]+\n[a-z ]+").with_rule(r"opt:\d*"))]
PIECES = st.lists(st.sampled_from(["\n", "\n\n", " ", "12", "-7", "abc", "gate7", "gate8", "a/b", "ab@c9", "03/04 10:20:30 low", "07h15m bo", "1.5C", "é", "@", ",", ";", "\r\n", "##", "x1y", "2024-05-06 07:08:09"]), max_size=14).map("".join)


class Declared:
    """The token rules as sentences, on top of Python's re: at each place, the longest match that may stand there, else text up to the next delimiter."""

    def __init__(self, schema: LogSchema):
        chars = schema.delimiters if "\n" in schema.delimiters else schema.delimiters + "\n"
        self.delimiters = chars.encode()
        dot = regex.ALL_BYTES & ~regex.mask_of(self.delimiters)
        self.names = list(dict.fromkeys([NEWLINE, *(r.name for r in schema.rules)]))
        self.rules = [(r.name, re.compile(regex.to_re(regex.parse(r.pattern, dot), []).encode(), re.S)) for r in schema.rules]

    def rules_of(self, text: bytes, headers: bool) -> tuple[int, ...]:
        return tuple(dict.fromkeys(self.names.index(name) for name, pattern in self.rules if (headers or name != HEADER) and pattern.fullmatch(text)))

    def tokens(self, data: bytes):
        at, n = 0, len(data)
        while at < n:
            line_feed, bounded = data[at] == 10, data[at] in self.delimiters
            marks = [i for i in range(at + 1, n) if data[i] in self.delimiters]
            best = (at + 1, (0, *self.rules_of(b"", True))) if line_feed else None
            if at == 0 or bounded:
                inner = at + (line_feed or at > 0)
                for end in [e for e in (*marks, n) if e > inner or not line_feed]:
                    # The line feed that is the first delimiter inside stops what hasn't matched before it or at it.
                    if marks and data[marks[0]] == 10 and end > marks[0] and (best is None):
                        break
                    found = self.rules_of(data[inner:end], at == 0 or line_feed)
                    if found:
                        best = (end, found)
            if best:
                yield at, best[0], best[1]
                at = best[0]
            else:
                end = marks[0] if marks else n
                yield at, end, ()
                at = end


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from([0, 1, 2, 3, 4, 5, 8]), PIECES)
def test_tokens_are_as_declared(number, text):
    schema = LogSchema.parse(COMMON + SCHEMAS[number]) if number < 6 else LogSchema(" \n").with_rule(r"two:[a-z]+\n[a-z ]+").with_rule(r"opt:\d*")
    assert [(t.start, t.end, t.rules) for t, _ in LEXERS[number]._scan(text.encode(), True)] == list(Declared(schema).tokens(text.encode()))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(LEXERS), PIECES)
def test_events_partition_the_input(lx, text):
    data, at = text.encode(), 0
    for e in lx.events(data):
        assert e.start == at and e.tokens[0].start == at and e.tokens[-1].end == e.end
        assert all(a.end == b.start for a, b in zip(e.tokens, e.tokens[1:]))
        at = e.end
    assert at == len(data)


@settings(max_examples=500, deadline=None)
@given(st.sampled_from([lx for lx in LEXERS if lx.by_lines]), PIECES, st.booleans())
def test_events_by_lines_are_the_events_of_the_tokens(lx, text, terminal):
    data = text.encode()
    assert [(e.start, e.end) for e in lx.bare_events(data, terminal)] == [(e.start, e.end) for e in lx.events(data, terminal=terminal)]


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(LEXERS), st.lists(PIECES, max_size=4), st.sampled_from([None, frozenset(["newLine", "count", "header", "value"])]))
def test_columns_hold_what_events_are_described_by(lx, texts, rules):
    made, rows = Columns(lx, OUTPUTS, rules), []
    for data in [t.encode() + b"\xff" * (n == 2) for n, t in enumerate(texts)]:
        line = 0
        for n, event in enumerate(lx.events(data)):
            rows.append({"event_idx": n} | describe(lx, data, event, 0, line, OUTPUTS, rules))
            made.add(n, data, event, line)
            line += data.count(b"\n", event.start, event.end)
    arrow = to_arrow(EVENT)
    assert pa.RecordBatch.from_arrays(made.arrays(arrow), schema=arrow).to_pylist() == pa.RecordBatch.from_pylist(rows, arrow).to_pylist()


@settings(max_examples=300, deadline=None)
@given(st.sampled_from([lx for lx in LEXERS if lx.chunked]), PIECES)
def test_stretches_give_the_state_machines_tokens(lx, text):
    data = text.encode()
    plain = lambda found: [(t.start, t.end, t.rules) for t, _ in found]
    assert plain(lx._scan_chunks(data, True)) == plain(lx._scan(data, True))


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(LEXERS), PIECES, st.lists(st.integers(0, 80), max_size=6))
def test_streamed_pieces_give_the_same_events(lx, text, cuts):
    data = text.encode()
    whole = [(e.start, e.end, lx.logtype(data, e), lx.timestamp(data, e)) for e in lx.events(data)]
    parser, got, at = StreamParser(lx), [], 0
    for cut in [*sorted(c for c in cuts if c <= len(data)), len(data)]:
        out = parser.feed(data[at:cut])
        at = cut
        got += [(b + e.start, b + e.end, lx.logtype(d, e), lx.timestamp(d, e)) for b, d, e in out]
    got += [(b + e.start, b + e.end, lx.logtype(d, e), lx.timestamp(d, e)) for b, d, e in parser.feed(b"", True)]
    assert got == whole


@pytest.mark.parametrize("text,want", [("1 a\n2\n", [("1 a\n"), "2\n", ""]), ("1\n2", ["1\n", "2"]), ("a\n\n", ["a\n", "\n"]), ("", []), ("\n", ["\n"])])
def test_the_empty_event_at_the_end(text, want):
    lx, data = lexer(COUNT), text.encode()
    events = list(lx.events(data, terminal=True))
    assert [data[e.start : e.end].decode() for e in events] == want
    assert not any(lx.has_header(e) or lx.timestamp(data, e) or lx.is_multiline(data, e) for e in events)
    assert [lx.logtype(data, e) for e in events if not e.tokens] == [b""] * want.count("")


def test_every_split_of_a_log():
    lx = LEXERS[4]
    data = "gate7 gate8;gate9,gate7\ngate8 is shut\n\nroom gate8".encode()
    whole = logtypes(lx, data)
    assert whole[0] == "<door> gate<no>;gate9,<door>\n" and whole[-1] == "<newLine>room gate<no>"
    for cut in range(len(data) + 1):
        parser = StreamParser(lx)
        out = parser.feed(data[:cut]) + parser.feed(data[cut:]) + parser.feed(b"", True)
        assert [lx.logtype(d, e).decode() for _, d, e in out] == whole
