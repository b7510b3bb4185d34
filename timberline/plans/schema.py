"""Log schemas: delimiters, header rules and variable rules, from a file, a text, or code. Schemas don't change; each method gives a new one."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from . import regex

# Reserved names, and the escapes of a delimiters line.
HEADER, NEWLINE, TIMESTAMP = "header", "newLine", "timestamp"
DELIMITER_ESCAPES = {"t": "\t", "n": "\n", "v": "\x0b", "f": "\f", "r": "\r", "\\": "\\"}


class SchemaSyntaxError(ValueError):
    """line and column count from 1. expected: what could have stood there, as far as it is known."""

    def __init__(self, message: str, line: int, column: int, text: str = "", expected: tuple[str, ...] = ()):
        hint = f"\nexpected: {' '.join(expected)}" if expected else ""
        super().__init__(f"schema:{line}:{column}: error: {message}\n{text}\n{' ' * (column - 1)}^{hint}")
        self.line, self.column, self.expected = line, column, expected


@dataclass(frozen=True)
class Rule:
    name: str
    pattern: str
    line: int = 0


@dataclass(frozen=True)
class LogSchema:
    delimiters: str = ""
    rules: tuple[Rule, ...] = ()
    notes: tuple[str, ...] = field(default=(), compare=False)

    @classmethod
    def from_file(cls, path: str) -> LogSchema:
        with open(path, encoding="ascii") as f:
            return cls.parse(f.read())

    @classmethod
    def parse(cls, text: str) -> LogSchema:
        lines = re.split(r"\r?\n", text)
        if not lines[0]:
            raise SchemaSyntaxError("expected a comment, a rule or delimiters", 1, 1, "", ("//", "name:", "delimiters:"))
        out = cls()
        for number, line in enumerate(lines, 1):
            body = line.lstrip(" ")
            if not body:
                continue
            if body.startswith("//"):
                if len(body) == 2:
                    raise SchemaSyntaxError("expected text after '//'", number, len(line) + 1, line, ("character",))
            elif body.startswith("delimiters:"):
                out = out.with_delimiters(body.removeprefix("delimiters:"), escaped=True, line=number)
            else:
                out = out._with(_rule(line, number), len(out.rules))
        return out

    def with_rule(self, definition: str, priority: int = -1) -> LogSchema:
        """definition: name:pattern. priority: 0 is the highest, -1 the lowest."""
        if definition.startswith("delimiters:"):
            raise ValueError("delimiters are no rule")
        if not definition:
            raise SchemaSyntaxError("expected a rule", 1, 1)
        if not -1 <= priority <= len(self.rules):
            raise ValueError(f"priority {priority} is out of range")
        return self._with(_rule(definition, 1), len(self.rules) if priority == -1 else priority)

    def _with(self, rule: Rule, at: int) -> LogSchema:
        return replace(self, rules=(*self.rules[:at], rule, *self.rules[at:]))

    def with_delimiters(self, chars: str, escaped: bool = False, line: int = 1) -> LogSchema:
        """Replaces those given before."""
        out, i = "", 0
        while i < len(chars):
            c = chars[i]
            if escaped and c == "\\":
                i += 1
                if chars[i : i + 1] not in DELIMITER_ESCAPES:
                    raise SchemaSyntaxError("unknown escape in delimiters", line, i + 1, chars, tuple(DELIMITER_ESCAPES))
                c = DELIMITER_ESCAPES[chars[i]]
            elif not (" " <= c <= "~" or c in DELIMITER_ESCAPES.values()):
                raise SchemaSyntaxError("a delimiter must be printable ASCII or white space", line, i + 1, chars)
            out, i = out + c, i + 1
        if not out:
            raise SchemaSyntaxError("expected a delimiter", line, len("delimiters:") + 1)
        return replace(self, delimiters="".join(dict.fromkeys(out)))

    @property
    def names(self) -> list[str]:
        return list(dict.fromkeys(r.name for r in self.rules))

    @property
    def symbols(self) -> list[str]:
        """Names by number, as tokens have them: the line feed first, then the rules' names in order of priority."""
        return list(dict.fromkeys([NEWLINE, *self.names]))

    def symbol_of(self, name: str) -> int:
        """The number of a name; KeyError if no rule has it."""
        if name not in self.symbols:
            raise KeyError(f"no rule is named {name!r}")
        return self.symbols.index(name)

    def name_of(self, symbol: int) -> str:
        """The name of a number; KeyError if there is none."""
        if not 0 <= symbol < len(self.symbols):
            raise KeyError(f"no name has the number {symbol}")
        return self.symbols[symbol]

    def rule(self, rule_id: int) -> Rule:
        """A rule by its place in the order of priority, from 0; KeyError if there is none."""
        if not 0 <= rule_id < len(self.rules):
            raise KeyError(f"no rule has the id {rule_id}")
        return self.rules[rule_id]

    def capture_names(self, name: str) -> list[str]:
        return [c for r in self.rules if r.name == name for c in regex.captures(regex.parse(r.pattern))]

    def table(self, spark):
        """The rules as a small DataFrame."""
        rows = [(i, r.name, i, r.pattern) for i, r in enumerate(self.rules)]
        return spark.createDataFrame(rows, "rule_id int, name string, priority int, pattern string")


def _rule(line: str, number: int) -> Rule:
    found = re.match(r" *([A-Za-z0-9_]+):", line)
    if not found:
        raise SchemaSyntaxError("expected 'name:pattern'", number, len(line) - len(line.lstrip(" ")) + 1, line, ("name:",))
    pattern = line[found.end() :]
    try:
        regex.parse(pattern)
    except regex.PatternError as e:
        raise SchemaSyntaxError(str(e), number, found.end() + e.position + 1, line, e.expected) from e
    return Rule(found[1], pattern, number)


#: Ways in which log lines open, by where they are common; TIME and DAY stand for the parts below.
OPENINGS = (
    r"(?<timestamp>DAY[T ]TIMEFRACTIONZONE)",  # ISO 8601
    r"\[(?<timestamp>DAY[T ]TIMEFRACTIONZONE)\]",
    r"\[[A-Z]{4,5} {0,1}\] (?<timestamp>DAY[T ]TIMEFRACTIONZONE)",  # level first
    r"(?<timestamp>\d{8}T\d{6}Z{0,1})",  # ISO 8601 without separators
    r"(?<timestamp>\d{4}/\d{2}/\d{2} TIMEFRACTION)",  # web servers' error logs, Go
    r"(?<timestamp>\d{2}/\d{2}/\d{2} TIME)",  # two-digit years
    r"(?<timestamp>\d{1,2}/\d{1,2}/\d{4},{0,1} \d{1,2}:\d{2}:\d{2}( (AM|PM)){0,1})",  # month first
    r"(?<timestamp>\d{2}\.\d{2}\.\d{4} TIMEFRACTION)",  # day first
    r"(?<timestamp>MONTH [ \d]\d TIME)",  # syslog
    r"\<(?<priority>\d{1,3})\>(?<timestamp>MONTH [ \d]\d TIME)",  # syslog as sent
    r"\<(?<priority>\d{1,3})\>\d (?<timestamp>DAYTTIMEFRACTIONZONE)",  # syslog, newer
    r"(?<timestamp>WEEKDAY MONTH [ \d]\d TIME \d{4})",  # as C's asctime prints it
    r"\[(?<timestamp>WEEKDAY MONTH [ \d]\d TIMEFRACTION \d{4})\]",  # web servers' error logs
    r"(?<timestamp>WEEKDAY, \d{2} MONTH \d{4} TIME (GMT|UTC|[+\-]\d{4}))",  # mail
    r"(?<timestamp>MONTH \d{1,2}, \d{4} \d{1,2}:\d{2}:\d{2} (AM|PM))",  # Java's logging
    r"(?<timestamp>\d{1,2}\-MONTH\-\d{4} TIMEFRACTION)",  # servlet containers, databases
    r"(?<host>[\w.:\-]+) [^ \n]+ [^ \n]+ \[(?<timestamp>\d{2}/MONTH/\d{4}:TIME [+\-]\d{4})\]",  # web servers' access logs
    r"(?<level>[IWEF])(?<timestamp>\d{4} TIME\.\d{6})",  # C++ services
    r"(?<timestamp>\d{2}\-\d{2} TIME\.\d{3})",  # phones
    r"(?<timestamp>\d{6} TIME)",  # old databases
    r"(?<timestamp>\d{6} \d{6}) ",  # old file systems
    r"\[ {0,6}(?<timestamp>\d{1,7}\.\d{6})\]",  # kernel: seconds since boot
    r"(?<timestamp>1\d{9}\.\d{3,6})",  # seconds since 1970
    r"(?<timestamp>1\d{12})",  # milliseconds since 1970
    r"\[(?<timestamp>TIMEFRACTION)\]",  # time alone
    r"(?<timestamp>TIME[.,]\d{3})",
    r'\{"(time|ts|timestamp|@timestamp)": {0,1}"(?<timestamp>DAY[T ]TIMEFRACTIONZONE)"',  # lines of JSON
)
_PARTS = {
    "FRACTION": r"([.,]\d{1,9}){0,1}", "ZONE": r"( {0,1}(Z|[+\-]\d{2}:{0,1}\d{2})){0,1}", "WEEKDAY": "(Mon|Tue|Wed|Thu|Fri|Sat|Sun)",
    "MONTH": "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)", "TIME": r"\d{2}:\d{2}:\d{2}", "DAY": r"\d{4}\-\d{2}\-\d{2}",
}


def _spelled(opening: str) -> str:
    return re.sub("|".join(_PARTS), lambda m: _PARTS[m[0]], opening)


#: A schema for common logs.
DEFAULT = "\n".join(["// Openings of events, and variables, of common logs", r"""delimiters: \t\r\n,;|()"'<>""", *(f"header:{_spelled(x)}" for x in OPENINGS), r"""level:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERROR|CRITICAL|FATAL
uuid:[0-9a-f]{8}\-[0-9a-f]{4}\-[0-9a-f]{4}\-[0-9a-f]{4}\-[0-9a-f]{12}
address:(?<ip>\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})(:(?<port>\d{1,5})){0,1}
number:[+\-]{0,1}\d+
decimal:[+\-]{0,1}\d+\.\d+
size:\d+(\.\d+){0,1}(ms|us|ns|s|B|kB|KB|MB|GB|%)
hexadecimal:0x[0-9A-Fa-f]+
setting:(?<name>[A-Za-z_][\w.\-]*)[=:](?<value>[^ \t\r\n,;|()"'\<\>]*\d[^ \t\r\n,;|()"'\<\>]*)
file:/{0,1}([\w.\-]+/)+[\w.\-]*
mixed:[^ \t\r\n,;|()"'\<\>]*\d[^ \t\r\n,;|()"'\<\>]*
"""])
