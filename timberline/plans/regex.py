"""Patterns of variable rules: parsing, validation, and translation to Python's re over bytes.

A pattern is a tree of tuples: ("set", mask), ("cat", parts), ("alt", parts), ("rep", part, least, most or None), ("cap", name, part).
A mask has a bit for each byte, and bit START for the start of the input.
"""

from __future__ import annotations

import re

START = 256
ALL_BYTES = (1 << 256) - 1
# Characters that must be escaped, classes, and control escapes.
SPECIAL = set("()*+-.[\\]^{|}<>?")
DIGIT, SPACE, WORD = b"0123456789", b" \t\n\r\x0b\f", b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"
CONTROL = {"t": "\t", "n": "\n", "v": "\x0b", "f": "\f", "r": "\r"}


#: What an expression can begin with.
ATOMS = ("character", "(", "[", ".", "\\")


class PatternError(ValueError):
    """A pattern that the language doesn't have; position counts from 0 in the pattern. expected: what could have stood there."""

    def __init__(self, message: str, position: int, expected: tuple[str, ...] = ()):
        super().__init__(f"{message} at position {position}")
        self.position, self.expected = position, expected


def mask_of(chars: bytes) -> int:
    out = 0
    for c in chars:
        out |= 1 << c
    return out


_CLASSES = {"d": mask_of(DIGIT), "s": mask_of(SPACE), "w": mask_of(WORD)}
_CLASSES |= {k.upper(): ALL_BYTES & ~m for k, m in _CLASSES.items()}


class _Parser:
    def __init__(self, text: str, dot: int):
        self.text, self.at, self.dot = text, 0, dot

    def fail(self, message: str, *expected: str):
        raise PatternError(message, self.at, expected)

    def peek(self) -> str:
        return self.text[self.at] if self.at < len(self.text) else ""

    def take(self, expected: str = "") -> str:
        c = self.peek()
        if not c or expected and c != expected:
            self.fail(f"expected {expected!r}" if expected else "unexpected end", *([expected] if expected else ATOMS))
        self.at += 1
        return c

    def alternation(self):
        parts = [self.sequence()]
        while self.peek() == "|":
            self.at += 1
            parts.append(self.sequence())
        return parts[0] if len(parts) == 1 else ("alt", parts)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated())
        if not parts:
            self.fail("empty expression", *ATOMS)
        return parts[0] if len(parts) == 1 else ("cat", parts)

    def repeated(self):
        part = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.at += 1
            if c == "{":
                least = self.number()
                most = least
                if self.peek() == ",":
                    self.at += 1
                    most = self.number() or None  # {n,0}: without end
                elif least == 0:
                    self.fail("{0} repeats nothing", ",")
                self.take("}")
                if most is not None and most < least:
                    self.fail("bounds in the wrong order")
            else:
                least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}[c]
            part = ("rep", part, least, most)
        return part

    def number(self) -> int:
        found = re.match(r"\d+", self.text[self.at :])
        if not found:
            self.fail("expected a number", "digit")
        self.at += found.end()
        return int(found[0])

    def atom(self):
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.at += 1
                self.take("<")
                found = re.match(r"[A-Za-z0-9_]+", self.text[self.at :])
                if not found:
                    self.fail("expected a capture name", "letter", "digit", "_")
                self.at += found.end()
                self.take(">")
                inner = ("cap", found[0], self.alternation())
            else:
                inner = self.alternation()
            self.take(")")
            return inner
        if c == "[":
            return ("set", self.char_class())
        if c == ".":
            return ("set", self.dot)
        if c == "\\":
            return ("set", self.escaped())
        if c in SPECIAL and c != "-":
            self.at -= 1
            self.fail(f"{c!r} must be escaped")
        return ("set", self.literal(c))

    def literal(self, c: str) -> int:
        if ord(c) > 126 or ord(c) < 32 and c != "\t":
            self.fail("only printable ASCII may stand in a pattern")
        return 1 << ord(c)

    def escaped(self) -> int:
        c = self.take()
        if c in _CLASSES:
            return _CLASSES[c]
        if c in CONTROL:
            return 1 << ord(CONTROL[c])
        if c in SPECIAL:
            return 1 << ord(c)
        self.at -= 1
        self.fail(f"unknown escape \\{c}", *sorted({*_CLASSES, *CONTROL, *SPECIAL}))

    def char_class(self) -> int:
        negated = self.peek() == "^"
        self.at += negated
        out = 0
        while self.peek() != "]":
            start = self.take()
            mask = self.escaped() if start == "\\" else self.class_char(start)
            if self.peek() == "-" and self.text[self.at + 1 : self.at + 2] not in ("]", ""):
                self.at += 1
                end = self.take()
                last = self.escaped() if end == "\\" else self.class_char(end)
                if mask.bit_count() != 1 or last.bit_count() != 1:
                    self.fail("a class can't bound a range")
                if last < mask:
                    self.fail("inverted range")
                mask = (last << 1) - mask
            out |= mask
        self.take("]")
        if not out:
            self.fail("empty class")
        return ALL_BYTES & ~out if negated else out

    def class_char(self, c: str) -> int:
        if c in "[^" or c in SPECIAL and c not in "-.":
            if c not in "()*+{|}<>?":
                self.fail(f"{c!r} must be escaped")
        return self.literal(c)


def parse(text: str, dot: int = ALL_BYTES):
    """The tree of a pattern; dot: what `.` stands for."""
    parser = _Parser(text, dot)
    tree = parser.alternation()
    if parser.at < len(text):
        parser.fail(f"unexpected {parser.peek()!r}", "end", "|", *ATOMS)
    return tree


def captures(tree) -> list[str]:
    """Capture names in order, inner before outer."""
    kind = tree[0]
    if kind == "set":
        return []
    inner = [n for part in (tree[1] if kind in ("cat", "alt") else [tree[2] if kind == "cap" else tree[1]]) for n in captures(part)]
    return [*inner, tree[1]] if kind == "cap" else inner


def holds(tree, mask: int) -> bool:
    """Whether some set of the tree meets the mask."""
    if tree[0] == "set":
        return bool(tree[1] & mask)
    return any(holds(p, mask) for p in (tree[1] if tree[0] in ("cat", "alt") else [tree[2] if tree[0] == "cap" else tree[1]]))


def to_re(tree, names: list[str]) -> str:
    """The same language for Python's re over bytes; captures become numbered groups, whose names are appended."""
    kind = tree[0]
    if kind == "set":
        members = [i for i in range(256) if tree[1] >> i & 1]
        return "[" + "".join(f"\\x{i:02x}" for i in members) + "]" if len(members) < 256 else "[\\x00-\\xff]"
    if kind == "cat":
        return "".join(to_re(p, names) for p in tree[1])
    if kind == "alt":
        return "(?:" + "|".join(to_re(p, names) for p in tree[1]) + ")"
    if kind == "rep":
        most = "" if tree[3] is None else tree[3]
        return f"(?:{to_re(tree[1], names)}){{{tree[2]},{most}}}"
    names.append(tree[1])
    return f"({to_re(tree[2], names)})"


def show(tree) -> str:
    """A readable form, for error messages and tests."""
    kind = tree[0]
    if kind == "set":
        runs, i = [], 0
        while i <= START:
            if tree[1] >> i & 1:
                j = i
                while tree[1] >> (j + 1) & 1:
                    j += 1
                runs.append(_char(i) if i == j else f"{_char(i)}-{_char(j)}")
                i = j
            i += 1
        return runs[0] if tree[1].bit_count() == 1 else "[" + ",".join(runs) + "]"
    if kind in ("cat", "alt"):
        return "(" + {"cat": "", "alt": "|"}[kind].join(map(show, tree[1])) + ")"
    if kind == "rep":
        return f"{show(tree[1])}{{{tree[2]},{'inf' if tree[3] is None else tree[3]}}}"
    return f"<{tree[1]}:{show(tree[2])}>"


def _char(i: int) -> str:
    return chr(i) if 32 < i < 127 else "START" if i == START else f"\\x{i:02x}"
