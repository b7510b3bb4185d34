import pytest

from timberline.plans import automaton, regex
from timberline.plans.regex import PatternError
from timberline.plans.schema import DEFAULT, OPENINGS, LogSchema, SchemaSyntaxError


def test_a_schema_text():
    s = LogSchema.parse("// ports and ships\ndelimiters: \\t\\n\n pier:[A-F]\r\nship:s(?<hull_1>[0-9]+)\ndelimiters:,;\n")
    assert s.delimiters == ",;" and s.names == ["pier", "ship"] and s.capture_names("ship") == ["hull_1"]
    default = LogSchema.parse(DEFAULT)
    assert len([r for r in default.rules if r.name == "header"]) == len(OPENINGS) >= 22 and len(default.names) == 11


def test_a_schema_file(tmp_path):
    (tmp_path / "ports.txt").write_text("delimiters: \\n\nship:s[0-9]+\n")
    s = LogSchema.from_file(str(tmp_path / "ports.txt"))
    assert s.delimiters == " \n" and [(r.name, r.pattern, r.line) for r in s.rules] == [("ship", "s[0-9]+", 2)]


def test_names_and_numbers():
    s = LogSchema(" ").with_rule("ship:s").with_rule("pier:p").with_rule("ship:t")
    assert s.symbols == ["newLine", "ship", "pier"] and [s.symbol_of(n) for n in s.symbols] == [0, 1, 2] and s.name_of(2) == "pier"
    assert s.rule(2).pattern == "t"
    for wrong in (lambda: s.symbol_of("dock"), lambda: s.name_of(3), lambda: s.name_of(-1), lambda: s.rule(3)):
        with pytest.raises(KeyError):
            wrong()


@pytest.mark.parametrize("text,column,expected", [("a:b(", 5, "("), ("a:b)", 4, "|"), ("a:b{x}", 5, "digit"), ("a:(?x)", 5, "<"), ("", 1, "delimiters:"), ("ab", 1, "name:"), ("a:\\q", 4, "d"), ("delimiters:\\q", 2, "t")])
def test_errors_say_what_could_stand_there(text, column, expected):
    with pytest.raises(SchemaSyntaxError) as e:
        LogSchema.parse(text)
    assert e.value.column == column and expected in e.value.expected and (not text or f"{text}" in str(e.value) or text.startswith("delimiters"))


@pytest.mark.parametrize("text,line", [("\na:b", 1), ("//\n", 1), ("a:b\nship=7", 2), ("ship:[s7", 1), ("a:b\ndelimiters:", 2), ("a:", 1), ("x y:z", 1)])
def test_errors_name_the_place(text, line):
    with pytest.raises(SchemaSyntaxError) as e:
        LogSchema.parse(text)
    assert e.value.line == line


def test_rules_by_priority():
    s = LogSchema(" ").with_rule("a:1", 0).with_rule("b:2", 1)
    assert s.with_rule("c:3", 0).names == ["c", "a", "b"] and s.with_rule("c:3").names == ["a", "b", "c"]
    for bad in (3, -2):
        with pytest.raises(ValueError):
            s.with_rule("c:3", bad)
    with pytest.raises(ValueError):
        s.with_rule("delimiters:;")
    for bad in ("", "ship=7", "ship:[s7"):
        with pytest.raises(SchemaSyntaxError):
            s.with_rule(bad)
    with pytest.raises(SchemaSyntaxError):
        s.with_delimiters("")


@pytest.mark.parametrize("pattern,shown", [
    ("x{0,7}", "x{0,7}"), ("x{2,7}", "x{2,7}"), ("a*", "a{0,inf}"), ("a+", "a{1,inf}"), ("a?", "a{0,1}"), ("a{3,0}", "a{3,inf}"), ("a{3}", "a{3,3}"),
    ("xy|z", "((xy)|z)"), ("(x|y)*z+", "((x|y){0,inf}z{1,inf})"), ("(x|y)+|z", "((x|y){1,inf}|z)"), ("(?<n>a)|b", "(<n:a>|b)"),
    (r"\d", "[0-9]"), (r"[a\-z]", "[\\x2d,a,z]".replace("\\x2d", "-")), ("no-x", "(no-x)"), ("[a-c-]", "[-,a-c]"),
])
def test_shapes(pattern, shown):
    assert regex.show(regex.parse(pattern)) == shown


@pytest.mark.parametrize("pattern", ["", "(", "a)", "[z-a]", "[]", "a{0}", "a{2,1}", "^a", "a<", "(?:a)", r"\b", "a{,3}", "é", "*", "a|"])
def test_what_the_language_lacks(pattern):
    with pytest.raises(PatternError):
        regex.parse(pattern)


def test_classes():
    for name, members in (("d", b"5"), ("s", b" \t\n\r\x0b\f"), ("w", b"a_9")):
        for c in members:
            assert regex.parse(f"\\{name}")[1] >> c & 1 and not regex.parse(f"\\{name.upper()}")[1] >> c & 1
    assert regex.parse("[^a]")[1] >> 0xC3 & 1


def test_automata():
    dfa = automaton.build([(0, regex.parse(r"\d+")), (1, regex.parse(r"[A-Za-z]*\d+[A-Za-z]*"))])
    assert dfa.accepting(b"12") == (0, 1) and dfa.accepting(b"a1") == (1,) and dfa.accepting(b"a") == ()
    assert automaton.common_rules(dfa, automaton.build([(0, regex.parse(".*1.*"))])) == {0, 1}
    assert automaton.common_rules(dfa, automaton.build([(0, regex.parse(".*=.*"))])) == set()
    assert len(automaton.build([(0, regex.parse("ship 77"))]).table) == 8


def test_rules_table(spark):
    rows = LogSchema(" ").with_rule("a:1").with_rule("b:2").table(spark).collect()
    assert [(r.name, r.priority, r.pattern) for r in rows] == [("a", 0, "1"), ("b", 1, "2")]
