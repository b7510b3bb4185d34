"""The examples run."""

import os
import subprocess
import sys

TOP = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(name, *args):
    return subprocess.run([sys.executable, f"{TOP}/examples/{name}.py", *args], env=os.environ | {"PYTHONPATH": TOP}, capture_output=True, text=True, check=True, timeout=120).stdout


def test_examples(tmp_path):
    schema, text = tmp_path / "schema.txt", tmp_path / "a.log"
    schema.write_text("delimiters: \\n\nheader:(?<timestamp>\\d{2}:\\d{2})\nroom:\\d+[a-c]\n")
    text.write_text("12:30 in 7a\n ok\n12:31 out\n")
    assert run("parse_text", str(schema), str(text)).splitlines() == ["0\t12:30\tmulti\t<timestamp> in <room><newLine> ok", "16\t12:31\tone\t<timestamp> out<newLine>"]
    assert run("what_could_match", str(schema), "7*", "x").splitlines()[:2] == ["7* could be room", "    logtype='7**', contains_wildcard='0'"]
