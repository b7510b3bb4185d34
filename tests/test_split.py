"""Files cut into byte ranges give the events of whole files."""

import random

import pytest
from pyspark.sql import functions as F

from timberline.operators.kernel import Lexer
from timberline.plans.schema import LogSchema
from timberline.sources import LogSource, read_split
from timberline.sources.split import splittable

HEADED = LogSchema.parse("delimiters: \\n:\nheader:(?<timestamp>\\d{2}:\\d{2})\nint:\\d+\n")
PLAIN = LogSchema.parse("delimiters: \\n,\nint:\\d+\nkv:[a-z]+=[a-z, ]+\n")
PARTS = ["12:34 x 5\n", "7\n", "\n", "\n\n", "word 12:34 9\n", " 8\n", "a=b, c\n", "é 3\n", "12:3\n", "\r\n", "x", "12:34", "plain text here\n"]


def texts(seed: int) -> list[str]:
    pick = random.Random(seed)
    made = ["".join(pick.choices(PARTS, k=pick.randint(1, 60))) for _ in range(12)]
    return [*made, "no header\n" * 40, "\n" * 90, "12:34 a\n" + "more\n" * 60 + "12:35 b", "a\n", "a", "\n", ""]


@pytest.mark.parametrize("schema", [HEADED, PLAIN])
@pytest.mark.parametrize("size", ["16", "61"])
def test_ranges_give_the_events_of_whole_files(spark, tmp_path, schema, size):
    for i, text in enumerate(made := texts(int(size))):
        (tmp_path / f"{i:03}.log").write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_split(spark, f"file://{tmp_path}", schema, ("raw", "logtype", "timestamp", "line_start")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert len({r.block for r in rows}) > 3
    lexer = Lexer(schema)
    for i, text in enumerate(made):
        got = sorted((r for r in rows if r.source.endswith(f"{i:03}.log")), key=lambda r: (r.block, r.byte_start))
        data = text.encode()
        assert [(r.raw, r.logtype, r.timestamp) for r in got] == [(data[e.start : e.end].decode(), lexer.logtype(data, e).decode(), lexer.timestamp(data, e)) for e in lexer.events(data)], (i, text)
        assert all(r.byte_end - r.byte_start == len(r.raw.encode()) for r in got)


@pytest.mark.parametrize("schema", [HEADED, PLAIN])
@pytest.mark.parametrize("size", [16, 61])
def test_ranges_of_the_data_source_give_the_events_of_whole_files(spark, tmp_path, schema, size):
    for i, text in enumerate(made := texts(size)):
        (tmp_path / f"{i:03}.log").write_bytes(text.encode())
    spark.dataSource.register(LogSource)
    rules = f"delimiters: {schema.delimiters.encode('unicode_escape').decode()}\n" + "\n".join(f"{r.name}:{r.pattern}" for r in schema.rules)
    read = spark.read.schema("source string, byte_start long, raw string, logtype string, tokens array<struct<text string, byte_end long>>").format("timberline").option("rules", rules).option("rangeBytes", size)
    rows = read.load(str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in rows}) > len({r.source for r in rows})
    lexer = Lexer(schema)
    for i, text in enumerate(made):
        got = sorted((r for r in rows if r.source.endswith(f"{i:03}.log")), key=lambda r: r.byte_start)
        data = text.encode()
        want = [(e.start, data[e.start : e.end].decode(), lexer.logtype(data, e).decode(), [(data[t.start : t.end].decode(), t.end) for t in e.tokens]) for e in lexer.events(data)]
        assert [(r.byte_start, r.raw, r.logtype, [tuple(t) for t in r.tokens]) for r in got] == want, (i, text)


def test_rules_over_lines_cannot_be_cut(spark, tmp_path):
    schema = LogSchema(" \n").with_rule("pair:[a-z]+\\n[a-z]+")
    assert not splittable(schema)
    with pytest.raises(ValueError):
        read_split(spark, f"file://{tmp_path}", schema)
