"""The DataFrame operators, sources, SQL functions and streams."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from timberline import queries
from timberline.functions import register
from timberline.operators import native, parse
from timberline.operators.kernel import Lexer
from timberline.plans.schema import LogSchema
from timberline.sources import LogSource, read_callback, read_logs, read_until, write_raw
from timberline.streaming import parse_stream
from timberline.streaming.parse_stream import in_order

LOG = "2024-01-01 00:00:00.000001 ERROR user_7 value=1.50 props={\"k\": 3}\n#0 frame\n#1 frame\n2024-01-01 00:00:00.000002 VIEW user_8 value=2.00 props={\"k\": 4}\n"
ODD = ["", "\n", "\n\n\na 1\n", " 12 a", "a\r\n12\r\n", "é1 12é 1é2", "12", "\n12\n\n13x", "a:b,c 1.5!"]


def test_events_of_a_column(spark):
    df = spark.createDataFrame([(1, LOG), (2, None), (3, "")], "id long, text string")
    got = parse.parse_column(df, queries.LINES).collect()
    assert [(r.id, r.event_idx, r.timestamp[-1], r.is_multiline, r.line_start) for r in got] == [(1, 0, "1", True, 0), (1, 1, "2", False, 3)]
    assert "".join(r.raw for r in got) == LOG and got[0].byte_end == got[1].byte_start
    assert got[0].logtype == '<timestamp> <loglevel> user_<userID> value=<val> props={"k": <k>}<newLine>#0 frame<newLine>#1 frame\n'
    assert [t.line for t in got[0].tokens][-6:] == [1, 1, 1, 2, 2, 2]
    found = parse.variables(parse.parse_column(df, queries.LINES), "user").collect()
    assert [r.text for r in found] == [" user_7", " user_8"] and found[0].captures[0].text == "7"
    wide = parse.pivot_variables(parse.parse_column(df, queries.LINES), ["loglevel"]).collect()
    assert [r.loglevel for r in wide] == [" ERROR", " VIEW"]
    assert parse.multiline(parse.parse_column(df, queries.LINES)).count() == 1


def test_only_what_is_asked_for(spark):
    df = spark.createDataFrame([(1, LOG)], "id long, text string")
    assert parse.parse_column(df, queries.LINES, keep=[], outputs=("logtype",)).columns == ["logtype"]


def test_native_tokens_are_the_kernels(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")
    got = {r.id: [(t.text, t.rule) for t in r.t] for r in df.select("id", native.tokens("text", queries.NUMBERS).alias("t")).collect()}
    lexer = Lexer(queries.NUMBERS)
    for i, t in enumerate(ODD):
        data = t.encode()
        assert got[i] == [(data[x.start : x.end].decode(), lexer.names[x.rules[0]] if x.rules else None) for x, _ in lexer.scan(data)]


HEADED = LogSchema.parse("delimiters: \\n:\nheader:(?<timestamp>\\d{2}:\\d{2})\nheader:T(?<timestamp>\\d{1,0})x{0,1}\nword:[a-z]+=\\d+\n")
LINE_PARTS = ["12:34", "12:34 x 5\n", "12:34\n", "\n", "\n\n", "word 12:34 9\n", " 12:34\n", "a=5\n", "é 3\n", "12:345\n", "\r\n", "x", "T5x\n", "T5xy\n", "T77:", "text\n"]


@pytest.mark.parametrize("schema", [queries.NUMBERS, HEADED, queries.LINES, LogSchema("\n").with_rule("header:\\d{2}:\\d{2}")])
def test_native_events_are_the_kernels(spark, schema):
    pick = random.Random(7)
    made = [*ODD, LOG, *("".join(pick.choices(LINE_PARTS, k=pick.randint(1, 12))) for _ in range(400))]
    rows = native.event_rows(spark.createDataFrame([(i, t) for i, t in enumerate([*made, None])], "id long, text string"), schema).collect()
    lexer, got = Lexer(schema), {}
    for r in sorted(rows, key=lambda r: r.event_idx):
        got.setdefault(r.id, []).append(r.raw)
    for i, t in enumerate(made):
        data = t.encode()
        assert got.get(i, []) == [data[e.start : e.end].decode() for e in lexer.events(data)], t
    assert len(made) not in got


@pytest.mark.parametrize("rules", [["header:\\d+", "int:\\d+\\.\\d+"], ["header:[^a]+"]])
def test_events_that_need_the_kernel(rules):
    schema = LogSchema(" \n")
    for r in rules:
        schema = schema.with_rule(r)
    with pytest.raises(native.NotNative):
        native.events("text", schema)


@pytest.mark.parametrize("rules", ["", "a:a*\nb:[a1]+\na:1b?", "newLine:1+\nn:-?1+\nw:[^ ,\\n]*1[^ ,\\n]*", "x:(ab|1){0,3}"])
def test_counts_on_the_text_are_those_of_its_tokens(spark, rules):
    rng = random.Random(8)
    schema = LogSchema.parse("delimiters: ,\\n\n" + rules) if rules else queries.NUMBERS
    texts = [*ODD, None, "a" * 100_000, "1," * 50_000, *("".join(rng.choices("ab1é🙂- ,\n", k=rng.randint(0, 12))) for _ in range(1500))]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    names = [None, "newLine", *schema.names, "unknown"]
    for r in df.select(native.tokens("text", schema)["rule"].alias("found"), F.array(*native.rule_counts("text", schema, names)).alias("n"), "text").collect():
        assert r.n == ([None] * len(names) if r.text is None else [r.found.count(x) for x in names]), r.text


def test_native_templates_are_the_kernels(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "id long, text string")
    got = {r.id: r.t for r in df.select("id", native.template("text", queries.NUMBERS).alias("t")).collect()}
    lexer = Lexer(queries.NUMBERS)
    for i, t in enumerate(ODD):
        data = t.encode()
        assert got[i] == b"".join(lexer.logtype(data, e) for e in lexer.events(data)).decode()
    with pytest.raises(native.NotNative):
        native.template("text", queries.PROPS)


@pytest.mark.parametrize("schema", [queries.LINES, LogSchema(" ").with_rule("a:b c"), LogSchema(" "), LogSchema(" ").with_rule("a:[^ \\n]{3}")])
def test_what_needs_the_kernel(schema):
    with pytest.raises(native.NotNative):
        native.rule_patterns(schema)


@pytest.mark.parametrize("rule", ["v:(ab|c)+", "v:(ab)*c", "v:(a[0-9]|bc){2,900}"])
def test_long_repetitions_need_the_kernel(rule):
    """Java's matcher takes a stack frame for each round of such a repetition."""
    with pytest.raises(native.NotNative):
        native.tokens("text", LogSchema(" \n").with_rule(rule))


def test_long_texts(spark):
    schema = LogSchema(" \n").with_rule("v:(a|b|[c-e])+").with_rule("w:x{0,1}(yz|z){1,3}\\d*")
    texts = ["ab" * 100_000, "ab" * 100_000 + "f", "xyzz" + "7" * 200_000, "q" * 200_000 + " c"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").select("id", native.tokens("text", schema).alias("t")).collect()
    assert {r.id: [x.rule for x in r.t] for r in rows} == {0: ["v"], 1: [None], 2: ["w"], 3: [None, "v"]}
    lexer = Lexer(schema)
    for r in rows:
        assert [x.rule for x in r.t] == [lexer.names[x.rules[0]] if x.rules else None for x, _ in lexer.scan(texts[r.id].encode())]


def test_columns_of_the_outputs_names(spark):
    df = spark.createDataFrame([(1, LOG, "old", "old", 9)], "id long, text string, RAW string, rule string, event_idx int")
    assert parse.parse_column(df, queries.LINES, outputs=("event_idx", "raw")).columns == ["id", "rule", "event_idx", "raw"]
    assert [r.raw for r in native.event_rows(df, queries.LINES).orderBy("event_idx").collect()] == [r.raw for r in parse.parse_column(df, queries.LINES, outputs=("raw",)).collect()]
    found = parse.variables(parse.parse_column(df, queries.LINES), "user")
    assert len({c.lower() for c in found.columns}) == len(found.columns) and found.select("rule", "raw").first().rule == "user"
    assert parse.capture_positions(df.withColumn("name", F.lit("old")), queries.LINES, "user").select("name").distinct().collect() == [("userID",)]
    assert "loglevel" in parse.pivot_variables(parse.parse_column(df, queries.LINES).withColumn("loglevel", F.lit(1)), ["loglevel"]).columns


def test_events_are_written_as_they_were_read(spark, tmp_path):
    for n, text in enumerate(["a\n\n\nb\n", "a\n", "\n\n", LOG, "a\n\n"]):
        out = str(tmp_path / str(n))
        df = spark.createDataFrame([(text,)], "text string")
        write_raw(parse.parse_column(df, queries.LINES if text == LOG else queries.NUMBERS, outputs=("raw",)), out)
        assert "".join(p.read_text() for p in sorted((tmp_path / str(n)).glob("part-*"))) == text


def test_counts_within_a_row(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*ODD, None])], "id long, text string")
    rules = [None, "newLine", "int", "hasNumber"]
    got = df.select("id", F.array(*native.rule_counts("text", queries.NUMBERS, rules)).alias("n")).collect()
    lexer = Lexer(queries.NUMBERS)
    for r in got[:-1]:
        found = [lexer.names[x.rules[0]] if x.rules else None for x, _ in lexer.scan(ODD[r.id].encode())]
        assert r.n == [found.count(x) for x in rules]


def test_parts_of_tokens(spark):
    df = spark.createDataFrame([("  user_7 é9:x",)], "text string")
    schema = LogSchema(" \n").with_rule(r"word:[^ \n]*\d[^ \n]*")
    tokens = parse.parse_column(df, schema, outputs=("tokens",)).select(F.explode("tokens").alias("t"))
    got = tokens.select(parse.delimiter_of(F.col("t")).alias("d"), parse.body_of(F.col("t")).alias("b"), parse.bytes_of(F.col("t")).alias("n"), parse.part_of(F.col("t"), 1, 5).alias("p"), parse.part_of(F.col("t"), -3, 99).alias("w")).collect()
    assert [tuple(r) for r in got] == [("", " ", 1, "", " "), (" ", "user_7", 7, "user", " user_7"), (" ", "é9:x", 6, "é9:", " é9:x")]


def test_inputs_from_callables_and_the_data_source(spark, tmp_path):
    pieces = lambda: iter([LOG.encode()[:20], LOG.encode()[20:]])
    got = read_callback(spark, {"one": pieces, "none": lambda: []}, queries.LINES).collect()
    want = parse.parse_column(spark.createDataFrame([("one", LOG)], "source string, text string"), queries.LINES).collect()
    assert got == want
    assert read_callback(spark, {}, queries.LINES).collect() == []
    (tmp_path / "x.log").write_text(LOG)
    spark.dataSource.register(LogSource)
    rules = "delimiters: \\n\n" + "\n".join(f"{r.name}:{r.pattern}" for r in queries.LINES.rules)
    read = spark.read.format("timberline").option("rules", rules).load(str(tmp_path)).drop("source").collect()
    assert read == [r[1:] for r in want]
    assert sorted(r.piece for r in read_until(spark, str(tmp_path), "user_").collect()) == sorted(LOG.split("user_"))


def test_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(LOG)
    (tmp_path / "b.log").write_text(LOG * 2)
    got = read_logs(spark, f"file://{tmp_path}", queries.LINES, ("event_idx", "raw"))
    assert sorted((r.source[-5:], r.event_idx) for r in got.collect()) == [("a.log", 0), ("a.log", 1), ("b.log", 0), ("b.log", 1), ("b.log", 2), ("b.log", 3)]


def test_files_are_read_by_pieces(spark, tmp_path):
    """A task reads a file itself, so no row holds one."""
    (tmp_path / "a %20é").mkdir()
    text = LOG * 9_000 + "last"  # some pieces
    (tmp_path / "a %20é" / "b c.log").write_text(text)
    (tmp_path / "a %20é" / "empty.log").write_text("")
    got = read_logs(spark, str(tmp_path / "a %20é"), queries.LINES, ("event_idx", "byte_start", "line_start", "raw", "is_multiline"))
    assert "content" not in got._jdf.queryExecution().executedPlan().toString()
    rows = got.orderBy("event_idx").collect()
    want = parse.parse_column(spark.createDataFrame([(text,)], "text string"), queries.LINES, outputs=("event_idx", "byte_start", "line_start", "raw", "is_multiline"))
    assert [r[1:] for r in rows] == want.orderBy("event_idx").collect() and rows[0].source.endswith("/a %20é/b c.log")


def test_files_that_arrow_cannot_open(spark, tmp_path, monkeypatch):
    (tmp_path / "a.log").write_text(LOG)
    got = read_logs(spark, str(tmp_path), queries.LINES).collect()
    monkeypatch.setattr("timberline.sources.logs._opens", lambda path: False)
    assert read_logs(spark, str(tmp_path), queries.LINES).collect() == got and len(got) == 2


def test_search(spark):
    df = spark.createDataFrame([("a%b",), ("axb",), ("a*b",), ("a\\b",)], "raw string")
    for query, want in (("a?b", 4), ("a%b", 1), (r"a\*b", 1), ("*", 4), (r"a\\b", 1)):
        assert parse.search(df, query).count() == want


def test_sql_functions(spark):
    register(spark, queries.LINES, "t_")
    spark.createDataFrame([(LOG,)], "text string").createOrReplaceTempView("logs")
    assert spark.sql("select t_logtype('ERROR user_9') as l, t_logtype(null) as n").first() == ("<loglevel> user_<userID>", None)
    rows = spark.sql("select e.event_idx, e.timestamp, e.is_multiline from logs, lateral t_log_parse(text) e order by 1").collect()
    assert [(r.event_idx, r.is_multiline) for r in rows] == [(0, True), (1, False)]


def test_sql_functions_share_a_pass(spark):
    """Both functions of a text are one step of the plan, and get its events once; nulls and texts of several events included."""
    register(spark, queries.LINES, "s_")
    texts = [LOG, None, "", "ERROR user_9", *(f"VIEW user_{n} é" for n in range(300))]
    got = spark.createDataFrame(list(enumerate(texts)), "id long, text string").selectExpr("id", "s_logtype(text) as l", "s_log_tokens(text) as t")
    assert got._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    lexer = Lexer(queries.LINES)
    for r in got.collect():
        if texts[r.id] is None:
            assert r.l is None and r.t is None
            continue
        data = texts[r.id].encode()
        events = list(lexer.events(data))
        assert r.l == b"".join(lexer.logtype(data, e) for e in events).decode()
        assert [(t.text, t.rule) for t in r.t] == [(data[t.start : t.end].decode(), lexer.names[t.rules[0]] if t.rules else None) for e in events for t in e.tokens]


def test_stream_is_batch(spark, tmp_path):
    text, pieces = LOG * 5, []
    for k in ("x", "y"):
        cuts = sorted({0, len(text), *((i * 37 + ord(k)) % len(text) for i in range(9))})
        pieces += [(k, n, text[a:b]) for n, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    for batch in range(3):
        rows = [p for p in pieces if p[1] // 4 == batch]
        spark.createDataFrame(rows, "k string, seq int, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, seq int, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = parse_stream(source, queries.LINES, "k").writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    whole = spark.createDataFrame([("x", text)], "k string, text string")
    want = [(r.event_idx, r.byte_start, r.line_start, r.raw, r.logtype) for r in parse.parse_column(whole, queries.LINES).collect()]
    for k in ("x", "y"):
        got = sorted((r.event_idx, r.byte_start, r.line_start, r.raw, r.logtype) for r in spark.table("streamed").where(F.col("k") == k).collect())
        assert got == want[: len(got)] and len(got) == len(want) - 1  # the last one waits for more


def test_streamed_tokens(spark, tmp_path):
    spark.createDataFrame([("x", 0, LOG), ("x", 1, LOG)], "k string, seq int, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("k string, seq int, text string").parquet(str(tmp_path / "in"))
    events = parse_stream(source, queries.LINES, "k", outputs=("timestamp", "tokens"))
    assert events.columns == ["k", "event_idx", "byte_start", "byte_end", "line_start", "timestamp", "tokens"]
    events.writeStream.format("memory").queryName("streamed_tokens").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table("streamed_tokens").orderBy("event_idx").select("event_idx", parse.capture("userID").alias("u")).collect()
    assert [(r.event_idx, r.u) for r in got] == [(0, "7"), (1, "8"), (2, "7")]


@pytest.mark.parametrize("run, width", [(1 << 20, 64), (1, 3), (3_000, 2)])
def test_pieces_are_put_in_order_by_runs(monkeypatch, run, width):
    monkeypatch.setitem(in_order.__globals__, "RUN", run)
    monkeypatch.setitem(in_order.__globals__, "WIDTH", width)
    monkeypatch.setitem(in_order.__globals__, "CHUNK", 200)
    pick, taken = random.Random(9), []
    frames = [pd.DataFrame([(pick.choice([None, *range(30)]), f"{i}.{n}" if n % 7 else None) for n in range(pick.randint(1, 40))], columns=["seq", "text"]) for i in range(40)]
    want = pd.concat(frames).sort_values("seq", kind="stable")["text"].fillna("").tolist()

    def seen():
        for f in frames:
            taken.append(len(f))
            yield f

    assert list(in_order(seen(), "seq", "text")) == want and len(taken) == 40
    assert list(in_order([], "seq", "text")) == []


def test_a_key_of_many_pieces(spark, tmp_path):
    """Pieces come out of order in many Arrow batches; the state comes after the last of many events."""
    lines = [line + "\n" for line in (LOG * 3_000).splitlines()]
    spark.createDataFrame([("x", n, t) for n, t in enumerate(lines)], "k string, seq int, text string").orderBy(F.hash("seq")).coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        source = spark.readStream.schema("k string, seq int, text string").parquet(str(tmp_path / "in"))
        query = parse_stream(source, queries.LINES, "k", outputs=("raw",)).writeStream.format("memory").queryName("streamed_many").option("checkpointLocation", str(tmp_path / "cp"))
        query.trigger(availableNow=True).start().awaitTermination(120)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = spark.table("streamed_many").orderBy("event_idx").collect()
    want = [r.raw for r in parse.parse_column(spark.createDataFrame([(LOG * 3_000,)], "text string"), queries.LINES, outputs=("event_idx", "raw")).orderBy("event_idx").collect()]
    assert [r.event_idx for r in got] == list(range(5_999)) and [r.raw for r in got] == want[:-1]


def test_entry_point(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and entry.entry(spark).count() == 1
