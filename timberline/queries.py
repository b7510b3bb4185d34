"""Queries over logs made from the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import register
from .operators import native, parse
from .plans import wildcard
from .plans.schema import LogSchema
from .sources import LogSource, read_callback, read_logs, read_split, read_until, write_raw
from .sources.scratch import scratch
from .streaming import parse_stream


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return parse.dealt(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


LINES = LogSchema.parse(r"""delimiters: \n
header:(?<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6})
loglevel:CLICK|ERROR|PURCHASE|SIGNUP|VIEW
user:user_(?<userID>\d+)
amount:value=(?<val>-{0,1}\d+\.\d+)
props:props=\{"k": (?<k>\d+)\}
""")
NUMBERS = LogSchema.parse(r"""delimiters: \t\r\n:,.!
int:\-{0,1}[0-9]+
hasNumber:[^ \t\r\n:,.!]*\d[^ \t\r\n:,.!]*
""")
TURNS = LogSchema.parse(r"""delimiters: \n
header:\[conv (?<conv>\d+) turn (?<turn>\d+)\] (?<role>[a-z]+):
""")
URLS = LogSchema.parse(r"""delimiters:\n
url:https{0,1}://(?<host>[^/\n]+)/(?<path>(?<lang>[a-z]+)/(?<id>\d+))[^\n]*
""")
ROOMS = LogSchema(" ").with_rule(r"number:\d+").with_rule(r"word:[a-z]+")


PLAIN_LINES = LogSchema.parse(r"""delimiters: \n
header:(?<timestamp>\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}\.\d{6})
user:user_(?<userID>\d+)
amount:value=(?<val>-{0,1}\d+\.\d+)
props:props=\{"k": (?<k>\d+)\}
""")
PROPS = LogSchema("\n").with_rule(r'props:\{"k": (?<k>\d+)\}')
SPANS = LogSchema(" \n").with_rule(r"span:user_\d+ value=-{0,1}\d+\.\d+")
PRIORITY = LogSchema(" \n").with_rule(r"even:\d*[02468]").with_rule(r"int:\d+").with_rule("word:[a-z]+")
DIGITS = LogSchema("\n").with_rule(r"two:(?<tens>\d){0,1}(?<ones>\d)")
TWICE = LogSchema("\n").with_rule(r"header:(?<timestamp>\d{4}-\d{2}-\d{2}) (?<timestamp>\d{2}:\d{2})")
FIELDS = LogSchema("\n").with_rule(r"fields:((?<key>[a-z]+)=(?<val>\d+);)+")


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, text): a log line for each row of events."""
    e = _table(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" "), F.upper("event_type"), F.lit(" user_"), F.col("user_id").cast("string"), F.lit(" value="), F.col("value").cast("decimal(18,2)").cast("string"), F.lit(" props="), F.col("props"))
    return e.select("event_id", "event_type", line.alias("text"))


def synth_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_column(event_lines(spark, sf_dir), LINES, keep=["event_id"], outputs=("timestamp", "logtype", "tokens"))
    level = parse.without_delimiter(F.try_element_at(F.filter("tokens", lambda t: t["rule"] == "loglevel"), F.lit(1))["text"], LINES)
    return events.select("event_id", "timestamp", level.alias("loglevel"), parse.capture("userID").cast("long").alias("user_id"), parse.capture("val").alias("val"), parse.capture("k").cast("long").alias("k"), "logtype")


def logtype_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.logtype_counts(parse.parse_column(event_lines(spark, sf_dir), LINES, keep=[], outputs=("logtype",)))


def doc_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return native.event_rows(_table(spark, sf_dir, "documents"), NUMBERS, keep=["doc_id"])


def doc_events_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse.parse_column(_table(spark, sf_dir, "documents"), NUMBERS, keep=["doc_id"], outputs=("event_idx", "raw"))


def conv_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation, cut at their headers in Catalyst expressions alone."""
    return native.event_rows(conversation_logs(spark, sf_dir), TURNS)


def doc_tokens_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counted within each document, then summed: no row for each token, and no distinct."""
    rules = [None, "newLine", *NUMBERS.names]
    held = _table(spark, sf_dir, "documents").select(F.array(*native.rule_counts("text", NUMBERS, rules)).alias("held"))
    sums = held.agg(*[F.struct(F.sum(F.col("held")[i]).alias("n"), F.count(F.when(F.col("held")[i] > 0, 1)).alias("docs")).alias(f"c{i}") for i in range(len(rules))])
    each = F.array(*[F.struct(F.lit(r or "static").alias("rule"), F.col(f"c{i}.n").alias("n"), F.col(f"c{i}.docs").alias("docs")) for i, r in enumerate(rules)])
    return sums.select(F.explode(each).alias("x")).select("x.*").where("n > 0")


def doc_tokens_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same tokens by the kernel; in events, a line feed before a variable is a static token of its own."""
    events = parse.parse_column(_table(spark, sf_dir, "documents"), NUMBERS, keep=["doc_id"], outputs=("tokens",), rules=["newLine", *NUMBERS.names])
    found = events.select("doc_id", F.explode("tokens").alias("t"))
    return found.groupBy("t.rule").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("docs"))


def doc_variables(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_column(_table(spark, sf_dir, "documents"), NUMBERS, keep=["doc_id"], outputs=("tokens",), rules=["int"])
    return parse.variables(events, "int").select("doc_id", parse.without_delimiter(F.col("text"), NUMBERS).alias("text"))


def conversation_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, text): the turns of a conversation as one log."""
    turn = F.concat(F.lit("[conv "), F.col("conv_id").cast("string"), F.lit(" turn "), F.col("turn").cast("string"), F.lit("] "), F.col("role"), F.lit(": "), F.col("text"))
    rows = _table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", turn.alias("line")))).alias("all"))
    return rows.select("conv_id", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("text"))


def conv_multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_column(conversation_logs(spark, sf_dir), TURNS, keep=["conv_id"], outputs=("raw", "has_header", "is_multiline", "tokens"))
    said = F.rtrim(F.regexp_replace("raw", r"\A\[conv \d+ turn \d+\] [a-z]+: ", ""), F.lit("\n"))
    return events.select("conv_id", parse.capture("turn").cast("long").alias("turn"), parse.capture("role").alias("role"), "has_header", "is_multiline", said.alias("said"))


def url_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_column(_table(spark, sf_dir, "pages"), URLS, "url", ["page_id"], ("logtype", "tokens"))
    return events.select("page_id", parse.capture("host").alias("host"), parse.capture("lang").alias("lang"), parse.capture("id").cast("long").alias("id"))


def wildcard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = native.event_rows(event_lines(spark, sf_dir), LINES, keep=["event_id"])
    return parse.search(events, "*PURCHASE user_*7 value=1?.*").select("event_id", "raw")


def logtype_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same search over events with their log types, of which the reading of the query leaves some."""
    events = parse.parse_column(event_lines(spark, sf_dir), PLAIN_LINES, keep=["event_id"], outputs=("raw", "logtype"))
    return parse.search_by_logtype(events, "*PURCHASE user_*7 value=1?.*", PLAIN_LINES).select("event_id", "raw", "logtype")


def interpretations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings of one query for each kind of event and each of fifty rooms: `kind room`, the word and the number being variables or not."""
    found = _table(spark, sf_dir, "events").select(F.concat_ws(" ", "event_type", (F.col("user_id") % 50).cast("string")).alias("q")).distinct()
    return wildcard.interpretations(spark, [r.q for r in found.collect()], ROOMS).select("query", "logtype", "wildcard_flags")


def schema_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a kind of event between stars, and a number before one, could be."""
    e = _table(spark, sf_dir, "events")
    found = e.select(F.concat(F.lit("*"), "event_type", F.lit("*")).alias("q")).union(e.select(F.concat((F.col("user_id") % 50).cast("string"), F.lit("*")))).distinct()
    return wildcard.schema_types(spark, [r.q for r in found.collect()], ROOMS)


def _line_files(spark: SparkSession, sf_dir: str, label: str) -> str:
    """A folder of text files with the lines of all events; each line feed ends a line."""
    path = scratch(spark, label)
    lines = event_lines(spark, sf_dir)
    lines.repartitionByRange(4, "event_id").sortWithinPartitions("event_id").select("text").write.text(path)
    return path


def split_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read in byte ranges."""
    events = read_split(spark, _line_files(spark, sf_dir, "split"), PLAIN_LINES, ("raw", "timestamp", "logtype"))
    # At the end of a file the line feed is a variable, since no header follows it.
    return events.select("raw", "timestamp", F.regexp_replace("logtype", r"(\n|<newLine>)\z", "").alias("logtype"))


def whole_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read whole, with a count of their events."""
    events = read_logs(spark, _line_files(spark, sf_dir, "whole"), PLAIN_LINES, ("event_idx", "timestamp"))
    return events.groupBy("source").agg(F.count("*").alias("n"), F.min("timestamp").alias("first"), F.max("event_idx").alias("last_idx")).agg(F.sum("n").alias("events"), F.min("first").alias("first"), F.sum(F.col("n") - F.col("last_idx")).alias("files"))


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read by the data source `timberline`, in ranges; only what is asked for is made."""
    spark.dataSource.register(LogSource)
    rules = "delimiters: \\n\n" + "\n".join(f"{r.name}:{r.pattern}" for r in PLAIN_LINES.rules)
    found = spark.read.schema("raw string, timestamp string, tokens array<struct<text string>>").format("timberline").option("rules", rules).load(_line_files(spark, sf_dir, "source"))
    return found.select("raw", "timestamp", F.element_at("tokens", 2)["text"].alias("kind"))


def file_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read up to each delimiter."""
    found = read_until(spark, _line_files(spark, sf_dir, "pieces"), "user_")
    return found.select(F.regexp_extract("piece", r"\A(\d+) value=", 1).alias("user_id")).where("user_id <> ''").groupBy(F.col("user_id").cast("long")).agg(F.count("*").alias("n"))


def called_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that a callable gives: for each kind of event a log of its name, as often as the name has letters, in pieces of three bytes."""
    kinds = sorted(r[0] for r in _table(spark, sf_dir, "events").select("event_type").distinct().collect())

    def log(kind: str):
        data = "".join(f"{kind} {n}\n" for n in range(len(kind))).encode()
        return lambda: (data[i : i + 3] for i in range(0, len(data), 3))

    return read_callback(spark, {k: log(k) for k in kinds}, ROOMS, ("event_idx", "raw")).select("source", "event_idx", "raw")


def raw_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' events written as text and read again, line by line."""
    path = scratch(spark, "raw")
    write_raw(native.event_rows(_table(spark, sf_dir, "documents"), NUMBERS, keep=[]), path)
    return spark.read.text(path).groupBy(F.length("value").cast("long").alias("chars")).agg(F.count("*").alias("n"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that arrive as a stream under eight keys; the last event of a key waits for what may follow it."""
    pieces, done = scratch(spark, "pieces"), scratch(spark, "streamed")
    lines = event_lines(spark, sf_dir).select((F.col("event_id") % 8).cast("string").alias("key"), F.col("event_id").alias("seq"), F.concat("text", F.lit("\n")).alias("text"))
    lines.repartition(8, "key").write.parquet(pieces)
    events = parse_stream(spark.readStream.schema(lines.schema).parquet(pieces), PLAIN_LINES, "key", outputs=("timestamp", "logtype"))
    sink = events.writeStream.format("parquet").option("path", done).option("checkpointLocation", scratch(spark, "stream-state"))
    sink.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(events.schema).parquet(done).select("key", "event_idx", "timestamp", "logtype")


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions of SQL over lines of events."""
    register(spark, PLAIN_LINES, "lines_")
    lines = event_lines(spark, sf_dir)
    return spark.sql(
        "select l.event_id, e.event_idx, e.timestamp, e.is_multiline, lines_logtype(l.text) as logtype, size(lines_log_tokens(l.text)) as tokens from {lines} l, lateral lines_log_parse(l.text) e", lines=lines
    )


def token_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delimiter, body, length and a part of the amount's token."""
    events = parse.parse_column(event_lines(spark, sf_dir), PLAIN_LINES, keep=["event_id"], outputs=("tokens",), rules=["amount"])
    token = F.element_at("tokens", 1)
    return events.select("event_id", parse.delimiter_of(token).alias("delimiter"), parse.body_of(token).alias("body"), parse.bytes_of(token).alias("bytes"), parse.part_of(token, 1, 6).alias("part"))


def clashing_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table that has columns of the outputs' names: the outputs take their place."""
    lines = event_lines(spark, sf_dir).withColumns({"raw": F.lit("old"), "Rule": F.lit("old"), "event_idx": F.lit(-1)})
    events = parse.parse_column(lines, PLAIN_LINES, outputs=("event_idx", "raw", "tokens"))
    return parse.variables(events, "user").select("event_id", "event_idx", "raw", "rule")


def logtype_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = parse.logtype_counts(parse.parse_column(event_lines(spark, sf_dir), PLAIN_LINES, keep=[], outputs=("logtype",)))
    return counts.orderBy(F.desc("n"), "logtype").limit(3)


def doc_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of each document's log types, joined; in Catalyst expressions alone."""
    made = _table(spark, sf_dir, "documents").select("doc_id", native.template("text", NUMBERS).alias("t"))
    return made.select("doc_id", F.length("t").cast("long").alias("template_chars"), F.sha2("t", 256).alias("template_sha256"))


def multiline_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors are followed by two lines of frames."""
    frames = F.when(F.col("event_type") == "error", F.lit("\n#0 frame\n#1 frame")).otherwise("")
    lines = event_lines(spark, sf_dir).withColumn("text", F.concat("text", frames))
    events = parse.parse_column(lines, LINES, keep=["event_id"], outputs=("raw", "is_multiline"))
    return parse.multiline(events).select("event_id", F.length("raw").cast("long").alias("chars"))


def props_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = parse.parse_column(_table(spark, sf_dir, "events"), PROPS, "props", ["event_id"], ("logtype", "tokens"))
    return events.select("event_id", parse.capture("k").cast("long").alias("k"), "logtype")


def delim_spanning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable over a delimiter."""
    events = parse.parse_column(event_lines(spark, sf_dir), SPANS, keep=["event_id"], outputs=("tokens",), rules=["span"])
    return parse.variables(events, "span").select("event_id", parse.without_delimiter(F.col("text"), SPANS).alias("text"))


def rule_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule gives a token its type; all that match are listed."""
    lines = _table(spark, sf_dir, "events").select("event_id", F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("text"))
    found = parse.variables(parse.parse_column(lines, PRIORITY, outputs=("tokens",)))
    return found.select("event_id", "pos", "rule", F.array_join("rules", ",").alias("rules"))


def optional_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 100).cast("string").alias("text"))
    events = parse.parse_column(lines, DIGITS, outputs=("logtype", "tokens"))
    return events.select("event_id", parse.capture("tens").alias("tens"), parse.capture("ones").alias("ones"), "logtype")


def header_first_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two timestamps in a header, the first counts."""
    lines = _table(spark, sf_dir, "events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("\nrest")).alias("text"))
    return parse.parse_column(lines, TWICE, outputs=("timestamp", "logtype"))


def repeated_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All positions of captures under a repetition, the newest first."""
    text = F.concat(F.lit("id="), F.col("user_id").cast("string"), F.lit(";v="), F.length("props").cast("string"), F.lit(";"))
    found = parse.capture_positions(_table(spark, sf_dir, "events").select("event_id", text.alias("text")), FIELDS, "fields")
    return found.select("event_id", "name", F.array_join(F.col("starts").cast("array<string>"), ",").alias("starts"), F.array_join(F.col("ends").cast("array<string>"), ",").alias("ends"))


def hourly_logtypes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by hour and log type, with a total for each hour."""
    events = parse.parse_column(event_lines(spark, sf_dir), PLAIN_LINES, keep=[], outputs=("timestamp", "logtype"))
    return events.rollup(F.substring("timestamp", 1, 13).alias("hour"), "logtype").agg(F.count("*").alias("n")).where("hour IS NOT NULL")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (synth_roundtrip, logtype_counts, doc_events, doc_tokens_by_rule, doc_tokens_kernel, doc_variables, conv_multiline, url_captures, wildcard_search, interpretations, schema_types,
        logtype_topk, doc_templates, multiline_errors, props_capture, delim_spanning, rule_priority, optional_capture, header_first_timestamp, repeated_captures, hourly_logtypes, doc_events_kernel, conv_events,
        logtype_search, split_files, whole_files, source_files, file_pieces, called_back, raw_round_trip, streamed, sql_functions, token_parts, clashing_columns)
}

_LINE = "strftime(ts, '%Y-%m-%d %H:%M:%S.%f') || ' ' || upper(event_type) || ' user_' || user_id || ' value=' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || ' props=' || props"
_CHUNKS = r"""
chunks AS (
  SELECT doc_id, i, c FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS c
    FROM (SELECT doc_id, regexp_extract_all(text, '\A[^ \t\r\n:,.!]+|[ \t\r\n:,.!][^ \t\r\n:,.!]*') AS l FROM documents))),
named AS (
  SELECT doc_id, i, c, CASE WHEN i = 1 AND regexp_matches(c, '\A[ \t\r:,.!]') THEN NULL
    WHEN regexp_full_match(c, '[ \t\r\n:,.!]?-?[0-9]+') THEN 'int'
    WHEN regexp_full_match(c, '[ \t\r\n:,.!]?[^ \t\r\n:,.!]*[0-9][^ \t\r\n:,.!]*') THEN 'hasNumber' END AS rule FROM chunks)"""

ORACLES = {
    "synth_roundtrip": """
        SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, upper(event_type) AS loglevel, user_id,
               CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS val, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
               '<timestamp> <loglevel> user_<userID> value=<val> props={"k": <k>}' AS logtype FROM events""",
    "logtype_counts": """SELECT '<timestamp> <loglevel> user_<userID> value=<val> props={"k": <k>}' AS logtype, count(*) AS n FROM events""",
    "doc_events": r"""
        SELECT doc_id, i - 1 AS event_idx, raw FROM (
          SELECT doc_id, unnest(range(1, len(l) + 1)) AS i, unnest(l) AS raw
          FROM (SELECT doc_id, list_filter(regexp_extract_all(text, '\n?[^\n]*(?:\n|\z)'), lambda x: x <> '') AS l FROM documents))""",
    "conv_events": """
        SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS event_idx,
               '[conv ' || conv_id || ' turn ' || turn || '] ' || role || ': ' || text || CASE WHEN turn < max(turn) OVER (PARTITION BY conv_id) THEN chr(10) ELSE '' END AS raw
        FROM conversations WHERE text IS NOT NULL""",
    "doc_tokens_by_rule": f"""WITH {_CHUNKS},
        tokens AS (
          SELECT doc_id, coalesce(rule, 'static') AS rule FROM named WHERE rule IS NOT NULL OR c NOT LIKE chr(10) || '%'
          UNION ALL SELECT doc_id, 'newLine' FROM named WHERE rule IS NULL AND c LIKE chr(10) || '%'
          UNION ALL SELECT doc_id, 'static' FROM named WHERE rule IS NULL AND c LIKE chr(10) || '_%')
        SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY rule""",
    "doc_tokens_kernel": f"""WITH {_CHUNKS},
        tokens AS (SELECT doc_id, rule FROM named WHERE rule IS NOT NULL
          UNION ALL SELECT doc_id, 'newLine' FROM named WHERE rule IS NULL AND c LIKE chr(10) || '%')
        SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS docs FROM tokens GROUP BY rule""",
    "doc_variables": f"WITH {_CHUNKS} SELECT doc_id, regexp_replace(c, '^[ \\t\\r\\n:,.!]', '') AS text FROM named WHERE rule = 'int'",
    "conv_multiline": "SELECT conv_id, turn, role, true AS has_header, contains(text, chr(10)) AS is_multiline, rtrim(text, chr(10)) AS said FROM conversations",
    "url_captures": r"""
        SELECT page_id, regexp_extract(url, '^https?://([^/\n]+)/([a-z]+)/([0-9]+)', 1) AS host, regexp_extract(url, '^https?://([^/\n]+)/([a-z]+)/([0-9]+)', 2) AS lang,
               CAST(regexp_extract(url, '^https?://([^/\n]+)/([a-z]+)/([0-9]+)', 3) AS BIGINT) AS id FROM pages""",
    "wildcard_search": f"SELECT event_id, raw FROM (SELECT event_id, {_LINE} AS raw FROM events) WHERE raw LIKE '%PURCHASE user\\_%7 value=1_.%' ESCAPE '\\'",
    "interpretations": """
        WITH q AS (SELECT DISTINCT event_type AS w, user_id % 50 AS n FROM events)
        SELECT w || ' ' || n AS query, unnest([w || ' ' || n, '<word>(' || w || ') ' || n, w || ' <number>(' || n || ')', '<word>(' || w || ') <number>(' || n || ')']) AS logtype,
               unnest(['0', '00', '00', '000']) AS wildcard_flags FROM q""",
    "logtype_search": f"""
        SELECT event_id, raw, '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={{"k": <k>}}' AS logtype
        FROM (SELECT event_id, event_type, {_LINE} AS raw FROM events) WHERE raw LIKE '%PURCHASE user\\_%7 value=1_.%' ESCAPE '\\'""",
    "split_files": f"""SELECT {_LINE} || chr(10) AS raw, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={{"k": <k>}}' AS logtype FROM events""",
    "whole_files": "SELECT count(*) AS events, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS first, 4 AS files FROM events",
    "source_files": f"SELECT {_LINE} || chr(10) AS raw, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, ' ' || upper(event_type) AS kind FROM events",
    "file_pieces": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "called_back": "SELECT event_type AS source, i AS event_idx, event_type || ' ' || i || chr(10) AS raw FROM (SELECT event_type, unnest(range(length(event_type))) AS i FROM (SELECT DISTINCT event_type FROM events))",
    "raw_round_trip": """
        SELECT length(line) AS chars, count(*) AS n FROM (SELECT unnest(string_split(regexp_replace(text, '\\n$', ''), chr(10))) AS line FROM documents WHERE text <> '') GROUP BY ALL""",
    "streamed": """
        SELECT * EXCLUDE (last_idx) FROM (SELECT (event_id % 8)::VARCHAR AS key, row_number() OVER w - 1 AS event_idx, count(*) OVER (PARTITION BY event_id % 8) - 1 AS last_idx, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp,
          '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={"k": <k>}' || chr(10) AS logtype FROM events WINDOW w AS (PARTITION BY event_id % 8 ORDER BY event_id))
        WHERE event_idx < last_idx""",
    "sql_functions": """
        SELECT event_id, 0 AS event_idx, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS timestamp, false AS is_multiline, '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={"k": <k>}' AS logtype, 5 AS tokens FROM events""",
    "token_parts": "SELECT event_id, ' ' AS delimiter, 'value=' || v AS body, length(v) + 7 AS bytes, 'value' AS part FROM (SELECT event_id, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS v FROM events)",
    "clashing_columns": f"SELECT event_id, 0 AS event_idx, {_LINE} AS raw, 'user' AS rule FROM events",
    "logtype_topk": """
        SELECT '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={"k": <k>}' AS logtype, count(*) AS n FROM events GROUP BY event_type
        ORDER BY n DESC, logtype LIMIT 3""",
    "doc_templates": rf"""WITH {_CHUNKS},
        shown AS (SELECT doc_id, i, CASE
            WHEN rule IS NOT NULL THEN regexp_extract(c, '\A[ \t\r\n:,.!]?') || '<' || rule || '>'
            WHEN c LIKE chr(10) || '%' THEN '<newLine>' || substr(c, 2) ELSE c END AS t FROM named),
        joined AS (SELECT doc_id, string_agg(t, '' ORDER BY i) AS t FROM shown GROUP BY doc_id)
        SELECT d.doc_id, length(coalesce(t, ''))::BIGINT AS template_chars, sha256(coalesce(t, '')) AS template_sha256 FROM documents d LEFT JOIN joined j ON d.doc_id = j.doc_id""",
    "multiline_errors": f"SELECT event_id, length({_LINE}) + 18 AS chars FROM events WHERE event_type = 'error'",
    "props_capture": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k": <k>}' AS logtype FROM events""",
    "delim_spanning": f"SELECT event_id, regexp_extract({_LINE}, ' (user_[0-9]+ value=-?[0-9]+\\.[0-9]+) ', 1) AS text FROM events",
    "rule_priority": """
        SELECT event_id, 0 AS pos, 'word' AS rule, 'word' AS rules FROM events
        UNION ALL SELECT event_id, 1, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'int' END, CASE WHEN user_id % 2 = 0 THEN 'even,int' ELSE 'int' END FROM events""",
    "optional_capture": """
        SELECT event_id, CASE WHEN u >= 10 THEN (u // 10)::VARCHAR END AS tens, (u % 10)::VARCHAR AS ones, CASE WHEN u >= 10 THEN '<tens><ones>' ELSE '<ones>' END AS logtype
        FROM (SELECT event_id, user_id % 100 AS u FROM events)""",
    "header_first_timestamp": "SELECT event_id, strftime(ts, '%Y-%m-%d') AS timestamp, '<timestamp> <timestamp><newLine>rest' AS logtype FROM events",
    "repeated_captures": """
        WITH l AS (SELECT event_id, length(user_id::VARCHAR) AS a, length(length(props)::VARCHAR) AS b FROM events)
        SELECT event_id, 'key' AS name, (a + 4) || ',0' AS starts, (a + 5) || ',2' AS ends FROM l
        UNION ALL SELECT event_id, 'val', (a + 6) || ',3', (a + 6 + b) || ',' || (a + 3) FROM l""",
    "hourly_logtypes": """
        SELECT strftime(ts, '%Y-%m-%d %H') AS hour, CASE WHEN grouping(event_type) = 0 THEN '<timestamp> ' || upper(event_type) || ' user_<userID> value=<val> props={"k": <k>}' END AS logtype, count(*) AS n
        FROM events GROUP BY GROUPING SETS ((strftime(ts, '%Y-%m-%d %H'), event_type), (strftime(ts, '%Y-%m-%d %H')))""",
    "schema_types": "SELECT DISTINCT '*' || event_type || '*' AS query, 'word' AS rule FROM events UNION SELECT DISTINCT (user_id % 50) || '*', 'number' FROM events",
}
ORACLES["doc_events_kernel"] = ORACLES["doc_events"]
