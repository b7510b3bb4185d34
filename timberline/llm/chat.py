"""Chat formatting of reply trees, in DataFrame operations only.

Nodes point to their parents. Iterative self-joins double the reach of each node's pointer: after k rounds it spans 2^k replies, with the sum of the
scores on the way, until all point at their root; a node's depth and path score fall out. Leaves are ranked within their tree by path
score; the best `keep` are chosen. The same jumps, largest first, then mark all ancestors of a chosen leaf, so a
path of n turns takes log n joins of narrow rows. Texts join last, and each path becomes one conversation.

The template, per turn: <|start|>ROLE<|sep|>TEXT<|end|> and a line feed. In roles and texts a backslash becomes two, and `<|` becomes `<\\|`;
so no control string can stand in them, and `unescape` restores them exactly. The loss mask covers the texts of assistant turns: spans in code points
and in UTF-8 bytes of the formatted text, out of which `read_back` cuts what a model would be trained on.

A conversation is one row in the end, so its turns meet in one window and one array: a conversation must fit a task, as its formatted text must.

Defined results: null roles and texts count as empty; in a table of turns, rows are ordered by turn, then role, then text, so turns that
repeat follow each other; null turns come first; a null conversation id is a conversation of its own; a parent that doesn't exist makes its child a
root, and a loop of parents has no root and so no path. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize

# The template's control strings.
START, SEP, END = "<|start|>", "<|sep|>", "<|end|>\n"


def escape(value: Column) -> Column:
    return F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(value: Column) -> Column:
    return F.regexp_replace(value, r"\\([\\|])", "$1")


def paths(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, path, node, depth): the `keep` best root-to-leaf paths of each tree. nodes: tree, node, parent, score; node unique in its tree.

    path ranks from 1, by the sum of scores; ties go to the smaller leaf.
    """
    parent = nodes.select(F.col("tree"), F.col("node").alias("up"))
    hop = nodes.select("tree", "node", "parent", F.col("score").cast("double").alias("score"))
    hop = hop.join(parent, (hop["tree"].eqNullSafe(parent["tree"])) & (hop["parent"] == parent["up"]), "left").select(hop["tree"], "node", "up", F.lit(0).cast("long").alias("depth"), "score")
    # up: the node 2^k replies above, null beyond the root; depth and score: of the stretch up to there, without it.
    # A node that has reached its root takes no part in later rounds, but others look it up.
    hop = materialize(hop.withColumn("depth", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long")), "hops", narrow=True)
    rooted, jumps, total = hop.where("up is null"), [hop.where("up is not null")], nodes.count()
    while 2 ** (len(jumps) - 1) <= total and not jumps[-1].isEmpty():
        above = jumps[-1].unionByName(rooted).select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("depth").alias("d2"), F.col("score").alias("s2"))
        hop = jumps[-1].join(above, F.col("tree").eqNullSafe(F.col("t")) & (F.col("up") == F.col("n")))
        hop = materialize(hop.select("tree", "node", F.col("up2").alias("up"), (F.col("depth") + F.col("d2")).alias("depth"), (F.col("score") + F.col("s2")).alias("score")), "hops", narrow=True)
        rooted = rooted.unionByName(hop.where("up is null"))
        jumps.append(hop.where("up is not null"))
    jumps = [j.select("tree", "node", "up") for j in jumps]
    leaf = rooted.join(jumps[0].select(F.col("tree").alias("t"), F.col("up").alias("p")).where("p is not null").distinct(), F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("p")), "left_anti")
    rank = F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "node"))
    marked = leaf.withColumn("path", rank).where(F.col("path") <= keep).select("tree", "path", "node")
    for jump in reversed(jumps[:-1]):
        marked = materialize(marked, "marked", narrow=True)
        up = jump.where("up is not null").select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        more = marked.join(up, marked["tree"].eqNullSafe(up["t"]) & (marked["node"] == up["n"])).select("tree", "path", F.col("up").alias("node"))
        marked = marked.unionByName(more)
    depth = rooted.select(F.col("tree").alias("t"), F.col("node").alias("n"), "depth")
    return marked.join(depth, marked["tree"].eqNullSafe(depth["t"]) & (marked["node"] == depth["n"])).select("tree", "path", "node", "depth")


def format_trees(nodes: DataFrame, keep: int = 1) -> DataFrame:
    """(tree, path, formatted, loss_spans): nodes has tree, node, parent, score, role and text. Spans: start and end in code points of `formatted`, and
    byte_start and byte_end in its bytes; ends are exclusive."""
    chosen = paths(nodes, keep)
    body = nodes.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("said"))
    turns = chosen.join(body, chosen["tree"].eqNullSafe(body["t"]) & (chosen["node"] == body["n"]))
    head = F.concat(F.lit(START), escape(F.col("role")), F.lit(SEP))
    turns = turns.select("tree", "path", "depth", "role", head.alias("head"), "said")
    before = Window.partitionBy("tree", "path").orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)

    def bounds(size):
        """Where the text of a turn starts and ends, by a measure of length."""
        whole = size("head") + size("said") + F.lit(len(END))
        start = F.coalesce(F.sum(whole.cast("long")).over(before), F.lit(0)) + size("head")
        return start, start + size("said")

    (a, b), (c, d) = bounds(F.length), bounds(F.octet_length)
    span = F.when(F.col("role") == "assistant", F.struct(a.alias("start"), b.alias("end"), c.alias("byte_start"), d.alias("byte_end")))
    turns = turns.withColumn("span", span)
    gathered = turns.groupBy("tree", "path").agg(F.sort_array(F.collect_list(F.struct("depth", F.concat("head", "said").alias("turn"), "span"))).alias("all"))
    return gathered.select(
        "tree", "path",
        F.concat(F.array_join(F.transform("all", lambda x: x["turn"]), END), F.lit(END)).alias("formatted"),
        F.filter(F.transform("all", lambda x: x["span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns, read back from a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    pieces = F.slice(pieces, 1, F.size(pieces) - 1)
    cut = F.transform(pieces, lambda p: F.split(F.substring(p, len(START) + 1, 2**31 - 1), r"<\|sep\|>", -1))
    return F.transform(cut, lambda p: F.struct(unescape(p[0]).alias("role"), unescape(p[1]).alias("text")))


def masked(formatted: Column, spans: Column) -> Column:
    """The text under the spans, unescaped and joined. Bytes are cut, since a position in code points is found by walking from the start; the outer
    lambda binds the bytes once, not for each span."""
    cut = lambda raw: lambda s: unescape(F.decode(F.substring(raw, (s["byte_start"] + 1).cast("int"), (s["byte_end"] - s["byte_start"]).cast("int")), "UTF-8"))
    return F.array_join(F.element_at(F.transform(F.array(formatted.cast("binary")), lambda raw: F.transform(spans, cut(raw))), 1), "")


def as_trees(turns: DataFrame) -> DataFrame:
    """Nodes of a table (conv_id, turn, role, text): each turn answers the one before it."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    node = F.row_number().over(order).cast("long")
    rows = turns.select(F.col("conv_id").alias("tree"), node.alias("node"), "role", "text")
    return rows.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), F.lit(1.0).alias("score"), "role", "text")


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) of a table of turns; the nodes are written once, since row numbers must not change between reads."""
    nodes = materialize(as_trees(turns.select("conv_id", "turn", "role", "text")), "nodes")
    return format_trees(nodes).select(F.col("tree").alias("conv_id"), "formatted", "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what the formatted conversations say: all turns, and the text that the loss mask covers."""
    read = formatted.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), parse(F.col("formatted")).alias("turns"), masked(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


# A conversation whose texts look like control strings.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(spark: SparkSession, turns: DataFrame) -> DataFrame:
    probe = spark.createDataFrame(PROBE, "conv_id long, turn long, role string, text string")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe)
