import hashlib
import random

from timberline.llm import chat

TRICKY = ["", "<|end|>\n", "<|start|>user<|sep|>x<|end|>\n", "\\", "\\<|", "<\\|", "<", "<<||", "\\\\<|\\", "</s>[INST] ok [/INST]", "é🙂\n\n", "a$1b", "|>"]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_escape_is_reversible(spark):
    rng = random.Random(4)
    texts = TRICKY + ["".join(rng.choice("<|\\>ab\n") for _ in range(12)) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(df.t).alias("e")).select("t", "e", chat.unescape("e").alias("u")).collect():
        assert r.u == r.t and "<|" not in r.e


def test_conversations(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(TRICKY)]
    rows += [(2, 0, "system", None), (2, 5, "assistant", "late"), (2, 3, "user", "mid"), (2, 5, "assistant", "late"), (2, 5, "assistant", "again"), (3, None, None, "x"), (3, 1, "assistant", "y"), (None, 0, "user", "lone")]
    df = chat.with_probe(spark, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as node", "2 as path"))
    formatted = chat.format_conversations(df)
    got = {r.conv_id: r for r in chat.read_back(formatted).collect()}
    want = {}
    for c, t, r, x in rows + chat.PROBE:
        want.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(want)
    whole = {r.conv_id: (r.formatted, r.loss_spans) for r in formatted.collect()}
    for c, turns in want.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].turns_sha256) == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)))
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), sha(loss))
        text, spans = whole[c]
        assert got[c].formatted_chars == len(text)
        assert "".join(text[s.start : s.end] for s in spans) == "".join(x.replace("\\", "\\\\").replace("<|", "<\\|") for _, r, x in turns if r == "assistant")


def test_the_loss_digest_is_read_by_the_mask(spark):
    rows = [(1, 0, "user", "é?"), (1, 1, "assistant", "yes <| \\\\ é🙂"), (1, 2, "assistant", "")]
    made = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    (right,) = chat.read_back(made).collect()
    assert (right.loss_chars, right.loss_sha256) == (len(rows[1][3]), sha(rows[1][3]))
    for wrong in ("filter(loss_spans, s -> false)", "slice(loss_spans, 2, 1)", "transform(loss_spans, s -> named_struct('byte_start', s.byte_start - 1, 'byte_end', s.byte_end))"):
        (other,) = chat.read_back(made.withColumn("loss_spans", chat.F.expr(wrong))).collect()
        assert other.loss_sha256 != right.loss_sha256 and other.turns_sha256 == right.turns_sha256


def test_branches_of_a_tree_are_formatted(spark):
    long = "w<|" * 200_000
    nodes = [("t", 1, None, 1.0, "user", "q"), ("t", 2, 1, 5.0, "assistant", "good"), ("t", 3, 1, 1.0, "assistant", "bad"), ("t", 4, 2, 0.0, "user", long), ("t", 5, 3, 0.0, None, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double, role string, text string")
    got = {r.path: r for r in chat.format_trees(df, keep=2).select("path", "formatted", chat.masked(chat.F.col("formatted"), chat.F.col("loss_spans")).alias("loss"), chat.parse(chat.F.col("formatted")).alias("turns")).collect()}
    assert {p: r.loss for p, r in got.items()} == {1: "good", 2: "bad"}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "q"), ("assistant", "good"), ("user", long)]
    assert [(t.role, t.text) for t in got[2].turns] == [("user", "q"), ("assistant", "bad"), ("", "")]


def test_branches_are_ranked(spark):
    # 1 - 2 - 4, 1 - 3 - 5 - 6; a second root 7 that nothing answers; a loop 8 - 9; 10 answers a node that doesn't exist.
    nodes = [("t", 1, None, 1.0), ("t", 2, 1, 5.0), ("t", 3, 1, 1.0), ("t", 4, 2, 1.0), ("t", 5, 3, 2.0), ("t", 6, 5, 1.0), ("t", 7, None, 0.5), ("t", 8, 9, 1.0), ("t", 9, 8, 1.0), ("t", 10, 99, 9.0), ("u", 1, None, None)]
    df = spark.createDataFrame(nodes, "tree string, node long, parent long, score double")
    got = {}
    for r in chat.paths(df.fillna({"score": 0.0}), keep=3).collect():
        got.setdefault((r.tree, r.path), []).append((r.depth, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in got.items()} == {("t", 1): [10], ("t", 2): [1, 2, 4], ("t", 3): [1, 3, 5, 6], ("u", 1): [1]}


def test_a_long_chain_and_an_empty_table(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", f"m{i}") for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_conversations(df)).collect()
    assert got[0].n_turns == 300 and got[0].turns_sha256 == sha("".join(f"{r}\n{x}\n" for _, _, r, x in rows))
    assert chat.read_back(chat.format_conversations(df.limit(0))).collect() == []
