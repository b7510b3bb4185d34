import zlib

from timberline.llm.shards import shard_by_bytes


def test_brute_force(spark):
    rows = [(i * 7 % 101, "ab" * (i * i % 37) + "é" * (i % 3)) for i in range(101)] + [(200, None), (201, ""), (5, "again"), (None, "z"), (300, "long" * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as size", "2 as shard", "3 as part")
    got = shard_by_bytes(df, 8).collect()
    line = sorted(((-1 if k is None else k, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1) for k, t in rows))
    total, at, want, count = sum(n for *_, n in line), 0, [], {}
    for k, c, n in line:
        s = at * 8 // total
        want.append((k, n, c, s, count.get(s, 0)))
        count[s] = count.get(s, 0) + 1
        at += n
    assert sorted((-1 if r.doc_id is None else r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == sorted(want)
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_equal_targets(spark):
    got = shard_by_bytes(spark.createDataFrame([(i, "x" * 9) for i in range(1600)], "doc_id long, text string"), 16).collect()
    sizes = [sum(r["size"] for r in got if r.shard == s) for s in range(16)]
    assert max(sizes) - min(sizes) <= 20
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_empty_and_hot(spark):
    df = spark.createDataFrame([(1, "same")] * 50, "doc_id long, text string")
    assert shard_by_bytes(df.limit(0)).collect() == []
    assert sorted(r.slot for r in shard_by_bytes(df, 1).collect()) == list(range(50))
