import math
import random

import numpy as np
import pytest

from timberline.llm import impact_index


def brute(rows, asks, k):
    """rows and queries with their row numbers; a query isn't compared with its own row."""
    held = [(n, i, [math.floor(256 * x) if abs(x) < 2**53 else 256 * int(x) for x in map(np.float32, v)]) for n, (i, v) in enumerate(rows) if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for n, q, v in held:
        if asks(q):
            scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for m, i, w in held if m != n)[:k]
            out += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(scores)]
    return sorted(out)


@pytest.mark.parametrize("seed,block", [(1, 4096), (2, 300)])
def test_brute_force(spark, monkeypatch, seed, block):
    monkeypatch.setattr(impact_index, "BLOCK_ROWS", block)
    monkeypatch.setattr(impact_index, "CHUNK_BYTES", 2000)
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 0.2) for _ in range(12)]) for i in range(400)]
    rows += [(400, None), (401, [None, 1.0]), (402, [float("nan")] * 3), (403, [float("inf")]), (404, [0.5, 0.5]), (None, [1.0]), (20, [0.25] * 12), (20, [None, 2.0]), (406, rows[3][1]), (407, rows[3][1])]
    rows += [rows[40], (60, []), (408, [])] if seed == 1 else [(80, [5000.0, 1.0]), (409, [3e38, -1.0, 2.0]), (410, [-9e30] * 12), (100, [1e20] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 as score", "2 as rank").repartition(3)
    got = impact_index.top_k(df, df.where("vec_id % 20 = 0"), 5).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == brute(rows, lambda i: i % 20 == 0, 5)


def test_few_rows_and_ties(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0]) for i in (50, 3, 9)], "vec_id long, embedding array<float>")
    got = impact_index.top_k(df, df.where("vec_id = 50"), 5).collect()
    assert sorted((r["rank"], r.vec_id, r.score) for r in got) == [(1, 3, 65536), (2, 9, 65536)]
    assert impact_index.top_k(df.limit(0), df.limit(0), 5).collect() == []


def test_it_stops_before_all_segments():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 60, (10, 32))
    rows = (centres[rng.integers(0, 10, 4000)] + rng.normal(0, 6, (4000, 32))).astype(np.int64)
    block = impact_index.Block.unpack(impact_index.Block(np.arange(4000), rows).pack(rows), 256)
    seen: list[float] = []
    for q in (0, 17, 99):
        exact = rows @ rows[q]
        want = sorted(((int(-s), i) for i, s in enumerate(exact)))[:5]
        assert [(-s, -i) for s, i in block.search(rows[q], 5, None, seen)] == want
        assert [(-s, -i) for s, i in block.of_any_size().search(rows[q].astype(object), 5, None)] == want
    assert max(seen) < 0.9  # postings remain unread
