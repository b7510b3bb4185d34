import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import components as cc
from timberline.llm import jaccard_rtree as jr


def shingles(text, n):
    w = (text or "").encode().lower().split()
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1)))


def brute(docs, n, percent):
    sets = [shingles(t, n) for _, t in docs]
    label = {i: i for i, _ in docs}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((find(docs[a][0]), find(docs[b][0])))
                label[y] = x
    return sorted((i, len(s), find(i)) for (i, _), s in zip(docs, sets))


def near_copies(seed, bases=6, copies=25):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    docs = []
    for _ in range(bases):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 4, 6, 9, 20, 60, 150]))] + (passage if rng.random() < 0.5 else [])
        for _ in range(copies):
            own = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                at = rng.randrange(len(own) + 1)
                own[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)] * rng.choice([0, 1])
            docs.append(" ".join(own))
    docs += ["", None, "   ", "One two", "one TWO", "a b c d", "A  b\nc d", "word " * 3000]
    rng.shuffle(docs)
    return [(i * 3 + 1, t) for i, t in enumerate(docs)]


@pytest.mark.parametrize("seed,n,percent", [(1, 4, 85), (2, 5, 80), (3, 4, 50), (4, 1, 85), (5, 4, 100)])
def test_brute_force(spark, monkeypatch, seed, n, percent):
    if seed % 2:
        monkeypatch.setattr(jr, "BLOCK_SETS", 5)
    docs = near_copies(seed)
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n", "2 as rep", "3 as key").repartition(5)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jr.join(df, n, percent).collect())
    assert got == brute(docs, n, percent)


def test_ids_that_repeat_null_ids_and_empty(spark):
    rows = [(1, "a b c d e f"), (1, "g h i j k l"), (2, "g h i j k l"), (None, "a b c d e f"), (3, None), (4, "a b c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id) for r in jr.join(df, 4, 85).collect()), key=str)
    assert got == sorted([(1, 3, 1), (1, 3, 1), (2, 3, 1), (0, 3, None), (3, 0, 3), (4, 3, 1)], key=str)
    assert jr.join(df.limit(0)).collect() == []
    assert sorted(r.doc_id or 0 for r in jr.keep_one(df, 4, 85).collect()) == [0, 1, 1, 3]


def test_ids_of_other_types(spark):
    rows = [("b", "a b c d e f"), ("a", "a b c d e f"), ("a", "g h i j k l"), (None, "a b c d e f"), ("10", "x y"), ("9", None)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jr.join(df, 4, 85).collect()), key=str)
    assert got == sorted([("b", 3, "a"), ("a", 3, "a"), ("a", 3, "a"), (None, 3, None), ("10", 1, "10"), ("9", 0, "9")], key=str)
    assert jr.join(df.limit(0), 4, 85).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 80), st.sampled_from([50, 80, 85, 95, 100]), st.integers(0, 10_000))
def test_linked_sets_share_a_key(size, percent, seed):
    """Whatever the sample put last."""
    rng, law = np.random.default_rng(seed), jr.Law(percent)
    a = np.unique(rng.integers(1, 2**63, size).astype(np.uint64))
    drop = rng.permutation(len(a))[: rng.integers(0, len(a) // 3 + 1)]
    b = np.unique(np.concatenate([np.delete(a, drop), rng.integers(1, 2**63, rng.integers(0, size // 3 + 1)).astype(np.uint64)]))
    shared = len(np.intersect1d(a, b))
    if len(b) and 100 * shared >= percent * (len(a) + len(b) - shared):
        late = set(rng.choice(a, len(a) // 3).tolist())
        order = lambda s: np.array(sorted(s.tolist(), key=lambda h: (h in late, h)), np.uint64)
        assert len(np.intersect1d(law.run_keys(order(a)), law.run_keys(order(b))))


def test_thinned_chains_connect_the_same():
    rng, law = np.random.default_rng(7), jr.Law(80)
    for _ in range(50):
        n = 40
        key, size, node = rng.integers(0, 3, n).astype(np.uint64), rng.integers(50, 300, n), np.arange(n)
        whole = cc.smallest_reachable(*jr.chains(key, size, node, law)) if len(jr.chains(key, size, node, law)[0]) else None
        parts = np.array_split(rng.permutation(n), 4)
        links, kept = [], []
        for p in parts:
            links.append(jr.chains(key[p], size[p], node[p], law))
            kept.append(p[jr.thin(key[p], size[p], node[p], law)])
        kept = np.concatenate(kept)
        links.append(jr.chains(key[kept], size[kept], node[kept], law))
        got = cc.smallest_reachable(*(np.concatenate(x) for x in zip(*links)))
        assert np.array_equal(got[0], whole[0]) and np.array_equal(got[1], whole[1])


@pytest.mark.parametrize("bound", [100_000, 30, 0])
def test_components(spark, monkeypatch, bound):
    monkeypatch.setattr(cc, "ONE_TASK_LINKS", bound)
    rng = np.random.default_rng(11)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    want = cc.smallest_reachable(*(np.array(x) for x in zip(*pairs)))
    got = dict((r.node, r.component) for r in cc.components(spark.createDataFrame(pairs, "a long, b long").repartition(7)).collect())
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {int(n): int(c) for n, c in zip(*want) if int(n) in linked}
