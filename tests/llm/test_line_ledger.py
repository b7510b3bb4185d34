import random
from collections import Counter

import numpy as np
import pytest

from timberline.llm import line_ledger
from timberline.llm.line_ledger import CuckooFilter, FilterSet, LineLedger, hash_keys


def brute(docs, threshold, min_chars=1):
    key = lambda x: x.strip(" \t\n\x0b\f\r").translate({c: c + 32 for c in range(65, 91)})
    lines = [(d or "").split("\n") for d in docs]
    held = Counter(k for own in lines for k in {key(x) for x in own})
    hot = {k for k, n in held.items() if n >= threshold and len(k) >= min_chars}
    return [("\n".join(x for x in own if key(x) not in hot), len(own), sum(key(x) in hot for x in own)) for own in lines]


def corpus(n=60):
    rng = random.Random(5)
    common = ["Same line", "  same LINE\t", "ÉTÉ", "", "x"]
    return ["\n".join(rng.choice(common + [f"own {i} {j}" for j in range(3)]) for _ in range(rng.randint(1, 6))) for i in range(n)] + [None, "", "\n", "a" * 100_000]


def test_filter_deletes_what_it_holds():
    keys = [str(i).encode() for i in range(3000)]
    hi, lo = hash_keys(keys)
    held = CuckooFilter.of(hi, lo)
    for a, b in zip(hi[:1500].tolist(), lo[:1500].tolist()):
        assert held.delete(a, b)
    rows = [(0, held.buckets, held.table.tobytes())]
    found = FilterSet(1, rows).maybe(hi, lo)
    assert found[1500:].all() and found[:1500].sum() <= 1


def test_exceptions_make_it_exact():
    hi, lo = hash_keys([b"a", b"b"])
    held = CuckooFilter.of(hi, lo)
    tested = FilterSet(1, [(0, held.buckets, held.table.tobytes())], {(int(hi[1]), int(lo[1]))})
    assert tested.holds(hi, lo).tolist() == [True, False]


@pytest.mark.parametrize("bound", [None, 0])
def test_dedup_is_brute_force(spark, monkeypatch, bound):
    if bound is not None:
        monkeypatch.setattr(line_ledger, "BROADCAST_BYTES", bound)
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").withColumnRenamed("doc_id", "doc_id")
    df = df.selectExpr("doc_id", "text", "'c' as kept")
    got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in line_ledger.dedup(df, threshold=10).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, 10)


def test_min_chars_and_empty_table(spark):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id: (r.kept, r.n_lines, r.n_dropped) for r in line_ledger.dedup(df, threshold=5, min_chars=3).collect()}
    assert [got[i] for i in range(len(docs))] == brute(docs, 5, 3)
    assert line_ledger.dedup(df.limit(0)).collect() == []


def test_a_deletion_undoes_an_insertion(spark):
    docs = corpus()
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    first, second = df.where("doc_id % 2 = 0"), df.where("doc_id % 2 = 1")
    ledger = LineLedger(spark, threshold=8, shards=4).insert(first)
    before = {(r.hi, r.lo): r.refs for r in ledger.refs.collect()}
    ledger.insert(second)
    both = {r.doc_id: r.kept for r in ledger.apply(df).collect()}
    assert [both[i] for i in range(len(docs))] == [k for k, _, _ in brute(docs, 8)]
    ledger.delete(second)
    assert {(r.hi, r.lo): r.refs for r in ledger.refs.where("refs > 0").collect()} == before
    with pytest.raises(ValueError):
        ledger.delete(second)
    assert {(r.hi, r.lo): r.refs for r in ledger.refs.where("refs > 0").collect()} == before
    after = {r.doc_id: r.kept for r in ledger.apply(first).collect()}
    assert [after[i] for i in sorted(after)] == [k for k, _, _ in brute(docs[::2], 8)]
