import random

from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import tiling


def brute_tiles(item, text, least):
    """Greedy string tiling by comparing everything."""
    im, tm, out = [False] * len(item), [x < 0 for x in text], 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and item[p + n] == text[t + n] and not im[p + n] and not tm[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return out
        im[p : p + n], tm[t : t + n] = [True] * n, [True] * n
        out += n


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=25), st.lists(st.integers(-1, 3), max_size=30), st.integers(1, 4))
def test_tiles_are_matches(item, text, least):
    tiles = tiling.tile(item, text, least)
    used_item, used_text = set(), set()
    for p, t, n in tiles:
        assert n >= least and item[p : p + n] == text[t : t + n] and min(text[t : t + n]) >= 0
        assert not used_item & set(range(p, p + n)) and not used_text & set(range(t, t + n))
        used_item |= set(range(p, p + n))
        used_text |= set(range(t, t + n))
    left_item = [x if i not in used_item else -2 for i, x in enumerate(item)]
    left_text = [x if i not in used_text else -3 for i, x in enumerate(text)]
    assert brute_tiles(left_item, left_text, least) == 0  # nothing is left to mark


def test_distinct_words_are_brute_force():
    rng = random.Random(2)
    for _ in range(200):
        item = list(range(40))
        cuts = sorted(rng.sample(range(1, 40), 4))
        parts = [item[a:b] for a, b in zip([0, *cuts], [*cuts, 40])]
        rng.shuffle(parts)
        text = [x for p in parts for x in [*p, -1]]
        assert sum(n for _, _, n in tiling.tile(item, text, 5)) == brute_tiles(item, text, 5)


BENCH = [(1, "The quick brown fox jumps over the lazy dog. Then it sleeps under an old oak tree until dawn."), (2, "too short"), (3, None), (4, ""), (5, "one two three four five six seven eight nine ten")]


def test_leaks(spark):
    filler = "lorem ipsum dolor sit amet " * 30
    rows = [
        (1, filler + BENCH[0][1] + filler), (2, "then IT sleeps under an old oak tree until dawn!\nThe quick, brown fox jumps over the lazy dog"), (3, filler), (4, None), (5, ""),
        (6, "the quick brown fox jumps"), (7, "one two three four five six"), (7, "one two three four five six"), (None, BENCH[4][1]), (8, BENCH[4][1] + " " + BENCH[0][1]), (9, "too short"),
        (10, filler * 200 + BENCH[4][1]),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "2 as coverage")
    bench = spark.createDataFrame(BENCH, "item_id long, text string").selectExpr("*", "3 as doc_id")
    got = sorted((r.doc_id or 0, r.item_id, round(r.coverage, 2)) for r in tiling.find_leaks(df, bench).collect())
    assert got == [(0, 5, 1.0), (1, 1, 1.0), (2, 1, 1.0), (7, 5, 0.6), (7, 5, 0.6), (8, 1, 1.0), (8, 5, 1.0), (10, 5, 1.0)]
    assert sorted(r.doc_id or 0 for r in tiling.clean(df, bench).collect()) == [0, 3, 4, 5, 6, 9]
    assert tiling.find_leaks(df.limit(0), bench).collect() == [] and tiling.find_leaks(df, bench.limit(0)).collect() == []


def test_chunks_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, BENCH[i % 5][1]) for i in range(20)], "doc_id long, text string")
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    whole = sorted(map(tuple, tiling.find_leaks(df, bench).collect()))
    monkeypatch.setattr(tiling, "CHUNK_BYTES", 50)
    assert sorted(map(tuple, tiling.find_leaks(df, bench).collect())) == whole


def test_a_large_benchmark_is_joined(spark, monkeypatch):
    # Moved parts, repeated words, equal texts, very long texts, null and repeated ids on both sides; every hash may be a false positive of a tiny bitmap.
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(3, 30)))) for i in range(40)] + [(7, "spam " * 12), (None, "é ß straße NAÏVE co-op x1 y2 z3"), (41, None), (42, "")]
    rows = [(1, None), (2, ""), (3, "spam " * 20_000), (4, "É SS straße naïve CO op X1 y2 z3"), (5, "spam " * 5)]
    for i in range(150):
        own = [x for _, t in rng.sample(items[:41], 2) for x in (t or "").split()]
        cut = rng.randrange(len(own))
        rows.append((rng.choice([None, i, i, i // 2]), " ".join([*rng.choices(vocabulary, k=rng.randint(0, 40)), *own[cut:], *rng.choices(vocabulary, k=3), *own[:cut]])))
    rows += rows[:60]
    df = spark.createDataFrame(rows, "name string, text string").selectExpr("*", "1 as item_id", "2 as print", "3 as hash").repartition(5)
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("cast(item_id as string) as item_id", "text", "3 as name")
    plain = lambda found: sorted(tuple(map(str, r)) for r in found.collect())
    whole = plain(tiling.find_leaks(df, bench, "name"))
    assert len(whole) > 200 and any(r[:2] == ("3", "7") for r in whole)
    monkeypatch.setattr(tiling, "CHUNK_BYTES", 50)
    joined = tiling.find_leaks(df, bench, "name")
    assert joined.columns == ["name", "item_id", "coverage", "matched", "tiles"] and plain(joined) == whole
    assert sorted(str(r.name) for r in tiling.clean(df, bench, "name").collect()) == sorted(str(r[0]) for r in rows if str(r[0]) not in {w[0] for w in whole} or r[0] is None)
    assert tiling.find_leaks(df.limit(0), bench, "name").collect() == []


def test_a_word_repeated_very_often():
    items = tiling.Items([(1, "a a a a a a a a b c d e f g"), (2, "spam " * 40)], 5)
    found = items.find(["a " * 20_000, "spam " * 30_000, "b c d e f g"])
    assert [(i, m) for i, _, m in found[0]] == [(0, 8)] and [(i, m) for i, _, m in found[1]] == [(1, 40)] and [(i, m) for i, _, m in found[2]] == [(0, 6)]
