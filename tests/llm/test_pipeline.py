import base64
import hashlib
import os
import re

import duckdb
import public_tokenizers as tokenizers
import pytest
import tiktoken

import corpus_pipeline
from timberline.llm import langid, queries, tiling

from .test_jaccard import brute as brute_components
from .test_line_ledger import brute as brute_lines
from .test_tiling import brute_tiles

SF = "/root/testdata/sf0.001"


def brute_leak(words, items):
    for own in items:
        grams = {tuple(own[i : i + 5]) for i in range(len(own) - 4)}
        if any(tuple(words[i : i + 5]) in grams for i in range(len(words) - 4)):
            code = {w: i for i, w in enumerate(own)}
            near = [i for i in range(len(words) - 4) if tuple(words[i : i + 5]) in grams]
            covered = sorted({j for i in near for j in range(i, i + 5)})
            text = []
            for a, b in zip([None, *covered], covered):
                text += [-1] * (a is not None and b != a + 1) + [code[words[b]]]
            if brute_tiles([code[w] for w in own], text, 5) >= 0.5 * len(own):
                return True
    return False


def test_run_is_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect())
    docs = [(i, t) for i, t in docs if t and re.search(r"[^\W\d_]", t)]
    docs = [(i, kept) for (i, _), (kept, _, _) in zip(docs, brute_lines([t for _, t in docs], 10))]
    docs = [(i, t) for (i, t), (j, _, low) in zip(docs, brute_components(docs, 5, 80)) if i == low]
    by_id = {r.doc_id: r for r in langid.identify(spark.read.parquet(f"{SF}/documents.parquet"), keep=True).collect()}
    assert all(by_id[i].lang_pred != "und" and by_id[i].score >= 0.5 and by_id[i].evidence > 0 for i, _ in docs)
    items = [tiling.words(r.text or "") for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    items = [w for w in items if len(w) >= 5]
    clean = [(i, t) for i, t in docs if not brute_leak(tiling.words(t), items)]
    assert 0 < len(clean) < len(docs) < 200
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, t in clean:
        ids = library.encode_ordinary(t)
        want.append((i, by_id[i].lang_pred, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == want


def test_stages_keep_the_columns_and_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    nothing = docs.limit(0)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, nothing, SF)
        assert out.collect() == []
        assert n == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
    assert len(corpus_pipeline.STAGES) == 5


def test_stages_take_null_texts_and_repeated_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, "the cat sat on the mat with a hat", "en", None, None), (1, "the cat sat on the mat with a hat", "en", None, None), (2, None, None, "s", 0), (None, "a lone text without an id", None, None, 3), (3, "", "en", "s", 0), (4, "123 !!", "en", "s", 6)]
    docs = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.language(spark, docs, SF).collect()) == [0, 1, 1]
    assert corpus_pipeline.lines(spark, docs, SF).count() == 6
    assert sorted(r.doc_id or 0 for r in corpus_pipeline.near_copies(spark, docs, SF).collect()) == [0, 1, 1, 2, 3, 4]
    assert corpus_pipeline.leaks(spark, docs, SF).count() == 6
    assert corpus_pipeline.tokens(spark, docs, SF).count() == 6


def test_the_language_stage_goes_by_what_was_predicted(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.language(spark, docs, SF)
    found = {r.doc_id: r for r in langid.identify(docs, keep=True).collect()}
    assert {r.doc_id: r.lang for r in kept.collect()} == {i: r.lang_pred for i, r in found.items() if r.lang_pred != "und" and r.score >= 0.5 and r.evidence > 0}
    noise = spark.createDataFrame([(-1, "Ωκεανός и море 海洋 " * 9, None, "s", 1), (-2, "The of and", "fr", "s", 1)], docs.schema)
    judged = {r.doc_id: r.lang for r in corpus_pipeline.language(spark, docs.unionByName(noise), SF).collect()}
    assert -1 not in judged and judged[-2] == "en"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_give_what_the_sql_gives(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "conversations"):
        con.execute(f"create view {table} as select * from '{os.path.join(SF, table)}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in found.description]
    want = found.fetchall()
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(str, (tuple(r) for r in got.select(*columns).collect()))) == sorted(map(str, want))


def test_all_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 11))
