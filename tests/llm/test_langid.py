import zlib

import numpy as np
from pyspark.sql import functions as F

from timberline.llm import langid

SF = "/root/testdata/sf0.01"


def test_features_stay_within_texts():
    both, owner = langid.features(["abC", "", "de"])
    alone = [langid.features([t])[0] for t in ("abC", "", "de")]
    for i, own in enumerate(alone):
        assert sorted(both[owner == i].tolist()) == sorted(own.tolist())
    assert len(alone[0]) == 6 and len(alone[2]) == 3


def test_sums_are_by_document():
    matrix = np.arange(3 << 16, dtype=float).reshape(3, -1) % 977
    for docs in ([], [""], ["", "ab", "", "x", "日本語 text", "", "ab"], ["a"] * 5):
        found, owner = langid.features(docs)
        want = [[row[found[owner == i]].sum() for i in range(len(docs))] for row in matrix]
        assert langid.sums(matrix, found, owner, len(docs)).tolist() == want


def test_scores_are_brute_force(spark):
    rows = [(i, t, l) for i, (t, l) in enumerate([("aab", "x"), ("abb", "x"), ("ccd", "y"), ("cdd", "y"), (None, "y"), ("zz", None)])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    [(names, matrix)] = langid.train(df)
    assert names == ["x", "y"]
    for r, name in enumerate(names):
        found = np.concatenate([langid.features([t])[0] for _, t, l in rows if l == name and t])
        n = np.bincount(found, minlength=matrix.shape[1])
        assert np.allclose(matrix[r], np.log((n + 1) / (n.sum() + len(n))))
    got = {r.doc_id: r for r in langid.predict(df.selectExpr("*", "1 as score"), [(names, matrix)]).collect()}
    for i, t, _ in rows:
        if t:
            s = matrix[:, langid.features([t])[0]].sum(axis=1)
            assert got[i].lang_pred == names[int(s.argmax())] and abs(got[i].score - 1 / np.exp(s - s.max()).sum()) < 1e-9
    assert (got[4].lang_pred, got[4].score) == ("und", 0.0)


def test_more_languages_than_a_chunk(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(300)
    plain = lambda: sorted((r.doc_id, r.lang_pred, round(r.score, 9), round(r.evidence, 9)) for r in langid.identify(docs, keep=True).collect())
    want = plain()
    for size in (1, 3):
        monkeypatch.setattr(langid, "CHUNK", size)
        assert plain() == want


def test_noise_has_no_language(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    odd = spark.createDataFrame([(-1, "Ωκεανός и море 海洋 " * 9, "en"), (-2, "zq9XkQ7wJvZ0pQxYq8Kj" * 20, None), (-3, "de the", "fr"), (-4, "!! 12", "en")], "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang for r in langid.tell(docs.unionByName(odd)).collect()}
    assert not {-1, -2, -4} & set(got) and got[-3] == "en"
    lettered = {r.doc_id: r.lang for r in docs.where("text rlike '\\\\p{L}'").collect()}
    assert set(lettered) == set(got) - {-3} and sum(got[i] == x for i, x in lettered.items()) > 0.97 * len(lettered)


def test_edges(spark):
    rows = [(1, "12 34 !!", "en"), (2, "", "en"), (3, None, None), (3, None, None), (None, "abc", "en"), (5, "ß" * 200_000, "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.identify(df).collect()
    assert len(got) == 6 and all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1, 2, 3))
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(df.limit(0)).collect() == []
    assert {r.lang_pred for r in langid.identify(df.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    tested = [r for r in got if r.held_out]
    assert len(tested) > 100 and sum(r.lang_pred == lang[r.doc_id] for r in tested) / len(tested) > 0.97


def test_a_small_sample_is_enough(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    [(names, matrix)] = langid.train(docs, limit=50)
    assert len(names) == 4 and np.isfinite(matrix).all()
