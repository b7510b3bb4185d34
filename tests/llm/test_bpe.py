import base64
import hashlib

import public_tokenizers as tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from timberline.llm import bpe

RANKS = tokenizers.path("byte_bpe_50k.tiktoken")
RAW = open(RANKS, "rb").read()
TABLE = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=TABLE, special_tokens={})
OURS = bpe.Vocabulary(RAW, tokenizers.PATTERN)
WHITE = st.text(alphabet=" \t\n\xa0\x1c\x1fab'.9é", max_size=40)


def ids_of(vocabulary, batch):
    ends, ids = vocabulary.encode(batch)
    return [ids[a:b].tolist() for a, b in zip(ends, ends[1:])]


def texts_of(vocabulary, batch):
    ends, spelled = vocabulary.decode(*vocabulary.encode(batch))
    return [spelled[a:b].tobytes().decode() for a, b in zip(ends, ends[1:])]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(max_size=80) | WHITE, max_size=5))
def test_ids_are_the_librarys(batch):
    batch = [t.encode("utf-8", "ignore").decode() for t in batch]
    assert ids_of(OURS, batch) == [LIBRARY.encode_ordinary(t) for t in batch]
    assert texts_of(OURS, batch) == batch


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "\n\n \t x", "<|endoftext|>", "don't I'LL we've", "中文🙂é" * 300, "x" * 257, "ab" * 128])
def test_odd_texts(text):
    assert ids_of(OURS, [text])[0] == LIBRARY.encode_ordinary(text)


def test_forgetting_does_not_change_ids(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    small = bpe.Vocabulary(RAW, tokenizers.PATTERN)
    for text in ("the thredely outheash", "an onnthaly ounder", "the thredely outheash"):
        assert ids_of(small, [text])[0] == LIBRARY.encode_ordinary(text)


def test_operator(spark):
    rows = [(1, "Hello wörld", 7), (2, None, 8), (3, "", 9), (1, "Hello wörld", 7), (None, "x" * 3000, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    got = bpe.digests(df, RANKS, tokenizers.PATTERN).collect()
    assert len(got) == 5
    for r in got:
        text = {1: "Hello wörld", 2: "", 3: "", None: "x" * 3000}[r.doc_id]
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    assert bpe.digests(df.limit(0), RANKS, tokenizers.PATTERN).collect() == []
    encoded = bpe.encode(df, RANKS, tokenizers.PATTERN)
    assert encoded.columns == ["doc_id", "text", "ids"]
    assert all(bytes(r.decoded).decode() == (r.text or "") for r in bpe.decode(encoded, RANKS, tokenizers.PATTERN).collect())
