"""Byte-level BPE encoding and decoding.

Texts are cut by a pattern; each piece becomes token ids by merges of adjacent tokens in rank order. The pieces that a
batch needs are encoded together: they are grouped by length into padded numpy matrices, one row each. In every round each row
merges its leftmost pair of least rank; pair ranks come from a hash table in numpy; rows without a pair leave the matrix, and the
matrix loses a column. Pieces beyond `MATRIX_BYTES` follow the same rule with a heap, so that a text without any space
costs n log n steps.

Defined results: null and empty texts have no ids and decode to empty bytes; rows that repeat are encoded each by itself; an empty
table gives an empty table; other columns of the input pass through, except ones named `ids` or `decoded`, which are replaced.
"""

from __future__ import annotations

import base64
import gc
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, bounded, drop_clashing, remembers, slices, texts

#: Longest piece that goes to a matrix, and rows of a matrix; pieces that a worker remembers.
MATRIX_BYTES, MATRIX_ROWS = 256, 1 << 14
REMEMBERED = 150_000
_NONE = np.int32(2**31 - 1)
_EMPTY = np.uint64(2**64 - 1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Tokens by id, and the ranks of the pairs that may merge, in an open-addressing hash table."""

    def __init__(self, rank_file: bytes, pattern: str):
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, rank_file.splitlines()) if a}
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.tokens[rank] = token
        self.bytes_to_id = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        pairs = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = np.array(pairs, np.int64).reshape(-1, 3).T
        self.bits = max(4, int(2 * len(rank)).bit_length())
        self.keys = np.full(1 << self.bits, _EMPTY)
        self.values = np.full(1 << self.bits, _NONE, np.int32)
        key, slot = self._hash(left, right)
        waiting = np.arange(len(key))
        while waiting.size:
            first, at = np.unique(slot[waiting], return_index=True)
            free = self.keys[first] == _EMPTY
            placed = waiting[at[free]]
            self.keys[slot[placed]], self.values[slot[placed]] = key[placed], rank[placed]
            waiting = np.setdiff1d(waiting, placed, assume_unique=True)
            slot[waiting] = (slot[waiting] + 1) & ((1 << self.bits) - 1)
        self.known = _Pieces()
        self.spelled = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.spelled_bytes = np.array([len(t) for t in self.tokens], np.int64)
        self.spelled_start = np.cumsum(self.spelled_bytes) - self.spelled_bytes

    def _hash(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        return key, ((key * _MULTIPLIER) >> np.uint64(64 - self.bits)).astype(np.int64)

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, which is also the id it merges to; _NONE where it doesn't merge or an id is -1."""
        out = np.full(len(left), _NONE, np.int32)
        waiting = np.flatnonzero((left >= 0) & (right >= 0))
        key, slot = self._hash(left[waiting], right[waiting])
        while waiting.size:
            there = self.keys[slot]
            hit = there == key
            out[waiting[hit]] = self.values[slot[hit]]
            on = ~hit & (there != _EMPTY)
            waiting, key, slot = waiting[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def merge_matrix(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        lengths = np.array([len(p) for p in pieces])
        width = int(lengths.max())
        filled = np.arange(width) < lengths[:, None]
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[filled] = self.bytes_to_id[np.frombuffer(b"".join(pieces), np.uint8)]
        rank = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), width - 1)
        row, out = np.arange(len(pieces)), [()] * len(pieces)
        while row.size:
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            best = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), _NONE)
            done = best == _NONE
            if done.any():
                for i, found in zip(row[done].tolist(), ids[done]):
                    out[i] = tuple(found[found >= 0].tolist())
                row, ids, rank, at, best = row[~done], ids[~done], rank[~done], at[~done], best[~done]
                if not row.size:
                    break
            n, k, width = np.arange(len(row)), at, ids.shape[1]
            ids[n, k] = best
            ids = ids[np.arange(width) != (k + 1)[:, None]].reshape(len(row), width - 1)
            rank = rank[np.arange(width - 1) != k[:, None]].reshape(len(row), width - 2)
            before = k > 0
            rank[n[before], k[before] - 1] = self.pair_ranks(ids[n[before], k[before] - 1], ids[n[before], k[before]])
            after = k < width - 2
            rank[n[after], k[after]] = self.pair_ranks(ids[n[after], k[after]], ids[n[after], k[after] + 1])
        return out

    def merge_heap(self, piece: bytes) -> tuple[int, ...]:
        ids = self.bytes_to_id[np.frombuffer(piece, np.uint8)].tolist()
        spelled, ranks, n = self.tokens, self.ranks, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.pair_ranks(np.array(ids[:-1], np.int32), np.array(ids[1:], np.int32))
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first.tolist()) if r != _NONE]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (r := ranks.get(spelled[ids[i]] + spelled[ids[j]])) is not None:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return tuple(x for x in ids if x >= 0)

    def _ids(self, pieces: list[str]) -> list[tuple[int, ...]]:
        """The ids of some pieces, which differ from each other."""
        out: list[tuple[int, ...]] = [()] * len(pieces)
        buckets: dict[int, list[tuple[int, bytes]]] = {}
        for i, piece in enumerate(pieces):
            raw = piece.encode()
            if (whole := self.ranks.get(raw)) is not None:
                out[i] = (whole,)
            elif len(raw) > MATRIX_BYTES:
                out[i] = self.merge_heap(raw)
            else:
                buckets.setdefault((len(raw) - 1).bit_length(), []).append((i, raw))
        for members in buckets.values():
            for at in range(0, len(members), MATRIX_ROWS):
                part = members[at : at + MATRIX_ROWS]
                for (i, _), ids in zip(part, self.merge_matrix([r for _, r in part])):
                    out[i] = ids
        return out

    def encode(self, batch: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ends, ids): text i has ids[ends[i]:ends[i + 1]]. Each piece that a worker meets is encoded once while it remembers it."""
        table = self.known
        pieces = [self.pattern.findall(t) for t in batch]
        counts = np.array([len(p) for p in pieces], np.int64)
        code = np.fromiter(map(table.__getitem__, chain.from_iterable(pieces)), np.int64, int(counts.sum()))
        if table.fresh:
            table.add(self._ids(table.fresh))
        start, size, ids = table.arrays()
        lengths = size[code]
        done = np.concatenate([[0], np.cumsum(lengths)])
        at = np.repeat(start[code] - done[:-1], lengths) + np.arange(done[-1])
        if len(table) > REMEMBERED:
            self.known = _Pieces()
        return done[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32), ids[at]

    def decode(self, ends: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ends, bytes) of what the ids spell."""
        size = self.spelled_bytes[ids]
        done = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.spelled_start[ids] - done[:-1], size) + np.arange(done[-1])
        return done[ends].astype(np.int32), self.spelled[at]


class _Pieces(dict):
    """A number for each piece that was met, and the ids of the numbered pieces in one array."""

    def __init__(self):
        self.fresh: list[str] = []
        self._size, self._ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]

    def __missing__(self, piece: str) -> int:
        self[piece] = out = len(self)
        self.fresh.append(piece)
        return out

    def add(self, found: list[tuple[int, ...]]) -> None:
        self._size.append(np.array([len(x) for x in found], np.int64))
        self._ids.append(np.fromiter(chain.from_iterable(found), np.int32))
        self.fresh = []

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        for held in (self._size, self._ids):
            held[:] = [np.concatenate(held)]
        return np.cumsum(self._size[0]) - self._size[0], self._size[0], self._ids[0]


_LOADED: dict[tuple[int, str], Vocabulary] = {}
remembers("bpe", _LOADED.clear)


def _vocabulary(raw: bytes, pattern: str) -> Vocabulary:
    """One per worker process, until another operator's kernel begins there; the file's size is fixed, whatever the input."""
    begin("bpe")
    key = (hash(raw), pattern)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(raw, pattern)
    return _LOADED[key]


@contextmanager
def _no_collection() -> Iterator[None]:
    """Tuples and strings by the million have no cycles to look for."""
    gc.disable()
    try:
        yield
    finally:
        gc.enable()


def _encoded(vocabulary: Vocabulary, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    with _no_collection():
        return vocabulary.encode([t.decode("utf-8", "replace") for t in texts(column)])


def _decoded(vocabulary: Vocabulary, ends: np.ndarray, ids: np.ndarray) -> pa.Array:
    ends, spelled = vocabulary.decode(ends, ids)
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(spelled)])


def encode(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add `ids`, an array of ints, to each row."""
    df = drop_clashing(df, "ids")
    bounded(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())
    schema = T.StructType([*df.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(*_encoded(vocabulary, batch.column(text)))], names=[*batch.schema.names, "ids"])

    return df.mapInArrow(kernel, schema)


def decode(df: DataFrame, rank_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """Add `decoded`, the bytes that the ids stand for."""
    df = drop_clashing(df, "decoded")
    bounded(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.BinaryType())])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value, pattern)
        for whole in batches:
            for a in range(0, whole.num_rows, 256):
                batch = whole.slice(a, 256)
                held = [x or () for x in batch.column(ids).to_pylist()]
                ends = np.cumsum([0, *map(len, held)])
                out = _decoded(vocabulary, ends, np.fromiter(chain.from_iterable(held), np.int64, int(ends[-1])))
                yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(kernel, schema)


def round_trip(df: DataFrame, rank_path: str, pattern: str, text: str = "text") -> DataFrame:
    """Add `ids`, and `decoded` as those ids spell it; one pass, so that a worker holds one vocabulary."""
    df = drop_clashing(df, "ids", "decoded")
    bounded(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(open(rank_path, "rb").read())
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())]
    schema = T.StructType([*df.schema.fields, *added])

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shipped.value, pattern)
        for whole in batches:
            for batch in slices(whole, text):
                ends, ids = _encoded(vocabulary, batch.column(text))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(ends, ids), _decoded(vocabulary, ends, ids)], names=schema.names)

    return df.mapInArrow(kernel, schema)


def digests(df: DataFrame, rank_path: str, pattern: str, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Encode, decode, and reduce both to digests: one row per document, with the columns of `keep`."""
    done = round_trip(df.select(key, text, *keep), rank_path, pattern, text)
    return done.select(
        key, *keep,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
