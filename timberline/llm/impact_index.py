"""Exact top-k search by inner product over an impact-ordered index, score at a time.

A block of vectors has a posting list for each dimension, in order of impact: the quantised component. The list is cut into segments of
like impact. For a query, the segments of all dimensions are processed by descending contribution, whichever end of a list that is; each adds to its
vectors' accumulators. Contributions are counted from the least one that a dimension can make, so accumulators only rise, and what a vector
may still gain is at most the sum of the next segments' contributions. Processing stops only when that proves that no more than a few vectors can be
among the k best; these are then scored exactly. Nothing is approximated: a vector is left out only by proof.

Queries are sent to the index in chunks of bounded size, one job each, whose results are written; so any number of queries meets all rows in blocks,
and neither the plan nor the driver's memory grows with them. Each task keeps the best of its blocks for each query, and one window picks the best of
all tasks. Components up to `NARROW` are held as 32-bit integers; vectors with larger ones have blocks of their own, whose arithmetic is Python's, of any size.

Defined results: vectors that are null, or hold null or non-finite components, take no part; a vector with fewer components counts as having zeros, an
empty one as all zeros; each row that repeats an id is a candidate and a query of its own, and only the query's own row is no candidate; null ids take no part. Ties
go to the smaller id. Scores beyond 64 bits rank by their true value and are returned as the nearest 64-bit number. An empty table gives an empty table;
other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import begin, bounded, materialize, new_path, spread

#: Rows of a block (16-bit postings) and of one with large components; segments of a list; bytes of queries sent at once; largest component of a 32-bit block.
BLOCK_ROWS, WIDE_ROWS, SEGMENTS, CHUNK_BYTES, NARROW = 4096, 256, 12, 8 << 20, 1 << 20
#: Possible members are scored exactly once they are no more than this part of a block (a power of 2): scoring them costs less than a further step.
FEW_BITS = 2


def whole(x: float, scale: int) -> int:
    """floor(scale * x), also where that is beyond 64 bits."""
    return int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale)


def vectors_of(column: list) -> tuple[np.ndarray, np.ndarray]:
    """Components as doubles, zero-padded to one width, and which vectors take part."""
    width = max((len(v) for v in column if v is not None), default=0)
    out, valid = np.zeros((len(column), width)), np.zeros(len(column), bool)
    for i, v in enumerate(column):
        if v is not None and not any(x is None for x in v):
            own = np.asarray(v, np.float64)
            if np.isfinite(own).all():
                out[i, : len(own)], valid[i] = own, True
    return out, valid


def is_wide(rows: np.ndarray, scale: int) -> np.ndarray:
    return (np.abs(rows) > NARROW / scale).any(axis=1)


def quantise(rows: np.ndarray, scale: int, wide: bool) -> np.ndarray:
    """Integer components: 64-bit numbers, or Python's for large ones."""
    if not wide:
        return np.floor(scale * rows).astype(np.int64)
    return np.array([[whole(x, scale) for x in r] for r in rows.tolist()], object).reshape(rows.shape)


class Block:
    """Posting lists in ascending order of component; segment s of dimension d is postings[d, cuts[d, s]:cuts[d, s + 1]]."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows = ids, rows
        self.order = np.ascontiguousarray(np.argsort(rows, axis=0, kind="stable").T.astype(np.uint16))
        self.values = np.take_along_axis(rows.T, self.order.astype(np.int64), axis=1)
        n, dims = rows.shape
        low, high = self.values[:, :1], self.values[:, -1:]
        band = (self.values - low) * SEGMENTS // np.maximum(high - low + 1, 1)
        self.cuts = np.array([np.searchsorted(b, np.arange(SEGMENTS + 1)) for b in band], np.int64).reshape(dims, SEGMENTS + 1)
        self.large: Block | None = self if rows.dtype == object else None

    def pack(self, raw: np.ndarray) -> dict:
        """raw: the components before quantisation, which are kept for large ones."""
        n, dims = self.rows.shape
        wide = self.rows.dtype == object
        held = raw.astype(np.float64) if wide else self.rows.astype(np.int32)
        return {"rows": n, "dims": dims, "wide": wide, "ids": self.ids.tobytes(), "components": held.tobytes(), "postings": self.order.tobytes(), "cuts": self.cuts.astype(np.int32).tobytes()}

    @classmethod
    def unpack(cls, r: dict, scale: int) -> Block:
        out = cls.__new__(cls)
        n, dims = r["rows"], r["dims"]
        held = np.frombuffer(r["components"], np.float64 if r["wide"] else np.int32).reshape(n, dims)
        out.ids, out.rows = np.frombuffer(r["ids"], np.int64), quantise(held, scale, True) if r["wide"] else held.astype(np.int64)
        out.order = np.frombuffer(r["postings"], np.uint16).reshape(dims, n)
        out.cuts = np.frombuffer(r["cuts"], np.int32).reshape(dims, SEGMENTS + 1).astype(np.int64)
        out.values = np.take_along_axis(out.rows.T, out.order.astype(np.int64), axis=1)
        out.large = out if r["wide"] else None
        return out

    def of_any_size(self) -> Block:
        """The same block in Python's integers."""
        if self.large is None:
            self.large = Block(self.ids, self.rows.astype(object))
        return self.large

    def search(self, query: np.ndarray, k: int, floor: int | None, seen: list[int] | None = None) -> list[tuple[int, int]]:
        """(score, -id) of possible members of the k best. floor: a score that the k-th best reaches already; seen: gets the share of segments done."""
        n, dims = self.rows.shape
        kind = self.rows.dtype
        q = np.zeros(dims, kind)
        q[: min(dims, len(query))] = query[:dims]
        low, high = self.values[:, 0], self.values[:, -1]
        least = np.where(q >= 0, q * low, q * high)
        # Best contribution of each segment above the dimension's least, and the segments by it; empty ones are left out.
        start, stop = self.cuts[:, :-1], self.cuts[:, 1:]
        dim, seg = np.nonzero((stop > start) & (q != 0)[:, None])
        a, b = start[dim, seg], stop[dim, seg]
        gain = np.where(q[dim] >= 0, q[dim] * self.values[dim, b - 1], q[dim] * self.values[dim, a]) - least[dim]
        by = np.argsort(-gain, kind="stable")
        dim, a, b, gain = dim[by], a[by], b[by], gain[by]
        # rest[i]: the most that a vector can gain once i segments are done: the sum of each dimension's next contribution. A dimension's
        # segments follow each other in this order, so what a segment takes from that sum is its gain less the one of its successor.
        own = np.lexsort((np.arange(len(dim)), dim))
        after = np.zeros(len(dim), kind)
        same = dim[own][1:] == dim[own][:-1]
        after[own[:-1][same]] = gain[own[1:][same]]
        first = np.ones(len(dim), bool)
        first[own[1:][same]] = False
        rest = gain[first].sum() - np.concatenate([np.zeros(1, kind), np.cumsum(gain - after)]) if len(dim) else np.zeros(1, kind)
        held, base = np.zeros(n, kind), int(least.sum()) if dims else 0
        need = None if floor is None else floor - base
        few, step, done = max(4 * k, n >> FEW_BITS), max(1, len(dim) // 12), 0
        while True:
            bar = need
            if n > k:
                own_bar = int(np.partition(held, n - k)[n - k])
                bar = own_bar if bar is None else max(bar, own_bar)
            possible = np.arange(n) if bar is None else np.flatnonzero(held + rest[done] >= bar)
            if len(possible) <= few or done >= len(dim):
                break
            d, i, size = dim[done : done + step], a[done : done + step], b[done : done + step] - a[done : done + step]
            at = np.arange(size.sum()) + np.repeat(d * n + i - np.cumsum(size) + size, size)
            add = np.repeat(q[d], size) * self.values.ravel()[at] - np.repeat(least[d], size)
            np.add.at(held, self.order.ravel()[at], add)
            done = min(done + step, len(dim))
        if seen is not None:
            seen.append(done / max(1, len(dim)))
        if not len(possible):
            return []
        exact = self.rows[possible] @ q if dims else np.zeros(len(possible), np.int64)
        return heapq.nlargest(k, zip(exact.tolist(), (-self.ids[possible]).tolist()))


_INDEX = "rows int, dims int, wide boolean, ids binary, components binary, postings binary, cuts binary"
_ARROW = pa.schema([("rows", pa.int32()), ("dims", pa.int32()), ("wide", pa.bool_()), *((c, pa.binary()) for c in ("ids", "components", "postings", "cuts"))])


def build(df: DataFrame, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """The index: a row for each block of up to BLOCK_ROWS vectors; every row of the table is in it."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("impact_index")
        held: dict[bool, list[tuple[np.ndarray, np.ndarray]]] = {False: [], True: []}

        def flush(wide: bool) -> pa.RecordBatch:
            own, held[wide] = held[wide], []
            width = max(r.shape[1] for _, r in own)
            raw = np.concatenate([np.pad(r, ((0, 0), (0, width - r.shape[1]))) for _, r in own])
            return pa.RecordBatch.from_pylist([Block(np.concatenate([i for i, _ in own]), quantise(raw, scale, wide)).pack(raw)], schema=_ARROW)

        for batch_of in batches:
            for at in range(0, batch_of.num_rows, WIDE_ROWS):
                batch = batch_of.slice(at, WIDE_ROWS)
                rows, valid = vectors_of(batch.column(vector).to_pylist())
                ids, large = batch.column(key).to_numpy(zero_copy_only=False).astype(np.int64), is_wide(rows, scale)
                for wide, most in ((False, BLOCK_ROWS), (True, WIDE_ROWS)):
                    chosen = valid & (large == wide)
                    if chosen.any():
                        if sum(len(i) for i, _ in held[wide]) + chosen.sum() > most:
                            yield flush(wide)
                        held[wide].append((ids[chosen], rows[chosen]))
        for wide in (False, True):
            if held[wide]:
                yield flush(wide)

    bounded(df.sparkSession)
    return df.where(F.col(key).isNotNull()).select(key, vector).mapInArrow(kernel, _INDEX)


def _takes_part(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False)))


def search(index: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows for each query, which is a row of the table itself. index: as written by `build`."""
    spark = index.sparkSession
    # Queries alike in id and vector have the same answer; it is given once for each of them.
    queries = queries.where(F.col(key).isNotNull() & _takes_part(F.col(vector))).groupBy(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).agg(F.count("*").alias("copies"))
    queries = materialize(queries.withColumn("number", F.monotonically_increasing_id()), "queries")
    size = queries.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(1)).alias("width")).first()
    chunks = max(1, -(-size.n * max(1, size.width) * 8 // CHUNK_BYTES))
    path, blocks = new_path(spark, "found"), spread(index)
    schema = "number long, own boolean, vec_id long, score decimal(38,0), beyond double"
    for c in range(chunks):
        held = queries.where(F.pmod(F.xxhash64("number"), F.lit(chunks)) == c).select("number", "key", "vector").toArrow()
        raw, _ = vectors_of(held.column("vector").to_pylist())
        shipped = spark.sparkContext.broadcast((held.column("number").to_numpy(), held.column("key").to_numpy(), raw))

        def kernel(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            begin("impact_index")
            numbers, keys, vectors = shipped.value
            large = is_wide(vectors, scale)
            asked = {False: quantise(vectors[~large], scale, False), True: quantise(vectors, scale, True) if large.any() else None}
            place = np.cumsum(~large) - 1
            best: list[list[tuple[int, int]]] = [[] for _ in numbers]
            for batch in batches:
                for r in batch.to_pylist():
                    block = Block.unpack(r, scale)
                    for i in range(len(numbers)):
                        # One more than k, since the query's own row is among them.
                        floor = best[i][-1][0] if len(best[i]) == k + 1 else None
                        if large[i]:
                            found = block.of_any_size().search(asked[True][i], k + 1, floor)
                        elif block.rows.dtype == object:
                            found = block.search(asked[False][place[i]].astype(object), k + 1, floor)
                        else:
                            found = block.search(asked[False][place[i]], k + 1, floor)
                        best[i] = heapq.nlargest(k + 1, best[i] + found)
            flat: list[tuple] = []
            for i, found in enumerate(best):
                self_score = sum(x * x for x in (whole(v, scale) for v in vectors[i].tolist()))
                flat += [(int(numbers[i]), -v == int(keys[i]) and s == self_score, -v, s) for s, v in found]
            if flat:
                number, own, ids, scores = zip(*flat)
                fits = [max(-(10**37), min(10**37, s)) for s in scores]
                yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(own), pa.array(ids, pa.int64()), pa.array(fits, pa.decimal128(38, 0)), pa.array([_as_double(s) for s in scores], pa.float64())], names=["number", "own", "vec_id", "score", "beyond"])

        blocks.mapInArrow(kernel, schema).write.mode("append").parquet(path)
        shipped.destroy()
    found = spark.read.schema(schema).parquet(path)
    order = Window.partitionBy("number").orderBy(F.desc("beyond"), F.desc("score"), "vec_id", F.desc("own"))
    # The query's own row goes: one of those with its id and its score.
    ranked = found.withColumn("at", F.row_number().over(order)).where(F.col("at") <= k + 1)
    ranked = ranked.withColumn("own_at", F.min(F.when(F.col("own"), F.col("at"))).over(Window.partitionBy("number"))).where("own_at is null or at <> own_at")
    ranked = ranked.withColumn("rank", F.col("at") - F.when(F.col("at") > F.col("own_at"), 1).otherwise(0)).where(F.col("rank") <= k)
    most = F.lit(2**63 - 1).cast("decimal(38,0)")
    score = F.greatest(F.least("score", most), -most - 1).cast("long")
    named = ranked.join(queries.select("number", F.col("key").alias("query_id"), "copies"), "number")
    return named.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("query_id", "rank", "vec_id", score.alias("score"))


def _as_double(score: int) -> float:
    """Where scores are beyond what a decimal holds, their order; 0 for others, which the decimal orders."""
    if abs(score) <= 10**37:
        return 0.0
    try:
        return float(score)
    except OverflowError:
        return math.copysign(math.inf, score)


def top_k(df: DataFrame, queries: DataFrame, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """Build the index of a table, write it, and search it."""
    return search(materialize(build(df, key, vector, scale), "impact-index"), queries, k, key, vector, scale)
