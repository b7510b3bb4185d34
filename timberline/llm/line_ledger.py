"""Reversible line dedup: sharded cuckoo filters backed by exact reference-count tables.

A text is cut at \\n. A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys are held as 128-bit hashes.
The ledger's truth is the table `refs` (key, number of documents that hold it). A key that reaches `threshold` documents enters the
cuckoo filter of its shard; a key that falls below it, because documents were deleted, leaves it. So insertions and deletions
both update the ledger, and a deletion undoes an insertion exactly.

Lines are looked up in the filters. A filter can also say yes to a key that is not in it. Filters whose counted size allows it are broadcast; then
every such key of `refs` is found beforehand and travels along as an exception, so the answer is exact. Else the documents' keys go to their
shard's filter, salted, and what passes meets the hot part of `refs` in a salted join, which is exact as well.

Defined results: a null text counts as empty, and has one empty line; each row counts as a document, also one that repeats; keys with
fewer than `min_chars` code points always stay; when all lines go, the kept text is empty; an empty table gives an empty table. Columns
of the input pass through, except ones named `kept`, `n_lines` or `n_dropped`, which are replaced. Deleting a document that was not inserted is an error
that leaves the ledger as it was, whenever it would take a count below zero.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BROADCAST_BYTES, begin, bounded, drop_clashing, new_path, remove, slices, spread, texts

SLOTS, KICKS = 4, 500


def line_keys(text: bytes) -> tuple[list[bytes], list[bytes]]:
    lines = text.split(b"\n")
    return lines, [x.strip().lower() for x in lines]


def hash_keys(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), ">u8").reshape(-1, 2).astype(np.uint64)
    return both[:, 0], both[:, 1]


class CuckooFilter:
    """Four 32-bit fingerprints a bucket; the second bucket follows from the first and the fingerprint, so a key can be deleted."""

    def __init__(self, buckets: int, table: np.ndarray | None = None):
        self.buckets, self.table = buckets, np.zeros((buckets, SLOTS), np.uint32) if table is None else table

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> CuckooFilter:
        buckets = 1 << max(2, int(len(hi) / (0.85 * SLOTS)).bit_length())
        while True:
            out = cls(buckets)
            if all(out.insert(*x) for x in zip(hi.tolist(), lo.tolist())):
                return out
            buckets *= 2

    def _places(self, hi: int, lo: int) -> tuple[int, int, int]:
        mark = (lo & 0xFFFFFFFF) or 1
        first = hi & (self.buckets - 1)
        return mark, first, first ^ self._other(mark)

    def _other(self, mark: int) -> int:
        return ((mark * 0x5BD1E995) & 0xFFFFFFFF) >> 7 & (self.buckets - 1)

    def insert(self, hi: int, lo: int) -> bool:
        mark, at, second = self._places(hi, lo)
        for b in (at, second):
            free = np.flatnonzero(self.table[b] == 0)
            if free.size:
                self.table[b, free[0]] = mark
                return True
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[at, slot] = int(self.table[at, slot]), mark
            at ^= self._other(mark)
            free = np.flatnonzero(self.table[at] == 0)
            if free.size:
                self.table[at, free[0]] = mark
                return True
        return False

    def delete(self, hi: int, lo: int) -> bool:
        mark, *places = self._places(hi, lo)
        for b in places:
            held = np.flatnonzero(self.table[b] == mark)
            if held.size:
                self.table[b, held[0]] = 0
                return True
        return False


class FilterSet:
    """All shards' filters in one array, for lookups of many keys at once."""

    def __init__(self, shards: int, rows: list[tuple[int, int, bytes]], exceptions: set[tuple[int, int]] = frozenset()):
        self.shards, self.exceptions = shards, exceptions
        self.buckets, self.start = np.ones(shards, np.uint64), np.zeros(shards, np.int64)
        tables = [np.zeros((1, SLOTS), np.uint32)]
        for shard, buckets, raw in rows:
            self.buckets[shard], self.start[shard] = buckets, sum(map(len, tables))
            tables.append(np.frombuffer(raw, np.uint32).reshape(-1, SLOTS))
        self.table = np.concatenate(tables)

    def maybe(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        shard = shard_of(hi, self.shards)
        mark = (lo & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        mark[mark == 0] = 1
        mask, start = self.buckets[shard] - np.uint64(1), self.start[shard]
        first = hi & mask
        other = ((mark.astype(np.uint64) * np.uint64(0x5BD1E995)) & np.uint64(0xFFFFFFFF)) >> np.uint64(7) & mask
        found = (self.table[start + first.astype(np.int64)] == mark[:, None]).any(axis=1)
        return found | (self.table[start + (first ^ other).astype(np.int64)] == mark[:, None]).any(axis=1)

    def holds(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = self.maybe(hi, lo)
        if self.exceptions:
            for i in np.flatnonzero(out).tolist():
                out[i] = (int(hi[i]), int(lo[i])) not in self.exceptions
        return out


def shard_of(hi: np.ndarray, shards: int) -> np.ndarray:
    return ((hi >> np.uint64(40)) % np.uint64(shards)).astype(np.int64)


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


class LineLedger:
    """A ledger in a shared folder; every change writes a new version of its tables."""

    REFS = "shard int, hi long, lo long, was long, refs long"
    FILTERS = "shard int, buckets long, filter binary"

    def __init__(self, spark: SparkSession, path: str | None = None, threshold: int = 10, min_chars: int = 1, shards: int = 64):
        """shards: each shard's hot keys meet in one task, so let it grow with the number of hot keys (a million each, say)."""
        bounded(spark)
        self.spark, self.path = spark, path or new_path(spark, "line-ledger")
        self.threshold, self.min_chars, self.shards, self.version = threshold, min_chars, shards, 0

    def _table(self, name: str, schema: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/v{self.version}/{name}")

    @property
    def refs(self) -> DataFrame:
        return self._table("refs", self.REFS)

    @property
    def filters(self) -> DataFrame:
        return self._table("filters", self.FILTERS)

    def _counts(self, docs: DataFrame, text: str) -> DataFrame:
        """(hi, lo, n): the documents that hold a key; counted within each slice first."""
        min_chars = self.min_chars

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("line_ledger")
            for whole in batches:
                for batch in slices(whole, text):
                    held: Counter[bytes] = Counter()
                    for doc in texts(batch.column(text)):
                        held.update(set(line_keys(doc)[1]))
                    keys = [k for k in held if long_enough(k, min_chars)]
                    if keys:
                        hi, lo = hash_keys(keys)
                        yield pa.RecordBatch.from_arrays([signed(hi), signed(lo), pa.array([held[k] for k in keys], pa.int64())], names=["hi", "lo", "n"])

        return docs.select(text).mapInArrow(kernel, "hi long, lo long, n long").groupBy("hi", "lo").agg(F.sum("n").alias("n"))

    def insert(self, docs: DataFrame, text: str = "text") -> LineLedger:
        return self._change(self._counts(docs, text))

    def delete(self, docs: DataFrame, text: str = "text") -> LineLedger:
        """Take documents out that were inserted before."""
        return self._change(self._counts(docs, text).withColumn("n", -F.col("n")))

    def _change(self, delta: DataFrame) -> LineLedger:
        threshold, shards, at = self.threshold, self.shards, f"{self.path}/v{self.version + 1}"
        shard = F.pmod(F.shiftrightunsigned("hi", 40), F.lit(shards)).cast("int")
        both = self.refs.select("hi", "lo", F.col("refs").alias("was"), F.lit(0).cast("long").alias("n")).unionByName(delta.withColumn("was", F.lit(0).cast("long")))
        merged = both.groupBy("hi", "lo").agg(F.sum("was").alias("was"), (F.sum("was") + F.sum("n")).alias("refs"))
        merged.select(shard.alias("shard"), "hi", "lo", "was", "refs").where("refs <> 0 or was > 0").write.parquet(f"{at}/refs")
        fresh = self.spark.read.schema(self.REFS).parquet(f"{at}/refs")
        if not fresh.where("refs < 0").isEmpty():
            remove(self.spark, at)
            raise ValueError("a document was deleted that the ledger doesn't hold")

        def rebuild(key: tuple, rows: pa.Table, old: pa.Table) -> pa.Table:
            hi, lo, was, refs = (rows.column(c).to_numpy() for c in ("hi", "lo", "was", "refs"))
            hi, lo, was, now = hi.view(np.uint64), lo.view(np.uint64), was >= threshold, refs >= threshold
            held = None
            if old.num_rows:
                held = CuckooFilter(old.column("buckets")[0].as_py(), np.frombuffer(old.column("filter")[0].as_py(), np.uint32).reshape(-1, SLOTS).copy())
                right = all(held.delete(*x) for x in zip(hi[was & ~now].tolist(), lo[was & ~now].tolist()))
                right = right and all(held.insert(*x) for x in zip(hi[now & ~was].tolist(), lo[now & ~was].tolist()))
                held = held if right else None
            held = held or CuckooFilter.of(hi[now], lo[now])
            return pa.table({"shard": pa.array([key[0].as_py() if hasattr(key[0], "as_py") else key[0]], pa.int32()), "buckets": pa.array([held.buckets], pa.int64()), "filter": pa.array([held.table.tobytes()], pa.binary())})

        hot = fresh.where((F.col("refs") >= threshold) | (F.col("was") >= threshold)).groupBy("shard")
        hot.cogroup(self.filters.groupBy("shard")).applyInArrow(rebuild, self.FILTERS).write.parquet(f"{at}/filters")
        self.version += 1
        return self

    def _lookup(self) -> FilterSet | None:
        """What executors need to test a key exactly, or None where that is beyond the bound."""
        limit, sc = BROADCAST_BYTES, self.spark.sparkContext
        if (self.filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0) > limit:
            return None
        rows = [(r.shard, r.buckets, bytes(r.filter)) for r in self.filters.collect()]
        shipped = sc.broadcast(FilterSet(self.shards, rows))

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = shipped.value.maybe(b.column("hi").to_numpy().view(np.uint64), b.column("lo").to_numpy().view(np.uint64))
                yield b.filter(pa.array(found))

        false = self.refs.where(F.col("refs") < self.threshold).select("hi", "lo").mapInArrow(passing, "hi long, lo long")
        most = limit // 100
        wrong = false.limit(most + 1).collect()
        if len(wrong) > most:
            return None
        return FilterSet(self.shards, rows, {(r.hi % 2**64, r.lo % 2**64) for r in wrong})

    def apply(self, docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
        """Add kept, n_lines and n_dropped to each document."""
        docs = drop_clashing(docs, "kept", "n_lines", "n_dropped")
        min_chars, lookup = self.min_chars, self._lookup()
        schema = T.StructType([*docs.schema.fields, T.StructField("kept", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
        if lookup is None:
            docs = docs.join(self._hot_of(docs, text, key), F.col(key).eqNullSafe(F.col("__key")), "left").drop("__key")
        shipped = self.spark.sparkContext.broadcast(lookup)

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            begin("line_ledger")
            tested, names = shipped.value, schema.names
            for whole in batches:
                for batch in slices(whole, text):
                    cut = [line_keys(doc) for doc in texts(batch.column(text))]
                    if tested is not None:
                        keys = list({k for _, own in cut for k in own if long_enough(k, min_chars)})
                        gone = {keys[i] for i in np.flatnonzero(tested.holds(*hash_keys(keys))).tolist()} if keys else set()
                        hot = [gone] * len(cut)
                    else:
                        hot = []
                        for (_, own), listed in zip(cut, batch.column("__hot").to_pylist()):
                            there, keys = set(listed or ()), list({k for k in own if long_enough(k, min_chars)})
                            hot.append({k for k in keys if xxhash.xxh3_128_digest(k) in there} if there else set())
                    kept = [[line for line, k in zip(lines, own) if k not in gone] for (lines, own), gone in zip(cut, hot)]
                    n = [len(lines) for lines, _ in cut]
                    added = [pa.array([b"\n".join(x) for x in kept], pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array([a - len(x) for a, x in zip(n, kept)], pa.int64())]
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-3]), *added], names=names)

        return docs.mapInArrow(kernel, schema)

    def _hot_of(self, docs: DataFrame, text: str, key: str) -> DataFrame:
        """(__key, __hot): the hot keys of each document. Its keys meet their shard's filter, and what passes the hot keys themselves; both repeat for 16 salts."""
        min_chars, shards = self.min_chars, self.shards

        def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, text):
                    for row, doc in enumerate(texts(batch.column(text))):
                        keys = [k for k in set(line_keys(doc)[1]) if long_enough(k, min_chars)]
                        if keys:
                            hi, lo = hash_keys(keys)
                            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array([row] * len(keys))), signed(hi), signed(lo)], names=["__key", "hi", "lo"])

        held = docs.select(key, text).mapInArrow(kernel, T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType())]))
        shard = F.pmod(F.shiftrightunsigned("hi", 40), F.lit(shards)).cast("int")
        held = held.select("*", shard.alias("shard"), F.pmod(F.xxhash64("__key"), F.lit(16)).cast("int").alias("salt"), F.lit(None).cast("long").alias("buckets"), F.lit(None).cast("binary").alias("filter"))
        every = F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt")
        tables = self.filters.select(F.lit(None).cast(docs.schema[key].dataType).alias("__key"), F.lit(None).cast("long").alias("hi"), F.lit(None).cast("long").alias("lo"), "shard", every, "buckets", "filter")

        def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come by (shard, salt), the filter before the keys."""
            begin("line_ledger")
            tested = None
            for batch in batches:
                on = np.asarray(batch.column("filter").is_null())
                hi, lo = (pc.fill_null(batch.column(c), 0).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("hi", "lo"))
                opens = np.flatnonzero(~on).tolist()
                for a, b in zip([0, *opens], [*opens, batch.num_rows]):
                    if a < b and not on[a]:
                        tested = FilterSet(1, [(0, batch.column("buckets")[a].as_py(), batch.column("filter")[a].as_py())])
                    if tested is not None:  # a shard without a filter has no hot key, so any filter will do
                        on[a:b] &= tested.maybe(hi[a:b], lo[a:b])
                yield batch.select(["__key", "hi", "lo", "salt"]).filter(pa.array(on))

        both = spread(tables.unionByName(held), "shard", "salt").sortWithinPartitions("shard", "salt", F.col("filter").isNull())
        held = both.mapInArrow(passing, T.StructType([T.StructField("__key", docs.schema[key].dataType), T.StructField("hi", T.LongType()), T.StructField("lo", T.LongType()), T.StructField("salt", T.IntegerType())]))
        hot = self.refs.where(F.col("refs") >= self.threshold).select("hi", "lo", F.explode(F.sequence(F.lit(0), F.lit(15))).alias("salt"))
        raw = F.concat(*[F.unhex(F.lpad(F.hex(c), 16, "0")) for c in ("hi", "lo")])
        return held.join(hot, ["hi", "lo", "salt"], "left_semi").groupBy("__key").agg(F.collect_set(raw).alias("__hot"))


def long_enough(key: bytes, min_chars: int) -> bool:
    return bool(key) if min_chars == 1 else len(key.decode("utf-8", "replace")) >= min_chars


def dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", threshold: int = 10, min_chars: int = 1) -> DataFrame:
    """Insert all documents into a new ledger, and drop every line whose key is in `threshold` documents or more."""
    return LineLedger(docs.sparkSession, threshold=threshold, min_chars=min_chars).insert(docs, text).apply(docs, text, key)
