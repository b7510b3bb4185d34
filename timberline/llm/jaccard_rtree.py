"""N-gram Jaccard join over an R-tree of count vectors, and the groups that its links form.

A document's set holds the hashes of its distinct n-word shingles. A set's shingles fall into groups by hash; the counts per group are a point. Two sets
share at most the sum, over groups, of the smaller count. An R-tree over the points is searched with that bound: first between the upper
corners of its boxes, then between points; pairs that survive are verified on the sets themselves.

The tree is distributed over families: sets that could link at all. All sets are put in one order (shingles that are frequent in a sample of bounded size
last, else by hash); each run of three neighbours is a key, and a set brings the runs of its first part. Shingles that a linked pair doesn't
share break at most three runs each, and the part is long enough that some run stays whole; so two linked sets always share a key, whatever the
sample. Sets of compatible sizes with a common key are chained, and what is connected by chains is a family. Families are small next
to the table; large ones are cut into blocks, so no task holds an unbounded group. Blocks are searched one by one first, then one set of each
component that they gave. That makes most groups of near copies one component. Only of a family that still isn't one, each pair of blocks is
a cell, in which links are sought between components.

Equal sets form one class before all this, and a link is only sought between two sets that aren't connected yet, so a group of copies costs a row each, not
a row for each pair.

Defined results: ids may be of any type that has an order; integers are used as they are, others are numbered first; words are lower-cased in A-Z and cut at ASCII white space; a text with fewer than n words is one shingle; a null text, or one without words,
has an empty set, is linked with nothing, and is its own component. Rows that repeat an id are one document for linking, each with its own set size. A null id
is linked with nothing and has a null component. An empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import begin, bounded, materialize, numbered, remembers, salted_left_join, sized, slices, spread, texts
from .components import components, smallest_reachable

#: Documents of the sample that decides which shingles come last, and how many of them must hold one; sets and shingles of a block.
SAMPLE_DOCS, SAMPLE_HELD, BLOCK_SETS, BLOCK_SHINGLES = 8_000, 4, 512, 400_000
#: Points of a leaf, leaves of a node; keys that a task unpacks at once.
LEAF, FAN, MEET_KEYS = 32, 16, 400_000
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = out = xxhash.xxh3_64_intdigest(word)
        return out


_HASHES = _WordHashes()
remembers("jaccard", _HASHES.clear)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD[1]
    return x ^ (x >> np.uint64(29))


def shingle_sets(batch: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    split = [t.lower().split() for t in batch]
    lengths = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((h for w in split for h in map(_HASHES.__getitem__, w)), np.uint64, int(lengths.sum()))
    value = np.zeros(max(0, len(flat) - n + 1), np.uint64)
    for i in range(n):
        value = value * _ODD[0] + flat[i : i + len(value)]
    value, out, at = mix(value + np.uint64(n)), [], 0
    for size in lengths.tolist():
        if size >= n:
            out.append(np.unique(value[at : at + size - n + 1]))
        elif size:
            whole = np.uint64(0)
            with np.errstate(over="ignore"):
                for h in flat[at : at + size]:
                    whole = whole * _ODD[0] + h
                out.append(mix(np.array([whole + np.uint64(size)])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += size
    return out


class Law:
    """Similarity of `percent` of 100, in whole numbers."""

    def __init__(self, percent: int):
        self.percent = percent
        # Runs of r break r times for each shingle that only this set has; r * (100 - percent) of 100 shingles must leave some run.
        self.run = max(1, min(3, 75 // max(1, 100 - percent)))

    def keys_needed(self, size: int) -> int:
        return min(size, self.run * (100 - self.percent) * size // 100 + 1)

    def sizes_fit(self, small, large):
        return 100 * small >= self.percent * large

    def overlap_needed(self, a, b):
        """Least intersection of two linked sets of these sizes."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def run_keys(self, ordered: np.ndarray) -> np.ndarray:
        m = self.keys_needed(len(ordered))
        padded = np.concatenate([ordered[: m + self.run - 1], np.arange(1, self.run, dtype=np.uint64)])
        value = np.zeros(m, np.uint64)
        for i in range(self.run):
            value = value * _ODD[2] + padded[i : i + m]
        return mix(value)


def chains(key: np.ndarray, size: np.ndarray, node: np.ndarray, law: Law) -> tuple[np.ndarray, np.ndarray]:
    """Links between neighbours by size among the nodes that share a key, where sizes fit."""
    by = np.lexsort((node, size, key))
    key, size, node = key[by], size[by], node[by]
    on = (key[1:] == key[:-1]) & law.sizes_fit(size[:-1], size[1:]) & (node[1:] != node[:-1])
    return node[:-1][on], node[1:][on]


def thin(key: np.ndarray, size: np.ndarray, node: np.ndarray, law: Law) -> np.ndarray:
    """Which entries stand for their slice: of the nodes chained at a key, enough that any size between two of them fits both."""
    by = np.lexsort((node, size, key))
    keep = np.ones(len(by), bool)
    k, s = key[by], size[by]
    start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    for a, b in zip(start.tolist(), [*start[1:].tolist(), len(by)]):
        if b - a < 3:
            continue
        last = a
        for i in range(a + 1, b - 1):
            # i can go if the last kept one fits the next one.
            if law.sizes_fit(s[last], s[i + 1]):
                keep[i] = False
            else:
                last = i
    out = np.zeros(len(by), bool)
    out[by[keep]] = True
    return out


_PACKED = "bucket int, keys binary, nodes binary, sizes binary, hi binary, lo binary"


def _packed(bucket: int, keys=None, nodes=None, sizes=None, hi=None, lo=None) -> dict:
    blob = lambda x: None if x is None else np.ascontiguousarray(x).tobytes()
    return {"bucket": bucket, "keys": blob(keys), "nodes": blob(nodes), "sizes": blob(sizes), "hi": blob(hi), "lo": blob(lo)}


_PACKED_ARROW = pa.schema([("bucket", pa.int32()), *((c, pa.binary()) for c in ("keys", "nodes", "sizes", "hi", "lo"))])


def _frequent(docs: DataFrame, n: int) -> np.ndarray:
    """Shingles that SAMPLE_HELD of about SAMPLE_DOCS sampled documents hold; they only decide an order."""
    total = docs.count()
    share = min(1.0, SAMPLE_DOCS / max(1, total))
    part = F.pmod(F.xxhash64(F.col("key"), F.lit("sample")), F.lit(1 << 30)) / float(1 << 30)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(texts(batch.column("text")), n)
                value, held = np.unique(np.concatenate(sets), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(held.astype(np.int64))], names=["h", "n"])

    counted = docs.where(part < share).mapInArrow(kernel, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    found = counted.where(F.col("n") >= SAMPLE_HELD).select("h").toArrow().column("h").to_numpy()
    return np.sort(found.view(np.uint64))


def _emit_keys(docs: DataFrame, n: int, law: Law, buckets: int) -> DataFrame:
    """Packed rows: the sets' sizes and fingerprints, the links within a slice, and for each bucket of keys who holds them."""
    shipped = docs.sparkSession.sparkContext.broadcast(_frequent(docs, n))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        last = shipped.value
        for whole in batches:
            for batch in slices(whole, "text", 4 << 20):
                ids = batch.column("key").to_numpy(zero_copy_only=False).astype(np.int64)
                sets = shingle_sets(texts(batch.column("text")), n)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), ">u8").reshape(-1, 2).astype(np.uint64)
                sizes = np.array([len(s) for s in sets], np.int64)
                rows = [_packed(int(ids[0] % buckets) if len(ids) else 0, nodes=ids, sizes=sizes, hi=prints[:, 0], lo=prints[:, 1])]
                _, first = np.unique(prints, axis=0, return_index=True)
                keys, owner = [], []
                for i in sorted(first.tolist()):
                    s = sets[i]
                    if len(s):
                        late = np.zeros(len(s), bool)
                        if len(last):
                            at = np.minimum(np.searchsorted(last, s), len(last) - 1)
                            late = last[at] == s
                        found = law.run_keys(np.concatenate([s[~late], s[late]]) if late.any() else s)
                        keys.append(found)
                        owner.append(np.full(len(found), i))
                if keys:
                    key, own = np.concatenate(keys), np.concatenate(owner)
                    a, b = chains(key, sizes[own], ids[own], law)
                    if len(a):
                        a, b = _star(a, b)
                        rows.append(_packed(int(ids[-1] % buckets), keys=a, nodes=b))
                        kept = thin(key, sizes[own], ids[own], law)
                        key, own = key[kept], own[kept]
                    bucket = (key % np.uint64(buckets)).astype(np.int64)
                    by = np.argsort(bucket, kind="stable")
                    key, own, bucket = key[by], own[by], bucket[by]
                    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
                    for p in np.flatnonzero(np.diff(cuts)).tolist():
                        part, holders = key[cuts[p] : cuts[p + 1]], own[cuts[p] : cuts[p + 1]]
                        there, local = np.unique(holders, return_inverse=True)
                        entry = (part >> np.uint64(16) << np.uint64(16)) | local.astype(np.uint64)
                        rows.append(_packed(p, keys=entry, nodes=ids[there], sizes=sizes[there]))
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED_ARROW)

    return docs.mapInArrow(kernel, _PACKED)


def _star(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, low = smallest_reachable(a, b)
    return nodes[nodes != low], low[nodes != low]


def _meet(law: Law, buckets: int):
    """Pass sets' sizes on, and chain the holders of each key of a partition; the links come out packed, by the bucket of their smaller node."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for r in (r for at in range(batch.num_rows) for r in batch.slice(at, 1).to_pylist()):
                nodes = np.frombuffer(r["nodes"], np.int64)
                if r["hi"] is not None:
                    yield pa.RecordBatch.from_pylist([r], schema=_PACKED_ARROW)
                elif r["sizes"] is None:
                    links.append((np.frombuffer(r["keys"], np.int64), nodes))
                else:
                    held.append((np.frombuffer(r["keys"], np.uint64), np.frombuffer(r["sizes"], np.int64), nodes))
        # A part of the key space at a time, so that a partition needs little more memory than its packed rows.
        parts = max(1, sum(len(e) for e, *_ in held) // MEET_KEYS)
        for part in range(parts if held else 0):
            own = []
            for entry, sizes, nodes in held:
                local = (entry & np.uint64(0xFFFF)).astype(np.int64)
                key = entry >> np.uint64(16)
                here = slice(None) if parts == 1 else np.flatnonzero(key % np.uint64(parts) == part)
                own.append((key[here], sizes[local[here]], nodes[local[here]]))
            links.append(chains(*(np.concatenate(x) for x in zip(*own)), law))
            links = [_star(*(np.concatenate(x) for x in zip(*links)))]
        if links:
            a, b = _star(*(np.concatenate(x) for x in zip(*links)))
            bucket = (mix(b.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
            by = np.argsort(bucket, kind="stable")
            a, b, cuts = a[by], b[by], np.searchsorted(bucket[by], np.arange(buckets + 1))
            rows = [_packed(p, keys=a[cuts[p] : cuts[p + 1]], nodes=b[cuts[p] : cuts[p + 1]]) for p in np.flatnonzero(np.diff(cuts)).tolist()]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_PACKED_ARROW)

    return kernel


def _unpack_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r[c], np.int64)) for c in ("nodes", "sizes", "hi", "lo")], names=["key", "n", "hi", "lo"])


def _unpack_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that met in a bucket, contracted; after each batch, so that repeats don't pile up."""
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        got = [(np.frombuffer(r["keys"], np.int64), np.frombuffer(r["nodes"], np.int64)) for r in batch.to_pylist()]
        a, b = _star(*(np.concatenate(x) for x in zip((a, b), *got)))
    if len(a):
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


class RTree:
    """Points in leaves of LEAF, leaves in nodes of FAN; each box is held by its upper corner and its range of set sizes."""

    def __init__(self, sets: list[np.ndarray], law: Law):
        self.law = law
        sizes = np.array([len(s) for s in sets], np.int64)
        groups = 1 << int(np.clip(np.ceil(np.log2(max(1, np.median(sizes)) / 8)), 4, 8))
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        counts = np.bincount(owner * groups + (flat % np.uint64(groups)).astype(np.int64), minlength=len(sets) * groups).reshape(-1, groups)
        # Tiles: slabs by size, then by the fullest coordinate's count.
        slab = np.argsort(np.argsort(sizes, kind="stable"), kind="stable") // (LEAF * FAN)
        self.by = np.lexsort((counts[:, 0], slab))
        self.sizes, self.counts = sizes[self.by], counts[self.by].astype(np.int32)
        self.leaf = self._boxes(self.counts, self.sizes, self.sizes, LEAF)
        self.node = self._boxes(*self.leaf, FAN)

    @staticmethod
    def _boxes(upper: np.ndarray, low: np.ndarray, high: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.arange(0, len(low), size)
        return np.maximum.reduceat(upper, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)

    def _may_link(self, corner: np.ndarray, low: int, high: int, boxes: tuple[np.ndarray, np.ndarray, np.ndarray], among: np.ndarray) -> np.ndarray:
        upper, lows, highs = (x[among] for x in boxes)
        shared = np.minimum(upper, corner).sum(axis=1)
        return among[(shared >= self.law.overlap_needed(low, lows)) & self.law.sizes_fit(high, lows) & self.law.sizes_fit(highs, low)]

    def candidates(self) -> Iterator[tuple[int, np.ndarray]]:
        """(position, later positions whose counts allow a link), by leaf; positions are in the tree's order."""
        n, (upper, lows, highs) = len(self.sizes), self.leaf
        for i in range(len(lows)):
            corner, low, high = upper[i], int(lows[i]), int(highs[i])
            nodes = self._may_link(corner, low, high, self.node, np.arange(i // FAN, len(self.node[1])))
            leaves = (nodes[:, None] * FAN + np.arange(FAN)).ravel()
            leaves = self._may_link(corner, low, high, self.leaf, leaves[(leaves >= i) & (leaves < len(lows))])
            points = (leaves[:, None] * LEAF + np.arange(LEAF)).ravel()
            points = points[points < n]
            if len(points):
                for x in range(i * LEAF, min(n, (i + 1) * LEAF)):
                    later = points[points > x]
                    a, b = self.sizes[x], self.sizes[later]
                    later = later[self.law.sizes_fit(np.minimum(a, b), np.maximum(a, b))]
                    shared = np.minimum(self.counts[later], self.counts[x]).sum(axis=1)
                    yield x, later[shared >= self.law.overlap_needed(a, self.sizes[later])]


def linked(sets: list[np.ndarray], law: Law, side: np.ndarray | None = None, label: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that connect what the sets' links connect. side: only links between different sides are sought; label: sets of one label are connected."""
    label = np.arange(len(sets)) if label is None else label.copy()
    if len(sets) < 2 or (label == label[0]).all():
        return []
    tree = RTree(sets, law)
    order, out = tree.by, []
    values, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum([0, *map(len, sets)])
    held = np.zeros(len(values), bool)
    for x, later in tree.candidates():
        i = int(order[x])
        others = order[later]
        others = others[label[others] != label[i]]
        if side is not None:
            others = others[side[others] != side[i]]
        if not len(others):
            continue
        own = flat[ends[i] : ends[i + 1]]
        held[own] = True
        lengths = ends[others + 1] - ends[others]
        at = np.repeat(ends[others] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        shared = np.add.reduceat(held[flat[at]].astype(np.int64), np.cumsum(lengths) - lengths)
        held[own] = False
        for j in others[100 * shared >= law.percent * (lengths + len(own) - shared)].tolist():
            if label[j] != label[i]:
                out.append((i, j))
                label[label == label[j]] = label[i]
    return out


def _verify(law: Law):
    """Links of each cell; rows come in order of cell."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        held: list[tuple[int, int, int, bytes]] = []
        now = None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = list({(row[0], row[3]): row for row in held}.values())
            if len(rows) > 1:
                side, label = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
                links = linked([np.frombuffer(r[3], np.uint64) for r in rows], law, side if side.any() else None, label)
                if links:
                    a, b = zip(*((rows[i][0], rows[j][0]) for i, j in links))
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                for r in whole.slice(at, 128).to_pylist():
                    cell = (r["family"], r["left"], r["right"])
                    if cell != now:
                        yield from flush()
                        held, now = [], cell
                    held.append((r["node"], int(r["left"] != r["right"] and r["block"] == r["right"]), r["label"], r["set"]))
        yield from flush()

    return kernel


def join(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_shingles, component_id) for each row."""
    law, spark = Law(percent), docs.sparkSession
    kind = docs.schema[key].dataType
    if not isinstance(kind, T.IntegralType):
        names = numbered(docs, key).withColumnRenamed(key, "__name")
        found = join(docs.select(F.col(key).alias("__id"), F.col(text).alias("text")).join(names, F.col("__id") == F.col("__name"), "left").select("number", "text"), n, percent, "number", "text")
        of = lambda number, name: names.select(F.col("number").alias(number), F.col("__name").alias(name))
        return found.join(of("number", key), "number", "left").join(of("component_id", "__component"), "component_id", "left").select(key, "n_shingles", F.col("__component").alias("component_id"))
    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    bounded(spark)
    named = rows.where("key is not null")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = materialize(_emit_keys(named, n, law, buckets).repartitionById(buckets, "bucket").mapInArrow(_meet(law, buckets), _PACKED), "sets-and-links")
    sets = met.where("hi is not null").select("nodes", "sizes", "hi", "lo").mapInArrow(_unpack_sets, "key long, n long, hi long, lo long")
    links = met.where("hi is null").select("bucket", "keys", "nodes").repartitionById(buckets, "bucket").mapInArrow(_unpack_links, "a long, b long")

    # Classes of equal sets; what follows is between their representatives. Copies are salted.
    classes = sets.where("n > 0").groupBy("hi", "lo").agg(F.min("key").alias("rep"), F.min("n").alias("n"))
    classes = materialize(classes, "classes", narrow=True)
    fingerprint = F.struct("hi", "lo").alias("print")
    member = salted_left_join(sets.withColumn("print", fingerprint), classes.select(fingerprint, "rep"), "print", F.col("key"))
    member = materialize(member.select("key", "n", "rep"), "members", narrow=True)
    rep_of = member.where("rep is not null").select("key", "rep").distinct()
    # Copies share all keys, so the chains put a class into one family; families of one class are done.
    family = components(links).join(rep_of.withColumnRenamed("key", "node"), "node").select(F.col("rep").alias("node"), "component").distinct()
    family = materialize(family, "families", narrow=True)

    inside = family.join(classes, family["node"] == classes["rep"]).select("node", F.col("component").alias("family"), "hi", "lo", "n")
    blocks = inside.groupBy("family").agg(F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"), F.count("*").alias("classes"))
    blocks = blocks.where("classes > 1").drop("classes")
    inside = materialize(inside.join(blocks, "family").select("node", "family", "blocks", "hi", "lo"), "inside", narrow=True)

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("jaccard")
        names = ["family", "blocks", "node", "set"]
        for whole in batches:
            for batch in slices(whole, "text"):
                found = shingle_sets(texts(batch.column("text")), n)
                prints = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in found), ">u8").reshape(-1, 2).astype(np.uint64).view(np.int64)
                same = (prints[:, 0] == batch.column("hi").to_numpy()) & (prints[:, 1] == batch.column("lo").to_numpy())
                out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:-1]), pa.array([s.tobytes() for s in found], pa.binary())], names=names)
                yield out.filter(pa.array(same))

    wanted = named.join(sized(inside, 64), named["key"] == F.col("node")).select("family", "blocks", "node", "hi", "lo", "text")
    held = materialize(wanted.mapInArrow(resolve, "family long, blocks int, node long, set binary"), "family-sets")
    block = F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")).cast("int")

    def search(cells: DataFrame) -> DataFrame:
        """Links found in cells: rows (family, left, right, block, node, label, set)."""
        order = ["family", "left", "right"]
        found = spread(cells, *order).sortWithinPartitions(*order).mapInArrow(_verify(law), "a long, b long")
        return materialize(found, "verified", narrow=True)

    verified = search(held.select("family", block.alias("left"), block.alias("right"), block.alias("block"), "node", F.col("node").alias("label"), "set"))
    wide = held.where("blocks > 1").select("family", "node").distinct()
    if not inside.where("blocks > 1").isEmpty():
        def labels() -> DataFrame:
            """(family, node, label) of families that aren't one component yet."""
            own = wide.join(components(verified), "node", "left").select("family", "node", F.coalesce("component", "node").alias("label"))
            still = own.groupBy("family").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("family")
            return materialize(own.join(still, "family"), "labels", narrow=True)

        def labelled(own: DataFrame) -> DataFrame:
            return held.withColumn("block", block).join(sized(own, 64), ["family", "node"])

        # A component's smallest set stands for it; they are searched in blocks of their own, by a hash that deals them anew.
        now = labels()
        first = now.where("node = label")
        dealt = first.join(first.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_SETS).cast("int").alias("parts")), "family")
        dealt = dealt.select("family", "node", "label", F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part"))
        cells = labelled(dealt).select("family", F.col("part").alias("left"), F.col("part").alias("right"), F.col("part").alias("block"), "node", "label", "set")
        verified = verified.unionByName(search(cells))
        now = labels()
        if not now.isEmpty():
            other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
            cells = labelled(now).withColumn("other", other).where("block <> other")
            verified = verified.unionByName(search(cells.select("family", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "node", "label", "set")))
    # Rows that repeat an id are one document.
    repeats = rep_of.join(rep_of.groupBy("key").count().where("count > 1").select("key"), "key").select(F.col("key").alias("a"), F.col("rep").alias("b"))
    whole = components(verified.unionByName(repeats))
    # A class of some documents is a component too, if nothing else links it.
    named_out = member.join(whole.withColumnRenamed("node", "rep"), "rep", "left")
    out = named_out.select(F.col("key").cast(kind).alias(key), F.col("n").alias("n_shingles"), F.coalesce("component", "rep", "key").alias("component_id"))

    def count_only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole_batch in batches:
            for batch in slices(whole_batch, "text"):
                yield pa.RecordBatch.from_arrays([pa.array([len(s) for s in shingle_sets(texts(batch.column("text")), n)], pa.int64())], names=["n_shingles"])

    unnamed = rows.where("key is null").select("text").mapInArrow(count_only, "n_shingles long")
    return out.unionByName(unnamed.select(F.lit(None).cast(kind).alias(key), "n_shingles", F.lit(None).cast("long").alias("component_id")))


def keep_one(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without those that a smaller id represents; rows with a null id are kept."""
    found = join(docs, n, percent, key, text)
    gone = materialize(found.where(F.col(key) != F.col("component_id")).select(F.col(key).alias("__gone")).distinct(), "gone", narrow=True)
    return docs.join(sized(gone, 64), F.col(key) == F.col("__gone"), "left_anti")
