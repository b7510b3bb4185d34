"""Benchmark decontamination by greedy string tiling.

Texts and benchmark items become sequences of words (runs of letters and digits, lower-cased). A document and an item that share a run of
`min_match` words, found by joining rolling hashes of such runs, are compared: the longest matches that don't overlap are marked again and again,
down to `min_match` words, with Karp-Rabin hashes of all windows of the length searched. Marked parts may stand in any order, so a passage is caught
when its sentences were moved. The share of an item's words that are marked is its coverage; from `threshold` on, the document is contaminated.

A benchmark of up to `CHUNK_BYTES` is broadcast, and the documents are read once. A larger one is joined instead: a bitmap of its runs, of 32 MB at most, goes to
the documents, whose runs that may be in it are dealt by hash, with salts, and meet the items' runs. A text that shares runs with an item consists, for tiling,
of these runs, whose words the item has; so places are all that moves, no text does. Equal texts are one until their documents are named.

Defined results: null and empty texts match nothing; items with fewer than `min_match` words take no part; documents and items that repeat
give a row for each pair of rows; a null id is returned as null; an empty table gives an empty table. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import begin, bounded, count_bytes, materialize, salted_left_join, sized, slices, texts

MIN_MATCH, THRESHOLD, CHUNK_BYTES, FIRST_LENGTH = 5, 0.5, 4 << 20, 16
#: Bits of the bitmap that larger benchmarks send out (a power of 2), and of a piece of it.
BITMAP_BITS, PIECE_BITS = 28, 16
_WORD = re.compile(r"[^\W_]+")
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class _Rolling:
    """Karp-Rabin hashes of any window of a sequence, from running prefix hashes."""

    def __init__(self, tokens: list[int], powers: list[int]):
        self.prefix, self.powers = [0], powers
        for x in tokens:
            self.prefix.append((self.prefix[-1] * _BASE + x) % _PRIME)

    def window(self, start: int, length: int) -> int:
        return (self.prefix[start + length] - self.prefix[start] * self.powers[length]) % _PRIME


def _open_windows(marked: list[bool], length: int) -> Iterator[int]:
    """Starts of windows of a length without a marked token."""
    run = 0
    for i, m in enumerate(marked):
        run = 0 if m else run + 1
        if run >= length:
            yield i - length + 1


def tile(item: list[int], text: list[int], min_match: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of each tile. Negative tokens of `text` match nothing."""
    longest = min(len(item), len(text))
    if longest < min_match:
        return []
    powers = [1]
    for _ in range(longest):
        powers.append(powers[-1] * _BASE % _PRIME)
    of_item, of_text = _Rolling(item, powers), _Rolling(text, powers)
    item_marked, text_marked, tiles = [False] * len(item), [x < 0 for x in text], []
    length = max(min_match, min(FIRST_LENGTH, longest))
    while True:
        table: dict[int, list[int]] = defaultdict(list)
        for t in _open_windows(text_marked, length):
            table[of_text.window(t, length)].append(t)
        matches, best = [], 0
        for p in _open_windows(item_marked, length):
            room = length
            while p + room < len(item) and not item_marked[p + room]:
                room += 1
            top = (0, 0)
            for t in table.get(of_item.window(p, length), ()):
                n = 0
                while n < room and t + n < len(text) and not text_marked[t + n] and item[p + n] == text[t + n]:
                    n += 1
                top = max(top, (n, -t))
                if n == room:
                    break
            if top[0] >= length:
                matches.append((top[0], p, -top[1]))
                best = max(best, top[0])
        if best > 2 * length:
            length = best  # longest matches first
            continue
        placed = False
        for n, p, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(item_marked[p : p + n]) and not any(text_marked[t : t + n]):
                item_marked[p : p + n] = [True] * n
                text_marked[t : t + n] = [True] * n
                tiles.append((p, t, n))
                placed = True
        if placed:
            continue  # what was partly covered may still hold a match of this length
        if length == min_match:
            return tiles
        length = max(min_match, length // 2)


class Items:
    """A chunk of the benchmark: its vocabulary, the words of its items, and which items hold a run of `min_match` words."""

    def __init__(self, rows: list[tuple[object, str]], min_match: int):
        self.min_match, self.vocabulary = min_match, {}
        self.ids, self.tokens = [], []
        self.seeds: dict[int, list[int]] = defaultdict(list)
        for item_id, text in rows:
            found = words(text or "")
            if len(found) < min_match:
                continue
            own = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in found]
            for h in set(self._runs(np.array(own, np.int64)).tolist()):
                self.seeds[h].append(len(self.ids))
            self.ids.append(item_id)
            self.tokens.append(own)
        self.sorted = np.sort(np.fromiter(self.seeds, np.uint64, len(self.seeds)))

    def _runs(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.min_match + 1
        value = np.zeros(max(n, 0), np.uint64)
        for i in range(self.min_match if n > 0 else 0):
            value = value * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n].astype(np.uint64) + np.uint64(1)
        return value

    def find(self, batch: list[str]) -> list[list[tuple[int, int, int]]]:
        """For each text: (item number, tiles, matched words) of each item that shares a run."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in batch]
        split = [words(t) for t in batch]
        lengths = np.array([len(w) for w in split], np.int64)
        flat = np.fromiter((x for w in split for x in map(self.vocabulary.get, w, repeat(-1))), np.int64, int(lengths.sum()))
        if len(flat) < self.min_match or not len(self.sorted):
            return out
        value = self._runs(flat)
        # Only runs wholly of the items' words, and within one text.
        known = np.cumsum(np.concatenate([[0], flat >= 0]))
        end = np.cumsum(lengths)
        doc = np.repeat(np.arange(len(batch)), lengths)[: len(value)]
        start = np.arange(len(value))
        fits = (known[start + self.min_match] - known[start] == self.min_match) & (start + self.min_match <= end[doc])
        start = start[fits]
        at = np.minimum(np.searchsorted(self.sorted, value[start]), len(self.sorted) - 1)
        start = start[self.sorted[at] == value[start]]
        hits: dict[tuple[int, int], list[int]] = defaultdict(list)
        for s in start.tolist():
            for item in self.seeds[int(value[s])]:
                hits[int(doc[s]), item].append(s)
        for (d, item), places in hits.items():
            parts = stretches(lambda a, b: flat[a:b].tolist(), places, len(self.tokens[item]), self.min_match)
            tiles = tile(self.tokens[item], parts, self.min_match)
            if tiles:
                out[d].append((item, len(tiles), sum(n for _, _, n in tiles)))
        return out


def stretches(read: Callable[[int, int], list[int]], places: list[int], size: int, min_match: int) -> list[int]:
    """The parts of a text that runs shared with an item of `size` words cover, apart from each other; as many of equal parts as the item could use.
    places: where the runs start, ascending; read: the words between two places."""
    spans: list[list[int]] = []
    for s in places:
        if spans and s <= spans[-1][1]:
            spans[-1][1] = s + min_match
        else:
            spans.append([s, s + min_match])
    most, seen, out = size // min_match, defaultdict(int), []
    for a, b in spans:
        part = tuple(read(a, b))
        seen[part] += 1
        if seen[part] <= most:
            out += [*part, -1]
    return out


class _WordHashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = out = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return out


def run_hashes(batch: list[str], min_match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, a second hash, text number, place) of each run of `min_match` words within a text."""
    split, known = [words(t) for t in batch], _WordHashes()
    lengths = np.array([len(w) for w in split], np.int64)
    flat = np.fromiter((known[w] for own in split for w in own), np.uint64, int(lengths.sum()))
    end = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(split)), lengths)
    start = np.flatnonzero(np.arange(len(flat)) + min_match <= end[doc])
    first, second = np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint64)
    for i in range(min_match):
        word = flat[start + i]
        first = first * np.uint64(0x9E3779B97F4A7C15) + word
        second = (second ^ (word >> np.uint64(29)) ^ word) * np.uint64(0xC2B2AE3D27D4EB4F)
    return first, second, doc[start], start - (end - lengths)[doc[start]]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _item_runs(items: DataFrame, min_match: int) -> DataFrame:
    """(hash, second, number, at): each distinct run of an item, and where the item has it first."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tiling")
        for whole in batches:
            for batch in slices(whole, "text"):
                first, second, doc, at = run_hashes([t.decode("utf-8", "replace") for t in texts(batch.column("text"))], min_match)
                _, own = np.unique(np.stack([doc.astype(np.uint64), first, second]), axis=1, return_index=True)
                yield pa.RecordBatch.from_arrays([_signed(first[own]), _signed(second[own]), batch.column("number").take(pa.array(doc[own])), pa.array(at[own].astype(np.int32))], names=["hash", "second", "number", "at"])

    return items.select("number", "text").mapInArrow(kernel, "hash long, second long, number long, at int")


def _bitmap(runs: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, bitmap): which leading bits some run's hash has. Packed in pieces where the runs lie, so that the driver gets no more than the bitmap."""
    bits = int(np.clip(int(16 * runs.count()).bit_length(), PIECE_BITS, BITMAP_BITS))
    at = F.shiftrightunsigned("hash", 64 - bits)

    def pack(rows: pa.Table) -> pa.Table:
        bit = rows.column("bit").to_numpy()
        held = np.zeros(1 << PIECE_BITS, bool)
        held[bit & ((1 << PIECE_BITS) - 1)] = True
        return pa.table({"piece": pa.array([bit[0] >> PIECE_BITS], pa.int64()), "held": pa.array([np.packbits(held, bitorder="little").tobytes()], pa.binary())})

    found = runs.select(at.alias("bit")).distinct().groupBy(F.shiftright("bit", PIECE_BITS)).applyInArrow(pack, "piece long, held binary").toArrow()
    out = np.zeros((1 << (bits - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8)
    for piece, held in zip(found.column("piece").to_pylist(), found.column("held").to_pylist()):
        out[piece] = np.frombuffer(held, np.uint8)
    return bits, out.ravel()


def _find_by_join(docs: DataFrame, items: DataFrame, min_match: int, threshold: float, schema: T.StructType) -> DataFrame:
    """docs: key, text; items: id, text. One reading of the documents for their runs and one for their names, whatever the size of the benchmark."""
    items = materialize(items.withColumn("number", F.monotonically_increasing_id()), "items")
    runs = materialize(_item_runs(items, min_match), "item-runs")
    shipped = docs.sparkSession.sparkContext.broadcast(_bitmap(runs))
    docs = docs.withColumn("print", F.unhex(F.sha2("text", 256)))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tiling")
        bits, bitmap = shipped.value
        for whole in batches:
            for batch in slices(whole, "text"):
                first, second, doc, at = run_hashes([t.decode("utf-8", "replace") for t in texts(batch.column("text"))], min_match)
                bit = (first >> np.uint64(64 - bits)).astype(np.int64)
                on = np.flatnonzero(bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1)
                yield pa.RecordBatch.from_arrays([batch.column("print").take(pa.array(doc[on])), _signed(first[on]), _signed(second[on]), pa.array(at[on].astype(np.int32))], names=["print", "hash", "second", "place"])

    held = docs.select("print", "text").where("text is not null").mapInArrow(places, "print binary, hash long, second long, place int").distinct()
    met = salted_left_join(held, runs.withColumnRenamed("second", "same"), "hash", F.struct("print", "place")).where("second = same")
    # What a text and an item share is bounded by the text.
    pairs = met.groupBy("print", "number").agg(F.array_sort(F.collect_list(F.struct("place", "at"))).alias("shared"))
    pairs = salted_left_join(pairs, items.withColumnRenamed("text", "item_text"), "number", F.col("print"))
    names = ["print", "id", *schema.names[2:]]
    found_schema = T.StructType([T.StructField("print", T.BinaryType()), T.StructField("id", schema[1].dataType), *schema.fields[2:]])
    kinds = [pa.binary(), to_arrow_type(schema[1].dataType), pa.float64(), pa.int64(), pa.int64()]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tiling")
        for whole in batches:
            for at in range(0, whole.num_rows, 128):
                out = []
                for r in whole.slice(at, 128).to_pylist():
                    numbers: dict[str, int] = {}
                    item = [numbers.setdefault(w, len(numbers)) for w in words(r["item_text"])]
                    said = {s["place"] + i: item[s["at"] + i] for s in r["shared"] for i in range(min_match)}
                    parts = stretches(lambda a, b, said=said: [said[i] for i in range(a, b)], [s["place"] for s in r["shared"]], len(item), min_match)
                    tiles = tile(item, parts, min_match)
                    matched = sum(n for _, _, n in tiles)
                    if tiles and matched >= threshold * len(item):
                        out.append((r["print"], r["id"], matched / len(item), matched, len(tiles)))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)

    found = materialize(pairs.select("print", "shared", "id", "item_text").mapInArrow(measure, found_schema), "found", narrow=True)
    named = salted_left_join(docs.select("key", "print"), found, "print", F.col("key")).where("matched is not null")
    return named.select(F.col("key").alias(schema.names[0]), F.col("id").alias(schema.names[1]), *schema.names[2:])


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", min_match: int = MIN_MATCH, threshold: float = THRESHOLD) -> DataFrame:
    """(key, item, coverage, matched, tiles) of each pair whose coverage reaches the threshold."""
    spark, docs, benchmark = docs.sparkSession, docs.select(key, text), benchmark.select(item, "text")
    bounded(spark)
    schema = T.StructType([docs.schema[key], benchmark.schema[item], T.StructField("coverage", T.DoubleType()), T.StructField("matched", T.LongType()), T.StructField("tiles", T.LongType())])
    if count_bytes(benchmark, "text") > CHUNK_BYTES:
        return _find_by_join(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), benchmark.select(F.col(item).alias("id"), "text"), min_match, threshold, schema)
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    shipped = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in benchmark.collect()], min_match))

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tiling")
        items = shipped.value
        for whole in batches:
            for batch in slices(whole, text):
                found = items.find([t.decode("utf-8", "replace") for t in texts(batch.column(text))])
                flat = [(i, items.ids[k], m / len(items.tokens[k]), m, n) for i, own in enumerate(found) for k, n, m in own if m >= threshold * len(items.tokens[k])]
                if flat:
                    at, ids, coverage, matched, tiles = zip(*flat)
                    yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at)), pa.array(ids, item_type), pa.array(coverage, pa.float64()), pa.array(matched, pa.int64()), pa.array(tiles, pa.int64())], names=schema.names)

    return docs.mapInArrow(kernel, schema)


def clean(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents that no item contaminates; rows with a null id are kept."""
    leaks = materialize(find_leaks(docs, benchmark, key, text, **options).select(F.col(key).alias("__leak")).distinct(), "leaks", narrow=True)
    return docs.join(sized(leaks, 64), F.col(key) == F.col("__leak"), "left_anti")
