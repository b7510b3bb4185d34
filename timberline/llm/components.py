"""Connected components of a graph of links, by alternating large-star and small-star steps over written tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Links of up to so many rows are joined in one task.
ONE_TASK_LINKS = 200_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v, label = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(label[u], label[v])
        before = label.copy()
        np.minimum.at(label, label[u], low)
        np.minimum.at(label, label[v], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return nodes, nodes[label]


def star_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links, replaced by links from each node to the smallest one it reaches."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if held:
        nodes, low = smallest_reachable(np.concatenate([a for a, _ in held]), np.concatenate([b for _, b in held]))
        off = nodes != low
        yield pa.RecordBatch.from_arrays([pa.array(nodes[off]), pa.array(low[off])], names=["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links (a, b); component: the smallest node it reaches."""
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    links = materialize(links.mapInArrow(star_links, "a long, b long"), "links", narrow=True)
    rows = links.count()
    while rows > ONE_TASK_LINKS > 0:
        # Links to the same node meet, in tasks of bounded size; what they have in common falls away. A node of very many links is salted.
        met = links.repartition(rows // ONE_TASK_LINKS + 1, "b", F.pmod(F.xxhash64("a"), F.lit(8))).mapInArrow(star_links, "a long, b long")
        links, before = materialize(met, "links", narrow=True), rows
        rows = links.count()
        if rows > 0.7 * before:
            break
    if rows <= ONE_TASK_LINKS:
        links = links.coalesce(1).mapInArrow(star_links, "a long, b long")
        return _with_roots(links)
    state = None
    while True:
        # Large star: each node links its larger neighbours to the smallest node around it.
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialize(large, "large-star", narrow=True)
        # Small star: each node links its smaller neighbours, and itself, to the smallest.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        links = materialize(small.where("a <> b").distinct(), "small-star", narrow=True)
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == state:
            return _with_roots(links)
        state = now


def _with_roots(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
