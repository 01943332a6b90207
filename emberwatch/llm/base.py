"""Shared pieces of the text operators: reading a table's columns by kind, words, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

HELD_OUT_BY = "crc32(cast(doc_id as string))"


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but the six ASCII blanks, A-Z lower-cased; a null text has none."""
    return text.encode().lower().split() if text else []


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable over the undirected `edges` (a, b), for every node of an edge.

    Alternating large-star and small-star rounds, each written to the checkpoint folder. A hub's neighbours are reduced
    to their minimum before the shuffle, and no round makes more rows than two per edge.
    """
    edges = checkpointed(edges.filter("a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).selectExpr("a", "least(a, low) as low")
        large = both.join(low, "a").filter("b > a and b <> low").selectExpr("b as a", "low as b").distinct()
        large = large.unionByName(low.filter("low < a").select("a", F.col("low").alias("b"))).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = checkpointed(small.unionByName(low.select("a", F.col("low").alias("b"))).distinct())
        # A set of edges is known by its size and its sums; stars on their minima do not change any more.
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def sorted_runs(frames: Iterable, keys: list[str], value: str) -> Iterator[np.ndarray]:
    """The values of each run of equal `keys` with at least two rows, from batches that are sorted by them."""
    kept_keys, kept = None, None
    for frame in frames:
        k = np.stack([frame[c].to_numpy(np.int64) for c in keys])
        v = frame[value].to_numpy()
        if kept is not None:
            k, v = np.concatenate([kept_keys, k], axis=1), np.concatenate([kept, v])
        cuts = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        bounds = np.concatenate([[0], cuts, [len(v)]])
        for i in np.flatnonzero(np.diff(bounds[:-1]) > 1):
            yield v[bounds[i]:bounds[i + 1]]
        kept_keys, kept = k[:, bounds[-2]:], v[bounds[-2]:]
    if kept is not None and len(kept) > 1:
        yield kept
