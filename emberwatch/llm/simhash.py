"""SimHash near-duplicates through an inverted index on the fingerprint's bytes by position, with count filtering."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.base import components, sorted_runs, words_of
from emberwatch.session import checkpointed

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 3
BYTES = 8
#: Fingerprints that differ in MAX_BITS bits differ in no more bytes, so at least this many bytes agree in place.
MIN_SHARED = BYTES - MAX_BITS
#: Posting lists over this many fingerprints are cut by further positions, until at most as many remain.
LIST_ROWS = 4096


def fingerprint(text: str | None) -> int:
    """64-bit SimHash of a whole text: a bit is set if over half of the shingle hashes have it; 0 without words."""
    words = words_of(text)
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [tuple(words)]
    else:
        shingles = zip(*(words[i:] for i in range(SHINGLE_WORDS)))
    hashes = np.array([xxhash.xxh64_intdigest(b" ".join(s), HASH_SEED) for s in shingles], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].view(np.uint8).reshape(-1, BYTES), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint_column():
    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64))

    return fp


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row, fp as a signed long; other columns are left behind."""
    return docs.select("doc_id", fingerprint_column()("text").alias("fp"))


@lru_cache
def position_sets(width: int) -> list[tuple[int, ...]]:
    """Sets of `width` byte positions such that any MIN_SHARED agreeing positions contain one of them (greedy cover)."""
    open_ = {frozenset(c) for c in combinations(range(BYTES), MIN_SHARED)}
    chosen = []
    while open_:
        best = max(combinations(range(BYTES), width), key=lambda s: sum(o.issuperset(s) for o in open_))
        chosen.append(best)
        open_ = {o for o in open_ if not o.issuperset(best)}
    return chosen


def index_width(n: int) -> int:
    """Bytes per posting key at which `n` spread-out fingerprints meet by chance less than about once each."""
    return next((w for w in (3, 4) if n * len(position_sets(w)) < 2 << (8 * w)), MIN_SHARED)


def linked(pivot: np.uint64, others: np.ndarray) -> np.ndarray:
    """Which of `others` are within MAX_BITS of `pivot`: first by the tally of agreeing bytes, then bit by bit."""
    diff = pivot ^ others
    bytes_ = diff.view(np.uint8).reshape(-1, BYTES)
    close = np.flatnonzero((bytes_ == 0).sum(axis=1, dtype=np.int8) >= MIN_SHARED)
    return close[np.bitwise_count(diff[close]) <= MAX_BITS]


def spanning_links(fps: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(root, members) of the linked groups of one posting list, by search over what no group has taken yet."""
    open_ = np.ascontiguousarray(fps)
    while len(open_) > 1:
        root, open_ = open_[0], open_[1:]
        group, frontier = [], [root]
        while frontier and len(open_):
            hit = linked(frontier.pop(), open_)
            if len(hit):
                found = open_[hit]
                open_ = np.delete(open_, hit)
                group.append(found)
                frontier.extend(found)
        if group:
            yield root, np.concatenate(group)


def posting_links(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for fps in sorted_runs(frames, ["slot", "posting"], "fp"):
        for root, members in spanning_links(fps.astype(np.int64).view(np.uint64)):
            yield pd.DataFrame({"a": np.full(len(members), root).view(np.int64), "b": members.view(np.int64)})


def byte_mask(positions: Iterable[int]) -> int:
    return sum(255 << 8 * p for p in positions)


def signed(masks: Iterable[int]) -> Column:
    return F.array(*[F.lit(int(np.uint64(m).view(np.int64))) for m in masks])


def deeper_bytes(mask: int) -> list[int]:
    """`mask` with every choice of further bytes that makes MIN_SHARED: a pair in reach agrees in one of them."""
    held = [p for p in range(BYTES) if mask >> 8 * p & 1]
    free = [p for p in range(BYTES) if p not in held]
    return [mask | byte_mask(more) for more in combinations(free, MIN_SHARED - len(held))]


def deeper_halves(mask: int) -> list[int]:
    """`mask` of MIN_SHARED bytes with three of the six half bytes left: MAX_BITS bits differ in no more than three.

    12 bits stay free, so a list holds LIST_ROWS distinct fingerprints at most.
    """
    free = [h for h in range(2 * BYTES) if not mask >> 4 * h & 1]
    return [mask | sum(15 << 4 * h for h in more) for more in combinations(free, len(free) - MAX_BITS)]


def cut_lists(rows: DataFrame, deeper: dict[int, list[int]]) -> tuple[DataFrame, DataFrame]:
    """The rows of lists up to LIST_ROWS as they are, and those of longer lists under each of the masks in `deeper`."""
    keys = ["slot", "posting"]
    long = checkpointed(rows.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > LIST_ROWS).select(*keys))
    further = F.create_map(*[x for mask, masks in deeper.items() for x in (signed([mask])[0], signed(masks))])
    cut = rows.join(long, keys, "left_semi").select("fp", F.explode(further[F.col("slot")]).alias("slot"))
    cut = cut.select("slot", F.col("fp").bitwiseAND(F.col("slot")).alias("posting"), "fp").distinct()
    return rows.join(long, keys, "left_anti"), cut


def fingerprint_links(distinct: DataFrame, width: int) -> DataFrame:
    """Edges (a, b) that connect the distinct `fp`s within MAX_BITS of each other, a forest per posting list.

    A posting is a mask of byte positions and the fingerprint's bytes there; every pair in reach shares one. A list over
    LIST_ROWS is cut by further bytes, then by half bytes, in such a way that each pair in reach still shares a list.
    Lists are walked in sorted order, and a list yields fewer edges than it has fingerprints, however dense it is.
    """
    masks = [byte_mask(s) for s in position_sets(width)]
    rows = distinct.select("fp", F.explode(signed(masks)).alias("slot")).select(
        "slot", F.col("fp").bitwiseAND(F.col("slot")).alias("posting"), "fp")
    whole = [byte_mask(s) for s in combinations(range(BYTES), MIN_SHARED)]
    if width < MIN_SHARED:
        lists, rows = cut_lists(rows, {m: deeper_bytes(m) for m in masks})
        more, rows = cut_lists(rows, {m: deeper_halves(m) for m in whole})
        rows = lists.unionByName(more).unionByName(rows)
    else:
        lists, rows = cut_lists(rows, {m: deeper_halves(m) for m in whole})
        rows = lists.unionByName(rows)
    return rows.repartition("slot", "posting").sortWithinPartitions("slot", "posting").mapInPandas(
        posting_links, "a long, b long")


def simhash_groups(docs: DataFrame, width: int | None = None) -> DataFrame:
    """doc_id, fp, fingerprint (16 hex digits), component_id: the smallest doc_id reachable over links.

    One row per input row. Copies share a fingerprint and are reduced to it before anything is compared. A null or
    empty text has fingerprint 0 and is linked like any other; a null doc_id keeps its row and never names a component
    (null where a component has no other). Repeated rows are repeated; columns besides doc_id and text are ignored.
    `width` (bytes per posting key) only changes the plan: every choice finds all links.
    """
    return grouped(docs, width).select(
        "doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def grouped(docs: DataFrame, width: int | None = None) -> DataFrame:
    """(doc_id, fp, root, component_id) for every row; a group's root is its smallest fingerprint."""
    fps = checkpointed(fingerprints(docs))
    distinct = fps.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    width = width or index_width(distinct.count())
    roots = components(fingerprint_links(distinct.select("fp"), width))
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp"))
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return fps.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """The rows of `docs` (same columns) that stand for their group: the one with its smallest doc_id, once.

    A row without a doc_id stays only where its group has no other, again once. A doc_id with unrelated texts stands for
    each of their groups. No rows in, no rows out; a text of any length is hashed whole.
    """
    groups = checkpointed(grouped(docs))
    heads = groups.filter("doc_id = component_id").groupBy("root", "doc_id").agg(F.min("fp").alias("__fp"))
    rows = groups.groupBy("doc_id").agg(F.count("*").alias("__rows"))
    heads = checkpointed(heads.join(rows, "doc_id").select("doc_id", "__fp", "__rows"))
    kept = docs.join(heads.filter("__rows = 1").select("doc_id"), "doc_id", "left_semi").select(*docs.columns)
    # A doc_id of several rows may stand for unrelated texts, each the head of a group: there the fingerprint tells.
    several = heads.filter("__rows > 1").select("doc_id", "__fp")
    repeated = docs.join(several.select("doc_id").distinct(), "doc_id", "left_semi").withColumn("__fp", fingerprint_column()("text"))
    repeated = repeated.join(several, ["doc_id", "__fp"], "left_semi").dropDuplicates(["doc_id", "__fp"])
    kept = kept.unionByName(repeated.select(*docs.columns))
    orphans = groups.filter("component_id is null")
    if orphans.isEmpty():
        return kept.select(*docs.columns)
    nameless = docs.filter("doc_id is null")
    ids = checkpointed(components_without_id(orphans.select("fp").distinct()))
    nameless = nameless.withColumn("__fp", fingerprint_column()("text"))
    nameless = nameless.join(ids.withColumnsRenamed({"fp": "__fp", "root": "__root"}), "__fp").dropDuplicates(["__root"])
    return kept.select(*docs.columns).unionByName(nameless.select(*docs.columns))


def components_without_id(distinct: DataFrame) -> DataFrame:
    """(fp, root) over the fingerprints whose whole groups have no doc_id."""
    roots = components(fingerprint_links(distinct, index_width(distinct.count())))
    return distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", F.coalesce("root", "fp").alias("root"))
