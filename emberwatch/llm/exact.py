"""Exact dedup through an extendible-hash index kept as tables in the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

BLANKS = r"[\x20\x09-\x0D]+"
#: Bytes of text (and of row overhead) that a bucket holds before it is split.
BUCKET_BYTES = 64 << 20
ROW_BYTES = 64
#: The directory never exceeds 2^MAX_DEPTH pointers. Beyond it buckets grow; they are walked as a stream in any case.
MAX_DEPTH = 16
#: An overflow page has at least so many rows on average, and so few rows of one hash never overflow.
PAGE_ROWS = 8


def normalised(text: str = "text") -> Column:
    """Runs of the six ASCII blanks become one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


class Directory:
    """Pointers from hash prefixes to buckets. A bucket of local depth d owns the hashes with one d-bit prefix."""

    def __init__(self, loads: np.ndarray, capacity: int):
        """`loads`: bytes per prefix of full depth (a power of two of them). Starts as one bucket and splits what is
        overfull; a split at the global depth doubles the directory first."""
        self.full = len(loads).bit_length() - 1
        below = np.concatenate([[0], np.cumsum(loads)])
        self.depth, self.pointers = 0, [0]
        self.buckets = [(0, 0)]  # (local depth, prefix)
        overfull = [0]
        while overfull:
            bucket = overfull.pop()
            local, prefix = self.buckets[bucket]
            span = 1 << (self.full - local)
            if local == self.full or below[(prefix + 1) * span] - below[prefix * span] <= capacity:
                continue
            if local == self.depth:
                self.pointers = [p for p in self.pointers for _ in range(2)]
                self.depth += 1
            sibling = len(self.buckets)
            self.buckets[bucket] = (local + 1, 2 * prefix)
            self.buckets.append((local + 1, 2 * prefix + 1))
            width = 1 << (self.depth - local - 1)
            at = (2 * prefix + 1) * width
            self.pointers[at:at + width] = [sibling] * width
            overfull += [bucket, sibling]

    def bucket_of(self, h: str) -> Column:
        """The pointer of a 64-bit hash: its leading bits, read as a number, name the place."""
        cell = F.shiftrightunsigned(h, 64 - self.depth).cast("int") if self.depth else F.lit(0)
        return F.get(F.lit(self.pointers), cell)


def prefix_loads(rows: DataFrame, depth: int) -> np.ndarray:
    """Bytes per hash prefix; at most 2^depth rows reach the driver."""
    found = rows.groupBy(F.shiftrightunsigned("h", 64 - depth).alias("cell")).agg(F.sum("n_bytes").alias("load")).toPandas()
    loads = np.zeros(1 << depth, dtype=np.int64)
    loads[found["cell"].to_numpy(np.int64)] = found["load"].to_numpy(np.int64)
    return loads


ENTRY = pa.schema([("h", pa.int64()), ("slot", pa.int32()), ("text_sha256", pa.string()), ("norm", pa.string()),
                   ("first_id", pa.int64()), ("first_row", pa.int64()), ("copies", pa.int64())])
ENTRY_SQL = "h long, slot int, text_sha256 string, norm string, first_id long, first_row long, copies long"


def _ahead(a: tuple, b: tuple) -> bool:
    """(id, row) a stands before b; a null id comes after all others."""
    return (a[0] is None, a[0] or 0, a[1]) < (b[0] is None, b[0] or 0, b[1])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries sorted by (bucket, page, hash) to one per different text: a hash's texts are chained, and a text joins
    the entry whose bytes it equals. Holds one chain and one batch."""

    def closed(h: int) -> list[tuple]:
        return [(h, slot, sha, norm.to_pybytes().decode(), *first, n) for slot, (norm, sha, first, n) in enumerate(chain)]

    def batch_of(entries: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*entries), ENTRY)], schema=ENTRY)

    at, chain = None, []  # chain: [bytes, sha, (id, row), copies]
    for batch in batches:
        cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
        keys = zip(cols["bucket"].to_pylist(), cols["page"].to_pylist(), cols["h"].to_pylist())
        light = zip(cols["text_sha256"].to_pylist(), cols["first_id"].to_pylist(), cols["first_row"].to_pylist(),
                    cols["copies"].to_pylist())
        done, size = [], 0
        for key, norm, (sha, first, row, n) in zip(keys, cols["norm"], light):
            if key != at:
                if at is not None:
                    done += closed(at[2])
                    size += sum(e[0].size for e in chain)
                    if size > 1 << 22:
                        yield batch_of(done)
                        done, size = [], 0
                at, chain = key, []
            text = norm.as_buffer()
            for entry in chain:
                if entry[0].equals(text):
                    if _ahead((first, row), entry[2]):
                        entry[2] = (first, row)
                    entry[3] += n
                    break
            else:
                chain.append([text, sha, (first, row), n])
        if done:
            yield batch_of(done)
        chain = [[pa.py_buffer(e[0].to_pybytes()), *e[1:]] for e in chain]  # lets go of the batch
    if at is not None:
        yield batch_of(closed(at[2]))


def _owned(entries: DataFrame) -> DataFrame:
    """Owner tasks over the buckets' pages, each in hash order."""
    return entries.repartition("bucket", "page").sortWithinPartitions("bucket", "page", "h", "text_sha256").select(
        "bucket", "page", "h", "text_sha256", "norm", "first_id", "first_row", "copies").mapInArrow(_walk, ENTRY_SQL)


def index_of(rows: DataFrame, bucket_bytes: int, max_depth: int) -> DataFrame:
    """(h, slot, text_sha256, first_id, first_row, copies): the index of written `rows`, one row per different text.

    A hash whose rows alone overfill a bucket cannot be split off by more directory bits. Its rows go to overflow pages by
    row, each of a bucket's size and PAGE_ROWS at least, which are walked on their own; what they leave (one entry per page
    and text) is paged again, four times as large, until one page takes it.
    """
    entries = rows.select("h", "text_sha256", "norm", F.col("doc_id").alias("first_id"), F.col("row").alias("first_row"),
                          F.lit(1).cast("long").alias("copies"), "n_bytes")
    found = []
    while True:
        sizes = entries.groupBy("h").agg(F.sum("n_bytes").alias("load"), F.count("*").alias("n"))
        hot = checkpointed(sizes.filter((F.col("load") > bucket_bytes) & (F.col("n") > PAGE_ROWS)))
        cold = entries.join(F.broadcast(hot.select("h")), "h", "left_anti") if _small(hot) else entries.join(hot, "h", "left_anti")
        directory = Directory(prefix_loads(cold, max_depth), bucket_bytes)
        found.append(checkpointed(_owned(cold.withColumns({"bucket": directory.bucket_of("h"), "page": F.lit(0)})).drop("norm")))
        if hot.isEmpty():
            break
        pages = F.ceil(F.least(F.col("load") / bucket_bytes, F.col("n") / PAGE_ROWS))
        paged = entries.join(F.broadcast(hot) if _small(hot) else hot, "h").withColumns({
            "bucket": directory.bucket_of("h"), "page": (1 + F.pmod(F.xxhash64("first_row", "h"), pages)).cast("int")})
        entries = checkpointed(_owned(paged)).select(
            "h", "text_sha256", "norm", "first_id", "first_row", "copies", (F.octet_length("norm") + ROW_BYTES).alias("n_bytes"))
        bucket_bytes *= 4
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    return whole


def _small(hot: DataFrame) -> bool:
    """Hot hashes number at most the input's bytes over a bucket's; they are broadcast up to 16 MB of them."""
    return hot.count() <= 1 << 20


def deduplicated(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES, max_depth: int = MAX_DEPTH) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row, by equality of whole normalised texts.

    Of equal texts the row with the smallest doc_id stays: exactly one, whichever of rows with that doc_id. A null doc_id
    comes after all others, so keep_id is null only where no equal text has one. A null text equals an empty one; a text
    of any length is compared whole. No rows in, no rows out. Columns besides doc_id and text are ignored.

    Rows are written once with hash and digest; owner tasks walk the buckets of the index and compare bytes, so two
    texts with one hash stay apart. Rows find their entry by hash and digest.
    """
    norm = docs.select(F.col("doc_id").cast("long"), normalised().alias("norm"))
    rows = checkpointed(norm.select(
        "doc_id", "norm", F.xxhash64("norm").alias("h"), F.sha2("norm", 256).alias("text_sha256"),
        (F.octet_length("norm") + ROW_BYTES).cast("long").alias("n_bytes"), F.monotonically_increasing_id().alias("row")))
    index = index_of(rows, bucket_bytes, max_depth)
    several = index.filter("copies > 1").select("h", "text_sha256", "first_id", "first_row", "copies")
    several = several.withColumn("shared", F.lit(True))
    placed = rows.select("doc_id", "h", "text_sha256", "row").join(several, ["h", "text_sha256"], "left")
    return placed.select(
        "doc_id", F.when(F.col("shared"), F.col("first_id")).otherwise(F.col("doc_id")).alias("keep_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("first_row") == F.col("row"), F.lit(True)).alias("kept"), "text_sha256")
