"""Vector code compression: product codebooks in whole numbers, nearest entries by equal-average search."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberwatch.session import checkpointed

PARTS = 16
ENTRIES = 64
ROUNDS = 2
SCALE = 256
#: A part of n components is exact while these stay within this over n: no square of a sum leaves 64 bits.
SUM_LIMIT = 1 << 30


def nearest(points: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of each point's nearest entry; ties go to the lower index.

    Equal-average search: entries are sorted by the sum of their components, and each point looks outward from its own
    sum, below and above. A squared gap between sums over the dimension is a lower bound of the squared distance, so a
    side is done once that strictly exceeds the best distance so far; an equal one can still tie.
    """
    n, width = points.shape
    best = np.full(n, np.iinfo(np.int64).max)
    index = np.full(n, len(entries))
    if not width:
        return np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    order = np.argsort(entries.sum(axis=1), kind="stable")
    sums, mine = entries.sum(axis=1)[order], points.sum(axis=1)
    above = np.searchsorted(sums, mine)
    sides = [[np.flatnonzero(above > 0), -1], [np.flatnonzero(above < len(entries)), 1]]
    at = [above - 1, above]
    while len(sides[0][0]) or len(sides[1][0]):
        for side, (rows, step) in enumerate(sides):
            place = at[side][rows]
            rows = rows[(sums[place] - mine[rows]) ** 2 <= np.minimum(best[rows], np.iinfo(np.int64).max // width) * width]
            entry = order[at[side][rows]]
            away = ((points[rows] - entries[entry]) ** 2).sum(axis=1)
            better = (away < best[rows]) | ((away == best[rows]) & (entry < index[rows]))
            best[rows[better]], index[rows[better]] = away[better], entry[better]
            at[side][rows] += step
            sides[side][0] = rows[(at[side][rows] >= 0) & (at[side][rows] < len(entries))]
    return index, best


def _parts(frame: pd.DataFrame, books: np.ndarray) -> np.ndarray:
    """A batch's vectors as (row, part, component)."""
    flat = np.concatenate(frame["whole"].to_list()).astype(np.int64)
    return flat.reshape(len(frame), books.shape[0], books.shape[2])


def _sums(books: np.ndarray):
    """Per task: how many parts each entry got, and their sums by component."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, totals = np.zeros(books.shape[:2], dtype=np.int64), np.zeros(books.shape, dtype=np.int64)
        for frame in frames:
            if not len(frame):
                continue
            parts = _parts(frame, books)
            for p, entries in enumerate(books):
                index, _ = nearest(parts[:, p], entries)
                n[p] += np.bincount(index, minlength=len(entries))
                np.add.at(totals[p], index, parts[:, p])
        part, entry = np.nonzero(n)
        for place in range(books.shape[2]):
            yield pd.DataFrame({"part": part, "entry": entry, "place": place, "n": n[part, entry],
                                "total": totals[part, entry, place]})

    return run


def _encode(books: np.ndarray):
    @F.pandas_udf("code string, error long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = _parts(pd.DataFrame({"whole": batch}), books)
            found = [nearest(parts[:, p], entries) for p, entries in enumerate(books)]
            codes = np.stack([i for i, _ in found], axis=1).astype(np.uint8)
            yield pd.DataFrame({"code": [c.tobytes().hex() for c in codes],
                                "error": sum(e for _, e in found) if found else 0})

    return run


def whole_vectors(vectors: DataFrame, dimension: int, parts: int) -> DataFrame:
    """Adds `whole`: the components of vectors of `dimension` as floored multiples of 1/SCALE, padded with zeros to
    full parts and held within SUM_LIMIT; null for other lengths."""
    pad = -dimension % parts
    limit = SUM_LIMIT // max(1, (dimension + pad) // parts)
    scaled = F.transform("embedding", lambda x: F.greatest(F.least(
        F.floor(F.greatest(F.least(x.cast("double"), F.lit(1e15)), F.lit(-1e15)) * SCALE), F.lit(limit)), F.lit(-limit)).cast("int"))
    padded = F.concat(scaled, F.array_repeat(F.lit(0), pad)) if pad else scaled
    return vectors.withColumn("whole", F.when(F.size("embedding") == dimension, padded))


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose vector is there and finite in all components."""
    return vectors.filter(F.coalesce(F.forall(
        "embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)))


def trained_books(coded: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Entries after `rounds` of assigning every part and flooring each entry's mean; unused entries stay.

    Tasks send sums, at most one row per part, entry and component; so much reaches the driver.
    """
    for _ in range(rounds):
        found = coded.mapInPandas(_sums(books), "part int, entry int, place int, n long, total long").groupBy(
            "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).toPandas()
        books = books.copy()
        books[found["part"], found["entry"], found["place"]] = found["total"].to_numpy() // found["n"].to_numpy()
    return books


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compressed(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, label for every row with a usable vector.

    Left out are null vectors and those with a null or non-finite component. Entries start as the parts of the
    `entries` smallest vec_ids (null ids last, equal ids by their components); with fewer vectors there are fewer
    entries. Repeated rows are repeated and count each time. A null label is a label of its own. Codebooks are for one
    length of vectors, the most frequent (the shorter of equals): rows of other lengths have a null code and error, and
    add nothing to label_error. A length that does not divide into `parts` is padded with zeros at the end; vectors
    without components have code 00...0 and error 0. Components beyond SUM_LIMIT over the part length (2^28 for parts of
    four, before it 2^20) are held there. No usable rows in, no rows out. Columns besides vec_id, label and embedding are
    ignored.

    At most 256 entries, so that an index has two hex digits.
    """
    if not 0 < entries <= 256:
        raise ValueError("codebooks have 1 to 256 entries")
    kept = usable(vectors.select("vec_id", "label", "embedding"))
    common = kept.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    dimension = common["n"] if common else 0
    coded = checkpointed(whole_vectors(kept, dimension, parts).drop("embedding"))
    fitted = coded.filter("whole is not null")
    seeds = fitted.orderBy(F.asc_nulls_last("vec_id"), "whole").limit(entries).select("whole").collect()
    width = (dimension + parts - 1) // parts
    books = np.array([r["whole"] for r in seeds], dtype=np.int64).reshape(len(seeds), parts, width).swapaxes(0, 1)
    books = trained_books(fitted.select("whole"), books, rounds) if len(seeds) else books
    result = checkpointed(fitted.select("vec_id", "label", _encode(books)("whole").alias("c")).select(
        "vec_id", "label", "c.*").unionByName(coded.filter("whole is null").select(
            "vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))))
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(2 ** 63 - 1).cast("decimal(38,0)"))
    totals = checkpointed(result.groupBy("label").agg(total.cast("long").alias("label_error")))
    return result.join(totals.withColumnRenamed("label", "of"), F.col("label").eqNullSafe(F.col("of"))).select(
        "vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"), "label")
