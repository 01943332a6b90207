"""Ordered computations that hold up when one key owns most rows.

A window partitioned by the key alone sends a hot key to one task. The helpers
here cut the timeline of every key into cells, work inside (key, cell), and
carry a small summary from cell to cell: at most one row per key and cell goes
through the per-key window.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from emberwatch.session import checkpointed

HOUR_US = 3_600_000_000
#: Rows of one key and cell that one task may order; denser cells are cut by range.
PIECE_ROWS = 200_000


def _cell(us: str, width: int) -> Column:
    return F.floor(F.col(us) / F.lit(width)).cast("bigint") if width < 2 else F.expr(
        f"(`{us}` - pmod(`{us}`, {width}L)) div {width}L"
    )


def gap_sessions(df: DataFrame, keys: list[str], us: str, gap_us: int, out: str = "session_start") -> DataFrame:
    """Add the start time of each row's session; a step of more than `gap_us` opens a new one.

    Two rows of one key in one cell of width `gap_us` always share a session, so
    only the cells' first and last times need ordering.
    """
    celled = df.withColumn("_cell", _cell(us, gap_us))
    cells = celled.groupBy(*keys, "_cell").agg(F.min(us).alias("_lo"), F.max(us).alias("_hi"))
    by_key = Window.partitionBy(*keys).orderBy("_cell")
    opens = F.coalesce(F.col("_lo") - F.lag("_hi").over(by_key) > gap_us, F.lit(True))
    starts = (
        cells.withColumn("_open", F.when(opens, F.col("_lo")))
        .withColumn(out, F.last("_open", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
        .select(*keys, "_cell", out)
    )
    return celled.join(starts, [*keys, "_cell"]).drop("_cell")


def session_spans(df: DataFrame, keys: list[str], us: str, seq: str, gap_us: int) -> DataFrame:
    """(keys, session_start, _seq, _last): each session of `gap_sessions`, the lowest seq at its start and its last time.

    Read off the cells, so the rows themselves are taken once and not joined again.
    """
    known = df.filter(reduce(and_, [F.col(c).isNotNull() for c in (*keys, us)])).withColumn("_cell", _cell(us, gap_us))
    cells = known.groupBy(*keys, "_cell").agg(
        F.min(F.struct(F.col(us).alias("us"), F.col(seq).isNull().alias("unknown"), F.col(seq).alias("seq"))).alias("_lo"),
        F.max(us).alias("_hi"))
    by_key = Window.partitionBy(*keys).orderBy("_cell")
    opens = F.coalesce(F.col("_lo.us") - F.lag("_hi").over(by_key) > gap_us, F.lit(True))
    starts = cells.withColumn("_open", F.when(opens, F.col("_lo"))).withColumn(
        "_start", F.last("_open", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)))
    return starts.groupBy(*keys, F.col("_start.us").alias("session_start")).agg(
        F.min("_start.seq").alias("_seq"), F.max("_hi").alias("_last"))


def _summed_pieces(df: DataFrame, keys: list[str], us: str, order: list[str], cell_us: int, piece_rows: int,
                   summary: list[Column]) -> tuple[DataFrame, DataFrame]:
    """Rows with `_cell` (of time) and `_piece` (of a dense cell), which ascend with (us, *order) within a key, and the
    `summary` of each piece.

    Cells of more than `piece_rows` rows are sorted by range over all their rows, ties in time included, and each range
    is a piece. The ranges are sampled, so their rows are written with the piece they fell in. Cells are counted and
    summed up in one pass.
    """
    at = [*keys, "_cell"]
    celled = df.withColumn("_cell", _cell(us, cell_us))
    cells = checkpointed(celled.groupBy(*at).agg(F.count("*").alias("_n"), *summary))
    crowded = cells.filter(F.col("_n") > piece_rows).agg(F.sum("_n")).first()[0]
    whole = cells.filter(F.col("_n") <= piece_rows).drop("_n").withColumn("_piece", F.lit(0))
    if not crowded:
        return celled.withColumn("_piece", F.lit(0)), whole
    dense = cells.filter(F.col("_n") > piece_rows).select(*at)
    ranges = int(min(20_000, -(-2 * crowded // piece_rows)))
    cut = celled.join(dense, at, "left_semi").repartitionByRange(ranges, *keys, us, *order)
    cut = checkpointed(cut.withColumn("_piece", F.spark_partition_id()))
    sparse = celled.join(dense, at, "left_anti").withColumn("_piece", F.lit(0))
    return sparse.unionByName(cut), whole.unionByName(cut.groupBy(*at, "_piece").agg(*summary))


def _pieces(df: DataFrame, keys: list[str], us: str, order: list[str], cell_us: int, piece_rows: int) -> DataFrame:
    """The rows of `_summed_pieces` alone."""
    return _summed_pieces(df, keys, us, order, cell_us, piece_rows, [F.count("*").alias("_rows")])[0]


def previous_time(
    df: DataFrame, keys: list[str], us: str, order: list[str], out: str = "previous_us", cell_us: int = HOUR_US,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add the time of the preceding row of the same key, in (us, *order) order."""
    celled, pieces = _summed_pieces(df, keys, us, order, cell_us, piece_rows, [F.max(us).alias("_hi")])
    at = [*keys, "_cell", "_piece"]
    by_key = Window.partitionBy(*keys).orderBy("_cell", "_piece")
    before = pieces.select(*at, F.lag("_hi").over(by_key).alias("_before"))
    inside = F.lag(us).over(Window.partitionBy(*at).orderBy(us, *order))
    return (
        celled.withColumn("_inside", inside)
        .join(before, at)
        .withColumn(out, F.coalesce("_inside", "_before"))
        .drop("_cell", "_piece", "_inside", "_before")
    )


def running_totals(
    df: DataFrame, keys: list[str], us: str, order: list[str], values: dict[str, str], cell_us: int = HOUR_US,
    piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add running sums of `values` (output name -> column) in (us, *order) order."""
    sums = [F.sum(v).alias(f"_t_{o}") for o, v in values.items()]
    celled, pieces = _summed_pieces(df, keys, us, order, cell_us, piece_rows, sums)
    at = [*keys, "_cell", "_piece"]
    by_key = Window.partitionBy(*keys).orderBy("_cell", "_piece").rowsBetween(Window.unboundedPreceding, -1)
    carried = pieces.select(
        *at, *[F.coalesce(F.sum(f"_t_{o}").over(by_key), F.lit(0)).alias(f"_c_{o}") for o in values],
    )
    inside = Window.partitionBy(*at).orderBy(us, *order).rowsBetween(Window.unboundedPreceding, 0)
    out = celled.select("*", *[F.sum(v).over(inside).alias(f"_i_{o}") for o, v in values.items()])
    out = out.join(carried, at)
    for o in values:
        out = out.withColumn(o, F.col(f"_i_{o}") + F.col(f"_c_{o}")).drop(f"_i_{o}", f"_c_{o}")
    return out.drop("_cell", "_piece")


def trailing_frames(
    df: DataFrame, keys: list[str], us: str, seq: str, rows: int, out: str = "frame", *,
    cell_us: int = HOUR_US, piece_rows: int = PIECE_ROWS, chunk: int = 100_000,
) -> DataFrame:
    """Add the ordered times of the last `rows` rows of the key, the current one included.

    Rows are numbered across cells, then cut into chunks of equal length that
    overlap by `rows - 1`, so each task sees a bounded slice however hot the key.
    """
    numbered = running_totals(
        df.withColumn("_one", F.lit(1)), keys, us, [seq], {"_pos": "_one"}, cell_us, piece_rows
    ).drop("_one").withColumn("_pos", F.col("_pos") - 1)
    home = F.expr(f"_pos div {chunk}")
    spill = F.expr(f"_pos % {chunk}") >= chunk - (rows - 1)
    copies = F.when(spill, F.array(home, home + 1)).otherwise(F.array(home))
    chunked = numbered.withColumn("_chunk", F.explode(copies))
    frame = Window.partitionBy(*keys, "_chunk").orderBy("_pos").rowsBetween(-(rows - 1), 0)
    return (
        chunked.withColumn(out, F.collect_list(us).over(frame))
        .filter(F.col("_chunk") == home)
        .drop("_chunk", "_pos")
    )


def active_breadth(
    sightings: DataFrame, keys: list[str], items: dict[str, str], us: str, seq: str, window_us: int,
    cell_us: int = HOUR_US, piece_rows: int = PIECE_ROWS,
) -> DataFrame:
    """Add, per row, how many distinct values of each item were seen in the trailing window.

    `items` maps an output count to the item column. A value counts from the
    sighting that opens its gap session until `window_us` after the last one, so
    the count is a running sum of +1 and -1 marks, not a set per row.
    """
    marks = sightings.select(*keys, F.col(us).alias("_us"), F.col(seq).alias("_seq"), F.lit(1).alias("_row"),
                             *[F.lit(0).alias(f"_d_{o}") for o in items])
    for o, item in items.items():
        sessions = session_spans(sightings.select(*keys, item, us, seq), [*keys, item], us, seq, window_us)
        deltas = lambda v: [F.lit(v if other == o else 0).alias(f"_d_{other}") for other in items]
        opened = sessions.select(*keys, F.col("session_start").alias("_us"), "_seq", F.lit(0).alias("_row"), *deltas(1))
        lapsed = sessions.select(*keys, (F.col("_last") + window_us + 1).alias("_us"),
                                 F.lit(-(2 ** 63) + 1).cast("bigint").alias("_seq"), F.lit(0).alias("_row"),
                                 *deltas(-1))
        marks = marks.unionByName(opened).unionByName(lapsed)
    # Written once: cells and rows are both read off the marks.
    counted = running_totals(checkpointed(marks), keys, "_us", ["_seq", "_row"], {o: f"_d_{o}" for o in items}, cell_us, piece_rows)
    return counted.filter("_row = 1").select(
        *keys, F.col("_us").alias(us), F.col("_seq").alias(seq), *items
    )


def sample_first_n(df: DataFrame, keys: list[str], value: str, n: int, out: str = "sample") -> DataFrame:
    """The `n` smallest values per key as a sorted array; ranks are cut before the shuffle."""
    ranked = df.select(*keys, value, F.row_number().over(Window.partitionBy(*keys).orderBy(value)).alias("_n"))
    return ranked.filter(F.col("_n") <= n).groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias(out))


# -- cooldown ------------------------------------------------------------------

def _greedy(cooldown_us: int):
    """Kept rows of pieces that arrive one after the other, each in time order; holds one batch and the last kept time."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        piece, last = None, 0
        for frame in frames:
            ids = list(zip(frame["_p"].tolist(), frame["_q"].tolist()))
            times = frame["_us"].tolist()
            cuts = np.flatnonzero((frame["_p"].diff() != 0) | (frame["_q"].diff() != 0)).tolist()
            kept = []
            for at, end in zip(cuts, [*cuts[1:], len(times)]):
                if ids[at] != piece:
                    piece, last = ids[at], times[at] - cooldown_us
                while (at := bisect_left(times, last + cooldown_us, at, end)) < end:
                    kept.append(at)
                    last = times[at]
            yield frame.iloc[kept]

    return run


def cooldown_filter(candidates: DataFrame, keys: list[str], us: str, seq: str, cooldown_us: int) -> DataFrame:
    """Keep a candidate only when at least `cooldown_us` passed since the last kept one of its key.

    Of candidates at one time the lowest seq counts; without a cooldown all are kept. The greedy pass starts anew
    wherever a key pauses for the cooldown, so a key's timeline is cut there and the pieces are independent. A piece
    is sorted by Spark and walked once, batch by batch.
    """
    if cooldown_us < 0:
        raise ValueError("a cooldown is not negative")
    if cooldown_us == 0:
        return candidates
    candidates = checkpointed(candidates)
    firsts = candidates.groupBy(*keys, F.col(us).alias("_us")).agg(F.min(seq).alias("_seq"))
    pieces = gap_sessions(firsts, keys, "_us", max(1, cooldown_us - 1), "_start")
    named = pieces.withColumns({"_p": F.xxhash64(*keys, "_start"), "_q": F.xxhash64(F.lit(1), *keys, "_start")})
    ordered = named.select(*keys, "_us", "_seq", "_p", "_q").repartition("_p", "_q").sortWithinPartitions("_p", "_q", "_us")
    # Written once: detectors read their alerts several times.
    alerts = checkpointed(ordered.mapInPandas(_greedy(cooldown_us), ordered.schema).select(
        *keys, F.col("_us").alias(us), F.col("_seq").alias(seq)))
    return candidates.join(alerts, [*keys, us, seq], "left_semi")
