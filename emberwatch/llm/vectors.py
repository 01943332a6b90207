"""Embedding near-duplicates as an exact metric range join: pivots, boundary replication, independent cells."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberwatch.llm.base import components
from emberwatch.session import checkpointed

THRESHOLD = 0.98
PIVOTS = 4
#: Cells above this size are partitioned again, by pivots of their own, as long as that makes them smaller by SHRINK.
CELL_ROWS = 8000
SHRINK = 0.7
LEVELS = 24
#: What is still larger then is compared block by block, each pair of blocks on its own.
BLOCK_ROWS = 4000
#: Rows of a cell that are compared with the whole cell at once.
ROWS_AT_ONCE = 256
#: Rounding of distances: replication may be wider than needed, never narrower.
SLACK = 1e-6


def unit_column() -> Column:
    """The vector at length 1 in double precision; null for one that links with nothing."""

    @F.pandas_udf("array<double>")
    def unit(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out = []
            for v in batch:
                v = None if v is None else np.asarray(v, dtype=np.float64)
                top = np.abs(v).max() if v is not None and v.size else 0.0
                if not 0 < top < np.inf:  # also a NaN
                    out.append(None)
                    continue
                v = v / top
                out.append(v / np.sqrt(v @ v))
            yield pd.Series(out, dtype=object)

    return unit("embedding")


def partition(cells: DataFrame, level: int, eps: float) -> DataFrame:
    """Members (cell, id, copies, unit, away) to the cells of `level` around pivots drawn in each cell.

    A vector's home is its nearest pivot. It also goes to each lower-numbered cell j whose home vectors may be within
    eps: by the triangle inequality d(x, p_j) - d(x, p_home) <= 2 eps and d(x, p_j) <= radius of j + eps. `away` has a
    bit for each level at which the row is a replica: a pair counts in the cell where not both are replicas of one
    level, which for every pair within eps is one cell exactly.
    """
    slot = F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(PIVOTS))
    drawn = checkpointed(cells.groupBy("cell", slot.alias("slot")).agg(
        F.min_by("unit", F.xxhash64("unit", F.lit(level))).alias("p"), F.count("*").alias("rows")))
    cuts = drawn.groupBy("cell").agg(F.ceil(F.sum("rows") / BLOCK_ROWS).cast("int").alias("cut"))
    block = F.pmod(F.xxhash64("id", F.lit(4)), F.col("cut")).cast("int")
    left = cells.join(cuts, "cell").withColumn("block", block).drop("cut").groupBy("cell", "block")
    right = drawn.join(cuts, "cell").select("cell", "p", F.explode(F.expr("sequence(0, cut - 1)")).alias("block"))
    schema = "cell string, id long, copies long, unit array<double>, away int, home int, near double, d array<double>"
    placed = checkpointed(left.cogroup(right.groupBy("cell", "block")).applyInPandas(homes, schema))
    radius = placed.groupBy("cell", "home").agg(F.max("near").alias("radius"))
    radius = radius.groupBy("cell").agg(F.map_from_entries(F.collect_list(F.struct("home", "radius"))).alias("radii"))
    reach = F.expr(f"""filter(sequence(0, home), j -> j = home or (
        d[j] - near <= {2 * eps + SLACK} and d[j] <= coalesce(radii[j], -1D) + {eps + SLACK}))""")
    spread = placed.join(radius, "cell").withColumn("j", F.explode(reach))
    foreign = F.when(F.col("j") != F.col("home"), F.lit(1 << level)).otherwise(0)
    return spread.select(F.concat_ws("/", "cell", "j").alias("cell"), "id", "copies", "unit",
                         F.col("away").bitwiseOR(foreign).alias("away"))


def homes(members: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    """Distances of a block of a cell's members to the cell's pivots, in an order that all blocks share."""
    if not len(members):
        return members.drop(columns="block").assign(home=0, near=0.0, d=None)
    units, points = np.stack(members["unit"]), np.stack(sorted(pivots["p"], key=tuple))
    d = np.sqrt(np.maximum(0, 2 - 2 * (units @ points.T)))
    return members.drop(columns="block").assign(home=d.argmin(axis=1), near=d.min(axis=1), d=list(d))


def join(low: np.ndarray, members: np.ndarray) -> None:
    """Makes one group of those of `members`; `low` points from each position to one of its group that is no higher."""
    roots = low[members]
    while (low[roots] != roots).any():
        roots = low[roots]
    low[roots] = low[members] = roots.min()


def cell_links(threshold: float):
    """Links inside a cell (or between two blocks of one): partial counts per vector and edges to each group's least.

    ROWS_AT_ONCE rows at a time are compared and reduced to counts and groups, so no list of pairs is kept.
    """

    def links(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        # Positions in order of ids: the least position of a group is its least id.
        frame = frame.sort_values("id", ignore_index=True)
        left, right = (np.flatnonzero(on) for on in (frame["side"] <= 1, frame["side"] >= 1))
        same = (frame["side"] == 1).all()
        ids, away, copies = (frame[c].to_numpy(np.int64) for c in ("id", "away", "copies"))
        n, low = np.zeros(len(ids), np.int64), np.arange(len(ids))
        units = np.stack(frame["unit"])
        others = units[right]
        for at in range(0, len(left) if len(right) else 0, ROWS_AT_ONCE):
            i, j = left[at:at + ROWS_AT_ONCE], right[at:] if same else right
            hit = units[i] @ (others[at:] if same else others).T >= threshold
            hit &= (away[i][:, None] & away[j]) == 0
            if same:
                hit = np.triu(hit, 1)
            n[i] += (hit @ copies[j].astype(float)).astype(np.int64)
            n[j] += (copies[i].astype(float) @ hit).astype(np.int64)
            for row in np.flatnonzero(hit.any(axis=1)):
                join(low, np.append(j[hit[row]], i[row]))
        while (low[low] != low).any():
            low = low[low]
        linked = np.flatnonzero(n)
        return pd.DataFrame({"id": ids[linked], "links": n[linked], "low": ids[low[linked]]})

    return links


def blocks(cells: DataFrame, sizes: DataFrame) -> DataFrame:
    """Adds (task, side): a small cell is one task; a large one is cut and each pair of its blocks is one.

    side 1: compare within; otherwise 0 against 2.
    """
    cut = F.ceil(F.col("rows") / BLOCK_ROWS).cast("int")
    sized = cells.join(sizes, "cell").withColumn("cut", F.when(F.col("rows") > CELL_ROWS, cut).otherwise(1))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id", F.lit(3)), F.col("cut")).cast("int"))
    pairs = F.expr("""transform(sequence(0, cut - 1), o -> struct(
        concat_ws('-', least(block, o), greatest(block, o)) as task,
        case when o = block then 1 when block < o then 0 else 2 end as side))""")
    return sized.withColumn("t", F.explode(pairs)).select("cell", "t.task", "t.side", "id", "copies", "unit", "away")


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: every pair of one label at or over `threshold` cosine, none below.

    One row per input row. Equal (label, embedding) rows are compared once and count as each other's links, repeated
    rows of one vec_id included. Vectors of a null label, null, empty, zero or with a null or non-finite component, and
    vectors of different lengths, link with nothing: n_links 0, their own component. A null vec_id links but names no
    component. Columns besides vec_id, label and embedding are ignored. Pairs never leave a cell: it returns a count
    per vector and one edge per vector to its group. In data without clusters, high dimensions leave the triangle
    inequality little to prune: cells then hardly shrink, are not cut further by pivots, and are compared in blocks.
    """
    eps = float(np.sqrt(2 - 2 * threshold))
    rows = vectors.select("vec_id", "label", "embedding", unit_column().alias("unit"))
    rows = checkpointed(rows)
    linked = rows.filter("unit is not null and label is not null").groupBy("label", "unit").agg(
        F.count("*").alias("copies"), F.min("vec_id").alias("first_id"))
    kinds = checkpointed(linked.select("label", "unit", "copies", "first_id", F.monotonically_increasing_id().alias("id")))
    cells = kinds.select(F.concat_ws(":", "label", F.size("unit")).alias("cell"), "id", "copies", "unit",
                         F.lit(0).alias("away"))
    done, before = [], cells.groupBy("cell").agg(F.count("*").alias("rows"))
    for level in range(LEVELS):
        cells = checkpointed(partition(cells, level, eps))
        sizes = checkpointed(cells.groupBy("cell").agg(F.count("*").alias("rows")))
        parents = before.select(F.col("cell").alias("parent"), F.col("rows").alias("of"))
        large = sizes.withColumn("parent", F.regexp_replace("cell", "/[^/]*$", "")).join(parents, "parent").filter(
            (F.col("rows") > CELL_ROWS) & (F.col("rows") < SHRINK * F.col("of"))).select("cell")
        if level == LEVELS - 1 or large.isEmpty():
            break
        done.append(cells.join(large, "cell", "left_anti"))
        cells, before = cells.join(large, "cell", "left_semi"), sizes
    for more in done:
        cells = cells.unionByName(more)
    sizes = cells.groupBy("cell").agg(F.count("*").alias("rows"))
    found = checkpointed(blocks(cells, sizes).groupBy("cell", "task").applyInPandas(
        cell_links(threshold), "id long, links long, low long"))
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    named = kinds.join(roots.withColumnRenamed("node", "id"), "id", "left").join(links, "id", "left").select(
        "label", "unit", "copies", "first_id", F.coalesce("root", "id").alias("root"),
        F.coalesce("links", F.lit(0)).alias("links"))
    least = named.groupBy("root").agg(F.min("first_id").alias("least"))
    labels = named.join(least, "root").select("label", "unit", "copies", "links", "least")
    keyed = rows.select("vec_id", "label", "unit").join(labels, ["label", "unit"], "left")
    component = F.when(F.col("copies").isNull(), F.col("vec_id")).otherwise(F.col("least"))
    return keyed.select("vec_id", F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).alias("n_links"),
                        component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
