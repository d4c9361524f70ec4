"""Pairs of points that are in opposite order by two columns, counted over any number of points.

Points in the order of (x, y) are dealt to ranges, and again in the order of (y, x). Two points are inverted if one comes first by
x and last by y. Inversions inside a range of x are counted there by merging; of two points in different ranges of both orders the ranges
decide, so counts of points by both ranges are enough; and two points in different ranges of x and the same range of y
are counted there. No pair is made, and no key is kept together: ties may be cut by a range's end in either order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Points of a range; a range is held in one task.
SHARE = 500_000
WHOLE = "decimal(38,0)"


def inverted(first: np.ndarray, second: np.ndarray, weight: np.ndarray) -> int:
    """Sum of w_i w_j over pairs with first_i < first_j and second_i > second_j, by merging runs of doubling length."""
    order = np.lexsort((second, first))
    first, second, weight = first[order], second[order], weight[order]
    _, rank = np.unique(second, return_inverse=True)
    weight = weight.astype(np.int64 if int(weight.sum()) < 2**31 else object)
    n, total, run = len(rank), 0, 1
    place = np.arange(n)
    while run < n:
        block, right = place // (2 * run), place // run % 2 == 1
        by = np.lexsort((right, rank, block))  # in a block by rank; of equal ranks the left run first
        b, r, w = block[by], right[by], weight[by]
        left = np.where(r, 0, w)
        upto = np.cumsum(left)
        ends = np.append(np.flatnonzero(b[1:] != b[:-1]), n - 1)
        all_left = upto[ends[np.searchsorted(b[ends], b)]]
        total += int(np.sum(np.where(r, w, 0) * (all_left - upto)))
        run *= 2
    # Equal firsts are in the order of seconds, so they never count.
    return total


def _inside(batches):
    """A range of x: its inversions, and its points with the range's number."""
    part = TaskContext.get().partitionId()
    batches = list(batches)
    if not batches:
        return
    held = pa.Table.from_batches(batches)
    x, y, n = (held.column(c).to_numpy() for c in "xyn")
    if len(x):
        yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y), pa.array(n), pa.array(np.full(len(x), part)), pa.nulls(len(x), pa.string())], names=["x", "y", "n", "part", "count"])
        yield pa.RecordBatch.from_arrays([pa.array([0.0]), pa.array([0.0]), pa.array([0]), pa.array([part]), pa.array([str(inverted(x, y, n))])], names=["x", "y", "n", "part", "count"])


def _across(batches):
    """A range of y: inversions between its points of different ranges of x, and its points by these ranges."""
    mine = TaskContext.get().partitionId()
    batches = list(batches)
    if not batches:
        return
    held = pa.Table.from_batches(batches)
    done = held.filter(pa.array(held.column("count").is_valid().to_numpy())).column("count").to_pylist()
    rest = held.filter(pa.array(held.column("count").is_null().to_numpy()))
    y, n, part = (rest.column(c).to_numpy() for c in ("y", "n", "part"))
    total = sum(map(int, done)) + (inverted(part, y, n) if len(y) else 0)
    parts, at = np.unique(part, return_inverse=True)
    size = np.zeros(len(parts), np.int64)
    np.add.at(size, at, n)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(parts, -1)), pa.array(np.full(len(parts) + 1, mine)), pa.array(np.append(size, 0)), pa.array([None] * len(parts) + [str(total)], pa.string())],
                                     names=["part", "other", "n", "count"])


def discordant(points: DataFrame, share: int = SHARE) -> DataFrame:
    """One row ``(d)``: the number of inverted pairs of ``points(x, y, n)``, n copies of each, as a decimal of 38 digits.

    Points with nulls take no part. Counts are exact.
    """
    points = points.select(F.col("x").cast("double"), F.col("y").cast("double"), F.col("n").cast("long")).dropna()
    ranges = max(1, -(-points.count() // share))
    inside = points.repartitionByRange(ranges, "x", "y").mapInArrow(_inside, "x double, y double, n long, part long, count string")
    cells = inside.repartitionByRange(ranges, "y", "x").select("y", "n", "part", "count").mapInArrow(_across, "part long, other long, n long, count string")
    # For each cell: points in lower ranges of x and higher ranges of y. Windows are over ranges, not points.
    size = F.col("n").cast(WHOLE)
    grid = cells.where("part >= 0").groupBy("part", "other").agg(F.sum(size).alias("n"))
    full = grid.select("part").distinct().join(F.broadcast(grid.select("other").distinct()), F.lit(True)).join(grid, ["part", "other"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast(WHOLE)))
    above = full.withColumn("above", F.sum("n").over(W.partitionBy("part").orderBy(F.desc("other")).rowsBetween(W.unboundedPreceding, -1)))
    before = above.withColumn("before", F.sum("above").over(W.partitionBy("other").orderBy("part").rowsBetween(W.unboundedPreceding, -1)))
    crossed = before.agg(F.sum((F.col("n").cast("decimal(19,0)") * F.coalesce("before", F.lit(0)).cast("decimal(19,0)")).cast(WHOLE)).alias("c"))
    local = cells.where("part < 0").agg(F.sum(F.col("count").cast(WHOLE)).alias("l"))
    return crossed.crossJoin(local).select((F.coalesce("c", F.lit(0)).cast(WHOLE) + F.coalesce("l", F.lit(0)).cast(WHOLE)).cast(WHOLE).alias("d"))  # one row each
