"""Exact neighbour lists: rows are dealt to cells, and a cell is searched only where its ball can hold a nearer row."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .lineage import cut

#: Cells at most, and rows that the cells are fitted on at most; neither changes a result.
CELLS, FITTED = 4096, 100_000
FOUND = "id long, other long, distance double"


def usable(points: DataFrame, id_col: str, vector: str) -> DataFrame:
    """Rows ``(id, v)`` with a whole, finite vector; of rows that share an id the smallest vector."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.col(vector).cast("array<double>")
    return points.where(F.col(id_col).isNotNull() & finite & (F.size(vector) > 0)).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))


def _centres(rows: DataFrame, n: int, cells: int, seed: int) -> np.ndarray:
    dims = rows.select(F.max(F.size("v"))).first()[0]
    if cells <= 1:
        return np.zeros((1, dims))
    part = rows.select(array_to_vector("v").alias("features")).sample(min(1.0, FITTED / n), seed)
    return np.array(KMeans(k=cells, seed=seed, maxIter=5).fit(part).clusterCenters())


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``, from differences, so that equal rows are 0 apart."""
    out = np.empty((len(a), len(b)))
    step = max(1, (1 << 21) // max(1, b.size))
    for i in range(0, len(a), step):
        out[i : i + step] = np.sqrt(((a[i : i + step, None, :] - b[None]) ** 2).sum(2))
    return out


def _candidates(asked: np.ndarray, held: np.ndarray, same: np.ndarray, k: int, ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row asked, row held) that can be among the k nearest within the ball: products give squared distances up to rounding, for which there is room."""
    far = (held**2).sum(1)
    own = (asked**2).sum(1)
    if not np.isfinite(own.max() + far.max()):
        return np.nonzero(~same)
    d = asked @ held.T
    d *= -2
    d += own[:, None]
    d += far
    d[same] = np.inf
    room = 16 * (held.shape[1] + 4) * np.finfo(float).eps * (own + far.max())
    edge = np.partition(d, k - 1, axis=1)[:, k - 1] if k < d.shape[1] else np.full(len(d), np.inf)
    edge = np.minimum(edge, ball**2 * (1 + 1e-9)) + 2 * room
    at, to = np.nonzero(d <= edge[:, None])
    keep = np.isfinite(d[at, to])
    return at[keep], to[keep]


def _nearest(k: int, step: int = 512):
    def search(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "other": [], "distance": []}).astype({"id": "int64", "other": "int64"})]
        if asked.empty or held.empty:
            return out[0]
        held = held.sort_values("id")
        other, rows = held["id"].to_numpy(), np.stack(held["v"])
        ids, ball = asked["id"].to_numpy(), asked["ball"].to_numpy()
        for i in range(0, len(asked), step):
            x, mine = np.stack(asked["v"].iloc[i : i + step]), ids[i : i + step]
            at, to = _candidates(x, rows, mine[:, None] == other, k, ball[i : i + step])
            d, some = np.empty(len(at)), max(1, (1 << 21) // rows.shape[1])
            for j in range(0, len(at), some):
                d[j : j + some] = np.sqrt(((x[at[j : j + some]] - rows[to[j : j + some]]) ** 2).sum(1))
            order = np.lexsort((to, d, at))
            at, to, d = at[order], to[order], d[order]
            first = np.arange(len(at)) - np.searchsorted(at, at) < k
            out.append(pd.DataFrame({"id": mine[at[first]], "other": other[to[first]], "distance": d[first]}))
        return pd.concat(out)

    return search


def _searched(asked: DataFrame, held: DataFrame, blocks: dict[int, int], k: int, block: int) -> DataFrame:
    """The nearest rows of each block of the cells asked: any two blocks that meet are a group of bounded size."""
    spark = asked.sparkSession
    tally = {r["cell"]: math.ceil(r["count"] / block) for r in asked.groupBy("cell").count().collect()}
    sizes = spark.createDataFrame([(c, blocks[c], tally.get(c, 0)) for c in blocks], "cell int, held_in int, asked_in int")
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    mine = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    both = F.broadcast(sizes.where("asked_in > 0"))  # a row for each cell
    asked = asked.select(*(F.col(c).alias(c) for c in ("id", "v", "cell", "ball")))  # columns of its own where both sides are one table
    left = asked.join(both, "cell").select("id", "v", "ball", "cell", mine("asked_in").alias("qb"), span("held_in").alias("pb"))
    right = held.join(both, "cell").select("id", "v", "cell", mine("held_in").alias("pb"), span("asked_in").alias("qb"))
    key = ["cell", "qb", "pb"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_nearest(k), FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id").orderBy("distance", "other")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbour_lists(points: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", block: int = 8192, cells: int | None = None, seed: int = 42) -> DataFrame:
    """L3: each row's ``k`` nearest others by Euclidean distance: ``id``, ``rank``, ``other``, ``distance``; ties to the smaller id.

    First a row's own cell is searched, then every cell that reaches into the ball of its k-th distance so far, so the
    lists are exact whatever the cells. Where vectors have many dimensions few cells can be left out. Null vectors
    and those with null or non-finite parts take no part; an empty table gives no rows; vectors have one length.
    """
    rows = cut(usable(points, id_col, vector))
    n = rows.count()
    centres = _centres(rows, n, min(CELLS, cells or math.ceil(n / (4 * block))), seed) if n else np.zeros((1, 1))

    def placed(batches):
        for b in batches:
            if len(b):
                d = _apart(np.stack(b["v"]), centres)
                at = d.argmin(1)
                yield b.assign(cell=at.astype("int32"), far=d[np.arange(len(at)), at])

    held = cut(rows.mapInPandas(placed, "id long, v array<double>, cell int, far double"))
    known = held.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect()  # a row for each cell
    reach = np.full(len(centres), -np.inf)
    for r in known:
        reach[r["cell"]] = r["far"]
    blocks = {r["cell"]: math.ceil(r["n"] / block) for r in known}
    held = held.drop("far")
    near = cut(_best(_searched(held.withColumn("ball", F.lit(float("inf"))), held, blocks, k, block), k))
    if len(known) > 1:
        ball = near.where(F.col("rank") == k).select("id", F.col("distance").alias("ball"))

        def further(batches):
            for b in batches:
                if len(b):
                    hit = _apart(np.stack(b["v"]), centres) - reach <= b["ball"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                    hit[np.arange(len(b)), b["cell"]] = False
                    at, cell = np.nonzero(hit)
                    yield pd.DataFrame({"id": b["id"].to_numpy()[at], "v": b["v"].to_numpy()[at], "cell": cell.astype("int32"), "ball": b["ball"].to_numpy()[at]})

        asked = held.join(ball, "id", "left").fillna(float("inf"), ["ball"]).mapInPandas(further, "id long, v array<double>, cell int, ball double")
        near = _best(near.drop("rank").unionByName(_searched(cut(asked), held, blocks, k, block)), k)
    return near.select("id", "rank", "other", "distance")
