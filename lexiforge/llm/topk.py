"""Exact top-k inner products by no-random-access aggregation.

Each component is two sorted lists, of its values and of their negatives, so that
a query is a sum with non-negative weights over lists read from their best end.
The queries of a block read all lists of a part in lockstep, in blocks of ranks.
At each depth a row has a lower bound (components not read yet at their list's
least value) and an upper bound (at the last value read). A query stops when no
row outside a few can reach its k-th best lower bound; those few get their exact
scores. Bounds of a whole block are matrix products.

Parts and query blocks have bounded sizes; each pair of them is one task's group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows of a part, queries of a block, and queries that are searched at a time.
PART, BLOCK, AT_ONCE = 8192, 8192, 256


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(vec_id, v, dim)`` of the rows with an id and a vector without null or non-finite components."""
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    return rows.where("vec_id is not null and v is not null and size(v) > 0").where(~odd).withColumn("dim", F.size("v"))


def nra(query: np.ndarray, row: np.ndarray, own: np.ndarray, k: int, few: int = 64, steps=(8, 4, 2, 4 / 3, 1)):
    """The k best rows of each query, ties included: (query index, row index, score). ``own``: rows that a query leaves out."""
    n = len(row)
    x = np.hstack([row, -row])  # values of both lists of every component
    #: Sums of doubles may be off by so much, which only keeps more rows open.
    slack = 4 * np.finfo(float).eps * x.shape[1] * np.abs(query).sum(1) * (np.abs(row).max() if n else 0.0)
    w = np.hstack([np.maximum(query, 0), np.maximum(-query, 0)])
    order = np.argsort(-x, axis=0, kind="stable")
    rank = np.empty_like(order)
    np.put_along_axis(rank, order, np.arange(n)[:, None] * np.ones(x.shape[1], np.int64), axis=0)
    best = np.take_along_axis(x, order, axis=0)
    least = best[-1]
    todo, out = np.arange(len(query)), []
    for part in steps:
        depth = min(n, max(k, int(n / part)))
        read = rank < depth
        got = np.where(read, x, 0.0) @ w[todo].T
        unread = (~read).astype(float)
        lower = got + unread @ (w[todo] * least).T
        upper = got + unread @ (w[todo] * best[depth - 1]).T
        lower[own[:, todo]] = -np.inf
        upper[own[:, todo]] = -np.inf
        at = max(0, n - k)
        bar = np.partition(lower, at, axis=0)[at]
        open_ = upper + slack[todo] >= bar - slack[todo]
        open_ &= ~own[:, todo]
        count = open_.sum(0)
        done = (count <= few) | (depth == n)
        for j in np.flatnonzero(done):
            r = np.flatnonzero(open_[:, j])
            score = _exact(row[r], query[todo[j]])
            out.append((np.full(len(r), todo[j]), r, score))
        todo = todo[~done]
        if not len(todo):
            break
    q, r, s = (np.concatenate(c) for c in zip(*out)) if out else (np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.int64))
    return q, r, s


def _exact(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Integer inner products as longs, by integers without a bound where doubles can't hold the sums."""
    if not len(rows) or np.abs(rows).max() * np.abs(query).sum() < 2**53:
        return (rows * query).sum(1).astype(np.int64)
    q = [int(x) for x in query]
    score = [sum(int(x) * y for x, y in zip(r, q)) for r in rows]
    if max(map(abs, score)) >= 2**63:
        raise OverflowError("an inner product doesn't fit in a long")
    return np.array(score, np.int64)


def _search(k: int, scale: float):
    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        rows, queries = (np.floor(scale * np.stack(d["v"].to_numpy()).astype(float)) for d in (left, right))
        ids, qids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        got = []
        for i in range(0, len(queries), AT_ONCE):
            q, r, s = nra(queries[i : i + AT_ONCE], rows, ids[:, None] == qids[None, i : i + AT_ONCE], k)
            got.append((q + i, r, s))
        q, r, s = (np.concatenate(c) for c in zip(*got))
        order = np.lexsort((ids[r], -s, q))
        q, r, s = q[order], r[order], s[order]
        place = np.arange(len(q)) - np.searchsorted(q, q)
        top = place < k
        return pd.DataFrame({"query_id": qids[q[top]], "vec_id": ids[r[top]], "score": s[top]})

    return search


def exact_top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding", part: int = PART, block: int = BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``, its k rows of highest integer inner product.

    Components are floor(scale * x). Returns ``query_id``, ``rank`` (from 1), ``vec_id``
    and ``score``; ties go to the smaller id, a query's own id is left out, and with fewer
    candidates all are returned. Rows with a null id, and vectors null, empty or with
    null or non-finite components, take no part; vectors of different lengths
    don't meet. A row given twice is two candidates and one query; of different vectors under one
    id the least asks. Scores are exact; one that a long can't hold is an error. Empty input: no rows.

    A row is sent once for each ``block`` queries and a query once for each ``part`` rows: both are as
    large as a task's memory takes, so few copies are made.
    """
    rows = usable(vectors, id_col, vector_col)
    queries = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    n = max(1, rows.count())
    parts, blocks = -(-n // part), max(1, -(-n // (every * block)))
    left = (rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))))
    key = ["dim", "part", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_search(k, scale), "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
