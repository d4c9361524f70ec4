"""Approximate nearest neighbours by a robust-pruned directed graph.

Vectors are dealt to shards of bounded size by content. In each shard a graph is
built in batches: a greedy beam search from the entry point proposes a vector's
neighbours, and pruning keeps an edge only if no kept neighbour is nearer to its
end by the factor ``alpha``, so that kept edges point in diverse directions;
reverse edges are pruned alike. A query's beam searches every shard and the
shards' finds are ranked by the exact measure. Inner products become
distances by one more component that gives all vectors of a shard one norm.

Copies of a vector are one node: only the smallest ids that could be returned
are kept for each, so copies neither crowd the graph nor the result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written
from .topk import usable

#: Vectors of a shard, queries of a block, and queries that are searched at a time.
SHARD, BLOCK, AT_ONCE = 8192, 16_384, 1024


def _distance(x: np.ndarray, norm: np.ndarray, q: np.ndarray, qn: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each q[i] to x[ids[i]]."""
    return np.maximum(norm[ids] + qn[:, None] - 2 * np.matmul(x[ids], q[:, :, None])[:, :, 0], 0)


def beam_search(x, norm, near, entry: int, q, width: int, wide: int = 4):
    """Nodes and squared distances of each query's beam, nearest first (-1: none).

    ``wide`` unvisited nodes of the beam are opened at a time.
    """
    m, n = len(q), len(x)
    qn = (q * q).sum(1)
    seen = np.zeros((m, n + 1), bool)
    seen[:, n] = True  # the slot of missing neighbours
    beam = np.full((m, width), n, np.int64)
    dist = np.full((m, width), np.inf, np.float32)
    opened = np.ones((m, width), bool)
    start = np.full((m, 1), entry)
    beam[:, 0], dist[:, 0], opened[:, 0] = entry, _distance(x, norm, q, qn, start)[:, 0], False
    seen[:, entry] = True
    live = np.arange(m)
    while len(live):
        d = np.where(opened[live], np.inf, dist[live])
        pick = np.argpartition(d, wide - 1, axis=1)[:, :wide]
        row = live[:, None]
        ok = np.isfinite(np.take_along_axis(d, pick, 1))
        opened[row, pick] = True
        ids = near[np.where(ok, beam[row, pick], n)].reshape(len(live), -1)
        ids.sort(axis=1)
        new = ~seen[row, ids]
        new[:, 1:] &= ids[:, 1:] != ids[:, :-1]
        seen[row, ids] = True
        got = new.sum(1)
        most = int(got.max()) if len(got) else 0
        if most:
            first = np.argsort(~new, axis=1, kind="stable")[:, :most]
            ids = np.where(np.take_along_axis(new, first, 1), np.take_along_axis(ids, first, 1), n)
            fresh = _distance(x, norm, q[live], qn[live], np.minimum(ids, n - 1))
            fresh[ids == n] = np.inf
            both, all_d = np.hstack([beam[live], ids]), np.hstack([dist[live], fresh])
            all_o = np.hstack([opened[live], ids == n])
            top = np.argpartition(all_d, width - 1, axis=1)[:, :width]
            beam[live], dist[live], opened[live] = (np.take_along_axis(v, top, 1) for v in (both, all_d, all_o))
        live = live[(~opened[live] & np.isfinite(dist[live])).any(1)]
    order = np.argsort(dist, axis=1, kind="stable")
    beam, dist = np.take_along_axis(beam, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), beam, -1), dist


def robust_prune(x, norm, at, cand, degree: int, alpha: float) -> np.ndarray:
    """Up to ``degree`` diverse neighbours for each node ``at[i]`` from ``cand[i]`` (n: none); rows padded with n."""
    n = len(x)
    v = x[np.minimum(cand, n - 1)]
    nv = norm[np.minimum(cand, n - 1)]
    d = np.maximum(nv + norm[at][:, None] - 2 * np.matmul(v, x[at][:, :, None])[:, :, 0], 0)
    d[(cand == n) | (cand == at[:, None])] = np.inf
    order = np.argsort(d, axis=1, kind="stable")
    cand, d, v, nv = (np.take_along_axis(cand, order, 1), np.take_along_axis(d, order, 1), np.take_along_axis(v, order[:, :, None], 1), np.take_along_axis(nv, order, 1))
    apart = np.maximum(nv[:, :, None] + nv[:, None, :] - 2 * np.matmul(v, v.transpose(0, 2, 1)), 0) * np.float32(alpha * alpha)
    alive = np.isfinite(d)
    out = np.full((len(at), degree), n, np.int64)
    row = np.arange(len(at))
    for k in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        p = alive.argmax(1)
        out[:, k] = np.where(any_, cand[row, p], n)
        alive &= apart[row, p] > d
        alive[row, p] = False
    return out


def build(x: np.ndarray, degree: int = 32, width: int = 32, alpha: float = 1.2, step: int = 512, seed: int = 5):
    """(neighbours n x degree padded with n, one spare row; entry point) over unique float32 rows."""
    n = len(x)
    rng = np.random.default_rng(seed)
    norm = (x * x).sum(1)
    near = np.full((n + 1, degree), n, np.int64)
    if n > 1:
        k = min(degree // 3, n - 1)
        near[:n, :k] = (np.arange(n)[:, None] + rng.integers(1, n, (n, k))) % n
    entry = int(((x - x.mean(0)) ** 2).sum(1).argmin())
    order = rng.permutation(n)
    for i in range(0, n, step):
        p = order[i : i + step]
        found, _ = beam_search(x, norm, near, entry, x[p], width)
        cand = np.hstack([np.where(found < 0, n, found), near[p]])
        near[p] = robust_prune(x, norm, p, _distinct(cand, n), degree, alpha)
        # Reverse edges: each target's own list and up to ``degree`` new sources, pruned again.
        src, dst = np.repeat(p, degree), near[p].ravel()
        src, dst = src[dst < n], dst[dst < n]
        o = np.argsort(dst, kind="stable")
        src, dst = src[o], dst[o]
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        for turn in range(0, int(place.max()) + 1 if len(place) else 0, degree):
            now = (place >= turn) & (place < turn + degree)
            t, where = np.unique(dst[now], return_inverse=True)
            extra = np.full((len(t), degree), n, np.int64)
            extra[where, place[now] - turn] = src[now]
            for j in range(0, len(t), 1024):
                c = slice(j, j + 1024)
                cand = _distinct(np.hstack([near[t[c]], extra[c]]), n)
                room = (cand < n).sum(1) <= degree
                near[t[c][room]] = cand[room][:, :degree]
                full = ~room
                if full.any():
                    near[t[c][full]] = robust_prune(x, norm, t[c][full], cand[full], degree, alpha)
    return near, entry


def _distinct(ids: np.ndarray, n: int) -> np.ndarray:
    """Rows sorted, repeats replaced by n and moved last."""
    ids = np.sort(ids, axis=1)
    ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = n
    return np.sort(ids, axis=1)


def level(v: np.ndarray) -> np.ndarray:
    """Rows with one more component that makes all norms equal: nearest is then largest inner product."""
    s = (v * v).sum(1)
    return np.hstack([v, np.sqrt(np.maximum(s.max() - s, 0))[:, None]]).astype(np.float32)


def _index(degree: int, width: int, alpha: float):
    def index(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id").reset_index(drop=True)
        v = np.stack(pdf["v"].to_numpy())
        nodes, node = np.unique(v, axis=0, return_inverse=True)
        near, entry = build(level(nodes), degree, width, alpha)
        node = node.ravel()
        first = np.full(len(nodes), len(v), np.int64)
        np.minimum.at(first, node, np.arange(len(v)))
        links = [near[i] if first[i] == r else None for r, i in enumerate(node)]  # once for each node
        return pdf[["dim", "shard", "vec_id", "v"]].assign(node=node, near=links, entry=entry)

    return index


def _find(k: int, width: int):
    def find(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        left = left.sort_values(["node", "vec_id"])
        v, ids, node = np.stack(left["v"].to_numpy()), left["vec_id"].to_numpy(), left["node"].to_numpy()
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1]))
        n = len(first)
        near = np.full((n + 1, len(left["near"].dropna().iloc[0])), n, np.int64)
        own = left[left["near"].notna()]
        near[own["node"].to_numpy()] = np.stack(own["near"].to_numpy())
        x = level(v[first])
        norm = (x * x).sum(1)
        q = np.stack(right["v"].to_numpy())
        qids = right["vec_id"].to_numpy()
        q1 = np.hstack([q, np.zeros((len(q), 1))]).astype(np.float32)
        beam = np.concatenate([beam_search(x, norm, near, int(left["entry"].iloc[0]), q1[i : i + AT_ONCE], width)[0] for i in range(0, len(q1), AT_ONCE)])
        # Members of the nodes found, each scored in double precision.
        r, c = np.nonzero(beam >= 0)
        hit = beam[r, c]
        size = np.diff(np.append(first, len(v)))[hit]
        at = np.repeat(first[hit] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        r = np.repeat(r, size)
        score = (v[at] * q[r]).sum(1)
        keep = ids[at] != qids[r]
        r, at, score = r[keep], at[keep], score[keep]
        order = np.lexsort((ids[at], -score, r))
        r, at, score = r[order], at[order], score[order]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        return pd.DataFrame({"query_id": qids[r[top]], "vec_id": ids[at[top]], "score": score[top]})

    return find


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, degree: int = 32, width: int = 160, build_width: int = 32,
            alpha: float = 1.2, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """For each row whose id is divisible by ``every``, about its k rows of largest inner product.

    Every row is indexed. Returns ``query_id``, ``rank`` (from 1), ``vec_id`` and ``score`` (the
    inner product of the original vectors, in doubles), nearest first, ties to the
    smaller id; a query's own id is left out, and fewer candidates give fewer rows.
    Rows with a null id, and vectors null, empty, zero or with null or non-finite
    components, take no part; vectors of different lengths don't meet. Of copies of one vector
    the k + 1 smallest ids are candidates: no other could be among the k nearest.
    A row given twice is one candidate; of different vectors under one id the least counts. Empty input: no rows.

    A shard's graph is sent once for each ``block`` queries and a query once for each shard, so both are
    as large as a task's memory takes.
    """
    rows = usable(vectors, id_col, vector_col).where(F.exists("v", lambda x: x != 0))
    rows = rows.groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("dim", F.size("v"))
    rows = written(rows, "vectors")
    queries = rows.where(F.col("vec_id") % every == 0)
    copies = F.row_number().over(W.partitionBy("v").orderBy("vec_id"))
    nodes = rows.withColumn("copy", copies).where(F.col("copy") <= k + 1).drop("copy")
    n = max(1, rows.count())
    shards, blocks = -(-n // shard), max(1, -(-n // (every * block)))
    nodes = nodes.withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))
    graph = written(nodes.groupBy("dim", "shard").applyInPandas(
        _index(degree, build_width, alpha), "dim int, shard int, vec_id long, v array<double>, node long, near array<long>, entry long"), "graph")
    left = graph.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = (queries.withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    key = ["dim", "shard", "block"]
    found = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(_find(k, width), "query_id long, vec_id long, score double")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
