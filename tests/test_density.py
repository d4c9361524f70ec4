"""Density clusters and neighbour lists against plain versions over all pairs."""

import numpy as np
import pytest

from lexiforge.operators import density as D
from lexiforge.operators.neighbours import neighbour_lists


def _points(seed, sizes, dims=2):
    rng = np.random.default_rng(seed)
    parts = [rng.normal(rng.uniform(-8, 8, dims), rng.uniform(0.2, 1.0), (n, dims)) for n in sizes]
    return np.vstack([*parts, rng.uniform(-10, 10, (12, dims))])


def _frame(spark, x):
    return spark.createDataFrame([(i, [float(f) for f in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")


def plain_clusters(x, least):
    """The tree of all pairs, cut from the top: {row: (cluster, strength)} without outliers."""
    n = len(x)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, least]
    links = sorted((max(d[a, b], core[a], core[b]), a, b) for a in range(n) for b in range(a + 1, n))
    find, tree = {i: (i,) for i in range(n)}, {}
    for w, a, b in links:
        ga, gb = find[a], find[b]
        if ga != gb:
            both = tuple(sorted(ga + gb))
            tree[both] = (ga, gb, w)
            for i in both:
                find[i] = both

    def walk(rows, birth):
        """(own excess, best excess, chosen clusters) of the cluster that begins as ``rows``."""
        begun, left, lam = rows, {}, 0.0
        while True:
            one, two, w = tree[rows]
            lam = 1 / max(w, 1e-9)
            if len(one) >= least and len(two) >= least:
                kids = [walk(one, lam), walk(two, lam)]
                own = sum(v - birth for v in left.values()) + len(rows) * (lam - birth)
                inner = {i: v for k in kids for i, v in k[3].items()}
                best = sum(k[1] for k in kids)
                chosen = [c for k in kids for c in k[2]]
                break
            for part in (one, two):
                if len(part) < least:
                    left.update(dict.fromkeys(part, lam))
            rows = max(one, two, key=len)
            if len(rows) < least:
                own, inner, best, chosen = sum(v - birth for v in left.values()), {}, 0.0, []
                break
        times = inner | left
        if own >= best and birth > 0:
            return own, own, [(begun, lam)], times
        return own, max(own, best), chosen, times

    _, _, chosen, times = walk(tuple(range(n)), 0.0)
    return {i: (min(rows), min(times[i], lam) / lam) for rows, lam in chosen for i in rows}


@pytest.mark.parametrize("seed,sizes,least", [(1, (40, 30, 25), 5), (2, (60, 20), 4)])
def test_clusters(spark, seed, sizes, least):
    x = _points(seed, sizes)
    got = {r.vec_id: (r.cluster, r.strength) for r in D.density_clusters(_frame(spark, x), least, links=len(x) - 1).collect()}
    want = plain_clusters(x, least)
    assert len(set(c for c, _ in want.values())) >= 2 and len(want) < len(x)
    for i in range(len(x)):
        c, s = want.get(i, (-1, 0.0))
        assert got[i] == (c, pytest.approx(s, rel=1e-9)), i


def test_neighbours(spark):
    x = _points(3, (50, 40), 3).round(1)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    want = {(i, r + 1): j for i in range(len(x)) for r, j in enumerate(sorted((j for j in range(len(x)) if j != i), key=lambda j: (d[i, j], j))[:5])}
    got = {(r.id, r["rank"]): r.other for r in neighbour_lists(_frame(spark, x), 5, block=16, cells=6).collect()}
    assert got == want


def test_rows_without_vectors_repeated_and_equal_rows(spark):
    rows = [(i, [0.0, 0.0]) for i in range(6)] + [(i, [9.0, float(i) / 50]) for i in range(6, 14)]
    rows += [(20, None), (21, [1.0, None]), (22, [float("nan"), 0.0]), (23, []), (6, [9.0, 6.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "2 as cluster")
    got = {r.vec_id: r.cluster for r in D.density_clusters(df, 4, links=3).collect()}
    assert got == {i: 0 for i in range(6)} | {i: 6 for i in range(6, 14)} | {i: -1 for i in range(20, 24)}
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")
    assert D.density_clusters(empty, 4).collect() == []
