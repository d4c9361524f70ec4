"""Inverted pairs and Kendall's tau against all pairs."""

import math
import random

import numpy as np
import pytest

from lexiforge.operators import inversions as I
from lexiforge.operators import stats as S


def naive(points):
    return sum(n * m for x, y, n in points for a, b, m in points if x < a and y > b)


def random_points(rng, n, kinds):
    pick = {"wide": lambda: rng.random(), "few": lambda: float(rng.randrange(4)), "one": lambda: 1.0}
    return [(pick[kinds[0]](), pick[kinds[1]](), rng.randrange(1, 4)) for _ in range(n)]


@pytest.mark.parametrize("kinds", [("wide", "wide"), ("wide", "few"), ("few", "wide"), ("few", "few"), ("one", "wide"), ("wide", "one")])
@pytest.mark.parametrize("share", [7, 1000])
def test_discordant(spark, kinds, share):
    points = random_points(random.Random(share), 150, kinds)
    df = spark.createDataFrame(points, "x double, y double, n long")
    assert int(I.discordant(df, share).first()["d"]) == naive(points)


def test_merging():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 3, 17, 200):
        x, y, w = rng.integers(0, 9, n), rng.integers(0, 9, n), rng.integers(1, 5, n)
        assert I.inverted(x, y, w) == naive(list(zip(x.tolist(), y.tolist(), w.tolist())))
    big = np.array([2**40, 2**41, 2**42])
    assert I.inverted(np.array([1, 2, 3]), np.array([3, 2, 1]), big) == 2**81 + 2**82 + 2**83


def tau(rows):
    rows = [(x, y) for x, y in rows if x is not None and y is not None]
    n = len(rows)
    s = tx = ty = 0
    for i in range(n):
        for j in range(i):
            a, b = rows[i][0] - rows[j][0], rows[i][1] - rows[j][1]
            s += (a * b > 0) - (a * b < 0)
            tx += a == 0
            ty += b == 0
    n0 = n * (n - 1) / 2
    return n, s / math.sqrt((n0 - tx) * (n0 - ty))


def test_kendall(spark, monkeypatch):
    monkeypatch.setattr(I.discordant, "__defaults__", (40,))
    rng = random.Random(8)
    rows = [(rng.choice([None, *map(float, range(30))]), rng.random() if k % 3 else float(k % 5)) for k in range(300)] + [(1.0, 2.0)] * 40
    got = S.correlation(spark.createDataFrame(rows, "x double, y double"), "x", "y", "kendall").first()
    n, r = tau(rows)
    assert got["n"] == n and math.isclose(got["r"], r, rel_tol=1e-12)


def test_kendall_without_points(spark):
    df = spark.createDataFrame([(1.0, None)], "x double, y double")
    assert tuple(S.correlation(df, "x", "y", "kendall").first()) == (0, None)
    same = spark.createDataFrame([(1.0, 2.0)] * 5, "x double, y double")
    assert S.correlation(same, "x", "y", "kendall").first()["r"] is None
