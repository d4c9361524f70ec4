"""Coherence by hand, and window counts against windows that really slide."""

import math
import random
import time
from collections import Counter
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiforge.operators import coherence as C


def slid(texts, words, size):
    """Counts of windows that hold both words, by making each window."""
    out, total = Counter(), 0
    for ws in texts:
        for s in range(max(len(ws) - size + 1, 1)):
            window = set(ws[s : s + size]) & set(words)
            total += 1
            out.update(combinations_with_replacement(sorted(window), 2))
    return out, total


@pytest.mark.parametrize("size", [1, 2, 3, 7, 10, 110, C.WHOLE])
def test_window_counts(spark, size):
    rng = random.Random(size)
    words = ["aaa", "bbb", "ccc", "ddd", "never"]
    texts = [[rng.choice(["aaa", "bbb", "ccc", "ddd", "xxx", "yyy", "zzz"]) for _ in range(rng.choice([0, 1, 2, 5, 9, 30, 140]))] for _ in range(60)] + [["aaa"] * 200]
    docs = spark.createDataFrame([(1, " ".join(t)) for t in texts] + [(1, None)], "doc_id int, text string").repartition(4)
    tops = spark.createDataFrame([("t", w, i) for i, w in enumerate(words)], "class string, word string, rank int")
    got = {(r.a, r.b): (r.n, r.total) for r in C.window_counts(docs, tops, size).collect()}
    want, total = slid([*texts, []], words, size)
    assert got == {p: (want[p], total) for p in combinations_with_replacement(sorted(words), 2)}


def test_by_hand(spark):
    """Two halves that never meet: four documents, words of one half always together."""
    docs = spark.createDataFrame([("one two",), ("one two",), ("red blue",), ("red blue",)], "text string")
    tops = spark.createDataFrame([("mixed", w, i) for i, w in enumerate(["one", "two", "red", "blue", "absent"])] + [("pure", "one", 1), ("pure", "two", 2), ("alone", "one", 1), ("alone", "none", 2)],
                                 "class string, word string, rank int")
    got = {r["class"]: r for r in C.coherence(docs, tops).collect()}
    assert set(got) == {"mixed", "pure"}
    # p(word) = 1/2; a pair of one half has p = 1/2 and NPMI 1, one of both halves p = 0 and NPMI ln(4e-12) / -ln(1e-12)
    apart = math.log(1e-12 / 0.25) / -math.log(1e-12)
    assert math.isclose(got["mixed"].npmi, (2 * 1 + 4 * apart) / 6, rel_tol=1e-9)
    assert math.isclose(got["mixed"].u_mass, (2 * 0 + 4 * math.log(1e-12 / 0.5)) / 6, rel_tol=1e-9)
    assert math.isclose(got["pure"].npmi, 1, rel_tol=1e-9) and math.isclose(got["pure"].u_mass, 0, abs_tol=1e-9)
    # each word's vector is (1, 1, apart, apart) up to its order, their sum (2 + 2 apart) in each place
    v, s = [1, 1, apart, apart], 2 + 2 * apart
    cosine = sum(x * s for x in v) / (math.sqrt(sum(x * x for x in v)) * math.sqrt(4 * s * s))
    assert math.isclose(got["mixed"].c_v, cosine, rel_tol=1e-6) and math.isclose(got["pure"].c_v, 1, rel_tol=1e-9)


def test_repeated_words_and_empty(spark):
    docs = spark.createDataFrame([], "text string")
    tops = spark.createDataFrame([("t", "aaa", 1), ("t", "bbb", 2)], "class string, word string, rank int")
    assert C.coherence(docs, tops).count() == 0
    assert C.window_counts(docs, tops, 5).agg(F.sum("n")).first()[0] == 0


def test_long_texts_of_top_words(spark):
    """Time follows the places of top words, also where texts have thousands; a pair of two classes counts once; small steps change nothing."""
    rng = random.Random(5)
    words = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(40)]
    texts = [[rng.choice([*words, "other"]) for _ in range(12_000)] for _ in range(12)]
    docs = spark.createDataFrame([(" ".join(t),) for t in texts], "text string").repartition(4)
    tops = spark.createDataFrame([(c, w, i) for c in "xy" for i, w in enumerate(words[: 40 if c == "x" else 20])] + [(None, "other", 1)], "class string, word string, rank int")
    began = time.monotonic()
    got = {(r.a, r.b): (r.n, r.total) for r in C.window_counts(docs, tops, 110).collect()}
    took = time.monotonic() - began
    held = []  # for each word whether each window of each text holds it
    for w in words:
        ends = [np.cumsum([0, *(t == w for t in text)]) for text in texts]
        held.append(np.concatenate([e[110:] - e[:-110] > 0 for e in ends]))
    assert got == {(words[i], words[j]): (int((held[i] & held[j]).sum()), 12 * 11_891) for i, j in combinations_with_replacement(range(40), 2)}
    assert took < 45, took


@pytest.mark.parametrize("step", [1, 7, 1000])
def test_small_steps(step, monkeypatch):
    rng = random.Random(step)
    words = ["aaa", "bbb", "ccc", "ddd"]
    texts = [[rng.choice([*words, "xxx"]) for _ in range(rng.choice([0, 1, 5, 40]))] for _ in range(30)]
    monkeypatch.setattr(C, "STEP", step)
    want, total = slid(texts, words, 10)
    got, everything = Counter(), 0
    for out in C._pair_counts(words, [[0, 1, 2, 3], [1, 2]], 10)([pa.record_batch([pa.array(texts, pa.list_(pa.string()))], ["ws"])]):
        for r in out.to_pylist():
            if r["a"] is None:
                everything += r["n"]
            else:
                got[r["a"], r["b"]] += r["n"]
    assert everything == total and {p: n for p, n in got.items() if n} == {p: n for p, n in want.items() if n}
