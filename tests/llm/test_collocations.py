"""Collocations against a count of all phrases in plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lexiforge.llm import collocations as C
from lexiforge.llm import packed


def counted(rows, least, longest=4, covered=80, most=2000):
    f, n = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            ws = re.findall("[^ \t]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                for i in range(len(ws) - k + 1):
                    f[lang, tuple(ws[i : i + k])] += 1
    found = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        cuts = [(2_000_000 * a // (f[lang, p[:k]] + f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(cuts)
        hidden = any(z[0] == lang and len(z[1]) > len(p) and 100 * g >= covered * a and any(z[1][i : i + len(p)] == p for i in range(len(z[1]) - len(p) + 1)) for z, g in found.items())
        if not hidden:
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), f[lang, p[:k]], f[lang, p[k:]]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for i, (s, a, p, l, r) in enumerate(sorted(rows)[:most]))


def corpus():
    rng = random.Random(3)
    words = ["a", "B", "New", "york", "é漢", "the", "x-y", "'", " z"]
    gaps = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\r\n", ";", "!?"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60)))) for _ in range(300)]
    rows += [("en", None), ("en", ""), (None, "..., ;"), ("fr", "only words, here"), ("en", "New york the a " * 3000)] + rows[:20]
    return rows


@pytest.mark.parametrize("least,longest,covered,most", [(3, 4, 80, 2000), (5, 3, 50, 20), (2, 2, 80, 7)])
def test_against_count(spark, least, longest, covered, most):
    rows = corpus()
    docs = spark.createDataFrame([(t, 0, x, 1) for x, t in rows], "text string, name int, lang string, n int").repartition(6)
    got = sorted(tuple(r) for r in C.collocations(docs, least, longest, covered, most).collect())
    assert got == counted(rows, least, longest, covered, most)


def test_small_runs_and_no_broadcast(spark, monkeypatch):
    """Same rows where each task has many runs, every word is heavy or none is broadcast."""
    rows = corpus()
    docs = spark.createDataFrame([(t, x) for x, t in rows], "text string, lang string").repartition(3)
    want = counted(rows, 4)
    monkeypatch.setattr(C, "FEW", 3)
    monkeypatch.setattr(C, "BOOK", 4)
    assert sorted(tuple(r) for r in C.collocations(docs, 4).collect()) == want


def test_messages_keep_every_pair():
    rng = np.random.default_rng(1)
    l, r = rng.integers(0, 9, 5000).astype(np.uint64), rng.integers(0, 9, 5000).astype(np.uint64)
    for first, heavy, book in ((0, np.zeros(0, np.uint64), np.zeros(0, np.uint64)), (1 << 25, np.array([2, 3], np.uint64), np.array([0, 4, 5], np.uint64))):
        at = first + np.arange(5000, dtype=np.uint32)
        m = C.pair_messages(l, r, at, 7, 5, heavy, book)
        left = np.repeat(packed.decoded(m.column("a"), m.column("f"), book)[0], packed.joined(m.column("b"), np.uint32)[0])
        right, n = packed.decoded(m.column("c"), m.column("g"), book)[0], packed.joined(m.column("d"), np.uint32)[0]
        raw = packed.joined(m.column("e"), np.uint8)[0]
        where = packed.from_three(raw) if m.column("n")[0].as_py() == 3 else raw.view(np.uint32)
        assert sorted(zip(np.repeat(left, n), np.repeat(right, n), where)) == sorted(zip(l, r, at))
        assert len(set(zip(left, right))) == len(left)  # one range a pair


def test_empty(spark):
    for rows in ([], [(None, None), ("en", " ,. ")]):
        assert C.collocations(spark.createDataFrame(rows, "lang string, text string")).count() == 0


def test_score_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    big = 2**61
    row = spark.range(1).select(C._lowest([(F.lit(big + 2), F.lit(big)), (F.lit(big), F.lit(big + 3))], F.lit(big)).alias("x")).first().x
    assert (row.score, row.cut) == min((2_000_000 * big // (2 * big + 2), 1), (2_000_000 * big // (2 * big + 3), 2))
