"""The Pitman-Yor model against plain counts, an enumeration of seatings, and held-out texts."""

import math
import random
import re
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiforge.llm import pitman_yor as P


def tokens(text):
    return re.findall("[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) + ["</s>"]


def one_table_each(rows, strength=0.5):
    """Scores where every dish has one table: the model before any sampling."""
    pairs, words = Counter(), Counter()
    for _, held, text in rows:
        if not held:
            t = tokens(text)
            words.update(t)
            pairs.update(zip(["<s>", *t], t))
    n, v = sum(words.values()), len(words)
    sent, context, kinds = Counter(w for _, w in pairs), Counter(), Counter()
    for (a, _), c in pairs.items():
        context[a] += c
        kinds[a] += 1

    def discount(counts):
        ones, twos = (sum(c == k for c in counts.values()) for k in (1, 2))
        return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    d, e, total = discount(pairs), discount(sent), sum(sent.values())

    def parent(w):
        return (sent[w] - e * (w in sent) + (strength + e * v) / (v + 1)) / (strength + total)

    def p(a, w):
        if a not in context:
            return parent(w)
        return (pairs[a, w] - d * ((a, w) in pairs) + (strength + d * kinds[a]) * parent(w)) / (strength + context[a])

    out = []
    for i, held, text in rows:
        t = tokens(text)
        out.append((i, bool(held), len(t), sum(w in words for w in t), n, sum(math.log10((words[w] + 1) / (n + v + 1)) for w in t), sum(math.log10(p(a, w)) for a, w in zip(["<s>", *t], t))))
    return out, p, words


def corpus(n=150, seed=2):
    rng = random.Random(seed)
    vocab = ["a", "B", "the", "the", "the", "of", "é", "漢字", "x.", *(f"w{k}" for k in range(60))]
    rows = [(k, rng.random() < 0.2, " ".join(rng.choice(vocab) for _ in range(rng.randrange(40)))) for k in range(n)]
    return rows + [(n, False, None), (n + 1, True, ""), (n + 2, None, "the the the the"), (None, False, "the of\n\tthe"), (3, False, "A b"), (3, False, "A b"), (n + 3, False, "the of " * 4000)]


def table(spark, rows, parts=5):
    return spark.createDataFrame([(i, h, t, 0) for i, h, t in rows], "doc_id long, held boolean, text string, score int").repartition(parts)


def close(got, want):
    got, want = (sorted(x, key=lambda r: (str(r[0]), *r[1:])) for x in (got, want))
    assert [tuple(r[:5]) for r in got] == [tuple(r[:5]) for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9)


def test_counts_and_probabilities(spark):
    """Without sampling the whole exchange equals plain Python, very frequent contexts included."""
    rows = corpus()
    want, p, words = one_table_each(rows)
    close([tuple(r) for r in P.score_texts(table(spark, rows), F.col("held"), rounds=0).collect()], want)
    assert abs(sum(p("the", w) for w in words) + p("the", "unseen") - 1) < 1e-9


def test_small_book(spark, monkeypatch):
    """Words without a code are sent whole."""
    monkeypatch.setattr(P, "BOOK", 2)
    rows = corpus(60, 4)
    close([tuple(r) for r in P.score_texts(table(spark, rows, 3), F.col("held"), rounds=0, sweeps=1, burn=0).collect()], one_table_each(rows)[0])


def test_sampling_lowers_perplexity_and_repeats(spark):
    rng = random.Random(1)
    after = {w: [rng.choice(range(40)) for _ in range(3)] for w in range(40)}
    rows = []
    for k in range(300):
        w, text = rng.randrange(40), []
        for _ in range(30):
            text.append(f"w{w}")
            w = rng.choice(after[w]) if rng.random() < 0.9 else rng.randrange(40)
        rows.append((k, k % 7 == 2, " ".join(text)))
    docs = table(spark, rows)
    got = {r.doc_id: r for r in P.score_texts(docs, F.col("held")).collect()}
    held = [r for r in got.values() if r.held_out]
    n = sum(r.n_tokens for r in held)
    perplexity, base = (10 ** (-sum(r[c] for r in held) / n) for c in ("score", "base_score"))
    assert perplexity < 0.4 * base
    again = {r.doc_id: r for r in P.score_texts(docs, F.col("held")).collect()}
    assert got == again


def test_empty_and_untrained(spark):
    assert P.score_texts(table(spark, []), F.col("held")).count() == 0
    rows = P.score_texts(table(spark, [(1, True, "a b"), (2, True, None)]), F.col("held")).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in rows) == [(1, 3, 0, 0, 0.0, 0.0), (2, 1, 0, 0, 0.0, 0.0)]


def exact_tables(c, other, base, d, s):
    """Distribution of one dish's tables, by listing who joins whom (other: tables of the restaurant's other dishes)."""
    weight = defaultdict(float)

    def sit(k, sizes, w):
        if k == c:
            weight[len(sizes)] += w
            return
        for i in range(len(sizes)):
            sit(k + 1, sizes[:i] + [sizes[i] + 1] + sizes[i + 1 :], w * (sizes[i] - d))
        sit(k + 1, sizes + [1], w * (s + d * (other + len(sizes))) * base)

    sit(0, [], 1.0)
    z = sum(weight.values())
    return [weight[t] / z for t in range(1, c + 1)]


@pytest.mark.parametrize("c,other,base", [(2, 0, 0.3), (3, 4, 0.1), (6, 2, 0.4)])
def test_seating_is_the_posterior(c, other, base):
    k, d, s = 40_000, 0.6, 0.5
    t = P.seat(np.full(k, c), np.arange(k), np.full(k, other), np.ones(k, bool), np.full(k, base), d, s, 40, np.random.default_rng(3))
    assert np.abs(np.bincount(t, minlength=c + 1)[1:] / k - exact_tables(c, other, base, d, s)).max() < 0.012


def mean_tables(c, other, base, d, s, most=200):
    """Mean number of tables of a dish by the recurrence of generalised Stirling numbers."""
    t = np.arange(most)
    log = np.full(most, -np.inf)
    log[1] = 0.0
    for n in range(1, c):
        stay = np.log(np.maximum(n - d * t, 1e-300)) + log
        log = np.logaddexp(stay, np.concatenate([[-np.inf], log[:-1]]))
    opened = np.cumsum(np.concatenate([[0.0], np.log((s + d * (other + t[:-1])) * base)]))
    w = np.exp(log + opened - (log + opened).max())
    return float((w * t).sum() / w.sum())


@pytest.mark.parametrize("c,k,rounds", [(10, 4000, 400), (60, 2000, 300), (400, 300, 300), (5000, 60, 300)])
def test_seating_of_large_dishes(c, k, rounds):
    """Blocks of customers have the posterior's mean number of tables, up to their not seeing each other."""
    got = P.seat(np.full(k, c), np.arange(k), np.full(k, 30), np.ones(k, bool), np.full(k, 0.05), 0.5, 0.5, rounds, np.random.default_rng(c)).mean()
    want = mean_tables(c, 30, 0.05, 0.5, 0.5)
    assert abs(got / want - 1) < (0.03 if c < 16 else 0.2), (got, want)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    book = np.unique(rng.integers(0, 2**63, 50).astype(np.uint64))
    for name in (rng.choice(book, 200), rng.integers(0, 2**63, 30).astype(np.uint64), np.concatenate([book[:5], [np.uint64(7)], book[5:9]])):
        edges = np.array([0, len(name) // 3, len(name)])
        for b in (book, book[:0]):
            back, per = P.decoded(*P.coded(name, b, edges), b)
            assert (back == name).all() and per.tolist() == np.diff(edges).tolist()


def test_enumeration_is_a_distribution():
    assert all(abs(sum(exact_tables(c, o, 0.2, 0.5, 1.0)) - 1) < 1e-12 for c, o in product((1, 4), (0, 3)))
