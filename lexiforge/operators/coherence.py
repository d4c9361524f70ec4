"""How well the top words of topics belong together, by documents or by sliding windows.

A window of ``size`` words slides over each document a word at a time (a shorter document is one window). A word at
place p stands in the windows that begin at p - size + 1 to p, an interval whose ends only grow with p. So the windows
that hold any of some words are a union of intervals in order, whose length follows from each place and the one
before; windows that hold two words follow from those with one and with either. No window is ever made.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from .lineage import cut

#: Windows of the two windowed measures; a window as long as any document counts documents.
NPMI_WINDOW, CV_WINDOW, WHOLE = 10, 110, 2_000_000_000
#: Top words at most; a topic model has some for each topic.
MOST = 20_000
#: Pairs, or places of pairs, that a worker holds at a time (one pair at least).
STEP = 1 << 19
EPS = 1e-12


def _slices(sizes) -> Iterator[tuple[int, int]]:
    """Ranges of items in order, each of ``STEP`` in sum at most or of one item."""
    import numpy as np

    ends, i = np.cumsum(sizes), 0
    while i < len(ends):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + STEP, "right")))
        yield i, j
        i = j


def _ranges(starts, sizes):
    """``start, start + 1, ..`` for each of some ranges, one behind the other."""
    import numpy as np

    return np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)


def _covered(places, firsts, last, size: int):
    """Windows that hold one of a group's places at least, for each group; places ascend in a group, ``firsts`` are where groups begin."""
    import numpy as np

    high = np.minimum(places, last)
    low = np.empty_like(high)
    low[1:] = high[:-1] + 1
    low[firsts] = 0
    return np.add.reduceat(np.maximum(high - np.maximum(low, places - size + 1) + 1, 0), firsts)


def _pair_counts(words: list[str], classes: list[list[int]], size: int) -> Callable:
    """A mapInArrow function: token lists to rows ``(a, b, n)``, windows with both words of a pair of a class, and without words all windows."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        k, names = len(words), pa.array(words, pa.string())
        member = sorted((w, c) for c, ws in enumerate(classes) for w in ws)
        of, begins = np.array([c for _, c in member], np.int64), np.searchsorted([w for w, _ in member], np.arange(k + 1))
        several = len(member) > k

        def rows(a, b, n):
            return pa.RecordBatch.from_arrays([names.take(pa.array(a)), names.take(pa.array(b)), pa.array(n, pa.int64())], ["a", "b", "n"])

        def summed(key, n):
            key, at = np.unique(key, return_inverse=True)
            out = np.zeros(len(key), np.int64)
            np.add.at(out, at, n)
            return rows(key // k, key % k, out)

        for batch in batches:
            tokens = batch.column(0)
            ends = np.cumsum(pc.list_value_length(tokens).to_numpy(zero_copy_only=False), dtype=np.int64)
            if not len(ends):
                continue
            length = np.diff(ends, prepend=0)
            last = np.maximum(length - size, 0)
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.array([int((last + 1).sum())], pa.int64())], ["a", "b", "n"])
            flat = tokens.flatten()
            found = pc.index_in(flat, value_set=names.cast(flat.type))
            held = np.flatnonzero(found.is_valid().to_numpy(zero_copy_only=False))
            if not len(held):
                continue
            word = found.drop_null().to_numpy().astype(np.int64)
            doc = np.searchsorted(ends, held, "right")
            # Places by document and word; of a document of one window each word's first.
            key = doc * k + word
            order = np.argsort(key, kind="stable")
            key, place = key[order], (held - (ends - length)[doc])[order]
            wide = last[key // k] > 0
            kept = wide | (np.diff(key, prepend=-1) != 0)
            key, place, wide = key[kept], place[kept], wide[kept]
            # A run is a word of a document.
            start = np.flatnonzero(np.diff(key, prepend=-1))
            doc, word, wide = key[start] // k, key[start] % k, wide[start]
            many = np.diff(start, append=len(key))
            one = _covered(place, start, np.repeat(last[doc], many), size)
            yield summed(word * k + word, one)
            # Each run in each class of its word, by run, and its place by document and class, where its partners follow it.
            times = begins[word + 1] - begins[word]
            run_, class_ = np.repeat(np.arange(len(start)), times), of[_ranges(begins[word], times)]
            group = doc[run_] * len(classes) + class_
            by_group = np.argsort(group, kind="stable")
            ordered = group[by_group]
            at = np.empty_like(by_group)
            at[by_group] = np.arange(len(at))
            partners = np.searchsorted(ordered, group, "right") - at - 1
            of_run = np.cumsum(times) - times
            for i, j in _slices(np.add.reduceat(partners, of_run)):
                part = slice(of_run[i], of_run[j] if j < len(of_run) else len(run_))
                left, right = np.repeat(run_[part], partners[part]), run_[by_group[_ranges(at[part] + 1, partners[part])]]
                if several:  # a pair of two classes counts once
                    left, right = np.divmod(np.unique(left * len(start) + right), len(start))
                if not len(left):
                    continue
                both = np.ones(len(left), np.int64)  # the one window of a document holds all its words
                longer = np.flatnonzero(wide[left])
                for x, y in _slices((many[left] + many[right])[longer]):
                    pair = longer[x:y]
                    l, r = left[pair], right[pair]
                    n = many[l] + many[r]
                    firsts = np.cumsum(n) - n
                    base = int(place.max()) + 1
                    merged = np.concatenate([place[_ranges(start[l], many[l])] + np.repeat(np.arange(len(l)), many[l]) * base, place[_ranges(start[r], many[r])] + np.repeat(np.arange(len(l)), many[r]) * base])
                    merged.sort()
                    either = _covered(merged - np.repeat(np.arange(len(l)), n) * base, firsts, np.repeat(last[doc[l]], n), size)
                    both[pair] = one[l] + one[r] - either
                yield summed(word[left] * k + word[right], both)

    return run


def window_counts(docs: DataFrame, tops: DataFrame, size: int, text: str = "text") -> DataFrame:
    """``(a, b, n, total)``: windows that hold both words, for all pairs a < b of a class's words (a = b: the word itself).

    Every pair has a row, also those that never meet. ``tops(class, word)`` is a bounded list: it is sent to the workers.
    Rows are counted each for itself, so ids don't matter; null texts are empty documents.
    """
    listed = tops.where("class is not null and word is not null")
    words = sorted(r[0] for r in listed.select("word").distinct().limit(MOST + 1).collect())
    if len(words) > MOST:
        raise ValueError(f"more than {MOST} top words")
    place, classes = {w: i for i, w in enumerate(words)}, defaultdict(list)
    for c, w in listed.select("class", "word").distinct().collect():
        classes[c].append(place[w])
    a, b = listed.select("class", F.col("word").alias("a")), listed.select("class", F.col("word").alias("b"))
    wanted = a.join(b, "class").where("a <= b").select("a", "b").distinct()
    seen = docs.select(X.tokens(F.col(text)).alias("ws")).mapInArrow(_pair_counts(words, list(classes.values()), size), "a string, b string, n long")
    found = cut(seen.groupBy("a", "b").agg(F.sum("n").alias("n")))  # a row for each pair: read several times, counted once
    total = found.where("a is null").agg(F.sum("n").alias("total"))
    return wanted.join(found, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).alias("n")).crossJoin(F.broadcast(total))  # total: one row


def _npmi(both: Column, a: Column, b: Column, total: Column) -> Column:
    p = both / total + EPS
    return F.log(p / ((a / total) * (b / total))) / -F.log(p)


def pair_table(tops: DataFrame, counts: DataFrame) -> DataFrame:
    """``(class, i, j, n, n_i, n_j, total)`` for all ordered pairs of words of a class that occur at all, a word with itself included."""
    either = counts.unionByName(counts.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "total"))
    single = counts.where("a = b and n > 0").select(F.col("a").alias("w"), F.col("n").alias("m"))
    words = tops.select("class", "word", "rank").join(single, F.col("word") == F.col("w")).drop("w")
    left = words.select("class", F.col("word").alias("a"), F.col("rank").alias("i"), F.col("m").alias("n_i"))
    right = words.select("class", F.col("word").alias("b"), F.col("rank").alias("j"), F.col("m").alias("n_j"))
    return left.join(right, "class").join(either, ["a", "b"])


def u_mass(tops: DataFrame, counts: DataFrame) -> DataFrame:
    """``(class, pairs, u_mass)``: mean of ln((D(i, j) / D + eps) / (D(j) / D)) over words i and words j ranked before, by documents."""
    value = F.log((F.col("n") / F.col("total") + EPS) / (F.col("n_j") / F.col("total")))
    return pair_table(tops, counts).where("j < i").groupBy("class").agg(F.count("*").alias("pairs"), F.avg(value).alias("u_mass"))


def c_npmi(tops: DataFrame, counts: DataFrame) -> DataFrame:
    """``(class, pairs, npmi)``: mean normalised pointwise mutual information of a topic's pairs."""
    value = _npmi(F.col("n"), F.col("n_i"), F.col("n_j"), F.col("total"))
    return pair_table(tops, counts).where("j < i").groupBy("class").agg(F.count("*").alias("pairs"), F.avg(value).alias("npmi"))


def c_v(tops: DataFrame, counts: DataFrame) -> DataFrame:
    """``(class, words, c_v)``: mean cosine of each word's vector of NPMI with all words of its topic, and the sum of these vectors."""
    value = _npmi(F.col("n"), F.col("n_i"), F.col("n_j"), F.col("total"))
    cells = pair_table(tops, counts).select("class", "i", "j", value.alias("x"))
    sums = cells.groupBy("class", "j").agg(F.sum("x").alias("s"))
    rows = cells.join(sums, ["class", "j"]).groupBy("class", "i").agg(
        F.try_divide(F.sum(F.col("x") * F.col("s")), F.sqrt(F.sum(F.col("x") * F.col("x"))) * F.sqrt(F.sum(F.col("s") * F.col("s")))).alias("cosine"))
    return rows.groupBy("class").agg(F.count("*").alias("words"), F.avg(F.coalesce("cosine", F.lit(0.0))).alias("c_v")).where("words > 1")


def fixed(tops: DataFrame) -> DataFrame:
    """The top words as a table of values, so that what weighs them runs once; they are a few for each topic."""
    rows = tops.select("class", "word", "rank").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} top words")
    return tops.sparkSession.createDataFrame(rows, tops.select("class", "word", "rank").schema)


def coherence(docs: DataFrame, tops: DataFrame, text: str = "text") -> DataFrame:
    """All three measures of each class of ``tops(class, word, rank)``: ``(class, u_mass, npmi, c_v)``.

    Words that never occur are left out; a class needs two that do, else it has no row. Pairs that never meet count with
    their smoothed value. ``tops`` is evaluated once.
    """
    tops = fixed(tops)
    out = u_mass(tops, window_counts(docs, tops, WHOLE, text)).drop("pairs")
    out = out.join(c_npmi(tops, window_counts(docs, tops, NPMI_WINDOW, text)).drop("pairs"), "class")
    return out.join(c_v(tops, window_counts(docs, tops, CV_WINDOW, text)).drop("words"), "class")
