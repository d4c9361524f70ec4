"""Phrase collocation mining by hierarchical pair naming.

A word's name is a hash. A phrase of k words is the pair of the names of its first and its last k-1 words, both
frequent: neighbouring names in a text are replaced by the name of their pair wherever the
pair is frequent over all texts, which one exchange decides. The pair is also the phrase's two parent pointers:
cuts and subsumption are joins along them and never look at a text again.

One exchange: every run of texts sends each range of pairs its distinct pairs with counts and positions in one packed row
(packed.py); a range adds up what all runs sent and sends each run the positions of its frequent pairs, now one name each.
A hot pair has one entry for each run, however often it occurs. Pairs are dealt by their left name, so that it is
sent once; those of very frequent words by both names. Every exchange ends in a written table, so lost executors
cost one exchange at most.
"""

from __future__ import annotations

import json
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import LOWER, chunks, forget, mixed, releasing, running, span_hash, written
from .packed import BOOK, RUN, among, arrays, coded, decoded, firsts, from_three, gathered, joined, n_ranges, numbered, order_of, pieces, range_of, swept, three_bytes

#: Frequent words that are broadcast at most (8 bytes each); with more, words aren't filtered before their pairs are.
FEW = 500_000
#: Rows of a language are ranked in so many parts before the parts' best are.
PARTS = 200
MESSAGE = pa.schema([("kind", pa.int32()), ("dst", pa.int32()), ("src", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), *[(c, pa.binary()) for c in "abcdefg"]])
MESSAGE_SQL = "kind int, dst int, src long, lang string, n long, a binary, b binary, c binary, d binary, e binary, f binary, g binary"
SETTLED = pa.schema([("kind", pa.int32()), ("src", pa.int64()), ("lang", pa.string()), ("word", pa.string()), *[(c, pa.int64()) for c in ("name", "l", "r", "f")], *[(c, pa.binary()) for c in "abc"]])
SETTLED_SQL = "kind int, src long, lang string, word string, name long, l long, r long, f long, a binary, b binary, c binary"
TOTAL, WORD, PAIR, KEPT = range(4)

NO_BOOK = np.zeros(0, np.uint64)
_BREAK, _BLANK = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[[*b".,;:!?", *range(10, 14)]] = True
_BLANK[[32, 9]] = True


def _table(schema: pa.Schema, rows: int, **columns) -> pa.Table:
    """Columns by name; numbers are repeated, absent ones null."""
    out = []
    for f in schema:
        v = columns.get(f.name)
        out.append(pa.nulls(rows, f.type) if v is None else pa.array(np.full(rows, v), f.type) if isinstance(v, (int, np.integer)) else v if isinstance(v, pa.Array) else pa.array(v, f.type))
    return pa.Table.from_arrays(out, schema=schema)


def _salt(lang: str) -> np.uint64:
    raw = np.frombuffer(lang.encode() + b"\0", np.uint8)
    return mixed(span_hash(running(raw), np.zeros(1, np.int64), np.array([len(raw)])))[0]


def words_of(data: np.ndarray, off: np.ndarray, salt: np.ndarray):
    """(names, starts, ends, texts, positions) of all words of a run.

    ``salt`` is a hash of each text's language, on which names depend. Positions grow by one
    within a piece and by two between pieces, so that neighbours in a piece, and only they, differ by one.
    """
    stop = _BREAK[data]
    mark = ~(stop | _BLANK[data])
    before, after = np.zeros_like(mark), np.zeros_like(mark)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    filled = np.flatnonzero(off[1:] > off[:-1])
    before[off[filled]] = False
    after[off[filled + 1] - 1] = False
    start, end = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    text = np.searchsorted(off, start, "right") - 1
    breaks = np.concatenate([[0], np.cumsum(stop)])
    step = np.ones(len(start), np.int64)
    step[1:] += (breaks[start[1:]] > breaks[end[:-1]]) | (text[1:] != text[:-1])
    name = mixed(span_hash(running(data), start, end) ^ salt[text])
    return name, start, end, text, np.cumsum(step).astype(np.uint32)


def _runs(batches):
    """(number, languages, bytes, offsets, words) of each run of a task's texts."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in gathered(batches, 1):
        langs = batch.column(0).fill_null("und").to_pylist()
        for at, data, off in chunks(batch.column(1), RUN):
            data, here = LOWER[data], langs[at : at + len(off) - 1]
            kinds = sorted(set(here))
            code = np.array([kinds.index(x) for x in here], np.uint16)
            salts = np.array([_salt(x) for x in kinds], np.uint64)
            yield (part << 32) + k, kinds, code, data, words_of(data, off, salts[code])
            k += 1


def _count_words(ranges: int):
    """Sends every range the distinct words of a run with counts and spellings, and each language's number of words."""

    def run(batches):
        for src, kinds, code, data, (name, start, end, text, _) in _runs(batches):
            size = np.bincount(code[text], minlength=len(kinds))
            yield from _table(MESSAGE, len(kinds), kind=TOTAL, dst=src % ranges, src=src, lang=kinds, n=size).to_batches()
            if not len(name):
                continue
            distinct, number = numbered(name)
            one = np.empty(len(distinct), np.int64)
            one[number] = np.arange(len(number))
            dst = range_of(distinct, ranges)
            by = order_of(dst)
            one, count, dst = one[by], np.bincount(number).astype(np.uint32)[by], dst[by]
            length = (end - start)[one]
            raw = np.concatenate([[0], np.cumsum(length)])
            body = data[np.repeat(start[one] - raw[:-1], length) + np.arange(raw[-1])]
            edges = np.append(firsts(dst), len(dst))
            yield from _table(MESSAGE, len(edges) - 1, kind=WORD, dst=pa.array(dst[edges[:-1]]), src=src, lang=[json.dumps(kinds)] * (len(edges) - 1), a=pieces(name[one], edges),
                              b=pieces(count, edges), c=pieces(length.astype(np.uint32), edges), d=pieces(body, raw[edges]), e=pieces(code[text[one]], edges)).to_batches()

    return run


def pair_messages(l: np.ndarray, r: np.ndarray, at: np.ndarray, src: int, ranges: int, heavy: np.ndarray, book: np.ndarray) -> pa.Table:
    """One row for each range: its distinct pairs by left name (a and f, how many b), right names (c and g), counts (d) and positions (e).

    Names are coded by ``book``; positions have ``n`` bytes each.
    """
    word, left = numbered(l)
    other, right = numbered(r)
    hot = among(word, heavy)[left]
    dst = np.where(hot, range_of(mixed(l + np.uint64(3) * r), ranges), range_of(word, ranges)[left])
    order = order_of(dst, left, right)
    l, r, at, dst = l[order], r[order], at[order], dst[order]
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (r[1:] != r[:-1])
    pair = np.flatnonzero(new)  # equal pairs have one range
    left = pair[np.concatenate([[True], (l[pair][1:] != l[pair][:-1]) | (dst[pair][1:] != dst[pair][:-1])])] if len(pair) else pair
    part = firsts(dst)
    edges = [np.append(np.searchsorted(x, part), len(x)) for x in (left, pair)]
    lefts = np.searchsorted(pair, left)
    if not len(part):
        return _table(MESSAGE, 0)
    width = 3 if at.max() < 1 << 24 else 4
    where = three_bytes(at) if width == 3 else at.view(np.uint8)
    (a, f), (c, g) = coded(l[left], book, edges[0]), coded(r[pair], book, edges[1])
    return _table(MESSAGE, len(part), kind=PAIR, dst=pa.array(dst[part]), src=src, n=width, a=a, b=pieces(np.diff(np.append(lefts, len(pair))).astype(np.uint32), edges[0]), c=c,
                  d=pieces(np.diff(np.append(pair, len(l))).astype(np.uint32), edges[1]), e=pieces(where, np.append(part, len(at)) * width), f=f, g=g)


def _near(name: np.ndarray, at: np.ndarray, src: int, ranges: int, heavy: np.ndarray, book: np.ndarray):
    near = np.flatnonzero(at[1:] == at[:-1] + np.uint32(1))
    return pair_messages(name[near], name[near + 1], at[near], src, ranges, heavy, book)


def _pair_words(ranges: int, heavy, frequent, book):
    """Sends the neighbouring words of each run; ``frequent`` (None: unknown) leaves only pairs of frequent words."""

    def run(batches):
        for src, _, _, _, (name, _, _, _, at) in _runs(batches):
            if frequent is not None:
                few = among(name, frequent.value)
                name, at = name[few], at[few]
            yield from _near(name, at, src, ranges, heavy.value, book.value).to_batches()

    return run


def _pair_names(ranges: int, heavy):
    """Sends the neighbouring names of a run, from what all ranges have sent it."""

    def run(table: pa.Table) -> pa.Table:
        name, n = joined(table.column("a"), np.uint64)
        name = np.repeat(name, joined(table.column("b"), np.uint32)[0])
        at = joined(table.column("c"), np.uint32)[0]
        order = order_of(at)
        return _near(name[order], at[order], table.column("src")[0].as_py(), ranges, heavy.value, NO_BOOK)

    return run


def _settle(least: int, level: int, book=None):
    """What a range makes of all runs' messages: frequent words or pairs, and for each run its frequent pairs' names and positions."""

    def words(m: pa.Table) -> pa.Table:
        name, per = joined(m.column("a"), np.uint64)
        count, length = joined(m.column("b"), np.uint32)[0].astype(np.int64), joined(m.column("c"), np.uint32)[0]
        body, code = joined(m.column("d"), np.uint8)[0], joined(m.column("e"), np.uint16)[0]
        end = np.cumsum(length.astype(np.int64))
        distinct, number = numbered(name)
        f = np.bincount(number, count, len(distinct)).astype(np.int64)
        one = np.empty(len(distinct), np.int64)
        one[number] = np.arange(len(number))
        one, f = one[f >= least], f[f >= least]
        message = np.repeat(np.arange(len(per)), per)[one]
        kinds = [json.loads(x) for x in m.column("lang").to_pylist()]
        return _table(SETTLED, len(one), kind=WORD, name=name[one].view(np.int64), f=f, lang=[kinds[i][c] for i, c in zip(message, code[one])],
                      word=[body[b - n : b].tobytes().decode() for b, n in zip(end[one], length[one].astype(np.int64))])

    def pairs(m: pa.Table) -> list[pa.Table]:
        codes = NO_BOOK if book is None else book.value
        r, per = decoded(m.column("c"), m.column("g"), codes)
        word, left = numbered(decoded(m.column("a"), m.column("f"), codes)[0])
        left = np.repeat(left, joined(m.column("b"), np.uint32)[0])
        l = word[left]
        n = joined(m.column("d"), np.uint32)[0]
        at = [from_three(x) if width == 3 else x.view(np.uint32) for x, width in zip(arrays(m.column("e"), np.uint8), m.column("n").to_pylist())]
        order = order_of(left, numbered(r)[1])
        new = np.ones(len(l), bool)
        new[1:] = (l[order][1:] != l[order][:-1]) | (r[order][1:] != r[order][:-1])
        first = np.flatnonzero(new)
        f = np.add.reduceat(n[order].astype(np.int64), first) if len(first) else n.astype(np.int64)
        name = mixed(mixed(l[order][first] + np.uint64(level)) * np.uint64(0x9E3779B97F4A7C15) + r[order][first])
        mine = np.empty(len(l), np.int64)
        mine[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(l))))
        keep = f[mine] >= least
        out = [_table(SETTLED, int((f >= least).sum()), kind=PAIR, name=name[f >= least].view(np.int64), l=l[order][first][f >= least].view(np.int64), r=r[order][first][f >= least].view(np.int64), f=f[f >= least])]
        edge = np.concatenate([[0], np.cumsum(per)])
        src, rows = m.column("src").to_pylist(), []
        for k in range(len(src)):
            a, b = edge[k], edge[k + 1]
            some = keep[a:b]
            if some.any():
                rows.append((src[k], name[mine[a:b][some]].tobytes(), n[a:b][some].tobytes(), at[k][np.repeat(some, n[a:b])].tobytes()))
        if rows:
            s, x, y, z = zip(*rows)
            out.append(_table(SETTLED, len(rows), kind=KEPT, src=pa.array(s, pa.int64()), a=list(x), b=list(y), c=list(z)))
        return out

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        out = []
        if (kind == TOTAL).any():
            t = table.filter(pa.array(kind == TOTAL))
            out.append(_table(SETTLED, len(t), kind=TOTAL, lang=t.column("lang").combine_chunks(), f=t.column("n").combine_chunks()))
        if (kind == WORD).any():
            out.append(words(table.filter(pa.array(kind == WORD))))
        if (kind == PAIR).any():
            out += pairs(table.filter(pa.array(kind == PAIR)))
        return pa.concat_tables([x.cast(SETTLED) for x in out])

    return run


def _lowest(cuts: list[tuple[Column, Column]], a: Column) -> Column:
    """The cut with the lowest floor(2000000 a / (l + r)), the first of equals: a struct (score, cut, l, r).

    The product is a decimal of 38 digits, which holds it for every count of 64 bits.
    """
    wide = "decimal(38,0)"

    def score(l, r):
        top, below = (a.cast("decimal(19,0)") * F.lit(2_000_000).cast("decimal(7,0)")).cast(wide), (l.cast("decimal(19,0)") + r.cast("decimal(19,0)")).cast(wide)
        return ((top - top % below).cast(wide) / below).cast("long")

    return F.array_min(F.array(*[F.struct(score(l, r).alias("score"), F.lit(k + 1).alias("cut"), l.alias("l"), r.alias("r")) for k, (l, r) in enumerate(cuts)]))


def mined(docs: DataFrame, least: int = 30, longest: int = 4) -> tuple[DataFrame, list[DataFrame]]:
    """``(totals, [words, pairs, triples, ..])`` over all texts, as written tables.

    Totals are ``(lang, n)``, words ``(lang, word, name, f)`` with ``f >= least``, and phrases of k words ``(name, l, r, f)``, where ``l``
    and ``r`` name the first and the last k-1 words.
    """
    spark = docs.sparkSession
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = n_ranges(texts)
    counted = written(texts.mapInArrow(releasing(_count_words(ranges)), MESSAGE_SQL).groupBy("dst").applyInArrow(_settle(least, 1), SETTLED_SQL), "words")
    totals = written(counted.where(F.col("kind") == TOTAL).groupBy("lang").agg(F.sum("f").alias("n")), "totals")
    levels = [counted.where(F.col("kind") == WORD).select("lang", "word", "name", "f")]
    n = totals.agg(F.sum("n")).first()[0] or 0
    few = levels[0].limit(FEW + 1).count() <= FEW
    frequent = spark.sparkContext.broadcast(_column(levels[0].select("name"))) if few else None
    book = spark.sparkContext.broadcast(_column(levels[0].orderBy(F.desc("f"), "name").limit(BOOK).select("name")))
    sent = None
    swept(spark)
    for k in range(2, longest + 1):
        # Names with an eighth of a range's words or more: at most eight for each range.
        big = levels[-1].where(F.col("f") * 8 * ranges > n).select("name")
        heavy = spark.sparkContext.broadcast(_column(big))
        if k == 2:
            messages = texts.mapInArrow(releasing(_pair_words(ranges, heavy, frequent, book)), MESSAGE_SQL)
        else:
            messages = sent.where(F.col("kind") == KEPT).groupBy("src").applyInArrow(_pair_names(ranges, heavy), MESSAGE_SQL)
        sent = written(messages.groupBy("dst").applyInArrow(_settle(least, k, book if k == 2 else None), SETTLED_SQL), f"phrases-{k}")
        levels.append(sent.where(F.col("kind") == PAIR).select("name", "l", "r", "f"))
        heavy.destroy()
        swept(spark)
    book.destroy()
    if frequent is not None:
        frequent.destroy()
    return totals, levels


def _column(names: DataFrame) -> np.ndarray:
    """The sorted names of a table whose size its caller has bounded."""
    return np.sort(np.array([r[0] for r in names.collect()], np.int64).view(np.uint64))


def collocations(docs: DataFrame, least: int = 30, longest: int = 4, covered: int = 80, most: int | None = 2000) -> DataFrame:
    """The best collocations of each language.

    Texts of ``docs(lang, text)`` are lower-cased (A-Z), cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and those into words ``[^\\x20\\x09]+``.
    Phrases of 2 to ``longest`` words (at most 4) that occur ``a >= least`` times score floor(2000000 a / (l + r)) by their lowest-scoring
    cut. Phrases inside a longer frequent phrase with at least ``covered`` percent of their occurrences go. Returns the first
    ``most`` of each language (None: all) by score, a (both descending) and phrase: ``(lang, rank, phrase, a, l, r, n, score)``.

    Null texts count as empty, null languages as ``und``; repeated rows count each time, ids aren't read, other columns are
    ignored, and an empty table gives no rows. Counts are exact up to 64-bit hashes of words and pairs. Texts
    of any length are read whole; a text longer than a run is a run of its own, held in a few times its size.
    """
    if not 2 <= longest <= 4:
        raise ValueError("longest: 2 to 4")
    totals, levels = mined(docs, least, longest)
    by = {1: levels[0].withColumnRenamed("word", "phrase")}
    for k in range(2, longest + 1):
        left = by[k - 1].select(*[F.col(c).alias(f"l_{c}") for c in by[k - 1].columns])
        right = by[k - 1].select(*[F.col(c).alias(f"r_{c}") for c in by[k - 1].columns])
        both = levels[k - 1].join(left, F.col("l") == F.col("l_name")).join(right, F.col("r") == F.col("r_name"))
        # Occurrences of the first and of the last 1, 2, .. words, read off the parents.
        heads = F.array("l_f") if k == 2 else F.concat("l_heads", F.array("l_f"))
        tails = F.array("r_f") if k == 2 else F.concat("r_tails", F.array("r_f"))
        phrase = F.concat_ws(" ", "l_phrase", F.substring_index("r_phrase", " ", -1))
        by[k] = written(both.select(F.col("l_lang").alias("lang"), "name", "l", "r", "f", phrase.alias("phrase"), heads.alias("heads"), tails.alias("tails")), f"named-{k}")
    out = []
    for k in range(2, longest + 1):
        rows = by[k].withColumn("best", _lowest([(F.col("heads")[j - 1], F.col("tails")[k - j - 1]) for j in range(1, k)], F.col("f")))
        if k < longest:  # a phrase that a longer one covers is covered by one with a word more, which is at least as frequent
            up = [by[k + 1].select(F.col(side).alias("name"), F.col("f").alias("g")) for side in ("l", "r")]
            rows = rows.join(up[0].unionByName(up[1]).groupBy("name").agg(F.max("g").alias("g")), "name", "left")
            rows = rows.where(F.col("g").isNull() | (F.col("g").cast("decimal(19,0)") * 100 < F.col("f").cast("decimal(19,0)") * covered))
        out.append(rows.select("lang", "phrase", F.col("f").alias("a"), "best.l", "best.r", "best.score"))
    found = reduce(DataFrame.unionByName, out)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    if most is not None:  # a language's rows are ranked in parts first, whose best alone meet
        part = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= most)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long"))
    if most is not None:
        ranked = ranked.where(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
