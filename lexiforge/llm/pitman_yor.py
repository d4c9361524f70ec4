"""Language-model scoring by a hierarchical Pitman-Yor model.

Every word of the training texts is a customer who orders the next word in the restaurant of the word before; each
table there sends one customer to the one parent that all context restaurants share, and the parent's tables send theirs
to an even base over the vocabulary and one unknown word. Who sits where is sampled by Gibbs: customers leave and are seated
again by the Chinese-restaurant rule (seat()). A text's probability is that of its words, averaged over the kept samples.

All counts stay spread out. Pairs of neighbouring words are dealt to ranges by the word before (a very frequent one's to
several), dishes of the parent to ranges by themselves, and both kinds send each other packed rows (packed.py):

1. ``pairs``: each run of texts sends the ranges its distinct pairs, their counts and which documents hold them. Written
   once as a table bucketed by range, which no later step shuffles again.
2. a sweep: ranges seat their pairs and ask the dishes of their words, which add up the customers, seat the parent
   and answer. Ranges are sampled side by side given the parent of the last sweep. Restarted tasks draw the same numbers.
3. the score: a range takes each pair's averaged probability and adds up logarithms by document; documents add up ranges.
"""

from __future__ import annotations

import atexit
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, _remove, chunks, forget, mixed, releasing, running, shared_dir, span_hash, words, written
from .packed import BOOK, RUN, among, coded, decoded, firsts, gathered, joined, n_ranges, numbered, order_of, pieces, range_of, swept

START, END = np.uint64(0x5354415254), np.uint64(0x454E44)
PAIRS, DOCS, ASK, HEAVY, REPLY, TOTAL, SEATS, SUMS, SCALARS = range(9)
NAMES = "abcdefgh"
ROW = pa.schema([("kind", pa.int32()), ("at", pa.int32()), ("src", pa.int64()), *[(c, pa.binary()) for c in NAMES]])
ROW_SQL = "kind int, at int, src long, " + ", ".join(f"{c} binary" for c in NAMES)
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"


def _rows(kind: int, at, src, n: int, **columns) -> pa.Table:
    """Rows of one kind; ``at`` and ``src`` are arrays or one number, binary columns are given by name."""
    out = [pa.array(np.full(n, kind, np.int32)), pa.array(np.broadcast_to(np.asarray(at, np.int32), n)), pa.array(np.broadcast_to(np.asarray(src, np.int64), n))]
    return pa.Table.from_arrays(out + [columns[c] if c in columns else pa.nulls(n, pa.binary()) for c in NAMES], schema=ROW)


def _one(kind: int, at: int, src: int, **arrays) -> pa.Table:
    return _rows(kind, at, src, 1, **{c: pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for c, v in arrays.items()})


def _changes(l: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Where a pair differs from the one before."""
    new = np.ones(len(l), bool)
    new[1:] = (l[1:] != l[:-1]) | (r[1:] != r[:-1])
    return np.flatnonzero(new)


def _of(table: pa.Table, kind: int) -> pa.Table:
    return table.filter(pa.array(table.column("kind").to_numpy() == kind))


# ---------------------------------------------------------------- seating


def seat(customers, owner, fixed, live, base, discount: float, strength: float, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after ``rounds`` rounds of Gibbs sampling; dishes have two customers at least.

    ``owner`` is a dish's restaurant, ``fixed`` the tables that each restaurant has besides (of all its dishes where ``live`` is False)
    and ``base`` the dish's probability in the parent. At first each dish has one table. In a round an eighth of a dish's
    customers (one at least) get up, tables left by all go, and each sits down: at a table of n with weight n - discount,
    or at a new one with weight (strength + discount * tables of the restaurant) * base. Customers who get up
    together don't see each other; dishes of fewer than 16 customers move one at a time.
    """
    k = len(customers)
    size, dish, tables = customers.astype(np.int64).copy(), np.arange(k), np.ones(k, np.int64)
    few, many = customers < 16, customers > 4096
    share = np.maximum(1, customers // 8) / customers
    for _ in range(rounds):
        first = np.cumsum(tables) - tables
        gone = np.zeros(len(size), np.int64)
        gone[first[few & (tables == 1)]] = 1
        some = np.flatnonzero(few & (tables > 1))
        end = np.cumsum(size)
        chosen = (end - size)[first[some]] + (rng.random(len(some)) * customers[some]).astype(np.int64)
        gone[np.searchsorted(end, chosen, "right")] = 1
        rest = np.flatnonzero(~few[dish])
        gone[rest] = rng.binomial(size[rest], share[dish[rest]])
        up = np.bincount(dish, gone, k).astype(np.int64)
        size = size - gone
        if not size.all():
            dish = dish[size > 0]
            size = size[size > 0]
            tables = np.bincount(dish, minlength=k)
            first = np.cumsum(tables) - tables
        there = fixed + np.where(live, np.bincount(owner, tables, len(fixed)), 0)
        fresh = (strength + discount * there[owner]) * base
        old = np.maximum(customers - up - discount * tables, 0)
        new = np.where(up == 1, rng.random(k) * (fresh + old) < fresh, 0)
        more = np.flatnonzero(up > 1)
        new[more] = rng.binomial(up[more], fresh[more] / (fresh + old)[more])
        back = up - new
        only = np.flatnonzero((tables == 1) & (back > 0))
        size[first[only]] += back[only]
        several = np.flatnonzero((tables > 1) & ~many & (back > 0))
        weight = np.cumsum(size - discount)
        one = np.repeat(several, back[several])
        low = (weight - size + discount)[first[one]]
        at = np.searchsorted(weight, low + rng.random(len(one)) * (weight[first[one] + tables[one] - 1] - low), "right")
        at = np.clip(at, first[one], first[one] + tables[one] - 1)
        size = size + np.bincount(at, minlength=len(size))
        for i in np.flatnonzero((tables > 1) & many & (back > 0)):
            a, b = first[i], first[i] + tables[i]
            p = size[a:b] - discount
            size[a:b] += rng.multinomial(back[i], p / p.sum())
        opened = np.flatnonzero(new)
        more = np.repeat(opened, new[opened])
        where = (first + tables)[more]
        size, dish = np.insert(size, where, 1), np.insert(dish, where, more)
        tables = tables + new
    return tables


def _discount(ones: int, twos: int) -> float:
    """The discount that counts of counts suggest, away from both ends."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


# ---------------------------------------------------------------- texts


def _texts(batches):
    """(run, ids, held, offsets of tokens, names) of each run; each text ends with END. Bytes are hashed in smaller parts."""
    part, k = TaskContext.get().partitionId(), 0
    for batch in gathered(batches, 2):
        ids, held = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
        names, counts, size, begin = [], [], 0, 0
        for at, data, off in chunks(batch.column(2)):
            data, n = LOWER[data], len(off) - 1
            start, end, text = words(data, off)
            per = np.bincount(text, minlength=n) + 1
            edge = np.cumsum(per)
            name = np.full(edge[-1], END)
            mask = np.ones(edge[-1], bool)
            mask[edge - 1] = False
            name[mask] = span_hash(running(data), start, end)
            names.append(name)
            counts.append(per)
            size += len(data)
            last = at + n
            if size >= RUN or last == len(ids):
                yield (part << 32) + k, ids.slice(begin, last - begin), held[begin:last], np.concatenate([[0], np.cumsum(np.concatenate(counts))]), np.concatenate(names)
                k, names, counts, size, begin = k + 1, [], [], 0, last


def _frequent(batches):
    """Words that occur three times in a run, with their counts; under a null name the number of all words."""
    for _, _, _, edge, name in _texts(batches):
        found = pa.array(name).value_counts()
        name, n = found.field(0).to_numpy(), found.field(1).to_numpy()
        keep = n >= 3
        yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(name[keep].view(np.int64)), pa.nulls(1, pa.int64())]), pa.array(np.append(n[keep], n.sum()), pa.int64())], names=["name", "n"])


def _spread(word: np.ndarray, before: np.ndarray, right: np.ndarray, ranges: int, heavy: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The range of each pair: that of its left word, word[before]; a very frequent one's are several in a row."""
    at = range_of(word, ranges)[before]
    hot = among(word, heavy)
    some = np.flatnonzero(hot[before])
    k = parts[np.searchsorted(heavy, word[before[some]])].astype(np.uint64)
    at[some] = (at[some] + (mixed(right[some]) % k).astype(np.int64)) % ranges
    return at


def _send(ranges: int, shared):
    """Each run's distinct pairs by range, with counts in training and in all texts, and the document of each occurrence."""

    def run(batches):
        book, heavy, parts = shared.value
        for src, ids, held, edge, right in _texts(batches):
            n = len(edge) - 1
            doc = np.repeat(np.arange(n, dtype=np.uint32), np.diff(edge))
            word, number = numbered(right)
            word = np.append(word, START)  # its number is the last
            before = np.empty_like(number)
            before[1:], before[edge[:-1]] = number[:-1], len(word) - 1
            at = _spread(word, before, right, ranges, heavy, parts)
            order = order_of(at, before, number)
            before, number, at, doc = before[order], number[order], at[order], doc[order]
            l, r = word[before], word[number]
            pair = _changes(before, number)
            lp, ap = l[pair], at[pair]
            lead, part = _changes(lp, ap), firsts(ap)
            pair_edges, lead_edges = np.append(part, len(pair)), np.append(np.searchsorted(lead, part), len(lead))
            token_edges = np.append(pair[part], len(l))
            seen = np.add.reduceat(~held[doc], pair, dtype=np.int64).astype(np.uint32)
            codes, others = coded(r[pair], book, pair_edges)
            yield from _rows(PAIRS, ap[part], src, len(part), a=pieces(lp[lead], lead_edges), b=pieces(np.diff(np.append(lead, len(pair))).astype(np.uint32), lead_edges), c=codes, d=others,
                             e=pieces(seen, pair_edges), f=pieces(np.diff(np.append(pair, len(l))).astype(np.uint32), pair_edges), g=pieces(doc, token_edges),
                             h=pa.array([np.int64(n).tobytes()] * len(part), pa.binary())).to_batches()
            yield from _one(DOCS, src % ranges, src, a=ids.fill_null(0).to_numpy(), b=ids.is_valid().to_numpy(zero_copy_only=False), c=held, d=np.diff(edge)).to_batches()

    return run


def _gather(ranges: int, shared):
    """A range's pairs from all runs' messages: each pair once with its training count and the documents of its occurrences.

    A row has the left words (a, how many pairs each b), the pairs' right words (c) as places in the list d of all, which is ordered
    by the ranges of dishes, counts in training (e), occurrences (f) and the documents of these (g), which
    are numbered over the runs that sent something; h has the runs and their first numbers.
    """

    def run(table: pa.Table) -> pa.Table:
        out = [_of(table, DOCS)]
        m = _of(table, PAIRS).sort_by("src")
        if len(m):
            first, owner = numbered(joined(m.column("a"), np.uint64)[0])
            l = np.repeat(owner, joined(m.column("b"), np.uint32)[0])
            word, r = numbered(decoded(m.column("c"), m.column("d"), shared.value[0])[0])
            to = range_of(word, ranges)
            by = np.argsort(to, kind="stable")
            place = np.empty(len(by), np.int64)
            place[by] = np.arange(len(by))
            seen, held = joined(m.column("e"), np.uint32)[0].astype(np.int64), joined(m.column("f"), np.uint32)[0].astype(np.int64)
            doc, per = joined(m.column("g"), np.uint32)
            base = np.concatenate([[0], np.cumsum(joined(m.column("h"), np.int64)[0])])[:-1]
            doc = doc + np.repeat(base, per)
            order = order_of(l, r)
            l, r, many = l[order], place[r[order]], held[order]
            begin = (np.cumsum(held) - held)[order]
            doc = doc[np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(len(doc))]
            pair = _changes(l, r)
            c, f = np.add.reduceat(seen[order], pair), np.add.reduceat(many, pair)
            out.append(_one(PAIRS, m.column("at")[0].as_py(), 0, a=first, b=np.bincount(l[pair], minlength=len(first)).astype(np.uint32), c=r[pair].astype(np.uint32), d=word[by], e=c, f=f.astype(np.uint32),
                            g=doc.astype(np.uint32 if doc.max() < 2**32 else np.int64), h=np.concatenate([m.column("src").to_numpy(), base])))
        return pa.concat_tables(out)

    return run


class _Range:
    """A range's pairs, read from its row."""

    def __init__(self, row: pa.Table, heavy: np.ndarray, ranges: int):
        self.at = row.column("at")[0].as_py()
        self.left = joined(row.column("a"), np.uint64)[0]
        self.owner = np.repeat(np.arange(len(self.left)), joined(row.column("b"), np.uint32)[0])
        self.of, self.word = joined(row.column("c"), np.uint32)[0], joined(row.column("d"), np.uint64)[0]
        self.count = joined(row.column("e"), np.int64)[0]
        self.hot = among(self.left, heavy)
        by = range_of(self.word, ranges)
        first = firsts(by)
        self.ends, self.to = np.append(first, len(by)), by[first]

    def ask(self, tables: np.ndarray, book: np.ndarray, ranges: int) -> pa.Table:
        """Rows for the dishes of all words (customers sent, training occurrences), and for the totals of very frequent words' restaurants."""
        n = len(self.word)
        sent, seen = np.bincount(self.of, tables, n).astype(np.int64), np.bincount(self.of, self.count, n).astype(np.int64)
        codes, others = coded(self.word, book, self.ends)
        out = [_rows(ASK, self.to, self.at, len(self.to), c=codes, d=others, e=pieces(sent, self.ends), f=pieces(seen, self.ends))]
        if self.hot.any():
            name = self.left[self.hot]
            to = range_of(name, ranges)
            both = [np.bincount(self.owner, x, len(self.left)).astype(np.int64)[self.hot] for x in (self.count, tables)]
            order = np.argsort(to, kind="stable")
            edges = np.append(firsts(to[order]), len(to))
            out.append(_rows(HEAVY, to[order][edges[:-1]], self.at, len(edges) - 1, a=pieces(name[order], edges), b=pieces(both[0][order], edges), c=pieces(both[1][order], edges)))
        return pa.concat_tables(out)

    def parent(self, replies: pa.Table, model: dict) -> np.ndarray:
        """Probability of each word in the parent."""
        r = _of(replies, REPLY).sort_by("src")
        customers, tables = joined(r.column("a"), np.int64)[0], joined(r.column("b"), np.int64)[0]
        d, s = model["parent_discount"], model["strength"]
        return (customers - d * tables + (s + d * model["tables"]) / (model["kinds"] + 1)) / (s + model["customers"])

    def totals(self, replies: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        """Customers and tables over all ranges of the very frequent words' restaurants (zero for others)."""
        customers, tables = np.zeros(len(self.left)), np.zeros(len(self.left))
        t = _of(replies, TOTAL)
        name = joined(t.column("a"), np.uint64)[0]
        at = np.searchsorted(self.left, name)
        customers[at], tables[at] = joined(t.column("b"), np.int64)[0], joined(t.column("c"), np.int64)[0]
        return customers, tables

    def seated(self, replies: pa.Table, model: dict, sweep: int) -> np.ndarray:
        """Tables of each pair, sampled given the parent of ``replies``."""
        tables = (self.count > 0).astype(np.int64)
        base = self.parent(replies, model)[self.of]
        several = np.flatnonzero(self.count > 1)
        _, total = self.totals(replies)
        alone = np.bincount(self.owner, self.count == 1, len(self.left))
        tables[several] = seat(self.count[several], self.owner[several], np.where(self.hot, total, alone), ~self.hot, base[several],
                               model["discount"], model["strength"], model["rounds"], np.random.default_rng([model["seed"], self.at, sweep]))
        return tables


def _ask_first(ranges: int, shared):
    """Before any sweep each pair has one table."""

    def run(batches):
        book, heavy, _ = shared.value
        for batch in batches:
            for k in range(len(batch)):
                r = _Range(pa.Table.from_batches([batch.slice(k, 1)]), heavy, ranges)
                yield from r.ask((r.count > 0).astype(np.int64), book, ranges).to_batches()

    return run


def _sweep(ranges: int, shared, model: dict, sweep: int):
    def run(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(pairs):
            return ROW.empty_table()
        book, heavy, _ = shared.value
        r = _Range(pairs, heavy, ranges)
        tables = r.seated(replies, model, sweep)
        kept = _one(SEATS, r.at, 0, a=tables[r.count > 1].astype(np.uint32))
        return pa.concat_tables([kept, r.ask(tables, book, ranges)])

    return run


def _dishes(ranges: int, shared, model: dict | None, sweep: int, settings: dict):
    """The parent's dishes of a range: customers from all asking ranges, seated, and answered to each in its own order.

    ``model`` has the sums of the last sweep; before the first sweep each dish has one table.
    """

    def run(table: pa.Table) -> pa.Table:
        book, out = shared.value[0], []
        at = table.column("at")[0].as_py()
        out.append(_of(table, SEATS))
        h = _of(table, HEAVY)
        if len(h):
            name, per = joined(h.column("a"), np.uint64)
            u, back = numbered(name)
            both = [np.bincount(back, joined(h.column(c), np.int64)[0], len(u)).astype(np.int64)[back] for c in "bc"]
            edges = np.concatenate([[0], np.cumsum(per)])
            out.append(_rows(TOTAL, h.column("src").to_numpy(), at, len(h), a=pieces(name, edges), b=pieces(both[0], edges), c=pieces(both[1], edges)))
        m = _of(table, ASK)
        if len(m):
            name, per = decoded(m.column("c"), m.column("d"), book)
            u, back = numbered(name)
            customers, seen = (np.bincount(back, joined(m.column(c), np.int64)[0], len(u)).astype(np.int64) for c in "ef")
            tables = (customers > 0).astype(np.int64)
            several = np.flatnonzero(customers > 1)
            if model is not None and len(several):
                base = np.full(len(several), 1.0 / (model["kinds"] + 1))
                tables[several] = seat(customers[several], np.zeros(len(several), np.int64), np.array([model["tables"]]), np.array([False]), base,
                                       model["parent_discount"], model["strength"], settings["rounds"], np.random.default_rng([settings["seed"], at, sweep, 1]))
            edges = np.concatenate([[0], np.cumsum(per)])
            out.append(_rows(REPLY, m.column("src").to_numpy(), at, len(m), **{c: pieces(v[back], edges) for c, v in zip("abc", (customers, tables, seen))}))
            known = seen > 0
            out.append(_one(SCALARS, at, 0, a=np.array([known.sum(), seen.sum(), customers.sum(), tables.sum(), (customers == 1).sum(), (customers == 2).sum()], np.int64)))
        return pa.concat_tables(out)

    return run


def _score(ranges: int, shared, models: list[dict], burn: int):
    """Sums by document over a range's pairs: score, base score and known tokens.

    ``replies`` holds those of all sweeps, the sweep in column h.
    """

    def run(pairs: pa.Table, replies: pa.Table) -> pa.Table:
        if not len(pairs):
            return ROW.empty_table()
        r = _Range(pairs, shared.value[1], ranges)
        sweep = joined(replies.column("h"), np.int64)[0]
        of = [replies.filter(pa.array(sweep == s)) for s in range(len(models))]
        mean = np.zeros(len(r.count))
        for s in range(burn, len(models) - 1):
            m = models[s]
            tables = (r.count > 0).astype(np.int64)
            tables[r.count > 1] = joined(_of(of[s + 1], SEATS).column("a"), np.uint32)[0]
            there, sat = np.bincount(r.owner, r.count, len(r.left)), np.bincount(r.owner, tables, len(r.left))
            customers, total = r.totals(of[s + 1])
            there, sat = np.where(r.hot, customers, there), np.where(r.hot, total, sat)
            d, q = m["discount"], m["strength"]
            leave = np.where(there > 0, (q + d * sat) / (q + there), 1.0)
            mean += (r.count - d * tables) / (q + there)[r.owner] + leave[r.owner] * r.parent(of[s], m)[r.of]
        logp = np.log10(mean / (len(models) - 1 - burn))
        seen = joined(_of(of[0], REPLY).sort_by("src").column("c"), np.int64)[0]
        base = np.log10((seen + 1) / (models[0]["tokens"] + models[0]["kinds"] + 1))
        f = joined(pairs.column("f"), np.uint32)[0]
        wide = len(pairs.column("g")[0].as_buffer()) == 8 * f.sum(dtype=np.int64)
        doc = joined(pairs.column("g"), np.int64 if wide else np.uint32)[0].astype(np.int64)
        where = joined(pairs.column("h"), np.int64)[0].reshape(2, -1)
        u, back = np.unique(doc, return_inverse=True)
        sums = [np.bincount(back, np.repeat(x, f), len(u)) for x in (logp, base[r.of], seen[r.of] > 0)]
        runs = np.searchsorted(where[1], u, "right") - 1
        first = firsts(runs)
        edges = np.append(first, len(u))
        local = (u - where[1][runs]).astype(np.uint32)
        return _rows(SUMS, r.at, where[0][runs[first]], len(first), a=pieces(local, edges), b=pieces(sums[0], edges), c=pieces(sums[1], edges), d=pieces(sums[2].astype(np.uint32), edges))

    return run


def _by_document(table: pa.Table) -> pa.Table:
    """A run's documents with their sums over all ranges."""
    d, s = _of(table, DOCS), _of(table, SUMS).sort_by("at")
    ids, valid = joined(d.column("a"), np.int64)[0], joined(d.column("b"), np.bool_)[0]
    local = joined(s.column("a"), np.uint32)[0]
    score, base = (np.bincount(local, joined(s.column(c), np.float64)[0], len(ids)) for c in "bc")
    known = np.bincount(local, joined(s.column("d"), np.uint32)[0], len(ids)).astype(np.int64)
    return pa.table([pa.array(ids, mask=~valid), pa.array(joined(d.column("c"), np.bool_)[0]), pa.array(joined(d.column("d"), np.int64)[0]), pa.array(known), pa.array(base), pa.array(score)],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])


def _bucketed(df: DataFrame, buckets: int) -> DataFrame:
    """``df`` as a table in the shared folder, bucketed by ``at``: grouping by it needs no shuffle."""
    spark = df.sparkSession
    name = f"lexiforge_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    df.write.bucketBy(buckets, "at").option("path", path).option("compression", "zstd").saveAsTable(name)
    out = spark.table(name)
    out.written_to, out.table_name = path, name
    atexit.register(_remove, spark, path)
    return out


def score_texts(docs: DataFrame, held: Column, sweeps: int = 3, burn: int = 1, rounds: int = 8, strength: float = 0.5, seed: int = 12) -> DataFrame:
    """Scores every text of ``docs(doc_id, text)`` by a model learnt from those where ``held`` isn't true.

    Returns ``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score)`` for each row: tokens are the words of the text
    (A-Z lower-cased, cut at white space) and one end; known ones occur in training; the base score is the sum of log10((c + 1) / (N + V + 1))
    over tokens, and the score the model's log10 probability of the text. Perplexity is 10 ** (-score / n_tokens).

    Samples ``burn`` to ``sweeps - 1`` are averaged. Discounts follow from counts of counts. Probabilities sum to one over the
    vocabulary and an unknown word. Null texts are empty (their one token is the end); a null ``held`` counts as false; rows are
    scored each for itself, so repeated rows, ties and null ids are kept as they are; an empty table gives no rows. Other
    columns are ignored. Texts of any length are read whole, one longer than a run as a run of its own.
    """
    if not 0 <= burn < sweeps:
        raise ValueError("0 <= burn < sweeps")
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held, F.lit(False)).alias("held"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = n_ranges(texts)
    often = written(texts.mapInArrow(releasing(_frequent), "name long, n long").groupBy("name").agg(F.sum("n").alias("n")), "frequent")
    total = often.where("name is null").agg(F.sum("n")).first()[0] or 0
    top = often.where("name is not null").orderBy(F.desc("n"), "name").limit(BOOK).toArrow()
    name, n = (np.append(top.column(c).to_numpy(), x) for c, x in (("name", np.int64(START)), ("n", texts.count())))
    order = np.argsort(name.view(np.uint64))
    name, n = name.view(np.uint64)[order], n[order]
    # Words with over half a range's tokens are dealt to as many ranges as they have halves: at most four for each range in all.
    big = 2 * ranges * n > total
    parts = np.minimum(ranges, -(-2 * ranges * n[big] // max(total, 1)))
    shared = spark.sparkContext.broadcast((name, name[big], parts))
    forget(often)

    messages = texts.mapInArrow(releasing(_send(ranges, shared)), ROW_SQL)
    pairs = _bucketed(messages.groupBy("at").applyInArrow(_gather(ranges, shared), ROW_SQL), int(spark.conf.get("spark.sql.shuffle.partitions")))
    swept(spark)
    only = pairs.where(F.col("kind") == PAIRS)
    small = only.select("kind", "at", "src", *"abcde")
    counts = small.select("e").mapInArrow(_ones_and_twos, "ones long, twos long").agg(F.sum("ones"), F.sum("twos")).first()
    settings = {"discount": _discount(counts[0] or 0, counts[1] or 0), "strength": strength, "rounds": rounds, "seed": seed}
    models, replies = [], []
    for s in range(sweeps + 1):
        if s == 0:
            asked = small.mapInArrow(releasing(_ask_first(ranges, shared)), ROW_SQL)
        else:
            asked = small.groupBy("at").cogroup(replies[-1].where(F.col("kind") != SCALARS).groupBy("at")).applyInArrow(_sweep(ranges, shared, models[-1], s - 1), ROW_SQL)
        replies.append(written(asked.groupBy("at").applyInArrow(_dishes(ranges, shared, models[-1] if models else None, s, settings), ROW_SQL), f"sweep-{s}"))
        rows = replies[-1].where(F.col("kind") == SCALARS).select("a").collect()  # six numbers for each range
        kinds, tokens, customers, tables, ones, twos = np.sum([np.frombuffer(r.a, np.int64) for r in rows] or [np.zeros(6, np.int64)], axis=0).tolist()
        models.append(settings | {"kinds": kinds, "tokens": tokens, "customers": customers, "tables": tables, "parent_discount": _discount(ones, twos)})
        swept(spark)
    # A sweep's answers also keep the seats that its questions came from, and the totals of very frequent words' restaurants.
    needed = []
    for s, r in enumerate(replies):
        used = burn <= s < sweeps
        kept = r.where(F.col("kind").isin(REPLY, TOTAL, SEATS) if used or s == 0 else F.col("kind").isin(TOTAL, SEATS))
        total = F.col("kind") != REPLY
        if not used:
            kept = kept.withColumns({c: F.when(total, F.col(c)) for c in "ab"})
        if s > 0:
            kept = kept.withColumn("c", F.when(total, F.col("c")))
        needed.append(kept.withColumn("h", F.unhex(F.lit(np.int64(s).tobytes().hex()))))
    needed = reduce(DataFrame.unionByName, needed)
    sums = only.groupBy("at").cogroup(needed.groupBy("at")).applyInArrow(_score(ranges, shared, models, burn), ROW_SQL)
    both = sums.unionByName(pairs.where(F.col("kind") == DOCS))
    out = written(both.groupBy("src").applyInArrow(_by_document, SCORES).withColumn("train_tokens", F.lit(models[-1]["tokens"]).cast("long")), "scores")
    for t in (pairs, *replies):
        forget(t)
    spark.sql(f"drop table if exists {pairs.table_name}")
    shared.destroy()
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def _ones_and_twos(batches):
    for b in batches:
        count = joined(b.column(0), np.int64)[0]
        yield pa.RecordBatch.from_arrays([pa.array([int((count == 1).sum())]), pa.array([int((count == 2).sum())])], names=["ones", "twos"])
