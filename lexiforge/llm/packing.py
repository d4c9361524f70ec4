"""Packing as a cutting-stock problem solved by column generation.

Every document is tokenised, ended with one id, and cut into full sequences and
a tail. Tails are a histogram over the sequence length, so the problem's size
does not depend on the number of documents: a linear program over patterns
(multisets of tail lengths that fit in a sequence) is solved on the driver, its
columns priced by an unbounded-knapsack dynamic program, and rounded. Documents
are ranked within their length, and the rank alone says in which copy of which
pattern a tail lies.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bytebpe import coder
from .common import releasing, text_runs, written

# ------------------------------------------------------------------ the program


def _knapsack(price: np.ndarray, size: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within room: its value and counts."""
    best, took = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(int(size.min()), room + 1):
        k = np.flatnonzero(size <= c)
        v = best[c - size[k]] + price[k]
        j = int(np.argmax(v))
        best[c] = best[c - 1]
        if v[j] > best[c] + 1e-12:
            best[c], took[c] = v[j], k[j]
    n, c = np.zeros(len(size), np.int64), room
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            n[took[c]] += 1
            c -= size[took[c]]
    return float(best[room]), n


def _inverse(a: np.ndarray) -> np.ndarray:
    """Gauss-Jordan with row pivots; plain array operations, as threaded BLAS can stall beside a JVM."""
    m = len(a)
    w = np.hstack([a.astype(float), np.eye(m)])
    for j in range(m):
        p = j + int(np.argmax(np.abs(w[j:, j])))
        w[[j, p]] = w[[p, j]]
        w[j] /= w[j, j]
        f = w[:, j].copy()
        f[j] = 0
        w -= f[:, None] * w[j]
    return w[:, m:]


def cutting_stock(size: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-4) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often to use each, covering ``demand`` pieces of each ``size`` with about the fewest stocks.

    Revised simplex over generated columns. The best column's value v bounds the program from below by the present
    number of stocks over v, so columns are made until that number is within ``gap`` of the optimum. The
    fractional solution is rounded down and what is left is packed first-fit decreasing, so the result covers the demand exactly.
    """
    m = len(size)
    if not m:
        return []
    # First-fit decreasing, a pattern at a time: each uses up a size that later ones
    # don't hold, so the m patterns are a triangular, feasible first basis.
    left, basis, x, open_ = demand.astype(float), np.zeros((m, m)), np.zeros(m), np.ones(m, bool)
    for j in range(m):
        c = room
        for k in np.argsort(-size, kind="stable"):
            if open_[k]:
                basis[k, j], c = c // size[k], c % size[k]
        on = basis[:, j] > 0
        ratio = np.where(on, left / np.maximum(basis[:, j], 1), np.inf)
        k = int(np.argmin(ratio))
        x[j] = ratio[k]
        left = np.maximum(left - x[j] * basis[:, j], 0)
        left[k], open_[k] = 0, False
    inverse = _inverse(basis)
    still, least = 0, x.sum()
    while still < 50 * m + 100:  # a degenerate basis may stand still for a while
        dual = inverse.sum(0)
        value, column = _knapsack(dual, size, room)
        if value <= 1 + gap:
            break
        d = (inverse * column).sum(1)
        ok = d > 1e-9
        ratio = np.full(m, np.inf)
        ratio[ok] = x[ok] / d[ok]
        r = int(np.argmin(ratio))
        step = ratio[r]
        x = x - step * d
        x[r] = step
        x[x < 1e-12] = 0
        row = inverse[r] / d[r]
        inverse = inverse - np.outer(d, row)
        inverse[r] = row
        basis[:, r] = column
        still, least = (0, x.sum()) if x.sum() < least - 1e-9 else (still + 1, least)
    left, out = demand.astype(np.int64).copy(), []
    for r in np.argsort(-x, kind="stable"):
        p = basis[:, r].astype(np.int64)
        n = int(np.floor(x[r] + 1e-9))
        used = p > 0
        n = min(n, int((left[used] // p[used]).min()))
        if n > 0:
            out.append((p, n))
            left -= n * p
    while left.any():  # first-fit decreasing, a pattern at a time
        p, c = np.zeros(m, np.int64), room
        for k in np.argsort(-size, kind="stable"):
            n = min(int(left[k]), c // int(size[k]))
            p[k], c = n, c - n * int(size[k])
        n = int((left[p > 0] // p[p > 0]).min())
        out.append((p, n))
        left -= n * p
    return out


# ------------------------------------------------------------------ tokens

#: Bytes of texts that a task encodes at once; its arrays take many times as much.
RUN = 1 << 18
_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int32()), ("crc", pa.int64()), ("doc_tokens", pa.int64())])


def _cut(path: str, end_id: int, room: int):
    end = np.array([end_id], np.uint32)

    def run(batches):
        code = coder(path).encode
        for b in batches:
            ids = b.column(0).to_pylist()
            out: list[list] = [[] for _ in _PIECES]
            for i, texts in text_runs(b.column(1), RUN):
                for doc, tok in zip(ids[i : i + len(texts)], code(texts)):
                    tok = np.concatenate([tok, end])
                    for a in range(0, len(tok), room):
                        p = tok[a : a + room]
                        for c, v in zip(out, (doc, a, len(p), zlib.crc32(p.astype("<u4", copy=False)), len(tok))):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _PIECES)], schema=_PIECES)

    return run


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 2048, end_id: int = 1, step: int = 8, id_col: str = "doc_id", text_col: str = "text", per_part: int = 100_000) -> DataFrame:
    """Pack all documents into sequences of at most ``room`` tokens with little padding.

    Returns a row per piece: the id, ``start`` (the document's tokens before it),
    ``length``, ``ids_crc32``, ``doc_tokens`` (with the ending id), ``sequence_id``
    and ``offset`` in the sequence, gapless from 0. Full pieces are sequences of
    their own; tails are packed by the patterns of the program, over tail lengths
    rounded up to ``step`` (which bounds it to ``room / step`` sizes; what is longer than the last of them
    is a sequence of its own, so any ``room`` and ``step`` do).

    Null text is an empty one: its only token is the ending id. Null and repeated ids:
    each row is a document of its own. Empty input: no rows. Other columns are ignored.
    """
    room, step = int(room), int(step)
    full = max(1, room // step)
    pieces = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        releasing(_cut(tokenizer, end_id, room)), "doc_id long, start long, length int, crc long, doc_tokens long")
    pieces = written(pieces.withColumn("bin", F.least(F.ceil(F.col("length") / step), F.lit(full)).cast("int"))
                     .withColumn("mix", F.xxhash64("doc_id", "start", "crc")), "pack-pieces")
    # A rank within each length: a count for each (length, part) and its running sum,
    # so that no single task gets all pieces of a frequent length.
    parts = max(1, pieces.count() // per_part)
    pieces = pieces.withColumn("part", F.pmod("mix", F.lit(parts)).cast("int"))
    counts = pieces.groupBy("bin", "part").count()
    base = counts.select("bin", "part", (F.sum("count").over(W.partitionBy("bin").orderBy("part")) - F.col("count")).alias("base"))
    ranked = (pieces.withColumn("r", F.row_number().over(W.partitionBy("bin", "part").orderBy("mix", "doc_id", "start")))
              .join(base, ["bin", "part"]).withColumn("r", F.col("base") + F.col("r") - 1).drop("base", "part", "mix"))
    hist = {r["bin"]: r["n"] for r in counts.groupBy("bin").agg(F.sum("count").alias("n")).collect()}  # at most room / step rows
    bins = sorted(b for b in hist if b < full)
    plan = cutting_stock(np.array(bins, np.int64), np.array([hist[b] for b in bins], float), full)
    rows, first, taken = [], hist.get(full, 0), dict.fromkeys(bins, 0)
    for p, n in plan:
        for k in np.flatnonzero(p):
            b = bins[k]
            rows.append((b, taken[b], taken[b] + n * int(p[k]), int(p[k]), first))
            taken[b] += n * int(p[k])
        first += n
    if full in hist:
        rows.append((full, 0, hist[full], 1, 0))
    if taken != {b: hist[b] for b in bins}:
        raise AssertionError("the patterns don't hold every piece once")
    spark = docs.sparkSession
    # One row for each length in a pattern: bounded by the program's size, not by the data.
    where = spark.createDataFrame(rows, "bin int, lo long, hi long, each int, first long")
    placed = ranked.join(F.broadcast(where), (ranked["bin"] == where["bin"]) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi"))).drop(where["bin"])
    placed = placed.withColumn("sequence_id", F.col("first") + F.floor((F.col("r") - F.col("lo")) / F.col("each")))
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "r", "doc_id", "start")
    return placed.select(
        F.col("doc_id").alias(id_col), "start", F.col("length").cast("long").alias("length"), F.col("crc").alias("ids_crc32"), "doc_tokens",
        F.col("sequence_id").cast("long").alias("sequence_id"),
        (F.sum("length").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("length")).cast("long").alias("offset"))
