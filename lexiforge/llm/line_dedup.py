"""Line deduplication by a segment-partition edit join.

Lines are compared without surrounding white space. Equal lines, and lines within a few
single-character edits, are one class; of each class the first line, by document id and
position, stays. How many edits grows with the shorter line's length: one from the first of
``lengths`` characters on, two from the second, and so on; lines shorter than all of them have none to spare.

The edit join splits every line into one segment more than it has edits: of two lines within
the threshold, one holds a segment of the other unchanged. Segments are indexed
by length, number and hash; lines probe, for every shorter length in reach, only
the substrings at starts that a match in that segment allows. Lines that meet are
verified with a banded bit-parallel edit distance, many pairs at a time.

Many variants of one line would meet in all pairs, so they are verified in two
rounds: with the smallest line of each bucket, then only lines that no chain
of verified links connects yet.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batch, components, mixed, point_table, powers, releasing, replaced, semi, text_runs, told_apart, written

#: The least lengths of lines with one edit and with two.
LENGTHS = (12, 30)
#: Bytes of text whose occurrences are taken at a time: arrays over their characters stay in a core's cache.
RUN = 1 << 16

_FILLED = np.ones(0x3002, bool)  # the last one stands for all further code points
_FILLED[[32, *range(9, 14), 0x1C, 0x1D, 0x1E, 0x1F, 0x85, 0xA0, 0x3000]] = False


def _points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), off


def _sums(cp: np.ndarray) -> np.ndarray:
    p, _ = powers(len(cp) + 1)
    s = np.zeros(len(cp) + 1, np.uint64)
    x = point_table()[cp]
    x *= p[: len(cp)]
    np.cumsum(x, out=s[1:])
    return s


def _hash(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    _, q = powers(len(s))
    return mixed((s[b] - s[a]) * q[a] + (b - a).astype(np.uint64))


def split_lines(texts: list[str]):
    """Code points, and start, end, text index and number of every line that isn't blank."""
    cp, off = _points(texts)
    text = np.flatnonzero(_FILLED.take(cp, mode="clip"))
    if not len(text):
        z = np.zeros(0, np.int64)
        return cp, z, z, z, z
    breaks = np.flatnonzero(cp == 10)
    doc = np.searchsorted(off, breaks, "right") - 1
    # Lines end at breaks and at the texts' ends, begin behind them, and are trimmed to their first and last character that isn't blank.
    end = np.sort(np.concatenate([breaks, off[1:]]), kind="stable")
    of = np.sort(np.concatenate([doc, np.arange(len(texts))]), kind="stable")
    number = np.arange(len(end)) - np.searchsorted(of, np.arange(len(texts)))[of]
    start = np.concatenate([[0], end[:-1]])
    a, z = np.searchsorted(text, start), np.searchsorted(text, end)
    k = np.flatnonzero(a < z)
    return cp, text[a[k]], text[z[k] - 1] + 1, of[k], number[k]


_OCC = pa.schema([("h", pa.int64()), ("g", pa.int64()), ("doc", pa.int64()), ("line", pa.int32())])


def _occurrences(batches):
    for b in batches:
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for i, texts in text_runs(b.column(1), RUN):
            cp, a, z, doc, line = split_lines(texts)
            h = _hash(_sums(cp), a, z)
            # The second sum takes each second character of a line twice.
            wide = np.zeros(len(cp) + 2, np.int64)
            wide[2:] = cp
            even, odd = np.cumsum(wide[::2]), np.cumsum(wide[1::2])
            even, odd = even[(z + 1) // 2] - even[(a + 1) // 2], odd[z // 2] - odd[a // 2]
            w = even + odd + np.where(a & 1, even, odd)
            yield batch({"h": h.view(np.int64), "g": (z - a) * np.int64(1 << 40) + w, "doc": ids[i + doc].astype(np.int64), "line": line.astype(np.int32)}, _OCC)


_ENTRIES = pa.schema([("key", pa.int64()), ("id", pa.int64()), ("kind", pa.int64())])
#: Two flags and, above them, a parity bitmap of the line's characters in BUCKETS
#: classes: an edit flips two bits at most.
INDEX, PROBE, BUCKETS = 1, 2, 48


_buckets: list[np.ndarray] = []


def _bucket_table() -> np.ndarray:
    """Each code point's class as a bit above the flags; one table for each worker."""
    if not _buckets:
        _buckets.append(np.int64(4) << (np.arange(0x110000) % BUCKETS))
    return _buckets[0]


def edits_of(size: np.ndarray, lengths: tuple[int, ...]) -> np.ndarray:
    """The edits that lines of so many characters may differ in."""
    return np.searchsorted(np.asarray(lengths), size, "right")


def segment_keys(s: np.ndarray, a: np.ndarray, n: np.ndarray, lengths: tuple[int, ...]):
    """Yields (rows, keys, kind) of the index and probe entries of the lines at a of n characters."""
    for edits in range(1, len(lengths) + 1):
        parts = edits + 1
        for less in range(edits + 1):
            size = n - less  # of the line that is looked for; it says how many edits and segments there are
            base, more = size // parts, size % parts
            fits = edits_of(size, lengths) == edits
            for i in range(parts) if fits.any() else ():
                length = base + (i >= parts - more)
                start = i * base + np.maximum(0, i - (parts - more))
                for shift in range(max(-i, less - (edits - i)), min(i, less + (edits - i)) + 1):
                    p = start + shift
                    ok = np.flatnonzero(fits & (p >= 0) & (p + length <= n))
                    x = a[ok] + p[ok]
                    key = mixed(_hash(s, x, x + length[ok]) + size[ok].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(i * 0x51ED27))
                    yield ok, key, PROBE | (INDEX if less == 0 and shift == 0 else 0)


def _entries(lengths: tuple[int, ...], remembered: int = 1_000_000):
    def run(batches):
        seen = np.zeros(0, np.uint64)
        for b in batches:
            for _, texts in text_runs(b.column(0)):
                cp, a, z, _, _ = split_lines(texts)
                a, z = a[z - a >= lengths[0]], z[z - a >= lengths[0]]
                s = _sums(cp)
                h = _hash(s, a, z)
                # A line is entered once for each task, or a frequent one would crowd its buckets.
                h, k = np.unique(h, return_index=True)
                if len(seen):
                    new = seen[np.minimum(np.searchsorted(seen, h), len(seen) - 1)] != h
                    h, k = h[new], k[new]
                seen = np.union1d(seen, h) if len(seen) < remembered else h
                a, z = a[k], z[k]
                odd = np.zeros(len(cp) + 1, np.int64)
                np.bitwise_xor.accumulate(_bucket_table()[cp], out=odd[1:])
                bits = odd[z] ^ odd[a]
                found = [(key.view(np.int64), h[ok].view(np.int64), bits[ok] | kind) for ok, key, kind in segment_keys(s, a, z - a, lengths)]
                if found:
                    yield batch(dict(zip(_ENTRIES.names, map(np.concatenate, zip(*found)))), _ENTRIES)

    return run


_LINES = pa.schema([("id", pa.int64()), ("line", pa.string())])


def _texts(batches):
    for b in batches:
        for _, texts in text_runs(b.column(0)):
            cp, a, z, _, _ = split_lines(texts)
            h = _hash(_sums(cp), a, z)
            h, k = np.unique(h, return_index=True)
            whole = "".join(texts)
            yield batch({"id": h.view(np.int64), "line": [whole[x:y] for x, y in zip(a[k].tolist(), z[k].tolist())]}, _LINES)


def within(x: list[str], y: list[str], k: int) -> np.ndarray:
    """Whether each pair of texts is within k edits: a bit vector for each pair's diagonal band, advanced together."""
    out = np.zeros(len(x), bool)
    pair = [(s, t) if len(s) >= len(t) else (t, s) for s, t in zip(x, y)]
    m, n = np.array([len(s) for s, _ in pair], np.int64), np.array([len(t) for _, t in pair], np.int64)
    todo = np.flatnonzero((m - n <= k) & (n > k))
    short = np.flatnonzero((m - n <= k) & (n <= k))
    out[short] = [_plain(*pair[i]) <= k for i in short]
    todo = todo[np.argsort(m[todo], kind="stable")]
    i = 0
    while i < len(todo):
        j = i + 1
        while j < len(todo) and j - i < 4096 and (j - i + 1) * (m[todo[j]] + 2 * k) < 4_000_000 and m[todo[j]] <= 1.3 * m[todo[i]] + 64:
            j += 1
        out[todo[i:j]] = _band([pair[q] for q in todo[i:j]], m[todo[i:j]], n[todo[i:j]], k)
        i = j
    return out


def _plain(s: str, t: str) -> int:
    row = list(range(len(t) + 1))
    for i, c in enumerate(s, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(t, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return row[-1]


def _band(pair, m: np.ndarray, n: np.ndarray, k: int) -> np.ndarray:
    width = int(m.max())
    a = np.full((len(pair), width + 3 * k + 2), 0xFFFFFFFF, np.uint32)  # k columns of margin before
    b = np.full((len(pair), width + 1), 0xFFFFFFFE, np.uint32)
    for r, (s, t) in enumerate(pair):
        a[r, k : k + len(s)] = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
        b[r, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
    a, b = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    one, ones = np.uint64(1), np.uint64(0xFFFFFFFFFFFFFFFF)
    vp = np.full(len(pair), ones << np.uint64(63 - k), np.uint64)
    vn = np.zeros(len(pair), np.uint64)
    dist = np.full(len(pair), k, np.int64)
    for c in range(int(n.max())):
        live = c < n
        pm = np.zeros(len(pair), np.uint64)
        for t in range(2 * k + 1):  # row c + k - t of the longer text, at bit 63 - t
            pm |= (a[c + 2 * k - t] == b[c]).astype(np.uint64) << np.uint64(63 - t)
        d0 = (((pm & vp) + vp) ^ vp) | pm | vn
        hp, hn = vn | ~(d0 | vp), d0 & vp
        sloping = c + k < m
        dist += live & sloping & ((d0 >> np.uint64(63)) == 0)
        bit = np.clip(62 - (c + k - m), 0, 63).astype(np.uint64)
        level = live & ~sloping
        dist += np.where(level, ((hp >> bit) & one).astype(np.int64) - ((hn >> bit) & one).astype(np.int64), 0)
        vp, vn = hn | ~((d0 >> one) | hp), (d0 >> one) & hp
    return dist <= k


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _verify(lengths: tuple[int, ...]):
    def run(batches):
        for b in batches:
            x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
            most = edits_of(np.array([min(len(s), len(t)) for s, t in zip(x, y)], np.int64), lengths)
            keep = np.zeros(len(x), bool)
            for k in np.unique(most[most > 0]):
                at = np.flatnonzero(most == k)
                keep[at] = within([x[i] for i in at], [y[i] for i in at], int(k))
            keep = pa.array(keep)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], schema=_LINKS)

    return run


def line_classes(docs: DataFrame, occ: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links among different lines within the edit threshold: components ``(id, component)`` of line hashes."""
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    rows = base.select("text").mapInArrow(releasing(_entries(lengths)), "key long, id long, kind long")
    by = W.partitionBy("key")
    rows = rows.withColumn("lo", F.min("id").over(by)).withColumn("hi", F.max("id").over(by)).where("lo < hi")
    rows = written(rows.groupBy("key", "id").agg(F.bit_or("kind").alias("kind")), "line-entries")
    # Lines within the threshold differ in two bits for each edit at most.
    close = f"bit_count(shiftrightunsigned(k ^ l, 2)) <= {2 * len(lengths)}"
    tops = rows.where(f"kind & {INDEX} > 0").groupBy("key").agg(F.min(F.struct("id", "kind")).alias("t")).select("key", F.col("t.id").alias("b"), F.col("t.kind").alias("l"))
    first = rows.withColumnRenamed("kind", "k").join(tops, "key").where(f"id <> b and {close}").select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))
    first = written(first.distinct(), "line-first")
    links = _linked(base, occ, first, lengths)
    roots = components(links)
    rows = rows.join(roots, "id", "left").select("key", "id", "kind", F.coalesce("component", "id").alias("root"))
    rows = written(rows, "line-roots")
    mixed_keys = rows.groupBy("key").agg(F.min("root").alias("l"), F.max("root").alias("h")).where("l < h").select("key")
    wide = rows.join(mixed_keys, "key", "left_semi")
    x = wide.where(f"kind & {INDEX} > 0").select("key", F.col("id").alias("i"), F.col("kind").alias("k"), F.col("root").alias("r")).alias("x")
    y = wide.select("key", F.col("id").alias("j"), F.col("kind").alias("l"), F.col("root").alias("s")).alias("y")
    pairs = x.join(y, (F.col("x.key") == F.col("y.key")) & F.expr(f"r <> s and {close}")).select(F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"))
    # Pairs of the first round that failed needn't be verified again.
    more = _linked(base, occ, pairs.distinct().join(first, ["a", "b"], "left_anti"), lengths)
    return components(links.unionByName(more))


def _linked(base: DataFrame, occ: DataFrame, pairs: DataFrame, lengths: tuple[int, ...]) -> DataFrame:
    pairs = written(pairs.distinct(), "line-pairs")
    need = written(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct(), "line-need")
    # Only documents that hold a line's first occurrence are read again.
    holders = semi(occ.select(F.col("h").alias("id"), "doc"), need, "id").groupBy("id").agg(F.min("doc").alias("doc")).select("doc").distinct()
    texts = semi(base, written(holders, "line-holders"), "doc").select("text").mapInArrow(releasing(_texts), "id long, line string")
    texts = written(semi(texts, need, "id").dropDuplicates(["id"]), "line-texts")
    x = texts.select(F.col("id").alias("a"), F.col("line").alias("x"))
    y = texts.select(F.col("id").alias("b"), F.col("line").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(releasing(_verify(lengths)), "a long, b long"), "line-links")


def _without(text: int):
    """Rows whose last two columns are the number of lines and the lines that go; their number takes the latter's place."""

    def run(batches):
        for b in batches:
            gone, new = b.column(b.num_columns - 1), {}
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                lost, t = set(gone[k].as_py()), b.column(text)[k].as_py()
                new[int(k)] = "\n".join([x for i, x in enumerate((t or "").split("\n")) if i not in lost])
            columns = list(b.columns)
            columns[text] = replaced(columns[text], new)
            columns[-1] = pc.fill_null(pc.list_value_length(gone), 0)
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-2], "n_lines", "n_removed"])

    return run


def dedup_lines(docs: DataFrame, lengths: tuple[int, ...] = LENGTHS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` freed of lines that repeat an earlier one, and two columns: ``n_lines`` and ``n_removed``.

    All rows and columns stay (a document all of whose lines are repeats gets an empty
    text); columns named ``n_lines`` or ``n_removed`` are replaced. Blank lines count for
    nothing and stay. Null or empty text has no lines. Rows with a null id are kept
    unchanged and matched with nothing. Rows that share id and text are one document given
    twice: they keep and lose the same line numbers. Rows that share an id with different texts are documents of
    their own, the further ones behind all others. Ties: the smallest id, then the first line. An empty table stays empty.
    """
    given, docs, id_col = docs.columns, told_apart(docs, id_col, text_col, "__line_key"), "__line_key"
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    occ = written(base.mapInArrow(releasing(_occurrences), "h long, g long, doc long, line int"), "line-occurrences")
    roots = line_classes(docs, occ, lengths, id_col, text_col).select(F.col("id").alias("h"), "component")
    occ = occ.join(roots, "h", "left").select(
        F.coalesce("component", "h").alias("c"), F.when(F.col("component").isNull(), F.col("g")).otherwise(F.lit(0)).alias("g"), "doc", "line")
    where = F.struct("doc", "line")
    tops = occ.groupBy("c", "g").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first < last").select("c", "g", "first")
    gone = occ.join(tops, ["c", "g"]).where(where > F.col("first"))
    counts = occ.groupBy("doc").agg(F.count_distinct("line").alias("__line_n"))
    gone = gone.groupBy("doc").agg(F.collect_set("line").alias("__line_gone"))  # at most the lines of one document
    found = counts.join(gone, "doc", "left").withColumnRenamed("doc", "__line_doc")
    names = [c for c in given if c not in ("n_lines", "n_removed")]
    out = docs.join(found, F.col(id_col) == F.col("__line_doc"), "left")
    out = out.select(*[f"`{c}`" for c in names], F.coalesce("__line_n", F.lit(0)).cast("long").alias("__line_n"), "__line_gone")
    schema = T.StructType([*docs.select(*[f"`{c}`" for c in names]).schema, T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.IntegerType())])
    return out.mapInArrow(releasing(_without(names.index(text_col))), schema)
