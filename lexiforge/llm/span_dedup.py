"""Substring deduplication by sliding sentence spans.

A sentence ends at a line break or at a word whose last character, but for closing
quotes and brackets, is ``.``, ``!``, ``?`` or an ideographic stop. In scripts without
spaces a character is a word. Sentences of more than ``long`` words are cut every
``long`` words, so that one long sentence is a run as well; those of more than twice
as many where the content says so, so that equal stretches have equal cuts at
any distance from the sentence's start. From every sentence the
shortest run of several consecutive sentences with at least ``min_words`` words is
hashed, forwards and backwards (backward runs cover a passage's tail). Runs meet
by hash over all documents; all but the first occurrence, by document id and
position, are repeats, and every sentence that a repeat covers goes. With
``passage``, repeats that touch are joined, the joined stretch is extended by the words that
also stand around the earlier occurrence, and goes only if it then has that many words.

Only the first occurrence of a hash in each task is shuffled by its hash alone:
later ones are repeats already, so a passage in a third of all documents sends a
row for each task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import IS_SPACE, batch, chunks, mixed, powers, releasing, replaced, running, semi, span_hash, told_apart, words, written

_ENDS = np.zeros(256, bool)
_ENDS[[33, 46, 63]] = True
_NEWLINE = np.zeros(256, np.int32)
_NEWLINE[[10, 11, 12, 13]] = 1


def _points(*ranges) -> np.ndarray:
    out = np.zeros(0x10000, bool)
    for a, z in ranges:
        out[a : z + 1] = True
    return out


#: By code point: stops, closing quotes and brackets, scripts without spaces, and what never begins a word of theirs.
_STOPS = _points((0x3002, 0x3002), (0xFF01, 0xFF01), (0xFF0E, 0xFF0E), (0xFF1F, 0xFF1F), (0xFF61, 0xFF61))
_CLOSE = _points(*[(ord(c), ord(c)) for c in "\"')]}\u00bb\u2019\u201d\u203a\u3009\u300b\u300d\u300f\u3011\u3015\u3017\u301f\uff02\uff07\uff09\uff3d\uff5d\uff63"])
_SPACELESS = _points((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF1F), (0xFF61, 0xFF9F))
_INSIDE = _STOPS | _CLOSE | _points((0x0E30, 0x0E3A), (0x0E45, 0x0E4E), (0x0EB0, 0x0EBC), (0x0EC8, 0x0ECE), (0x102B, 0x103E), (0x1056, 0x1059), (0x17B4, 0x17D3), (0x17DD, 0x17DD), (0x3001, 0x3001), (0x3099, 0x309C), (0x30FC, 0x30FC), (0xFF0C, 0xFF0C), (0xFF1A, 0xFF1B), (0xFF70, 0xFF70), (0xFF9E, 0xFF9F))


def _point(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The code points of the three-byte characters at ``at``."""
    a, b, c = (data[at + k].astype(np.int32) for k in range(3))
    return (a & 15) << 12 | (b & 63) << 6 | c & 63


def _pieces(data: np.ndarray, off: np.ndarray):
    """words(), with a word for each character in scripts without spaces."""
    start, end, doc = words(data, off)
    three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
    point = _point(data, three)
    alone = _SPACELESS[point]
    four = np.flatnonzero(data == 0xF0)
    four = four[data[four + 1] >= 0xA0]  # the ideographs' further planes
    if not len(start) or not (alone.any() or len(four)):
        return start, end, doc
    first = np.zeros(len(data) + 4, bool)
    first[three[alone] + 3] = True
    first[four + 4] = True
    first[three[_INSIDE[point]]] = False
    first[three[alone & ~_INSIDE[point]]] = True
    first[four] = True
    first = first[: len(data)] & ~IS_SPACE[data]
    first &= (data >= 0x80) | ~_CLOSE[data]
    first[start] = True
    cut = np.flatnonzero(first)
    word = np.searchsorted(start, cut, "right") - 1
    return cut, np.minimum(np.append(cut[1:], len(data)), end[word]), doc[word]


def _stopped(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Whether each word ends a sentence: a stop, and any closing quotes and brackets after it."""
    e = end.copy()
    out = np.zeros(len(e), bool)
    k = np.arange(len(e))
    while len(k):
        last = data[e[k] - 1]
        out[k] = _ENDS[last]
        one = (last < 0x80) & _CLOSE[last]
        size = one.astype(np.int64)
        wide = np.flatnonzero((last >= 0x80) & (e[k] - 3 >= start[k]))
        wide = wide[(data[e[k[wide]] - 3] & 0xF0) == 0xE0]
        point = _point(data, e[k[wide]] - 3)
        out[k[wide]] |= _STOPS[point]
        size[wide[_CLOSE[point]]] = 3
        size[(last == 0xBB) & (data[e[k] - 2] == 0xC2)] = 2
        k, size = k[size > 0], size[size > 0]
        e[k] -= size
        k = k[e[k] > start[k]]
    return out


def _content_cuts(w: np.ndarray, sentence: np.ndarray, far: np.ndarray, reach: int) -> np.ndarray:
    """Words of long sentences at which the hash of a word pair is least among ``reach`` on both sides.

    Only words near by count, so equal stretches have equal cuts. Ties all count, as in periodic text, but of
    a chain of them only every ``reach + 1``-th, or units would be too short.
    """
    n = len(w)
    h = np.zeros(n, np.uint64)
    h[1:] = mixed(w[:-1] * np.uint64(3) + w[1:])
    low = far.copy()
    low[0] = False
    low[1:] &= sentence[1:] == sentence[:-1]
    h[~low] = np.iinfo(np.uint64).max  # a sentence's first word, which is a cut anyway
    for k in range(1, min(reach, n - 1) + 1):
        other = sentence[k:] != sentence[:-k]
        low[k:] &= (h[k:] <= h[:-k]) | other
        low[:-k] &= (h[:-k] <= h[k:]) | other
    c = np.flatnonzero(low)
    if len(c):
        new = np.append(True, (np.diff(c) > reach) | (sentence[c[1:]] != sentence[c[:-1]]))
        at = np.arange(len(c))
        c = c[(at - np.maximum.accumulate(np.where(new, at, 0))) % (reach + 1) == 0]
    return c


def units(data: np.ndarray, off: np.ndarray, long: int):
    """Word starts, ends, texts and hashes, and the index of each unit's first word (a sentence, or a cut of one)."""
    start, end, doc = _pieces(data, off)
    n = len(start)
    if not n:
        return start, end, doc, np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = span_hash(running(data), start, end)
    breaks = np.concatenate([[0], np.cumsum(_NEWLINE[data], dtype=np.int64)])
    first = np.ones(n, bool)
    first[1:] = (doc[1:] != doc[:-1]) | _stopped(data, start[:-1], end[:-1]) | (breaks[start[1:]] > breaks[end[:-1]])
    s = np.flatnonzero(first)
    size = np.diff(np.append(s, n))
    inside = np.arange(n) - np.repeat(s, size)
    far = np.repeat(size > 2 * long, size)
    cut = (inside == 0) | (~far & (inside % long == 0))
    cut[_content_cuts(w, np.cumsum(first), far, long // 2)] = True
    return start, end, doc, w, np.flatnonzero(cut)


def spans_of(doc: np.ndarray, unit: np.ndarray, w: np.ndarray, min_words: int, least: int):
    """(document, first word, words, hash) of every run; words count within their document."""
    n = len(unit)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z, np.zeros(0, np.uint64)
    d = doc[unit]
    stop = np.append(unit[1:], len(w))
    base = np.searchsorted(d, np.arange(int(d[-1]) + 2))
    at = np.arange(n)
    # Forward: the first unit end with enough words; backward: the last unit start with enough.
    fwd = np.maximum(np.searchsorted(stop, unit + min_words), at + least - 1)
    bwd = np.minimum(np.searchsorted(unit, stop - min_words, "right") - 1, at - least + 1)
    f = at[(fwd < base[d + 1])]
    b = at[(bwd >= base[d])]
    a, z = np.concatenate([f, bwd[b]]), np.concatenate([fwd[f], b])
    key = np.unique(a * np.int64(n + 1) + z)
    a, z = key // (n + 1), key % (n + 1)
    # A run's hash: a polynomial of its words' hashes, by prefix sums.
    p, q = powers(len(w) + 1)
    s = np.zeros(len(w) + 1, np.uint64)
    np.cumsum(w * p[: len(w)], out=s[1:])
    h = mixed((s[stop[z]] - s[unit[a]]) * q[unit[a]] + (stop[z] - unit[a]).astype(np.uint64))
    return d[a], unit[a] - unit[base[d[a]]], stop[z] - unit[a], h


_SPANS = pa.schema([("hash", pa.int64()), ("salt", pa.int64()), ("id", pa.int64()), ("at", pa.int32()), ("n", pa.int32()), ("id2", pa.int64()), ("at2", pa.int32())])
#: The salt of the row that only says how many units a document has.
_COUNT = -1


def _spans(min_words: int, least: int, long: int, held: int = 200_000):
    def flush(parts):
        h, i, a, n = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((n, a, i, h))
        h, i, a, n = h[order], i[order], a[order], n[order]
        again = np.zeros(len(h), bool)
        same = h[1:] == h[:-1]
        # One document may hold the first run twice over; the same row given twice is the same run.
        again[1:] = same & ((i[1:] != i[:-1]) | (a[1:] != a[:-1]))
        group = np.cumsum(np.append(True, ~same)) - 1
        top = np.flatnonzero(np.append(True, ~same))[group]
        again &= (i != i[top]) | (a != a[top])
        salt = np.where(again, np.maximum(np.arange(len(h)) % 65521, 1), 0)
        id2, at2 = np.where(again, i[top], 0), np.where(again, a[top], 0)
        for k in range(0, len(h), 100_000):
            c = slice(k, k + 100_000)
            yield batch({"hash": h[c].view(np.int64), "salt": salt[c], "id": i[c], "at": a[c].astype(np.int32), "n": n[c].astype(np.int32),
                         "id2": id2[c], "at2": at2[c].astype(np.int32)}, _SPANS)

    def run(batches):
        parts, size = [], 0
        for b in batches:
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, data, off in chunks(b.column(1)):
                _, _, doc, w, unit = units(data, off, long)
                count = np.bincount(doc[unit], minlength=len(off) - 1).astype(np.int32)
                own, none = ids[row : row + len(count)], np.zeros(len(count), np.int64)
                yield batch({"hash": own, "salt": none + _COUNT, "id": own, "at": none.astype(np.int32), "n": count, "id2": none, "at2": none.astype(np.int32)}, _SPANS)
                d, a, n, h = spans_of(doc, unit, w, min_words, least)
                parts.append((h, ids[row + d], a, n))
                size += len(h)
                if size >= held:
                    yield from flush(parts)
                    parts, size = [], 0
        if size:
            yield from flush(parts)

    return run


def _numbered(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))


def _found(docs: DataFrame, min_words: int, least: int, long: int, id_col: str, text_col: str) -> DataFrame:
    """One pass over the texts: all repeats as repeated_spans() has them and, with a null ``id2``, each document's number of units."""
    spans = _numbered(docs, id_col, text_col).mapInArrow(releasing(_spans(min_words, least, long)), "hash long, salt long, id long, at int, n int, id2 long, at2 int")
    where = F.struct("id", "at")
    spans = spans.withColumn("first", F.min(where).over(W.partitionBy("hash", "salt"))).where((F.col("salt") != 0) | (where > F.col("first")))
    earlier = lambda held, top: F.when(F.col("salt") > 0, F.col(held)).when(F.col("salt") == 0, F.col(top)).alias(held)
    return spans.select("id", "at", "n", earlier("id2", "first.id"), earlier("at2", "first.at"))


def repeated_spans(docs: DataFrame, min_words: int = 20, least: int = 2, long: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All runs that repeat an earlier one: ``(id, at, n, id2, at2)``, the first word, the number of words, and an earlier place."""
    return _found(docs, min_words, least, long, id_col, text_col).where("id2 is not null")


def _stretches(gone: DataFrame) -> DataFrame:
    """Repeats with ``(a, z)``, the first word and the end of the stretch that those of a document which touch make together."""
    rows = gone.distinct().withColumn("end", F.col("at") + F.col("n"))
    order = W.partitionBy("id").orderBy("at", "end", "id2", "at2")  # a document's runs: at most two for each of its sentences
    before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.coalesce((F.col("at") > before).cast("int"), F.lit(1)))
    rows = rows.withColumn("part", F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    one = W.partitionBy("id", "part")
    return rows.withColumn("a", F.min("at").over(one)).withColumn("z", F.max("end").over(one)).drop("new", "part")


_AROUND = pa.schema([("id", pa.int64()), ("at", pa.int32()), ("side", pa.int32()), ("around", pa.binary())])


def _around(passage: int, long: int):
    """Hashes of up to ``passage`` words before (side 0, nearest first) or after (side 1) each place of each document."""

    def run(batches):
        for b in batches:
            places = b.column(2).to_pylist()
            for row, data, off in chunks(b.column(1)):
                _, _, doc, w, _ = units(data, off, long)
                w = (w >> np.uint64(32)).astype(np.uint32)
                edge = np.searchsorted(doc, np.arange(len(off)))
                out = {"id": [], "at": [], "side": [], "around": []}
                for d in range(len(off) - 1):
                    own = w[edge[d] : edge[d + 1]]
                    for p in places[row + d]:
                        k = p["at"]
                        x = own[k : k + passage] if p["side"] else own[max(0, k - passage) : k][::-1]
                        for name, value in (("id", b.column(0)[row + d].as_py()), ("at", k), ("side", p["side"]), ("around", x.tobytes())):
                            out[name].append(value)
                if out["id"]:
                    yield batch(out, _AROUND)

    return run


def _alike(batches):
    """Rows whose last two columns are words' hashes: how many leading ones are equal takes their place."""
    for b in batches:
        out = np.zeros(b.num_rows, np.int32)
        for k, (s, t) in enumerate(zip(b.column(b.num_columns - 2), b.column(b.num_columns - 1))):
            x, y = np.frombuffer(s.as_buffer(), np.uint32), np.frombuffer(t.as_buffer(), np.uint32)
            n = min(len(x), len(y))
            other = np.flatnonzero(x[:n] != y[:n])
            out[k] = other[0] if len(other) else n
        yield pa.RecordBatch.from_arrays([*b.columns[:-2], pa.array(out)], names=[*b.schema.names[:-2], "more"])


def _long_enough(docs: DataFrame, gone: DataFrame, passage: int, long: int, id_col: str, text_col: str) -> DataFrame:
    """``(id, at, n)``: the stretches of repeats that have ``passage`` words with what is equal around them."""
    rows = written(_stretches(gone), "span-stretches")
    sure = rows.where(F.col("z") - F.col("a") >= passage).select("id", F.col("a").alias("at"), (F.col("z") - F.col("a")).alias("n")).distinct()
    # Any of the other runs may stand with more equal words in its own earlier place, before it (side 0) or after it.
    short = rows.where(F.col("z") - F.col("a") < passage)
    side = lambda k, more: short.select("id", "a", "z", F.lit(k).alias("side"), (F.col("at") + more).alias("at"), "id2", (F.col("at2") + more).alias("at2"))
    ends = written(side(0, F.lit(0)).unionByName(side(1, F.col("n"))).distinct(), "span-ends")
    places = ends.select("id", "at", "side").unionByName(ends.select(F.col("id2").alias("id"), F.col("at2").alias("at"), "side")).distinct()
    places = written(places.groupBy("id").agg(F.collect_list(F.struct("at", "side")).alias("places")), "span-places")  # at most two for each sentence of one document
    # Rows that share an id are one document given twice.
    texts = semi(_numbered(docs, id_col, text_col), places.select("id"), "id").join(places, "id").select("id", "text", "places")
    around = texts.mapInArrow(releasing(_around(passage, long)), "id long, at int, side int, around binary").groupBy("id", "at", "side").agg(F.max("around").alias("around"))
    around = written(around, "span-around")
    there = around.select(F.col("id").alias("id2"), F.col("at").alias("at2"), "side", F.col("around").alias("around2"))
    both = ends.join(around, ["id", "at", "side"]).join(there, ["id2", "at2", "side"])
    more = both.select("id", "a", "z", "side", "at", "around", "around2").mapInArrow(releasing(_alike), "id long, a int, z int, side int, at int, more int")
    more = more.groupBy("id", "a", "z").agg(F.max(F.when(F.col("side") == 1, F.col("at") + F.col("more"))).alias("to"), F.min(F.when(F.col("side") == 0, F.col("at") - F.col("more"))).alias("since"))
    return sure.unionByName(more.where(F.col("to") - F.col("since") >= passage).select("id", F.col("a").alias("at"), (F.col("z") - F.col("a")).alias("n")))


def _shorter(text: str, gone: list[dict], long: int) -> tuple[str, int]:
    """The text without the units that begin inside a run (runs count words), and how many those are."""
    if not text:
        return text, 0
    _, data, off = next(chunks(pa.array([text], pa.string())))
    start, _, _, _, unit = units(data, off, long)
    n = len(unit)
    change = np.zeros(n + 1, np.int64)
    for r in gone:
        a, z = np.searchsorted(unit, [r["at"], r["at"] + r["n"]])
        change[a] += 1
        change[z] -= 1
    keep = np.flatnonzero(np.cumsum(change)[:n] == 0)
    if len(keep) == n:
        return text, 0
    raw, edge = data.tobytes(), np.append(start[unit], len(data))
    return b"".join(raw[edge[i] : edge[i + 1]] for i in keep).decode("utf-8").rstrip(), n - len(keep)


def _rewrite(text: int, long: int):
    """Rows whose last two columns are the number of units and the runs that go; the number of lost units takes the latter's place."""

    def run(batches):
        for b in batches:
            gone, new, lost = b.column(b.num_columns - 1), {}, np.zeros(b.num_rows, np.int64)
            for k in np.flatnonzero(gone.is_valid().to_numpy(zero_copy_only=False)):
                if b.column(text)[k].is_valid:
                    new[int(k)], lost[k] = _shorter(b.column(text)[k].as_py(), gone[k].as_py(), long)
            columns = list(b.columns)
            columns[text] = replaced(columns[text], new)
            columns[-1] = pa.array(lost)
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names[:-2], "n_units", "n_removed"])

    return run


#: The shortest passage that the registered queries remove.
PASSAGE = 50


def dedup_spans(docs: DataFrame, min_words: int = 20, least: int = 2, long: int = 10, passage: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``text`` freed of repeated passages, and two columns: ``n_units`` and ``n_removed``.

    ``passage`` is the least number of words of a passage, words of sentences cut off by its
    ends included; 0 removes every repeated run of ``min_words``.

    All rows and columns stay (also a document all of whose text was repeated: its
    text is then empty); an unchanged text stays byte for byte, and columns named
    ``n_units`` or ``n_removed`` are replaced. Null or empty text has no units and stays. Rows with a
    null id are kept unchanged, with 0 units, and matched with nothing. Rows that share id and text are
    one document given twice: they keep and lose the same sentences. Rows that share an id with different texts are
    documents of their own, the further ones behind all others. Ties of
    position: the smallest id comes first. An empty table stays empty.
    """
    given, docs, id_col = docs.columns, told_apart(docs, id_col, text_col, "__span_key"), "__span_key"
    found = written(_found(docs, min_words, least, long, id_col, text_col), "span-repeats")
    gone = found.where("id2 is not null")
    if passage:
        gone = _long_enough(docs, gone, passage, long, id_col, text_col)
    # Of one document: its number of units, and at most two repeats for each.
    about = (found.where("id2 is null").select("id", "n", F.lit(None).cast("struct<at:int,n:int>").alias("gone"))
             .unionByName(gone.select("id", F.lit(0).alias("n"), F.struct("at", "n").alias("gone")))
             .groupBy(F.col("id").alias("__span_id")).agg(F.max("n").alias("__span_n"), F.collect_list("gone").alias("__span_gone")))
    about = about.withColumn("__span_gone", F.expr("if(size(__span_gone) > 0, __span_gone, null)"))
    names = [c for c in given if c not in ("n_units", "n_removed")]
    own = docs.select(*[f"`{c}`" for c in names])
    out = docs.join(about, F.col(id_col) == F.col("__span_id"), "left")
    out = out.select(*[f"`{c}`" for c in names], F.coalesce("__span_n", F.lit(0)).cast("long").alias("__span_n"), "__span_gone")
    schema = T.StructType([*own.schema, T.StructField("n_units", T.LongType()), T.StructField("n_removed", T.LongType())])
    return out.mapInArrow(releasing(_rewrite(names.index(text_col), long)), schema)
