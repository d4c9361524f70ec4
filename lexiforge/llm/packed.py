"""Runs of texts and packed messages, for operators that exchange a number for every word of a corpus.

A row for each word would cost the JVM more than the counting itself. Texts are read in runs of a
bounded number of bytes; a run sends each range of keys one row whose binary columns are arrays.
A range is a group of bounded size, since ranges grow in number with the input; a frequent key has one entry for each run.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_binary

#: Bytes of text of a run, and of text for each range of keys.
RUN, SHARE = 4 << 20, 8 << 20
#: Words that have a three-byte code in messages (the most frequent ones; 8 bytes each are broadcast). Others are sent whole.
BOOK, OTHER = 1 << 18, 0xFFFFFF
_ODD = np.uint64(0x9E3779B97F4A7C15)


def gathered(batches, column: int, limit: int = RUN):
    """Batches put together until the texts in ``column`` have ``limit`` bytes."""
    held, size = [], 0
    for b in batches:
        held.append(b)
        size += pc.sum(pc.binary_length(b.column(column))).as_py() or 0
        if size >= limit:
            yield _one(held)
            held, size = [], 0
    if held:
        yield _one(held)


def _one(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches(max_chunksize=None)[0]


def n_ranges(docs: DataFrame, share: int = SHARE) -> int:
    """Ranges of keys for these texts: one for each ``share`` bytes, as many as shuffle partitions at least."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // share))


def arrays(column: pa.ChunkedArray | pa.Array, dtype) -> list[np.ndarray]:
    """Each binary row as an array."""
    return [np.frombuffer(x.as_buffer(), dtype) if x.is_valid and len(x.as_buffer()) else np.zeros(0, dtype) for x in column]


def joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All rows' values in one array, and how many each row has."""
    parts = arrays(column, dtype)
    return (np.concatenate(parts) if parts else np.zeros(0, dtype)), np.array([len(p) for p in parts], np.int64)


def pieces(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """Binary rows values[edges[k]:edges[k + 1]]."""
    off = np.asarray(edges, np.int64) * values.itemsize
    if off[-1] - off[0] >= 2**31 - 1:
        return as_binary([values[a:b] for a, b in zip(edges[:-1], edges[1:])])
    body = np.ascontiguousarray(values[edges[0] : edges[-1]])
    return pa.BinaryArray.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer((off - off[0]).astype(np.int32)), pa.py_buffer(body)])


def firsts(sorted_keys: np.ndarray) -> np.ndarray:
    """Where each new value begins."""
    if not len(sorted_keys):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]]))


def range_of(key: np.ndarray, ranges: int) -> np.ndarray:
    """The range that a 64-bit hash belongs to."""
    return ((key * _ODD >> np.uint64(20)) % np.uint64(ranges)).astype(np.int32)


def among(key: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    """Whether each key is one of ``sorted_keys``."""
    if not len(sorted_keys):
        return np.zeros(len(key), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, key), len(sorted_keys) - 1)] == key


def order_of(*keys: np.ndarray) -> np.ndarray:
    """The stable order by several numbers from 0, the first one counting most: one plain sort where they and the place fit 64 bits together."""
    n = len(keys[0])
    bits, low = [int(k.max()).bit_length() if n else 0 for k in keys], np.uint64(n.bit_length())
    if sum(bits) + int(low) > 64:
        return np.lexsort(keys[::-1])
    key = np.zeros(n, np.uint64)
    for k, b in zip(keys, bits):
        key = key << np.uint64(b) | k.astype(np.uint64)
    key = key << low | np.arange(n, dtype=np.uint64)
    key.sort()
    return (key & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)


def numbered(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct values, and each value's place among them (by hashing; only distinct values are sorted)."""
    d = pa.array(values).dictionary_encode()
    word = d.dictionary.to_numpy()
    order = np.argsort(word)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return word[order], place[d.indices.to_numpy()]


def three_bytes(values: np.ndarray) -> np.ndarray:
    """The low three bytes of each number."""
    return np.ascontiguousarray(values.astype(np.uint32).view(np.uint8).reshape(-1, 4)[:, :3]).reshape(-1)


def from_three(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 3, 4), np.uint8)
    out[:, :3] = raw.reshape(-1, 3)
    return out.view(np.uint32).reshape(-1)


def coded(name: np.ndarray, book: np.ndarray, edges: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Binary rows of the names' three-byte places in the sorted ``book``, and of the names that have none."""
    known = among(name, book)
    code = np.where(known, np.searchsorted(book, name), OTHER)
    rest = np.concatenate([[0], np.cumsum(~known)])
    return pieces(three_bytes(code), np.asarray(edges) * 3), pieces(name[~known], rest[edges])


def decoded(codes, others, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What coded() took, of all rows, and how many each row has."""
    raw, per = joined(codes, np.uint8)
    code = from_three(raw)
    name = book[np.minimum(code, len(book) - 1)] if len(book) else np.zeros(len(code), np.uint64)
    name[code == OTHER] = joined(others, np.uint64)[0]
    return name, per // 3


def swept(spark) -> None:
    """Asks the driver's JVM to collect, after which Spark removes the shuffle files of steps whose results are written."""
    spark.sparkContext._jvm.System.gc()
