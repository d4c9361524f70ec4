"""Helpers that several operators of this subpackage share.

Storage: lineage is cut by Parquet tables in the folder that the cluster names
in ``spark.checkpoint.dir`` (a shared one) or that was given to ``setCheckpointDir``; only
where neither is set and the master is local, as in tests, a folder of our own is set.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for tables that cut lineage; every executor can read it."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = sc.applicationId
        if app not in _own:
            _own[app] = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
        at = _own[app]
    return at.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, removed when the driver ends.

    Survives the loss of executors, and later reads start from the files.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lexiforge-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out.written_to = path
    return out


def forget(df: DataFrame) -> None:
    """Delete the files of a table of written() that nothing will read again."""
    _remove(df.sparkSession, df.written_to)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        sc = spark.sparkContext
        if sc._jsc is not None:
            p = sc._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder goes with it
        pass


def semi(big: DataFrame, ids: DataFrame, key: str, limit: int = 500_000, how: str = "left_semi") -> DataFrame:
    """Rows of ``big`` whose ``key`` is in ``ids`` (one distinct long column of that name; ``left_anti``: is not).

    ``ids`` is broadcast only when its counted rows are at most ``limit``
    (8 MB of longs); beyond that the join is shuffled.
    """
    small = ids.limit(limit + 1).count() <= limit
    return big.join(F.broadcast(ids) if small else ids.hint("merge"), key, how)


def told_apart(docs: DataFrame, id_col: str, text_col: str, key: str) -> DataFrame:
    """``docs`` with a column ``key``: the id, but a number of its own for each further text of an id that has several.

    Rows that share id and text share the key. Of an id's texts the one with the smallest hash keeps the id, the others' keys
    are beyond all ids. Usually no id has several texts, which one aggregation of two numbers for each row finds out.
    """
    own = docs.withColumn(key, F.col(id_col).cast("long"))
    h = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("i"), h.alias("h"))
    per = rows.groupBy("i").agg(F.min("h").alias("lo"), F.max("h").alias("hi"))
    found = per.agg(F.max("i").alias("most"), F.count_if(F.col("lo") < F.col("hi")).alias("n")).first()
    if not found["n"]:
        return own
    if found["most"] >= 2**62:
        raise ValueError("ids with several texts need ids below 2 ** 62")
    others = rows.join(per.where("lo < hi"), "i").where("h > lo").select("i", "h").distinct()
    others = written(others.withColumn("new", F.lit(found["most"] + 1) + F.monotonically_increasing_id()), "further-texts")
    out = own.withColumn("__h", h).join(others.withColumnsRenamed({"i": "__i", "h": "__g"}), (F.col(key) == F.col("__i")) & (F.col("__h") == F.col("__g")), "left")
    return out.withColumn(key, F.coalesce("new", key)).drop("__h", "__i", "__g", "new")


def components(links: DataFrame) -> DataFrame:
    """Connected components of ``links(a, b)`` (longs): one row ``(id, component)`` per node.

    ``component`` is the smallest id of the component. Alternates large-star
    and small-star steps (edges are rewired to the smallest neighbour) until the
    edge set stands still; every step is an aggregation and a join, and edges are
    written between rounds so that lost executors cost one round. Null ends and
    self links are ignored; no links give no rows.
    """
    edges = written(
        links.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        old, edges = edges, written(small, "edges")
        forget(old)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    root = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    tops = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return root.unionByName(tops)


# ---------------------------------------------------------------- memory of workers

try:
    _libc = ctypes.CDLL(None)
    # Arrays of 256 KB and more go back to the system when they are freed; else a
    # worker that serves many stages keeps the largest of each.
    _libc.mallopt(-3, 256 << 10)
    pa.set_memory_pool(pa.system_memory_pool())  # Arrow's own pool would keep them likewise
except (OSError, AttributeError):  # another C library
    _libc = None


def release() -> None:
    """Give freed memory back; called at the end of a worker's partition."""
    pa.default_memory_pool().release_unused()
    if _libc is not None and hasattr(_libc, "malloc_trim"):
        _libc.malloc_trim(0)


def releasing(run):
    """A mapInArrow function that gives memory back when its partition ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return wrapped


def replaced(column: pa.Array, new: dict[int, str]) -> pa.Array:
    """``column`` with the values of some rows replaced."""
    if not new:
        return column
    at, values = np.fromiter(new, np.int64, len(new)), pa.array(list(new.values()), column.type)
    mask = np.zeros(len(column), bool)
    mask[at] = True
    order = np.argsort(at, kind="stable")
    return pc.replace_with_mask(column, pa.array(mask), values.take(pa.array(order)))


def text_runs(column: pa.Array, limit: int = 1 << 20):
    """(first row, texts) of runs of about ``limit`` bytes; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    off = np.concatenate([[0], np.cumsum(size)])
    i, n = 0, len(column)
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield i, column.slice(i, j - i).to_pylist()
        i = j


# ---------------------------------------------------------------- text as bytes

_T = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_PI = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_K = np.random.default_rng(97).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_mixed_points: list[np.ndarray] = []
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Space and the controls from tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
CHUNK = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse."""
    if len(_pow[0]) < n:
        for k, base in enumerate((_P, _PI)):
            p = np.full(max(n, CHUNK), base, np.uint64)
            p[0] = 1
            _pow[k] = np.multiply.accumulate(p)
    return _pow[0][:n], _pow[1][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def point_table() -> np.ndarray:
    """A hash for each code point; one table for all operators of a worker."""
    if not _mixed_points:
        _mixed_points.append(mixed(np.arange(1, 0x110001, dtype=np.uint64)))
    return _mixed_points[0]


def chunks(column: pa.Array, limit: int = CHUNK):
    """(first row, bytes, offsets) of runs of texts of about ``limit`` bytes; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def running(data: np.ndarray) -> np.ndarray:
    """Prefix sums s, one longer than data, from which span_hash() takes any span."""
    p, _ = powers(len(data) + 1)
    s = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_T[data] * p[: len(data)], out=s[1:])
    return s


def span_hash(s: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end); equal bytes, equal hash."""
    _, q = powers(len(s))
    return mixed((s[end] - s[start]) * q[start] + (end - start).astype(np.uint64) * _K[63])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words (runs of other bytes than white space), and each one's text."""
    mark = ~IS_SPACE[data]
    before, after = np.zeros_like(mark), np.zeros_like(mark)
    before[1:], after[:-1] = mark[:-1], mark[1:]
    filled = np.flatnonzero(off[1:] > off[:-1])
    before[off[filled]] = False
    after[off[filled + 1] - 1] = False
    start, end = np.flatnonzero(mark & ~before), np.flatnonzero(mark & ~after) + 1
    return start, end, np.searchsorted(off, start, "right") - 1


def sequence_hash(w: np.ndarray, n: int) -> np.ndarray:
    """Hashes of every n consecutive word hashes (len(w) - n + 1 of them)."""
    m = len(w) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = np.full(m, n, np.uint64)
    for j in range(n):
        h += w[j : j + m] * _K[j]
    return mixed(h)


def shingle_sets(column: pa.Array, n: int, lower: bool = True):
    """For each text in turn the sorted distinct 64-bit hashes of its n-word shingles.

    A text of fewer words has its whole sequence as its one shingle; without words none.
    """
    empty = np.zeros(0, np.uint64)
    for _, data, off in chunks(column):
        data = LOWER[data] if lower else data
        start, end, doc = words(data, off)
        w = span_hash(running(data), start, end)
        h = sequence_hash(w, n)
        edge = np.searchsorted(doc, np.arange(len(off)))
        for d in range(len(off) - 1):
            a, b = edge[d], edge[d + 1]
            if b - a >= n:
                yield np.unique(h[a : b - n + 1])
            elif b > a:
                yield sequence_hash(w[a:b], int(b - a))
            else:
                yield empty


def batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def as_binary(parts: list[np.ndarray]) -> pa.Array:
    """Arrays as one binary column without a Python object each."""
    size = np.array([p.nbytes for p in parts], np.int64)
    off = np.zeros(len(parts) + 1, np.int64)
    np.cumsum(size, out=off[1:])
    body = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    if off[-1] < 2**31:
        return pa.BinaryArray.from_buffers(pa.binary(), len(parts), [None, pa.py_buffer(off.astype(np.int32)), pa.py_buffer(body)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(parts), [None, pa.py_buffer(off), pa.py_buffer(body)])
