"""N-gram Jaccard self-join, grouped by prefix.

A document's shingle set is ordered by one global order (frequent shingles last,
else by hash). Two sets that reach the threshold share a shingle of their
prefixes. Documents with equal prefixes and sizes are one group; groups, not
documents, are indexed and filtered, and only surviving group pairs are expanded
to members and verified on the whole sets.

Nodes of the graph are distinct sets, named by their 64-bit digests, so that copies are one node and different texts
under one id are nodes that the id ties together.

A group of thousands of near copies has millions of linked pairs, so pairs are
verified in rounds: first every member against its group's head and every
group's head against the head of each prefix shingle; then only pairs that no
chain of verified links connects yet. Every pair that reaches the threshold ends in
one component, and no pair inside a component is ever listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import as_binary, batch, components, mixed, releasing, semi, shingle_sets, written

#: Counters of the frequency sketch: 4 MB whatever the input.
BITS = 20
_PART = 14


def _counted(sets: list[np.ndarray]) -> np.ndarray:
    return np.bincount((np.concatenate(sets) >> np.uint64(64 - BITS)).astype(np.int64), minlength=1 << BITS)


def _sketch(n: int):
    schema = pa.schema([("part", pa.int32()), ("tasks", pa.int32()), ("counts", pa.binary())])

    def run(batches):
        tasks = TaskContext.get().partitionId() // 1024
        total = np.zeros(1 << BITS, np.int64)
        for b in batches:
            held, size = [], 0
            for s in shingle_sets(b.column(0), n):
                held.append(s)
                size += len(s)
                if size > 1 << BITS:
                    total += _counted(held)
                    held, size = [], 0
            if held:
                total += _counted(held)
        parts = total.astype(np.int64).reshape(-1, 1 << _PART)
        yield batch({"part": np.arange(len(parts), dtype=np.int32), "tasks": np.full(len(parts), tasks, np.int32), "counts": [p.tobytes() for p in parts]}, schema)

    return run


def frequency_levels(docs: DataFrame, n: int, text_col: str = "text") -> np.ndarray:
    """For each leading-bits class of shingle hashes, how much more frequent than the mean it is (0: not, else log2).

    Counted over all documents in a table of fixed size, summed part by part, first
    within every 1024 tasks, so that no task sums more than about 1024 rows; any
    order is right for the join, this one keeps very frequent shingles out of prefixes.
    """

    parts = docs.select(F.col(text_col).alias("text")).mapInArrow(releasing(_sketch(n)), "part int, tasks int, counts binary")
    parts = parts.groupBy("part", "tasks").applyInArrow(_summed, "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(_summed, "part int, counts binary").collect()
    total = np.zeros(1 << BITS, np.int64)
    for r in rows:
        total[r["part"] << _PART : (r["part"] + 1) << _PART] = np.frombuffer(r["counts"], np.int64)
    return np.floor(np.log2(np.maximum(total / (4 * max(total.mean(), 4)), 1))).astype(np.uint8)


def _summed(key, table):
    total = np.zeros(1 << _PART, np.int64)
    for c in table.column("counts"):
        total += np.frombuffer(c.as_buffer(), np.int64)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


#: Words of the parity bitmap: bit h mod 256 flips with each shingle, so two bitmaps
#: differ in no more bits than two sets in shingles.
BITMAP = ["b0", "b1", "b2", "b3"]
_SETS = pa.schema([("id", pa.int64()), ("size", pa.int64()), ("digest", pa.int64()), ("prefix", pa.int64()), *[(b, pa.int64()) for b in BITMAP], ("tokens", pa.list_(pa.int64()))])


def _digest(s: np.ndarray) -> int:
    return int(mixed(np.array([len(s)], np.uint64) + np.add.reduce(mixed(s ^ np.uint64(0x5851F42D4C957F2D))))[0])


def _prefixes(n: int, percent: int, levels):
    def run(batches):
        level = levels.value
        for b in batches:
            ids = b.column(0)
            size, digest, prefix, tokens, bitmap = [], [], [], [], np.zeros((b.num_rows, len(BITMAP)), np.int64)
            for s in shingle_sets(b.column(1), n):
                m = len(s)
                p = m - -(-percent * m // 100) + 1 if m else 0
                hot = level[(s >> np.uint64(64 - BITS)).astype(np.int64)]
                if hot.any():
                    s2 = s[np.argsort(hot, kind="stable")]
                else:
                    s2 = s
                t = s2[:p]
                bitmap[len(size)] = np.packbits((np.bincount((s & np.uint64(255)).astype(np.int64), minlength=256) & 1).astype(np.uint8)).view(np.int64)
                size.append(m)
                digest.append(_digest(s))
                prefix.append(_digest(t) ^ m)
                tokens.append(t)
            off = np.zeros(len(tokens) + 1, np.int32)
            np.cumsum([len(t) for t in tokens], out=off[1:])
            body = np.concatenate(tokens) if tokens else np.zeros(0, np.uint64)
            listed = pa.ListArray.from_arrays(pa.array(off), pa.array(body.view(np.int64)))
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), pa.array(size, pa.int64()), as_long(digest), as_long(prefix), *[pa.array(c) for c in bitmap.T], listed], schema=_SETS)

    return run


def _whole_sets(n: int):
    schema = pa.schema([("cls", pa.int64()), ("shingles", pa.binary())])

    def run(batches):
        for b in batches:
            sets = list(shingle_sets(b.column(0), n))
            for i in range(0, len(sets), 500):
                cls = np.array([_digest(s) for s in sets[i : i + 500]], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(cls), as_binary(sets[i : i + 500]).cast(pa.binary())], schema=schema)

    return run


def _verify(percent: int):
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches):
        for batch_ in batches:
            x, y, ok = batch_.column(2), batch_.column(3), []
            for s, t in zip(x, y):
                s, t = np.frombuffer(s.as_buffer(), np.uint64), np.frombuffer(t.as_buffer(), np.uint64)
                if len(s) > len(t):
                    s, t = t, s
                k = np.searchsorted(t, s)
                both = int((t[np.minimum(k, len(t) - 1)] == s).sum())
                ok.append(100 * both >= percent * (len(s) + len(t) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch_.column(0).filter(keep), batch_.column(1).filter(keep)], schema=schema)

    return run


def ngram_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of documents whose n-word shingle sets have a Jaccard similarity of ``percent`` / 100 or more.

    Returns one row per distinct id: the id, ``n_shingles`` (size of its set; texts are
    lower-cased over A-Z and split at ASCII white space; fewer than n words make one
    shingle), ``component_id`` (the smallest id that links lead to, itself
    included) and ``n_copies`` (documents with the very same set; 0 without words).

    Null or empty text: no shingles, linked with nothing. Null ids are left out, as no
    id could name them. Rows that share an id are one document: of different texts under one
    id, the set that is first by size and digest is reported, and the links of all of them count. Empty input: no rows. Other columns are ignored.
    """
    base = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    levels = spark.sparkContext.broadcast(frequency_levels(base, n))
    sets = base.mapInArrow(releasing(_prefixes(n, percent, levels)), "id long, size long, digest long, prefix long, b0 long, b1 long, b2 long, b3 long, tokens array<long>")
    sets = written(sets, "sets")
    ids = written(sets.groupBy("id", "digest").agg(F.min(F.struct("size", "prefix", *BITMAP)).alias("s")).select("id", F.col("digest").alias("cls"), "s.*"), "set-ids")
    # A class: documents with one and the same set, read again from the smallest id's text.
    classes = written(ids.where("size > 0").groupBy("cls").agg(
        F.min("id").alias("rep"), F.count("*").alias("n_copies"), *[F.first(b).alias(b) for b in ("size", "prefix", *BITMAP)]), "classes")
    # A group: classes with one prefix and size; its head is its smallest class.
    groups = classes.groupBy("size", "prefix").agg(F.min(F.struct("cls", "rep")).alias("h"), F.count("*").alias("n")).select("size", "prefix", F.col("h.cls").alias("head"), F.col("h.rep").alias("rep"), "n")
    tokens = sets.join(groups.select("head", "rep"), (sets["id"] == F.col("rep")) & (sets["digest"] == F.col("head")), "left_semi")
    tokens = tokens.dropDuplicates(["digest"]).select(F.col("digest").alias("head"), "size", F.explode("tokens").alias("token"))
    # Entries of prefix shingles that two groups at least share; top: the shingle's head.
    by = W.partitionBy("token")
    entries = (tokens.withColumn("lo", F.min("head").over(by)).withColumn("hi", F.max("head").over(by)).where("lo < hi"))
    entries = written(entries.select("token", "head", "size"), "entries")
    sizes = classes.select("cls", "size", "prefix", *BITMAP)
    heads = groups.select("size", "prefix", "head")
    first = sizes.join(heads, ["size", "prefix"]).where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b"))
    # A shingle's top is its most central group: what most others were copied from shares most.
    frequent = entries.groupBy("token").agg(F.count("*").alias("n"))
    central = entries.join(frequent, "token").groupBy("head").agg(F.sum("n").alias("score"))
    tops = entries.join(central, "head").groupBy("token").agg(
        F.max(F.struct("score", (-F.col("head")).alias("head"), "size")).alias("t")).select("token", (-F.col("t.head")).alias("top"), F.col("t.size").alias("top_size"))
    # Each head tries the two tops that it shares most with; the second round has the rest.
    tried = W.partitionBy("head").orderBy(F.desc("shared"), "top")
    near = (entries.join(tops, "token").where("head <> top").groupBy("head", "top").agg(F.first("size").alias("size"), F.first("top_size").alias("top_size"), F.count("*").alias("shared"))
            .withColumn("r", F.row_number().over(tried)).where("r <= 2")
            .where(_reach("size", "top_size", "shared", percent))
            .select(F.col("head").alias("a"), F.col("top").alias("b")))
    first = _close(first.unionByName(near), sizes, percent)
    reps = classes.select("cls", F.col("rep").alias("id"))
    links = _linked(base, reps, first, n, percent)
    roots = components(links)
    # Second round: what the first left apart.
    member = (sizes.join(heads, ["size", "prefix"]).join(roots.withColumnRenamed("id", "cls"), "cls", "left")
              .select("cls", "head", "size", F.coalesce("component", "cls").alias("root"), *BITMAP))
    member = written(member, "members")
    mixed_groups = member.groupBy("head").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
    inside = mixed_groups.where("lo < hi").select("head")
    inside = member.join(inside, "head", "left_semi")
    pairs = _apart(inside.select("head", "cls", "root", "size", *BITMAP), "head", percent)
    spread = entries.join(mixed_groups, "head")
    bounds = spread.groupBy("token").agg(F.min("lo").alias("l"), F.max("hi").alias("h")).where("l < h").select("token")
    wide = entries.join(bounds, "token", "left_semi").join(member.select("head", "cls", "root", *BITMAP), "head")
    pairs = pairs.unionByName(_apart(wide, "token", percent))
    more = _linked(base, reps, pairs, n, percent)
    # An id of several sets ties their classes together.
    tied = ids.where("size > 0").groupBy("id").agg(F.min("cls").alias("a"), F.max("cls").alias("b")).where("a < b")
    tied = ids.where("size > 0").join(tied.select("id", "a"), "id").where("cls <> a").select("a", F.col("cls").alias("b"))
    roots = components(links.unionByName(more).unionByName(tied)).withColumnRenamed("id", "cls")
    member = classes.join(roots, "cls", "left").select("cls", "rep", "n_copies", F.coalesce("component", "cls").alias("root"))
    member = written(member, "class-roots")
    least = member.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = member.join(least, "root").select("cls", "n_copies", "component_id")
    shown = ids.groupBy("id").agg(F.min(F.struct("size", "cls")).alias("s"), F.max(F.when(F.col("size") > 0, F.col("cls"))).alias("any"))
    # A document whose reported set is empty can have others: they say where it belongs.
    shown = shown.select("id", F.col("s.size").alias("n_shingles"), F.when(F.col("s.size") > 0, F.col("s.cls")).otherwise(F.col("any")).alias("cls"))
    out = shown.join(named, "cls", "left").select(
        "id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"), F.when(F.col("n_shingles") > 0, F.coalesce("n_copies", F.lit(0))).otherwise(F.lit(0)).alias("n_copies"))
    return out.withColumnRenamed("id", id_col)


def _reach(a: str, b: str, shared: str, percent: int) -> str:
    """Whether sets of sizes a and b that share so many prefix shingles can reach the threshold.

    What both prefixes hold up to the end of the lesser one is counted; beyond it the set of
    that prefix has fewer than its required overlap left.
    """
    most = f"({shared} + greatest(ceil({percent} * {a} / 100), ceil({percent} * {b} / 100)) - 1)"
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b}) and {100 + percent} * {most} >= {percent} * ({a} + {b})"


def _bits(a: list[str], b: list[str], sizes: str, percent: int) -> str:
    """Whether bitmaps differ in few enough bits for the threshold."""
    apart = " + ".join(f"bit_count({x} ^ {y})" for x, y in zip(a, b))
    return f"{100 + percent} * ({apart}) <= {100 - percent} * ({sizes})"


def _close(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose bitmaps let them reach the threshold."""
    side = lambda k: sizes.select(F.col("cls").alias(k), F.col("size").alias(f"s{k}"), *[F.col(x).alias(k + x) for x in BITMAP])
    both = pairs.distinct().join(side("a"), "a").join(side("b"), "b")
    return both.where(_bits(["a" + x for x in BITMAP], ["b" + x for x in BITMAP], "sa + sb", percent)).select("a", "b")


def _apart(rows: DataFrame, key: str, percent: int) -> DataFrame:
    """Pairs of classes with one key and different roots that sizes, bitmaps and shared shingles let reach the threshold."""
    a = rows.select(key, F.col("cls").alias("a"), F.col("root").alias("ra"), F.col("size").alias("sa"), *[F.col(x).alias("a" + x) for x in BITMAP]).alias("x")
    b = rows.select(key, F.col("cls").alias("b"), F.col("root").alias("rb"), F.col("size").alias("sb"), *[F.col(x).alias("b" + x) for x in BITMAP]).alias("y")
    bits = _bits(["a" + x for x in BITMAP], ["b" + x for x in BITMAP], "sa + sb", percent)
    near = F.expr(f"a < b and ra <> rb and 100 * least(sa, sb) >= {percent} * greatest(sa, sb) and {bits}")
    pairs = a.join(b, (F.col(f"x.{key}") == F.col(f"y.{key}")) & near)
    if key == "token":
        pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("shared"), F.first("sa").alias("sa"), F.first("sb").alias("sb"))
        pairs = pairs.where(_reach("sa", "sb", "shared", percent))
    return pairs.select("a", "b")


def _linked(base: DataFrame, reps: DataFrame, pairs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes whose whole sets reach the threshold; ``reps``: a document of each class."""
    pairs = written(pairs.distinct(), "pairs")
    need = written(pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct(), "need")
    holders = written(reps.join(need, "cls").select("id").distinct(), "need-ids")
    sets = semi(base, holders, "id").select("text").mapInArrow(releasing(_whole_sets(n)), "cls long, shingles binary")
    # Rows given twice, and other texts under the same id, have sets that nothing asked for or that are here already.
    sets = written(semi(sets, need, "cls").groupBy("cls").agg(F.first("shingles").alias("shingles")), "whole-sets")
    x = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("y"))
    both = pairs.join(x, "a").join(y, "b").select("a", "b", "x", "y")
    return written(both.mapInArrow(releasing(_verify(percent)), "a long, b long").distinct(), "links")
