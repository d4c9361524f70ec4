"""Delimited text whose quoted fields may hold line breaks, read in parallel blocks.

Whether a line break ends a record depends on all quotes before it. Each line is a function from the state before it (outside or inside a
quoted field) to the state behind it, one of four: stay, change, end outside, end inside. Lines compose within their block of the
file in the order in which a task reads them, blocks within their file, and the state before every block follows; only the few rows of blocks
meet. Then each block is read again from its state on. Texts aren't shuffled: only the parts of a record that lies in several blocks are.
"""

from __future__ import annotations

import csv
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.lineage import cut

QUOTE = '"'
#: The parser drops NUL characters and can't tell a field without characters from an empty quoted one. So a mark stands before these in a record, and before a mark.
MARK, SELF, NUL, NONE = "\ufdd0", "\ufdd1", "\ufdd2", "\ufdd3"


def transition(line: Column, separator: str, inside: bool) -> Column:
    """Whether a line ends inside a quoted field, if it begins inside one or outside.

    A quote opens a field at the field's first character only, closes it anywhere, and opens it again right behind a closing
    one (a doubled quote); in an unquoted field it is a character.
    """
    parts = F.split(line, QUOTE, -1)
    pairs = F.zip_with(F.slice(parts, 1, F.size(parts) - 1), F.slice(parts, 2, F.size(parts) - 1), lambda before, _: before)

    def step(state, before):
        opens = (state["closed"] & (before == "")) | before.endswith(separator)
        return F.when(state["inside"], F.struct(F.lit(False).alias("inside"), F.lit(True).alias("closed"))).otherwise(
            F.struct(opens.alias("inside"), F.lit(False).alias("closed")))

    first = F.struct(F.lit(inside).alias("inside"), F.lit(not inside).alias("closed"))
    return F.aggregate(pairs, first, step, lambda s: s["inside"])


def _segments(blocks) -> list[tuple[int, int]]:
    """Ranges of rows of one block each."""
    import numpy as np

    edges = np.flatnonzero(np.diff(blocks, prepend=-1)).tolist()
    return list(zip(edges, [*edges[1:], len(blocks)]))


def _column(batch, i: int):
    if batch.column(i).null_count:
        raise RuntimeError("files, or the blocks that they are read in, changed while they were read")
    return batch.column(i).to_numpy(zero_copy_only=False)


def _effects(batches):
    """Rows ``(b, fixed, turn)``: the state behind block ``b`` whatever it was before (null: it depends on that), and whether it changes then."""
    import numpy as np
    import pyarrow as pa

    done: dict[int, tuple[bool | None, bool]] = {}
    for batch in batches:
        blocks, outs, ins = (_column(batch, i) for i in range(3))
        for i, j in _segments(blocks):
            out, in_ = outs[i:j], ins[i:j]
            fixed, turn = done.get(b := int(blocks[i]), (None, False))
            constant = np.flatnonzero(out == in_)
            if len(constant):
                fixed, turn = bool(out[constant[-1]]), False
                out, in_ = out[constant[-1] + 1 :], in_[constant[-1] + 1 :]
            done[b] = fixed, turn ^ bool((out & ~in_).sum() % 2)
    yield pa.RecordBatch.from_arrays([pa.array(list(done), pa.int32()), pa.array([f for f, _ in done.values()], pa.bool_()), pa.array([t for _, t in done.values()], pa.bool_())], ["b", "fixed", "turn"])


#: Parts of a record that lies in several blocks: its end, a whole block, its begin.
END, MIDDLE, BEGIN = 0, 1, 2
#: A record's place is its block's number and, in so many bits, its number in the block.
PLACE_BITS = 36


def _records(files: list[int], begins: list[bool]) -> Callable:
    """A mapInArrow function: lines ``(b, text, out, in)`` in order to records ``(f, place, part, text)``; ``part`` is null for whole records."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        block, inside, n = -1, False, 0  # the block read, the state before its next line, its records so far
        opened: list[str] | None = None  # lines of a record that hasn't ended, and whether it began in this block
        began = False

        def rows(texts, first, part=None):
            texts = texts.cast(pa.string())
            places = pa.array((block << PLACE_BITS) + first + np.arange(len(texts)))
            if part is None:
                if pc.any(pc.ends_with(texts, "\r")).as_py():
                    texts = pc.replace_substring_regex(texts, r"\r\z", "")
                full = pc.not_equal(texts, "")
                texts, places = texts.filter(full), places.filter(full)
            k = len(texts)
            return pa.RecordBatch.from_arrays([pa.array(np.full(k, files[block], np.int32)), places, pa.array([part] * k, pa.int32()), texts], ["f", "place", "part", "text"])

        def joined(part=None):
            return rows(pa.array(["\n".join(opened)], pa.string()), n - began, part)

        def left():
            """What is open at a block's end: a part, or at the file's end a record."""
            if opened is not None:
                whole = began and (block + 1 == len(files) or files[block + 1] != files[block])
                yield joined(None if whole else BEGIN if began else MIDDLE)

        for batch in batches:
            blocks, outs, ins = _column(batch, 0), _column(batch, 2), _column(batch, 3)
            for i, j in _segments(blocks):
                if blocks[i] != block:
                    yield from left()
                    block, n = int(blocks[i]), 0
                    inside, opened, began = begins[block], [] if begins[block] else None, False
                out, in_, texts = outs[i:j], ins[i:j], batch.column(1).slice(i, j - i)
                turns, state = np.zeros(j - i + 1, np.int64), inside
                for at in np.flatnonzero(out | ~in_).tolist():
                    if (new := bool(in_[at] if state else out[at])) != state:
                        turns[at + 1], state = 1, new
                starts = np.flatnonzero((np.cumsum(turns[:-1]) % 2).astype(bool) == inside)
                inside, first = state, int(starts[0]) if len(starts) else j - i
                if opened is not None:
                    opened += texts.slice(0, first).to_pylist()
                    if len(starts) or not inside:
                        yield joined(None if began else END)
                        opened = None
                if len(starts):
                    ends = [*starts.tolist(), j - i]
                    if inside:
                        opened, began = texts.slice(ends[-2]).to_pylist(), True
                        ends.pop()
                    if len(ends) > 1:
                        yield rows(pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts.cast(pa.string())), "\n"), n)
                    n += len(starts)
        yield from left()

    return run


def _marked(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(MARK), F.lit(MARK + SELF)), F.lit("\0"), F.lit(MARK + NUL))


def _unmarked(field: Column) -> Column:
    return F.replace(F.replace(field, F.lit(MARK + NUL), F.lit("\0")), F.lit(MARK + SELF), F.lit(MARK))


def _typed(df: DataFrame) -> DataFrame:
    """Text columns as whole numbers, numbers or truth values where every value is one, but for empty ones, which are null there; one pass decides."""
    tests = {"bigint": lambda c: F.expr(f"try_cast({c} as bigint)").isNotNull(), "double": lambda c: F.expr(f"try_cast({c} as double)").isNotNull(),
             "boolean": lambda c: F.col(c).rlike(r"(?i)^\s*(true|false)\s*$")}
    names = [f"`{c.replace('`', '``')}`" for c in df.columns]
    if not names:
        return df
    counts = df.agg(*[F.count(F.nullif(c, F.lit(""))).alias(f"n{i}") for i, c in enumerate(names)], *[F.count_if(t(c)).alias(f"{k}{i}") for i, c in enumerate(names) for k, t in tests.items()]).first()
    kinds = [next((k for k in tests if counts[f"n{i}"] and counts[f"{k}{i}"] == counts[f"n{i}"]), "string") for i in range(len(names))]
    return df.select(*[(F.col(c) if k == "string" else F.nullif(c, F.lit("")).cast(k)).alias(n) for c, k, n in zip(names, kinds, df.columns)])


def _header(text: str, separator: str) -> list[str]:
    """Distinct names of a header record: repeated ones are numbered, empty ones named by their place."""
    out: list[str] = []
    for i, name in enumerate(next(csv.reader([text.removeprefix("﻿")], delimiter=separator), [])):
        name, k = name or f"Unnamed: {i}", 0
        while (n := f"{name}.{k}" if k else name) in out:
            k += 1
        out.append(n)
    return out


def read_delimited(spark: SparkSession, path: str, separator: str = ",", schema: str | T.StructType | None = None) -> DataFrame:
    """Delimited text files with a header record each, as one table by column name.

    Fields may be quoted; quoted ones may hold separators, line breaks and doubled quotes. Each file is UTF-8, or Latin-1 where its
    bytes aren't valid UTF-8. Empty lines between records go; missing fields and those without characters are null (quoted empty ones aren't, but in columns of numbers or truth values), also of columns that only other files
    have; fields beyond the header's go. Without a ``schema`` (by name), columns are whole numbers,
    numbers or truth values where all values are, else text. Files are read in blocks, side by side.
    """
    at = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("_metadata.file_block_length").alias("length")]
    lines = spark.read.option("lineSep", "\n").text(path).select(*at, "value")
    quoted = F.contains("value", F.lit(QUOTE))
    # A row for each block of a file, which a scan's driver lists too.
    blocks = sorted(map(tuple, lines.groupBy("file", "start", "length").agg(F.bool_and(F.is_valid_utf8("value")), F.bool_or(quoted)).collect()))
    if not blocks:
        return spark.createDataFrame([], schema or T.StructType())
    numbers = {file: f for f, file in enumerate(dict.fromkeys(r[0] for r in blocks))}
    latin, quotes = {r[0] for r in blocks if not r[3]}, {r[0] for r in blocks if r[4]}
    kinds = spark.createDataFrame([(*r[:3], b, r[0] not in latin, r[0] in quotes) for b, r in enumerate(blocks)], "file string, start long, length long, b int, utf8 boolean, quotes boolean")
    # Blocks found anew that aren't listed have no number, an error. Lines stay in order: the short side of the join is broadcast.
    rows = lines.join(F.broadcast(kinds), ["file", "start", "length"], "left")
    text = F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    out, in_ = (F.when(F.col("quotes") & F.contains(text, F.lit(QUOTE)), transition(text, separator, s)).otherwise(F.lit(s)) for s in (False, True))
    effects = {r["b"]: (r["fixed"], r["turn"]) for r in rows.where(quoted).select("b", out.alias("out"), in_.alias("in")).mapInArrow(_effects, "b int, fixed boolean, turn boolean").collect()} if quotes else {}
    begins, inside = [], False
    for b, r in enumerate(blocks):
        inside = inside and b > 0 and blocks[b - 1][0] == r[0]
        begins.append(inside)
        fixed, turn = effects.get(b, (None, False))
        inside = (inside if fixed is None else fixed) != turn
    records = rows.select("b", text.alias("text"), out.alias("out"), in_.alias("in")).mapInArrow(_records([numbers[r[0]] for r in blocks], begins), "f int, place long, part int, text string")
    found = records = cut(records, compression="zstd")  # read several times below, and the same whatever blocks a later scan has
    if any(begins):
        parts = records.where("part is not null")
        begun = F.last(F.when(F.col("part") == BEGIN, F.col("place")), ignorenulls=True).over(W.partitionBy("f").orderBy(F.shiftright("place", PLACE_BITS), "part"))
        pieces = F.array_sort(F.collect_list(F.struct(F.shiftright("place", PLACE_BITS), "part", "text")))
        joined = parts.withColumn("at", begun).groupBy("f", "at").agg(F.array_join(F.transform(pieces, lambda s: s["text"]), "\n").alias("text"))
        joined = joined.withColumn("text", F.when(F.endswith("text", F.lit("\r")), F.expr("left(text, length(text) - 1)")).otherwise(F.col("text")))
        found = records.where("part is null").drop("part").unionByName(joined.select("f", F.col("at").alias("place"), "text"))
    firsts = found.groupBy("f").agg(F.min("place").alias("first"))
    headers = found.join(F.broadcast(firsts), "f").where("place = first").select("f", "first", "text").collect()  # a row for each file
    names_of = sorted({r["text"] for r in headers})
    where = spark.createDataFrame([(r["f"], r["first"], names_of.index(r["text"])) for r in headers], "f int, first long, header int")
    bodies = found.join(F.broadcast(where), "f").where("place <> first")
    frames = []
    for h, header in enumerate(names_of):
        names = _header(header, separator)
        kind = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
        fields = F.from_csv(_marked(F.col("text")), kind.simpleString()[7:-1].replace(":", " "), {"sep": separator, "quote": QUOTE, "escape": QUOTE, "nullValue": MARK + NONE, "mode": "PERMISSIVE", "maxCharsPerColumn": "-1"})
        frames.append(bodies.where(F.col("header") == h).select(fields.alias("r")).select(*[_unmarked(F.col(f"r.c{i}")).alias(n) for i, n in enumerate(names)]))
    if not frames:
        return spark.createDataFrame([], schema or T.StructType())
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    if schema is None:
        return _typed(out)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    have = set(out.columns)
    return out.select(*[(F.col(f"`{f.name}`").try_cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in fields])
