"""Sinks: safe spreadsheets, corpora, templates, per-document texts; all written by executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import formula_safe


def spreadsheet_safe(df: DataFrame) -> DataFrame:
    """Strings and headers that a spreadsheet would run as formulas, quoted; names stay unique."""
    out, used = [], set(df.columns)
    for name, kind in df.dtypes:
        safe = name
        if name[:1] in ("=", "+", "-", "@", "\t", "\r"):
            safe = "'" + name
            while safe in used:
                safe = "'" + safe
            used.add(safe)
        c = F.col(f"`{name}`")
        out.append((formula_safe(c) if kind == "string" else c).alias(safe))
    return df.select(*out)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    spreadsheet_safe(df).write.mode(mode).option("header", True).csv(path)


def write_corpus(rows: DataFrame, path: str) -> None:
    """B1: a corpus as CSV and as JSON lines."""
    write_csv(rows, f"{path}/csv")
    rows.write.mode("overwrite").json(f"{path}/jsonl")


def replace_parquet(df: DataFrame, path: str, backup: str | None = None) -> None:
    """B2: written aside, then moved into place, the old one to ``backup``.

    Readers never see half a table; for a moment between the two moves they may see none. A move that fails is an
    error, and the old table is then moved back.
    """
    spark = df.sparkSession
    new = f"{path}.{uuid.uuid4().hex}.tmp"
    df.write.parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    old, aside = hadoop(path), hadoop(new)
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    before = hadoop(f"{path}.{uuid.uuid4().hex}.old")
    had = fs.exists(old)
    if had and not fs.rename(old, before):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(aside, old):
        if had:
            fs.rename(before, old)
        raise OSError(f"{new} can't be moved to {path}")
    if had and backup:
        fs.delete(hadoop(backup), True)
        if not fs.rename(before, hadoop(backup)):
            raise OSError(f"the old table stays at {before}")
    elif had:
        fs.delete(before, True)


def write_template(controls: DataFrame, path: str) -> None:
    """Controls as JSON, boxes rounded to six decimals."""
    controls.withColumn("bbox", F.transform("bbox", lambda x: F.bround(x, 6))).write.mode("overwrite").json(path)


def write_by(df: DataFrame, path: str, by: str) -> None:
    """A folder for each value."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def rebuilt(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of regenerated members in place of their old ones; the rest stays."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def as_json(df: DataFrame) -> DataFrame:
    """Each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("json"))


def assets(df: DataFrame, name: str = "name", data: str = "base64") -> DataFrame:
    """Decoded images under safe names."""
    return df.select(F.regexp_replace(name, "[^A-Za-z0-9_.-]", "_").alias("name"), F.unbase64(data).alias("content"))
