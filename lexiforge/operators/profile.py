"""Profiles of tables: column classes, summaries, histograms, capped loads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ROWS = 300_000


def column_class(field: T.StructField) -> str:
    """numeric, datetime or categorical (everything else, booleans too)."""
    if isinstance(field.dataType, T.NumericType):
        return "numeric"
    return "datetime" if isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else "categorical"


def columns_of(df: DataFrame, kind: str) -> list[str]:
    """Columns of a class."""
    return [f.name for f in df.schema if column_class(f) == kind]


def matching_columns(df: DataFrame, wanted: list[str], least: int = 2) -> list[str]:
    """Columns by exact name or by suffix, ``least`` of them at least."""
    found = [c for c in df.columns if any(c == w or c.endswith(w) for w in wanted)]
    if len(found) < least:
        raise ValueError(f"{len(found)} of at least {least} columns found for {wanted}")
    return found


def present(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Those of the wanted columns that exist."""
    return df.select(*[c for c in wanted if c in df.columns])


def require(df: DataFrame, *names: str) -> None:
    """C5."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")


def capped(df: DataFrame, most: int = MAX_ROWS) -> tuple[DataFrame, bool]:
    """At most ``most`` rows, and whether there were more."""
    more = df.limit(most + 1).count() > most
    return df.limit(most), more


def numeric_summary(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Least, greatest and mean value and the nulls of each numeric column, a row each.

    One pass over the table; NaN counts as null.
    """
    columns = columns or columns_of(df, "numeric")
    clean = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    one = df.agg(*[F.struct(F.lit(c).alias("column"), F.min(clean(c)).alias("min"), F.max(clean(c)).alias("max"), F.round(F.avg(clean(c)), 2).alias("mean"),
                            F.count_if(clean(c).isNull()).alias("nulls")).alias(f"s{i}") for i, c in enumerate(columns)])
    return one.select(F.inline(F.array(*[f"s{i}" for i in range(len(columns))])))


def categorical_summary(df: DataFrame, column: str, order: list[str], most: int = 10) -> DataFrame:
    """Distinct values in the order of their first appearance (by ``order``), with counts, the first ``most``.

    ``n_unique`` counts null as a value.
    """
    first = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.min(F.struct(*order)).alias("first"), F.count("*").alias("n"))
    total = first.agg(F.count("*").alias("n_unique"))
    top = first.orderBy("first").limit(most)
    place = F.row_number().over(W.orderBy("first"))  # over at most ``most`` rows
    return top.withColumn("place", place).crossJoin(F.broadcast(total)).select("place", "value", "n", "n_unique")


def smallest_values(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """E5: the smallest distinct values, as text, of each column."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))).where("value is not null").distinct()
    rank = F.row_number().over(W.partitionBy("column").orderBy("value"))
    return (long.withColumn("r", rank).where(F.col("r") <= most).groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("value")), "|").alias("first_values"))
            .join(long.groupBy("column").agg(F.count("*").alias("n_unique")), "column").select("column", "n_unique", "first_values"))


def column_profile(df: DataFrame) -> DataFrame:
    """For each column its class, share of non-nulls, distinct values, range, mean and most frequent value (ties: the smallest).

    Values are unpivoted as text and counted once; a column's ranks come from its distinct values.
    """
    classes = {f.name: column_class(f) for f in df.schema}
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(k).alias("kind"), F.col(c).cast("string").alias("value"),
                     (F.col(c).cast("double") if k == "numeric" else F.lit(None).cast("double")).alias("number")) for c, k in classes.items()])))
    counts = long.groupBy("column", "kind", "value", "number").agg(F.count("*").alias("n"))
    seen = F.col("value").isNotNull()
    return counts.groupBy("column", "kind").agg(
        F.round(100 * F.sum(F.when(seen, F.col("n")).otherwise(0)) / F.sum("n"), 4).alias("filled_percent"), F.count(F.when(seen, 1)).alias("n_unique"),
        F.min("number").alias("min"), F.round(F.sum(F.col("number") * F.col("n")) / F.sum(F.when(F.col("number").isNotNull(), F.col("n"))), 4).alias("mean"), F.max("number").alias("max"),
        F.min(F.when(seen, F.struct((-F.col("n")).alias("n"), F.col("value").alias("v"))))["v"].alias("most_frequent"))


def histogram(df: DataFrame, column: str, bins: int, by: str | None = None, low: float | None = None, high: float | None = None) -> DataFrame:
    """Rows in each of ``bins`` equal bins of [low, high], the last one closed; optionally split.

    Without bounds they are the column's least and greatest finite values.
    """
    x = F.col(column).cast("double")
    if low is None or high is None:
        ends = df.where(~F.isnan(x) & (F.abs(x) != float("inf"))).agg(F.min(x).alias("a"), F.max(x).alias("z")).first()
        low, high = ends["a"] if low is None else low, ends["z"] if high is None else high
        if low is None:
            low = high = 0.0  # no values: no bins
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((x - low) / width), F.lit(bins - 1)).cast("int").alias("bin")
    keys = [at] + ([F.col(by)] if by else [])
    return df.where((x >= low) & (x <= high)).groupBy(*keys).agg(F.count("*").alias("n"))


def seeded_sample(df: DataFrame, key: str, most: int = 5000, seed: int = 42) -> DataFrame:
    """The same rows whatever the partitioning: the first by a hash of the key."""
    return df.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(most)


def dropped_empty(df: DataFrame) -> DataFrame:
    """Without rows that are null in every column."""
    return df.dropna(how="all")


def with_text(df: DataFrame, column: str, blanks: bool = True) -> DataFrame:
    """Rows with a text; blank ones too unless told otherwise."""
    found = df.where(F.col(column).isNotNull())
    return found if blanks else found.where(F.trim(column) != "")


def timed(df: DataFrame, column: str) -> DataFrame:
    """Rows whose time stamp can be read, with ``timestamp``, in its order."""
    return df.withColumn("timestamp", F.try_to_timestamp(F.col(column).cast("string"))).where("timestamp is not null").orderBy("timestamp")
