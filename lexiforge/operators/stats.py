"""Statistics of tables: grouped bars and boxes, correlations, tests, regression.

Everything is an aggregation over the data; only the sums go to the driver, for p-values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .inversions import discordant

# Names of a positive class.
POSITIVE = ["m", "malignant", "yes", "true", "1", "positive", "pos", "disease", "infected", "bad", "high", "abnormal"]


def bars(df: DataFrame, value: str, keys: list[str], how: str = "mean", spread: bool = False) -> DataFrame:
    """Mean, sum, count or median by one or two keys; rows with a null key are left out; optionally the sample deviation."""
    agg = {"mean": F.avg, "sum": F.sum, "count": F.count, "median": F.median}.get(how, F.avg)
    more = [F.stddev_samp(value).alias("sd")] if spread and how in ("mean", "median") else []
    return df.dropna(subset=keys).groupBy(*keys).agg(agg(value).alias("value"), *more)


def boxes(df: DataFrame, value: str, by: str) -> DataFrame:
    """The five numbers of a box plot for each group."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(value).alias("low"), q.alias("q"), F.max(value).alias("high"))
    return out.select(by, "low", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), "high")


def line_means(df: DataFrame, x: str, y: str) -> DataFrame:
    """The mean of y for each x, in the order of x."""
    return df.groupBy(x).agg(F.avg(y).alias("mean"), F.count(y).alias("n")).orderBy(x)


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """All pairs, each over the rows that have both; one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b: F.corr(F.when(F.col(b).isNotNull(), F.col(a).cast("double")), F.when(F.col(a).isNotNull(), F.col(b).cast("double")))
    one = df.agg(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), both(a, b).alias("r")).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return one.select(F.inline(F.array(*[f"p{i}" for i in range(len(pairs))])))


def ranked(df: DataFrame, column: str, name: str) -> DataFrame:
    """Average ranks of a column (ties share theirs), from counts of its distinct values, so no single task sorts all rows.

    Sub-ranges of distinct values are ranked side by side and shifted by what stands before.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("__v")).agg(F.count("*").alias("__n"))
    parts = counts.repartitionByRange("__v").withColumn("__p", F.spark_partition_id())
    inside = F.sum("__n").over(W.partitionBy("__p").orderBy("__v"))
    sizes = parts.groupBy("__p").agg(F.sum("__n").alias("__s"))
    before = sizes.select("__p", (F.sum("__s").over(W.orderBy("__p")) - F.col("__s")).alias("__b"))  # a row for each partition
    rank = parts.withColumn("__i", inside).join(F.broadcast(before), "__p").select("__v", (F.col("__b") + F.col("__i") - (F.col("__n") - 1) / 2.0).alias(name))
    return df.join(rank, df[column] == rank["__v"]).drop("__v")


def correlation(df: DataFrame, x: str, y: str, method: str = "pearson") -> DataFrame:
    """Pearson, spearman (pearson over average ranks) or kendall (tau-b), over rows with both values; n must be 3 at least (else null).

    Kendall counts pairs in opposite order by distributed merging (inversions.py), over any number of points.
    """
    both = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).dropna()
    if method == "spearman":
        both = ranked(ranked(both, "x", "rx"), "y", "ry").select(F.col("rx").alias("x"), F.col("ry").alias("y"))
    if method == "kendall":
        return _kendall(both)
    return both.agg(F.count("*").alias("n"), F.when(F.count("*") >= 3, F.corr("x", "y")).alias("r"))


def _kendall(both: DataFrame) -> DataFrame:
    cells = both.groupBy("x", "y").agg(F.count("*").alias("n"))
    whole = "decimal(38,0)"
    pairs = lambda c: ((c.cast("decimal(19,0)") * (c - 1).cast("decimal(19,0)")).cast(whole) / 2).cast(whole)
    tie = lambda c, name: cells.groupBy(c).agg(F.sum("n").alias("n")).agg(F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0).cast(whole)).alias(name))
    total = cells.agg(F.sum("n").alias("n"), F.coalesce(F.sum(pairs(F.col("n"))), F.lit(0).cast(whole)).alias("txy"))
    row = total.crossJoin(tie("x", "tx")).crossJoin(tie("y", "ty")).crossJoin(discordant(cells))  # one row each
    n0 = pairs(F.col("n"))
    # Of all pairs those are concordant that are neither tied nor discordant.
    s = (n0 - F.col("tx") - F.col("ty") + F.col("txy") - F.col("d") - F.col("d")).cast("double")
    r = F.try_divide(s, F.sqrt((n0 - F.col("tx")).cast("double") * (n0 - F.col("ty")).cast("double")))
    return row.select(F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n") >= 3, r).alias("r"))


def encoded_target(df: DataFrame, target: str) -> DataFrame:
    """A two-valued text target as 0 and 1: a known positive name is 1, else the alphabetically second value."""
    if dict(df.dtypes)[target] not in ("string", "boolean"):
        return df
    values = [str(r[0]) for r in df.select(F.col(target).cast("string")).dropna().distinct().limit(3).collect()]
    if len(values) != 2:
        raise ValueError(f"{target} must have two values to be encoded")
    low, high = sorted(values, key=str.lower)
    positive = low if low.lower() in POSITIVE else high
    return df.withColumn(target, F.when(F.col(target).isNotNull(), (F.col(target).cast("string") == positive).cast("int")))


def correlation_ranking(df: DataFrame, target: str, features: list[str]) -> DataFrame:
    """Each feature's correlation with the target, strongest first."""
    df = encoded_target(df, target)
    one = df.agg(*[F.struct(F.lit(c).alias("feature"), F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias("r")).alias(f"p{i}") for i, c in enumerate(features)])
    return one.select(F.inline(F.array(*[f"p{i}" for i in range(len(features))]))).orderBy(F.desc(F.abs("r")), "feature")


def group_moments(df: DataFrame, value: str, by: str) -> DataFrame:
    x = F.col(value).cast("double")
    return df.where(x.isNotNull() & F.col(by).isNotNull()).groupBy(by).agg(F.count(x).alias("n"), F.avg(x).alias("m"), F.var_samp(x).alias("v"))


def welch(df: DataFrame, value: str, by: str, first: str, second: str, equal_var: bool = False) -> DataFrame:
    """T and degrees of freedom of two groups; pooled on request."""
    g = group_moments(df, value, by)
    pick = lambda k, c: F.max(F.when(F.col(by) == k, F.col(c)))
    one = g.agg(*[pick(k, c).alias(f"{c}{i}") for i, k in ((1, first), (2, second)) for c in ("n", "m", "v")])
    if equal_var:
        pooled = F.expr("((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)")
        return one.select(((F.col("m1") - F.col("m2")) / F.sqrt(pooled * F.expr("1 / n1 + 1 / n2"))).alias("t"), F.expr("cast(n1 + n2 - 2 as double)").alias("df"))
    return one.select(F.expr("(m1 - m2) / sqrt(v1 / n1 + v2 / n2)").alias("t"),
                      F.expr("pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1))").alias("df"))


def anova(df: DataFrame, value: str, by: str) -> DataFrame:
    """Sums of squares between and within groups and F of a one-way analysis of variance, from group moments."""
    g = group_moments(df, value, by)
    total = g.agg(F.sum("n").alias("n"), F.count("*").alias("k"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"), F.sum((F.col("n") - 1) * F.coalesce("v", F.lit(0.0))).alias("ssw"))
    between = g.crossJoin(F.broadcast(total.select("mean"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("ssb"))
    return total.crossJoin(F.broadcast(between)).select("k", "n", "ssb", "ssw", F.expr("(ssb / (k - 1)) / (ssw / (n - k))").alias("f"))


def t_p_value(spark: SparkSession, t: float, df: float) -> float:
    """Two-sided, by the JVM's distribution."""
    dist = spark._jvm.org.apache.commons.math3.distribution.TDistribution(float(df))
    return 2 * (1 - dist.cumulativeProbability(abs(float(t))))


def f_p_value(spark: SparkSession, f: float, d1: float, d2: float) -> float:
    dist = spark._jvm.org.apache.commons.math3.distribution.FDistribution(float(d1), float(d2))
    return 1 - dist.cumulativeProbability(float(f))


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    """E14, one predictor."""
    both = df.select(F.col(y).cast("double").alias("y"), F.col(x).cast("double").alias("x")).dropna()
    return both.agg(F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"), F.regr_r2("y", "x").alias("r2"))


def regression(df: DataFrame, y: str, xs: list[str]) -> DataFrame:
    """Least squares with an intercept over complete rows: a row per term with coefficient, error, t and p."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    rows = df.select(F.col(y).cast("double").alias("label"), *[F.col(c).cast("double") for c in xs]).dropna()
    fit = LinearRegression(solver="normal", featuresCol="__x").fit(VectorAssembler(inputCols=xs, outputCol="__x").transform(rows))
    s = fit.summary
    if s.numInstances <= len(xs) + 1:
        raise ValueError("more rows than terms are needed")
    terms = zip([*xs, "intercept"], [*fit.coefficients, fit.intercept], s.coefficientStandardErrors, s.tValues, s.pValues)
    data = [(n, float(c), float(e), float(t), float(p), float(s.r2), float(s.r2adj)) for n, c, e, t, p in terms]
    return df.sparkSession.createDataFrame(data, "term string, coefficient double, error double, t double, p double, r2 double, r2_adjusted double")
