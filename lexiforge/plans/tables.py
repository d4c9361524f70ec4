"""Queries over tables: profiles, charts' data, statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P
from ..operators import stats as S
from .common import Registry, table

R = Registry()
NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@R.query(" union all ".join(f"select '{c}' as \"column\", min({c})::double as min, max({c})::double as max, round(avg({c}), 2) as mean, count(*) filter ({c} is null) as nulls from lineitem" for c in NUMBERS))
def e_numeric_summary(spark, d):
    return P.numeric_summary(table(spark, d, "lineitem"), NUMBERS)


@R.query("""select row_number() over (order by first) as place, event_type as value, n, (select count(*) from (select distinct event_type from events)) as n_unique
from (select event_type, min(event_id) as first, count(*) as n from events group by 1) order by first limit 10""")
def e_categorical_summary(spark, d):
    return P.categorical_summary(table(spark, d, "events"), "event_type", ["event_id"])


@R.query(" union all ".join(f"select '{c}' as \"column\", count(distinct {c}) as n_unique, (select string_agg(v, '|' order by v) from (select distinct {c} as v from part order by 1 limit 5)) as first_values from part" for c in ("p_brand", "p_type")))
def e_smallest_values(spark, d):
    return P.smallest_values(table(spark, d, "part"), ["p_brand", "p_type"])


def _profile(c: str, kind: str) -> str:
    num = kind == "numeric"
    return f"""select '{c}' as "column", '{kind}' as kind, round(100.0e0 * count({c}) / count(*), 4) as filled_percent, count(distinct {c}) as n_unique,
{f'min({c})::double' if num else 'null::double'} as min, {f'round(avg({c}), 4)' if num else 'null::double'} as mean, {f'max({c})::double' if num else 'null::double'} as max,
(select v from (select {c}::varchar as v, count(*) as n from customer group by 1 order by n desc, v limit 1)) as most_frequent from customer"""


@R.query(" union all ".join(_profile(c, k) for c, k in (("c_custkey", "numeric"), ("c_name", "categorical"), ("c_nationkey", "numeric"), ("c_mktsegment", "categorical"))))
def e_column_profile(spark, d):
    return P.column_profile(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"))


@R.query("with m as (select min(o_totalprice)::double as a, max(o_totalprice)::double as z from orders) select least(floor((o_totalprice::double - a) / ((z - a) / 20)), 19)::int as bin, count(*) as n from orders, m where o_totalprice is not null group by 1")
def e_histogram(spark, d):
    return P.histogram(table(spark, d, "orders"), "o_totalprice", 20)


@R.query("with m as (select min(o_totalprice)::double as a, max(o_totalprice)::double as z from orders) select least(floor((o_totalprice::double - a) / ((z - a) / 10)), 9)::int as bin, o_orderpriority, count(*) as n from orders, m where o_totalprice is not null group by 1, 2")
def s_histogram_by(spark, d):
    return P.histogram(table(spark, d, "orders"), "o_totalprice", 10, "o_orderpriority")


def _bars(how: str, sql: str, keys: list[str]):
    spread = how == "mean"
    more = ", round(stddev_samp(l_quantity), 6) as sd" if spread else ""

    def run(spark, d):
        out = S.bars(table(spark, d, "lineitem"), "l_quantity", keys, how, spread)
        return out.select(*keys, F.round(F.col("value").cast("double"), 6).alias("value"), *[F.round("sd", 6).alias("sd")] * spread)

    run.__name__ = f"e_bar_{how}_{len(keys)}"
    R.query(f"select {', '.join(keys)}, round(({sql})::double, 6) as value{more} from lineitem where {' and '.join(k + ' is not null' for k in keys)} group by all")(run)


for _how, _sql in (("mean", "avg(l_quantity)"), ("sum", "sum(l_quantity)"), ("count", "count(l_quantity)"), ("median", "median(l_quantity)")):
    _bars(_how, _sql, ["l_returnflag"])
_bars("mean", "avg(l_quantity)", ["l_returnflag", "l_linestatus"])


@R.query("""select c_mktsegment, min(c_acctbal) as low, round(quantile_cont(c_acctbal, 0.25), 6) as q1, round(quantile_cont(c_acctbal, 0.5), 6) as median,
round(quantile_cont(c_acctbal, 0.75), 6) as q3, max(c_acctbal) as high from customer group by 1""")
def e_box(spark, d):
    out = S.boxes(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("c_mktsegment", "low", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")], "high")


@R.query("select l_linenumber, round(avg(l_extendedprice), 4) as mean, count(l_extendedprice) as n from lineitem group by 1")
def s_line_means(spark, d):
    return S.line_means(table(spark, d, "lineitem"), "l_linenumber", "l_extendedprice").withColumn("mean", F.round("mean", 4))


@R.query(" union all ".join(f"select '{a}' as x, '{b}' as y, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(NUMBERS) for b in NUMBERS[i:]))
def e_correlation_matrix(spark, d):
    return S.correlation_matrix(table(spark, d, "lineitem"), NUMBERS).withColumn("r", F.round("r", 6))


@R.query(" union all ".join(f"select '{c}' as feature, round(corr({c}, l_quantity), 6) as r from lineitem" for c in NUMBERS[1:]))
def e_correlation_ranking(spark, d):
    return S.correlation_ranking(table(spark, d, "lineitem"), "l_quantity", NUMBERS[1:]).withColumn("r", F.round("r", 6))


@R.query("""select feature, round(r, 6) as r from (select 'o_totalprice' as feature, corr(o_totalprice, case when o_orderstatus = 'O' then 1 else 0 end) as r from orders where o_orderstatus in ('F', 'O'))""")
def e_correlation_ranking_encoded(spark, d):
    rows = table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O"))
    return S.correlation_ranking(rows, "o_orderstatus", ["o_totalprice"]).withColumn("r", F.round("r", 6))


@R.query("select count(*) as n, round(corr(l_quantity, l_extendedprice), 6) as r from lineitem")
def e_pearson(spark, d):
    return S.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice").withColumn("r", F.round("r", 6))


@R.query("""with t as (select l_quantity as x, l_extendedprice as y from lineitem), r as (select rank() over (order by x) + (count(*) over (partition by x) - 1) / 2.0e0 as rx,
rank() over (order by y) + (count(*) over (partition by y) - 1) / 2.0e0 as ry from t) select count(*) as n, round(corr(rx, ry), 6) as r from r""")
def e_spearman(spark, d):
    return S.correlation(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice", "spearman").withColumn("r", F.round("r", 6))


@R.query("""with t as (select l_linenumber as x, l_quantity as y from lineitem), c as (select x, y, count(*) as n from t group by 1, 2),
s as (select sum(sign(a.x - b.x) * sign(a.y - b.y) * a.n * b.n) as s from c a, c b where a.x > b.x),
tx as (select sum(n * (n - 1) / 2.0e0) as v from (select count(*) as n from t group by x)), ty as (select sum(n * (n - 1) / 2.0e0) as v from (select count(*) as n from t group by y)),
m as (select count(*) as n from t)
select m.n as n, round(s.s / sqrt((m.n * (m.n - 1) / 2.0e0 - tx.v) * (m.n * (m.n - 1) / 2.0e0 - ty.v)), 6) as r from m, s, tx, ty""")
def e_kendall(spark, d):
    return S.correlation(table(spark, d, "lineitem"), "l_linenumber", "l_quantity", "kendall").withColumn("r", F.round("r", 6))


@R.query("""with c as (select l_extendedprice::double as x, l_quantity::double as y, count(*) as n from lineitem where l_extendedprice is not null and l_quantity is not null group by 1, 2),
v as (select distinct y as v from c), w as (select x, y, n, v, case when y = v then n else 0 end as m from c, v),
b as (select y, n, v, sum(m) over (partition by v order by x) - sum(m) over (partition by v, x) as earlier from w), d as (select sum(n::hugeint * earlier) as d from b where v > y),
s as (select sum(n)::hugeint as n, sum(n::hugeint * (n - 1)) / 2 as txy from c), tx as (select sum(n::hugeint * (n - 1)) / 2 as tx from (select x, sum(n) as n from c group by 1)), ty as (select sum(n::hugeint * (n - 1)) / 2 as ty from (select y, sum(n) as n from c group by 1))
select s.n::bigint as n, round((s.n * (s.n - 1) / 2 - tx - ty + txy - 2 * d)::double / (sqrt(s.n * (s.n - 1) / 2 - tx) * sqrt(s.n * (s.n - 1) / 2 - ty)), 6) as r from s, tx, ty, d""")
def e_kendall_continuous(spark, d):
    return S.correlation(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity", "kendall").withColumn("r", F.round("r", 6))


@R.query("""with g as (select c_mktsegment as k, count(*)::double as n, avg(c_acctbal) as m, var_samp(c_acctbal) as v from customer where c_mktsegment in ('AUTOMOBILE', 'BUILDING') group by 1),
w as (select a.n as n1, a.m as m1, a.v as v1, b.n as n2, b.m as m2, b.v as v2 from g a, g b where a.k = 'AUTOMOBILE' and b.k = 'BUILDING')
select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) as t, round(pow(v1 / n1 + v2 / n2, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v2 / n2, 2) / (n2 - 1)), 4) as df from w""")
def e_welch(spark, d):
    out = S.welch(table(spark, d, "customer"), "c_acctbal", "c_mktsegment", "AUTOMOBILE", "BUILDING")
    return out.select(F.round("t", 6).alias("t"), F.round("df", 4).alias("df")).where("t is not null")


@R.query("""with g as (select c_mktsegment, count(*)::double as n, avg(c_acctbal) as m, coalesce(var_samp(c_acctbal), 0) as v from customer group by 1), t as (select sum(n * m) / sum(n) as mean from g)
select count(*) as k, sum(n)::bigint as n, round(sum(n * pow(m - mean, 2)), 2) as ssb, round(sum((n - 1) * v), 2) as ssw,
round((sum(n * pow(m - mean, 2)) / (count(*) - 1)) / (sum((n - 1) * v) / (sum(n) - count(*))), 6) as f from g, t""")
def e_anova(spark, d):
    out = S.anova(table(spark, d, "customer"), "c_acctbal", "c_mktsegment")
    return out.select("k", "n", F.round("ssb", 2).alias("ssb"), F.round("ssw", 2).alias("ssw"), F.round("f", 6).alias("f"))


@R.query("""select count(*) as n, round(regr_slope(l_extendedprice, l_quantity), 4) as slope, round(regr_intercept(l_extendedprice, l_quantity), 3) as intercept,
round(regr_r2(l_extendedprice, l_quantity), 6) as r2 from lineitem""")
def e_simple_regression(spark, d):
    out = S.simple_regression(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return out.select("n", F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


@R.query()
def e_regression(spark, d):
    return S.regression(table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"])


@R.query()
def g_seeded_sample(spark, d):
    return P.seeded_sample(table(spark, d, "lineitem").withColumn("key", F.concat_ws("-", "l_orderkey", "l_linenumber")), "key", 5000).select("key", "l_quantity")


@R.query("select event_id, ts as timestamp from events")
def c_timed(spark, d):
    rows = table(spark, d, "events").select("event_id", F.col("ts").cast("string").alias("stamp"))
    return P.timed(rows, "stamp").select("event_id", F.col("timestamp").cast("timestamp_ntz").alias("timestamp"))


@R.query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_extendedprice), 2) as total from lineitem group by rollup (l_returnflag, l_linestatus)")
def x_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))
