"""Queries over page layouts: streams, labels, grids, orders and renderings, on regions made from orders and lines.

A document is a customer's orders, a page one order; its lines are regions, groups or controls on it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import layout as L
from ..operators import survey as V
from ..operators.lineage import spread
from .common import Registry, table

R = Registry()
KINDS = ["text", "title", "table", "figure", "checkbox"]
LINES = "li as (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey from lineitem group by 1, 2)"
REGIONS = """reg as (select o_custkey as document, l_orderkey as page, 'r' || l_linenumber as region_id, ['text', 'title', 'table', 'figure', 'checkbox'][1 + l_partkey % 5] as type, l_linenumber::int as reading_order,
'c' || l_partkey as content, (l_partkey % 50)::double as x1, l_linenumber * 20.0e0 as y1, (l_partkey % 50) + 40.0e0 as x2, l_linenumber * 20.0e0 + 15 as y2 from li join orders on o_orderkey = l_orderkey)"""
GROUPS = """grp as (select distinct o_custkey as document, o_orderkey as page, 'g' || o_orderkey as group_id, 10.0e0 as gx1, (o_orderkey % 150)::double as gy1, 60.0e0 as gx2, (o_orderkey % 150) + 18.0e0 as gy2 from orders join li on l_orderkey = o_orderkey)"""
CONTROLS = """ctr as (select o_custkey as document, l_orderkey as page, 'k' || l_linenumber as control_id, (l_suppkey % 60)::double as x1, (l_linenumber // 2) * 10.0e0 as y1, (l_suppkey % 60) + 4.0e0 as x2, (l_linenumber // 2) * 10.0e0 + 4 + l_linenumber % 3 as y2 from li join orders on o_orderkey = l_orderkey)"""


def _lines(spark, d):
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("page"), F.col("o_custkey").alias("document"))
    lines = spread(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), "l_orderkey").groupBy(F.col("l_orderkey").alias("page"), "l_linenumber").agg(F.min("l_partkey").alias("l_partkey"), F.min("l_suppkey").alias("l_suppkey"))
    return lines.join(orders, "page")


def _regions(spark, d):
    x, y = (F.col("l_partkey") % 50).cast("double"), F.col("l_linenumber") * 20.0
    kind = F.array(*map(F.lit, KINDS))[(F.col("l_partkey") % 5).cast("int")]
    return _lines(spark, d).select("document", "page", F.concat(F.lit("r"), "l_linenumber").alias("region_id"), kind.alias("type"), F.col("l_linenumber").cast("int").alias("reading_order"),
                                   F.concat(F.lit("c"), "l_partkey").alias("content"), F.array(x, y, x + 40, y + 15).alias("box"))


def _groups(spark, d):
    y = (F.col("page") % 150).cast("double")
    return _lines(spark, d).select("document", "page").distinct().select("document", "page", F.concat(F.lit("g"), "page").alias("group_id"), F.array(F.lit(10.0), y, F.lit(60.0), y + 18).alias("box"))


def _controls(spark, d):
    n = F.col("l_linenumber")
    x, y = (F.col("l_suppkey") % 60).cast("double"), F.floor(n / 2) * 10.0
    return _lines(spark, d).select("document", "page", F.concat(F.lit("k"), n).alias("control_id"), F.array(x, y, x + 4, y + 4 + n % 3).alias("bbox"))


@R.query(f"""with {LINES}, {REGIONS}, {GROUPS}, b as (select *, greatest(0, least(x2, gx2) - greatest(x1, gx1)) * greatest(0, least(y2, gy2) - greatest(y1, gy1)) / ((x2 - x1) * (y2 - y1)) as cov from grp join reg using (document, page)),
p as (select document, page, group_id as item, 'form_group' as kind, coalesce(max(case when cov > 0 then reading_order end), max(case when y2 <= gy1 then reading_order end), 2147483647) as place, 1 as late from b group by 1, 2, 3),
h as (select distinct document, page, region_id from b where type = 'checkbox' and cov >= 0.5),
s as (select document, page, region_id as item, 'region' as kind, reading_order as place, 0 as late from reg anti join h using (document, page, region_id) union all select * from p)
select document, page, row_number() over (partition by document, page order by place, late, item) as position, kind, item from s""")
def m_page_stream(spark, d):
    return L.page_stream(_regions(spark, d), _groups(spark, d))


@R.query(f"""with {LINES}, {REGIONS}, {CONTROLS}, n as (select c.document as document, c.page as page, control_id, content, greatest(0, r.x1 - c.x2) as far, reading_order from ctr c join reg r using (document, page)
where r.y2 >= (c.y1 + c.y2) / 2 - greatest(1, c.y2 - c.y1) * 0.8e0 and r.y1 <= (c.y1 + c.y2) / 2 + greatest(1, c.y2 - c.y1) * 0.8e0 and r.x2 > c.x1 and r.x1 <= c.x2 + 16)
select document, page, control_id, content as label from (select *, row_number() over (partition by document, page, control_id order by far, reading_order) as i from n) where i = 1""")
def d_nearest_labels(spark, d):
    blocks = _regions(spark, d).select("document", "page", "box", F.col("content").alias("text"), F.col("reading_order").alias("ord"))
    return L.nearest_labels(_controls(spark, d), blocks, 16.0)


@R.query(f"""with {LINES}, {REGIONS}, {CONTROLS}, h as (select r.document as document, r.page as page, region_id, control_id from reg r join ctr c using (document, page) where (c.x1 + c.x2) / 2 between r.x1 and r.x2 and (c.y1 + c.y2) / 2 between r.y1 and r.y2)
select document, page, region_id, count(*) as controls, bool_and(control_id <> 'k3') as labelled from h group by 1, 2, 3 having count(*) >= 2""")
def d_question_grids(spark, d):
    controls = _controls(spark, d).withColumn("label", F.when(F.col("control_id") != "k3", F.col("control_id")))
    return L.grids(_regions(spark, d), controls)


@R.query(f"""with {LINES}, {CONTROLS}, t as (select *, median(y2 - y1) over (partition by document, page) as tall from ctr)
select document, page, control_id, row_number() over (partition by document, page order by round_even((y1 + y2) / 2 / greatest(1, tall), 0), x1, control_id) as position from t""")
def g_control_order(spark, d):
    return L.reading_order(_controls(spark, d)).select("document", "page", "control_id", "position")


@R.query(f"with {LINES}, {REGIONS} select document, page, type, count(*) as n from reg group by 1, 2, 3")
def e_region_counts(spark, d):
    return L.region_counts(_regions(spark, d))


@R.query(f"""with {LINES}, {REGIONS} select document, page, string_agg(case type when 'title' then '## ' || content when 'figure' then '![figure](' || region_id || ')' else content end, chr(10) || chr(10) order by reading_order, region_id) as text from reg group by 1, 2""")
def b_page_markdown(spark, d):
    return L.markdown(_regions(spark, d))


@R.query(f"with {LINES}, {REGIONS} select document, page, string_agg(content, chr(10) || chr(10) order by reading_order, region_id) as text from reg where type <> 'figure' group by 1, 2")
def b_page_plain(spark, d):
    return L.plain(_regions(spark, d))


@R.query("""with r as (select quantity > 20 as flagged, quantity < 35 as correct, unsure, missing, certainty from (select l_quantity as quantity, l_linenumber = 7 as unsure, l_linenumber = 6 as missing, l_discount::double as certainty from lineitem)), f as (select * from r where not unsure and not missing)
select count(*) as scored, count(*) filter (flagged) as flagged, count(*) filter (not flagged) as auto_accepted, count(*) filter (not flagged and correct) as auto_correct, round(avg(case when not flagged then correct::int end), 4) as accuracy,
count(*) filter (not flagged and not correct) as silent_errors, round(max(certainty) filter (not flagged and not correct), 3) as max_certainty, round(median(certainty) filter (not flagged and not correct), 3) as median_certainty from f""".replace("quantity < 35", "quantity % 7 <> 3"))
def e_score_summary(spark, d):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    rows = table(spark, d, "lineitem").select((q > 20).alias("flagged"), (q % 7 != 3).alias("correct"), (n == 7).alias("human_unsure"), F.when(n == 6, "x").otherwise("").alias("unmatched"), F.col("l_discount").cast("double").alias("certainty"))
    return V.score_summary(rows)


@R.query("""with c as (select distinct l_suppkey % 40 as document, l_partkey % 3 as page, 'q' || l_linenumber % 3 as q, case when l_returnflag = 'R' then 'box' else 'circle' end as shape, (l_quantity::int % 9) * 60 as y, (l_partkey % 4) * 60 as x from lineitem),
r as (select document, page, q, shape, y, count(*) as n from c group by all), s as (select *, lag(n) over (partition by document, page, q, shape order by y) as before from r),
g as (select *, sum(case when n = 1 and coalesce(before, 2) = 1 then 0 else 1 end) over (partition by document, page, q, shape order by y) as g from s),
k as (select *, dense_rank() over (partition by document, page, q order by shape, g) as k from g)
select c.document as document, c.page as page, c.q as question_id, c.shape || c.y || '_' || c.x as control_id, c.q || '_r' || lpad(k::varchar, 2, '0') as row_id, case c.shape when 'box' then 'multiple' else 'single' end as rule,
row_number() over (partition by c.document, c.page, c.q, k order by c.y, c.x) as position from c join k using (document, page, q, shape, y)""")
def f_answer_groups(spark, d):
    n, y, x = F.col("l_linenumber") % 3, (F.col("l_quantity").cast("int") % 9) * 60, (F.col("l_partkey") % 4) * 60
    shape = F.when(F.col("l_returnflag") == "R", "box").otherwise("circle")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 40).alias("document"), (F.col("l_partkey") % 3).alias("page"), F.concat(F.lit("q"), n).alias("question_id"), shape.alias("shape"),
                                              F.concat(shape, y, F.lit("_"), x).alias("control_id"), (x * 100 + y).alias("ord"), F.array(*[v.cast("double") for v in (x, y, x + 34, y + 34)]).alias("bbox")).distinct()
    return L.answer_groups(rows)
