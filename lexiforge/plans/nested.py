"""Queries over nested results, question sections and learnt layouts, all made of the given tables' rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import harvest as H
from ..operators import sections as Q
from ..operators.lineage import spread
from .common import Registry, table

R = Registry()


def _results(spark, d):
    """Texts in results of three shapes."""
    docs = table(spark, d, "documents")
    c, own = F.col, F.coalesce("text", F.lit(""))
    first = F.to_json(F.struct(F.struct(F.array("lang", F.concat(F.lit(" "), "source")).alias("rec_texts"), F.struct(own.alias("text")).alias("meta")).alias("res")))
    second = F.concat(F.lit("["), F.to_json(F.struct(c("lang").alias("Text"))), F.lit(","), F.to_json(F.struct(F.struct(F.array(c("source"), c("n_chars").cast("string")).alias("texts")).alias("inner"))), F.lit("]"))
    third = F.to_json(F.struct(F.array(F.struct(F.array(F.struct(c("lang").alias("text"), c("source").alias("texts"))).alias("blocks"))).alias("pages"), own.alias("other")))
    return docs.select("doc_id", F.when(c("doc_id") % 3 == 0, first).when(c("doc_id") % 3 == 1, second).otherwise(third).alias("result"))


@R.query(r"""with t as (select doc_id, unnest(case doc_id % 3 when 0 then [regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g'), lang, source] when 1 then [lang, source, n_chars::varchar] else [lang, source] end) as text,
unnest(range(case doc_id % 3 when 2 then 2 else 3 end)) as o from documents) select doc_id as id, row_number() over (partition by doc_id order by o) - 1 as ord, text from t where text <> ''""")
def i_nested_texts(spark, d):
    return H.texts(H.nodes(_results(spark, d), "doc_id", "result"))


def _found(spark, d):
    """Polygons, boxes and layouts in results, by different names."""
    n = F.col("user_id") % 50
    corner = lambda a, b: F.array((n + a).cast("int"), (F.col("event_id") % 7 * 20 + b).cast("int"))
    b = F.concat(corner(40, 15), corner(0, 0))
    odd = F.col("event_id") % 2 == 1
    label = lambda name, use: F.when(use, F.col("event_type")).alias(name)
    block = F.struct(label("block_label", odd), label("label", ~odd), F.when(odd, F.concat(F.lit("c"), "user_id")).alias("block_content"), F.when(~odd, F.concat(F.lit("c"), "user_id")).alias("content"),
                     F.when(odd, b).alias("block_bbox"), F.when(~odd, b).alias("bbox"), (F.col("event_id") % 7).alias("block_order"), F.col("value").alias("score"))
    box = F.struct(F.col("event_type").alias("label"), F.when(odd, b).alias("coordinate"), F.when(~odd, b).alias("bbox"), (F.col("event_id") % 7).alias("cls_id"))
    res = F.struct(F.array(block).alias("parsing_res_list"), F.array(F.array(corner(0, 0), corner(40, 0), corner(40, 15), corner(0, 15))).alias("rec_polys"), F.array(b).alias("rec_boxes"), F.array(F.lit(0.5), F.lit(0.25)).alias("rec_scores"),
                   F.struct(F.array(box).alias("boxes")).alias("layout_det_res"))
    whole = F.when(odd, F.to_json(F.struct(res.alias("res")))).otherwise(F.to_json(res))
    return table(spark, d, "events").select(F.col("event_id").alias("id"), whole.alias("result"))


_BOX = "[user_id % 50, event_id % 7 * 20, user_id % 50 + 40, event_id % 7 * 20 + 15]::double[]"


@R.query(f"select event_id as id, unnest(range(4)) as ord, {_BOX} as bbox from events")
def i_nested_boxes(spark, d):
    return H.boxes(H.nodes(_found(spark, d), "id", "result"))


@R.query(f"select event_id as id, 0 as ord, event_type as label, 'c' || user_id as content, {_BOX} as bbox, event_id % 7 as block_order, value as score from events")
def t_parsed_blocks(spark, d):
    return H.blocks(_found(spark, d), "id", "result")


@R.query(f"select event_id as id, 0 as ord, event_type as label, null::double as score, {_BOX} as bbox, event_id % 7 as cls_id from events")
def t_layout_boxes(spark, d):
    return H.layout_boxes(_found(spark, d), "id", "result")


def _sections(spark, d):
    """A section for each order: a title, a table of its lines with two choices, and for some orders a second table."""
    lines = table(spark, d, "lineitem")
    cell = lambda *x: F.concat(*[v for t in x for v in (F.lit("<td>"), t if not isinstance(t, str) else F.lit(t), F.lit("</td>"))])
    row = lambda *x: F.concat(F.lit("<tr>"), cell(*x), F.lit("</tr>"))
    mine = row(F.concat(F.lit("Item "), "l_linenumber"), F.when(F.col("l_linenumber") % 2 == 0, "○").otherwise("●"), "○")
    rows = lines.groupBy(F.col("l_orderkey").alias("section")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", mine.alias("h")))), lambda s: s["h"]), "").alias("rows"))
    shape = lambda i, kind, html, text: F.struct(F.lit(i).alias("region_id"), F.lit(ord(i) - 97).alias("ord"), F.lit(kind).alias("type"), html.alias("html"), text.alias("text"))
    none, s = F.lit(None).cast("string"), F.col("section")
    head = F.concat(F.lit("<table><tr><td></td><td>Good</td><td>Bad</td></tr>"), "rows", F.lit("</table>"))
    second = F.when(s % 3 == 0, F.lit("<table><tr><td></td><td>1</td><td>2</td><td>3</td><td>4</td></tr><tr><td>Scale</td><td>○</td><td>○</td><td>○</td><td>●</td></tr></table>")).otherwise(
        F.lit("<table><tr><td>Price</td><td>☐</td><td>☐</td></tr></table>"))
    regions = F.array(shape("a", "text", none, F.concat(s, F.lit(") Which? ○ yes | ● no"))), shape("b", "table", head, none), shape("c", "table", second, none))
    regions = rows.select((s % 7).cast("int").alias("page"), "section", F.inline(F.when(s % 3 == 2, F.slice(regions, 1, 2)).otherwise(regions)))
    return regions, rows.select((s % 7).cast("int").alias("page"), "section", F.concat(s, F.lit(")  Which?  ○ yes")).alias("anchor"))


@R.query("""with l as (select l_orderkey as s, count(distinct l_linenumber) as n, count(*) as m, string_agg('b_r' || rn || ':Item ' || l_linenumber || ':Good=' || case when l_linenumber % 2 = 0 then 'unchecked' else 'checked' end || ',Bad=unchecked', ';' order by rn) as rows
from (select *, row_number() over (partition by l_orderkey order by l_linenumber) as rn from lineitem) group by 1), o as (select *, n > 1 and n = m as good, s % 3 = 0 as also from l),
w as (select *, case when good and not also then 'b' when also and not good then 'c' else '' end as owner from o)
select (s % 7)::int as page, s as section, s || ') Which?' as question_text, case owner when '' then '' else 'paddleocr-vl-table' end as structure_source, owner as structure_region_id,
case owner when 'b' then rows when 'c' then 'c_r1:Scale:1=unchecked,2=unchecked,3=unchecked,4=checked' else 'a:' || s || ') Which?:yes=unchecked,no=checked;' || rows || case s % 3 when 0 then ';c_r1:Scale:1=unchecked,2=unchecked,3=unchecked,4=checked' when 1 then ';c_r0:Price:option 1=unchecked,option 2=unchecked' else '' end end as rows from w""")
def i_schema_hints(spark, d):
    regions, anchors = _sections(spark, d)
    shown = F.array_join(F.transform("rows", lambda r: F.concat_ws(":", r["row_id"], r["label"], F.array_join(F.transform(r["options"], lambda o: F.concat(o["label"], F.lit("="), o["state"])), ","))), ";")
    return Q.schema_hints(regions, anchors).withColumn("rows", shown)


@R.query("""select user_id as page, event_id as section, case when event_type = 'purchase' then 'paddle-mark-glyph:a,b|paddle-checkbox-region:b' when event_type = 'click' then 'paddle-mark-notation:a' when event_type = 'view' then 'paddle-binary-options:a'
when event_id % 4 >= 2 then 'aligned-geometric-mark-pattern:' else '' end as evidence from events""")
def o_candidate_evidence(spark, d):
    e = table(spark, d, "events")
    kind = F.col("event_type")
    text = F.when(kind == "purchase", "☐ Box").when(kind == "click", "a \\boxtimes b").when(kind == "view", "Yes / No").otherwise("Price list, no yesterday")
    shape = lambda i, of, t: F.struct(F.lit(i).alias("region_id"), F.lit(ord(i)).alias("ord"), of.alias("type"), t.alias("text"))
    two = F.array(shape("a", F.lit("text"), text), shape("b", F.when(kind == "purchase", "checkbox").otherwise("text"), F.when(kind == "purchase", "☒").otherwise("plain")))
    rows = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("section"), F.inline(two)).withColumn("html", F.lit(None).cast("string")).withColumn("marks", F.when(F.col("region_id") == "b", (F.col("section") % 4).cast("int")))
    shown = F.array_join(F.transform("evidence", lambda r: F.concat(r["reason"], F.lit(":"), F.array_join(r["regions"], ","))), "|")
    return Q.evidence(rows, F.col("marks")).withColumn("evidence", shown)


@R.query("""with r as (select l_suppkey % 40 as page, l_linenumber * 20.0 as y, l_returnflag = 'R' or l_quantity > 49 or (l_linestatus = 'F' and l_quantity < 2) as shows from lineitem), b as (select distinct l_suppkey % 40 as page, l_linenumber as section from lineitem)
select b.page as page, b.section as section, bool_or(coalesce(r.y is not null, false)) as present from b left join r on r.page = b.page and r.shows and r.y + 15 > b.section * 20 + 10 and r.y < b.section * 20 + 30 group by 1, 2""")
def t_mark_presence(spark, d):
    rows = table(spark, d, "lineitem").withColumn("page", F.col("l_suppkey") % 40)
    y = F.col("l_linenumber") * 20.0
    item = F.struct(F.lit("unchecked").alias("state"), (F.col("l_quantity") > 49).alias("needs_review"))
    regions = rows.select("page", F.array(F.lit(0.0), y, F.lit(40.0), y + 15).alias("box"), F.when(F.col("l_linestatus") == "F", "table").otherwise("text").alias("type"), F.when(F.col("l_returnflag") == "R", "uncertain").alias("state"),
                          F.array(item).alias("items"), F.when(F.col("l_quantity") < 2, "☒ x").alias("html"), F.lit("☐ y").alias("text"))
    boxes = rows.select("page", F.col("l_linenumber").alias("section"), F.array(F.lit(0.0), y + 10, F.lit(40.0), y + 30).alias("box")).distinct()
    return Q.mark_presence(regions, boxes).drop("box")


@R.query("""with j as (select o_custkey % 20 as form, o_orderkey as turn, l_linenumber as page, 600 + o_orderkey % 7 as width, 800 + o_orderkey % 5 as height, l_partkey % 30 as x, l_suppkey % 30 as y, l_quantity < 30 as valid from orders join lineitem on l_orderkey = o_orderkey),
g as (select form, page, turn from j group by all having bool_and(valid)), f as (select form, page, min(turn) as first from g group by 1, 2), s as (select j.form, j.page, f.first, j.x / j.width::double as x1, j.y / j.height::double as y1, (j.x + 590) / j.width::double as x2, (j.y + 700) / j.height::double as y2 from j join f on f.form = j.form and f.page = j.page and f.first = j.turn),
p as (select distinct form, turn, page, width, height from j) select p.form as form, p.turn as turn, p.page as page, greatest(0, round_even(x1 * width, 0))::int as x1, greatest(0, round_even(y1 * height, 0))::int as y1,
least(width, round_even(x2 * width, 0))::int as x2, least(height, round_even(y2 * height, 0))::int as y2 from p join s on s.form = p.form and s.page = p.page and p.turn > s.first""")
def o_reused_layout(spark, d):
    k = F.col("o_orderkey")
    x, y = F.col("l_partkey") % 30, F.col("l_suppkey") % 30
    jobs = table(spark, d, "orders").join(spread(table(spark, d, "lineitem"), "l_orderkey"), k == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 20).alias("form"), k.alias("document"), k.alias("turn"), F.col("l_linenumber").alias("page"), (600 + k % 7).alias("width"), (800 + k % 5).alias("height"),
        F.concat(F.lit("g"), "l_linenumber").alias("group_id"), F.array(x, y, x + 590, y + 700).alias("bbox"), (F.col("l_quantity") < 30).alias("valid"))
    pages = jobs.select("form", "document", "turn", "page", "width", "height").distinct()
    out = Q.reused_layout(Q.learned_layout(jobs), pages)
    return out.select("form", "turn", "page", *[F.col("bbox")[i].alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))])
