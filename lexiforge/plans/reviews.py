"""Queries over review views, orders and lookups.

Questions are orders of a customer: their lines are options, dealt to two rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import review as V
from .common import Registry, table
from .pages import CONTROLS, LINES, REGIONS, _controls, _lines, _regions

R = Registry()


@R.query(f"with {LINES}, {REGIONS} select document, page, region_id, type from reg where type in ('text', 'title', 'table')")
def c_layer_regions(spark, d):
    return V.regions_for(_regions(spark, d), V.LAYER).select("document", "page", "region_id", "type")


@R.query(f"with {LINES}, {REGIONS} select document, page, string_agg(content, ' ' order by reading_order, region_id) as text from reg where type in ('text', 'title') group by 1, 2")
def t_page_prose(spark, d):
    return V.prose(_regions(spark, d), "document", "page")


@R.query(f"with {LINES}, {REGIONS} select document, string_agg(content, ' ' order by page, reading_order, region_id) as text from reg where type in ('text', 'title') group by 1")
def t_document_prose(spark, d):
    return V.prose(_regions(spark, d), "document")


@R.query(f"""with {LINES}, {CONTROLS} select document, page, control_id, row_number() over (partition by document, page order by floor(y1 / 20), x1, control_id) as position from ctr""")
def g_detected_order(spark, d):
    return V.detected_order(_controls(spark, d)).select("document", "page", "control_id", "position")


@R.query(f"""with {LINES}, r as (select o_custkey as document, 'p' || o_orderkey || '-' || l_linenumber as row_id, case when o_orderkey % 3 > 0 then o_orderkey % 3 else 0 end as scan_page, l_suppkey % 2 as col, (l_partkey % 90)::double as top from li join orders on o_orderkey = l_orderkey)
select document, row_id, row_number() over (partition by document order by scan_page, col, top, row_id) as position from r""")
def g_answer_order(spark, d):
    top = (F.col("l_partkey") % 90).cast("double")
    rows = _lines(spark, d).select(
        "document", F.concat(F.lit("p"), "page", F.lit("-"), "l_linenumber").alias("row_id"), F.when(F.col("page") % 3 > 0, F.col("page") % 3).alias("scan_page"),
        (F.col("l_suppkey") % 2).alias("column"), F.array(F.lit(0.0), top, F.lit(9.0), top + 4).alias("bbox"))
    return V.answer_order(rows).select("document", "row_id", "position")


@R.query("""select document, page, ord from (select n_regionkey as document, c_nationkey as page, c_custkey as ord, row_number() over (partition by n_regionkey, c_nationkey order by c_custkey) as i
from customer join nation on n_nationkey = c_nationkey) where i <= 30""")
def g_first_sections(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("page"), F.col("n_regionkey").alias("document"))
    sections = table(spark, d, "customer").select(F.col("c_nationkey").alias("page"), F.col("c_custkey").alias("ord")).join(nation, "page")
    return V.first_sections(sections).select("document", "page", "ord")


@R.query("""select o_custkey as paper_id, o_orderpriority as title, arg_max(case when o_orderkey % 4 = 0 then '' else '10.1/' || o_orderkey end, o_orderkey) as doi from orders group by 1, 2""")
def d_cited_dois(spark, d):
    doi = F.when(F.col("o_orderkey") % 4 > 0, F.concat(F.lit("10.1/"), "o_orderkey"))
    cited = F.array_sort(F.collect_list(F.struct("o_orderkey", F.concat(F.lit(" "), "o_orderpriority").alias("title"), doi.alias("doi"))))
    return V.cited_dois(table(spark, d, "orders").groupBy(F.col("o_custkey").alias("paper_id")).agg(cited.alias("citations")))


@R.query("select c_custkey as paper_id, c_name as title from customer where not (c_mktsegment = 'BUILDING' and c_acctbal < 5000)")
def c_chosen_papers(spark, d):
    c = table(spark, d, "customer")
    choices = c.where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("paper_id"), (F.col("c_acctbal") >= 5000).alias("chosen"))
    return V.chosen(c.select(F.col("c_custkey").alias("paper_id"), F.col("c_name").alias("title")), choices)


@R.query("""select nation, position, c_custkey, s_suppkey from (select c_nationkey as nation, c_custkey, row_number() over (partition by c_nationkey order by c_custkey) as position from customer)
join (select s_nationkey as nation, s_suppkey, row_number() over (partition by s_nationkey order by s_suppkey) as position from supplier) using (nation, position)""")
def d_paired(spark, d):
    left = table(spark, d, "customer").select(F.col("c_nationkey").alias("nation"), "c_custkey")
    right = table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), "s_suppkey")
    return V.paired(left, right, "nation", "c_custkey", "s_suppkey")


@R.query("""select o_orderkey, case o_orderstatus when 'F' then 'schema-free-v2' when 'O' then 'paddle-id-v1' else 'schema-free-v2' end as contract from orders""")
def t_contract_names(spark, d):
    status = F.col("o_orderstatus")
    value = F.when(status == "F", F.lit(" Universal ")).when(status == "O", F.lit("ID-only"))
    return table(spark, d, "orders").select("o_orderkey", V.contract_name(value).alias("contract"))


@R.query("""select o_orderkey, case when o_orderpriority in ('1-URGENT', '2-HIGH') then o_orderstatus else 'needs_review' end as status,
case when o_orderstatus = 'F' then 'late|' else '' end || case when o_orderpriority in ('1-URGENT', '2-HIGH') then '' else 'model has not passed the release benchmark' end as warnings from orders""")
def t_release_gate(spark, d):
    late = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("late"))).otherwise(F.array().cast("array<string>"))
    groups = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), late.alias("warnings"), "o_orderpriority")
    out = V.gated(groups, F.col("o_orderpriority"), ["1-URGENT", " 2-HIGH", ""])
    shown = F.concat(F.when(F.array_contains("warnings", "late"), F.lit("late|")).otherwise(F.lit("")), F.array_join(F.array_remove("warnings", "late"), "|"))
    return out.select("o_orderkey", "status", shown.alias("warnings"))


@R.query("""select c_custkey, 'Text recognition: ' || c_mktsegment || ', n' || c_nationkey || case when c_acctbal > 0 then chr(10) || 'Layout model v2: ' || c_name else '' end as lines from customer""")
def t_provenance_lines(spark, d):
    none = F.array().cast("array<string>")
    name = F.when(F.col("c_acctbal") > 0, F.array("c_name")).otherwise(none)
    parts = F.create_map(F.lit("text_recognition"), F.array("c_mktsegment", F.concat(F.lit("n"), "c_nationkey")), F.lit("figure_descriptions"), none, F.lit("layout_MODEL_v2"), name)
    return table(spark, d, "customer").select("c_custkey", V.provenance_lines(parts).alias("lines"))


@R.query(f"""with {LINES}, o as (select l_orderkey as question, l_partkey % 2 as r, case when l_partkey % 5 = 0 then 'option ' || row_number() over w else 'o' || l_suppkey % 3 end as label, row_number() over w as i, l_suppkey % 4 = 0 as marked from li window w as (partition by l_orderkey, l_partkey % 2 order by l_linenumber)),
f as (select *, case when count(*) over (partition by question, r, label) > 1 then label || ' [' || i || ']' else label end as shown from o),
a as (select question, r, coalesce(string_agg(shown, ' | ' order by i) filter (marked), '— no answer —') as answer, list(shown order by i) as labels, count(*) filter (marked) as n from f group by 1, 2)
select question, string_agg(case r when 0 then 'q0: ' || answer else answer end, '; ' order by r) as answers, count(distinct labels) = 1 and max(n) <= 1 as shared from a group by 1""")
def t_review_view(spark, d):
    label = F.when(F.col("l_partkey") % 5 > 0, F.concat(F.lit(" o"), F.col("l_suppkey") % 3)).otherwise(F.lit(" "))
    state = F.when(F.col("l_suppkey") % 4 == 0, F.lit("selected")).otherwise(F.lit("cancelled"))
    option = F.struct("l_linenumber", label.alias("label"), state.alias("state"))
    rows = _lines(spark, d).groupBy("page", (F.col("l_partkey") % 2).alias("r")).agg(F.array_sort(F.collect_list(option)).alias("options"))
    name = F.when(F.col("r") == 0, F.lit("q0"))
    questions = rows.groupBy(F.col("page").alias("question")).agg(F.array_sort(F.collect_list(F.struct("r", name.alias("label"), "options"))).alias("rows"))
    return questions.select("question", V.answer_summary(F.col("rows")).alias("answers"), V.shared_options(F.lit("matrix"), F.lit("one_per_row"), F.col("rows")).alias("shared"))


@R.query("""select lang, case lang when 'en' then 'eng_Latn' when 'de' then 'deu_Latn' when 'fr' then 'fra_Latn' when 'es' then 'spa_Latn' when 'it' then 'ita_Latn' when 'zh' then 'zho_Hans' when 'ja' then 'jpn_Jpan' when 'ru' then 'rus_Cyrl' when 'pt' then 'por_Latn' when 'nl' then 'nld_Latn' end as code,
case when lang in ('en', 'de', 'fr', 'es', 'it', 'zh', 'ja', 'ru', 'pt', 'nl') then lang end as back, count(*) as n from documents group by 1, 2, 3""")
def i_language_codes(spark, d):
    code = V.with_script(F.col("lang"))
    return table(spark, d, "documents").groupBy("lang", code.alias("code"), V.two_letters(code).alias("back")).agg(F.count("*").alias("n"))
