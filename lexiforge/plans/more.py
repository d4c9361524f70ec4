"""Queries over further operators: predicates, layout joins, forms, sheets, provenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import timecode as C
from ..operators import flows as M
from ..operators import forms as O
from ..operators import graph as K
from ..operators import layout as L
from ..operators import profile as P
from ..operators import survey as V
from ..operators import topics as T
from ..sources import sinks
from .common import Registry, table
from .marts import PAPERS, READ, _controls, _papers, _readings

R = Registry()


@R.query(r"""select doc_id, len(regexp_extract_all(text, '[\x{2200}-\x{22FF}\x{391}-\x{3C9}]')) >= 8 as math, regexp_matches(text, '[☑☒✓✔✗✘√●■▣▪◼✕⨯×☐□○◯▢▭▯❍◌◦]') as marked,
length(trim(text)) > 0 as labelled, len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: w in ('ja', 'yes', 'oui'))) > 0 as yes from documents""")
def c_text_flags(spark, d):
    t = F.col("text")
    words = F.split(F.lower(t), "[^a-z]+")
    return table(spark, d, "documents").select("doc_id", O.math_page(t, F.array().cast("array<string>")).alias("math"), (F.size(X.mark_glyphs(t)) > 0).alias("marked"), (F.length(F.trim(t)) > 0).alias("labelled"),
                                               F.exists(words, lambda w: w.isin("ja", "yes", "oui")).alias("yes"))


@R.query("select event_id, props as json, (props->>'$.k')::int as k from events where props is not null")
def i_json_objects(spark, d):
    rows = table(spark, d, "events").where("props is not null")
    wrapped = F.concat(F.lit("```json\n"), "props", F.lit("\n```"))
    return rows.select("event_id", X.json_object(wrapped).alias("json"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@R.query("""with e as (select event_id, case when event_id % 3 = 0 then '=' || event_type else event_type end as label, value from events)
select event_id, case when regexp_matches(label, '^[=+@\t\r-]') then '''' || label else label end as label, value from e""")
def b_formula_safe(spark, d):
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("="), "event_type")).otherwise(F.col("event_type")).alias("label"), "value")
    return sinks.spreadsheet_safe(e)


@R.query("""with f as (select user_id, event_type, min(event_id) as o from events group by 1, 2) select user_id, string_agg(event_type, ',' order by o) as seen from f group by 1""")
def e_first_seen(spark, d):
    return L.first_seen(table(spark, d, "events"), ["user_id"], "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("seen"))


@R.query("select event_type as topic, date_trunc('week', ts) as period, count(*) as n from events group by 1, 2")
def i_topics_over_time(spark, d):
    return T.topics_over_time(table(spark, d, "events"), "event_type", "ts", "week").withColumn("period", F.col("period").cast("timestamp_ntz"))


@R.query("""with b as (select conv_id as doc, turn as ord, text, lag(text) over (partition by conv_id order by turn) as bef from conversations),
g as (select *, sum(case when bef is null or trim(bef) = '' or regexp_matches(bef, '[.!?。！？…:;]["'')\\]»”’]*\\s*$') then 1 else 0 end) over (partition by doc order by ord) as p from b) select doc, ord, case when trim(text) <> '' then p end as paragraph from g""".replace("\\\\", "\\"))
def f_paragraph_groups(spark, d):
    rows = table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("ord"), "text")
    return O.paragraph_groups(rows).select("doc", "ord", "paragraph")


@R.query("select avg(value) as mean, min_by(value, event_id) as first, avg(value) filter (event_id > 0) as rest from events")
def e_timings(spark, d):
    return M.timings(table(spark, d, "events").select(F.col("value").alias("seconds"), F.col("event_id").alias("ord")))


@R.query("select user_id::varchar as document, round(min(value), 3) as registration from events group by 1")
def e_registration(spark, d):
    return V.registrations(table(spark, d, "events").select(F.col("user_id").cast("string").alias("document"), F.col("value").alias("registration")))


@R.query(f"""with {READ}, s as (select document, row_id, count(*) filter (state = 'checked') as c from ful group by 1, 2), w as (select document, row_id, min(control_id) as win from ful where state = 'checked' group by 1, 2)
select document, control_id, case when rule = 'single' and c > 1 and state = 'checked' and control_id <> win then 'unchecked' else state end as state, (case when rule = 'single' and c > 1 and state = 'checked' then 0.5 else score end)::double as score from ful join s using (document, row_id) left join w using (document, row_id)""")
def n_shared_marks(spark, d):
    full = V.complete(_readings(spark, d), _controls(spark, d))
    win = full.where("state = 'checked'").groupBy("document", "row_id").agg(F.min("control_id").alias("control_id"))
    return V.shared_marks(full, win).select("document", "control_id", "state", "score")


@R.query(f"""with {READ} select document, max(case when row_id = 'click' then value end) as click_value, round(max(case when row_id = 'click' then certainty end)::double, 3) as click_certainty, any_value(m) as click_0_marked, any_value(z) as click_0_certainty
from ans join (select document, case state when 'checked' then true when 'unchecked' then false end as m, round(score::double, 3) as z from ful where control_id = 'click_0') using (document) group by 1""")
def j_checkbox_table(spark, d):
    full = V.complete(_readings(spark, d), _controls(spark, d))
    out = V.checkbox_table(full, V.answers(full), ["click", "view"], ["click_0", "click_1"])
    return out.select("document", "click_value", "click_certainty", "click_0_marked", "click_0_certainty")


@R.query(f"""with {READ}, r as (select row_id, rule, min(ord) as o, string_agg(label, ' / ' order by ord, label) as options from ctl group by 1, 2), n as (select *, row_number() over (order by o, row_id) as position from r)
select document, row_id, rule, options, '' as answer from (select distinct document from rd), n""")
def j_blank_sheet(spark, d):
    return V.blank_sheet(_readings(spark, d), _controls(spark, d)).drop("position")


@R.query("select option_id, case when count(distinct state) > 1 then 'ambiguous' else min(state) end as state, count(*) as votes from (select user_id as option_id, case when value < 90 then 'selected' else 'unselected' end as state from events) group by 1")
def o_merged_votes(spark, d):
    return L.merged_votes(table(spark, d, "events").select(F.col("user_id").alias("option_id"), F.when(F.col("value") < 90, "selected").otherwise("unselected").alias("state")))


@R.query("""with k as (select event_id, user_id as page, (event_id % 60) * 10.0e0 as x, (event_id % 40) * 10.0e0 as y from events),
s as (select p as page, k as section_id, (k % 2) * 300.0e0 as x1, (k // 2) * 200.0e0 as y1 from (select distinct user_id as p from events), (select unnest(range(4)) as k))
select page, event_id as control_id, min(section_id)::int as section_id from k join s using (page) where x between x1 and x1 + 320 and y between y1 and y1 + 210 group by 1, 2""")
def d_controls_in_sections(spark, d):
    e = table(spark, d, "events")
    x, y = (F.col("event_id") % 60) * 10.0, (F.col("event_id") % 40) * 10.0
    controls = e.select(F.col("user_id").alias("page"), F.col("event_id").alias("control_id"), F.array(x, y, x, y).alias("bbox"))
    k = F.explode(F.array(*map(F.lit, range(4))))
    s = e.select(F.col("user_id").alias("page")).distinct().select("page", k.alias("section_id"))
    x1, y1 = (F.col("section_id") % 2) * 300.0, F.floor(F.col("section_id") / 2) * 200.0
    return L.controls_in_sections(controls, s.withColumn("ord", F.col("section_id")).withColumn("box", F.array(x1, y1, x1 + 320, y1 + 210)))


@R.query("select (page_id % 7)::int as doc, count(*) as pages from pages group by 1")
def g_page_groups(spark, d):
    return table(spark, d, "pages").groupBy((F.col("page_id") % 7).cast("int").alias("doc")).agg(F.count("*").alias("pages"))


@R.query("""with p as (select doc_id % 50 as doc, text from documents) select doc, sum(length(trim(coalesce(text, '')))) < 200 as scanned,
bool_or(not (length(trim(coalesce(text, ''))) >= 20 and len(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')) >= 6)) as needs_ocr from p group by 1""".replace("\\\\", "\\"))
def c_scanned(spark, d):
    return L.scanned(table(spark, d, "documents").select((F.col("doc_id") % 50).alias("doc"), "text"), "doc", "text")


@R.query(f"""with {PAPERS}, a as (select k, string_agg(s::varchar, '; ' order by s) as authors, count(*) as n from aut group by 1)
select paper_id, 'Title ' || k as title, doi as "DOI", coalesce(n, 0)::int as n_authors, 3 as n_citations, 'Title ' || (k + 7) || '; title ' || (k + 11) || '; Outside work on ' || (k % 50) as cited_titles from nod left join a using (k)""")
def t_corpus_rows(spark, d):
    return K.corpus_rows(_papers(spark, d)).select("paper_id", "title", "DOI", "n_authors", "n_citations", "cited_titles")


@R.query("select event_id, printf('%02d:%02d:%06.3f', floor(v / 3600)::bigint, floor((v % 3600) / 60)::bigint, v % 60) as clock, v as seconds from (select event_id, round(value * 41, 2) as v from events)")
def i_clock(spark, d):
    v = F.round(F.col("value") * 41, 2)
    rows = table(spark, d, "events").select("event_id", v.alias("seconds"), C.clock(v).alias("clock"))
    return rows


@R.query("select event_type, user_id % 3 as g, count(*) as n from events group by cube (event_type, user_id % 3)")
def x_cube(spark, d):
    return table(spark, d, "events").withColumn("g", F.col("user_id") % 3).cube("event_type", "g").agg(F.count("*").alias("n"))


@R.query("select l_orderkey, l_linenumber, l_quantity from lineitem where l_quantity is not null and l_shipdate is not null")
def c_complete_rows(spark, d):
    rows = P.present(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", "absent"])
    return P.dropped_empty(rows).dropna(subset=["l_quantity", "l_shipdate"]).drop("l_shipdate")


@R.query("""with v as (select user_id as g, value as x from events), n as (select a.g as g, a.x as x, (select count(*) from v b where b.g = a.g and b.x between a.x - 2 and a.x + 2) as n from v a)
select g as "group", max(n) as n from n group by 1""")
def f_dominant_band(spark, d):
    return L.dominant_band(table(spark, d, "events").select(F.col("user_id").alias("group"), F.col("value")), 2.0).select("group", "n")


@R.query("""with s as (select user_id as g, value as low, nth_value(value, 3) over (partition by user_id order by value rows between current row and 2 following) as high from events)
select g as "group", low, high from (select *, row_number() over (partition by g order by high - low, low) as i from s where high is not null) where i = 1""")
def f_most_uniform(spark, d):
    return L.most_uniform(table(spark, d, "events").select(F.col("user_id").alias("group"), "value"), 3)


@R.query("""with r as (select event_type as document, user_id as page, value as centre from events group by 1, 2, 3) select document, page, centre, (lag(centre) over w + centre) / 2 as top, (lead(centre) over w + centre) / 2 as bottom from r window w as (partition by document, page order by centre)""")
def f_row_bands(spark, d):
    return L.row_bands(table(spark, d, "events").select(F.col("event_type").alias("document"), F.col("user_id").alias("page"), F.col("value").alias("centre")).distinct()).select("document", "page", "centre", "top", "bottom")


@R.query("""with g as (select event_type as text, event_id % 5 as body, min(event_id) as group_id from events group by 1, 2) select group_id, text, body from g""")
def h_pruned_groups(spark, d):
    g = table(spark, d, "events").select(F.col("event_id").alias("group_id"), F.col("event_type").alias("text"), (F.col("event_id") % 5).alias("body"), F.col("event_id").alias("ord"), F.lit(None).cast("long").alias("parent"))
    return L.pruned_groups(g).select("group_id", "text", "body")
