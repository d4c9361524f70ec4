"""Queries over derived marts: survey readings, graphs, transcripts, geometry, event windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import timecode as C
from ..operators import graph as K
from ..operators import layout as L
from ..operators import survey as V
from ..operators import transcript as N
from ..streaming import streams as Q
from .common import Registry, table

R = Registry()

# ------------------------------------------------------------------ survey
# Readings from events: a user is a document, the event type and an eighth of users' events a control.
READ = """rd as (select user_id::varchar as document, event_type || '_' || (event_id % 4) as control_id, 0 as page,
case when value < 20 then 'checked' when value < 22 then 'uncertain' else 'unchecked' end as state, round((event_id % 97) / 100.0e0, 2) as score from events),
facts as (select document, control_id, max(struct_pack(score := score, state := state)) as r from rd group by 1, 2),
ctl as (select distinct event_type || '_' || (event_id % 4) as control_id, 0 as page, event_type as row_id, case when event_type < 'm' then 'single' else 'multiple' end as rule, 'L' || (event_id % 4) as label, (event_id % 4)::int as ord from events),
ful as (select d.document, c.*, coalesce(r.state, 'uncertain') as state, coalesce(r.score, 0) as score from (select distinct document from rd) d cross join ctl c left join facts using (document, control_id)),
agg as (select document, row_id, rule, count(*) filter (state = 'checked') as c, count(*) filter (state = 'uncertain') as u, min(score) as low,
coalesce(string_agg(label, ';' order by label) filter (state = 'checked'), '') as labels from ful group by 1, 2, 3),
ans as (select document, row_id, rule, case when rule = 'single' and c > 1 then 'MULTIPLE' when u > 0 then 'UNCERTAIN' when rule = 'single' and c = 0 then '' else labels end as value,
case when rule = 'single' and (c > 1 or u > 0) then 0 else low end as certainty from agg)"""


def _readings(spark, d):
    e = table(spark, d, "events")
    k = F.col("event_id") % 4
    state = F.when(F.col("value") < 20, "checked").when(F.col("value") < 22, "uncertain").otherwise("unchecked")
    return e.select(F.col("user_id").cast("string").alias("document"), F.concat_ws("_", "event_type", k.cast("string")).alias("control_id"), F.lit(0).alias("page"), state.alias("state"),
                    F.round((F.col("event_id") % 97) / 100.0, 2).alias("score"))


def _controls(spark, d):
    k = F.col("event_id") % 4
    return table(spark, d, "events").select(
        F.concat_ws("_", "event_type", k.cast("string")).alias("control_id"), F.lit(0).alias("page"), F.col("event_type").alias("row_id"),
        F.when(F.col("event_type") < "m", "single").otherwise("multiple").alias("rule"), F.concat(F.lit("L"), k.cast("string")).alias("label"), k.cast("int").alias("ord")).distinct()


@R.query(f"with {READ} select document, control_id, row_id, label, rd.page as page, state, score from rd join ctl using (control_id)")
def j_survey_long(spark, d):
    return V.long_table(_readings(spark, d), _controls(spark, d))


@R.query(f"with {READ} select document, row_id, rule, value, certainty::double as certainty from ans")
def j_survey_answers(spark, d):
    return V.answers(V.complete(_readings(spark, d), _controls(spark, d)))


@R.query(f"with {READ}, o as (select document, control_id, state from facts join (select document, control_id, r.state as state from facts) using (document, control_id)) select document, max(case when control_id = 'click_0' then state end) as click_0, max(case when control_id = 'click_1' then state end) as click_1 from (select document, control_id, r.state as state from facts) where control_id in ('click_0', 'click_1') group by 1")
def j_survey_wide(spark, d):
    facts = _readings(spark, d).groupBy("document", "control_id").agg(F.max(F.struct("score", "state"))["state"].alias("state"))
    return V.wide_table(facts, _controls(spark, d), ["click_0", "click_1"])


@R.query(f"with {READ} select document, control_id, row_id, label, rd.page as page, state, score from rd join ctl using (control_id) where state = 'uncertain'")
def g_review_queue(spark, d):
    return V.review_queue(V.long_table(_readings(spark, d), _controls(spark, d)))


@R.query(f"with {READ}, m as (select distinct control_id from rd where state = 'checked' and score > 0.9) select control_id, page, row_id, label, row_id not in (select row_id from ctl where control_id in (select control_id from m)) as whole_row_unused from ctl where control_id not in (select control_id from m)")
def e_unused_controls(spark, d):
    return V.unused_controls(_readings(spark, d).withColumn("state", F.when(F.col("score") > 0.9, F.col("state")).otherwise("unchecked")), _controls(spark, d))


@R.query(f"with {READ} select count(distinct document) as documents, count(*) // count(distinct document) as controls_per_document, count(*) filter (state = 'checked') as checked, count(*) filter (state = 'uncertain') as uncertain, round(count(*) filter (state = 'uncertain') * 1.0e0 / count(*), 4) as uncertain_rate from rd")
def e_survey_summary(spark, d):
    return V.summary(_readings(spark, d))


@R.query(f"""with {READ}, m as (select row_id, count(distinct document) as answered_by from rd join ctl using (control_id) where state = 'checked' group by 1)
select row_id, rule, count(*) as options, coalesce(any_value(answered_by), 0) as answered_by, any_value(answered_by) is null as never_marked, string_agg(control_id, ',' order by ord, control_id) as control_ids from ctl left join m using (row_id) group by 1, 2""")
def e_survey_overview(spark, d):
    return V.overview(_readings(spark, d), _controls(spark, d))


@R.query(f"""with {READ}, sht as (select document, row_id, case when document::int % 5 = 0 then '?' else 'l' || (document::int % 4) end as answer from ans),
s as (select a.document as document, a.row_id as row_id, answer, value, certainty::double as certainty, value in ('MULTIPLE', 'UNCERTAIN') as flagged, answer = '?' as human_unsure from ans a join sht using (document, row_id))
select document, row_id, answer, value, certainty, flagged, human_unsure, (not flagged and answer <> '?' and lower(value) = answer) as correct from s""")
def j_score_sheet(spark, d):
    found = V.answers(V.complete(_readings(spark, d), _controls(spark, d)))
    n = F.col("document").cast("int")
    sheet = found.select("document", "row_id", F.when(n % 5 == 0, "?").otherwise(F.concat(F.lit("l"), (n % 4).cast("string"))).alias("answer"))
    options = _controls(spark, d).select("row_id", F.col("label").alias("option"))
    rows = V.scored(found, sheet, options)
    return rows.select("document", "row_id", "answer", "value", "certainty", "flagged", "human_unsure", "correct")


# ------------------------------------------------------------------ graph
# Papers from parts: suppliers are authors, brands categories, types topics; each cites parts 7 and 11 further on and one outside.
PAPERS = """nul as (select max(p_partkey) as top from part),
pap as (select p_partkey as k, 'P' || p_partkey as paper_id, case when p_partkey % 3 = 0 then '10.1/' || p_partkey else '' end as doi, p_brand as category, p_type as topic, (p_partkey % 10) / 10.0e0 as confidence from part),
nod as (select *, case when doi <> '' then 'doi:' || doi else paper_id end as node from pap),
aut as (select distinct l_partkey as k, l_suppkey as s from lineitem),
cit as (select a.k as k, a.node as src, coalesce(b.node, 'paper:' || substr(q.title, 1, 50)) as dst, b.node is null as outside from nod a, lateral (select unnest(['Title ' || (a.k + 7), 'title ' || (a.k + 11), 'Outside work on ' || (a.k % 50)]) as title) q left join nod b on lower('Title ' || b.k) = lower(q.title)),
tps as (select * from nod where confidence >= 0.3e0)"""


def _papers(spark, d):
    p, k = table(spark, d, "part"), F.col("p_partkey")
    authors = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").cast("string").alias("s")).distinct().groupBy("p_partkey").agg(F.collect_list("s").alias("authors"))
    cites = F.array(*[F.struct(F.concat(F.lit(t), n.cast("string")).alias("title"), F.lit("").alias("doi")) for t, n in (("Title ", k + 7), ("title ", k + 11), ("Outside work on ", k % 50))])
    topics = F.array(F.struct(F.col("p_brand").alias("category"), F.col("p_type").alias("label"), ((k % 10) / 10.0).alias("confidence")))
    return p.join(authors, "p_partkey", "left").select(
        F.concat(F.lit("P"), k.cast("string")).alias("paper_id"), F.concat(F.lit("Title "), k.cast("string")).alias("title"), F.when(k % 3 == 0, F.concat(F.lit("10.1/"), k.cast("string"))).otherwise("").alias("doi"),
        "authors", topics.alias("topics"), cites.alias("citations"), F.array().cast("array<string>").alias("cited_authors"), F.lit(3).alias("n_citations"))


EDGES = """edg as (select 'author:' || s as src, node as dst, 'authored' as label, 0 as o from aut join nod using (k) union all select node, 'category:' || category, 'in_category', 1 from tps
union all select 'topic:' || topic, node, 'topic_of', 2 from tps union all select 'topic:' || topic, 'category:' || category, 'belongs_to', 3 from tps union all select src, dst, 'cites', 4 from cit)"""


@R.query(f"with {PAPERS}, {EDGES} select src, dst, max_by(label, o) as label from edg group by 1, 2")
def k_graph_edges(spark, d):
    return K.edges(_papers(spark, d), 0.3)


@R.query(f"""with {PAPERS} select node as id, 'paper' as kind, 3::bigint as links, 1::bigint as papers, 24.0::double as size from nod
union all select 'author:' || s, 'author', count(*), count(*), 10.0 + 5 * count(*) from aut join nod using (k) group by s
union all select 'category:' || category, 'category', count(*), count(*), 20.0 + 4 * count(*) from tps group by category
union all select 'topic:' || topic, 'topic', count(*), count(*), 10.0 + 2 * count(*) from tps group by topic
union all select dst, 'cited_paper', count(*), count(distinct src), 10.0 from cit where outside group by dst""")
def k_graph_nodes(spark, d):
    return K.nodes(_papers(spark, d), 0.3)


@R.query(f"""with {PAPERS}, one as (select * from nod where k = 12) select node as src, 'author:' || s as dst, 'authored_by' as label from one join aut using (k) union select node, 'category:' || category, 'in_category' from one
union select node, 'topic:' || topic, 'has_topic' from one union select src, dst, 'cites' from cit where k = 12""")
def k_ego_graph(spark, d):
    return K.ego(_papers(spark, d), "P12")


@R.query(f"""with {PAPERS}, {EDGES}, e as (select distinct src, dst from edg) select (select count(*) from nod) + (select count(distinct s) from aut) + (select count(distinct category) from tps) + (select count(distinct topic) from tps) + (select count(distinct dst) from cit where outside) as nodes,
(select count(*) from nod) as papers, (select count(distinct s) from aut) as authors, (select count(*) from e) as edges""")
def e_graph_metrics(spark, d):
    p = _papers(spark, d)
    return K.metrics(K.nodes(p, 0.3), K.edges(p, 0.3))


# ------------------------------------------------------------------ transcripts
TURNS = """wds as (select conv_id as doc, turn, text, case when turn % 5 = 4 then null when turn % 3 = 0 then 'A' else role end as speaker, turn * 2.5e0 as s, turn * 2.5e0 + 2 as e from conversations),
chg as (select *, coalesce(speaker, 'UNKNOWN') as who, lag(coalesce(speaker, 'UNKNOWN')) over (partition by doc, turn // 4 order by turn) as bef from wds),
isl as (select *, turn // 4 as segment, sum(case when bef is null or bef <> who then 1 else 0 end) over (partition by doc, turn // 4 order by turn) as island from chg)"""


def _words(spark, d):
    t = F.col("turn")
    c = table(spark, d, "conversations")
    who = F.when(t % 5 == 4, F.lit(None).cast("string")).when(t % 3 == 0, "A").otherwise(F.col("role"))
    return c.select(F.col("conv_id").alias("doc"), F.expr("turn div 4").alias("segment"), t.alias("ord"), F.col("text").alias("word"), who.alias("speaker"), (t * 2.5).alias("start"), (t * 2.5 + 2).alias("end"))


@R.query(f"""with {TURNS} select doc, segment, island as turn, any_value(who) as speaker, min(s) as start, max(e) as "end", trim(string_agg(text, ' ' order by turn)) as text,
row_number() over (partition by doc order by segment, island) as segment_id from isl group by doc, segment, island""")
def f_speaker_turns(spark, d):
    return N.speaker_turns(_words(spark, d))


@R.query(f"""with {TURNS}, g as (select *, dense_rank() over (partition by doc order by segment, island) as segment_id from isl)
select doc, segment, turn as ord, who as speaker, segment_id, row_number() over (partition by doc, segment_id order by turn) as word_id from g""")
def f_numbered_words(spark, d):
    return N.numbered_words(_words(spark, d)).select("doc", "segment", "ord", "speaker", "segment_id", "word_id")


@R.query("""with e as (select user_id, epoch_us(ts) / 1e6 as s, epoch_us(ts) / 1e6 + 600 as e from events), g as (select *, s - lag(e) over (partition by user_id order by s, e) as gap from e),
r as (select *, sum(case when gap is null or gap >= 21600 then 1 else 0 end) over (partition by user_id order by s, e) as run from g)
select user_id, run, min(s) as start, max_by(e, s) as "end", count(*) as n from r group by 1, 2""")
def f_merged_speech(spark, d):
    s = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return N.merged_speech(table(spark, d, "events").select("user_id", s.alias("s"), (s + 600).alias("e")), "user_id", "s", "e", 21600)


@R.query("""select event_id, printf('%02d:%02d:%02d,%03d', floor(v / 3600)::bigint, floor((v % 3600) / 60)::bigint, (floor(v)::bigint % 60), floor((v - floor(v)) * 1000)::bigint) as srt,
case when v >= 3600 then printf('%dh %dm', (round_even(v, 0)::bigint // 3600), (round_even(v, 0)::bigint % 3600) // 60) when round_even(v, 0) >= 60 then printf('%dm %ds', round_even(v, 0)::bigint // 60, round_even(v, 0)::bigint % 60) else printf('%ds', round_even(v, 0)::bigint) end as duration
from (select event_id, value * 37 as v from events)""".replace("case when v >= 3600", "case when round_even(v, 0) >= 3600"))
def i_stamps(spark, d):
    v = F.col("value") * 37
    return table(spark, d, "events").select("event_id", C.stamp(v).alias("srt"), C.duration(v).alias("duration"))


@R.query(f"""with {TURNS}, n as (select *, row_number() over (partition by doc order by s, turn) as n from wds where trim(text) <> '')
select doc, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', (s // 3600)::bigint, ((s % 3600) // 60)::bigint, floor(s)::bigint % 60, floor((s - floor(s)) * 1000)::bigint) || ' --> '
|| printf('%02d:%02d:%02d,%03d', (e // 3600)::bigint, ((e % 3600) // 60)::bigint, floor(e)::bigint % 60, floor((e - floor(e)) * 1000)::bigint) || chr(10) || trim(text) || chr(10) || chr(10), '' order by n) as text from n group by 1""")
def b_srt(spark, d):
    return N.srt(_words(spark, d).withColumnRenamed("word", "text"))


@R.query()
def b_vtt(spark, d):
    return N.vtt(_words(spark, d).withColumnRenamed("word", "text"))


@R.query(f"""with {TURNS}, w as (select doc, turn as ord, s + 1.2e0 as s, e + 1.2e0 as e from wds), t as (select doc, s, e, coalesce(speaker, '?') as who from wds)
select doc, ord, max_by(who, struct_pack(o := least(w.e, t.e) - greatest(w.s, t.s), n := -t.s)) as speaker from w join t using (doc) where w.s < t.e and w.e > t.s group by 1, 2""")
def d_assigned_speakers(spark, d):
    w = _words(spark, d)
    words = w.select("doc", "ord", (F.col("start") + 1.2).alias("start"), (F.col("end") + 1.2).alias("end"))
    turns = w.select("doc", "start", "end", F.coalesce("speaker", F.lit("?")).alias("speaker"))
    return N.assigned_speakers(words, turns).where("speaker is not null").select("doc", "ord", "speaker")


# ------------------------------------------------------------------ geometry
BOX = "[(o % 7) * 10.0e0, (o % 5) * 8.0e0, (o % 7) * 10.0e0 + 30, (o % 5) * 8.0e0 + 20]"


@R.query("""with m as (select event_id, value / 500.0e0 as fill, (event_id % 10) / 100.0e0 as halo, (event_id % 50) / 100.0e0 as strike from events)
select event_id, case when fill >= 0.08e0 then 'checked' when fill <= 0.025e0 and halo >= 0.05e0 then 'uncertain' when fill <= 0.025e0 then 'unchecked' else 'uncertain' end as residual,
case when fill >= 0.18e0 or strike >= 0.45e0 then 'checked' when fill <= 0.045e0 and strike < 0.30e0 then 'unchecked' else 'uncertain' end as geometric from m""")
def n_mark_states(spark, d):
    e = table(spark, d, "events")
    fill, halo, strike = F.col("value") / 500.0, (F.col("event_id") % 10) / 100.0, (F.col("event_id") % 50) / 100.0
    return e.select("event_id", G.residual_state(fill, halo)["state"].alias("residual"), G.geometric_state(fill, strike)["state"].alias("geometric"))


@R.query("""with w as (select event_id, event_id % 20 as page, (event_id % 100)::double as x, (event_id % 77)::double as y from events), r as (select page, k as region_id, k as ord, (k % 3) * 30.0e0 as x1, (k // 3) * 25.0e0 as y1 from (select unnest(range(20)) as page), (select unnest(range(9)) as k))
select page, event_id as word_id, min(region_id)::int as region_id from w join r using (page) where x between x1 - 1 and x1 + 36 and y between y1 - 1 and y1 + 31 group by 1, 2""")
def d_words_in_regions(spark, d):
    e = F.col("event_id")
    x, y = (e % 100).cast("double"), (e % 77).cast("double")
    words = table(spark, d, "events").select(e.alias("word_id"), (e % 20).alias("page"), F.array(x, y, x, y).alias("bbox"))
    regions = spark.range(180).select((F.col("id") % 20).alias("page"), F.floor(F.col("id") / 20).cast("int").alias("region_id"))
    x1, y1 = (F.col("region_id") % 3) * 30.0, F.floor(F.col("region_id") / 3) * 25.0
    regions = regions.withColumn("reading_order", F.col("region_id")).withColumn("box", F.array(x1, y1, x1 + 35, y1 + 30))
    return L.words_in_regions(words, regions)


# ------------------------------------------------------------------ event windows (the streaming operators, over closed windows)
@R.query("""select date_trunc('day', ts) as start, date_trunc('day', ts) + interval 1 day as "end", event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2, 3""")
def q_tumbling(spark, d):
    out = Q.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.query("""with w as (select *, unnest([date_trunc('day', ts), date_trunc('day', ts) - interval 12 hour, date_trunc('day', ts) + interval 12 hour]) as start from events)
select start, start + interval 1 day as "end", event_type, count(*) as n, round(sum(value), 4) as total from w where ts >= start and ts < start + interval 1 day group by 1, 2, 3""")
def q_sliding(spark, d):
    out = Q.tumbling(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day", "12 hours")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start", "end")})


@R.query("""with g as (select *, ts - lag(ts) over (partition by user_id order by ts) as gap from events), r as (select *, sum(case when gap is null or gap >= interval 6 hour then 1 else 0 end) over (partition by user_id order by ts) as run from g)
select user_id, min(ts) as first, max(ts) as last, count(*) as n from r group by user_id, run""")
def q_sessions(spark, d):
    out = Q.sessions(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("first", "last")})
