"""Queries over small texts, boxes and files whose parts are known from how they are made, so that SQL needs no pattern."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions import timecode as C
from ..operators import forms as V
from ..operators import reduction as N
from ..sources import files as S
from .common import Registry, table

R = Registry()


def _pick(column, *values):
    return F.array(*[F.lit(v) if isinstance(v, str) else v for v in values])[(column % len(values)).cast("int")]


@R.query("""with l as (select l_orderkey, l_linenumber, l_partkey % 1500 as n, l_partkey % 4 as k, l_suppkey % 3 as t from lineitem) select l_orderkey, l_linenumber, n, case when n < 1000 and k < 3 then n end as number,
case when n < 1000 and k < 3 then [')', '.', ':'][k + 1] end as mark, n < 1000 and (k in (0, 2) or (k = 1 and t > 0)) as anchor, case t when 0 then '' when 1 then 'unchecked,checked' else 'checked' end as states, case t when 0 then null when 1 then null else 'checked' end as state from l""")
def i_question_lines(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 1500).alias("n"),
                                              F.concat(F.lit("  "), F.col("l_partkey") % 1500, _pick(F.col("l_partkey"), ")", ".", ":", " -"), F.lit(" Item "), _pick(F.col("l_suppkey"), "", "☐ yes ☒ no", "✓ one")).alias("t"))
    q = X.question_number(F.col("t"))
    return rows.select("l_orderkey", "l_linenumber", "n", q["number"].alias("number"), q["mark"].alias("mark"), X.is_anchor(F.col("t"), F.lit(False)).alias("anchor"),
                       F.array_join(F.transform(X.mark_glyphs(F.col("t")), lambda m: m["state"]), ",").alias("states"), X.mark_state(F.col("t"))["state"].alias("state"))


@R.query("""select event_id, case event_id % 5 when 0 then 'Item ' || user_id when 1 then 'Box ' || user_id when 2 then 'Old name' when 3 then array_to_string(list_transform(range(10), lambda i: 'label' || user_id % 7), ' ') else '' end as label,
['1', '2,5', user_id::varchar] as numbers, event_id % 3 = 0 as binary, 'Which ' || user_id || '?' as question, (event_id % 90 + 1)::int as page, 99 as pages from events""")
def i_labels(spark, d):
    e = table(spark, d, "events")
    words = F.array_join(F.array_repeat(F.concat(F.lit("label"), (F.col("user_id") % 7).cast("string")), 14), "  ")
    label = _pick(F.col("event_id"), F.concat(F.lit("☐ ☒ Item "), "user_id"), F.concat(F.lit("O Box\n"), "user_id"), F.lit(" 0 Old  name "), words, F.lit(" ○ "))
    choice = F.when(F.col("event_id") % 3 == 0, "Ja, gern / Nein").otherwise("Janein only")
    return e.select("event_id", X.clean_label(label).alias("label"), X.scale_tokens(F.concat(F.lit("from 1 to 2,5 of "), "user_id")).alias("numbers"), X.is_binary(choice).alias("binary"),
                    X.question_text(F.concat(F.lit(" Which "), "user_id", F.lit("? ☐ a ☒ b"))).alias("question"), X.page_of(F.concat(F.lit("Page "), F.col("event_id") % 90 + 1, F.lit(" / 99")))["page"].alias("page"),
                    X.page_of(F.lit("7/99"))["pages"].alias("pages"))


@R.query("""select event_id, ['fence', 'heading', 'rule', 'quote', 'list', 'list', 'table', 'blank', 'text', 'text'][event_id % 10 + 1] as kind from events""")
def i_markdown_kinds(spark, d):
    n = F.col("user_id").cast("string")
    made = [F.concat(F.lit("  ```"), n), F.concat(F.lit(" ## "), n), F.lit("- - -"), F.concat(F.lit(" > "), n), F.concat(F.lit("* "), n), F.concat(n, F.lit(") x")), F.concat(F.lit("| "), n), F.lit("  \t"), F.concat(F.lit("#"), n), F.concat(n, F.lit(" - x"))]
    return table(spark, d, "events").select("event_id", X.markdown_kind(_pick(F.col("event_id"), *made)).alias("kind"))


@R.query("""select event_id, case event_id % 4 when 0 then event_id when 1 then event_id % 3600 when 2 then event_id / 8.0 else 0.0 end::double as seconds, (event_id % 36000 + 16000.0 * (user_id % 50) / 16000) as shifted, '20' || lpad((user_id % 100)::varchar, 2, '0') as year from events""")
def i_seconds(spark, d):
    n = F.col("event_id")
    two = lambda v: F.format_string("%02d", v.cast("int"))
    stamp = _pick(n, F.concat_ws(":", F.floor(n / 3600).cast("string"), two(F.floor(n % 3600 / 60)), two(n % 60)), F.concat_ws(":", two(F.floor(n % 3600 / 60)), two(n % 60)), (n / F.lit(8.0)).cast("string"), F.lit("1:2:3:4"))
    return table(spark, d, "events").select("event_id", C.seconds_of(stamp).alias("seconds"), C.shifted((n % 36000).cast("double"), 16000 * (F.col("user_id") % 50)).alias("shifted"),
                                            C.year_of(F.concat(F.lit("20"), two(F.col("user_id") % 100), F.lit("-01-02"))).alias("year"))


@R.query("""with b as (select event_id, (user_id % 30)::double as x, (event_id % 20)::double as y, (event_id % 7)::double as s from events), i as (select *, greatest(0, least(x + 10, 25) - greatest(x, 5)) * greatest(0, least(y + 8, 20) - greatest(y, 4)) as shared from b)
select event_id, [x, y, x + 10, y + 8] as box, round(shared / (80 + 320 - shared), 9) as iou, round(shared / 80, 9) as covered, case when s = floor(s) then s end as tidy, case when s / 6 >= 0.8 then 'high' when s / 6 >= 0.6 then 'medium' else 'low' end as badge,
[greatest(0, x::int - 12), greatest(0, y::int - 12), least(40, x::int + 22), least(30, y::int + 20)] as crop, [x * 2, y * 2] as scaled from i""")
def i_boxes(spark, d):
    x, y, s = (F.col("user_id") % 30).cast("double"), (F.col("event_id") % 20).cast("double"), (F.col("event_id") % 7).cast("double")
    box = G.box(F.array(x + 10, y, x, y, x, y + 8, x + 10, y + 8))
    other = F.array(*[F.lit(v) for v in (5.0, 4.0, 25.0, 20.0)])
    return table(spark, d, "events").select("event_id", box.alias("box"), F.round(G.iou(box, other), 9).alias("iou"), F.round(G.covered(box, other), 9).alias("covered"), G.tidy(s).alias("tidy"), G.badge(s / 6).alias("badge"),
                                            V.crop(F.array(box), F.lit(40), F.lit(30)).alias("crop"), G.scaled(F.array(x, y), F.lit(2.0)).alias("scaled"))


@R.query("""select conv_id, turn, 'Dr. X$1: hello, ' || turn || ' from Eve and SPEAKER_011' as text, ['SPEAKER_01', 'SPEAKER_011', 'SPEAKER_02'] as speakers from conversations""")
def i_speakers(spark, d):
    text = F.concat(F.lit("SPEAKER_01: hello, "), "turn", F.lit(" from speaker_02 and SPEAKER_011"))
    all_ = F.concat(F.lit("SPEAKER_02 SPEAKER_011 XSPEAKER_03 SPEAKER_01 "), F.upper(F.lit("speaker_02")))
    return table(spark, d, "conversations").select("conv_id", "turn", X.renamed_speakers(text, {"SPEAKER_01": "Dr. X$1", "SPEAKER_02": "Eve"}).alias("text"), X.speakers(all_).alias("speakers"))


@R.query("""select event_id, event_id % 4 in (1, 2) as translatable, case event_id % 3 when 0 then 'General' else event_type end as category, case event_id % 4 when 0 then 1.0 when 1 then 0.0 when 2 then 0.5 else 0.25 end as confidence, 1 as topics,
event_id % 4 = 3 as leaks, event_id % 4 in (1, 2) as resolved from events""")
def i_replies(spark, d):
    e, n = table(spark, d, "events"), F.col("event_id")
    cell = _pick(n, "=SUM(A1)", "words 1", "é", " 12,5 ")
    topic = lambda label: F.struct(_pick(n, " ", F.col("event_type"), F.concat(F.lit(" "), "event_type")).alias("category"), label.alias("label"), _pick(n, "7", "-1", "x", "0.25").alias("confidence"), F.lit(None).cast("string").alias("rationale"))
    topics = X.clean_topics(F.array(topic(F.lit("  ")), topic(F.lit(" a "))))
    label = _pick(n, " ☐ n/a ", "Good", "☒ x", "none', '")
    return e.select("event_id", X.translatable(cell).alias("translatable"), topics[0]["category"].alias("category"), topics[0]["confidence"].alias("confidence"), F.size(topics).alias("topics"),
                    V.leaks(_pick(n, "Good", "x", "y", "a', 'choice_text")).alias("leaks"), V.resolved(F.when(n % 4 == 3, "None").otherwise(label)).alias("resolved"))


def _scratch(spark) -> str:
    """A new folder that all executors share: below the checkpoint folder, or a local one where the master is local."""
    sc = spark.sparkContext
    at = sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="lexiforge-")
    path = f"{at.rstrip('/')}/lexiforge-scan-{uuid.uuid4().hex}"
    atexit.register(_gone, spark, path)
    return path


def _gone(spark, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session is gone; its folder goes with it
        pass


@R.query("""select doc_id, lang, source, n_chars, nullif('He said "hi", ' || doc_id || chr(10) || coalesce(text, ''), '') as text from documents""")
def a_delimited(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars", F.concat(F.lit('He said "hi", '), "doc_id", F.lit("\n"), F.coalesce("text", F.lit(""))).alias("text"))
    path = _scratch(spark)
    docs.write.option("header", True).option("quote", '"').option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)  # as they are; nothing for null, quotes for empty
    return S.read_delimited(spark, path)


@R.query("select conv_id, turn, role, text from conversations")
def a_json_documents(spark, d):
    """One pretty document for each file, next to files of JSON lines."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role", "text")
    path = _scratch(spark)
    rows.where("turn % 2 = 0").write.json(f"{path}/lines")
    whole = rows.where("turn % 2 = 1").groupBy((F.hash("conv_id") % 4).alias("part")).agg(F.to_json(F.collect_list(F.struct(*rows.columns)), {"pretty": "true"}).alias("value"))  # four files
    whole.repartition(4, "part").select("part", "value").write.partitionBy("part").text(f"{path}/whole")
    return S.read_json(spark, f"{path}/lines").select(*rows.columns).unionByName(S.read_json(spark, f"{path}/whole").select(*rows.columns))


@R.query("select vec_id, round(list_sum(list_transform(embedding, lambda x: x::double * x::double)), 4) as energy from embeddings")
def l_full_rotation(spark, d):
    """As many directions as dimensions keep every vector's length."""
    vectors = table(spark, d, "embeddings").select("vec_id", "embedding")
    out = N.reduced(vectors, vectors.select(F.max(F.size("embedding"))).first()[0] or 1)
    return out.select("vec_id", F.round(F.aggregate("reduced", F.lit(0.0), lambda a, v: a + v * v), 4).alias("energy"))
