"""Operators on small tables: survey resolution, scoring, layout, graphs, statistics, sources, streams."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import graph as K
from lexiforge.operators import layout as L
from lexiforge.operators import profile as P
from lexiforge.operators import stats as S
from lexiforge.operators import survey as V
from lexiforge.operators import topics as T
from lexiforge.operators import transcript as N
from lexiforge.sources import files, sinks
from lexiforge.streaming import streams


@pytest.fixture
def controls(spark):
    rows = [(f"c{r}{k}", 0, f"r{r}", "single" if r < 3 else "multiple", f"o{k}", 10 * r + k) for r in range(4) for k in range(3)]
    return spark.createDataFrame(rows, "control_id string, page int, row_id string, rule string, label string, ord int")


def readings(spark, rows):
    return spark.createDataFrame([(d, c, 0, s, 0.1 if s == "uncertain" else 1.0) for d, c, s in rows], "document string, control_id string, page int, state string, score double")


def test_answers(spark, controls):
    states = {"c00": "checked", "c10": "checked", "c11": "checked", "c20": "uncertain", "c30": "checked", "c32": "checked"}
    rd = readings(spark, [("d", f"c{r}{k}", states.get(f"c{r}{k}", "unchecked")) for r in range(4) for k in range(3)])
    got = {r.row_id: (r.value, r.certainty) for r in V.answers(V.complete(rd, controls)).collect()}
    assert got == {"r0": ("o0", 1.0), "r1": ("MULTIPLE", 0.0), "r2": ("UNCERTAIN", 0.0), "r3": ("o0;o2", 1.0)}
    failed = readings(spark, [("d", "c00", "registration_failed")])
    assert {r.value for r in V.answers(V.complete(failed, controls)).collect()} == {"UNCERTAIN"}
    unused = {r.control_id: r.whole_row_unused for r in V.unused_controls(rd, controls).collect()}
    assert unused["c20"] is True and unused["c01"] is False and "c00" not in unused
    wide = V.checkbox_table(V.complete(rd, controls), V.answers(V.complete(rd, controls)), ["r0"], ["c00", "c20"]).first()
    assert wide["r0_value"] == "o0" and wide["c00_marked"] is True and wide["c20_marked"] is None
    win = spark.createDataFrame([("d", "r1", "c11")], "document string, row_id string, control_id string")
    fixed = {r.control_id: (r.state, r.score) for r in V.shared_marks(V.complete(rd, controls), win).collect()}
    assert fixed["c10"] == ("unchecked", 0.5) and fixed["c11"] == ("checked", 0.5)


def test_scoring(spark):
    found = spark.createDataFrame([("d", "a", "Ja Falls ja, E-Mail", 1.0), ("d", "b", "MULTIPLE", 0.0), ("d", "c", "x", 0.9), ("d", "e", "x", 0.4)], "document string, row_id string, value string, certainty double")
    sheet = spark.createDataFrame([("d", "a", "ja falls JA"), ("d", "b", "x"), ("d", "c", "?"), ("d", "e", "y"), ("z", "a", "x")], "document string, row_id string, answer string")
    options = spark.createDataFrame([("a", "Ja Falls ja, E-Mail"), ("a", "Nein"), ("b", "x"), ("c", "x"), ("e", "x"), ("e", "y")], "row_id string, option string")
    rows = {r.row_id: r for r in V.scored(found, sheet, options).collect()}
    assert rows["a"].correct and rows["b"].flagged and not rows["b"].correct and rows["c"].human_unsure and not rows["e"].correct and len(rows) == 4
    s = V.score_summary(V.scored(found, sheet, options)).first()
    assert (s.scored, s.flagged, s.auto_accepted, s.silent_errors, s.accuracy, s.max_certainty) == (3, 1, 2, 1, 0.5, 0.4)


def test_names(spark, controls):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "name string, ord int")
    assert sorted(r.name for r in V.unique_names(df, "name", "ord").collect()) == ["a", "a (2)", "b"]
    same = controls.withColumn("label", F.lit("x"))
    assert {r.label for r in V.disambiguated(same).where("row_id = 'r0'").collect()} == {"option 1", "option 2", "option 3"}
    assert V.blank_sheet(spark.createDataFrame([("d",)], "document string"), controls).count() == 4
    assert V.without_controls(controls, controls.limit(2)).count() == 10


def test_layout(spark):
    page = {"page_number": 1, "parsing_res_list": [
        {"block_label": "doc_title", "block_content": "T", "block_bbox": [0, 0, 50, 10], "block_order": 0}, {"block_label": "Odd", "block_content": "x", "block_bbox": [0, 20, 50, 30], "block_order": 1}],
        "layout_det_res": [{"label": "t", "score": 0.9, "coordinate": [0, 0, 50, 9]}, {"label": "u", "score": 0.5, "coordinate": [40, 20, 90, 30]}]}
    schema = "page_number int, parsing_res_list array<struct<block_label string, block_content string, block_bbox array<double>, block_order int>>, layout_det_res array<struct<label string, score double, coordinate array<double>>>"
    df = spark.createDataFrame([(json.dumps(page),)], "j string").select(F.from_json("j", schema).alias("p")).select("p.*")
    rows = {r.region_id: r for r in L.regions_of(df).collect()}
    assert (rows["p1_r001"].type, rows["p1_r001"].score, rows["p1_r002"].type, rows["p1_r002"].score) == ("title", 0.9, "other", None)
    box = "page int, region_id string, type string, reading_order int, box array<double>, content string"
    regions = spark.createDataFrame([(1, "a", "text", 0, [0.0, 0.0, 50.0, 10.0], "A"), (1, "b", "checkbox", 1, [0.0, 20.0, 10.0, 30.0], "☐"), (1, "c", "text", 2, [0.0, 60.0, 50.0, 70.0], "C")], box)
    groups = spark.createDataFrame([(1, "g", [0.0, 15.0, 60.0, 40.0]), (1, "h", [100.0, 12.0, 110.0, 14.0])], "page int, group_id string, box array<double>")
    assert [r.item for r in L.page_stream(regions, groups).orderBy("position").collect()] == ["a", "h", "g", "c"]
    words = spark.createDataFrame([(1, 1, [1.0, 1.0, 5.0, 5.0]), (1, 2, [80.0, 80.0, 90.0, 90.0])], "page int, word_id int, bbox array<double>")
    assert [(r.word_id, r.region_id) for r in L.words_in_regions(words, regions).collect()] == [(1, "a")]
    assert L.markdown(regions.drop("x")).first()["text"].startswith("A")
    near = L.nearest_labels(spark.createDataFrame([(1, "k", [0.0, 0.0, 10.0, 10.0])], "page int, control_id string, bbox array<double>"),
                            spark.createDataFrame([(1, 0, [30.0, 0.0, 40.0, 9.0], "far"), (1, 1, [12.0, 1.0, 20.0, 9.0], "near"), (1, 2, [12.0, 90.0, 20.0, 99.0], "off")], "page int, ord int, box array<double>, text string"), 50)
    assert near.first()["label"] == "near"


def test_answer_groups(spark):
    # Four rows of five circles, then five boxes below each other.
    rows = [(0, "q1", "circle", f"c{r}{k}", r * 5 + k, [k * 60.0, r * 60.0, k * 60.0 + 34, r * 60.0 + 34]) for r in range(4) for k in range(5)]
    rows += [(0, "q2", "box", f"b{r}", 50 + r, [0.0, 500.0 + r * 60, 34.0, 534.0 + r * 60]) for r in range(5)]
    out = L.answer_groups(spark.createDataFrame(rows, "page int, question_id string, shape string, control_id string, ord int, bbox array<double>"))
    got = {r.row_id: (r.n, r.rule) for r in out.groupBy("row_id", "rule").agg(F.count("*").alias("n")).collect()}
    assert got == {**{f"q1_r0{k}": (5, "single") for k in (1, 2, 3, 4)}, "q2_r01": (5, "multiple")}


def test_answer_groups_of_several_documents(spark):
    rows = [(doc, 1, "q", "box", f"k{k}", k, [0.0, k * 60.0, 34.0, k * 60.0 + 34]) for doc in ("a", "b") for k in range(3)]
    df = spark.createDataFrame(rows, "document string, page int, question_id string, shape string, control_id string, ord int, bbox array<double>")
    got = {(r.document, r.row_id): r.n for r in L.answer_groups(df).groupBy("document", "row_id").agg(F.count("*").alias("n")).collect()}
    assert got == {("a", "q_r01"): 3, ("b", "q_r01"): 3}
    bands = L.row_bands(spark.createDataFrame([("a", 1, 0.0), ("a", 1, 10.0), ("b", 1, 4.0)], "document string, page int, centre double"))
    assert sorted((r.document, r.centre, r.top, r.bottom) for r in bands.collect()) == [("a", 0.0, None, 5.0), ("a", 10.0, 5.0, None), ("b", 4.0, None, None)]


def test_sequences(spark):
    m = spark.createDataFrame([("c", float(y)) for y in (0, 10, 20, 40, 50)], "column string, y double")
    assert [(r.column, r.y) for r in L.recovered_gap(m).collect()] == [("c", 30.0)]
    v = spark.createDataFrame([("g", x) for x in (1.0, 5.0, 5.5, 6.0, 20.0)], "group string, value double")
    assert L.most_uniform(v, 3).first().asDict() == {"group": "g", "low": 5.0, "high": 6.0}
    assert L.dominant_band(v, 0.6).first()["centre"] == 5.5
    seen = spark.createDataFrame([("d", "k", "b", 1), ("d", "k", "a", 2), ("d", "k", "b", 3)], "doc string, key string, value string, ord int")
    assert L.first_seen(seen, ["doc", "key"], "value", "ord").first()["values"] == ["b", "a"]
    items = spark.createDataFrame([("x", 0, "checked"), ("x", 1, "unchecked"), ("y", 0, "checked")], "r string, position int, state string")
    marks = spark.createDataFrame([("x", 0, "unchecked"), ("x", 1, "uncertain"), ("y", 0, "checked"), ("y", 1, "checked")], "r string, position int, state string")
    got = {(r.r, r.position): r.status for r in L.reconciled(items, marks, "r").collect()}
    assert got == {("x", 0): "needs_review", ("x", 1): "observed", ("y", None): "count_mismatch"}


def test_graph(spark):
    schema = "paper_id string, title string, doi string, authors array<string>, topics array<struct<category string, label string, confidence double>>, citations array<struct<title string, doi string>>, cited_authors array<string>, n_citations int"
    papers = spark.createDataFrame([
        ("p1", "One", "10.1/AB", ["A", "A"], [("C", "t", 0.9)], [("two ", ""), ("Else", "")], ["X"], 2), ("p2", " Two", "", ["A"], [("C", "u", 0.1)], None, None, 0), ("p3", None, None, None, None, None, None, None)], schema)
    e = {(r.src, r.dst, r.label) for r in K.edges(papers, 0.3).collect()}
    assert ("doi:10.1/ab", "p2", "cites") in e and ("doi:10.1/ab", "paper:Else", "cites") in e and ("author:A", "p2", "authored") in e and not any("topic:u" in x for x in e)
    n = {r.id: (r.links, r.papers, r.size) for r in K.nodes(papers, 0.3).collect()}
    assert n["author:A"] == (3, 2, 25.0) and n["doi:10.1/ab"][2] == 21.0 and "p3" in n
    assert K.ego(papers, "p1").where("src = 'doi:10.1/AB'").count() == 6
    xml = "<TEI xmlns='x'><teiHeader><fileDesc><titleStmt><title>My title</title></titleStmt><sourceDesc><biblStruct><analytic><author><persName><forename>A</forename><surname>B</surname></persName></author><idno type='DOI'>10.2/x</idno></analytic></biblStruct></sourceDesc></fileDesc></teiHeader></TEI>"
    r = K.tei_metadata(spark.createDataFrame([(xml,)], "xml string")).first()
    assert (r.title, r.authors, r.doi, r.abstract) == ("My title", ["A B"], "10.2/x", "")


def test_statistics(spark):
    df = spark.createDataFrame([(1.0, 2.0, "a"), (2.0, 4.1, "a"), (3.0, 5.9, "b"), (4.0, 8.2, "b"), (None, 1.0, "b"), (5.0, 9.9, None)], "x double, y double, g string")
    assert S.correlation(df, "x", "y", "kendall").first()["r"] == 1.0 and abs(S.correlation(df, "x", "y", "spearman").first()["r"] - 1) < 1e-12
    assert S.correlation(df.limit(2), "x", "y").first()["r"] is None
    assert {r.g for r in S.bars(df, "x", ["g"]).collect()} == {"a", "b"}
    w = S.welch(df, "x", "g", "a", "b").first()
    assert 0 < S.t_p_value(spark, w.t, w.df) < 1
    a = S.anova(df, "x", "g").first()
    assert abs(a.f - w.t**2) < 1e-9 and 0 < S.f_p_value(spark, a.f, a.k - 1, a.n - a.k) < 1
    with pytest.raises(ValueError, match="two values"):
        S.encoded_target(df.withColumn("g", F.col("x").cast("string")), "g")
    assert {r["g"] for r in S.encoded_target(df, "g").collect()} == {0, 1, None}
    assert P.matching_columns(df, ["x", "y"]) == ["x", "y"]
    with pytest.raises(ValueError):
        P.matching_columns(df, ["x"])
    assert P.capped(df, 3)[1] and P.capped(df, 3)[0].count() == 3
    assert P.with_text(df, "g").count() == 5


def test_topics(spark):
    with pytest.raises(ValueError):
        T.lda(spark.createDataFrame([(1, "a")], "doc_id int, text string"), 2)
    msgs = spark.createDataFrame([("Cannot use scipy.linalg.eigh with k >= N",), ("disk full",), (None,)], "m string")
    assert [r[0] for r in msgs.select(T.is_small_corpus_error(F.col("m"))).collect()] == [True, False, False]


def test_transcripts(spark):
    words = spark.createDataFrame([("d", 0, 0, "Hi", "A", 0.0, 1.0), ("d", 0, 1, "there", "A", 1.0, 2.0), ("d", 0, 2, "yes", None, 2.0, 3.0), ("d", 1, 3, "ok", None, 3.0, 4.0)], "doc string, segment int, ord int, word string, speaker string, start double, end double")
    t = [(r.segment_id, r.speaker, r.text, r.end) for r in N.speaker_turns(words).orderBy("segment_id").collect()]
    assert t == [(1, "A", "Hi there", 2.0), (2, "UNKNOWN", "yes", 3.0), (3, "UNKNOWN", "ok", 4.0)]
    assert [(r.segment_id, r.word_id) for r in N.numbered_words(words).orderBy("ord").collect()] == [(1, 1), (1, 2), (2, 1), (3, 1)]
    v = spark.createDataFrame([("d", 0.0, 1.0), ("d", 1.4, 5.0), ("d", 5.5, 6.0)], "doc string, s double, e double")
    assert [(r.start, r.end) for r in N.merged_speech(v, "doc", "s", "e", 0.5).orderBy("start").collect()] == [(0.0, 5.0), (5.5, 6.0)]
    assert "1\t00:00:00.000\t00:00:02.000\tA\tHi there" in N.tsv(N.speaker_turns(words)).first()["text"]
    assert N.vtt(words.withColumnRenamed("word", "text")).first()["text"].startswith("WEBVTT\n\n00:00:00.000 --> 00:00:01.000\nHi")


def test_sources(spark, tmp_path):
    (tmp_path / "l.csv").write_bytes("a,b\n1,Zürich\n".encode("latin-1"))
    assert files.read_delimited(spark, str(tmp_path / "l.csv")).first()["b"] == "Zürich"
    (tmp_path / "d.json").write_text('[\n{"a": 1},\n{"a": 2}\n]')
    assert files.read_json(spark, str(tmp_path / "d.json")).count() == 2
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("x/a.txt", "hello")
        z.writestr("._b.txt", "no")
        z.writestr("c.txt", "  ")
        z.writestr("d.pdf", "no")
    (tmp_path / "ok.zip").write_bytes(b.getvalue())
    bad = io.BytesIO()
    with zipfile.ZipFile(bad, "w") as z:
        z.writestr("../a.txt", "hello")
    (tmp_path / "bad.zip").write_bytes(bad.getvalue())
    got = {r.archive.rsplit("/", 1)[-1]: r for r in files.read_archives(spark, str(tmp_path / "*.zip")).collect()}
    assert got["ok.zip"].Text == "hello" and "leaves" in got["bad.zip"].error
    (tmp_path / "t.tsv").write_text("segment_id\tStart\tEnd\tTEXT\n1\t0:01\t0:02\thi\n")
    assert files.read_transcripts(spark, str(tmp_path / "t.tsv")).first().asDict() == {"segment_id": 1, "start": 1.0, "end": 2.0, "text": "hi"}
    assert files.merged_config({"a": {"x": 1, "l": [1]}}, {"a": {"l": [2]}, "b": 3}) == {"a": {"x": 1, "l": [2]}, "b": 3}
    df = spark.createDataFrame([("=1", 2)], "`=h` string, n int")
    assert sinks.spreadsheet_safe(df).first().asDict() == {"'=h": "'=1", "n": 2}
    sinks.replace_parquet(df, str(tmp_path / "p"))
    sinks.replace_parquet(df.union(df), str(tmp_path / "p"), str(tmp_path / "old"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2 and spark.read.parquet(str(tmp_path / "old")).count() == 1
    assert "truncated" in files.table_markdown(spark.range(5), 3)


def test_streaming(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    src = tmp_path / "src"
    events.repartition(3).write.parquet(str(src))
    run = lambda: streams.incremental(spark, str(src), events.schema, str(tmp_path / "out"), str(tmp_path / "ck")).count()
    n = events.count()
    assert run() == n and run() == n  # nothing is taken twice
    q = streams.tumbling(streams.event_stream(spark, str(src), events.schema)).writeStream.outputMode("append").format("memory").queryName("tumbling").trigger(availableNow=True).start()
    q.awaitTermination()
    batch = streams.tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")))
    closed = spark.sql("select * from tumbling")
    assert closed.count() > 0 and closed.exceptAll(batch).count() == 0
