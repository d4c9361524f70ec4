"""What the findings of round 3 named, each on a small table."""

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_density import plain_clusters

from lexiforge.functions import text as X
from lexiforge.functions import udfs as U
from lexiforge.operators import density
from lexiforge.operators import harvest as H
from lexiforge.operators import layout as L
from lexiforge.operators import lineage
from lexiforge.operators import sections as Q
from lexiforge.operators import topics as T
from lexiforge.plans import corpus, pages


def test_dominant_band_ends_are_doubles(spark):
    # 2.69 + 2 is 4.6899..., so 4.69 lies just beyond; rows without a value are none's neighbours.
    v = spark.createDataFrame([("g", x) for x in (0.69, 2.69, 4.69, None, None, None)], "group string, value double")
    assert L.dominant_band(v, 2.0).first().asDict() == {"group": "g", "centre": 0.69, "n": 2}


def test_sentences_keep_leading_digits(spark):
    # The second sentence's position is 1, the third's 2: no reason to trim these digits.
    t = spark.createDataFrame([("A. 11 b 1. 2 c.",), ("no end\n",)], "t string")
    assert [r[0] for r in t.select(X.sentences(F.col("t"))).collect()] == [["A.", "11 b 1.", "2 c."], ["no end"]]


def test_shield_round_trip_keeps_the_texts_own_spans(spark, tmp_path):
    texts = ["pay $x_1$ or %d to me@a.org\n```\n$code$\n```\n/usr/lib/x [a b](u \"t\") \\$5 and $6", "", None, "a/b //c/d %s/usr/lib $$y$$ http://x.y/z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    df = corpus.p_shield_round_trip(spark, str(tmp_path))
    got = {r.doc_id: (r.kept.split("\x01")[16:], r.same, r.filled) for r in df.collect()}
    assert got == {0: (["$x_1$", "%d", "me@a.org", "```\n$code$\n```", "/usr/lib/x", '](u "t")'], True, True), 1: ([], True, False), 2: ([], True, False),
                   3: (["%s", "$$y$$", "http://x.y/z"], True, True)}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert {r[0]: (r[1].split("\x01")[16:], r[2], r[3]) for r in con.sql(corpus.R.oracle["p_shield_round_trip"]).fetchall()} == got


def test_schema_hints_read_each_region_once(spark):
    shape = "page int, section string, region_id string, ord int, type string, html string, text string"
    html = "<table><tr><td></td><td>Good</td><td>A &amp; B</td></tr><tr><td>One</td><td>○</td><td>●</td></tr><tr><td>Two</td><td>○</td><td>○</td></tr></table>"
    regions = spark.createDataFrame([(1, "s", "t", 0, "table", html, None), (1, "s", "p", 1, "text", None, "x ○ y")], shape)
    df = Q.schema_hints(regions, spark.createDataFrame([(1, "s", "Which?")], "page int, section string, anchor string"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("<tr") == 1 and plan.count("Join") == 1
    r = df.first()
    assert (r.structure_region_id, [(x.label, [(o.label, o.state) for o in x.options]) for x in r.rows]) == (
        "t", [("One", [("Good", "unchecked"), ("A & B", "checked")]), ("Two", [("Good", "unchecked"), ("A & B", "unchecked")])])


def test_tasks_grow_in_number_with_the_rows(spark, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_ROWS", 100)
    t = spark.range(1000).selectExpr("id % 300 as k", "id")
    assert lineage.spread(t, "k").rdd.getNumPartitions() == 10 and lineage.spread(t.limit(5), "k").rdd.getNumPartitions() == 4
    assert sorted(r.id for r in lineage.spread(t, "k").collect()) == list(range(1000))
    control = pages.g_control_order(spark, "/root/testdata/sf0.001")
    assert "REPARTITION_BY_NUM, " in control._jdf.queryExecution().executedPlan().toString()


def test_layouts_go_to_the_pages(spark):
    shape = "form string, document string, turn int, page int, width int, height int"
    jobs = spark.createDataFrame([("f", f"d{k}", k, 1, 100, 100, "g", [0, 0, 10 * k, 10], True) for k in (1, 2, 3)], shape + ", group_id string, bbox array<int>, valid boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = Q.reused_layout(Q.learned_layout(jobs), jobs.select("form", "document", "turn", "page", "width", "height"))
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert [(r.document, r.bbox) for r in out.orderBy("turn").collect()] == [("d2", [0, 0, 10, 10]), ("d3", [0, 0, 10, 10])]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_phrases_read_texts_once(spark):
    docs = spark.createDataFrame([("new york " * 6 + "and",), ("Lone",), ("the new the and",), (None,)], "text string")
    df = T.phrases(docs, least=2, threshold=0.0)
    assert {(r.a, r.b, r.n, round(r.score, 6)) for r in df.collect()} == {("new", "york", 6, round(4 * 5 / 42, 6)), ("york", "new", 5, round(3 * 5 / 42, 6))}
    assert "regexp_extract_all" not in df._jdf.queryExecution().optimizedPlan().toString()  # counts are a written table


def test_terms_of_two_columns_in_one_pass(spark):
    docs = spark.createDataFrame([("en", "x", "red blue red"), ("en", None, "blue"), (None, "x", "green red"), ("de", "y", None)], "lang string, source string, text string")
    for by, counts in zip(("lang", "source"), T.term_counts_of(docs, "lang", "source")):
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, T.term_counts(docs, by).collect()))
        assert "regexp_extract_all" not in counts._jdf.queryExecution().optimizedPlan().toString()


def test_density_tree_in_chunks_of_links(spark, monkeypatch):
    # Parts far from one another, near one another and within one another: the tree is high, and its links are merged in ten chunks, not in rounds.
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal((30.0 * (k // 2), 3.0 * (k % 2)), 0.2 + 0.1 * k, (12, 2)) for k in range(8)]).round(3)
    monkeypatch.setattr(density, "BLOCK", 10)
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.cluster, r.strength) for r in density.density_clusters(df, 4, links=len(x) - 1).collect()}
    want = plain_clusters(x, 4)
    assert len({c for c, _ in want.values()}) > 4
    assert {i: v[0] for i, v in got.items()} == {i: want.get(i, (-1,))[0] for i in range(len(x))}
    assert all(abs(got[i][1] - s) <= 1e-9 * s for i, (_, s) in want.items())


def test_best_of_a_high_tree_in_few_rounds(spark, monkeypatch):
    rounds, cut = [], density.cut
    monkeypatch.setattr(density, "cut", lambda df: rounds.append(1) or cut(df))
    # A chain of 40 nodes, each of the next one and a leaf: own 1.5 below 30, 1000 from there on.
    tree = [(f"n{i}", 1000.0 if i >= 30 else 1.5, f"n{i + 1}", f"l{i}") for i in range(40)] + [(f"l{i}", 1.0, None, None) for i in range(40)] + [("n40", 2.0, None, None)]
    got = {r.node: r.best for r in density._best(spark.createDataFrame(tree, "node string, own double, l string, r string")).collect()}
    want = {f"l{i}": 1.0 for i in range(40)} | {"n40": 2.0}
    for i in reversed(range(40)):
        want[f"n{i}"] = max(1000.0 if i >= 30 else 1.5, want[f"n{i + 1}"] + 1.0)
    assert got == want and len(rounds) <= 8


def test_shielding_is_tried_in_one_worker(spark, tmp_path):
    texts = ["pay $x_1$ to me@a.org", "", None, "[a b](http://x.y/z) %d"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    for query in (corpus.p_shield_texts, corpus.p_shield_round_trip):
        df = query(spark, str(tmp_path))
        assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1
    assert sorted(map(tuple, corpus.p_shield_texts(spark, str(tmp_path)).collect())) == [(i, True, 0) for i in range(4)]
    both = spark.read.parquet(f"{tmp_path}/documents.parquet").select(U.mask("text").alias("m"), U.tried_mask("text").alias("n"), "text").collect()
    assert all((r.m.masked, r.m.kept) == (r.n.masked, r.n.kept) and r.n.same == (None if r.text is None else True) for r in both)


def test_boxes_read_each_value_once(spark):
    jsons = ['{"a": [[0, 0], [4, 0], [4, 3], [0, 3]], "b": [1, 2, 3, 4], "c": [1, null, 3, 4], "d": "[1, 2, 3, 4]", "e": {"f": [[1, 2], [3]]}}', "[]", "5", '{"x": "]]]]"}', None]
    found = H.nodes(spark.createDataFrame(list(enumerate(jsons)), "id int, j string"), "id", "j")
    df = H.boxes(found)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("try_variant_get") == 2 and "schema_of_variant" not in plan
    assert [(r.id, r.ord, r.bbox) for r in df.orderBy("id", "ord").collect()] == [(0, 0, [0.0, 0.0, 4.0, 3.0]), (0, 1, [1.0, 2.0, 3.0, 4.0])]


def test_lda_counts_words_without_keeping_texts(spark, monkeypatch):
    from pyspark.ml.feature import CountVectorizer

    fit, seen = CountVectorizer.fit, []

    def watched(self, rows):
        model = fit(self, rows)
        seen.append((self.getMaxDF(), set(model.vocabulary)))
        return model

    monkeypatch.setattr(CountVectorizer, "fit", watched)
    # Of 21 texts: "all" is in 20 (over 90 %), "most" in 18, "lone" in one.
    texts = ["all " + "most " * (k < 18) + f"pair{k % 7} " + "lone " * (k == 0) for k in range(20)] + [None]
    keywords, found, _ = T.lda(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), 2, iterations=2)
    # A share (below 1) makes CountVectorizer keep all words of all texts to count the texts.
    assert seen == [(0.9 * 21, {"most", *(f"pair{k}" for k in range(7))})]
    assert "most" in keywords.where("topic = 1").first()["keywords"] and {r.topic for r in keywords.collect()} == {1, 2}
    assert len(keywords._jdf.queryExecution().optimizedPlan().toString()) < 500  # the vocabulary is no literal of the plan
    assert {r.doc_id: r.dominant_topic is None for r in found.collect()} == {k: k == 20 for k in range(21)}


def test_packing_encodes_short_runs(monkeypatch):
    import pyarrow as pa

    from lexiforge.llm import packing

    sizes = []

    class Fake:
        def encode(self, texts):
            sizes.append(sum(map(len, texts)))
            return [np.arange(len(t) // 1000, dtype=np.uint32) for t in texts]

    monkeypatch.setattr(packing, "coder", lambda path: Fake())
    b = pa.RecordBatch.from_arrays([pa.array(range(40), pa.int64()), pa.array(["x" * 50_000] * 38 + [None, "y" * 600_000])], names=["i", "t"])
    out = next(packing._cut("p", 1, 2048)([b]))
    assert out.column(0).to_pylist() == list(range(40)) and out.column(4).to_pylist() == [51] * 38 + [1, 601]
    assert sum(sizes) == 2_500_000 and sorted(sizes)[-2] <= 1 << 18  # a run of several texts, or one longer text
