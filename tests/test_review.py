"""Review views and lookups on blank, null, unknown and empty input."""

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import review as V

OPTIONS = "array<struct<label string, state string>>"


def _answers(spark, rows):
    df = spark.createDataFrame([(rows,)], f"rows array<struct<label string, options {OPTIONS}>>")
    return df.select(V.answer_summary(F.col("rows")), V.shared_options(F.lit("matrix"), F.lit(None).cast("string"), F.col("rows"))).first()


def test_labels(spark):
    df = spark.createDataFrame([([("yes", "selected"), (None, "x"), ("yes", "x"), (" ", None)],), ([],), (None,)], f"o {OPTIONS}")
    assert [r[0] for r in df.select(V.option_labels(F.col("o"))).collect()] == [["yes [1]", "option 2", "yes [3]", "option 4"], [], None]


def test_answers(spark):
    both = [("a", [("y", "selected"), ("n", None)]), ("", [("y", "x"), ("n", "x")])]
    assert tuple(_answers(spark, both)) == ("a: y; — no answer —", True)
    assert tuple(_answers(spark, [("a", [("y", "selected"), ("n", "selected")])])) == ("a: y | n", False)
    assert tuple(_answers(spark, [])) == ("— extraction failed —", False)
    assert tuple(_answers(spark, None)) == ("— extraction failed —", False)


def test_contracts(spark):
    df = spark.createDataFrame([(None,), ("",), (" Paddle ",)], "v string")
    assert [r[0] for r in df.select(V.contract_name(F.col("v"))).collect()] == ["schema-free-v2", "schema-free-v2", "paddle-id-v1"]
    with pytest.raises(Exception, match="unknown survey contract"):
        spark.createDataFrame([("other",)], "v string").select(V.contract_name(F.col("v"))).collect()


def test_gate_without_model_or_warnings(spark):
    df = spark.createDataFrame([("a", "accepted", None, None), ("b", "accepted", ["w"], "good")], "g string, status string, warnings array<string>, model string")
    got = {r.g: (r.status, r.warnings) for r in V.gated(df, F.col("model"), ["good"]).collect()}
    assert got == {"a": ("needs_review", ["model has not passed the release benchmark"]), "b": ("accepted", ["w"])}


def test_cited_dois_last_wins(spark):
    papers = spark.createDataFrame([("p", [("T", "1"), (" T", None), (None, "9"), ("U", "2")]), ("q", None), ("r", [])], "paper_id string, citations array<struct<title string, doi string>>")
    assert {tuple(r) for r in V.cited_dois(papers).collect()} == {("p", "T", ""), ("p", "U", "2")}


def test_choices_and_pairs(spark):
    papers = spark.createDataFrame([("a", 1), ("b", 1), (None, 1)], "paper_id string, doc int")
    choices = spark.createDataFrame([("a", False), ("b", None)], "paper_id string, chosen boolean")
    assert sorted(str(r.paper_id) for r in V.chosen(papers, choices).collect()) == ["None", "b"]
    assert V.chosen(papers.limit(0), choices).count() == 0
    left = spark.createDataFrame([(1, 5), (1, 3), (1, 9)], "doc int, x int")
    right = spark.createDataFrame([(1, 20), (1, 10)], "doc int, y int")
    assert sorted((r.x, r.y) for r in V.paired(left, right, "doc", "x", "y").collect()) == [(3, 10), (5, 20)]


def test_provenance_and_codes(spark):
    df = spark.createDataFrame([({"text_layer": ["a", "b"], "some_Key": ["c"], "none": []},), (None,)], "p map<string, array<string>>")
    got = [r[0] for r in df.select(V.provenance_lines(F.col("p"))).collect()]
    assert sorted(got[0].split("\n")) == ["Searchable-PDF word geometry: a, b", "Some key: c"] and got[1] == ""
    one = spark.range(1).select(V.two_letters(F.lit("swh_Latn")), V.with_script(F.lit("sw")), V.with_script(F.lit("xx"))).first()
    assert tuple(one) == ("sw", "swh_Latn", None)


def test_prose_skips_blank(spark):
    rows = spark.createDataFrame([(1, 1, 2, "b", "text", "two"), (1, 1, 1, "a", "title", "one"), (1, 1, 3, "c", "text", " "), (1, 2, 1, "d", "table", "no"), (1, 2, 2, "e", "list", None)],
                                 "document int, page int, reading_order int, region_id string, type string, content string")
    assert [tuple(r) for r in V.prose(rows, "document").collect()] == [(1, "one two")]
    assert V.prose(rows.limit(0), "document").count() == 0
