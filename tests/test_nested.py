"""Nested results, schema hints, evidence and learnt layouts on small cases."""

import json

import pytest
from pyspark.sql import functions as F

from lexiforge.operators import harvest as H
from lexiforge.operators import sections as Q


def walk(value, keys=(), place=()):
    """Every node below a parsed value; members of objects by name."""
    items = [(k.lower(), value[k]) for k in sorted(value)] if isinstance(value, dict) else [(None, v) for v in value] if isinstance(value, list) else []
    for i, (k, v) in enumerate(items):
        yield [*keys, k], [*place, i]
        yield from walk(v, (*keys, k), (*place, i))


VALUES = [{"res": {"rec_texts": [" a ", "", 3, {"Text": 'deep [x] "{" '}], "rec_polys": [[[1, 2], [3, 2], [3, 5], [1, 5]], [[10, 20], [30, 5]]], "rec_boxes": [[4, 3, 2, 1]], "scores": [0.1, 0.2]}},
          [{"TEXT": 'up"} ', "k": {"dt_polys": [[0, 0, 5, 0, 5, 6, 0, 6]]}}, {"texts": "one"}], "bare", 5, [], {"a": None, "text": None, "texts": [True, None]}, [[[[[[[{"text": "down"}]]]]]]]]


def test_nodes(spark):
    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(VALUES)] + [(90, "not json"), (91, None)], "d int, j string")
    found = H.nodes(df, "d", "j")
    assert sorted((r.id, r.place, r["keys"]) for r in found.collect()) == sorted((i, p, k) for i, v in enumerate(VALUES) for k, p in walk(v))
    got = {}
    for r in H.texts(found).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append(r.text)
    assert got == {0: ["a", "3", 'deep [x] "{"'], 1: ['up"}', "one"], 5: ["true"], 6: ["down"]}
    boxes = [(r.id, r.ord, r.bbox) for r in H.boxes(found).orderBy("id", "ord").collect()]
    assert boxes == [(0, 0, [2.0, 1.0, 4.0, 3.0]), (0, 1, [1.0, 2.0, 3.0, 5.0]), (0, 2, [10.0, 5.0, 30.0, 20.0]), (1, 0, [0.0, 0.0, 5.0, 6.0])]


def test_nodes_of_nothing(spark):
    for rows in ([], [(1, None)], [(1, '"x"')]):
        assert H.nodes(spark.createDataFrame(rows, "d int, j string"), "d", "j").count() == 0


def test_aliases(spark):
    block = {"res": {"parsing_res_list": [{"block_label": "", "label": "t", "content": "c", "bbox": [1, 2, 3, 4], "score": 0.5}, {"label": "q", "block_content": "z", "content": "no", "block_bbox": [[1, 2]], "block_order": 2}, 5],
                     "layout_det_res": {"boxes": [{"label": "l", "coordinate": [5, 6, 1, 2], "cls_id": 3}]}}}
    df = spark.createDataFrame([(1, json.dumps(block)), (2, json.dumps({"layout_det_res": [{"label": "m", "bbox": [1, 2, 3]}]})), (3, "[]"), (4, None)], "d int, j string")
    assert [tuple(r) for r in H.blocks(df, "d", "j").orderBy("ord").collect()] == [(1, 0, "t", "c", [1.0, 2.0, 3.0, 4.0], None, 0.5), (1, 1, "q", "z", [], 2, None)]
    assert [tuple(r) for r in H.layout_boxes(df, "d", "j").orderBy("id").collect()] == [(1, 0, "l", None, [1.0, 2.0, 5.0, 6.0], 3), (2, 0, "m", None, [], None)]


def grid(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "</table>"


SHAPE = "page int, section string, region_id string, ord int, type string, html string, text string"


def hints(spark, regions, anchor="7) Who benefits? ✗ Population"):
    df = spark.createDataFrame([(1, "s", *r) for r in regions], SHAPE)
    return Q.schema_hints(df, spark.createDataFrame([(1, "s", anchor)], "page int, section string, anchor string")).first()


def test_matrix_owns_the_structure(spark):
    r = hints(spark, [("q7", 0, "text", None, "7) Who benefits? ✗ Population has disadvantages"), ("matrix", 1, "table", grid(["", "Good", "Bad"], ["First", "○", "○"], ["Second", "●", "○"]), None)])
    assert (r.question_text, r.structure_region_id, r.structure_source) == ("7) Who benefits?", "matrix", Q.TABLE_SOURCE)
    assert [(x.row_id, x.label, [(o.option_id, o.label, o.state) for o in x.options]) for x in r.rows] == [
        ("matrix_r1", "First", [("matrix_r1_o1", "Good", "unchecked"), ("matrix_r1_o2", "Bad", "unchecked")]), ("matrix_r2", "Second", [("matrix_r2_o1", "Good", "checked"), ("matrix_r2_o2", "Bad", "unchecked")])]


def test_header_is_the_last_that_fits(spark):
    table = grid(["x", "Old", "Names"], ["a", "○", "○"], ["", "New", "Labels"], ["short"], ["b", "○", "○"], ["○ lone", "c"], ["d", "", "○", "○"])
    r = hints(spark, [("t", 0, "table", table, None)])
    assert [(x.label, [o.label for o in x.options]) for x in r.rows] == [("a", ["Old", "Names"]), ("b", ["New", "Labels"]), ("d", ["option 1", "option 2"])]
    assert r.structure_region_id == ""


def test_two_reliable_tables_own_nothing(spark):
    t = grid(["", "Good", "Bad"], ["First", "○", "○"], ["Second", "○", "○"])
    r = hints(spark, [("a", 0, "table", t, None), ("b", 1, "table", t, None), ("p", 2, "text", None, "Yes ○ | ○ no, ● ")])
    assert r.structure_source == "" and [x.row_id for x in r.rows] == ["a_r1", "a_r2", "b_r1", "b_r2", "p"]
    assert (r.rows[4].label, [o.label for o in r.rows[4].options]) == ("Yes", ["option 1", "no", "option 3"])


def test_section_without_regions(spark):
    r = hints(spark, [("p", 0, "text", None, None)], None)
    assert (r.question_text, r.rows, r.structure_region_id) == ("", [], "")


@pytest.mark.parametrize("regions,marks,want", [
    ([("a", "table", grid(["Price", "100"]), None)], 1, []), ([("a", "text", None, "Ja     Nein")], 9, ["paddle-binary-options"]), ([("a", "text", None, "Female Male No answer")], 2, ["aligned-geometric-mark-pattern"]),
    ([("a", "text", None, "x \\boxtimes y"), ("b", "checkbox", None, "☐")], 0, ["paddle-mark-glyph", "paddle-mark-notation", "paddle-checkbox-region"]), ([("a", "text", None, None)], None, [])])
def test_evidence(spark, regions, marks, want):
    df = spark.createDataFrame([(1, "s", i, k, t, h, x, marks) for k, (i, t, h, x) in enumerate(regions)], SHAPE + ", marks int")
    assert [e.reason for e in Q.evidence(df, F.col("marks")).first().evidence] == want


def test_layout_is_learnt_once(spark):
    rows = [("f", "d1", 1, 1, 100, 100, "g", [0, 0, 10, 10], False), ("f", "d2", 2, 1, 100, 200, "g", [-5, 20, 105, 101], True), ("f", "d3", 3, 1, 100, 100, "other", [1, 1, 2, 2], True), ("f", "d2", 2, 2, 0, 10, "g", [1, 1, 2, 2], True)]
    jobs = spark.createDataFrame(rows, "form string, document string, turn int, page int, width int, height int, group_id string, bbox array<int>, valid boolean")
    layout = Q.learned_layout(jobs)
    assert [(r.page, r.learned_turn, r.group_id, r.share) for r in layout.collect()] == [(1, 2, "g", [-0.05, 0.1, 1.05, 0.505])]
    pages = spark.createDataFrame([("f", f"d{k}", k, p, 50, 1001) for k in (1, 2, 3, 4) for p in (1, 2)], "form string, document string, turn int, page int, width int, height int")
    got = [(r.document, r.page, r.bbox, r.template_reused) for r in Q.reused_layout(layout, pages).orderBy("document").collect()]
    assert got == [("d3", 1, [0, 100, 50, 506], True), ("d4", 1, [0, 100, 50, 506], True)]
