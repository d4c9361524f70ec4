"""Rows that share an id: equal texts are one document, different texts are documents of their own."""

import random

from lexiforge.llm import line_dedup, span_dedup
from lexiforge.llm.common import told_apart


def table(spark, rows):
    return spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, extra int").repartition(3)


def test_keys(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (2, "c"), (2, None), (3, None), (3, ""), (None, "x"), (None, "y")]
    got = {}
    for r in told_apart(table(spark, rows), "doc_id", "text", "k").collect():
        got.setdefault((r.doc_id, r.text or ""), set()).add(r.k)
    assert all(len(v) == 1 for v in got.values())
    keys = {p: v.pop() for p, v in got.items()}
    assert keys[1, "a"] == 1 and keys[3, ""] == 3 and keys[None, "x"] is None
    of_two = [keys[2, t] for t in ("b", "c", "")]
    assert 2 in of_two and len(set(of_two)) == 3 and sorted(of_two)[1] > 3


def test_lines_of_several_texts_stay(spark):
    common = "a line that stands in every one of the texts"
    rows = [(1, common), (2, f"{common}\nthe second text has this line alone"), (2, f"a quite different first line, unique\n{common}\nanother line that is not repeated"), (2, "a quite different first line, unique\n" + common + "\nanother line that is not repeated"),
            (3, "something else entirely stands here"), (None, common)]
    out = line_dedup.dedup_lines(table(spark, rows)).collect()
    text = {r.extra: r.text for r in out}
    assert text[0] == common and text[5] == common and text[4] == rows[4][1]
    assert text[1] == "the second text has this line alone"
    assert text[2] == text[3] == "a quite different first line, unique\nanother line that is not repeated"


def test_passages_of_several_texts_stay(spark):
    rng = random.Random(6)
    prose = lambda n: " ".join(" ".join(rng.choice("abcdefghij") * rng.randrange(2, 7) for _ in range(9)) + "." for _ in range(n // 9))
    shared, unique = prose(90), prose(90)
    rows = [(1, shared), (2, shared), (2, unique), (2, unique), (4, prose(90))]
    out = {r.extra: r for r in span_dedup.dedup_spans(table(spark, rows), passage=span_dedup.PASSAGE).collect()}
    assert out[0].text == shared and out[1].text.strip() == ""
    assert out[2].text == out[3].text == unique and out[2].n_removed == 0 and out[4].text == rows[4][1]
    assert out[0].n_units > 0


def test_empty(spark):
    assert line_dedup.dedup_lines(table(spark, [])).count() == 0 and span_dedup.dedup_spans(table(spark, [])).count() == 0
