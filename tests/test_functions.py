"""Column functions and UDF helpers on literals."""

import pytest
from pyspark.sql import functions as F

from lexiforge.functions import geometry as G
from lexiforge.functions import text as X
from lexiforge.functions import timecode as C
from lexiforge.functions import udfs as U


def of(spark, f, value, kind="string"):
    v = spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first()["x"]
    return v.asDict(True) if hasattr(v, "asDict") else v


@pytest.mark.parametrize(("f", "value", "want"), [
    (X.tokens, "Der große Hund, 1234 und ab", ["der", "große", "hund", "und"]),
    (X.tokens, None, []),
    (X.without_controls, "a\x00b\x1fc\td\ne\r", "abc\td\ne\r"),
    (X.comma_list, " A, ,b ,", ["a", "b"]),
    (X.layer_tokens, "☐ yes ☒no — 4", ["yes", "no", "4"]),
    (X.latin1, "“a”–b… €", '"a"-b...'),
    (X.html_plain, "<p>a &amp;lt; b</p><script>'</p>'</script>  c&nbsp;", "a &lt; b c"),
    (X.html_rows, "<table><tr><th>A</th><th>B</th></tr><tr><td>1</td><td><b>2</b></td></tr></table>", [["A", "B"], ["1", "2"]]),
    (X.slug, "a b/ü?c.txt", "a_b_c.txt"),
    (X.base_name, "x\\y/z.txt", "z.txt"),
    (X.clean_label, "☐ O Ja,  gerne", "Ja, gerne"),
    (X.sentences, "A b. C? D! e.f g。 h", ["A b.", "C?", "D!", "e.f g。", "h"]),
    (X.line_parts, "a\n\nb\n", ["a", "\n\n", "b", "\n"]),
    (X.word_count, None, 0), (X.word_count, " a  b\n", 2), (X.token_estimate, "", 1), (X.token_estimate, "x" * 9, 2),
    (X.question_number, " 12) Wie?", {"number": 12, "mark": ")"}), (X.question_number, "x 12)", None),
    (X.mark_state, "[x] a", {"state": "checked", "score": 0.9}), (X.mark_state, "[ ]", {"state": "unchecked", "score": 0.9}),
    (X.mark_state, "☐ a ☒ b", None), (X.mark_state, "☒", {"state": "checked", "score": 0.8}), (X.mark_state, None, None),
    (X.question_text, "Alter ☐ 1 ☐ 2", "Alter"), (X.is_binary, "Rauchen Sie? Ja ☐ Nein ☐", True), (X.is_binary, "yesterday none", False),
    (X.scale_tokens, "1 2,5 - 3.0", ["1", "2,5", "3.0"]), (X.json_object, '```json\n{"a": 1}\n```', '{"a": 1}'), (X.json_object, 'so: {"a": 1} ok', '{"a": 1}'), (X.json_object, "none", None),
    (X.page_of, "Seite 3 / 12", {"page": 3, "pages": 12}), (X.page_of, "x", None), (X.is_corrupt, "ðX; YÞ", False), (X.is_corrupt, "a\x02", True), (X.is_corrupt, "", False),
    (X.is_corrupt, "", True), (X.is_corrupt, "�", True), (X.is_corrupt, None, False), (X.formula_safe, "=1+1", "'=1+1"), (X.formula_safe, "a=1", "a=1"),
    (X.speakers, "SPEAKER_10: a SPEAKER_1: b SPEAKER_10", ["SPEAKER_1", "SPEAKER_10"]), (X.markdown_kind, "## x", "heading"), (X.markdown_kind, "- x", "list"), (X.markdown_kind, "---", "rule"), (X.markdown_kind, "x", "text"),
    (C.seconds_of, "1:02:03.5", 3723.5), (C.seconds_of, "2:03", 123.0), (C.seconds_of, "bad", 0.0), (C.seconds_of, None, 0.0), (C.seconds_of, "7.5", 7.5),
])
def test_text(spark, f, value, want):
    assert of(spark, f, value) == want


def test_renamed_and_rewritten(spark):
    assert of(spark, lambda c: X.renamed_speakers(c, {"SPEAKER_1": "Ann", "SPEAKER_10": "Bo$"}), "SPEAKER_10: x speaker_1: y") == "Bo$: x Ann: y"
    assert of(spark, lambda c: X.rewritten_marks(c, F.array(F.lit("checked"), F.lit("unchecked"))), "☐ a ☐ b") == "☒ a ☐ b"
    assert of(spark, lambda c: X.rewritten_marks(c, F.array(F.lit("checked"))), "☐ a ☐ b") == "☐ a ☐ b"
    assert [m["state"] for m in of(spark, X.mark_glyphs, "☒a☐")] == ["checked", "unchecked"]


@pytest.mark.parametrize(("f", "value", "want"), [
    (C.clock, 3661.5, "01:01:01.500"), (C.stamp, 1.9999, "00:00:01,999"), (C.duration, 3720.0, "1h 2m"), (C.duration, 62.5, "1m 2s"), (C.duration, 3.0, "3s"), (G.badge, 0.8, "high"), (G.badge, 1.7, "high"), (G.badge, 0.1, "low"), (G.tidy, 2.346, 2.35), (G.tidy, 3.0, 3.0),
])
def test_numbers(spark, f, value, want):
    assert of(spark, f, value, "double") == want


def test_boxes(spark):
    one = spark.range(1)
    a = F.array(*map(F.lit, (0.0, 0.0, 10.0, 10.0)))
    b = F.array(*map(F.lit, (5.0, 5.0, 15.0, 15.0)))
    r = one.select(G.iou(a, b).alias("iou"), G.covered(a, b).alias("cov"), G.box(F.array(*map(F.lit, (3.0, 1.0, 9.0, 1.0, 9.0, 7.0, 3.0, 7.0)))).alias("box"), G.box(F.array(F.lit(1.0))).alias("none"),
                   G.residual_state(F.lit(0.3), F.lit(0.0)).alias("r1"), G.residual_state(F.lit(0.01), F.lit(0.06)).alias("r2"), G.geometric_state(F.lit(0.01), F.lit(0.5)).alias("g1"), G.residual_state(F.lit(None).cast("double"), F.lit(0.0)).alias("r0"),
                   G.is_figure(a, F.lit(None).cast("int"), F.lit(3)).alias("fig"), G.is_figure(a, F.lit(2), F.lit(30)).alias("tiny")).first()
    assert abs(r.iou - 25 / 175) < 1e-12 and r.cov == 0.25 and r.box == [3.0, 1.0, 9.0, 7.0] and r.none == []
    assert (r.r1.state, r.r2.state, r.r2.score, r.g1.state, r.r0.state, r.fig, r.tiny) == ("checked", "uncertain", 0.2, "checked", "uncertain", True, False)


def test_shield():
    t = "See [the site](http://a.b/c) or `x = 1`, mail me@x.org, $a+b$, {name} and Bern, University of Bern. ok"
    masked, kept = U.masked_of(t, {"Bern": "Berne", "University of Bern": "Uni"})
    assert "http" not in masked and "me@x" not in masked and "[the site" in masked and "Bern" not in masked
    assert U.unmasked_of(masked, kept) == t.replace("University of Bern", "Uni").replace("and Bern,", "and Berne,")
    assert U.unmasked_of("\ue0009\ue001", []) == "\ue0009\ue001"
    code = "a\n```py\nx = 'http://a.b'\n```\nb"
    assert U.masked_of(code)[1] == ["```py\nx = 'http://a.b'\n```"] and U.unmasked_of(*U.masked_of(code)) == code
    assert U.masked_of("![i](u) <b>x</b> \\(y\\) /usr/lib/x %(n)s 5 $ and 6 $")[1] == ["![i](u)", "<b>", "</b>", "\\(y\\)", "/usr/lib/x", "%(n)s"]


def test_chunks_and_reflow(spark):
    chunks = lambda t, n: of(spark, lambda c: U.sentence_chunks(c, n), t)
    assert chunks("A b. C d.\n\nE.", 6) == ["A b.", "C d.", "E."] and chunks("A b. C d.\n\nE.", 9) == ["A b. C d.", "E."]
    assert chunks("x" * 10, 4) == ["xxxx", "xxxx", "xx"] and chunks("", 4) == [] and chunks(None, 4) == []
    breaks = lambda t, n: of(spark, lambda c: U.break_chunks(c, n), t)
    assert breaks("aaa\n\nbbb\nccc", 8) == ["aaa", "bbb", "ccc"] and breaks("abcdefgh", 3) == ["abc", "def", "gh"]
    assert breaks("aaa\nbbb\nccc", 9) == ["aaa\nbbb", "ccc"] and breaks("", 3) == [] and breaks(None, 3) == []
    assert U.split_by_shares_of("one two three four", [1, 1]) == ["one two three", "four"] or len(U.split_by_shares_of("one two three four", [1, 1])) == 2
    t = "This is a wrap-\nped line that\ngoes on.\nNew one\n\n- item\ncontinues\n```\ncode a\nb\n```"
    once = U.reflowed_of(t)
    assert once.startswith("This is a wrapped line that goes on.\nNew one\n\n- item") and "code a\nb" in once and U.reflowed_of(once) == once


def test_tables_and_json():
    assert U.safe_table_of('<table onclick="x"><tr><td colspan="2"><b>1</b><script>x</script></td></tr></table>') == '<table><tr><td colspan="2">1</td></tr></table>'
    assert U.table_grid_of('<table><tr><td rowspan="2">a</td><td>b</td></tr><tr><td>c</td></tr></table>') == [["a", "b"], ["a", "c"]]
    assert U.first_json_of('x {bad} {"a": [1]} y') == '{"a": [1]}' and U.first_json_of("x") is None
    words = [{"text": "Hello", "bbox": [0, 0, 1, 1]}, {"text": "w0rld", "bbox": [1, 0, 2, 1]}]
    got = U.aligned_of(["hello", "world"], words)
    assert [g["exact"] for g in got] == [True, False] and got[1]["bbox"] == [1, 0, 2, 1]
    assert U.aligned_of(["a"], [], [0, 0, 5, 5]) == [{"text": "a", "bbox": [0, 0, 5, 5], "exact": False}] and U.aligned_of([], words) == []


def test_udfs_run(spark):
    df = spark.createDataFrame([("a `x` b",), (None,), ("",)], "t string")
    rows = df.select(U.unmask(U.mask("t")["masked"], U.mask("t")["kept"]).alias("u"), U.sentence_chunks("t").alias("c"), U.reflowed("t").alias("r"), U.shielded_translation(F.col("t"), lambda s: s.str.upper()).alias("p")).collect()
    assert [r.u for r in rows] == ["a `x` b", None, ""] and rows[1].c == [] and rows[0].p == "A `x` B" and rows[1].p is None


def longest_run(a, b):
    """The longest common run, the first in a and then in b, by trying every place."""
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            k = 0
            while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k]:
                k += 1
            if k > best[2]:
                best = (i, j, k)
    return best


def naive_pairs(a, b, i0=0, j0=0):
    i, j, k = longest_run(a, b)
    if not k:
        return []
    return naive_pairs(a[:i], b[:j], i0, j0) + [(i0 + i + t, j0 + j + t) for t in range(k)] + naive_pairs(a[i + k :], b[j + k :], i0 + i + k, j0 + j + k)


def test_longest_blocks():
    import random

    rng = random.Random(11)
    for n in range(120):
        a, b = ([rng.choice("abcd"[: 2 + n % 3]) for _ in range(rng.randrange(25))] for _ in range(2))
        assert U.common_pairs(a, b) == naive_pairs(a, b)
    # the longest run wins over more anchors
    assert U.common_pairs(list("abxcd"), list("cdab")) == [(0, 2), (1, 3)]
