"""Form rules, model flows and office files."""

import io
import zipfile

import pandas as pd
from pyspark.sql import functions as F

from lexiforge.operators import flows as M
from lexiforge.operators import forms as R
from lexiforge.sources import files


def one(spark, column):
    v = spark.range(1).select(column.alias("x")).first()["x"]
    return v.asDict(True) if hasattr(v, "asDict") else v


def test_rules(spark):
    lit = F.lit
    assert one(spark, R.math_page(lit("∑∫√∂≤≥≠∞"), F.array(lit("Arial")))) and one(spark, R.math_page(lit("a"), F.array(lit("CMMI10"), lit("STIXMath")))) and not one(spark, R.math_page(lit("a"), F.array(lit("CMMI10"))))
    assert one(spark, R.math_span(lit("x ∈ ∑"))) is True and one(spark, R.math_span(lit("long plain words ∈"))) is False
    assert one(spark, R.leaks(lit('{"choice_text'))) and one(spark, R.leaks(lit("☐ Ja"))) and not one(spark, R.leaks(lit("Ja")))
    assert one(spark, R.resolved(lit("○ Ja"))) and not one(spark, R.resolved(lit("○ |"))) and not one(spark, R.resolved(lit("N/A")))
    some = F.array(lit("a"))
    assert one(spark, R.defect(lit("12)"), lit(None), lit("single"), lit("unknown"), some, some)) == "only a number"
    assert one(spark, R.defect(lit("How?"), lit(None), lit("odd"), lit("unknown"), some, some)) == "invalid kind"
    assert one(spark, R.defect(lit("How?"), lit(None), lit("single"), lit("zero_or_one"), some, some)) == ""
    assert one(spark, R.contract(lit("Mehrere Antworten"), F.array(lit(3)))) == {"response": "multiple", "rule": "zero_or_more"}
    assert one(spark, R.contract(lit("x"), F.array(lit(3), lit(2))))["response"] == "matrix" and one(spark, R.contract(lit("x"), F.array(lit(3))))["rule"] == "zero_or_one"
    assert [(o["state"], o["label"]) for o in one(spark, R.text_options(lit("Alter ☐ jung ☒")))] == [("unchecked", "jung"), ("checked", "option 2")]
    row = lambda label, *o: F.struct(lit(label).alias("label"), F.array(*map(lit, o)).alias("options"))
    assert one(spark, R.reliable(F.array(row("a", "x", "y"), row("b", "x", "Y")))) and not one(spark, R.reliable(F.array(row("a", "x", "y"), row("a", "x", "y")))) and not one(spark, R.reliable(F.array(row("a", "x", "y"))))
    assert one(spark, R.crop(F.array(F.array(lit(100.0), lit(100.0), lit(300.0), lit(200.0))), lit(305), lit(1000))) == [88, 88, 305, 212]
    assert one(spark, R.median_size(F.array(lit(8.0), lit(12.0), lit(10.0), lit(11.0)))) == 11.0 and one(spark, R.median_size(F.array().cast("array<double>"))) == 10.0
    assert len(one(spark, R.padding_collapsed(F.array(row("a", "x"), row(" "))))) == 1


def test_sequences(spark):
    c = spark.createDataFrame([("r", i, "1 2 3") for i in range(3)] + [("s", i, "x") for i in range(2)] + [("t", 0, "a"), ("t", 1, "b")], "run string, ord int, label string")
    got = {(r.run, r.ord): r.label for r in R.scale_labels(c).collect()}
    assert [got["r", i] for i in range(3)] == ["1", "2", "3"] and got["s", 1] == "option 2" and got["t", 0] == "a"
    b = spark.createDataFrame([("d", 0, "One"), ("d", 1, "goes on."), ("d", 2, "Two."), ("d", 3, " "), ("d", 4, "Three")], "doc string, ord int, text string")
    assert [r.paragraph for r in R.paragraph_groups(b).orderBy("ord").collect()] == [1, 1, 2, None, 4]
    r = spark.createDataFrame([(0, 0, 1.0, "a", "text", "1) Wie?"), (0, 0, 2.0, "b", "text", "☐ gut"), (0, 0, 3.0, "c", "title", "2. Was"), (0, 0, 0.5, "z", "text", "Kopf")], "page int, column int, top double, region_id string, type string, content string")
    assert {x.region_id: x.question for x in R.sections(r).collect()} == {"a": 1, "b": 1, "c": 2, "z": None}
    assert R.template_ids(spark.createDataFrame([(0, 5), (0, 2), (1, 1)], "page int, ord int")).orderBy("page", "ord").first()["control_id"] == "p1_c001"
    hints = spark.createDataFrame([("a", "Ja!", "h1"), ("x", "Nein", "h2")], "row_id string, label string, hint string")
    rows = spark.createDataFrame([("a", "?"), ("b", "nein"), ("c", "c")], "row_id string, label string")
    assert {x.row_id: x.hint for x in R.hint_match(rows, hints).collect()} == {"a": "h1", "b": "h2", "c": None}


def test_flows(spark):
    docs = spark.createDataFrame([(1, "a b. c\n\nd"), (2, ""), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in M.translated(docs, lambda s: s.str.upper()).collect()}
    assert out == {1: "A B. C\n\nD", 2: "", 3: ""}

    def picky(s: pd.Series) -> pd.Series:
        if s.str.contains("bad").any():
            raise ValueError("no")
        return s.str.len().astype(str)

    rows = spark.createDataFrame([("good",), ("bad",)], "t string").coalesce(1).select(M.called(picky, F.col("t")).alias("r")).collect()
    assert [(r.r.text, r.r.error) for r in rows] == [("4", None), (None, "ValueError: no")]
    long = spark.createDataFrame([(1, "x" * 50 + "\n" + "y" * 50), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r.summary for r in M.summarised(long, lambda s: s.str.len().astype(str), most_tokens=10, chunk=60).collect()}
    assert set(got) == {1, 2} and all(v.isdigit() for v in got.values())
    papers = spark.createDataFrame([("p", "good"), ("q", " "), ("r", "odd")], "paper_id string, abstract string")
    answer = lambda s: s.map(lambda t: '```json\n{"topics": [{"category": "", "label": " x ", "confidence": "1.7"}, {"label": ""}]}\n```' if t == "good" else "none")
    e = {r.paper_id: (r.status, [(t.category, t.label, t.confidence) for t in r.topics]) for r in M.enriched(papers, answer).collect()}
    assert e == {"p": ("ok", [("General", "x", 1.0)]), "q": ("no abstract", []), "r": ("no topics in the answer", [])}
    assert one(spark, M.speaker_sentence(F.array(F.lit("A"), F.lit("B"), F.lit("C")))) == "There are 3 speakers: A, B and C."
    d = spark.createDataFrame([("x/a",), ("y/b",)], "folder string")
    r = spark.createDataFrame([("q/z.pdf", "x/a", 1), ("k/b.pdf", "", 2)], "document string, export_directory string, reading int")
    assert {x.folder: x.reading for x in M.matched_documents(d, r).collect()} == {"x/a": 1, "y/b": 2}


def test_office(spark, tmp_path):
    b = io.BytesIO()
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("xl/sharedStrings.xml", f"<sst xmlns='{ns}'><si><t>name</t></si><si><t>n</t></si></sst>")
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet xmlns='{ns}'><sheetData><row r='1'><c r='A1' t='s'><v>0</v></c><c r='C1' t='s'><v>1</v></c></row><row r='2'><c r='A2' t='inlineStr'><is><t>x</t></is></c><c r='C2'><v>2.5</v></c></row></sheetData></worksheet>")
    (tmp_path / "w.xlsx").write_bytes(b.getvalue())
    rows = files.read_sheets(spark, str(tmp_path / "w.xlsx")).orderBy("row").collect()
    assert [r.cells for r in rows] == [["name", None, "n"], ["x", None, "2.5"]]
    d = io.BytesIO()
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(d, "w") as z:
        z.writestr("word/document.xml", f"<w:document xmlns:w='{w}'><w:body><w:p><w:r><w:t>Hello </w:t></w:r><w:r><w:t>you</w:t></w:r></w:p><w:p/></w:body></w:document>")
    (tmp_path / "a.docx").write_bytes(d.getvalue())
    (tmp_path / "b.bin").write_bytes(b"x")
    got = {r.Filename: (r.Text, bool(r.error)) for r in files.read_documents(spark, str(tmp_path / "[ab].*")).collect()}
    assert got == {"a.docx": ("Hello you\n", False), "b.bin": (None, True)}


def test_form_options(spark):
    import json

    mark = lambda **k: {"choice_position": None, "choice_text": None, "state": "selected", **k}
    ask = {"question_text": "Rauchen Sie?", "response_type": "single", "selection_rule": "zero_or_one", "choices": [{"choice_text": "Ja"}, {"choice_text": "Nein"}]}
    reply = {"questions": [
        {**ask, "rows": [{"row_text": "", "marked_answers": [mark(choice_position=2)]}, {"row_text": "b", "extra_choices": [{"choice_text": "Nie"}], "marked_answers": [mark(choice_text="nie"), mark(choice_text="Ja")]}]},
        {**ask, "rows": [{"row_text": "", "marked_answers": [mark(choice_position=2, choice_text="Ja", state="unclear")]}]},
        {**ask, "choices": [], "rows": [{"row_text": "x"}]}]}
    rows = {(r.row_id, r.option_id): r for r in R.form_options(spark.createDataFrame([(1, 1, "```json\n" + json.dumps(reply) + "\n```"), (1, 2, "no")], "page int, section int, reply string")).collect()}
    assert (rows["p1_s1_q1_r1", "p1_s1_q1_r1_c2"].state, rows["p1_s1_q1_r1", "p1_s1_q1_r1_c1"].state, rows["p1_s1_q1_r1", "p1_s1_q1_r1_c1"].status) == ("selected", "unselected", "observed")
    assert rows["p1_s1_q1_r2", "p1_s1_q1_r2_c3"].state == "selected" and rows["p1_s1_q1_r2", "p1_s1_q1_r2_c3"].status == "needs_review"
    assert rows["p1_s1_q2_r1", "p1_s1_q2_r1_c2"].state == "ambiguous" and rows["p1_s1_q2_r1", "p1_s1_q2_r1_c2"].status == "needs_review"
    assert rows[None, None].status == "no choices or rows" and len(rows) == 8


def test_tei_body():
    from lexiforge.functions.udfs import tei_body_of

    xml = "<TEI xmlns='x'><text><body><div><p>One <ref>[1]</ref> two.</p><figure><p>no</p></figure><p>Three</p></div></body></text></TEI>"
    assert tei_body_of(xml) == "One two.\n\nThree" and tei_body_of("<bad") == ""


def test_small_ones(spark):
    from lexiforge.functions import geometry as G
    from lexiforge.functions import text as X
    from lexiforge.functions import udfs as U
    from lexiforge.operators import layout as L
    from lexiforge.operators import transcript as N

    px = spark.createDataFrame([(0, 0, v) for v in (1, 9, 5)], "x int, y int, value int")
    assert L.pixel_median(px).first()["value"] == 5
    ink = spark.createDataFrame([(1, x, 0 if 10 <= x < 140 or x == 3 else 7) for x in range(200)], "page int, x int, ink int")
    assert [(r.left, r.right) for r in L.gutters(ink).collect()] == [(10, 139)]
    assert one(spark, L.printed_text(U.table_grid(F.lit("<table><tr><th>Unnamed: 0</th><th>A</th></tr><tr><td></td><td>1</td></tr></table>")))) == "A 1"
    assert one(spark, G.is_flat(F.lit(1.3))) and not one(spark, G.is_flat(F.lit(None).cast("double")))
    assert one(spark, X.translatable(F.lit("Ja"))) and not one(spark, X.translatable(F.lit("=A1"))) and not one(spark, X.translatable(F.lit("12")))
    assert one(spark, X.display_name(F.lit(1), F.lit(4), F.lit("Q10"), F.lit(" "))) == "p1/4 Q10"
    xml = "<TEI xmlns='x' xmlns:xml='http://www.w3.org/XML/1998/namespace'><listBibl><biblStruct xml:id='b0'><analytic><title>T</title><author><persName><forename>A</forename><forename>M</forename><surname>B</surname></persName></author></analytic><monogr><title>J</title><imprint><date when='2001-02'/></imprint></monogr><idno type='DOI'>10/x</idno></biblStruct></listBibl></TEI>"
    assert U.tei_citations_of(xml) == [{"citation_id": "b0", "title": "T", "authors": ["A M B"], "doi": "10/x", "year": "2001"}]
    w = spark.createDataFrame([("d", 1, 1, "Hi", "A", 0.0, 1.0)], "doc string, segment_id int, word_id int, word string, speaker string, start double, end double")
    assert N.words_tsv(w).first()["text"].endswith("1\t1\t00:00:00.000\t00:00:01.000\tHi\tA")
