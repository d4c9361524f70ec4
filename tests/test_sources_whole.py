"""Scans lose no row to a neighbour's fault, and layouts keep documents apart."""

import io
import zipfile

from pyspark.sql import functions as F

from lexiforge.operators import layout, topics
from lexiforge.sources import files, sinks


def test_json_by_file(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"k": 1}\n{"k": 2}\n{broken\n{"k": 3}\n')
    (tmp_path / "b.json").write_text('{"k": 4}\n\n{"k": 5}\n')
    (tmp_path / "c.json").write_text('[\n{"k": 6},\n{"k": 7}\n]')
    (tmp_path / "d.json").write_text('{\n"k": 8\n}')
    df = files.read_json(spark, str(tmp_path)).cache()
    assert sorted(r.k for r in df.where("k is not null").collect()) == list(range(1, 9))
    assert [r["_corrupt_record"] for r in df.where("_corrupt_record is not null").collect()] == ["{broken"]


def test_delimited_by_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("n,city\n1,Zürich\n".encode())
    (tmp_path / "b.csv").write_bytes("n,city\n2,Genève\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"n,city\nx,Bern\n")
    rows = files.read_delimited(spark, str(tmp_path)).collect()
    assert {(str(r.n), r.city) for r in rows} == {("1", "Zürich"), ("2", "Genève"), ("x", "Bern")}


def _book(active: int) -> bytes:
    out = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="u"><bookViews><workbookView activeTab="{active}"/></bookViews><sheets><sheet r:id="i2"/><sheet r:id="i10"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<R><r Id="i2" Target="worksheets/sheet2.xml"/><r Id="i10" Target="worksheets/sheet10.xml"/></R>')
        for n in (2, 10):
            z.writestr(f"xl/worksheets/sheet{n}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="B1" t="inlineStr"><is><t>s{n}</t></is></c></row></sheetData></worksheet>')
    return out.getvalue()


def test_active_sheet():
    assert files.sheet_rows_of(_book(0)) == [[None, "s2"]] and files.sheet_rows_of(_book(1)) == [[None, "s10"]]


def test_replaced_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    sinks.replace_parquet(spark.range(3), path)
    sinks.replace_parquet(spark.range(5), path, f"{path}-old")
    assert spark.read.parquet(path).count() == 5 and spark.read.parquet(f"{path}-old").count() == 3


def test_small_corpus_errors(spark):
    said = ["Found array with 0 sample(s) (shape=(0, 5))", "Cannot use scipy.linalg.eigh for sparse A with k >= N.", "need at least one array to concatenate", "n_samples must be positive", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(said)], "i int, t string")
    assert [r.x for r in df.select("i", topics.is_small_corpus_error(F.col("t")).alias("x")).orderBy("i").collect()] == [True, True, True, False, False]


def test_pages_of_two_documents(spark):
    words = spark.createDataFrame([("a", 1, 1, [1.0, 1.0, 2.0, 2.0]), ("b", 1, 1, [1.0, 1.0, 2.0, 2.0])], "document string, page int, word_id int, bbox array<double>")
    regions = spark.createDataFrame([("a", 1, "r1", 1, [0.0, 0.0, 9.0, 9.0]), ("b", 1, "r1", 1, [50.0, 50.0, 90.0, 90.0])], "document string, page int, region_id string, reading_order int, box array<double>")
    assert [(r.document, r.region_id) for r in layout.words_in_regions(words, regions).collect()] == [("a", "r1")]
    controls = words.select("document", "page", F.col("word_id").cast("string").alias("control_id"), "bbox")
    assert {(r.document, r.position) for r in layout.reading_order(controls).collect()} == {("a", 1), ("b", 1)}
