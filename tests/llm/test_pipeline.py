"""The pipeline stage by stage on the small tables: columns, what is kept, and what its decisions do."""

import collections

import corpus_pipeline as C
from pyspark.sql import functions as F

from lexiforge.llm.bytebpe import coder
from lexiforge.llm.queries import BYTE_BPE, tokenizer


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [len(C.STAGES), C.STAGES[-1][1]] == [5, C.packing]
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before, kept = docs, []
    for name, stage in C.STAGES[:-1]:
        after = stage(spark, before, sf).cache()
        assert after.columns == docs.columns and dict(after.dtypes) == dict(docs.dtypes), name
        assert after.join(before, "doc_id", "left_anti").count() == 0 and after.count() == after.select("doc_id").distinct().count()
        assert after.where(F.length("text") != F.col("n_chars")).count() == 0
        kept.append(after.count())
        before = after
    good = labels.where("quality = 1").join(docs, "doc_id")
    left = C.quality(spark, docs, sf)
    assert good.join(left, "doc_id").count() >= 0.97 * good.count()
    bad = labels.where("quality = 0").join(docs, "doc_id")
    assert bad.join(left, "doc_id").count() <= 0.3 * bad.count()
    # Pieces tile the texts that are left.
    pieces = C.packing(spark, before, sf).collect()
    rows = before.collect()
    tokens = {r.doc_id: len(t) + 1 for r, t in zip(rows, coder(tokenizer(BYTE_BPE)).encode([r.text for r in rows]))}
    found = collections.Counter()
    for p in pieces:
        found[p.doc_id] += p.length
    assert dict(found) == tokens


def test_near_duplicates_and_repeats(spark, sf):
    base = " ".join(f"w{i}" for i in range(200)) + "."
    near = base.replace("w100", "other")
    texts = [base, near, "Something else entirely, which stays as it is.\nAnd more of it.", "", None]
    docs = spark.createDataFrame([(i + 10, t, "en", "s", len(t or ""), "x") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, component_id string")
    left = C.near_duplicates(spark, docs, sf)
    assert sorted(r.doc_id for r in left.collect()) == [10, 12, 13, 14] and left.columns == docs.columns
    lines = {r.doc_id: r for r in C.lines(spark, docs.union(docs.where("doc_id = 12").withColumn("doc_id", F.lit(99).cast("long"))), sf).collect()}
    assert 99 not in lines and lines[12].text == texts[2] and lines[13].text == "" and lines[14].text is None
    spans = {r.doc_id: r for r in C.passages(spark, docs, sf).collect()}
    assert spans[10].text == base and 11 not in spans or len(spans[11].text) < len(near)
    assert C.near_duplicates(spark, docs.limit(0), sf).count() == 0
