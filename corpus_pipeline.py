"""A corpus pipeline: quality, lines, near duplicates, passages, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept;
all but the last return the columns of ``documents``, further columns included. Where a stage changes a text,
``n_chars`` follows it. In every stage null text counts as an empty one and stays null, whole texts
of any length are read, ties go to the smaller id, rows given twice are treated alike, rows with a null id are matched
with nothing and stay, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiforge.llm.common import semi, written
from lexiforge.llm.line_dedup import dedup_lines
from lexiforge.llm.ngram_join import ngram_components
from lexiforge.llm.packing import pack_documents
from lexiforge.llm.quality import held_out, keep_quality, train
from lexiforge.llm.queries import BYTE_BPE, tokenizer
from lexiforge.llm.span_dedup import PASSAGE, dedup_spans
from lexiforge.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier scores below 0.3."""
    ship(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = train(docs, labels.where(~held_out()))
    return keep_quality(docs, model, 0.3)


def _rewritten(docs: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with the columns of ``docs``; a document left without any text goes."""
    new = new.where("n_removed = 0 or trim(text) <> ''")
    if "n_chars" in docs.columns:
        kept = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        new = new.withColumn("n_chars", kept)
    return new.select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that repeat an earlier one, exactly or within two edits."""
    ship(spark)
    return _rewritten(docs, dedup_lines(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, that of the smallest id, of each component of five-word shingle similarity 0.8 or more."""
    ship(spark)
    found = ngram_components(docs, n=5, percent=80)
    gone = written(found.where("doc_id <> component_id").select("doc_id"), "near-duplicates")
    return semi(docs, gone, "doc_id", how="left_anti").select(*docs.columns)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes passages that repeat an earlier one."""
    ship(spark)
    return _rewritten(docs, dedup_spans(docs, passage=PASSAGE))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens: a row per piece."""
    ship(spark)
    return pack_documents(docs, tokenizer(BYTE_BPE))


STAGES = [("quality", quality), ("line dedup", lines), ("n-gram join", near_duplicates), ("substring dedup", passages), ("packing", packing)]
#: SQL can't express the classifier; the stages are tested one by one.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{k}")
    return docs
