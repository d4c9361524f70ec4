"""Dataflows around external models: flatten, call in batches, regroup; prompts and reports.

A model is a pandas function on a batch of texts; it runs in Arrow batches on executors. Each row has a
status, so one failure is one row's.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import udfs as U
from .transcript import ordered_text

# What a summary may be, and what it is asked for.
MODES = {
    "brief": "Write a short summary of the main points.", "detailed": "Write a detailed summary by topic.", "minutes": "Write minutes: topics, decisions, open points.",
    "actions": "List the tasks agreed, with who does them.", "narrative": "Retell the conversation as continuous prose.",
}
_RESULT = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def called(model: Callable[[pd.Series], pd.Series], text: Column, retries: int = 2) -> Column:
    """The model's answers as (text, error). A failing batch is tried again, then row by row."""

    @F.pandas_udf(_RESULT)
    def run(s: pd.Series) -> pd.DataFrame:
        def attempt(part: pd.Series):
            problem = None
            for _ in range(retries + 1):
                try:
                    return list(model(part)), None
                except Exception as e:  # whatever the model raises is the row's error
                    problem = f"{type(e).__name__}: {e}"
            return [None] * len(part), problem

        got, problem = attempt(s)
        if problem is None:
            return pd.DataFrame({"text": got, "error": [None] * len(s)})
        one = [attempt(s.iloc[i : i + 1]) for i in range(len(s))]
        return pd.DataFrame({"text": [g[0][0] for g in one], "error": [g[1] for g in one]})

    return run(text)


def translated(docs: DataFrame, model: Callable[[pd.Series], pd.Series], id_col: str = "doc_id", text: str = "text", most: int = 1200) -> DataFrame:
    """Parts between line breaks, in chunks, through the model, and back as whole texts; line breaks stay as they are."""
    parts = docs.select(id_col, F.posexplode_outer(F.regexp_extract_all(text, F.lit(r"(\n+|[^\n]+)"), F.lit(1))).alias("part", "piece"))
    chunks = parts.select(id_col, "part", F.posexplode_outer(F.when(F.trim(F.regexp_replace("piece", "\n", "")) == "", F.array("piece")).otherwise(U.sentence_chunks("piece", most))).alias("chunk", "text"))
    plain = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "\n", "")) == ""
    done = chunks.withColumn("__r", called(model, F.col("text"))).withColumn("text", F.when(plain, F.coalesce("text", F.lit(""))).otherwise(F.coalesce("__r.text", "text")))
    whole = ordered_text(done, [id_col, "part"], "chunk", "text", " ")
    return ordered_text(whole, [id_col], "part", "text", "")


def speaker_sentence(names: Column) -> Column:
    """Who speaks, as a sentence; null without names."""
    n = F.size(names)
    most = F.array_join(F.slice(names, 1, F.greatest(n - 1, F.lit(0))), ", ")
    return (F.when(n == 1, F.concat(F.lit("There is one speaker: "), names[0], F.lit(".")))
            .when(n > 1, F.concat(F.lit("There are "), n.cast("string"), F.lit(" speakers: "), most, F.lit(" and "), F.element_at(names, -1), F.lit("."))))


def prompts(docs: DataFrame, mode: str, language: str | None = None, text: str = "text") -> DataFrame:
    """A prompt for each text."""
    ask = MODES[mode] + (f" Answer in {language}." if language else "")
    return docs.withColumn("prompt", F.concat(F.lit(ask + "\n\n"), F.coalesce(text, F.lit(""))))


def summarised(docs: DataFrame, model: Callable[[pd.Series], pd.Series], mode: str = "brief", id_col: str = "doc_id", text: str = "text", most_tokens: int = 75_000, chunk: int = 56_000) -> DataFrame:
    """Short texts in one call; long ones chunk by chunk to notes, joined in order, and then summed up."""
    chunks = F.when(F.length(text) > 4 * most_tokens, U.break_chunks(text, chunk)).otherwise(F.array(text))
    parts = docs.select(id_col, F.size(chunks).alias("n"), F.posexplode(chunks).alias("chunk", "text"))
    notes = parts.withColumn("text", F.when(F.col("n") > 1, F.coalesce(called(model, F.concat(F.lit("Take notes.\n\n"), "text"))["text"], F.lit(""))).otherwise(F.col("text")))
    whole = ordered_text(notes, [id_col], "chunk", "text", "\n\n")
    return prompts(whole, mode).withColumn("r", called(model, F.col("prompt"))).select(id_col, F.col("r.text").alias("summary"), F.col("r.error").alias("error"))


def enriched(papers: DataFrame, model: Callable[[pd.Series], pd.Series]) -> DataFrame:
    """Topics of each abstract; papers without one get none, bad answers a status of their own."""
    from ..functions.text import clean_topics, json_object

    kind = "topics array<struct<category: string, label: string, confidence: string, rationale: string>>"
    r = called(model, F.when(F.trim(F.coalesce("abstract", F.lit(""))) != "", F.col("abstract")))
    rows = papers.withColumn("__r", r).withColumn("__t", F.from_json(json_object(F.col("__r.text")), kind)["topics"])
    blank = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    status = F.when(blank, "no abstract").when(F.col("__r.error").isNotNull(), F.col("__r.error")).when(F.col("__t").isNull(), "no topics in the answer").otherwise("ok")
    none = F.from_json(F.lit("[]"), "array<struct<category: string, label: string, confidence: double, rationale: string>>")
    return rows.withColumn("topics", F.when(blank | F.col("__t").isNull(), none).otherwise(clean_topics(F.col("__t")))).withColumn("status", status).drop("__r", "__t")


def report(summary: Column, title: Column, when: Column, speakers: Column) -> Column:
    """A summary as a markdown document."""
    return F.concat(F.lit("# "), title, F.lit("\n\n*"), when, F.lit("*\n\n"), F.coalesce(F.concat(speaker_sentence(speakers), F.lit("\n\n")), F.lit("")), summary, F.lit("\n"))


def matched_documents(documents: DataFrame, readings: DataFrame) -> DataFrame:
    """A document's reading by its folder, else by its name's stem."""
    stem = lambda c: F.regexp_replace(F.regexp_extract(c, r"([^/]+)$", 1), r"\.[^.]*$", "")
    a = readings.where("coalesce(export_directory, '') <> ''").select(F.col("export_directory").alias("folder"), F.col("reading").alias("r1"))
    b = readings.where("coalesce(export_directory, '') = ''").groupBy(stem(F.col("document")).alias("stem")).agg(F.max("reading").alias("r2"))
    rows = documents.withColumn("stem", F.regexp_extract("folder", r"([^/]+)$", 1))
    return rows.join(a, "folder", "left").join(b, "stem", "left").select("folder", F.coalesce("r1", "r2").alias("reading"))


def timings(runs: DataFrame) -> DataFrame:
    """Mean, first and later mean seconds of a batch."""
    return runs.agg(F.avg("seconds").alias("mean"), F.min_by("seconds", "ord").alias("first"), F.avg(F.when(F.col("ord") > 0, F.col("seconds"))).alias("rest"))


def stability(runs: list[DataFrame]) -> float:
    """How alike the topics of several runs are: the mean best word overlap over all ordered pairs of runs."""
    from .topics import best_jaccard

    found = [best_jaccard(a, b).agg(F.avg("best")).first()[0] for i, a in enumerate(runs) for j, b in enumerate(runs) if i != j]
    return sum(found) / len(found)
