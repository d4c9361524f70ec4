"""Questionnaires: readings and controls to answers, tables, queues and scores.

``readings(document, control_id, page, state, score)`` are facts; ``controls(control_id, page, row_id,
rule, label, ord)`` is the form, a small dimension, broadcast. A control that a document lacks, and one
whose page could not be registered, counts as uncertain with score 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

UNREAD = ("uncertain", "registration_failed")


def complete(readings: DataFrame, controls: DataFrame) -> DataFrame:
    """Every control of every document; the form is a dimension of bounded size."""
    docs = readings.select("document").distinct()
    facts = readings.groupBy("document", "control_id").agg(F.max(F.struct("score", "state")).alias("r")).select("document", "control_id", "r.state", "r.score")
    grid = docs.crossJoin(F.broadcast(controls))
    unread = F.coalesce(F.col("state").isin(*UNREAD), F.lit(True))
    return (grid.join(facts, ["document", "control_id"], "left")
            .withColumn("score", F.when(F.col("state").isNull() | (F.col("state") == "registration_failed"), 0.0).otherwise(F.col("score")))
            .withColumn("state", F.when(unread, "uncertain").otherwise(F.col("state"))))


def long_table(readings: DataFrame, controls: DataFrame) -> DataFrame:
    """Readings of known controls with their labels."""
    return readings.join(F.broadcast(controls.drop("page")), "control_id").select("document", "control_id", "row_id", "label", "page", "state", "score")


def wide_table(readings: DataFrame, controls: DataFrame, names: list[str]) -> DataFrame:
    """A row per document and a column per control, in the given order."""
    return readings.where(F.col("control_id").isin(names)).groupBy("document").pivot("control_id", names).agg(F.first("state"))


def answers(full: DataFrame) -> DataFrame:
    """The value and certainty of each answer row.

    One choice: its label; several MULTIPLE, anything unread UNCERTAIN (both with certainty 0); none ''.
    Several choices: labels sorted and joined by ';', or UNCERTAIN. Certainty is the lowest score.
    """
    g = full.groupBy("document", "row_id", "rule").agg(
        F.count_if(F.col("state") == "checked").alias("c"), F.count_if(F.col("state") == "uncertain").alias("u"), F.min("score").alias("low"),
        F.array_sort(F.collect_list(F.when(F.col("state") == "checked", F.coalesce(F.nullif("label", F.lit("")), "control_id")))).alias("labels"))
    single = F.col("rule") == "single"
    value = (F.when(single & (F.col("c") > 1), "MULTIPLE").when(F.col("u") > 0, "UNCERTAIN").when(single & (F.col("c") == 0), "").otherwise(F.array_join("labels", ";")))
    sure = F.when(single & ((F.col("c") > 1) | (F.col("u") > 0)), 0.0).otherwise(F.col("low"))
    return g.select("document", "row_id", "rule", value.alias("value"), sure.alias("certainty"))


def checkbox_table(full: DataFrame, found: DataFrame, rows: list[str], controls: list[str]) -> DataFrame:
    """A row per document: each answer with its certainty, then each control as true, false or null with its."""
    a = found.groupBy("document").pivot("row_id", rows).agg(F.first("value").alias("value"), F.round(F.first("certainty"), 3).alias("certainty"))
    state = F.when(F.col("state") == "checked", True).when(F.col("state") == "unchecked", False)
    c = full.groupBy("document").pivot("control_id", controls).agg(F.first(state).alias("marked"), F.round(F.first("score"), 3).alias("certainty"))
    return a.join(c, "document")


def review_queue(long: DataFrame) -> DataFrame:
    """Unread controls, the least certain first."""
    return long.where(F.col("state").isin(*UNREAD)).orderBy("score", "document", "control_id")


def unused_controls(readings: DataFrame, controls: DataFrame) -> DataFrame:
    """Controls that nobody marked, and whether their whole row is unmarked."""
    marked = readings.where("state = 'checked'").select("control_id").distinct()
    used_rows = controls.join(marked, "control_id", "left_semi").select("row_id").distinct().withColumn("used", F.lit(True))
    out = controls.join(marked, "control_id", "left_anti").join(used_rows, "row_id", "left")
    return out.select("control_id", "page", "row_id", "label", F.col("used").isNull().alias("whole_row_unused")).orderBy(F.desc("whole_row_unused"), "page", "row_id", "control_id")


def summary(readings: DataFrame, failed: DataFrame | None = None) -> DataFrame:
    """Counts over all documents; controls per document are whole."""
    out = readings.agg(F.count_distinct("document").alias("documents"), F.count("*").alias("readings"), F.count_if(F.col("state") == "checked").alias("checked"),
                       F.count_if(F.col("state") == "uncertain").alias("uncertain"))
    return out.select("documents", F.expr("readings div greatest(documents, 1)").alias("controls_per_document"), "checked", "uncertain",
                      F.round(F.col("uncertain") / F.greatest("readings", F.lit(1)), 4).alias("uncertain_rate"))


def worst_registration(documents: DataFrame, column: str = "registration") -> DataFrame:
    """The lowest page registration of each document."""
    return documents.select("document", F.round(F.coalesce(F.array_min(F.map_values(column)), F.lit(0.0)), 3).alias("registration"))


def registrations(pages: DataFrame) -> DataFrame:
    """E16 over long rows ``(document, registration)``, one for each page: the lowest of each document, combined before the shuffle."""
    return pages.groupBy("document").agg(F.round(F.coalesce(F.min("registration"), F.lit(0.0)), 3).alias("registration"))


def overview(readings: DataFrame, controls: DataFrame) -> DataFrame:
    """Each answer row: options, who marked any of them, its controls."""
    marked = readings.where("state = 'checked'").join(F.broadcast(controls.select("control_id", "row_id")), "control_id").groupBy("row_id").agg(F.count_distinct("document").alias("answered_by"))
    rows = controls.groupBy("row_id", "rule").agg(F.count("*").alias("options"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "control_id"))), lambda s: s["control_id"]), ",").alias("control_ids"))
    return rows.join(marked, "row_id", "left").select("row_id", "rule", "options", F.coalesce("answered_by", F.lit(0)).alias("answered_by"), F.col("answered_by").isNull().alias("never_marked"), "control_ids")


def shared_marks(full: DataFrame, winners: DataFrame, score: float = 0.5) -> DataFrame:
    """Of a single choice marked twice, ``winners(document, row_id, control_id)`` keep their mark; all marked ones get the score."""
    w = W.partitionBy("document", "row_id")
    n = F.sum(F.when(F.col("state") == "checked", 1).otherwise(0)).over(w)
    win = winners.select("document", "row_id", F.col("control_id").alias("__win"))
    out = full.withColumn("__n", n).join(win, ["document", "row_id"], "left")
    twice = (F.col("rule") == "single") & (F.col("__n") > 1) & F.col("__win").isNotNull() & (F.col("state") == "checked")
    return (out.withColumn("score", F.when(twice, score).otherwise(F.col("score"))).withColumn("state", F.when(twice & (F.col("control_id") != F.col("__win")), "unchecked").otherwise(F.col("state"))).drop("__n", "__win"))


def norm(text):
    """An answer for comparison: without punctuation, lower case, white space collapsed."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", ""), r"\s+", " ")))


def matched_options(parts: DataFrame, options: DataFrame) -> DataFrame:
    """The one printed option that a written part means: equal, else the only one that begins alike, else the only one that contains it.

    ``parts(document, row_id, part)``; ``options(row_id, option)``, broadcast. No match: null.
    """
    both = parts.join(F.broadcast(options), "row_id", "left").withColumns({"__a": norm(F.col("option")), "__b": norm(F.col("part"))})
    starts = F.startswith("__a", "__b") | F.startswith("__b", "__a")
    holds = F.contains("__a", "__b") | F.contains("__b", "__a")
    one = lambda test: F.when(F.count_distinct(F.when(test, F.col("option"))) == 1, F.min(F.when(test, F.col("option"))))
    return both.groupBy("document", "row_id", "part").agg(F.coalesce(F.min(F.when(F.col("__a") == F.col("__b"), F.col("option"))), one(starts), one(holds)).alias("option"))


def scored(found: DataFrame, sheet: DataFrame, options: DataFrame) -> DataFrame:
    """Answers of a filled sheet beside the predictions, part by part; rows without a prediction are left out."""
    sheet = sheet.withColumn("answer", F.trim(F.coalesce("answer", F.lit(""))))
    parts = sheet.select("document", "row_id", F.explode(F.split("answer", ";")).alias("part")).withColumn("part", F.trim("part")).where("part <> ''")
    hit = matched_options(parts.distinct(), options).groupBy("document", "row_id").agg(
        F.lower(F.array_join(F.array_sort(F.collect_list("option")), ";")).alias("truth"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("option").isNull(), F.col("part")))), ";").alias("unmatched"))
    out = found.join(sheet.select("document", "row_id", "answer"), ["document", "row_id"]).join(hit, ["document", "row_id"], "left")
    flagged = F.col("value").isin("MULTIPLE", "UNCERTAIN")
    same = F.coalesce("truth", F.lit("")) == F.lower("value")
    return out.select("document", "row_id", "answer", "value", "certainty", flagged.alias("flagged"), (~flagged & (F.coalesce("unmatched", F.lit("")) == "") & same).alias("correct"),
                      (F.col("answer") == "?").alias("human_unsure"), F.coalesce("unmatched", F.lit("")).alias("unmatched"))


def score_summary(rows: DataFrame) -> DataFrame:
    """Accuracy of what was accepted without review, and how certain its errors were."""
    fit = rows.where(~F.col("human_unsure") & (F.col("unmatched") == ""))
    auto, wrong = ~F.col("flagged"), ~F.col("flagged") & ~F.col("correct")
    return fit.agg(F.count("*").alias("scored"), F.count_if("flagged").alias("flagged"), F.count_if(auto).alias("auto_accepted"), F.count_if(auto & F.col("correct")).alias("auto_correct"),
                   F.round(F.avg(F.when(auto, F.col("correct").cast("int"))), 4).alias("accuracy"), F.count_if(wrong).alias("silent_errors"),
                   F.round(F.max(F.when(wrong, F.col("certainty"))), 3).alias("max_certainty"), F.round(F.median(F.when(wrong, F.col("certainty"))), 3).alias("median_certainty"))


def blank_sheet(documents: DataFrame, controls: DataFrame) -> DataFrame:
    """A line for each document and answer, numbered from the top."""
    rows = controls.groupBy("row_id", "rule").agg(F.min("ord").alias("ord"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "label"))), lambda s: s["label"]), " / ").alias("options"))
    rows = rows.withColumn("position", F.row_number().over(W.orderBy("ord")))  # the form's rows
    return documents.select("document").distinct().crossJoin(F.broadcast(rows.drop("ord"))).withColumn("answer", F.lit(""))


def unique_names(df: DataFrame, name: str, order: str) -> DataFrame:
    """a repeated name gets its number, in order: ``name (2)``."""
    n = F.row_number().over(W.partitionBy(name).orderBy(order))
    return df.withColumn(name, F.when(n > 1, F.concat(F.col(name), F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col(name)))


def disambiguated(controls: DataFrame) -> DataFrame:
    """Labels of a row that aren't all different become ``option 1``, ``option 2``…"""
    w = W.partitionBy("row_id")
    same = F.size(F.collect_set("label").over(w)) < F.count("*").over(w)
    return controls.withColumn("label", F.when(same, F.concat(F.lit("option "), F.row_number().over(w.orderBy("ord")).cast("string"))).otherwise(F.col("label")))


def without_controls(controls: DataFrame, gone: DataFrame) -> DataFrame:
    """N6."""
    return controls.join(gone.select("control_id"), "control_id", "left_anti")


def majority_pages(documents: DataFrame) -> DataFrame:
    """The most frequent page count (ties: the first seen by document)."""
    return documents.groupBy("pages").agg(F.count("*").alias("n"), F.min("document").alias("first")).orderBy(F.desc("n"), "first").limit(1)
