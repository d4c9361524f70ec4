"""Question sections of a page: what answers they offer, why they are questions, and layouts that later documents reuse.

A section is a group of regions, one row each: ``regions([document, ]page, section, region_id, ord, type, html, text)``; other columns
that a function reads are named there. Tables are read as relations of rows; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from .forms import reliable, resolved
from .layout import place_of

# Names of the reasons and of the structure's source, the LaTeX names and signs of crossed or open boxes, and the longest question.
REASONS = ["paddle-mark-glyph", "paddle-mark-notation", "paddle-checkbox-region", "paddle-binary-options", "aligned-geometric-mark-pattern"]
TABLE_SOURCE = "paddleocr-vl-table"
BOX_NAMES, BOX_SIGNS = ["bigotimes", "boxtimes", "square", "Box", "bigcirc"], "⊗⊠"
QUESTION_CHARS = 600

OPTIONS = "array<struct<option_id: string, label: string, state: string>>"
ROWS = f"array<struct<row: int, row_id: string, label: string, options: {OPTIONS}>>"


def _key(regions: DataFrame) -> list[str]:
    return [*place_of(regions), "section"]


def _trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t|:;,\-]+|[ \t|:;,\-]+$", "")


def _table(html: Column, region_id: Column) -> Column:
    """The response rows of a region's table, made of its own row alone."""
    cols = lambda r: F.filter(F.transform(r["states"], lambda s, i: F.when(s.isNotNull(), i)), lambda i: i.isNotNull())
    read = F.transform(X.html_rows(html), lambda c: F.struct(c.alias("cells"), F.transform(c, X.first_mark).alias("states")))
    parsed = F.transform(read, lambda r, i: F.struct(i.alias("row"), r["cells"].alias("cells"), r["states"].alias("states"), cols(r).alias("cols"), F.transform(r["cells"], resolved).alias("named")))
    fits = lambda r, w: (F.size(r["cells"]) > F.array_max(w)) & (F.size(F.filter(w, lambda i: F.get(r["named"], i))) >= 2)
    start = F.struct(F.lit(None).cast("int").alias("last"), F.array().cast("array<int>").alias("before"))

    def headers(rows, wanted):
        """For each row the last one before it that can head these columns."""
        step = lambda acc, r: F.struct(F.when(fits(r, wanted), r["row"]).otherwise(acc["last"]).alias("last"), F.array_append(acc["before"], acc["last"]).alias("before"))
        return F.aggregate(rows, start, step, lambda acc: acc["before"])

    def shaped(r, h):
        row_id = F.concat(region_id, F.lit("_r"), r["row"])
        options = F.transform(r["cols"], lambda i, k: F.struct(
            F.concat(row_id, F.lit("_o"), k + 1).alias("option_id"),
            F.when(F.get(h["named"], i), F.get(h["cells"], i)).otherwise(F.concat(F.lit("option "), (k + 1).cast("string"))).alias("label"), F.get(r["states"], i).alias("state")))
        label = F.trim(F.array_join(F.filter(F.slice(r["cells"], 1, F.array_min(r["cols"])), lambda c: c != ""), " "))
        return F.struct(r["row"].alias("row"), row_id.alias("row_id"), label.alias("label"), options.alias("options"))

    def under(rows, asked):
        sets = F.array_distinct(F.transform(asked, lambda r: r["cols"]))
        alike = lambda w: X.let(headers(rows, w), lambda b: F.transform(F.filter(asked, lambda r: r["cols"] == w), lambda r: X.let(F.get(rows, F.get(b, r["row"])), lambda h: shaped(r, h))))
        return F.array_sort(F.flatten(F.transform(sets, alike)))

    return X.let(parsed, lambda rows: X.let(F.filter(rows, lambda r: F.size(r["cols"]) >= 2), lambda asked: under(rows, asked))).cast(ROWS)


def table_rows(regions: DataFrame) -> DataFrame:
    """Response rows of tables: those with marks in two cells at least.

    A row's options are named by its header: the last row before it that reaches its last mark and has at least two resolved
    labels in its marked columns. So the search depends on the marked columns: rows are read once for each set of columns that
    occurs in their table, and the header is the last that fits before each row. Other options are ``option i``.
    Returns the section's columns, ``region_id, row, row_id, label, options`` (structs of id, label and state).
    """
    return regions.where(F.col("type") == "table").select(*_key(regions), "region_id", F.inline(_rows()))


def text_rows(regions: DataFrame) -> DataFrame:
    """I71 as rows: a region other than a table whose text has marks is one row, each mark's option named by what follows it."""
    return regions.where(F.col("type") != "table").select(*_key(regions), "region_id", F.inline(_rows()))


def _text(text: Column, region_id: Column) -> Column:
    """The one row of a text with marks, or none."""
    def row(plain, marks):
        # Marks are one character each, numbered from 0: a label ends before the next mark.
        ends = lambda k: F.coalesce(F.get(marks, k + 1)["index"], F.length(plain))
        named = lambda m, k: X.let(_trimmed(F.substring(plain, m["index"] + 2, ends(k) - m["index"] - 1)), lambda t: F.when(t == "", F.concat(F.lit("option "), (k + 1).cast("string"))).otherwise(t))
        options = F.transform(marks, lambda m, k: F.struct(F.concat(region_id, F.lit("_o"), k + 1).alias("option_id"), named(m, k).alias("label"), m["state"].alias("state")))
        prefix = _trimmed(F.substring(plain, F.lit(1), F.get(marks, F.lit(0))["index"]))
        return F.struct(F.lit(0).alias("row"), region_id.alias("row_id"), prefix.alias("label"), options.alias("options"))

    rows = lambda plain, marks: F.when(F.size(marks) > 0, F.array(row(plain, marks))).otherwise(F.array())
    return X.let(X.html_plain(text), lambda plain: X.let(X.mark_glyphs(plain), lambda marks: rows(plain, marks))).cast(ROWS)


def _rows() -> Column:
    """A table's response rows, or the row of a text with marks: each region is read once, by itself."""
    of, who = F.col("type"), F.col("region_id")
    return F.when(of == "table", _table(F.coalesce("html", F.lit("")), who)).when(of != "table", _text(F.coalesce("text", F.lit("")), who))


def schema_hints(regions: DataFrame, anchors: DataFrame) -> DataFrame:
    """A row for each section of ``anchors([document, ]page, section, anchor)``: its question and the rows of its answers.

    Where exactly one table of the section is reliable, it owns the structure and its rows are the only ones; else all rows of all
    regions count, in the order of regions and rows. ``(.., question_text, structure_source, structure_region_id, rows)``.
    """
    key = _key(regions)
    labels = lambda rows: F.transform(rows, lambda r: F.struct(r["label"].alias("label"), F.transform(r["options"], lambda o: o["label"]).alias("options")))
    sure = lambda rows: F.coalesce((F.col("type") == "table") & X.let(labels(rows), reliable), F.lit(False))
    part = lambda rows: F.when(F.col("region_id").isNotNull() & (F.size(rows) > 0), F.struct("ord", "region_id", sure(rows).alias("sure"), rows.alias("rows")))
    # A region's rows are made within one expression: a filter on them would be pushed below and make them again.
    per = regions.select(*key, X.let(_rows(), part).alias("part")).groupBy(*key).agg(F.collect_list("part").alias("parts"))
    per = per.withColumn("sure", F.array_distinct(F.transform(F.filter("parts", lambda p: p["sure"]), lambda p: p["region_id"])))
    per = per.withColumn("owner", F.when(F.size("sure") == 1, F.get("sure", F.lit(0))))
    mine = F.filter("parts", lambda p: F.col("owner").isNull() | (F.col("owner") == p["region_id"]))
    rows = F.flatten(F.transform(mine, lambda p: F.transform(p["rows"], lambda r: F.struct(p["ord"].alias("ord"), p["region_id"].alias("region_id"), *[r[n].alias(n) for n in ("row", "row_id", "label", "options")]))))
    hints = per.select(*key, "owner", F.array_sort(rows).alias("rows"))
    out = anchors.select(*key, "anchor").join(hints, key, "left")
    question = F.trim(F.substring(X.question_text(F.trim(F.regexp_replace(X.html_plain(F.coalesce("anchor", F.lit(""))), r"\s+", " "))), 1, QUESTION_CHARS))
    kept = F.coalesce(F.transform("rows", lambda r: F.struct(r["row_id"].alias("row_id"), r["label"].alias("label"), r["options"].alias("options"))), F.array().cast(f"array<struct<row_id: string, label: string, options: {OPTIONS}>>"))
    return out.select(*key, question.alias("question_text"), F.when(F.col("owner").isNotNull(), TABLE_SOURCE).otherwise("").alias("structure_source"), F.coalesce("owner", F.lit("")).alias("structure_region_id"), kept.alias("rows"))


def evidence(regions: DataFrame, aligned: Column | None = None) -> DataFrame:
    """O1: why each section is taken for a question: ``(.., evidence)``, an ordered array, empty for ordinary text and tables.

    What was read decides first: mark glyphs, names of box signs, a checkbox region, a short text with a yes and a no. Only without any of
    these ``aligned``, the number of marks found in a row in the section's image (the largest of its regions'), counts
    from two on. Each reason comes once, in the order of REASONS, with the regions that gave it in ``regions``.
    """
    key = _key(regions)
    text = X.html_plain(F.coalesce("text", "html", F.lit("")))
    notation = text.rlike("|".join(rf"\\{n}\b" for n in BOX_NAMES) + f"|[{BOX_SIGNS}]")
    tests = [F.size(X.mark_glyphs(text)) > 0, notation, F.col("type") == "checkbox", X.is_binary(text)]
    here = F.filter(F.array(*[F.when(t, F.struct(F.lit(i).alias("i"), F.lit(r).alias("reason"))) for i, (t, r) in enumerate(zip(tests, REASONS))]), lambda s: s.isNotNull())
    rows = regions.select(*key, "region_id", "ord", here.alias("here"), (F.lit(0) if aligned is None else F.coalesce(aligned, F.lit(0))).alias("aligned"))
    said = rows.select(*key, "region_id", "ord", F.explode("here").alias("s")).groupBy(*key, "s").agg(F.array_sort(F.collect_list(F.struct("ord", "region_id"))).alias("r"))
    said = said.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", F.transform("r", lambda x: x["region_id"]).alias("regions")))).alias("found"))
    out = rows.groupBy(*key).agg(F.max("aligned").alias("aligned")).join(said, key, "left")
    shape = lambda reason, who: F.struct(reason.alias("reason"), who.alias("regions"))
    none = F.array().cast("array<string>")
    listed = F.transform("found", lambda f: shape(f["s"]["reason"], f["regions"]))
    return out.select(*key, F.when(F.col("found").isNotNull(), listed).when(F.col("aligned") >= 2, F.array(shape(F.lit(REASONS[4]), none))).otherwise(F.array().cast("array<struct<reason: string, regions: array<string>>>")).alias("evidence"))


def mark_presence(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """Whether a section's box meets a region that shows an answer: ``(.., present)`` for each of ``boxes(.., section, box)``.

    Regions have ``box``, ``html``, ``text``, a ``state`` of their own and ``items`` (array of structs with state and needs_review), either
    possibly null. A checked or uncertain state, an item that is so or needs review, or a checked glyph counts.
    """
    at = place_of(regions, boxes)
    marked = lambda s: s.isin("checked", "uncertain")
    source = F.coalesce(F.when(F.col("type") == "table", F.col("html")).otherwise(F.col("text")), F.lit(""))
    shows = (F.coalesce(marked(F.col("state")), F.lit(False)) | F.coalesce(F.exists("items", lambda i: F.coalesce(marked(i["state"]), F.lit(False)) | F.coalesce(i["needs_review"], F.lit(False))), F.lit(False))
             | F.exists(X.mark_glyphs(source), lambda m: m["state"] == "checked"))
    some = regions.where(shows).select(*at, F.col("box").alias("__r"))
    meets = boxes.join(some, at).where(G.intersection(F.col("box"), F.col("__r")) > 0).select(*at, "section").distinct().withColumn("present", F.lit(True))
    return boxes.join(meets, [*at, "section"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


# ---------------------------------------------------------------- layouts


def learned_layout(jobs: DataFrame) -> DataFrame:
    """For each page number the sections of the first document that taught it, with boxes as shares of its page.

    ``jobs(form, document, turn, page, width, height, group_id, bbox, valid, ..)``: documents of a form in the order of ``turn``. A page whose
    response was invalid (``valid`` is not true for one of its jobs), without jobs or without size teaches nothing. Further
    columns of the job (its schema) come along; answers are not among them.
    """
    page = ["form", "page"]
    good = jobs.groupBy(*page, "turn").agg(F.bool_and(F.coalesce("valid", F.lit(False)) & (F.col("width") > 0) & (F.col("height") > 0)).alias("good")).where("good")
    first = F.broadcast(good.groupBy(*page).agg(F.min("turn").alias("turn")))  # a row for each page of a form
    share = F.transform("bbox", lambda v, i: v.cast("double") / F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height")))
    return jobs.join(first, [*page, "turn"]).withColumn("share", share).withColumnRenamed("turn", "learned_turn").drop("document", "bbox", "valid", "width", "height")


def reused_layout(layout: DataFrame, pages: DataFrame) -> DataFrame:
    """The learnt sections on the pages of documents after the one that taught them: boxes in their pixels, within the page.

    ``pages(form, document, turn, page, width, height)``. Edges are rounded half to even. The layout, a page's sections once for each form,
    is broadcast: it grows with the forms and not with their documents, whose pages would meet in a task for each page number of a form.
    """
    later = pages.join(F.broadcast(layout), ["form", "page"]).where("turn > learned_turn")
    limit = lambda i: F.when(i % 2 == 0, F.col("width")).otherwise(F.col("height"))
    edge = lambda v, i: F.bround(v * limit(i), 0).cast("int")
    box = F.transform("share", lambda v, i: F.when(i < 2, F.greatest(F.lit(0), edge(v, i))).otherwise(F.least(limit(i).cast("int"), edge(v, i))))
    return later.withColumn("bbox", box).withColumn("template_reused", F.lit(True)).drop("share", "learned_turn")
