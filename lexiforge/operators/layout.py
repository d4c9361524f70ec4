"""Page layouts: typing, spatial joins, reading order, renderers.

Spatial joins meet on a page and then compare boxes: a page's regions are few, so no join goes beyond a page.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geometry as G

# Engine labels of each region type; any other label is "other".
TYPES = {
    "text": ["text", "content", "plain_text", "number", "aside_text", "algorithm", "formula_number"],
    "title": ["title", "doc_title", "paragraph_title", "abstract", "figure_title", "chart_title", "table_title", "figure_caption", "table_caption"],
    "table": ["table"],
    "figure": ["figure", "image", "chart", "header_image", "footer_image"],
    "seal": ["seal"],
    "formula": ["formula", "interline_equation", "equation"],
    "header": ["header"],
    "footer": ["footer"],
    "footnote": ["footnote", "vision_footnote"],
    "reference": ["reference", "reference_content"],
    "list": ["list"],
    "checkbox": ["checkbox", "check_box"],
}
ASSETS = ["figure", "seal", "checkbox"]


def region_type(label):
    """M1."""
    low = F.lower(F.trim(label))
    out = F.when(low.isin(TYPES["text"]), "text")
    for kind, labels in TYPES.items():
        out = out.when(low.isin(labels), kind)
    return out.otherwise("other")


def regions_of(pages: DataFrame) -> DataFrame:
    """A row per parsed block, typed and boxed, in reading order; the layout score where a box overlaps by 0.3 at least."""
    b = pages.select("page_number", "layout_det_res", F.posexplode("parsing_res_list").alias("i", "b"))
    best = F.aggregate("layout_det_res", F.struct(F.lit(0.0).alias("iou"), F.lit(None).cast("double").alias("score")),
                       lambda s, d: F.when(G.iou(F.col("box"), G.box(d["coordinate"])) > s["iou"], F.struct(G.iou(F.col("box"), G.box(d["coordinate"])).alias("iou"), d["score"].cast("double").alias("score"))).otherwise(s))
    rows = b.select("page_number", "i", "layout_det_res", G.box(F.col("b.block_bbox")).alias("box"), region_type(F.col("b.block_label")).alias("type"), F.col("b.block_content").alias("content"), F.coalesce("b.block_order", "i").alias("reading_order"))
    rows = rows.withColumn("best", best)
    return rows.select("page_number", F.format_string("p%d_r%03d", "page_number", F.col("i") + 1).alias("region_id"), "type", "content", "box", "reading_order", F.when(F.col("best.iou") >= 0.3, F.col("best.score")).alias("score"))


def place_of(*frames: DataFrame) -> list[str]:
    """The columns that say which page of which document a row is of: ``document`` counts where all frames have it."""
    return ["document", "page"] if all("document" in f.columns for f in frames) else ["page"]


def words_in_regions(words: DataFrame, regions: DataFrame, margin: float = 0.02) -> DataFrame:
    """Each word in the first region, in reading order, that holds its centre; words in none are left out."""
    at = place_of(words, regions)
    b, r = F.col("bbox"), F.col("box")
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    mx, my = F.greatest(F.lit(1.0), (r[2] - r[0]) * margin), F.greatest(F.lit(1.0), (r[3] - r[1]) * margin)
    hit = words.join(regions.select(*at, "region_id", "reading_order", "box"), at).where((cx >= r[0] - mx) & (cx <= r[2] + mx) & (cy >= r[1] - my) & (cy <= r[3] + my))
    first = F.row_number().over(W.partitionBy(*at, "word_id").orderBy("reading_order", "region_id"))
    return hit.withColumn("__r", first).where("__r = 1").select(*at, "word_id", "region_id")


def controls_in_sections(controls: DataFrame, sections: DataFrame) -> DataFrame:
    """The first section that holds a control's centre."""
    at = place_of(controls, sections)
    b, s = F.col("bbox"), F.col("box")
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    hit = controls.join(sections, at).where((cx >= s[0]) & (cx <= s[2]) & (cy >= s[1]) & (cy <= s[3]))
    return hit.groupBy(*at, "control_id").agg(F.min_by("section_id", "ord").alias("section_id"))


def nearest_labels(controls: DataFrame, blocks: DataFrame, gap: float, band: float = 0.8) -> DataFrame:
    """The nearest text on a control's line that begins within ``gap`` to its right (or covers it); ties: the first block."""
    at = place_of(controls, blocks)
    c, b = F.col("bbox"), F.col("box")
    mid, high = (c[1] + c[3]) / 2, F.greatest(F.lit(1.0), c[3] - c[1])
    near = controls.join(blocks, at).where((b[3] >= mid - high * band) & (b[1] <= mid + high * band) & (b[2] > c[0]) & (b[0] <= c[2] + gap))
    return near.groupBy(*at, "control_id").agg(F.min_by("text", F.struct(F.greatest(F.lit(0.0), b[0] - c[2]), "ord")).alias("label"))


def grids(tables: DataFrame, controls: DataFrame, least: int = 2) -> DataFrame:
    """Table regions that hold the centres of at least ``least`` controls, and whether all of those are labelled."""
    at = place_of(tables, controls)
    b, t = F.col("bbox"), F.col("box")
    cx, cy = (b[0] + b[2]) / 2, (b[1] + b[3]) / 2
    hit = tables.join(controls, at).where((cx >= t[0]) & (cx <= t[2]) & (cy >= t[1]) & (cy <= t[3]))
    return hit.groupBy(*at, "region_id").agg(F.count("*").alias("controls"), F.bool_and(F.coalesce("label", F.lit("")) != "").alias("labelled")).where(F.col("controls") >= least)


def page_stream(regions: DataFrame, groups: DataFrame) -> DataFrame:
    """Regions and form groups of each page in reading order.

    A group follows the last region that it overlaps, else the last one above it, else all; check boxes
    that a group covers by half are left out.
    """
    at = place_of(regions, groups)
    r = regions.select(*at, "region_id", "type", "reading_order", F.col("box").alias("rb"))
    both = groups.select(*at, "group_id", F.col("box").alias("gb")).join(r, at, "left")
    place = both.groupBy(*at, "group_id").agg(F.max(F.when(G.covered(F.col("rb"), F.col("gb")) > 0, F.col("reading_order"))).alias("over"), F.max(F.when(F.col("rb")[3] <= F.col("gb")[1], F.col("reading_order"))).alias("above"))
    place = place.select(*at, F.col("group_id").alias("item"), F.lit("form_group").alias("kind"), F.coalesce("over", "above", F.lit(2**31 - 1)).alias("at"), F.lit(1).alias("after"))
    hidden = both.where((F.col("type") == "checkbox") & (G.covered(F.col("rb"), F.col("gb")) >= 0.5)).select(*at, "region_id").distinct()
    shown = r.join(hidden, [*at, "region_id"], "left_anti").select(*at, F.col("region_id").alias("item"), F.lit("region").alias("kind"), F.col("reading_order").alias("at"), F.lit(0).alias("after"))
    order = W.partitionBy(*at).orderBy("at", "after", "item")
    return shown.unionByName(place).withColumn("position", F.row_number().over(order)).select(*at, "position", "kind", "item")


def markdown(regions: DataFrame) -> DataFrame:
    """Each page as markdown, its regions in reading order."""
    c = F.coalesce("content", F.lit(""))
    block = F.when(F.col("type") == "title", F.concat(F.lit("## "), c)).when(F.col("type") == "formula", F.concat(F.lit("$$"), c, F.lit("$$"))).when(F.col("type") == "figure", F.concat(F.lit("![figure]("), "region_id", F.lit(")"))).otherwise(c)
    return _ordered(regions.withColumn("__b", block))


def plain(regions: DataFrame) -> DataFrame:
    """Each page as text."""
    from ..functions.text import html_plain

    return _ordered(regions.where(~F.col("type").isin("figure", "seal")).withColumn("__b", F.when(F.col("type") == "table", html_plain(F.col("content"))).otherwise(F.coalesce("content", F.lit("")))))


def _ordered(rows: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("reading_order", "region_id", F.col("__b").alias("b"))))
    return rows.where("__b <> ''").groupBy(*place_of(rows)).agg(F.array_join(F.transform(items, lambda s: s["b"]), "\n\n").alias("text"))


def region_counts(regions: DataFrame, by: str | list[str] | None = None) -> DataFrame:
    """Regions of each type, on each page of each document unless other columns are named."""
    keys = place_of(regions) if by is None else [by] if isinstance(by, str) else by
    return regions.groupBy(*keys, "type").agg(F.count("*").alias("n"))


def reading_order(controls: DataFrame) -> DataFrame:
    """By line (centre over the page's median height, rounded half to even), then from the left."""
    b = F.col("bbox")
    at = place_of(controls)
    tall = F.median(b[3] - b[1]).over(W.partitionBy(*at))  # of one page
    line = F.bround((b[1] + b[3]) / 2 / F.greatest(F.lit(1.0), F.col("__h")), 0)
    return controls.withColumn("__h", tall).withColumn("position", F.row_number().over(W.partitionBy(*at).orderBy(line, b[0], "control_id"))).drop("__h")


def _rows(pdf: pd.DataFrame) -> pd.DataFrame:
    # Greedy, in order: a control joins the first row whose centre is within half its height (6 at least).
    centres: list[int] = []
    out = []
    for box in pdf.sort_values("ord")["bbox"]:
        mid, slack = int((box[1] + box[3]) // 2), max(6, int(box[3] - box[1]) // 2)
        k = next((i for i, c in enumerate(centres) if abs(c - mid) <= slack), None)
        if k is None:
            centres.append(mid)
            k = len(centres) - 1
        out.append(centres[k])
    return pdf.sort_values("ord").assign(row_y=out).drop(columns="bbox")


def answer_groups(controls: DataFrame) -> DataFrame:
    """Rows of controls and the answers that they form, on each page of each document.

    ``controls([document, ]page, question_id, shape, control_id, ord, bbox)``. Rows of several controls are an answer each;
    consecutive rows of one control are one answer together. Boxes allow several choices.
    """
    at = [*place_of(controls), "question_id"]
    by = [*at, "shape"]
    rows = controls.select(*by, "control_id", F.col("ord").cast("int"), "bbox", F.col("bbox")[0].cast("double").alias("x"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields if f.name != "bbox")
    rows = rows.groupBy(*by).applyInPandas(_rows, kinds + ", row_y int")
    rows = rows.withColumn("n", F.count("*").over(W.partitionBy(*by, "row_y")))
    w = W.partitionBy(*by).orderBy("row_y")
    lines = rows.select(*by, "row_y", "n").distinct().withColumn("before", F.lag("n").over(w))
    lines = lines.withColumn("start", F.when((F.col("n") == 1) & (F.coalesce("before", F.lit(2)) == 1), 0).otherwise(1)).withColumn("g", F.sum("start").over(w))
    out = rows.join(lines.select(*by, "row_y", "g"), [*by, "row_y"])
    numbers = out.groupBy(*by, "g").agg(F.min("ord").alias("o")).withColumn("k", F.row_number().over(W.partitionBy(*at).orderBy("shape", "g")))
    out = out.join(numbers.drop("o"), [*by, "g"])
    return out.select(*at, "control_id", F.concat("question_id", F.format_string("_r%02d", "k")).alias("row_id"), F.when(F.col("shape") == "box", "multiple").otherwise("single").alias("rule"),
                      F.row_number().over(W.partitionBy(*at, "k").orderBy("row_y", "x")).alias("position"))


def row_bands(rows: DataFrame) -> DataFrame:
    """each row's band, from midway to the row before to midway to the next, on its page."""
    w = W.partitionBy(*place_of(rows)).orderBy("centre")
    return rows.withColumn("top", (F.lag("centre").over(w) + F.col("centre")) / 2).withColumn("bottom", (F.lead("centre").over(w) + F.col("centre")) / 2)


def column_split(anchors: DataFrame, width: float, least: int = 4, share: float = 0.18) -> DataFrame:
    """where a page of at least ``least`` anchors falls into columns: the middle of the widest gap, if that is wide enough."""
    gap = F.lead("x").over(W.partitionBy("page").orderBy("x")) - F.col("x")
    g = anchors.withColumn("gap", gap).groupBy("page").agg(F.count("*").alias("n"), F.max("gap").alias("gap"), F.max_by(F.col("x") + F.col("gap") / 2, "gap").alias("split"))
    return g.where((F.col("n") >= least) & (F.col("gap") >= share * width)).select("page", "split")


def recovered_gap(marks: DataFrame, low: float = 1.6, high: float = 2.6) -> DataFrame:
    """F16: where exactly one pitch of a column of marks is about double: the missing mark's place."""
    pitch = F.lead("y").over(W.partitionBy("column").orderBy("y")) - F.col("y")
    rows = marks.withColumn("pitch", pitch).where("pitch is not null")
    usual = rows.groupBy("column").agg(F.median("pitch").alias("usual"))
    wide = rows.join(usual, "column").where((F.col("pitch") >= low * F.col("usual")) & (F.col("pitch") <= high * F.col("usual")))
    return wide.groupBy("column").agg(F.count("*").alias("n"), F.min(F.col("y") + F.col("pitch") / 2).alias("y")).where("n = 1").select("column", "y")


def most_uniform(items: DataFrame, n: int) -> DataFrame:
    """of the n-runs of values in order, the one that spreads least: its range."""
    w = W.partitionBy("group").orderBy("value")
    run = w.rowsBetween(0, n - 1)
    rows = items.withColumn("size", F.count("*").over(run)).withColumn("low", F.min("value").over(run)).withColumn("high", F.max("value").over(run)).where(F.col("size") == n)
    return rows.groupBy("group").agg(F.min_by(F.struct("low", "high"), F.struct(F.col("high") - F.col("low"), "low")).alias("r")).select("group", "r.low", "r.high")


def dominant_band(values: DataFrame, tolerance: float) -> DataFrame:
    """The value with most others within the tolerance (ties: the smallest), both ends as doubles; a window by range, not pairs."""
    reach = f"{float(tolerance)!r}D"
    n = F.expr(f"count(value) over (partition by `group` order by value range between {reach} preceding and {reach} following)")
    rows = values.withColumn("value", F.col("value").cast("double")).withColumn("n", n)
    return rows.groupBy("group").agg(F.max_by("value", F.struct("n", -F.col("value"))).alias("centre"), F.max("n").alias("n"))


def line_boxes(words: DataFrame) -> DataFrame:
    """The box around the words of each line."""
    b = F.col("bbox")
    return words.groupBy("page", "line").agg(F.array(F.min(b[0]), F.min(b[1]), F.max(b[2]), F.max(b[3])).alias("box"), F.count("*").alias("words"))


def first_seen(rows: DataFrame, by: list[str], value: str, order: str) -> DataFrame:
    """Distinct values of each key in the order of their first appearance."""
    one = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.min(order).alias("__o"))
    return one.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("__o", value))), lambda s: s[value]).alias("values"))


def corrected(rows: DataFrame, edits: DataFrame, key: str, value: str) -> DataFrame:
    """M7: human corrections in place, the original kept beside."""
    new = edits.select(key, F.col(value).alias("__new"))
    changed = F.col("__new").isNotNull() & ~F.col("__new").eqNullSafe(F.col(value))
    out = rows.join(new, key, "left").withColumn("original", F.when(changed, F.col(value)))
    return out.withColumn(value, F.coalesce("__new", value)).withColumn("corrected", changed).drop("__new")


def overlapping_text(boxes: DataFrame, images: DataFrame, share: float = 0.4, off: float = 0.8) -> DataFrame:
    """Text boxes that an image covers by ``share``; if that holds for more than ``off`` of all, for none."""
    hit = boxes.join(images.select("page", F.col("box").alias("__i")), "page").where(G.covered(F.col("box"), F.col("__i")) >= share).select("page", "box_id").distinct().withColumn("over", F.lit(True))
    rows = boxes.join(hit, ["page", "box_id"], "left").withColumn("over", F.coalesce("over", F.lit(False)))
    rate = rows.agg(F.avg(F.col("over").cast("int")).alias("__r"))
    return rows.crossJoin(F.broadcast(rate)).withColumn("over", F.col("over") & (F.col("__r") <= off)).drop("__r")


def scanned(pages: DataFrame, by: str, text: str, least: int = 200) -> DataFrame:
    """Documents whose pages hold too little text in all, and those with a page that needs recognition."""
    from ..functions.text import has_text_layer

    return pages.groupBy(by).agg((F.sum(F.length(F.trim(F.coalesce(text, F.lit(""))))) < least).alias("scanned"), F.bool_or(~has_text_layer(F.col(text))).alias("needs_ocr"))


def form_rows(groups: DataFrame) -> DataFrame:
    """A line per group and row of forms: the options chosen, or why there is none.

    ``groups(group_id, question, rows array<struct(label, options array<struct(label, state)>)>)``.
    """
    rows = groups.select("group_id", "question", F.posexplode("rows").alias("position", "row"))
    chosen = F.array_join(F.transform(F.filter("row.options", lambda o: o["state"] == "selected"), lambda o: o["label"]), " | ")
    unclear = F.exists("row.options", lambda o: o["state"] == "ambiguous")
    answer = F.when((chosen != "") & unclear, F.concat(chosen, F.lit(" (+ unreadable mark)"))).when(chosen != "", chosen).when(unclear, "unreadable").otherwise("no answer")
    return rows.select("group_id", "question", "position", F.col("row.label").alias("label"), answer.alias("answer"))


def merged_votes(votes: DataFrame) -> DataFrame:
    """States that several readings give an option; contradictions are ambiguous."""
    return votes.groupBy("option_id").agg(F.when(F.count_distinct("state") > 1, "ambiguous").otherwise(F.min("state")).alias("state"), F.count("*").alias("votes"))


def reconciled(items: DataFrame, marks: DataFrame, key: str) -> DataFrame:
    """Glyphs beside measured marks, by position, only where both are as many; else a note."""
    n = lambda rows, name: rows.groupBy(key).agg(F.count("*").alias(name))
    sizes = n(items, "a").join(n(marks, "b"), key, "full")
    same = sizes.where("a = b").select(key)
    met = items.join(marks.withColumnRenamed("state", "measured"), [key, "position"]).join(same, key, "left_semi")
    met = met.select(key, "position", "state", "measured", F.when((F.col("state") != F.col("measured")) & (F.col("measured") != "uncertain"), "needs_review").otherwise("observed").alias("status"))
    odd = sizes.where("not (a <=> b)").select(key, F.lit(None).cast("int").alias("position"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("measured"), F.lit("count_mismatch").alias("status"))
    return met.unionByName(odd)


def pruned_groups(groups: DataFrame) -> DataFrame:
    """H7: repeated form groups (equal text and body) once, the first; parents that others name stay."""
    rank = F.row_number().over(W.partitionBy("text", "body").orderBy("ord"))
    parents = groups.where("parent is not null").select(F.col("parent").alias("group_id")).distinct().withColumn("__p", F.lit(True))
    return groups.withColumn("__r", rank).join(parents, "group_id", "left").where("__r = 1 or __p").drop("__r", "__p")


def pixel_median(pixels: DataFrame) -> DataFrame:
    """The median of registered copies at each pixel ``(x, y, value)``."""
    return pixels.groupBy("x", "y").agg(F.median("value").alias("value"))


def gutters(columns: DataFrame, least: int = 120) -> DataFrame:
    """runs of at least ``least`` pixel columns ``(page, x, ink)`` without ink."""
    w = W.partitionBy("page").orderBy("x")
    empty = columns.where(F.coalesce("ink", F.lit(0)) == 0).withColumn("run", F.col("x") - F.row_number().over(w))
    return empty.groupBy("page", "run").agg(F.min("x").alias("left"), F.max("x").alias("right"), F.count("*").alias("width")).where(F.col("width") >= least).drop("run")


def printed_text(grid):
    """The cells of a table as one text, without placeholders of unnamed columns."""
    cells = F.filter(F.flatten(grid), lambda c: c.isNotNull() & (F.trim(c) != "") & ~c.startswith("Unnamed:") & (F.lower(c) != "nan"))
    return F.array_join(cells, " ")
