"""Rules over forms read by a model: defects, contracts, hints, crops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as X

# What a model may answer, and words that leak from its schema.
RESPONSES = ["single", "multiple", "matrix", "text", "unknown"]
RULES = ["one_per_row", "zero_or_one", "zero_or_more", "unknown"]
LEAKS = ["associated_text", "choice_text", "marked_answers"]
MULTIPLE = ["mehrere antwort", "multiple", "select all", "mehrfach"]
UNRESOLVED = ["na", "none", "unknown", ""]
# Unicode blocks of mathematics and name parts of its fonts.
MATH = r"[\x{2200}-\x{22FF}\x{27C0}-\x{27EF}\x{2980}-\x{29FF}\x{2A00}-\x{2AFF}\x{2070}-\x{209F}\x{391}-\x{3C9}\x{1D400}-\x{1D7FF}]"
MATH_FONTS = "cmmi|cmsy|cmex|msam|msbm|math|stix"


def math_page(text: Column, fonts: Column, chars: int = 8, spans: int = 2) -> Column:
    """C17: enough mathematical characters, or spans in mathematical fonts."""
    return (F.coalesce(F.regexp_count(text, F.lit(MATH)), F.lit(0)) >= chars) | (F.coalesce(F.size(F.filter(fonts, lambda f: F.lower(f).rlike(MATH_FONTS))), F.lit(0)) >= spans)


def math_span(text: Column, chars: int = 2, share: float = 0.3) -> Column:
    """A span that is mathematics for the greater part of what counts."""
    n = F.regexp_count(text, F.lit(MATH))
    return F.coalesce((n >= chars) & (n >= share * F.length(F.regexp_replace(text, r"\s", ""))), F.lit(False))


def leaks(label: Column) -> Column:
    """A choice label that holds marks or pieces of the answer's format."""
    out = label.rlike(f"[{X.CHECKED_GLYPHS}{X.UNCHECKED_GLYPHS}]") | label.rlike(r"""\{\s*['"]|['"],\s*$|\}""")
    for word in LEAKS:
        out = out | F.lower(label).contains(word)
    return F.coalesce(out, F.lit(False))


def resolved(label: Column) -> Column:
    """A label with something besides marks, punctuation and placeholders."""
    bare = F.trim(F.regexp_replace(X.html_plain(label), f"[{X.CHECKED_GLYPHS}{X.UNCHECKED_GLYPHS}|,.;:-]", ""))
    return F.coalesce(X.let(bare, lambda b: ~X.alphanumeric(b).isin(*UNRESOLVED) & (b != "")), F.lit(False))


def defect(question: Column, condition: Column, response: Column, rule: Column, choices: Column, rows: Column) -> Column:
    """Why a question can't be used, or ''."""
    q = F.trim(F.regexp_replace(F.coalesce(question, F.lit("")), r"\s+", " "))
    return (F.when((F.length(q) > 800) | (F.length(F.coalesce(condition, F.lit(""))) > 240), "overlong field").when(q.rlike(r"^\d{1,3}\s*[).:]$"), "only a number")
            .when(~F.coalesce(response, F.lit("unknown")).isin(RESPONSES) | ~F.coalesce(rule, F.lit("unknown")).isin(RULES), "invalid kind")
            .when(F.exists(F.coalesce(choices, F.array().cast("array<string>")), lambda c: F.length(c) > 240), "overlong choice")
            .when((F.coalesce(F.size(choices), F.lit(0)) < 1) | (F.coalesce(F.size(rows), F.lit(0)) < 1), "no choices or rows").otherwise(""))


def contract(question: Column, options: Column) -> Column:
    """(response, rule) from a question's text and the number of options of each row."""
    low, many = F.lower(F.coalesce(question, F.lit(""))), F.lit(False)
    for word in MULTIPLE:
        many = many | low.contains(word)
    n = F.coalesce(F.size(options), F.lit(0))
    as_ = lambda a, b: F.struct(F.lit(a).alias("response"), F.lit(b).alias("rule"))
    return (F.when((n >= 2) & (F.size(F.filter(options, lambda k: k >= 2)) >= 2), as_("matrix", "one_per_row")).when((n == 1) & (options[0] >= 2) & many, as_("multiple", "zero_or_more"))
            .when((n == 1) & (options[0] >= 2), as_("single", "zero_or_one")).when(n >= 1, as_("multiple", "zero_or_more")).otherwise(as_("unknown", "zero_or_more")))


def text_options(text: Column) -> Column:
    """Options of a line of glyphs and labels: (state, label); a bare glyph is ``option i``."""
    glyph = f"[{X.CHECKED_GLYPHS}{X.UNCHECKED_GLYPHS}]"
    parts = F.regexp_extract_all(text, F.lit(f"({glyph}[^{X.CHECKED_GLYPHS}{X.UNCHECKED_GLYPHS}]*)"), F.lit(1))
    label = lambda p: F.regexp_replace(F.regexp_replace(p, r"(?s)^.", ""), r"^[\s|:;,\-]+|[\s|:;,\-]+$", "")
    return F.transform(parts, lambda p, i: F.struct(F.when(F.substring(p, 1, 1).rlike(f"[{X.CHECKED_GLYPHS}]"), "checked").otherwise("unchecked").alias("state"),
                                                    F.when(label(p) == "", F.concat(F.lit("option "), (i + 1).cast("string"))).otherwise(label(p)).alias("label")))


def reliable(rows: Column) -> Column:
    """Whether table rows ``array<struct(label, options array<string>)>`` agree well enough to be a question."""
    key = lambda o: X.alphanumeric(o)
    first = F.transform(rows[0]["options"], key)
    agree = X.let(first, lambda f: F.forall(rows, lambda r: F.transform(r["options"], key) == f)) & F.forall(rows, lambda r: F.forall(r["options"], lambda o: (F.trim(o) != "") & ~F.lower(o).startswith("option ")))
    labels = F.transform(rows, lambda r: X.alphanumeric(r["label"]))
    wide = (F.size(rows) == 1) & (F.size(first) >= 4)
    many = (F.size(rows) > 1) & F.forall(rows, lambda r: resolved(r["label"])) & (F.size(F.array_distinct(labels)) == F.size(rows))
    return F.coalesce((F.size(rows) > 0) & (F.size(first) >= 2) & agree & (wide | many), F.lit(False))


def crop(boxes: Column, width: Column, height: Column) -> Column:
    """The box around a section's regions with a margin, within the page; empty without regions."""
    at = lambda f, i: f(F.transform(boxes, lambda b: b[i]))
    x1, y1, x2, y2 = at(F.array_min, 0), at(F.array_min, 1), at(F.array_max, 2), at(F.array_max, 3)
    mx, my = F.greatest(F.lit(12), F.floor((x2 - x1) * 0.035)), F.greatest(F.lit(12), F.floor((y2 - y1) * 0.06))
    whole = F.array(*[v.cast("int") for v in (F.greatest(F.lit(0), F.floor(x1) - mx), F.greatest(F.lit(0), F.floor(y1) - my), F.least(width, F.floor(x2) + mx), F.least(height, F.floor(y2) + my))])
    return F.when(F.size(boxes) > 0, whole).otherwise(F.array().cast("array<int>"))


def scale_labels(controls: DataFrame) -> DataFrame:
    """labels of a run that aren't all different: its commonest label's numbers by position, if there are as many, else ``option i``."""
    run = W.partitionBy("run")
    tally = controls.groupBy("run", "label").agg(F.count("*").alias("n")).groupBy("run").agg(F.max(F.struct("n", "label"))["label"].alias("common"), F.count("*").alias("kinds"), F.sum("n").alias("size"))
    at = F.row_number().over(run.orderBy("ord"))
    numbers = X.scale_tokens(F.col("common"))
    new = F.when(F.col("kinds") == F.col("size"), F.col("label")).when(F.size(numbers) == F.col("size"), F.element_at(numbers, at)).otherwise(F.concat(F.lit("option "), at.cast("string")))
    return controls.join(tally, "run").withColumn("label", new).drop("common", "kinds", "size")


def sections(regions: DataFrame) -> DataFrame:
    """each region's question: that of the last numbered anchor at or above it in its column; anchors come from C27."""
    anchor = X.is_anchor(F.col("content"), F.col("type") == "title")
    w = W.partitionBy("page", "column").orderBy("top", "region_id")
    number = F.when(anchor, X.question_number(F.col("content"))["number"])
    return regions.withColumn("question", F.last(number, ignorenulls=True).over(w))


def paragraph_groups(blocks: DataFrame, by: str = "doc", order: str = "ord", text: str = "text") -> DataFrame:
    """blocks that continue a sentence are one paragraph; a finished sentence or a blank block ends it. Blank blocks have none."""
    w = W.partitionBy(by).orderBy(order)
    before = F.lag(text).over(w)
    start = before.isNull() | (F.trim(before) == "") | before.rlike(r"[.!?。！？…:;][\"')\]»”’]*\s*$")
    rows = blocks.withColumn("__s", F.when(start, 1).otherwise(0)).withColumn("paragraph", F.sum("__s").over(w)).drop("__s")
    return rows.withColumn("paragraph", F.when(F.trim(text) != "", F.col("paragraph")))


def median_size(sizes: Column, default: float = 10.0) -> Column:
    """The upper median of a block's font sizes."""
    known = F.array_sort(F.filter(sizes, lambda s: s.isNotNull() & (s != 0)))
    return F.when(F.size(known) > 0, F.element_at(known, (F.floor(F.size(known) / 2) + 1).cast("int"))).otherwise(F.lit(default))


def template_ids(controls: DataFrame) -> DataFrame:
    """``p1_c001``… by page and order."""
    n = F.row_number().over(W.partitionBy("page").orderBy("ord"))
    return controls.withColumn("control_id", F.format_string("p%d_c%03d", F.col("page") + 1, n))


def read_states(measures: DataFrame) -> DataFrame:
    """Readings from measured ink."""
    from ..functions.geometry import residual_state

    return measures.withColumn("r", residual_state(F.col("fill"), F.col("halo"))).select(*measures.columns, "r.state", "r.score")


def prompt_schema(options: Column) -> Column:
    """Columns that all rows share, named once, as JSON."""
    shared = F.size(F.array_distinct(options)) == 1
    return F.to_json(F.struct(F.when(shared, options[0]).alias("columns"), F.when(~shared, options).alias("rows")))


def hint_match(rows: DataFrame, hints: DataFrame) -> DataFrame:
    """A hint for each row by id, else by its normalised label."""
    by_id = hints.select(F.col("row_id"), F.col("hint").alias("h1"))
    by_label = hints.groupBy(X.alphanumeric(F.col("label")).alias("key")).agg(F.min("hint").alias("h2"))
    return rows.withColumn("key", X.alphanumeric(F.col("label"))).join(by_id, "row_id", "left").join(by_label, "key", "left").select("row_id", "label", F.coalesce("h1", "h2").alias("hint"))


def padding_collapsed(rows: Column) -> Column:
    """Rows ``array<struct(label, options)>`` without trailing ones that have neither label nor options."""
    return F.filter(rows, lambda r: (F.coalesce(F.trim(r["label"]), F.lit("")) != "") | (F.coalesce(F.size(r["options"]), F.lit(0)) > 0))


REPLY = ("questions array<struct<question_text: string, response_type: string, selection_rule: string, parent_question_index: int, condition_text: string, choices: array<struct<choice_text: string>>, "
         "rows: array<struct<row_text: string, extra_choices: array<struct<choice_text: string>>, marked_answers: array<struct<choice_position: int, choice_text: string, state: string, visual_mark: string, associated_text: string>>>>>>")


def form_options(replies: DataFrame) -> DataFrame:
    """O3, O2: a model's replies ``(page, section, reply)`` as options, a row each.

    Ids count from 1: ``p1_s1_q1``, ``p1_s1_q1_r1``, ``p1_s1_q1_r1_c2``. A mark belongs to the choice at its
    position, else to that of its text; options without a mark are unselected. A row needs review if a mark fits no
    choice, names another text than its position, is unclear, or if a rule of one choice has several. Defective
    questions (C24) are one row with their reason and no options. Replies without JSON give no rows.
    """
    q = replies.select("page", "section", F.from_json(X.json_object(F.col("reply")), REPLY).alias("r")).select("page", "section", F.posexplode("r.questions").alias("qi", "q"))
    labels = F.transform(F.coalesce("q.choices", F.array().cast("array<struct<choice_text:string>>")), lambda c: c["choice_text"])
    q = q.select("page", "section", F.format_string("p%d_s%d_q%d", "page", "section", F.col("qi") + 1).alias("group_id"), "q", labels.alias("labels"),
                 defect(F.col("q.question_text"), F.col("q.condition_text"), F.col("q.response_type"), F.col("q.selection_rule"), labels, F.col("q.rows")).alias("defect"))
    rows = q.select("group_id", "defect", F.col("q.question_text").alias("question"), F.col("q.selection_rule").alias("rule"), "labels", F.posexplode_outer(F.when(F.col("defect") == "", F.col("q.rows"))).alias("ri", "row"))
    more = F.transform(F.coalesce("row.extra_choices", F.array().cast("array<struct<choice_text:string>>")), lambda c: c["choice_text"])
    rows = rows.withColumn("all", F.concat("labels", more)).withColumn("marks", F.coalesce("row.marked_answers", F.expr("array()").cast("array<struct<choice_position:int,choice_text:string,state:string,visual_mark:string,associated_text:string>>")))
    same = lambda a, b: X.alphanumeric(F.coalesce(a, F.lit(""))) == X.alphanumeric(F.coalesce(b, F.lit("")))
    fits = lambda m, label, i: F.when(m["choice_position"].isNotNull(), m["choice_position"] == i + 1).otherwise(same(m["choice_text"], label))
    at = lambda m: F.try_element_at(F.col("all"), F.coalesce(F.nullif(m["choice_position"], F.lit(0)), F.lit(2**30)))
    lost = F.exists("marks", lambda m: F.when(m["choice_position"].isNotNull(), at(m).isNull() | (F.coalesce(m["choice_text"], F.lit("")) != "") & ~same(m["choice_text"], at(m))).otherwise(~F.exists("all", lambda c: same(c, m["choice_text"]))))
    unclear = F.exists("marks", lambda m: ~F.coalesce(m["state"], F.lit("")).isin("selected", "unselected"))
    chosen = F.size(F.filter("marks", lambda m: m["state"] == "selected"))
    rows = rows.withColumn("status", F.when(F.col("defect") != "", F.col("defect")).when(lost | unclear | (F.col("rule").isin("zero_or_one", "one_per_row") & (chosen > 1)), "needs_review").otherwise("observed"))
    mark = lambda label, i: F.get(F.filter("marks", lambda m: fits(m, label, i)), F.lit(0))
    options = F.transform("all", lambda c, i: F.struct(i.alias("i"), c.alias("label"), F.coalesce(mark(c, i)["state"], F.lit("unselected")).alias("state"), mark(c, i)["associated_text"].alias("associated_text")))
    out = rows.select("group_id", F.when(F.col("ri").isNotNull(), F.concat("group_id", F.format_string("_r%d", F.col("ri") + 1))).alias("row_id"), "question", F.col("row.row_text").alias("row"), "status",
                      F.explode_outer(F.when(F.col("ri").isNotNull(), options)).alias("o"))
    state = F.when(F.col("o.state").isin("selected", "unselected"), F.col("o.state")).when(F.col("o.state").isNotNull(), "ambiguous")
    return out.select("group_id", "row_id", F.when(F.col("o").isNotNull(), F.concat("row_id", F.format_string("_c%d", F.col("o.i") + 1))).alias("option_id"), "question", "row", F.col("o.label").alias("label"), state.alias("state"), "status", F.col("o.associated_text").alias("associated_text"))
