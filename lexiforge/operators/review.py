"""What reviewers see of a reading, and small choices and lookups around it: columns and joins only.

Every list that is gathered here belongs to one page, document, question or paper. A null label, text or title counts
as blank; empty tables give empty ones; other columns are carried along where rows are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Region types whose text is prose, and those whose text belongs in a text layer.
PROSE = ["text", "title", "footnote", "header", "footer", "list", "reference"]
LAYER = [*PROSE, "table"]

# Names that stand for a contract, and those of the contracts themselves.
CONTRACTS = {
    "schema-free-v1": "schema-free-v2",
    "schema-free": "schema-free-v2",
    "universal": "schema-free-v2",
    "paddle": "paddle-id-v1",
    "id-only": "paddle-id-v1",
    "schema-free-v2": "schema-free-v2",
    "paddle-id-v1": "paddle-id-v1",
}

# What the parts of a provenance are called.
PROVENANCE = {
    "text_recognition": "Text recognition",
    "figure_descriptions": "Figure descriptions",
    "text_layer": "Searchable-PDF word geometry",
}

# Language codes with script, and their two-letter codes.
LANGUAGES = {
    "eng_Latn": "en", "deu_Latn": "de", "fra_Latn": "fr", "ita_Latn": "it", "spa_Latn": "es", "por_Latn": "pt",
    "nld_Latn": "nl", "dan_Latn": "da", "swe_Latn": "sv", "nob_Latn": "no", "fin_Latn": "fi", "pol_Latn": "pl",
    "ces_Latn": "cs", "slk_Latn": "sk", "slv_Latn": "sl", "hrv_Latn": "hr", "bul_Cyrl": "bg", "ron_Latn": "ro",
    "hun_Latn": "hu", "ell_Grek": "el", "tur_Latn": "tr", "rus_Cyrl": "ru", "ukr_Cyrl": "uk", "arb_Arab": "ar",
    "heb_Hebr": "he", "pes_Arab": "fa", "urd_Arab": "ur", "hin_Deva": "hi", "zho_Hans": "zh", "jpn_Jpan": "ja",
    "kor_Hang": "ko", "vie_Latn": "vi", "tha_Thai": "th", "ind_Latn": "id", "swh_Latn": "sw", "cat_Latn": "ca",
    "eus_Latn": "eu",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[key]


def _blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def two_letters(code: Column) -> Column:
    """The two-letter code of a language code with script; null for others."""
    return _lookup(LANGUAGES, code)


def with_script(code: Column) -> Column:
    """The language code with script of a two-letter code; null for others."""
    return _lookup({v: k for k, v in LANGUAGES.items()}, code)


def regions_for(regions: DataFrame, types: list[str]) -> DataFrame:
    """C11: regions of the given types."""
    return regions.where(F.col("type").isin(types))


def prose(regions: DataFrame, *by: str) -> DataFrame:
    """The text a language is detected from, of each document or page (``by``): prose without blank regions, in order."""
    places = [c for c in ("page", "reading_order", "region_id") if c not in by]
    rows = regions_for(regions, PROSE).where(~_blank(F.col("content")))
    parts = F.array_sort(F.collect_list(F.struct(*places, "content")))
    return rows.groupBy(*by).agg(F.array_join(F.transform(parts, lambda p: p["content"]), " ").alias("text"))


def answer_order(rows: DataFrame, by: str = "document") -> DataFrame:
    """``position`` by scan page (none: 0), column of the spread and top edge; ties by row."""
    order = W.partitionBy(by).orderBy(F.coalesce("scan_page", F.lit(0)), "column", F.col("bbox")[1], "row_id")
    return rows.withColumn("position", F.row_number().over(order))


def detected_order(controls: DataFrame, band: float = 20.0) -> DataFrame:
    """``position`` of the controls of a page by bands of their top edges, then by left edge; ties by control."""
    order = W.partitionBy("document", "page").orderBy(F.floor(F.col("bbox")[1] / band), F.col("bbox")[0], "control_id")
    return controls.withColumn("position", F.row_number().over(order))


def first_sections(sections: DataFrame, most: int = 30) -> DataFrame:
    """The first sections of each page, by ``ord``."""
    place = F.row_number().over(W.partitionBy("document", "page").orderBy("ord"))
    return sections.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def cited_dois(papers: DataFrame) -> DataFrame:
    """D3: the DOI of each title that a paper cites; of equal titles the last, even without a DOI ('')."""
    cited = papers.select("paper_id", F.posexplode("citations").alias("at", "c"))
    cited = cited.select("paper_id", "at", F.trim("c.title").alias("title"), F.coalesce(F.trim("c.doi"), F.lit("")).alias("doi")).where("title <> ''")
    return cited.groupBy("paper_id", "title").agg(F.max(F.struct("at", "doi"))["doi"].alias("doi"))


def chosen(papers: DataFrame, choices: DataFrame) -> DataFrame:
    """Papers but those that ``choices(paper_id, chosen)`` leave out; a paper without a choice stays."""
    return papers.join(choices.where("not chosen").select("paper_id"), "paper_id", "left_anti")


def paired(left: DataFrame, right: DataFrame, by: str, order_left: str, order_right: str) -> DataFrame:
    """First with first, second with second, within ``by``; what has no partner goes. Orders are unique within ``by``."""
    number = lambda rows, order: rows.withColumn("position", F.row_number().over(W.partitionBy(by).orderBy(order)))
    return number(left, order_left).join(number(right, order_right), [by, "position"])


def contract_name(value: Column, default: str = "schema-free-v2") -> Column:
    """The contract that a name stands for; null or empty: the default; an unknown name is an error."""
    name = F.lower(F.trim(value))
    unknown = F.raise_error(F.concat(F.lit("unknown survey contract "), name)).cast("string")
    return F.when(F.coalesce(value, F.lit("")) == "", F.lit(default)).otherwise(F.coalesce(_lookup(CONTRACTS, name), unknown))


def gated(groups: DataFrame, model: Column, approved: list[str], warning: str = "model has not passed the release benchmark") -> DataFrame:
    """Groups read by a model that isn't approved need review and say so."""
    held = ~F.coalesce(model.isin([a.strip() for a in approved if a.strip()]), F.lit(False))
    warnings = F.coalesce("warnings", F.array().cast("array<string>"))
    return groups.withColumns({
        "status": F.when(held, F.lit("needs_review")).otherwise(F.col("status")),
        "warnings": F.when(held, F.array_append(warnings, F.lit(warning))).otherwise(warnings)})


def provenance_lines(provenance: Column) -> Column:
    """A line for each part of a provenance (map of lists) that holds something; null: ''."""
    words = lambda k: F.concat(F.upper(F.substring(k, 1, 1)), F.lower(F.substring(F.replace(k, F.lit("_"), F.lit(" ")), 2, 1 << 30)))
    held = F.filter(F.map_entries(provenance), lambda e: F.size(e["value"]) > 0)
    line = lambda e: F.concat(F.coalesce(_lookup(PROVENANCE, e["key"]), words(e["key"])), F.lit(": "), F.array_join(e["value"], ", "))
    return F.coalesce(F.array_join(F.transform(held, line), "\n"), F.lit(""))


def option_labels(options: Column) -> Column:
    """A label for each option: blank ones by their number, equal ones with it."""
    number = lambda i: (i + 1).cast("string")
    plain = F.transform(options, lambda o, i: F.when(_blank(o["label"]), F.concat(F.lit("option "), number(i))).otherwise(F.trim(o["label"])))
    twice = lambda x: F.size(F.filter(plain, lambda y: y == x)) > 1
    return F.transform(plain, lambda x, i: F.when(twice(x), F.concat(x, F.lit(" ["), number(i), F.lit("]"))).otherwise(x))


def _selected(options: Column) -> Column:
    return F.filter(options, lambda o: o["state"] == "selected")


def answer_summary(rows: Column) -> Column:
    """The answers of a question's rows (label, options) in a line."""
    marked = lambda r: F.filter(F.zip_with(option_labels(r["options"]), r["options"], lambda x, o: F.when(o["state"] == "selected", x)), lambda x: x.isNotNull())
    answer = lambda r: F.when(F.size(_selected(r["options"])) > 0, F.array_join(marked(r), " | ")).otherwise(F.lit("— no answer —"))
    one = lambda r: F.when(F.coalesce(r["label"], F.lit("")) == "", answer(r)).otherwise(F.concat(r["label"], F.lit(": "), answer(r)))
    return F.when(F.coalesce(F.size(rows), F.lit(0)) > 0, F.array_join(F.transform(rows, one), "; ")).otherwise(F.lit("— extraction failed —"))


def shared_options(question_type: Column, rule: Column, rows: Column) -> Column:
    """Whether a matrix fits one answer column: equal options in all rows, one selected at most."""
    first = option_labels(rows[0]["options"])
    fits = F.forall(rows, lambda r: (option_labels(r["options"]) == first) & (F.size(_selected(r["options"])) <= 1))
    single = (question_type == "matrix") & (F.coalesce(rule, F.lit("")) != "zero_or_more") & (F.size(rows) > 0)
    return F.coalesce(F.when(single, (F.size(first) > 0) & fits), F.lit(False))
