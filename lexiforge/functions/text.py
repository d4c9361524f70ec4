"""Text column functions: every one a native expression (columns in, column out)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mark glyphs and their states, sets of characters.
CHECKED_GLYPHS = "☑☒✓✔✗✘√●■▣▪◼✕⨯×"
UNCHECKED_GLYPHS = "☐□○◯▢▭▯❍◌◦"
OVERRIDE_GLYPH = "☒"
# Typographic characters and their Latin-1 stand-ins.
LATIN1 = {"‘": "'", "’": "'", "‚": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "-", "−": "-", " ": " ", "‹": "<", "›": ">"}
# yes/no pairs of binary questions.
YES_NO = [("ja", "nein"), ("yes", "no"), ("oui", "non"), ("sí", "no")]
WORD = r"[\p{L}\p{N}_]"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value made once, however often it is used: the optimiser may copy a column's expression into lambdas."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column, least: int = 3) -> Column:
    """Lower-case word tokens of at least ``least`` characters, without pure numbers."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{WORD}{{{least},}}"), F.lit(0))
    return F.filter(found, lambda t: ~t.rlike(r"^\p{N}+$"))


def without(words: Column, stop: list[str]) -> Column:
    """H2: tokens that aren't stopwords."""
    return F.filter(words, lambda t: ~t.isin(stop)) if stop else words


def comma_list(text: Column, separator: str = ",", lower: bool = True) -> Column:
    """Parts of a separated list, trimmed, without empty ones."""
    parts = F.transform(F.split(text, separator), lambda p: F.trim(F.lower(p) if lower else p))
    return F.filter(parts, lambda p: p != "")


def joined(items: Column, separator: str = "; ") -> Column:
    """List as text; null items are left out."""
    return F.array_join(items, separator)


def without_controls(text: Column) -> Column:
    """Without characters that XML forbids; tab, line feed and carriage return stay."""
    return F.regexp_replace(text, r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFE}\x{FFFF}]", "")


def alphanumeric(text: Column) -> Column:
    """Lower case, word characters only."""
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]", ""))


def layer_tokens(text: Column) -> Column:
    """White-space tokens without mark glyphs; those without a word character go."""
    stripped = F.transform(F.split(text, r"\s+"), lambda t: F.regexp_replace(t, f"[{CHECKED_GLYPHS}{UNCHECKED_GLYPHS}]", ""))
    return F.filter(stripped, lambda t: t.rlike(WORD))


def latin1(text: Column) -> Column:
    """I8: folded to Latin-1, trimmed."""
    plain = F.translate(F.replace(text, F.lit("…"), F.lit("...")), "".join(LATIN1), "".join(LATIN1.values()))
    return F.trim(F.regexp_replace(plain, r"[^\x{0}-\x{FF}]", ""))


def unescaped(text: Column) -> Column:
    """The common HTML entities as characters."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def escaped(text: Column) -> Column:
    """HTML-escaped."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def html_plain(html: Column) -> Column:
    """Text of HTML, scripts and styles left out, white space collapsed."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    open_ = F.when(html.contains("<"), F.regexp_replace(bare, r"(?s)<[^>]*>", " ")).otherwise(html)  # most cells have neither tags nor entities
    return F.trim(F.regexp_replace(F.when(html.contains("&"), unescaped(open_)).otherwise(open_), r"[\s\x{A0}]+", " "))


def html_rows(html: Column) -> Column:
    """Rows of the first table as arrays of cell texts; spans aren't expanded."""
    table = F.regexp_extract(html, r"(?is)<table\b[^>]*>(.*?)</table>", 1)
    rows = F.regexp_extract_all(table, F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    return F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_plain))


def slug(text: Column, other: str = "_") -> Column:
    """A safe file name."""
    return F.regexp_replace(text, r"[^A-Za-z0-9_.\-]+", other)


def base_name(path: Column) -> Column:
    """The last part of a path, whatever its separators."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def clean_label(text: Column, most: int = 70) -> Column:
    """Without leading mark glyphs or a lone O or 0, white space collapsed, cut at a word's end."""
    bare = F.regexp_replace(text, f"^[\\s{CHECKED_GLYPHS}{UNCHECKED_GLYPHS}]+", "")
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"^[Oo0]\s+", ""), r"\s+", " "))
    short = F.regexp_replace(F.substring(bare, 1, most), r"\s+\S*$", "")
    return F.when(F.length(bare) <= most, bare).otherwise(short)


def sentences(text: Column) -> Column:
    """Split after sentence punctuation and white space; trimmed, without empty ones."""
    return F.filter(F.transform(F.split(F.trim(text, F.lit("\n ")), r"(?<=[.!?。！？])\s+"), lambda s: F.trim(s)), lambda s: s != "")  # a bare F.trim would take the position for the characters to trim


def line_parts(text: Column) -> Column:
    """Runs of line breaks and what lies between them, in order."""
    return F.regexp_extract_all(text, F.lit(r"(\n+|[^\n]+)"), F.lit(1))


def word_count(text: Column) -> Column:
    """White-space words; null counts none."""
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(F.coalesce(text, F.lit(""))) / 4).cast("int"))


def question_number(text: Column) -> Column:
    """Number and mark of a numbered line, null if it has none."""
    number = F.regexp_extract(text, r"^\s*(\d{1,3})\s*[).:]", 1)
    mark = F.regexp_extract(text, r"^\s*\d{1,3}\s*([).:])", 1)
    return F.when(number != "", F.struct(number.cast("int").alias("number"), mark.alias("mark")))


def is_anchor(text: Column, is_title: Column) -> Column:
    """A numbered line opens a question; after a full stop only as a title, a question, or with a mark glyph."""
    q = question_number(text)
    sure = q["mark"].isin(")", ":")
    return F.coalesce(sure | is_title | text.contains("?") | text.rlike(f"[{CHECKED_GLYPHS}{UNCHECKED_GLYPHS}]"), F.lit(False)) & q.isNotNull()


def mark_glyphs(text: Column) -> Column:
    """(index, glyph, state) of every mark glyph, in order."""
    chars = F.transform(F.split(F.coalesce(text, F.lit("")), ""), lambda c, i: F.struct(
        i.alias("index"), c.alias("glyph"),
        F.when(c.isin(list(CHECKED_GLYPHS)), "checked").when(c.isin(list(UNCHECKED_GLYPHS)), "unchecked").alias("state")))
    return F.filter(chars, lambda m: m["state"].isNotNull())


def first_mark(text: Column) -> Column:
    """The state of a text's first mark glyph, null if it has none."""
    glyph = F.regexp_extract(text, f"[{CHECKED_GLYPHS}{UNCHECKED_GLYPHS}]", 0)
    return F.when(glyph.isin(list(CHECKED_GLYPHS)), "checked").when(glyph.isin(list(UNCHECKED_GLYPHS)), "unchecked")


def mark_state(text: Column) -> Column:
    """State and score that a text's check boxes show, null if none or ambiguous."""
    on, off = text.rlike(f"[{CHECKED_GLYPHS}]"), text.rlike(f"[{UNCHECKED_GLYPHS}]")
    as_ = lambda state, score: F.struct(F.lit(state).alias("state"), F.lit(score).alias("score"))
    return (F.when(text.rlike(r"\[\s*[xX×✓✔✗✘]\s*\]"), as_("checked", 0.9)).when(text.rlike(r"\[\s*\]"), as_("unchecked", 0.9))
            .when(on & ~off, as_("checked", 0.8)).when(off & ~on, as_("unchecked", 0.8)))


def question_text(text: Column) -> Column:
    """What stands before the first mark glyph."""
    return F.trim(F.regexp_extract(text, f"^([^{CHECKED_GLYPHS}{UNCHECKED_GLYPHS}]*)", 1))


def is_binary(text: Column, most: int = 260) -> Column:
    """A short text that offers a yes and a no."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0))
    pair = F.lit(False)
    for yes, no in YES_NO:
        pair = pair | (F.array_contains(words, yes) & F.array_contains(words, no))
    return pair & (F.length(text) <= most)


def scale_tokens(text: Column) -> Column:
    """Numbers of a printed scale."""
    return F.regexp_extract_all(text, F.lit(r"\d+(?:[.,]\d+)?"), F.lit(0))


def json_object(text: Column) -> Column:
    """The JSON of a model's answer: code fences go; else from the first to the last brace. Null if neither parses."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(text), r"^```[a-zA-Z]*\s*", ""), r"\s*```$", ""))
    inner = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    parsed = lambda t: F.when(F.try_parse_json(t).isNotNull() & (t != ""), t)
    return F.coalesce(parsed(bare), parsed(inner))


def clean_topics(topics: Column, most: int = 8) -> Column:
    """Topics trimmed, with a default category, confidence within 0 and 1; unlabelled ones go, at most ``most`` stay."""
    tidy = F.transform(topics, lambda t: F.struct(
        F.coalesce(F.nullif(F.trim(t["category"]), F.lit("")), F.lit("General")).alias("category"), F.trim(t["label"]).alias("label"),
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t["confidence"].try_cast("double"), F.lit(0.5)))).alias("confidence"),
        F.coalesce(F.trim(t["rationale"]), F.lit("")).alias("rationale")))
    return F.slice(F.filter(tidy, lambda t: t["label"].isNotNull() & (t["label"] != "")), 1, most)


def code_block(text: Column) -> Column:
    """The code of a fenced answer."""
    return F.regexp_extract(text, r"(?s)```(?:python)?\s*\n(.*?)```", 1)


def before_code(text: Column) -> Column:
    return F.trim(F.regexp_extract(text, r"(?s)^(.*?)(?:```|$)", 1))


def page_of(text: Column) -> Column:
    """(page, pages) of a footer, null if it has none."""
    page = F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 1)
    return F.when(page != "", F.struct(page.cast("int").alias("page"), F.regexp_extract(text, r"(\d+)\s*/\s*(\d+)", 2).cast("int").alias("pages")))


def has_text_layer(text: Column) -> Column:
    """At least 20 characters and 6 words."""
    return (F.length(F.trim(F.coalesce(text, F.lit("")))) >= 20) & (word_count(text) >= 6)


def is_corrupt(text: Column, most_private: int = 4) -> Column:
    """A control character, a replacement character, or several private-use glyphs."""
    private = F.regexp_count(text, F.lit(r"[\x{E000}-\x{F8FF}\x{F0000}-\x{FFFFD}\x{100000}-\x{10FFFD}]"))
    return F.coalesce(text.rlike(r"[\x{0}-\x{8}\x{B}\x{C}\x{E}-\x{1F}\x{FFFD}]") | (private >= most_private), F.lit(False))


def formula_safe(value: Column) -> Column:
    """Quoted when a spreadsheet would run it as a formula."""
    return F.when(value.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), value)).otherwise(value)


def rewritten_marks(text: Column, states: Column) -> Column:
    """Unchecked glyphs whose reconciled state is checked become checked; untouched if the counts differ."""
    marks = mark_glyphs(text)
    upgrade = F.filter(F.zip_with(marks, states, lambda m, s: F.when((s == "checked") & (m["state"] == "unchecked"), m["index"])), lambda x: x.isNotNull())
    chars = F.transform(F.split(text, ""), lambda c, i: F.when(F.array_contains(upgrade, i), OVERRIDE_GLYPH).otherwise(c))
    return F.when(F.size(marks) == F.size(states), F.array_join(chars, "")).otherwise(text)


def renamed_speakers(text: Column, names: dict[str, str]) -> Column:
    """Speaker labels as names, longest label first, whole labels only."""
    for old in sorted(names, key=len, reverse=True):
        text = F.regexp_replace(text, rf"(?i)\b\Q{old}\E\b", names[old].replace("\\", r"\\").replace("$", r"\$"))
    return text


def speakers(text: Column) -> Column:
    """Distinct speaker labels, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\bSPEAKER_\d+\b"), F.lit(0))))


def markdown_kind(line: Column) -> Column:
    """The kind of a markdown line outside fences."""
    return (F.when(line.rlike(r"^\s*(```|~~~)"), "fence").when(line.rlike(r"^\s{0,3}#{1,6}\s"), "heading")
            .when(line.rlike(r"^\s{0,3}([-*_])(\s*\1){2,}\s*$"), "rule").when(line.rlike(r"^\s*>"), "quote")
            .when(line.rlike(r"^\s*([-*+]|\d+[.)])\s"), "list").when(line.rlike(r"^\s*\|"), "table")
            .when(line.rlike(r"^\s*$"), "blank").otherwise("text"))


def translatable(cell: Column) -> Column:
    """A cell with words that isn't a formula."""
    return F.coalesce((F.trim(cell) != "") & ~cell.startswith("=") & cell.rlike(r"\p{L}"), F.lit(False))


def display_name(page: Column, pages: Column, question: Column, row: Column) -> Column:
    """``p1/4 Q10 row``; parts that are missing are left out."""
    return F.concat_ws(" ", F.concat(F.lit("p"), page.cast("string"), F.lit("/"), pages.cast("string")), question, F.nullif(F.trim(row), F.lit("")))
