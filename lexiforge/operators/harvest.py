"""Texts and boxes of nested results whose shape isn't known, as tables.

A result is JSON text of any shape. It is parsed to a variant and opened level by level, as many levels as the deepest one has,
so that every node is a row with its keys and places. What a key means is looked up in lists of aliases.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G

# Keys of recognised texts and the aliases of a block's parts, the first one that has a value wins.
LIST_KEYS, TEXT_KEY = ["rec_texts", "texts"], "text"
BLOCK = {"label": ["block_label", "label"], "content": ["block_content", "content"], "bbox": ["block_bbox", "bbox"], "score": ["block_score", "score"]}
BOX = {"label": ["label"], "score": ["score"], "bbox": ["coordinate", "bbox"]}


def brackets(json: Column) -> Column:
    """The brackets of a JSON text's containers, without all else; text in quotes doesn't count."""
    bare = F.regexp_replace(F.regexp_replace(json, r"\\.", ""), r'"[^"]*"', "")
    return F.regexp_replace(bare, r"[^\[\]{}]+", "")


def depth(json: Column) -> Column:
    """How deep the containers of a JSON text, or of its brackets alone, nest."""
    marks = F.split(brackets(json), "")

    def step(acc, c):
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(marks, F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda a: a["most"])


def nodes(docs: DataFrame, id_col: str, json: str) -> DataFrame:
    """Every node below the root: ``(id, keys, place, kind, value)``.

    ``keys`` are lower-cased names on the way down (null for list items), ``place`` the positions, which order nodes: items of a list as they
    stand, members of an object by name; ``kind`` is the value's type. Text that isn't JSON, and null, has no nodes. One pass finds the deepest text.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.try_parse_json(F.col(json)).alias("value"), F.col(json).alias("__t")).where("value is not null")
    shapes = rows.select(brackets(F.col("__t")).alias("shape")).distinct()  # alike texts are followed once
    levels = shapes.agg(F.max(depth(F.col("shape")))).first()[0] or 0
    spark = docs.sparkSession
    level = rows.select("id", F.array().cast("array<string>").alias("keys"), F.array().cast("array<int>").alias("place"), "value")
    out = None
    for _ in range(levels):
        # Objects and lists alike: an item has a position, and a key if it is a member.
        level = spark.sql("select t.id, concat(t.keys, array(lower(e.key))) as keys, concat(t.place, array(e.pos)) as place, e.value from {level} t, lateral variant_explode(t.value) e", level=level)
        out = level if out is None else out.unionByName(level)
    if out is None:
        out = level.limit(0)
    return out.withColumn("kind", F.regexp_extract(F.schema_of_variant("value"), r"^\w+", 0))


def _key(up: int = 0) -> Column:
    return F.try_element_at("keys", F.lit(-1 - up))


def texts(found: DataFrame) -> DataFrame:
    """``(id, ord, text)``: strings under a text key, and all scalars of lists under a key for texts; trimmed, without empty ones, in order."""
    scalar = ~F.col("kind").isin("OBJECT", "ARRAY", "VOID")
    listed = _key().isNull() & F.coalesce(_key(1).isin(LIST_KEYS), F.lit(False)) & scalar
    own = F.coalesce(_key().isin(*LIST_KEYS, TEXT_KEY), F.lit(False)) & (F.col("kind") == "STRING")
    text = F.trim(F.regexp_replace(F.variant_get("value", "$", "string"), r"^\s+|\s+$", ""))
    return _numbered(found.where(listed | own).select("id", "place", text.alias("text")).where("text <> ''"))


def _numbered(rows: DataFrame) -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct("place", *[c for c in rows.columns if c not in ("id", "place")])))
    out = rows.groupBy("id").agg(items.alias("items")).select("id", F.posexplode("items").alias("ord", "item"))
    return out.select("id", "ord", *[f"item.{c}" for c in rows.columns if c not in ("id", "place")])


def boxes(found: DataFrame) -> DataFrame:
    """``(id, ord, bbox)``: boxes around polygons: lists of two points and more, or lists of four or of eight and more numbers."""
    # Only lists can be read as lists, so the kind, for which a node's whole value would be described, isn't asked for.
    # Each step is exploded as a list of one: written into one another, a value would be read again wherever it is named.
    read = F.struct(F.try_variant_get("value", "$", "array<double>").alias("flat"), F.try_variant_get("value", "$", "array<array<double>>").alias("points"))
    lists = found.select("id", "place", F.inline(F.array(read)))
    whole = lambda a: ~F.exists(a, lambda x: x.isNull())
    points = F.when((F.size("points") >= 2) & F.forall("points", lambda p: (F.size(p) == 2) & whole(p)), F.flatten("points"))
    flat = F.when(((F.size("flat") == 4) | (F.size("flat") >= 8)) & whole(F.col("flat")), F.col("flat"))
    rows = lists.select("id", "place", F.explode(F.array(F.coalesce(points, flat))).alias("numbers")).where("numbers is not null")
    return _numbered(rows.select("id", "place", F.explode(F.array(G.box(F.col("numbers")))).alias("bbox")).where(F.size("bbox") == 4))


def _member(value: Column, names: list[str], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(value, f"$.{n}", kind) for n in names])


def _parts(docs: DataFrame, id_col: str, json: str, paths: list[str]) -> DataFrame:
    """Items of the first list at one of the paths, below ``res`` or at the top."""
    parsed = F.try_parse_json(F.col(json))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.try_variant_get(parsed, "$.res", "variant"), parsed).alias("v"))
    items = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in paths])
    return rows.select("id", F.posexplode(items).alias("ord", "value")).where(F.schema_of_variant("value").startswith("OBJECT"))


def blocks(docs: DataFrame, id_col: str, json: str) -> DataFrame:
    """Parsed blocks ``(id, ord, label, content, bbox, block_order, score)`` whichever of their aliases the result uses."""
    rows, v = _parts(docs, id_col, json, ["$.parsing_res_list"]), F.col("value")
    filled = lambda names: F.coalesce(*[F.nullif(F.try_variant_get(v, f"$.{n}", "string"), F.lit("")) for n in names])
    return rows.select("id", "ord", filled(BLOCK["label"]).alias("label"), F.coalesce(_member(v, BLOCK["content"], "string"), F.lit("")).alias("content"), G.box(_member(v, BLOCK["bbox"], "array<double>")).alias("bbox"),
                       F.try_variant_get(v, "$.block_order", "int").alias("block_order"), _member(v, BLOCK["score"], "double").alias("score"))


def layout_boxes(docs: DataFrame, id_col: str, json: str) -> DataFrame:
    """Detected boxes ``(id, ord, label, score, bbox, cls_id)``; the layout is a list or an object with one."""
    rows, v = _parts(docs, id_col, json, ["$.layout_det_res.boxes", "$.layout_det_res"]), F.col("value")
    return rows.select("id", "ord", _member(v, BOX["label"], "string").alias("label"), _member(v, BOX["score"], "double").alias("score"), G.box(_member(v, BOX["bbox"], "array<double>")).alias("bbox"),
                       F.try_variant_get(v, "$.cls_id", "int").alias("cls_id"))
