"""Scans: delimited text, JSON, documents, archives, transcripts, papers, templates."""

from __future__ import annotations

import io
import zipfile
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delimited import read_delimited  # noqa: F401  the scans of this package are found here

# Limits of an archive.
MEMBERS, MEMBER_BYTES, TOTAL_BYTES, RATIO = 1000, 500 << 20, 1 << 30, 200


def _together(frames: list[DataFrame]) -> DataFrame:
    """The rows of one or two frames by column name; a column of two types becomes text."""
    if len(frames) == 1:
        return frames[0]
    kinds = [dict(f.dtypes) for f in frames]
    mixed = {c for c, k in kinds[0].items() if kinds[1].get(c, k) != k}
    cast = lambda f: f.select(*[F.col(f"`{c}`").cast("string").alias(c) if c in mixed else F.col(f"`{c}`") for c in f.columns])
    return cast(frames[0]).unionByName(cast(frames[1]), allowMissingColumns=True)


def read_json(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """Each file as JSON lines where its first line that isn't blank is a whole value, else as one document.

    A broken line of a file of JSON lines is a row with ``_corrupt_record``; its other lines are read as ever.
    """
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), place.alias("at"), "value").where("trim(value) <> ''")
    first = rows.groupBy("file").agg(F.min_by("value", "at").alias("value"))
    kinds = first.select("file", F.try_parse_json("value").isNotNull().alias("lines")).collect()  # a row for each file
    reader = spark.read.schema(schema) if schema else spark.read
    frames = []
    for lines in (True, False):
        if files := [r["file"] for r in kinds if r["lines"] == lines]:
            frames.append(reader.option("multiLine", not lines).json(files))
    return _together(frames) if frames else reader.json(path)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``(Filename, Text)``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return raw.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("Filename"), F.make_valid_utf8(F.col("content").cast("string")).alias("Text"))


def list_documents(spark: SparkSession, folder: str, suffixes=("pdf", "png", "jpg", "jpeg", "tif", "tiff")) -> DataFrame:
    """Documents below a folder by suffix; names that begin with ``._`` are left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", "modificationTime")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return raw.withColumn("name", name).where(~name.startswith("._") & F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).isin(*suffixes)).orderBy(F.lower("path"))


def members_of(content: bytes, suffixes=(".txt",)) -> list[tuple[str, bytes]]:
    """(name, bytes) of an archive's safe members with a suffix; ValueError where one breaks a limit."""
    out, seen, total = [], set(), 0
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        infos = [i for i in z.infolist() if not i.is_dir()]
        if len(infos) > MEMBERS:
            raise ValueError(f"more than {MEMBERS} members")
        for i in infos:
            path = PurePosixPath(i.filename.replace("\\", "/"))
            if path.is_absolute() or ".." in path.parts or ":" in path.parts[0]:
                raise ValueError(f"{i.filename} leaves the archive")
            if (i.external_attr >> 16) & 0o170000 == 0o120000 or i.flag_bits & 1:
                raise ValueError(f"{i.filename} is a link or encrypted")
            if str(path).casefold() in seen:
                raise ValueError(f"{i.filename} stands twice")
            seen.add(str(path).casefold())
            total += i.file_size
            if i.file_size > MEMBER_BYTES or total > TOTAL_BYTES or i.file_size > RATIO * max(1, i.compress_size):
                raise ValueError(f"{i.filename} is too large")
            if path.suffix.lower() in suffixes and not path.name.startswith("._") and "__MACOSX" not in path.parts:
                out.append((str(path), z.read(i)))
    return out


def _texts(frames):
    for pdf in frames:
        rows = []
        for archive, content in zip(pdf["path"], pdf["content"]):
            try:
                found = members_of(bytes(content))
            except (ValueError, zipfile.BadZipFile) as e:
                rows.append((archive, None, None, str(e)))
                continue
            for name, data in found:
                text = data.decode("utf-8", "ignore")
                if text.strip():
                    rows.append((archive, name, text, None))
        yield pd.DataFrame(rows, columns=["archive", "Filename", "Text", "error"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Texts of ZIP archives, ``(archive, Filename, Text, error)``; blank ones are left out, a bad archive is a row with its error."""
    raw = spark.read.format("binaryFile").load(path).select("path", "content")
    return raw.mapInPandas(_texts, "archive string, Filename string, Text string, error string")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Transcript tables whatever their headers' case; ``speaker`` only if the first row has one."""
    from ..functions.timecode import seconds_of

    df = spark.read.option("header", True).option("sep", "\t").option("quote", '"').csv(path)
    by = {c.strip().lower(): c for c in df.columns}
    col = lambda n: F.col(f"`{by[n]}`") if n in by else F.lit(None).cast("string")
    out = df.select(col("segment_id").cast("int").alias("segment_id"), seconds_of(col("start")).alias("start"), seconds_of(col("end")).alias("end"), col("speaker").alias("speaker"), col("text").alias("text"))
    first = out.orderBy("segment_id").first()
    return out if first and first["speaker"] else out.drop("speaker")


def read_papers(spark: SparkSession, folder: str) -> DataFrame:
    """``P*/metadata.json`` below a folder, with the file's name."""
    return spark.read.option("multiLine", True).json(f"{folder}/P*/metadata.json").withColumn("source_file", F.col("_metadata.file_path"))


def read_template(spark: SparkSession, path: str) -> DataFrame:
    """Controls of a survey template, a row each, with their row's rule and label.

    The file holds ``pages[{page_index, controls[...]}]`` and the maps ``rules`` and ``row_labels``.
    """
    control = "id string, row_id string, question_id string, label string, shape string, bbox array<double>"
    schema = f"pages array<struct<page_index int, controls array<struct<{control}>>>>, rules map<string, string>, row_labels map<string, string>"
    t = spark.read.schema(schema).option("multiLine", True).json(path)
    rows = t.select("rules", "row_labels", F.explode("pages").alias("p")).select("rules", "row_labels", F.col("p.page_index").alias("page"), F.posexplode("p.controls").alias("ord", "c"))
    return rows.select("page", "ord", F.col("c.id").alias("control_id"), "c.row_id", "c.question_id", "c.label", "c.shape", "c.bbox",
                       F.coalesce(F.try_element_at("rules", F.col("c.row_id")), F.lit("single")).alias("rule"), F.try_element_at("row_labels", F.col("c.row_id")).alias("row_label"))


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    """A5."""
    return df.limit(n)


def table_markdown(df: DataFrame, most: int = 100) -> str:
    """The first rows as a markdown table, with a note where there are more."""
    rows = df.limit(most + 1).collect()
    head = ["| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
    body = ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows[:most]]
    return "\n".join(head + body + [f"… truncated to {most} rows"] * (len(rows) > most))


def context(files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """Files ``(ord, name, text, length)`` as blocks with banners; too large ones are a warning."""
    block = F.when(F.col("length") > most_bytes, F.concat(F.lit("[skipped "), "name", F.lit(": too large]"))).otherwise(
        F.concat(F.lit("--- "), "name", F.lit(" ---\n"), "text", F.lit("\n--- end of "), "name", F.lit(" ---")))
    return files.select("ord", "name", block.alias("block"))


def merged_config(base: dict, own: dict) -> dict:
    """Settings by section, own keys over base ones; lists are replaced."""
    return {k: {**base.get(k, {}), **v} if isinstance(v, dict) and isinstance(base.get(k, {}), dict) else v for k, v in {**base, **own}.items()}


# ------------------------------------------------------------ office files, by their XML

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_DOC = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def _active_sheet(z: zipfile.ZipFile) -> str:
    """The member of a workbook's active sheet; without a workbook part, of the first by number."""
    import re
    from xml.etree import ElementTree

    names = [n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)]
    try:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        view = next(book.iter(f"{_MAIN}workbookView"), None)
        sheet = list(book.iter(f"{_MAIN}sheet"))[int(view.get("activeTab", 0)) if view is not None else 0]
        target = targets[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"
    except (KeyError, IndexError, StopIteration):
        return min(names, key=lambda n: int(re.findall(r"\d+", n)[-1]))


def sheet_rows_of(content: bytes, most: int | None = None) -> list[list[str | None]]:
    """A2: cell texts of a workbook's active sheet, row by row; the first row is its header. ``most``: rows to stop after."""
    import re
    from xml.etree import ElementTree

    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_MAIN}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
        sheet = _active_sheet(z)
        out = []
        with z.open(sheet) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_MAIN}row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(f"{_MAIN}c"):
                    at = 0
                    for letter in re.match("[A-Z]*", c.get("r", ""))[0]:
                        at = 26 * at + ord(letter) - 64
                    cells += [None] * (max(at, len(cells) + 1) - 1 - len(cells))
                    v, text = c.find(f"{_MAIN}v"), "".join(t.text or "" for t in c.iter(f"{_MAIN}t"))
                    kind = c.get("t")
                    cells.append(shared[int(v.text)] if kind == "s" and v is not None else text if kind == "inlineStr" else v.text if v is not None else None)
                out.append(cells)
                row.clear()
                if most is not None and len(out) > most:
                    break
    return out


def read_sheets(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """A2: workbooks as ``(path, row, cells array<string>)``; row 0 is the header. A bad file has one row with null cells."""

    def rows(frames):
        for pdf in frames:
            for p, content in zip(pdf["path"], pdf["content"]):
                try:
                    found = sheet_rows_of(bytes(content), most)
                except Exception:  # not a workbook
                    found = [None]
                yield pd.DataFrame({"path": p, "row": range(len(found)), "cells": found})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "path string, row int, cells array<string>")


def document_text_of(name: str, content: bytes) -> str:
    """Text of .txt, .md, .csv, .tsv, .srt, .vtt and .docx files; ValueError for others."""
    from xml.etree import ElementTree

    suffix = PurePosixPath(name).suffix.lower()
    if suffix in (".txt", ".md", ".csv", ".tsv", ".srt", ".vtt"):
        return content.decode("utf-8-sig", "replace")
    if suffix == ".docx":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
        return "\n".join("".join(t.text or "" for t in p.iter(f"{_DOC}t")) for p in root.iter(f"{_DOC}p"))
    raise ValueError(f"no reader for {suffix or name}")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(Filename, Text, error)`` of files by their suffix."""

    def rows(frames):
        for pdf in frames:
            out = []
            for p, content in zip(pdf["path"], pdf["content"]):
                name = p.rsplit("/", 1)[-1]
                try:
                    out.append((name, document_text_of(name, bytes(content)), None))
                except Exception as e:  # a bad file is a row with its error
                    out.append((name, None, str(e)))
            yield pd.DataFrame(out, columns=["Filename", "Text", "error"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(rows, "Filename string, Text string, error string")
