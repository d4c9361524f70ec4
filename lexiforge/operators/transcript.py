"""Transcripts: speaker turns, merged speech, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import timecode as C


def islands(df: DataFrame, group: list[str], order: list[str], change, name: str = "island") -> DataFrame:
    """Number the runs of rows within a group; ``change`` is true where a run starts."""
    w = W.partitionBy(*group).orderBy(*order)
    first = F.when(F.coalesce(change, F.lit(True)), 1).otherwise(0)
    return df.withColumn("__first", first).withColumn(name, F.sum("__first").over(w)).drop("__first")


def speaker_turns(words: DataFrame, doc: str = "doc", segment: str = "segment", order: str = "ord") -> DataFrame:
    """runs of one speaker within a segment: first start, last end, words joined; null speakers are UNKNOWN.

    ``segment_id`` numbers the turns of a document from 1.
    """
    w = W.partitionBy(doc, segment).orderBy(order)
    rows = words.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))
    rows = islands(rows.withColumn("__before", F.lag("speaker").over(w)), [doc, segment], [order], F.col("speaker") != F.col("__before"), "turn")
    turns = rows.groupBy(doc, segment, "turn").agg(F.first("speaker").alias("speaker"), F.min_by("start", order).alias("start"), F.max_by("end", order).alias("end"),
                                                  F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "word"))), lambda s: s["word"]), " ")).alias("text"))
    return turns.withColumn("segment_id", F.row_number().over(W.partitionBy(doc).orderBy(segment, "turn")))


def numbered_words(words: DataFrame, doc: str = "doc", segment: str = "segment", order: str = "ord") -> DataFrame:
    """words numbered within their turn, turns within their document."""
    w = W.partitionBy(doc).orderBy(segment, order)
    rows = words.withColumn("speaker", F.coalesce("speaker", F.lit("UNKNOWN")))
    change = (F.col("speaker") != F.lag("speaker").over(w)) | (F.col(segment) != F.lag(segment).over(w))
    rows = islands(rows.withColumn("__change", change), [doc], [segment, order], F.col("__change"), "segment_id").drop("__change")
    return rows.withColumn("word_id", F.row_number().over(W.partitionBy(doc, "segment_id").orderBy(segment, order)))


def merged_speech(spans: DataFrame, doc: str, start: str, end: str, pause: float) -> DataFrame:
    """spans merged while the gap to the one before is below ``pause`` (strictly); the end is that of the last one."""
    w = W.partitionBy(doc).orderBy(start, end)
    rows = islands(spans.withColumn("__gap", F.col(start) - F.lag(end).over(w)), [doc], [start, end], F.col("__gap") >= pause, "run").drop("__gap")
    return rows.groupBy(doc, "run").agg(F.min(start).alias("start"), F.max_by(end, F.struct(start, end)).alias("end"), F.count("*").alias("n"))


def ordered_text(rows: DataFrame, by: list[str], order: str, text: str, separator: str) -> DataFrame:
    """One text for each group, in order: a document's own lines."""
    items = F.array_sort(F.collect_list(F.struct(order, text)))
    return rows.groupBy(*by).agg(F.array_join(F.transform(items, lambda s: s[text]), separator).alias("text"))


def srt(segments: DataFrame, doc: str = "doc") -> DataFrame:
    """Subtitles; blank segments are left out and don't count."""
    rows = segments.where(F.trim("text") != "").withColumn("n", F.row_number().over(W.partitionBy(doc).orderBy("start", "ord")))
    cue = F.concat(F.col("n").cast("string"), F.lit("\n"), C.stamp(F.col("start")), F.lit(" --> "), C.stamp(F.col("end")), F.lit("\n"), F.trim("text"), F.lit("\n\n"))
    return ordered_text(rows.withColumn("cue", cue), [doc], "n", "cue", "")


def vtt(segments: DataFrame, doc: str = "doc") -> DataFrame:
    rows = segments.where(F.trim("text") != "")
    cue = F.concat(C.stamp(F.col("start"), "."), F.lit(" --> "), C.stamp(F.col("end"), "."), F.lit("\n"), F.trim("text"), F.lit("\n\n"))
    return ordered_text(rows.withColumn("cue", cue), [doc], "ord", "cue", "").withColumn("text", F.concat(F.lit("WEBVTT\n\n"), "text"))


def tsv(turns: DataFrame, doc: str = "doc") -> DataFrame:
    line = F.concat_ws("\t", F.col("segment_id").cast("string"), C.clock(F.col("start")), C.clock(F.col("end")), "speaker", "text")
    return ordered_text(turns.withColumn("line", line), [doc], "segment_id", "line", "\n").withColumn("text", F.concat(F.lit("segment_id\tStart\tEnd\tSpeaker\tText\n"), "text"))


def speaker_lines(turns: DataFrame, doc: str = "doc") -> DataFrame:
    """``SPEAKER: text`` lines of each document."""
    line = F.when(F.coalesce("speaker", F.lit("")) != "", F.concat("speaker", F.lit(": "), "text")).otherwise(F.col("text"))
    return ordered_text(turns.withColumn("line", line), [doc], "segment_id", "line", "\n")


def assigned_speakers(words: DataFrame, turns: DataFrame, doc: str = "doc", bucket: float = 30.0) -> DataFrame:
    """The speaker whose turn overlaps a word longest (ties: the earlier turn). A range join on buckets of time."""
    cut = lambda df, a, b: df.withColumn("__b", F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket))))
    w = cut(words.withColumnsRenamed({"start": "ws", "end": "we"}), "ws", "we")
    t = cut(turns.select(doc, F.col("start").alias("ts"), F.col("end").alias("te"), F.col("speaker").alias("who")), "ts", "te")
    over = F.least("we", "te") - F.greatest("ws", "ts")
    best = w.join(t, [doc, "__b"]).where("ws < te and we > ts").groupBy(doc, "ord").agg(F.max_by("who", F.struct(over, -F.col("ts"))).alias("speaker"))
    return words.drop("speaker").join(best, [doc, "ord"], "left")


def active_at(items: DataFrame, times: DataFrame, doc: str = "doc") -> DataFrame:
    """The first item that holds each time."""
    hit = times.join(items, doc).where((F.col("t") >= F.col("start")) & (F.col("t") < F.col("end")))
    return hit.groupBy(doc, "t").agg(F.min_by("text", F.struct("start", "ord")).alias("text"))


def conversation_markdown(turns: DataFrame, conv: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each conversation as markdown, its turns in order."""
    block = F.concat(F.lit("**"), F.initcap("role"), F.lit("**\n\n"), F.coalesce("text", F.lit("")))
    return ordered_text(turns.withColumn("block", block), [conv], turn, "block", "\n\n---\n\n")


def chunk_plan(docs: DataFrame, text: str = "text", most_tokens: int = 75_000) -> DataFrame:
    """Whether a text needs chunks, by its token estimate."""
    from ..functions.text import token_estimate

    n = token_estimate(F.col(text))
    return docs.withColumn("tokens", n).withColumn("mode", F.when(n > most_tokens, "chunked").otherwise("direct"))


def regrouped(parts: DataFrame, owner: list[str], order: str = "part", text: str = "text", separator: str = " ") -> DataFrame:
    """Parts back as their owner's text."""
    return ordered_text(parts, owner, order, text, separator)


def words_tsv(words: DataFrame, doc: str = "doc") -> DataFrame:
    """Numbered words as a table; ``words`` as numbered_words() gives them, with ``word``, ``start`` and ``end``."""
    line = F.concat_ws("\t", F.col("segment_id").cast("string"), F.col("word_id").cast("string"), C.clock(F.col("start")), C.clock(F.col("end")), "word", "speaker")
    rows = words.withColumn("line", line).withColumn("__at", F.struct("segment_id", "word_id"))
    return ordered_text(rows, [doc], "__at", "line", "\n").withColumn("text", F.concat(F.lit("segment_id\tword_id\tStart\tEnd\tWord\tSpeaker\n"), "text"))
