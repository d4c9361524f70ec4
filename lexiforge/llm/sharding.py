"""Sharding as vector bin packing.

Groups of equal texts are vectors (bytes, tokens, rows); a token is a run of other characters than white space. Every group goes to the
shard whose residual capacity has the largest dot product with the group's
vector, both scaled by the totals. Groups are dealt to buckets of bounded size;
each bucket packs against its own share of every shard's capacity, so that
placing is parallel and each task holds a bounded number of groups. A group that
is larger than ``1 / whole`` of a shard in any dimension is first split into
pieces of ``1 / split`` of one, since no whole placement of a group of a third of all rows is level.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import written

#: Groups in a bucket, about. Items above 1/HEAD of a shard are packed first, in
#: one task: there can be at most 3 * shards * HEAD of them, whatever the input.
PER_BUCKET = 20_000
HEAD = 2048


def _place(room0: np.ndarray):
    """Packs one bucket's items into ``room0`` (shards x 3, as parts of the bucket's own totals)."""

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        v = pdf[["bytes", "tokens", "rows"]].to_numpy(float)
        v = v / np.maximum(v.sum(0), 1e-9)
        order = np.lexsort((pdf["piece"].to_numpy(), pdf["g2"].to_numpy(), pdf["g1"].to_numpy(), -v.max(1)))
        # Ties go to another shard first in each bucket, or shard 0 would get every bucket's largest item.
        turn = np.roll(np.arange(len(room0)), -int(pdf["bucket"].iloc[0]))
        room, out = room0[turn].copy(), np.empty(len(v), np.int32)
        for i in order:
            s = int(np.argmax(room @ v[i]))
            room[s] -= v[i]
            out[i] = turn[s]
        return pdf[["g1", "g2", "piece", "bytes", "tokens", "rows"]].assign(shard=out)

    return place


def shard_documents(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", whole: int = 3, split: int = 16, per_bucket: int = PER_BUCKET, head: int = HEAD, per_slot: int = 50_000) -> DataFrame:
    """Assign every row to one of ``shards`` shards with near equal bytes, words and rows.

    Returns one row per input row: the id, ``size`` (UTF-8 bytes of the text plus 8),
    ``text_crc32``, ``law`` (always ``bytes``), ``shard``, ``slot`` (gapless from 0
    within a shard) and ``grown_shard`` (null: only the law ``key`` has it).

    Equal texts share a shard unless their group exceeds ``1/whole`` of a shard;
    it is then dealt out in pieces of about ``1/split`` of one by row hash. Null text: no bytes, CRC 0,
    grouped with the empty text. Null and repeated ids: each row is placed as any other.
    Empty input: no rows. Other columns are ignored, whatever their names.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"), (F.octet_length(t).cast("long") + 8).alias("size"), F.crc32(t.cast("binary")).cast("long").alias("crc"),
        F.xxhash64(t).alias("g1"), F.xxhash64(F.lit(7), t).alias("g2"),
        F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"))
    rows = written(rows.withColumn("dealt", F.xxhash64("id", "g1")), "shard-rows")
    groups = rows.groupBy("g1", "g2").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows"))
    groups = written(groups, "shard-groups")
    n, *total = groups.agg(F.count("*"), F.sum("bytes"), F.sum("tokens"), F.sum("rows")).first()
    total = [float(x or 1) for x in total]
    share = F.greatest(*(F.col(c) / F.lit(x / shards) for c, x in zip(("bytes", "tokens", "rows"), total)))
    groups = groups.withColumn("pieces", F.when(share > 1 / whole, F.ceil(share * split)).otherwise(1).cast("int"))
    # At most 3 * shards * whole groups can be that large.
    large = F.broadcast(groups.where("pieces > 1").select("g1", "g2", "pieces"))
    rows = (rows.join(large, ["g1", "g2"], "left")
            .withColumn("piece", F.coalesce(F.pmod("dealt", F.col("pieces")), F.lit(0)).cast("int")).drop("pieces"))
    buckets = max(1, -(-n // per_bucket))
    cut = (rows.join(large, ["g1", "g2"]).groupBy("g1", "g2", "piece")
           .agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")))
    entire = groups.where("pieces = 1").select("g1", "g2", F.lit(0).alias("piece"), "bytes", "tokens", "rows")
    items = entire.unionByName(cut)
    share = F.greatest(*(F.col(c) / F.lit(x / shards) for c, x in zip(("bytes", "tokens", "rows"), total)))
    items = items.withColumn("bucket", F.when(share > 1 / head, 0).otherwise(1 + F.pmod(F.xxhash64("g1", "g2", "piece"), F.lit(buckets))).cast("int"))
    made = "g1 long, g2 long, piece int, bytes long, tokens long, rows long, shard int"
    heads = written(items.where("bucket = 0").groupBy("bucket").applyInPandas(_place(np.full((shards, 3), 1 / shards)), made), "shard-heads")
    used = np.zeros((shards, 3))
    for s, *x in heads.groupBy("shard").agg(F.sum("bytes"), F.sum("tokens"), F.sum("rows")).collect():  # a row for each shard
        used[s] = x
    left = np.maximum(np.array(total) - used.sum(0), 1)
    rest = items.where("bucket > 0").groupBy("bucket").applyInPandas(_place((np.array(total) / shards - used) / left), made)
    placed = heads.unionByName(written(rest, "shard-rest")).select("g1", "g2", "piece", "shard")
    out = rows.join(placed, ["g1", "g2", "piece"])
    # Slots: a count for each (shard, part) and its running sum, then a row number within the part.
    parts = max(1, -(-int(total[2]) // (shards * per_slot)))
    out = written(out.select("id", "size", "crc", "shard", "dealt", F.pmod("dealt", F.lit(parts)).cast("int").alias("part")), "shard-out")
    base = out.groupBy("shard", "part").count()
    base = base.select("shard", "part", (F.sum("count").over(W.partitionBy("shard").orderBy("part")) - F.col("count")).alias("base"))
    rank = F.row_number().over(W.partitionBy("shard", "part").orderBy("dealt", "id", "size", "crc"))
    return (out.withColumn("r", rank).join(base, ["shard", "part"])
            .select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard",
                    (F.col("base") + F.col("r") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")))
