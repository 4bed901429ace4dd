"""Sharding by jump consistent hashing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import placed

#: Jumps tried before the longer, never yet needed, second walk.
JUMPS = 64


def jump_shard(key: Column, shards: int) -> Column:
    """The shard of a key, 0 to ``shards - 1``.

    From bucket b the key jumps to floor((b + 1) / r), where r in (0, 1] is a hash of (key, b);
    the last bucket below ``shards`` is the answer. The walk does not depend on ``shards``, so
    one more shard only takes rows into itself. About ln(shards) jumps are needed and never
    more than ``shards``. A null key walks like any other value.
    """
    n = F.lit(shards).cast("long")

    def step(s: Column, _: Column) -> Column:
        r = (F.shiftrightunsigned(F.xxhash64(key, s["j"]), 33) + 1) / F.lit(float(1 << 31))
        jump = F.struct(s["j"].alias("b"), F.floor((s["j"] + 1) / r).cast("long").alias("j"))
        return F.when(s["j"] < n, jump).otherwise(s)

    def walk(start: Column, most: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(most)), start, step)

    start = F.struct(F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))
    first = walk(start, min(JUMPS, shards))
    if shards > JUMPS:
        first = F.transform(F.array(first), lambda s: F.when(s["j"] < n, walk(s, shards)).otherwise(s))[0]
    return first["b"].cast("int")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row.

    Law ``key``: doc_id and the number of shards decide, whatever the text. Size is the UTF-8
    length of the text (null: 0) plus 16. Slots count each shard's rows from 0 in the order of
    (doc_id, text_crc32, size); null ids come first and share a shard; repeated rows each get a
    slot; other columns of ``docs`` are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.select("*", F.lit("key").alias("law"), jump_shard(F.col("doc_id"), shards).alias("shard"), jump_shard(F.col("doc_id"), shards + 1).alias("grown_shard"))
    out = placed(rows, ["shard"], [F.col("doc_id"), F.col("text_crc32"), F.col("size")], "slot")
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
