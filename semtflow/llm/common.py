"""Words, checked broadcasts and shared-folder tables of the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semtflow.session import shared_dir

BLANKS = " \t\n\x0b\x0c\r"
#: Shared-folder tables up to this size may be broadcast.
BROADCAST_BYTES = 24 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(F.length(trimmed) > 0, F.split(trimmed, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))


def exploded(df: DataFrame, keep: list[str], items: Column, item: str, pos: str | None = None) -> DataFrame:
    """The named columns with a row per item, and its position from 0 if named.

    The outer form keeps the optimizer from testing the array's size below the projection that
    builds it, which would build it anew for every item.
    """
    if pos:
        return df.select(*keep, F.posexplode_outer(items).alias(pos, item)).filter(F.col(pos).isNotNull())
    return df.select(*keep, F.explode_outer(items).alias(item)).filter(F.col(item).isNotNull())


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def row_key() -> list[Column]:
    """_id and _th: a document's id (null as the smallest long) and a hash of its text."""
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th")]


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it back: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a narrow table; its files stay in the shared folder unless the session cleans checkpoints."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def packed(df: DataFrame) -> DataFrame:
    """As ``cut``, for rows of a few numbers: read back as a few partitions a core.

    A checkpoint has as many parts as the shuffle before it. Where most hold next to nothing, each
    later step would run a task for every part and cut its output into parts times partitions.
    """
    return cut(df).coalesce(4 * df.sparkSession.sparkContext.defaultParallelism)


def small(df: DataFrame, width: Column, most: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast if the materialized table is small enough; else leave a shuffle join.

    ``width`` is the size of a row in bytes.
    """
    size = df.agg(F.sum(width)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def placed(df: DataFrame, keys: list[str], order: list[Column], name: str) -> DataFrame:
    """Gapless position from 0 of every row within its key, in the given order.

    Rows are dealt by ranges of the order, not by key, so a key may hold any share of the
    rows. A range sorts its rows by key; counts per range and key give the offsets.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*keys, *order)
    ranged = cut(ranged.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id()))
    sizes = ranged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_c"), F.min("_m").alias("_m0"))
    before = F.sum("_c").over(Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_c")
    offsets = cut(sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_p").alias("_p1"), (before - F.col("_m0")).alias("_shift")))
    same = F.col("_p") == F.col("_p1")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    joined = ranged.join(small(offsets, F.lit(64)), same)
    return joined.withColumn(name, F.col("_m") + F.col("_shift")).drop("_p", "_p1", "_m", "_shift", *[f"_k_{k}" for k in keys])
