"""Mixing of sources to target weights by capped water-filling."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions.ordered import numbered
from semtflow.llm.common import cut, n_words, small

#: Rows that share a fine bucket of a source, on average.
BUCKET_ROWS = 4096


def cyclic_weights(sources: DataFrame, weights: tuple[int, ...] = (3, 1, 2)) -> DataFrame:
    """Weights dealt in turn to the sources in code-point order, null last."""
    ranked = numbered(sources.withColumn("_null", F.col("source").isNull()), ["_null", "source"], "_rn")
    weight = F.array(*[F.lit(float(w)) for w in weights])[F.pmod(F.col("_rn") - 1, F.lit(len(weights))).cast("int")]
    return ranked.select("source", "source_size", weight.alias("weight"))


def water_fill(sources: DataFrame, total: float, most: float) -> DataFrame:
    """Add ``target``: the total shared by weight, no source above ``most`` times its size.

    Sources above their cap are clamped and the excess is shared anew by weight until none is
    above. Only two sums leave each pass. If all are clamped the total is not reached.
    """
    cap = F.col("source_size") * F.lit(float(most))
    rows = cut(sources.withColumn("_full", F.col("weight") <= 0))
    n_full = -1
    while True:
        used, weight, now = rows.agg(
            F.sum(F.when(F.col("_full") & (F.col("weight") > 0), cap)), F.sum(F.when(~F.col("_full"), F.col("weight"))), F.count(F.when(F.col("_full"), 1))
        ).first()
        level = (total - (used or 0.0)) / weight if weight else 0.0
        if now == n_full or not weight:
            break
        n_full = now
        rows = rows.withColumn("_full", F.col("_full") | (F.col("weight") * F.lit(level) > cap))
    target = F.when(F.col("weight") <= 0, F.lit(0.0)).when(F.col("_full"), cap).otherwise(F.col("weight") * F.lit(level))
    return cut(rows.withColumn("target", target).drop("_full"))


def draw(seed: int) -> Column:
    """The order in which a source's documents are taken: md5 of the seed and the id (or text)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text:"), F.coalesce("text", F.lit(""))))))


def mix_plan(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: int = 42) -> DataFrame:
    """source, source_size, target, whole repetitions, and the draws that get one more.

    Every document of a source is taken ``whole`` times; those whose draw comes before
    ``cut_draw`` once more, so that the source's words meet its target within half a document.
    Words are counted per fine bucket of the draw first; only the bucket in which the target
    falls is looked at row by row, so no task sees a whole source.
    """
    rows = docs.select("source", n_words(F.col("text")).alias("size"), draw(seed).alias("draw"))
    n_rows = docs.count()
    bits = max(0, min(28, (max(1, n_rows) // BUCKET_ROWS).bit_length()))
    bucket = F.shiftright(F.conv(F.substring("draw", 1, 7), 16, 10).cast("long"), 28 - bits)
    tallies = cut(rows.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size")))
    sizes = tallies.groupBy("source").agg(F.sum("size").alias("source_size"))
    total = tallies.agg(F.sum("size")).first()[0] or 0
    goal = float(Fraction(str(share)) * total)
    plan = water_fill(cyclic_weights(sizes, weights), goal, most)
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    plan = plan.withColumn("whole", F.least(F.floor(ratio), F.lit(most)).cast("long"))
    plan = plan.withColumn("part", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    # the bucket in which the part ends
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = tallies.withColumn("before", F.sum("size").over(upto) - F.col("size"))
    p = plan.select(F.col("source").alias("_s"), "part")
    ends = run.join(p, F.col("source").eqNullSafe(F.col("_s"))).filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("size") >= F.col("part")))
    ends = cut(ends.select(F.col("source").alias("_s"), F.col("bucket").alias("_b"), "before", "part"))
    inner = rows.withColumn("bucket", bucket).join(small(ends, F.lit(128)), F.col("source").eqNullSafe(F.col("_s")) & (F.col("bucket") == F.col("_b")))
    inner = inner.groupBy("_s", "draw", "before", "part").agg(F.sum("size").alias("size"))  # rows with one draw go together
    row = Window.partitionBy("_s").orderBy("draw").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inner = inner.withColumn("ahead", F.col("before") + F.sum("size").over(row) - F.col("size"))
    last = inner.filter(F.col("ahead") + F.col("size") / 2 <= F.col("part")).groupBy("_s").agg(F.max("draw").alias("_last"))
    edge = ends.select("_s", F.lpad(F.lower(F.conv(F.shiftleft("_b", 28 - bits).cast("string"), 10, 16)), 7, "0").alias("_edge"))
    edge = edge.join(last.withColumnRenamed("_s", "_s2"), F.col("_s").eqNullSafe(F.col("_s2")), "left").select("_s", F.coalesce(F.col("_last"), F.col("_edge")).alias("cut_draw"))
    plan = plan.join(edge, F.col("source").eqNullSafe(F.col("_s")), "left")
    return cut(plan.select("source", "source_size", "target", "whole", F.coalesce("cut_draw", F.lit("")).alias("cut_draw")))


def mix_documents(docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[int, ...] = (3, 1, 2), seed: int = 42) -> DataFrame:
    """All columns of ``docs`` in ``row``, with size, source_size, target and repeats.

    Size is the number of words (null text: 0). Documents without words are taken like others
    and weigh nothing. A null source is a source of its own, last in order. Rows that agree in
    id (or, without id, in text) share their draw and so their fate. The same seed gives the
    same mix. An empty table gives no row.
    """
    plan = mix_plan(docs, share, most, weights, seed).withColumnRenamed("source", "_source")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), n_words(F.col("text")).alias("size"), F.col("source").alias("_of"), draw(seed).alias("_draw"))
    rows = rows.join(small(plan, F.lit(256)), F.col("_of").eqNullSafe(F.col("_source")))
    extra = F.col("_draw") <= F.col("cut_draw")
    return rows.select("row", "size", "source_size", "target", (F.col("whole") + F.when(extra, 1).otherwise(0)).alias("repeats"))


def repeat_documents(docs: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mix takes it."""
    out = mix_documents(docs, **settings)
    return out.select("row", F.explode_outer(F.sequence(F.lit(1).cast("long"), F.nullif("repeats", F.lit(0)))).alias("_nth")).filter("_nth IS NOT NULL").select("row.*")
