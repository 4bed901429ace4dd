"""Structured Streaming forms of the cascade and of the event analytics (N).

Windows run as streaming aggregates with a watermark. Per-pattern state that
depends on order (thresholds, alerts) is merged batch by batch into a small
table of one row per pattern, so a hot pattern is pre-aggregated over many
tasks instead of being folded in one. Each batch writes its own state version;
a retried batch reads the version before it and overwrites its own.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.operators import cascade
from semtflow.operators import thresholds as th
from semtflow.operators.geo import Dims
from semtflow.session import shared_dir

LATENESS = "5 minutes"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def normalize_stream(addresses: DataFrame, dims: Dims | None = None) -> DataFrame:
    """The cascade over a feed, with the same answers as in batch."""
    return cascade.normalize_addresses(addresses, dims)


def with_lateness(events: DataFrame, delay: str = LATENESS) -> DataFrame:
    """Events later than the delay are dropped; state older than it is released."""
    return events.withWatermark("ts", delay)


def _ok():
    return F.col("success").cast("int")


def metrics_stream(events: DataFrame, every: str = "60 seconds", delay: str = LATENESS) -> DataFrame:
    """Counts, rates and times per interval and method."""
    return with_lateness(events, delay).groupBy(F.window("ts", every).alias("w"), "method").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_ok()).alias("success_rate"), F.avg("processing_time_ms").alias("avg_ms"),
        F.avg("confidence").alias("avg_confidence"), F.percentile_approx("processing_time_ms", 0.95, 1000).alias("p95_ms"),
    ).select(F.col("w.start").alias("start"), "method", "n", "success_rate", "avg_ms", "avg_confidence", "p95_ms")


def grain_stream(events: DataFrame, grain: str, delay: str = LATENESS) -> DataFrame:
    """Totals per pattern and tumbling window (``1 hour`` or ``1 day``)."""
    return with_lateness(events, delay).groupBy(F.window("ts", grain).alias("w"), "pattern_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.avg(_ok()).alias("success_rate"),
    ).select(F.col("w.start").alias("start"), "pattern_id", "total", "successful", "success_rate")


def recent_trend_stream(events: DataFrame, span: str = "60 minutes", slide: str = "5 minutes", delay: str = LATENESS) -> DataFrame:
    """Success, confidence and time per pattern over a sliding window."""
    return with_lateness(events, delay).groupBy(F.window("ts", span, slide).alias("w"), "pattern_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_ok()).alias("success_rate"), F.avg("confidence").alias("avg_confidence"),
        F.avg("processing_time_ms").alias("avg_ms"),
    ).select(F.col("w.end").alias("end"), "pattern_id", "n", "success_rate", "avg_confidence", "avg_ms")


def layer_usage_stream(history: DataFrame, every: str = "1 hour", delay: str = LATENESS) -> DataFrame:
    """Rows and failures per layer and interval. History: ts, layer, success."""
    return with_lateness(history, delay).groupBy(F.window("ts", every).alias("w"), "layer").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("success")).alias("failures"),
    ).select(F.col("w.start").alias("start"), "layer", "n", "failures")


# --- state tables merged per batch ------------------------------------------


#: Versions kept of a state table: the one being written, the one it reads, and one spare.
SLOTS = 3


def _previous(spark: SparkSession, path: str, epoch: int, schema: str) -> DataFrame:
    """The newest state version before this batch; the slot that this batch writes is not read."""
    for k in range(SLOTS):  # a slot not yet written is an empty table
        spark.createDataFrame([], f"{schema}, epoch long").write.mode("ignore").parquet(f"{path}/slot={k}")
    others = [f"{path}/slot={k}" for k in range(SLOTS) if k != epoch % SLOTS]
    before = spark.read.schema(f"{schema}, epoch long").parquet(*others).filter(F.col("epoch") < epoch)
    last = before.agg(F.max("epoch")).first()[0]
    return before.filter(F.col("epoch") == F.lit(last)).drop("epoch")


def _save(state: DataFrame, path: str, epoch: int) -> None:
    """Write this batch's version over the oldest one; a retried batch overwrites its own."""
    state.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{path}/slot={epoch % SLOTS}")


def ema_threshold_batches(state: str) -> Callable[[DataFrame, int], None]:
    """Merge a batch of events into (ema, seen) per pattern and write the thresholds they imply.

    After n new outcomes the mean is old x 0.9^n plus the batch's own weighted
    sum, which the batch form already computes without ordering a whole pattern.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        old = _previous(spark, state, epoch, "pattern_id string, ema double, seen long, last_updated timestamp, threshold double")
        fresh = th.ema_last(batch, {"plain": F.col("success").cast("int")}).join(
            th.ema_last(batch, {"seeded": F.col("success").cast("int")}, seeded=True), "pattern_id"
        ).join(batch.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("newest")), "pattern_id")
        j = old.join(fresh, "pattern_id", "full_outer")
        n = F.coalesce("n", F.lit(0))
        ema = F.when(F.col("ema").isNull(), F.col("seeded")).otherwise(F.col("ema") * F.pow(F.lit(0.9), n) + F.coalesce("plain", F.lit(0.0)))
        seen = F.coalesce("seen", F.lit(0)) + n
        out = j.select("pattern_id", ema.alias("ema"), seen.alias("seen"), F.greatest("last_updated", "newest").alias("last_updated"))
        moved = F.greatest(F.lit(th.LOW), F.least(F.lit(th.HIGH), th.DEFAULT_THRESHOLD - (F.col("ema") - 0.5) * th.ADJUSTMENT))
        out = out.withColumn("threshold", F.when(F.col("seen") >= th.MIN_SAMPLES, moved).otherwise(th.DEFAULT_THRESHOLD))
        _save(out, state, epoch)

    return merge


def alert_batches(state: str, alerts: str, low_success: float = 0.5, low_confidence: float = 0.3) -> Callable[[DataFrame, int], None]:
    """Keep running totals per pattern; write an alert only when none of its (type, pattern) is active."""

    def merge(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        schema = "pattern_id string, n long, s long, conf double, ms double"
        old = _previous(spark, state, epoch, schema)
        fresh = batch.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("bn"), F.count_if("success").alias("bs")).join(
            th.ema_last(batch, {"bc": F.col("confidence"), "bt": F.col("processing_time_ms")}), "pattern_id")
        decay = F.pow(F.lit(0.9), F.coalesce("bn", F.lit(0)))
        zero = lambda c: F.coalesce(c, F.lit(0))
        now = old.join(fresh, "pattern_id", "full_outer").select(
            "pattern_id", (zero("n") + zero("bn")).alias("n"), (zero("s") + zero("bs")).alias("s"),
            (zero("conf") * decay + zero("bc")).cast("double").alias("conf"), (zero("ms") * decay + zero("bt")).cast("double").alias("ms"))
        _save(now, state, epoch)
        stats = _previous(spark, state, epoch + 1, schema).withColumn("sr", F.col("s") / F.col("n"))
        kept = "type string, pattern_id string, severity string, value double, threshold double, active boolean"
        active = _previous(spark, alerts, epoch, kept)
        new = th.performance_alerts(stats, active.filter("active")).withColumn("active", F.lit(True))
        _save(active.unionByName(new.select(*active.columns)), alerts, epoch)

    return merge


EVENT_LOG = "pattern_id string, pattern_type string, ts timestamp, event_id long, success boolean, confidence double, processing_time_ms double, threshold_used double"


def optimize_batches(log: str, audit: str) -> Callable[[DataFrame, int], None]:
    """Append the batch to the event log, re-run the optimization over the whole log and keep the moves.

    The log holds the columns the optimizer reads, one folder per batch, which a retry overwrites.
    """

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        columns = [c.split()[0] for c in EVENT_LOG.split(", ")]
        batch.select(*columns).write.mode("overwrite").parquet(f"{log}/epoch={epoch}")
        events = spark.read.schema(EVENT_LOG).parquet(*[f"{log}/epoch={e}" for e in range(epoch + 1)])
        done = th.audit_rows(th.optimize(th.pattern_stats(events)), th.latest(events))
        _save(done, audit, epoch)

    return run


SUMMARY = "method string, total long, successful long, failed long, confidence double"


def summary_batches(path: str) -> Callable[[DataFrame, int], None]:
    """Running counts by method over all batches of results."""

    def run(batch: DataFrame, epoch: int) -> None:
        old = _previous(batch.sparkSession, path, epoch, SUMMARY)
        fresh = batch.groupBy("method").agg(
            F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
            F.coalesce(F.sum(F.when(F.col("success"), F.col("confidence"))), F.lit(0.0)).alias("confidence"))
        both = old.unionByName(fresh).groupBy("method").agg(*[F.sum(c).alias(c) for c in ("total", "successful", "failed", "confidence")])
        _save(both, path, epoch)

    return run


def summary(state: DataFrame) -> DataFrame:
    """Totals and one row per method of running counts."""
    ok = F.sum("successful")
    return state.rollup("method").agg(
        F.sum("total").alias("total"), ok.alias("successful"), F.sum("failed").alias("failed"), (ok / F.sum("total")).alias("success_rate"),
        F.coalesce(F.sum("confidence") / F.nullif(ok, F.lit(0)), F.lit(0.0)).alias("average_confidence"),
    ).na.fill({"method": "all"})


# --- runners ----------------------------------------------------------------


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Run a stream over everything available and read back what it wrote."""
    spark = stream.sparkSession
    out = scratch(spark, name)
    q = stream.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def drain_batches(stream: DataFrame, fn: Callable[[DataFrame, int], None], name: str) -> None:
    out = scratch(stream.sparkSession, name)
    q = stream.writeStream.foreachBatch(fn).option("checkpointLocation", f"{out}/cp").trigger(availableNow=True).start()
    q.awaitTermination()


def newest_state(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a state table."""
    versions = spark.read.parquet(*[f"{path}/slot={k}" for k in range(SLOTS)])
    return versions.filter(F.col("epoch") == versions.agg(F.max("epoch")).first()[0]).drop("epoch")
