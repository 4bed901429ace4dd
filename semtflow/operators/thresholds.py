"""Adaptive acceptance thresholds learnt from match events (K).

Per-pattern state never needs all rows of a pattern in one task: exponential
means are sums weighted by position, which range partitions number, last-n
picks are salted, halves come from histograms. Scores over the per-pattern
statistics are portable SQL expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions.ordered import halves, hinted, last_n, positions
from semtflow.operators.analytics import latest, recent
from semtflow.session import checkpointed

# --- fixed values: default settings -----------------------------------------
DEFAULT_THRESHOLD, ADJUSTMENT, MIN_SAMPLES, LOW, HIGH = 0.4, 0.2, 3, 0.2, 0.9


def _x(text: str) -> Column:
    return F.expr(text)


def ema_last(events: DataFrame, values: dict[str, Column], alpha: float = 0.1, seeded: bool = False) -> DataFrame:
    """Final exponential means per pattern over all its rows, from 0 or seeded by the first value."""
    rows = events.select("pattern_id", "ts", "event_id", *[c.cast("double").alias(k) for k, c in values.items()])
    rows = positions(rows, ["pattern_id"], ["ts", "event_id"])
    weight = F.pow(F.lit(1 - alpha), F.col("n") - F.col("pos"))
    if seeded:
        weight = F.when(F.col("pos") == 1, weight).otherwise(weight * alpha)
    else:
        weight = weight * alpha
    return rows.groupBy("pattern_id").agg(*[F.sum(F.col(k) * weight).alias(k) for k in values])


def ema_threshold(events: DataFrame) -> DataFrame:
    """Success mean per pattern and the threshold it implies."""
    ema = ema_last(events, {"ema_success": F.col("success").cast("int")}, seeded=True)
    seen = events.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("seen"), F.max("ts").alias("last_updated"))
    moved = F.lit(DEFAULT_THRESHOLD) - (F.col("ema_success") - 0.5) * ADJUSTMENT
    moved = F.greatest(F.lit(LOW), F.least(F.lit(HIGH), moved))
    return ema.join(seen, "pattern_id").withColumn(
        "threshold", F.when(F.col("seen") >= MIN_SAMPLES, moved).otherwise(DEFAULT_THRESHOLD)
    )


def threshold_report(ema: DataFrame) -> DataFrame:
    return ema.select(
        "pattern_id", F.col("threshold").alias("current_threshold"), F.lit(DEFAULT_THRESHOLD).alias("default_threshold"),
        (F.abs(F.col("threshold") - DEFAULT_THRESHOLD) > 1e-12).alias("is_adjusted"), "ema_success", "seen",
        (F.col("seen") >= MIN_SAMPLES).alias("has_enough_samples"),
    )


def reset_thresholds(ema: DataFrame, pattern_id: str | None = None) -> DataFrame:
    return ema.filter(F.col("pattern_id") != pattern_id) if pattern_id else ema.limit(0)


def cumulative_stats(events: DataFrame) -> DataFrame:
    return events.groupBy("pattern_id").agg(
        F.count_if("success").alias("success_count"), F.count(F.lit(1)).alias("total_count"),
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.avg("confidence").alias("avg_confidence"),
        F.max("ts").alias("last_updated"),
    )


def recent_performance(events: DataFrame, n: int = 50) -> DataFrame:
    rows = events.select("pattern_id", "ts", "event_id", "success", "confidence")
    return last_n(rows, ["pattern_id"], ["ts", "event_id"], n).groupBy("pattern_id").agg(
        F.avg(F.col("success").cast("int")).alias("recent_success"), F.avg("confidence").alias("recent_confidence")
    )


def stability(events: DataFrame, n: int = 50) -> DataFrame:
    rows = last_n(events.select("pattern_id", "ts", "event_id", "confidence"), ["pattern_id"], ["ts", "event_id"], n)
    agg = rows.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("k"), F.stddev_pop("confidence").alias("sd"))
    return agg.select(
        "pattern_id", F.when(F.col("k") < 10, 0.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.col("sd") / 0.2)).alias("stability")
    )


def confidence_trend_7d(events: DataFrame) -> DataFrame:
    ev = recent(events.select("pattern_id", "ts", "event_id", "confidence"), "7 days", latest(events))
    agg = halves(ev, ["pattern_id"], "ts", "event_id").groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("half") == 1, F.col("confidence"))).alias("early"),
        F.avg(F.when(F.col("half") == 2, F.col("confidence"))).alias("late"),
    )
    e, l = F.col("early"), F.col("late")
    trend = F.when(F.col("n") < 2, "insufficient_data").when(l > e + 0.05, "improving").when(l < e - 0.05, "declining").otherwise("stable")
    return agg.select("pattern_id", trend.alias("trend"), F.when(F.col("n") < 2, 0.0).otherwise(l - e).alias("trend_change"))


STEP_KIND = """CASE WHEN total_count < 10 THEN 'no_data' WHEN success_rate > 0.95 THEN 'high' WHEN success_rate < 0.7 THEN 'low'
     WHEN avg_confidence > 0.9 AND stability > 0.7 THEN 'sure' WHEN avg_confidence < 0.6 THEN 'unsure' ELSE 'keep' END"""
STEP_MOVE = """CASE kind WHEN 'high' THEN -0.05 * CASE WHEN stability > 0.8 THEN 1.5 ELSE 1.0 END
     WHEN 'low' THEN 0.05 * CASE WHEN recent_success < success_rate * 0.8 THEN 1.5 ELSE 1.0 END
     WHEN 'sure' THEN -0.025 WHEN 'unsure' THEN 0.025 ELSE 0.0 END
     * CASE WHEN total_count < 100 THEN 1.0 WHEN total_count < 500 THEN 0.8 WHEN total_count < 1000 THEN 0.6 ELSE 0.4 END"""


def step_inputs(events: DataFrame) -> DataFrame:
    return cumulative_stats(events).join(recent_performance(events, 20), "pattern_id").join(stability(events), "pattern_id")


def step_threshold(stats: DataFrame, current: float = 0.8) -> DataFrame:
    """One learning step per pattern with the reason for it."""
    out = stats.withColumn("kind", _x(STEP_KIND)).withColumn("move", _x(STEP_MOVE).cast("double"))
    target = F.greatest(F.lit(0.6), F.least(F.lit(0.95), F.lit(current) + F.col("move")))
    small = F.abs(target - current) < 0.01
    return out.select(
        "pattern_id", "kind", F.lit(current).alias("old_threshold"),
        F.when((F.col("kind") == "no_data") | small, F.lit(current)).otherwise(target).alias("new_threshold"),
        "success_rate", "recent_success", "total_count",
    )


def batch_step(steps: DataFrame) -> DataFrame:
    moved = F.abs(F.col("new_threshold") - F.col("old_threshold")) > 0.01
    gain = F.greatest(F.lit(0.0), F.col("recent_success") - F.col("success_rate"))
    return steps.agg(
        F.count(F.lit(1)).alias("patterns_tracked"), F.count_if(moved).alias("adjustments"),
        F.coalesce(F.avg(F.when(F.col("total_count") >= 10, gain)), F.lit(0.0)).alias("improvement_rate"),
    )


def top_performers(stats: DataFrame, k: int = 10) -> DataFrame:
    kept = stats.filter(F.col("total_count") >= 10)
    return kept.orderBy(F.col("success_rate").desc(), "pattern_id").limit(k).select("pattern_id", "success_rate")


def low_performers(stats: DataFrame, threshold: float = 0.7, k: int = 10) -> DataFrame:
    kept = stats.filter((F.col("total_count") >= 10) & (F.col("success_rate") < threshold))
    return kept.orderBy("success_rate", "pattern_id").limit(k).select("pattern_id", "success_rate")


def threshold_histogram(steps: DataFrame) -> DataFrame:
    return steps.groupBy(F.round("new_threshold", 1).alias("bucket")).agg(F.count(F.lit(1)).alias("n_patterns"))


def ema_metrics(events: DataFrame) -> DataFrame:
    """Totals and running means from 0, as a tracker would hold them now."""
    ema = ema_last(events, {"ema_confidence": F.col("confidence"), "ema_time": F.col("processing_time_ms")})
    return cumulative_stats(events).select("pattern_id", "total_count", "success_count", "success_rate").join(ema, "pattern_id")


#: Uses per block of the running means.
BLOCK = 2000


def history_points(events: DataFrame, every: int = 10, alpha: float = 0.1) -> DataFrame:
    """Every ``every``-th use of a pattern: running success rate, threshold, volume, mean confidence.

    Running values are prefix sums inside blocks of 2,000 uses plus what the blocks before hand
    over. An exponential mean takes over the blocks whose weight is above 1e-18 for its alpha.
    """
    rows = events.select("pattern_id", "ts", "event_id", F.col("success").cast("int").alias("ok"), "confidence", "threshold_used")
    rows = positions(rows, ["pattern_id"], ["ts", "event_id"], "volume").withColumn("blk", F.floor((F.col("volume") - 1) / BLOCK)).withColumn("j", (F.col("volume") - 1) % BLOCK)
    decay = F.lit(1 - alpha)
    prefix = Window.partitionBy("pattern_id", "blk").orderBy("volume").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # older rows of a block would outgrow a double if scaled up, so a sub-block restarts the scale
    scale = max(1, min(BLOCK, int(600 / -math.log10(1 - alpha)) // 2))
    sub = F.floor(F.col("j") / scale)
    rows = rows.withColumn("sub", sub).withColumn("i", F.col("j") - sub * scale)
    part = Window.partitionBy("pattern_id", "blk", "sub").orderBy("volume").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("ok_in", F.sum("ok").over(prefix)).withColumn("inside", F.sum(F.col("confidence") * alpha * F.pow(decay, -F.col("i"))).over(part) * F.pow(decay, F.col("i")))
    ends = rows.groupBy("pattern_id", "blk", "sub").agg(F.max_by("inside", "i").alias("own"), F.max("i").alias("last"), F.sum("ok").alias("ok_own"))
    back = math.ceil(math.log(1e-18) / math.log(1 - alpha) / scale)
    near = Window.partitionBy("pattern_id").orderBy("blk", "sub").rowsBetween(-back, -1)
    handed = F.aggregate(F.collect_list("own").over(near), F.lit(0.0), lambda acc, x: acc * (1 - alpha) ** scale + x)
    ends = ends.select("pattern_id", "blk", "sub", handed.alias("carry"), F.sum("ok_own").over(Window.partitionBy("pattern_id", "blk")).alias("blk_ok"))
    blocks = ends.select("pattern_id", "blk", "blk_ok").distinct()
    upto = Window.partitionBy("pattern_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.select("pattern_id", "blk", (F.sum("blk_ok").over(upto) - F.col("blk_ok")).alias("ok_before"))
    kept = rows.filter(F.col("volume") % every == 0).join(ends.drop("blk_ok"), ["pattern_id", "blk", "sub"]).join(blocks, ["pattern_id", "blk"])
    return kept.select(
        "pattern_id", "ts", "volume", ((F.col("ok_before") + F.col("ok_in")) / F.col("volume")).alias("success_rate"),
        F.col("threshold_used").alias("threshold"),
        (F.col("inside") + F.col("carry") * F.pow(decay, F.col("i") + 1)).alias("confidence_avg"),
    )


def performance_trend(points: DataFrame, asof: Column, days: int = 7) -> DataFrame:
    """Trend of the running success rate over the points of the last days.

    A pattern's points stand at equal steps of its volume, and the last days are the end of them,
    so a point's place follows from the ends: nothing sorts a pattern's points in one task.
    """
    pts = checkpointed(points.filter(F.col("ts") > asof - F.expr(f"INTERVAL {days} DAYS")).select("pattern_id", "volume", "success_rate"))
    ends = checkpointed(pts.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("k"), F.min("volume").alias("v0"), F.max("volume").alias("v1")))
    pts = pts.join(hinted(ends), "pattern_id")
    before = F.when(F.col("k") > 1, (F.col("volume") - F.col("v0")) * (F.col("k") - 1) / (F.col("v1") - F.col("v0"))).otherwise(0.0)
    first = F.round(before) + 1 <= F.floor(F.col("k") / 2)
    agg = pts.groupBy("pattern_id").agg(
        F.max("k").alias("k"), F.var_pop("success_rate").alias("var"),
        F.avg(F.when(first, F.col("success_rate"))).alias("a"), F.avg(F.when(~first, F.col("success_rate"))).alias("b"),
    )
    diff = F.col("b") - F.col("a")
    trend = (
        F.when(F.col("k") < 3, "stable").when(F.col("var") > 0.01, "volatile").when(diff > 0.05, "improving")
        .when(diff < -0.05, "declining").otherwise("stable")
    )
    return agg.select("pattern_id", trend.alias("trend"), F.col("k").alias("points_used"))


def pattern_stats(events: DataFrame) -> DataFrame:
    """One row per pattern: what every optimizer below reads."""
    points = history_points(events)
    trend = performance_trend(points, latest(events)).select("pattern_id", "trend")
    counts = events.groupBy("pattern_id").agg(
        F.max("pattern_type").alias("pattern_type"), F.max_by("threshold_used", F.struct("ts", "event_id")).alias("t")
    )
    return (
        ema_metrics(events).select(
            "pattern_id", F.col("total_count").alias("n"), F.col("success_count").alias("s"), F.col("success_rate").alias("sr"),
            F.col("ema_confidence").alias("conf"), F.col("ema_time").alias("ms"),
        )
        .join(counts, "pattern_id").join(trend, "pattern_id", "left").na.fill({"trend": "stable"})
        .withColumn("points", F.floor(F.col("n") / 10))
    )


# --- portable expressions over pattern_stats --------------------------------

TREND_FACTOR = "CASE trend WHEN 'improving' THEN 1.1 WHEN 'declining' THEN 0.9 WHEN 'volatile' THEN 0.8 ELSE 1.0 END"
SCORE = f"least(1.0, (sr * 0.5 + least(1.0, conf) * 0.3 + least(1.0, n / 100.0) * 0.2) * {TREND_FACTOR})"
CONSERVATIVE = "CASE WHEN sr >= 0.9 THEN greatest(0.1, t - 0.05) WHEN sr < 0.7 THEN least(0.95, t + 0.1) ELSE t END"
AGGRESSIVE = "CASE WHEN sr > 0.95 THEN greatest(0.1, t - 0.1) WHEN sr < 0.75 THEN least(0.95, t + 0.15) ELSE t END"
VOLUME = """CASE WHEN sr < 0.85 THEN least(0.95, t + 0.05 + 0.1 * least(1.0, n / 1000.0))
    WHEN sr > 0.95 THEN greatest(0.1, t - 0.05 - 0.1 * least(1.0, n / 1000.0)) ELSE t END"""
BALANCED = """greatest(0.1, least(0.95, t + (0.85 - sr) * 0.5 + (0.8 - conf) * 0.1
    + CASE trend WHEN 'improving' THEN -0.02 WHEN 'declining' THEN 0.05 WHEN 'volatile' THEN 0.03 ELSE 0.0 END))"""
STRATEGIES = {"conservative": CONSERVATIVE, "aggressive": AGGRESSIVE, "volume_weighted": VOLUME, "balanced": BALANCED}

GAIN = """CASE WHEN x > t THEN least(0.1, (x - t) * 0.5) ELSE least(0.05, abs(x - t) * 0.3) END
    * CASE WHEN sr > 0.9 THEN 0.5 WHEN sr < 0.6 THEN 1.5 ELSE 1.0 END"""
ADVICE_CONFIDENCE = """least(1.0, n / 500.0) * 0.4
    + CASE trend WHEN 'stable' THEN 0.9 WHEN 'improving' THEN 0.8 WHEN 'declining' THEN 0.7 WHEN 'volatile' THEN 0.5 END * 0.4
    + least(1.0, points / 50.0) * 0.2"""
EST_SUCCESS = """CASE WHEN x > t THEN least(1.0, sr + least(0.2, (x - t) * 0.5))
    ELSE greatest(0.0, sr - least(0.1, abs(x - t) * 0.3)) END"""
EST_CONFIDENCE = "greatest(0.0, least(1.0, conf + (x - t) * 0.3))"
CAREFUL = """CASE WHEN sr < 0.85 THEN least(0.95, t + least(0.05, (0.85 - sr) * 0.5))
    WHEN sr > 0.95 THEN greatest(0.1, t - least(0.03, (sr - 0.85) * 0.3)) ELSE t END"""
BOLD = """CASE WHEN sr < 0.85 THEN least(0.95, t + least(0.15, 0.85 - sr))
    WHEN sr > 0.9 THEN greatest(0.1, t - least(0.1, (sr - 0.85) * 0.7)) ELSE t END"""
BY_VOLUME = "greatest(0.1, least(0.95, t + (0.85 - sr) * 0.8 * least(1.0, n / 1000.0)))"


def _d(text: str) -> Column:
    return F.expr(text).cast("double")


def performance_score(stats: DataFrame) -> DataFrame:
    return stats.select("pattern_id", "trend", _d(SCORE).alias("performance_score"))


def strategy_thresholds(stats: DataFrame) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("strategy"), _d(e).alias("threshold")) for k, e in STRATEGIES.items()]
    return stats.select("pattern_id", F.explode(F.array(*rows)).alias("r")).select("pattern_id", "r.*")


def needs_optimization(stats: DataFrame, optimized: DataFrame | None = None, asof: Column | None = None) -> DataFrame:
    """Flag patterns with enough samples, no run in the last day, and a reason to move."""
    s = stats.withColumn("best", _d(BALANCED))
    fresh = F.lit(True)
    if optimized is not None:
        s = s.join(optimized.select("pattern_id", "last_optimization"), "pattern_id", "left")
        fresh = F.col("last_optimization").isNull() | (F.col("last_optimization") <= asof - F.expr("INTERVAL 24 HOURS"))
    reason = (F.col("sr") < 0.85) | (F.col("trend") == "declining") | (F.abs(F.col("best") - F.col("t")) > 0.05)
    return s.withColumn("needed", (F.col("n") >= 100) & fresh & reason)


def optimize(stats: DataFrame) -> DataFrame:
    """Capped move to the balanced threshold; rows with ``applied`` go to the audit table."""
    s = needs_optimization(stats)
    target = F.greatest(F.col("t") - 0.2, F.least(F.col("t") + 0.2, F.col("best")))
    s = s.withColumn("x", F.greatest(F.lit(0.1), F.least(F.lit(0.95), target)))
    s = s.withColumn("gain", _d(GAIN)).withColumn("sure", _d(ADVICE_CONFIDENCE))
    needed = F.col("needed")
    return s.select(
        "pattern_id", F.col("t").alias("old_threshold"), F.when(needed, F.col("x")).otherwise(F.col("t")).alias("new_threshold"),
        F.when(needed, F.col("gain")).otherwise(0.0).alias("expected_improvement"),
        F.when(needed, F.col("sure")).otherwise(0.0).alias("confidence_score"),
        (needed & (F.col("gain") > 0.01)).alias("optimization_applied"), F.col("sr").alias("performance_before"),
    )


def audit_rows(optimized: DataFrame, asof: Column, strategy: str = "balanced") -> DataFrame:
    return optimized.filter("optimization_applied").select(
        "pattern_id", "old_threshold", "new_threshold", "expected_improvement", "performance_before",
        F.lit(strategy).alias("strategy_used"), asof.alias("timestamp"),
    )


def learning_report(stats: DataFrame, optimized: DataFrame) -> DataFrame:
    """(section, name, n, success_rate, confidence): per type with total, per trend, applied optimizations."""
    types = stats.rollup("pattern_type").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sr").alias("success_rate"), F.avg("conf").alias("confidence")
    ).select(F.lit("type").alias("section"), F.coalesce("pattern_type", F.lit("all")).alias("name"), "n", "success_rate", "confidence")
    trends = stats.groupBy("trend").agg(
        F.count(F.lit(1)).alias("n"), F.avg("sr").alias("success_rate"), F.avg("conf").alias("confidence")
    ).select(F.lit("trend").alias("section"), F.col("trend").alias("name"), "n", "success_rate", "confidence")
    done = optimized.agg(F.count_if("optimization_applied").alias("n"), F.avg(F.when(F.col("optimization_applied"), F.col("expected_improvement"))).alias("success_rate"))
    done = done.select(F.lit("optimizations").alias("section"), F.lit("applied").alias("name"), "n", "success_rate", F.lit(None).cast("double").alias("confidence"))
    return types.unionByName(trends).unionByName(done)


def hourly_daily_stats(events: DataFrame) -> DataFrame:
    """Totals by pattern and hour (7 days) and by pattern and day (30 days), one pass."""
    asof = latest(events)
    ev = events.select(
        "pattern_id", "success",
        F.explode(F.array_compact(F.array(
            F.when(F.date_trunc("hour", "ts") >= F.date_trunc("hour", asof - F.expr("INTERVAL 7 DAYS")),
                   F.struct(F.lit("hour").alias("grain"), F.date_trunc("hour", "ts").alias("bucket"))),
            F.when(F.date_trunc("day", "ts") >= F.date_trunc("day", asof - F.expr("INTERVAL 30 DAYS")),
                   F.struct(F.lit("day").alias("grain"), F.date_trunc("day", "ts").alias("bucket"))),
        ))).alias("b"),
    )
    return ev.groupBy("pattern_id", "b.grain", "b.bucket").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.avg(F.col("success").cast("int")).alias("success_rate"),
    )


def performance_alerts(stats: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """Alert rows, without those already active for the same (type, pattern)."""
    def alert(when: str, kind: str, severity: str, value: str, limit: float) -> Column:
        return F.when(_x(when), F.struct(
            F.lit(kind).alias("type"), F.lit(severity).alias("severity"), F.col(value).alias("value"), F.lit(limit).alias("threshold")))

    rows = F.array_compact(F.array(
        alert("sr < 0.5 AND n > 50", "low_success_rate", "high", "sr", 0.5),
        alert("conf < 0.3 AND n > 30", "low_confidence", "medium", "conf", 0.3),
        alert("ms > 1000", "high_processing_time", "medium", "ms", 1000.0),
    ))
    out = stats.select("pattern_id", F.explode(rows).alias("a")).select("pattern_id", "a.*")
    return out if active is None else out.join(active, ["type", "pattern_id"], "left_anti")


def recent_trend(events: DataFrame, interval: str = "60 minutes") -> DataFrame:
    """Last interval against all time (running means) per pattern."""
    overall = ema_metrics(events)
    now = recent(events, interval).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("events"), F.avg(F.col("success").cast("int")).alias("a"),
        F.avg("confidence").alias("b"), F.avg("processing_time_ms").alias("c"),
    )
    j = now.join(overall, "pattern_id")
    ds = F.col("a") - F.col("success_rate")
    trend = F.when(F.col("events") < 2, "insufficient_data").when(ds > 0.05, "improving").when(ds < -0.05, "declining").otherwise("stable")
    return j.select(
        "pattern_id", "events", trend.alias("trend"), ds.alias("success_rate_change"),
        (F.col("b") - F.col("ema_confidence")).alias("confidence_change"), (F.col("c") - F.col("ema_time")).alias("processing_time_change"),
    )


def pattern_trend(events: DataFrame) -> DataFrame:
    ev = events.select("pattern_id", "ts", "event_id", F.col("success").cast("int").alias("v"), "confidence")
    agg = halves(ev, ["pattern_id"], "ts", "event_id").groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("events_analyzed"), F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("first_half_success_rate"),
        F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("second_half_success_rate"),
        (F.avg(F.when(F.col("half") == 2, F.col("confidence"))) - F.avg(F.when(F.col("half") == 1, F.col("confidence")))).alias("confidence_change"),
    )
    ch = F.col("second_half_success_rate") - F.col("first_half_success_rate")
    grade = (
        F.when(F.col("events_analyzed") < 5, "insufficient_data").when(ch > 0.1, "strongly_improving").when(ch > 0.03, "improving")
        .when(ch < -0.1, "strongly_declining").when(ch < -0.03, "declining").otherwise("stable")
    )
    return agg.withColumn("trend", grade).withColumn("success_rate_change", ch)


def system_trend(events: DataFrame) -> DataFrame:
    hourly = events.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(
        F.avg(F.col("success").cast("int")).alias("rate"), F.count(F.lit(1)).alias("c"))
    hourly = hourly.withColumn("i", F.row_number().over(Window.orderBy("hour")) - 1)  # one row per hour
    agg = hourly.agg(F.regr_slope("rate", "i").alias("slope"), F.count(F.lit(1)).alias("hours_analyzed"), F.sum("c").alias("total_events"))
    s = F.col("slope")
    trend = F.when((F.col("hours_analyzed") < 3) | (F.col("total_events") < 10), "insufficient_data").when(s > 0.01, "improving").when(s < -0.01, "declining").otherwise("stable")
    return agg.withColumn("trend", trend)


def system_summary(stats: DataFrame) -> DataFrame:
    main = stats.agg(
        F.count(F.lit(1)).alias("total_patterns"), F.sum("n").alias("total_processed"), (F.sum("s") / F.sum("n")).alias("overall_success_rate"),
        F.avg("conf").alias("average_confidence"), F.avg("ms").alias("average_processing_time"),
    ).withColumn("j", F.lit(1))
    alerts = performance_alerts(stats).agg(F.count(F.lit(1)).alias("active_alerts")).withColumn("j", F.lit(1))
    return main.join(alerts, "j").drop("j")


def threshold_sweep(stats: DataFrame, steps: int = 20, low: float = 0.1, high: float = 0.95) -> DataFrame:
    """``steps`` evenly spaced candidates per pattern with estimated outcomes."""
    i = F.explode(F.sequence(F.lit(0), F.lit(steps - 1))).alias("step")
    s = stats.select("*", i).withColumn("x", F.lit(low) + F.col("step") * ((high - low) / (steps - 1)))
    return s.select(
        "pattern_id", "step", F.col("x").alias("threshold"), _d(EST_SUCCESS).alias("success_rate"),
        _d(EST_CONFIDENCE).alias("confidence"), F.col("ms").alias("processing_time"),
    )


def pareto_front(sweep: DataFrame) -> DataFrame:
    """Candidates no other candidate of the pattern dominates (a few candidates per pattern)."""
    a, b = sweep.alias("a"), sweep.alias("b")
    worse_or_same = (
        (F.col("b.success_rate") >= F.col("a.success_rate")) & (F.col("b.confidence") >= F.col("a.confidence"))
        & (F.col("b.processing_time") <= F.col("a.processing_time"))
    )
    strictly = (
        (F.col("b.success_rate") > F.col("a.success_rate")) | (F.col("b.confidence") > F.col("a.confidence"))
        | (F.col("b.processing_time") < F.col("a.processing_time"))
    )
    return a.join(b, (F.col("a.pattern_id") == F.col("b.pattern_id")) & worse_or_same & strictly, "left_anti")


def best_pareto(front: DataFrame) -> DataFrame:
    score = F.col("success_rate") * 0.5 + F.col("confidence") * 0.3 + 0.2 / (1 + F.col("processing_time"))
    s = front.withColumn("score", F.round(score, 12))
    return s.groupBy("pattern_id").agg(F.max_by("threshold", F.struct(F.col("score"), -F.col("step"))).alias("threshold"), F.max("score").alias("score"))


def auto_strategy(stats: DataFrame) -> DataFrame:
    """Pick a strategy by volume, trend and success, then its threshold."""
    best = best_pareto(pareto_front(threshold_sweep(stats))).select("pattern_id", F.col("threshold").alias("p"))
    pick = F.when(F.col("n") > 1000, "volume_weighted").when(F.col("trend") == "volatile", "conservative").when(F.col("sr") < 0.6, "aggressive").otherwise("balanced")
    s = stats.join(best, "pattern_id").withColumn("strategy", pick)
    k = F.col("strategy")
    x = F.when(k == "volume_weighted", _d(BY_VOLUME)).when(k == "conservative", _d(CAREFUL)).when(k == "aggressive", _d(BOLD)).otherwise(F.col("p"))
    s = s.withColumn("x", x)
    gain = _d(EST_SUCCESS) - F.col("sr")
    sure = F.when(k == "volume_weighted", 0.5 + 0.4 * F.least(F.lit(1.0), F.col("n") / 1000)).when(k == "conservative", 0.8).when(k == "aggressive", 0.6).otherwise(0.7)
    return s.select(
        "pattern_id", "strategy", F.col("t").alias("old_threshold"), F.col("x").alias("new_threshold"),
        F.when(k == "aggressive", gain * 1.2).otherwise(gain).alias("expected_improvement"), sure.alias("confidence_score"),
        (F.abs(F.col("x") - F.col("t")) > 0.01).alias("optimization_applied"),
    )


def group_optimize(stats: DataFrame, max_changes: int) -> DataFrame:
    """Per pattern type bold or careful moves; only the best ``max_changes`` are applied."""
    s = stats.withColumn("weak", F.avg("sr").over(Window.partitionBy("pattern_type")) < 0.7)
    s = s.withColumn("x", F.when(F.col("weak"), _d(BOLD)).otherwise(_d(CAREFUL)))
    s = s.withColumn("gain", F.round((_d(EST_SUCCESS) - F.col("sr")) * F.when(F.col("weak"), 1.2).otherwise(1.0), 12))
    top = s.orderBy(F.col("gain").desc(), "pattern_id").limit(max_changes).select("pattern_id", F.lit(True).alias("chosen"))
    s = s.join(top, "pattern_id", "left")
    applied = F.coalesce(F.col("chosen"), F.lit(False)) & (F.abs(F.col("x") - F.col("t")) > 0.01)
    return s.select("pattern_id", "pattern_type", F.col("x").alias("new_threshold"), F.col("gain").alias("expected_improvement"), applied.alias("optimization_applied"))


def threshold_distribution(stats: DataFrame) -> DataFrame:
    return stats.agg(
        F.avg("t").alias("mean"), F.median("t").alias("median"), F.stddev_pop("t").alias("std"), F.min("t").alias("min"), F.max("t").alias("max"),
        F.corr("t", "sr").alias("threshold_success_correlation"), F.corr("t", "conf").alias("threshold_confidence_correlation"),
        F.concat_ws("; ",
            F.when(F.var_pop("t") > 0.1, "High threshold variance detected - consider standardizing thresholds"),
            F.when(F.avg((F.col("sr") < 0.7).cast("int")) > 0.3, "30%+ patterns underperforming - consider global threshold reduction"),
            F.when(F.avg((F.col("conf") > 0.9).cast("int")) > 0.7, "High confidence across patterns - consider reducing thresholds for better recall"),
        ).alias("recommendations"),
    )


def gradient_step(points: DataFrame, stats: DataFrame, rate: float = 0.1) -> DataFrame:
    """Move against the slope of success over threshold in the last five points, if it pays."""
    last = last_n(points, ["pattern_id"], ["volume"], 5).groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("k"), F.regr_slope("success_rate", "threshold").alias("slope"))
    s = stats.join(last, "pattern_id", "left").withColumn("g", F.when(F.col("k") >= 2, F.col("slope")).otherwise(0.0))
    s = s.withColumn("g", F.coalesce("g", F.lit(0.0))).withColumn("x", F.greatest(F.lit(0.1), F.least(F.lit(0.95), F.col("t") - F.col("g") * rate)))
    s = s.withColumn("gain", _d(EST_SUCCESS) - F.col("sr"))
    return s.select("pattern_id", F.col("t").alias("old_threshold"), F.col("g").alias("gradient"), F.when(F.col("gain") > 0.01, F.col("x")).otherwise(F.col("t")).alias("new_threshold"))


# --- threshold grid over recent events --------------------------------------

GRID_RATIO = "x / t"
GRID = {
    "ms2": "ms * CASE WHEN x < t THEN 0.9 + 0.1 * x / t ELSE 1.1 - 0.1 * t / x END",
    "tp2": "tp * CASE WHEN x < t THEN 1.1 - 0.1 * x / t ELSE 0.9 + 0.1 * t / x END",
    "sr2": "least(1.0, greatest(0.0, sr * CASE WHEN x < t THEN 0.95 + 0.05 * x / t ELSE 1.02 - 0.02 * t / x END))",
    "ac2": "least(1.0, greatest(0.0, ac * CASE WHEN x < t THEN 0.95 + 0.05 * x / t ELSE 1.02 - 0.02 * t / x END))",
}
IMPROVE = {
    "performance": "((ms - ms2) / ms * 0.6 + (tp2 - tp) / tp * 0.4) * 100",
    "accuracy": "((sr2 - sr) / sr * 0.6 + (ac2 - ac) / ac * 0.4) * 100",
    "balanced": "((ms - ms2) / ms * 0.3 + (sr2 - sr) / sr * 0.3 + (tp2 - tp) / tp * 0.2 + (ac2 - ac) / ac * 0.2) * 100",
}
IMPROVE["adaptive"] = f"CASE WHEN ms > 100 THEN {IMPROVE['performance']} WHEN sr < 0.85 THEN {IMPROVE['accuracy']} ELSE {IMPROVE['balanced']} END"
GRID_CONFIDENCE = "(least(1.0, n / 1000.0) + greatest(0.3, 1 - sd / ms) + least(1.0, abs(sr2 - sr) * 10) + 0.8) / 4"


def event_profile(events: DataFrame) -> DataFrame:
    ms = F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 60e6
    return events.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("success").cast("int")).alias("sr"), F.avg(ms).alias("ms"), F.stddev_samp(ms).alias("sd"),
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("ac"),
        (F.count(F.lit(1)) / F.greatest(span, F.lit(1.0))).alias("tp"),
    )


def threshold_grid_recommend(
    events: DataFrame, strategy: str = "balanced", thresholds: DataFrame | None = None,
    step: float = 0.02, min_samples: int = 50, min_confidence: float = 0.7, low: float = 0.3, high: float = 0.95,
) -> DataFrame:
    """Five steps down and up around the current threshold, modelled and kept when worth it."""
    s = event_profile(events).filter(F.col("n") >= min_samples)
    if thresholds is not None:
        s = s.join(thresholds.select("pattern_id", F.col("threshold").alias("t")), "pattern_id", "left")
        s = s.withColumn("t", F.coalesce("t", F.lit(0.7)))
    else:
        s = s.withColumn("t", F.lit(0.7))
    at = F.transform(F.array(*[F.lit(i) for i in range(-5, 6) if i]), lambda i: F.greatest(F.lit(low), F.least(F.lit(high), F.col("t") + i * step)))
    s = s.withColumn("x", F.explode(F.array_distinct(at)))
    for name, e in GRID.items():
        s = s.withColumn(name, _d(e))
    s = s.withColumn("improvement", _d(IMPROVE[strategy])).withColumn("confidence_level", _d(GRID_CONFIDENCE))
    return s.filter((F.col("improvement") >= 1.0) & (F.col("confidence_level") >= min_confidence)).select(
        "pattern_id", F.col("t").alias("current_threshold"), F.col("x").alias("recommended_threshold"),
        F.col("improvement").alias("expected_improvement"), "confidence_level", F.lit(strategy).alias("strategy"),
    )


def recommendation_confidence(events: DataFrame) -> DataFrame:
    """Sample-size and stability parts of the recommendation confidence per pattern."""
    s = event_profile(events)
    return s.select("pattern_id", F.least(F.lit(1.0), F.col("n") / 1000).alias("sample_size"), F.greatest(F.lit(0.3), 1 - F.col("sd") / F.col("ms")).alias("stability"))


def recommendation_tiers(recs: DataFrame) -> DataFrame:
    e, ch = F.col("expected_improvement"), F.round(F.abs(F.col("recommended_threshold") - F.col("current_threshold")), 9)
    weight = F.col("confidence_level") * (1 + e / 100)
    over = Window.partitionBy("strategy")  # a few rows per pattern of the dimension
    lower = F.col("recommended_threshold") < F.col("current_threshold")
    return recs.select(
        "pattern_id", "recommended_threshold", F.when(e >= 5, "high").when(e >= 2, "medium").otherwise("low").alias("impact"),
        F.when(ch > 0.1, "HIGH").when(ch > 0.05, "MEDIUM").otherwise("LOW").alias("risk"),
        F.concat(F.when(lower, "Lower threshold from ").otherwise("Raise threshold from "),
                 F.format_string("%.3f to %.3f", F.col("current_threshold"), F.col("recommended_threshold")),
                 F.when(lower, " to improve processing speed").otherwise(" to improve accuracy")).alias("rationale"),
        (F.sum(e * weight).over(over) / F.sum(weight).over(over)).alias("overall_improvement"),
    )


def optimization_recommendations(stats: DataFrame, low: float = 0.7) -> DataFrame:
    kind = F.when((F.col("sr") < low) & (F.col("n") > 50), "threshold_increase").when((F.col("sr") > 0.95) & (F.col("conf") > 0.9), "threshold_decrease").when(F.col("trend") == "volatile", "stabilization")
    s = stats.withColumn("type", kind).filter(F.col("type").isNotNull())
    t, k = F.col("t"), F.col("type")
    return s.select(
        "pattern_id", "type", t.alias("current_threshold"),
        F.when(k == "threshold_increase", F.least(F.lit(0.9), t + 0.1)).when(k == "threshold_decrease", F.greatest(F.lit(0.3), t - 0.05)).otherwise(t + 0.05).alias("recommended_threshold"),
        F.when(k == "threshold_increase", "high").otherwise("medium").alias("priority"),
    )


def expire_history(rows: DataFrame, days: int, asof: Column) -> DataFrame:
    """Rows still within retention; on a date-partitioned table the filter prunes partitions."""
    return rows.filter(F.col("ts") > asof - F.expr(f"INTERVAL {days} DAYS"))


def health_table(stats: DataFrame, schedules_running: bool = True) -> DataFrame:
    """Component checks and the worst status as ``overall``."""
    n = stats.agg(F.count(F.lit(1)).alias("n"))
    rank = lambda c: F.when(c == "error", 3).when(c == "warning", 2).otherwise(1)
    engine = F.when(F.col("n") > 0, "healthy").otherwise("warning")
    rows = F.array(
        F.struct(F.lit("learning_engine").alias("component"), engine.alias("status")),
        F.struct(F.lit("performance_tracker").alias("component"), engine.alias("status")),
        F.struct(F.lit("scheduler").alias("component"), F.lit("healthy" if schedules_running else "error").alias("status")),
    )
    worst = F.array_max(F.transform(rows, lambda r: F.struct(rank(r["status"]).alias("r"), r["status"].alias("status"))))["status"]
    return n.select("n", F.explode(F.concat(rows, F.array(F.struct(F.lit("overall").alias("component"), worst.alias("status"))))).alias("c")).select(
        "c.component", "c.status", F.col("n").alias("pattern_count"))
