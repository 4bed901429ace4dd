"""Analytics over match events: metrics, trends, insights, rankings and reports (J).

An event has event_id, ts, metric_type, method, pattern_id, success,
confidence, processing_time_ms, error_type. "Now" is an as-of time: the latest
event unless given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions.ordered import halves, located, percentiles, value_levels

TIME_WINDOWS = {"1h": "1 hour", "24h": "24 hours", "7d": "7 days", "30d": "30 days"}


def latest(events: DataFrame) -> Column:
    """The newest event time as a scalar subquery."""
    return events.agg(F.max("ts")).scalar()


def recent(events: DataFrame, interval: str, asof: Column | None = None) -> DataFrame:
    """Events of the last ``interval`` up to the as-of time."""
    return events.filter(F.col("ts") >= (latest(events) if asof is None else asof) - F.expr(f"INTERVAL {interval}"))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def performance_metrics(events: DataFrame) -> DataFrame:
    """One row: index-pick percentiles of all times, totals of all events."""
    totals = events.agg(
        F.count(F.lit(1)).alias("total_processed"),
        F.avg(F.when(F.col("success"), 0.0).otherwise(1.0)).alias("error_rate"),
        ((F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 1e6).alias("elapsed"),
    )
    timed = events.filter(F.col("processing_time_ms") > 0)
    shares = {"median_ms": 0.5, "p95_ms": 0.95, "p99_ms": 0.99}
    at = located(timed, [], value_levels("processing_time_ms"), {k: lambda n, p=p: F.floor(n * p) for k, p in shares.items()})
    picked = at.agg(*[F.max(F.when(F.col("pick") == k, F.col("__v2"))).alias(k) for k in shares])
    mean = timed.agg(F.avg("processing_time_ms").alias("avg_ms"))
    one = F.lit(1).alias("j")
    both = totals.select("*", one).join(mean.select("*", one), "j").join(picked.select("*", one), "j")
    return both.select(
        "avg_ms", "median_ms", "p95_ms", "p99_ms",
        (F.col("total_processed") / F.greatest("elapsed", F.lit(1.0))).alias("throughput_per_second"),
        "total_processed", "error_rate",
    )


def pattern_metrics(events: DataFrame, failures: int = 5) -> DataFrame:
    """Usage, rates, means, last use and the newest distinct error types per pattern."""
    ev = events.filter(F.col("pattern_id").isNotNull())
    main = ev.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("usage_count"),
        F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.avg(F.when(F.col("confidence") > 0, F.col("confidence"))).alias("avg_confidence"),
        F.avg(F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))).alias("avg_processing_time_ms"),
        F.max("ts").alias("last_used"),
    )
    errs = ev.filter(~F.col("success") & F.col("error_type").isNotNull())
    errs = errs.groupBy("pattern_id", "error_type").agg(F.max("ts").alias("seen"))
    order = Window.partitionBy("pattern_id").orderBy(F.col("seen").desc(), "error_type")
    errs = errs.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= failures)
    listed = errs.groupBy("pattern_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "error_type"))), lambda x: x["error_type"]), ",")
        .alias("common_failures")
    )
    return main.join(listed, "pattern_id", "left").na.fill({"common_failures": ""})


def confidence_level(c: Column) -> Column:
    return (
        F.when(c >= 0.9, "very_high").when(c >= 0.75, "high").when(c >= 0.6, "medium").when(c >= 0.4, "low").otherwise("very_low")
    )


def system_metrics(events: DataFrame) -> DataFrame:
    """(section, name, value): both distributions and both rates from one pass."""
    bucket = F.when(F.col("confidence") > 0, confidence_level(F.col("confidence")))
    ev = events.select(
        "method", bucket.alias("bucket"), "geo_validated", (F.col("metric_type") == "threshold").alias("adjusted")
    )
    sets = ev.groupingSets([["method"], ["bucket"], []], "method", "bucket").agg(
        F.grouping_id().alias("g"),
        F.count(F.lit(1)).cast("double").alias("n"),
        F.avg(F.col("geo_validated").cast("double")).alias("geo"),
        F.count_if("adjusted").cast("double").alias("adj"),
    )

    def row(section: str, name: Column | str, value: Column) -> Column:
        name = F.lit(name) if isinstance(name, str) else name
        return F.struct(F.lit(section).alias("section"), name.alias("name"), value.alias("value"))

    rows = F.when(F.col("g") == 1, F.array(row("method", F.col("method"), F.col("n"))))
    rows = rows.when(F.col("g") == 2, F.array(row("confidence", F.col("bucket"), F.col("n"))))
    rows = rows.otherwise(F.array(
        row("system", "geographic_validation_rate", F.col("geo")), row("system", "threshold_adjustments", F.col("adj"))
    ))
    return sets.select(F.explode(rows).alias("x")).select("x.*").filter(F.col("name").isNotNull())


def in_time_windows(events: DataFrame, windows: dict[str, str] | None = None) -> DataFrame:
    """Each event once per window it falls in (``time_period``), from a single scan."""
    windows = TIME_WINDOWS if windows is None else windows
    asof = latest(events)
    hit = [F.when(F.col("ts") >= asof - F.expr(f"INTERVAL {span}"), F.lit(name)) for name, span in windows.items()]
    return events.withColumn("time_period", F.explode(F.array_compact(F.array(*hit))))


def time_window_counts(events: DataFrame, minimum: int = 10) -> DataFrame:
    counted = in_time_windows(events).groupBy("time_period").agg(F.count(F.lit(1)).alias("n_events"))
    return counted.filter(F.col("n_events") >= minimum)


def _direction(change: Column, band: float, up: str, down: str) -> Column:
    return F.when(F.abs(change) < band, "stable").when(change > 0, up).otherwise(down)


def _change(first: Column, second: Column) -> Column:
    return F.when(first > 0, (second - first) / first * 100).otherwise(0.0)


def _notes(*pairs: tuple[Column, str]) -> Column:
    return F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(t)) for c, t in pairs])), "; ")


def _trend_frame(windowed: DataFrame, value: Column, minimum: int) -> DataFrame:
    ev = windowed.select("time_period", "ts", "event_id", value.alias("v")).filter(F.col("v").isNotNull())
    split = halves(ev, ["time_period"], "ts", "event_id")
    agg = split.groupBy("time_period").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(F.when(F.col("half") == 1, F.col("v"))).alias("previous_value"),
        F.avg(F.when(F.col("half") == 2, F.col("v"))).alias("current_value"),
        F.stddev_samp("v").alias("sd"),
        F.max("v").alias("top"),
    )
    return agg.filter(F.col("n") >= minimum).withColumn(
        "change_percentage", _change(F.col("previous_value"), F.col("current_value"))
    )


_TREND = ["time_period", "metric_name", "direction", "change_percentage", "confidence", "current_value", "previous_value", "notes"]


def processing_time_trend(windowed: DataFrame, minimum: int = 10) -> DataFrame:
    t = _trend_frame(windowed, F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms")), minimum)
    cur, sd = F.col("current_value"), F.col("sd")
    return t.select(
        "time_period", F.lit("processing_time_ms").alias("metric_name"),
        _direction(F.col("change_percentage"), 5, "declining", "improving").alias("direction"), "change_percentage",
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - F.when(cur > 0, sd / cur).otherwise(1.0))).alias("confidence"),
        "current_value", "previous_value",
        _notes((sd > cur * 0.5, "High variability in processing times detected"),
               (F.col("top") > cur * 3, "Outliers detected - possible performance spikes")).alias("notes"),
    )


def success_rate_trend(windowed: DataFrame, minimum: int = 10) -> DataFrame:
    t = _trend_frame(windowed, F.col("success").cast("double"), minimum)
    return t.select(
        "time_period", F.lit("success_rate").alias("metric_name"),
        _direction(F.col("change_percentage"), 2, "improving", "declining").alias("direction"), "change_percentage",
        F.lit(0.8).alias("confidence"), "current_value", "previous_value",
        _notes((F.col("current_value") < 0.9, "Success rate below 90% - investigation recommended")).alias("notes"),
    )


def confidence_trend(windowed: DataFrame, minimum: int = 10) -> DataFrame:
    t = _trend_frame(windowed, F.when(F.col("confidence") > 0, F.col("confidence")), minimum)
    return t.select(
        "time_period", F.lit("confidence_score").alias("metric_name"),
        _direction(F.col("change_percentage"), 3, "improving", "declining").alias("direction"), "change_percentage",
        F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - F.col("sd"))).alias("confidence"), "current_value", "previous_value",
        _notes((F.col("current_value") < 0.7, "Average confidence below 70% - pattern quality may need improvement")).alias("notes"),
    )


def throughput_trend(windowed: DataFrame, minimum: int = 10) -> DataFrame:
    hourly = windowed.groupBy("time_period", F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    by = Window.partitionBy("time_period")  # one row per hour
    hourly = hourly.select(
        "time_period", "c", F.row_number().over(by.orderBy("hour")).alias("rn"),
        F.count(F.lit(1)).over(by).alias("n"), F.sum("c").over(by).alias("events"),
    )
    first = F.col("rn") <= F.floor(F.col("n") / 2)
    agg = hourly.filter((F.col("n") >= 2) & (F.col("events") >= minimum)).groupBy("time_period").agg(
        F.avg(F.when(first, F.col("c"))).alias("previous_value"), F.avg(F.when(~first, F.col("c"))).alias("current_value")
    )
    agg = agg.withColumn("change_percentage", _change(F.col("previous_value"), F.col("current_value")))
    return agg.select(
        "time_period", F.lit("throughput").alias("metric_name"),
        _direction(F.col("change_percentage"), 10, "improving", "declining").alias("direction"), "change_percentage",
        F.lit(0.7).alias("confidence"), "current_value", "previous_value", F.lit("").alias("notes"),
    )


# --- insights ---------------------------------------------------------------


def _insight(when: Column, category: str, kind: str, level: Column | str, text: Column, advice: Column | str, value: Column) -> Column:
    as_col = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.when(
        when,
        F.struct(
            F.lit(category).alias("category"), F.lit(kind).alias("insight_type"), as_col(level).alias("impact_level"),
            text.alias("description"), as_col(advice).alias("recommendation"), value.cast("double").alias("value"),
        ),
    )


def _insights(stats: DataFrame, *rows: Column) -> DataFrame:
    return stats.select(F.explode(F.array_compact(F.array(*rows))).alias("x")).select("x.*")


def processing_time_insights(ev: DataFrame) -> DataFrame:
    timed = ev.filter(F.col("processing_time_ms") > 0)
    stats = timed.agg(
        F.avg("processing_time_ms").alias("avg"), F.coalesce(F.stddev_samp("processing_time_ms"), F.lit(0.0)).alias("sd"),
        F.max("processing_time_ms").alias("top"),
    ).filter(F.col("avg").isNotNull())
    avg, sd, top = F.col("avg"), F.col("sd"), F.col("top")
    return _insights(
        stats,
        _insight(sd > avg * 0.5, "processing_time", "high_variance", "warning",
                 F.format_string("High variance in processing times detected (std: %.1fms)", sd),
                 "Investigate outliers and consider implementing caching for common patterns", sd / avg),
        _insight(top > avg * 5, "processing_time", "slow_outliers", "warning",
                 F.format_string("Slow processing outliers detected (max: %.1fms vs avg: %.1fms)", top, avg),
                 "Profile slow operations and optimize pattern matching algorithms", top / avg),
        _insight(avg > 100, "processing_time", "performance_degradation", F.when(avg > 500, "critical").otherwise("warning"),
                 F.format_string("Average processing time is high: %.1fms", avg),
                 "Optimize pattern matching algorithms and consider parallel processing", avg),
    )


def processing_time_profile(ev: DataFrame) -> DataFrame:
    """The supporting data of the time insights: mean, sd, max, exact median and interpolated p95."""
    timed = ev.filter(F.col("processing_time_ms") > 0)
    stats = timed.agg(
        F.avg("processing_time_ms").alias("avg_time"), F.stddev_samp("processing_time_ms").alias("std_dev"),
        F.max("processing_time_ms").alias("max_time"),
    ).withColumn("j", F.lit(1))
    exact = percentiles(timed, [], "processing_time_ms", {"median_time": 0.5, "p95_time": 0.95}).withColumn("j", F.lit(1))
    return stats.join(exact, "j").drop("j")


def method_stats(ev: DataFrame) -> DataFrame:
    return ev.groupBy("method").agg(
        F.count(F.lit(1)).alias("usage_count"), F.avg(F.col("success").cast("double")).alias("success_rate"),
        F.coalesce(F.avg(F.when(F.col("processing_time_ms") > 0, F.col("processing_time_ms"))), F.lit(0.0)).alias("avg_time"),
    )


def method_insights(ev: DataFrame) -> DataFrame:
    order = F.struct("success_rate", -F.col("avg_time"), "method")
    ends = method_stats(ev).agg(
        F.count(F.lit(1)).alias("n"), F.max_by("method", order).alias("best"), F.min_by("method", order).alias("worst"),
        (F.max("success_rate") - F.min("success_rate")).alias("gap"),
    )
    return _insights(
        ends,
        _insight((F.col("n") > 1) & (F.col("gap") > 0.1), "method_performance", "method_disparity", "warning",
                 F.concat(F.lit("Significant performance gap between methods: "), F.col("best"), F.lit(" vs "), F.col("worst")),
                 "Consider optimizing underperforming methods or adjusting method selection logic", F.col("gap")),
    )


def error_insights(ev: DataFrame) -> DataFrame:
    by_type = ev.groupBy("success", "error_type").agg(F.count(F.lit(1)).alias("n"))
    typed = ~F.col("success") & F.col("error_type").isNotNull()
    stats = by_type.agg(
        F.sum("n").alias("total"), F.sum(F.when(~F.col("success"), F.col("n")).otherwise(0)).alias("errors"),
        F.max(F.when(typed, F.struct(F.col("n"), F.col("error_type")))).alias("top"),
    ).filter(F.col("total") > 0)
    rate, top = F.col("errors") / F.col("total"), F.col("top")
    return _insights(
        stats,
        _insight(rate > 0.1, "error_rate", "high_error_rate", F.when(rate > 0.2, "critical").otherwise("warning"),
                 F.format_string("High error rate detected: %.1f%%", rate * 100),
                 "Investigate common error causes and improve input validation", rate),
        _insight(top["n"] > F.col("errors") * 0.3, "error_patterns", "dominant_error_type", "warning",
                 F.concat(F.lit("Dominant error type: "), top["error_type"], F.lit(" ("), top["n"].cast("string"), F.lit(" occurrences)")),
                 F.concat(F.lit("Focus on resolving "), top["error_type"], F.lit(" errors as they represent the majority")),
                 top["n"] / F.col("errors")),
    )


def load_insights(ev: DataFrame) -> DataFrame:
    hourly = ev.groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count(F.lit(1)).alias("c"))
    stats = hourly.agg(F.count(F.lit(1)).alias("hours"), F.avg("c").alias("avg"), F.stddev_samp("c").alias("sd"))
    return _insights(
        stats,
        _insight((F.col("hours") >= 2) & (F.col("sd") > F.col("avg") * 0.5), "resource_utilization", "uneven_load_distribution", "info",
                 F.format_string("Uneven load distribution detected (std: %.1f, avg: %.1f)", F.col("sd"), F.col("avg")),
                 "Consider implementing load balancing or caching during peak hours", F.col("sd") / F.col("avg")),
    )


def confidence_insights(ev: DataFrame) -> DataFrame:
    stats = ev.filter(F.col("confidence") > 0).agg(F.avg((F.col("confidence") < 0.6).cast("double")).alias("low"))
    low = F.col("low")
    return _insights(
        stats,
        _insight(low > 0.2, "confidence", "low_confidence_rate", "warning",
                 F.format_string("High rate of low-confidence results: %.1f%%", low * 100),
                 "Review and improve pattern quality, consider additional training data", low),
    )


def all_insights(ev: DataFrame) -> DataFrame:
    parts = [processing_time_insights, method_insights, error_insights, load_insights, confidence_insights]
    return union_all([p(ev) for p in parts])


# --- pattern ranking and reports --------------------------------------------


def pattern_ranking(ev: DataFrame) -> DataFrame:
    """Score, rank, bottlenecks and recommendations per pattern."""
    ok, conf, ms = F.col("success"), F.col("confidence"), F.col("processing_time_ms")
    per = ev.filter(F.col("pattern_id").isNotNull()).groupBy("pattern_id", F.when(~ok, F.col("error_type")).alias("err")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(ok).alias("s"),
        F.sum(F.when(conf > 0, conf)).alias("cs"), F.count_if(conf > 0).alias("cn"),
        F.sum(F.when(ms > 0, ms)).alias("ts"), F.count_if(ms > 0).alias("tn"),
    )
    agg = per.groupBy("pattern_id").agg(
        F.sum("n").alias("n"), (F.sum("s") / F.sum("n")).alias("success_rate"),
        F.coalesce(F.try_divide(F.sum("cs"), F.sum("cn")), F.lit(0.0)).alias("avg_confidence"),
        F.coalesce(F.try_divide(F.sum("ts"), F.sum("tn")), F.lit(0.0)).alias("avg_time"),
        F.max(F.when(F.col("err").isNotNull(), F.struct(F.col("n"), F.col("err")))).alias("top"),
    )
    sr, ac, at, err = F.col("success_rate"), F.col("avg_confidence"), F.col("avg_time"), F.col("top.err")
    score = sr * 0.4 + ac * 0.4 + F.greatest(F.lit(0.0), 1 - at / 1000) * 0.2
    out = agg.withColumn("performance_score", score)
    rank = Window.orderBy(F.col("performance_score").desc(), "pattern_id")  # one row per pattern
    fault = F.array_compact(F.array(
        F.when(sr < 0.8, "Low success rate"), F.when(ac < 0.7, "Low confidence scores"), F.when(at > 200, "Slow processing"),
        F.when(err.isNotNull(), F.concat(F.lit("Common error: "), err)),
    ))
    advice = F.array_compact(F.array(
        F.when(sr < 0.8, "Review pattern regex for edge cases and improve matching logic"),
        F.when(ac < 0.7, "Enhance pattern specificity and add validation rules"),
        F.when(at > 200, "Optimize regex compilation and consider caching compiled patterns"),
        F.when(err.isNotNull(), F.concat(F.lit("Focus on resolving "), err, F.lit(" errors (most common)"))),
        F.when((sr > 0.9) & (ac > 0.8), "Pattern performing well - consider using as template for new patterns"),
    ))
    return out.select(
        "pattern_id", F.row_number().over(rank).cast("long").alias("usage_rank"), "success_rate", "avg_confidence", "avg_time",
        "performance_score", F.greatest(F.lit(0.0), 1 - F.col("performance_score")).alias("optimization_potential"),
        F.array_join(fault, "; ").alias("bottlenecks"), F.array_join(advice, "; ").alias("recommendations"),
    )


def prioritized_recommendations(ev: DataFrame) -> DataFrame:
    """(priority, message) rows from insights and weak patterns."""
    level = F.col("impact_level")
    ins = all_insights(ev).select(
        F.when(level == "critical", "high").when(level == "warning", "medium").otherwise("low").alias("priority"),
        F.concat(F.lit("["), F.upper(level), F.lit("] "), F.col("description"), F.lit(": "), F.col("recommendation")).alias("message"),
    )
    pat = pattern_ranking(ev).filter(F.col("optimization_potential") > 0.3).select(
        F.when(F.col("optimization_potential") > 0.5, "high").otherwise("medium").alias("priority"),
        F.concat(F.lit("Pattern "), F.col("pattern_id"), F.lit(": "), F.col("recommendations")).alias("message"),
    )
    return ins.unionByName(pat)


def pattern_health(ev: DataFrame) -> DataFrame:
    score = F.col("success_rate") * 0.4 + F.col("avg_confidence") * 0.3 + F.col("performance_score") * 0.3
    out = pattern_ranking(ev).withColumn("health_score", score)
    h = F.col("health_score")
    return out.select(
        "pattern_id", "health_score",
        F.when(h >= 0.8, "Excellent").when(h >= 0.6, "Good").when(h >= 0.4, "Fair").otherwise("Poor").alias("health_status"),
        "recommendations",
    )


def compare_patterns(ev: DataFrame, pattern_ids: Sequence[str]) -> DataFrame:
    chosen = pattern_ranking(ev).filter(F.col("pattern_id").isin(list(pattern_ids)))
    order = F.struct("performance_score", "pattern_id")
    return chosen.agg(
        F.count(F.lit(1)).alias("patterns_compared"), F.max_by("pattern_id", order).alias("best_performing"),
        F.min_by("pattern_id", order).alias("worst_performing"), F.avg("success_rate").alias("avg_success_rate"),
        F.avg("avg_confidence").alias("avg_confidence"),
    )


def threshold_suggestions(ranking: DataFrame, thresholds: DataFrame, default: float = 0.7) -> DataFrame:
    """Small threshold moves for patterns with an odd mix of score and success."""
    r = ranking.join(thresholds.select("pattern_id", F.col("threshold").alias("t")), "pattern_id", "left")
    t, ps, sr = F.coalesce(F.col("t"), F.lit(default)), F.col("performance_score"), F.col("success_rate")
    lower, higher = (ps < 0.8) & (sr > 0.9), (ps > 0.9) & (sr < 0.85)
    return r.filter(lower | higher).select(
        "pattern_id", t.alias("current_threshold"),
        F.when(lower, F.greatest(F.lit(0.5), t - 0.05)).otherwise(F.least(F.lit(0.95), t + 0.03)).alias("suggested_threshold"),
        F.when(lower, 2.0).otherwise(1.5).alias("expected_improvement"),
    )


def metric_series(metrics: DataFrame) -> DataFrame:
    """Per metric name: points kept, counter total and latest value. Rows: name, value, ts, row id."""
    newest = F.max_by("value", F.struct("ts", "event_id"))
    return metrics.groupBy("name").agg(F.count(F.lit(1)).alias("points_kept"), newest.alias("latest_value"), F.sum("value").alias("counter_total"))


def trends(events: DataFrame) -> DataFrame:
    w = in_time_windows(events)
    parts = [processing_time_trend(w), success_rate_trend(w), confidence_trend(w), throughput_trend(w)]
    return union_all([p.select(*_TREND) for p in parts])


def report_tables(events: DataFrame, hours: int = 24, level: str = "full") -> dict[str, DataFrame]:
    """The tables of the report; ``summary`` leaves out trends and recommendations."""
    ev = recent(events, f"{hours} hours")
    tables = {"performance": performance_metrics(ev), "patterns": pattern_ranking(ev)}
    if level in ("detailed", "full"):
        tables["trends"] = trends(ev)
    if level == "full":
        tables["recommendations"] = prioritized_recommendations(ev)
    return tables


def write_report_tables(tables: dict[str, DataFrame], path: str, fmt: str = "csv") -> None:
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        (writer.option("header", True).csv if fmt == "csv" else writer.json)(f"{path}/{name}")


def comprehensive_report(events: DataFrame, hours: int = 24) -> DataFrame:
    """All report tables as (section, key, value) rows, value a JSON text."""
    keys = {"performance": F.lit("all"), "patterns": F.col("pattern_id"), "trends": F.concat_ws("/", "time_period", "metric_name"),
            "recommendations": F.col("priority")}
    parts = [
        df.select(F.lit(name).alias("section"), keys[name].alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
        for name, df in report_tables(events, hours).items()
    ]
    parts.append(system_metrics(recent(events, f"{hours} hours")).select(
        F.lit("system").alias("section"), F.concat_ws("/", "section", "name").alias("key"), F.col("value").cast("string").alias("value")
    ))
    return union_all(parts)


def top_patterns(events: DataFrame, k: int = 5) -> DataFrame:
    return pattern_metrics(events).orderBy(F.col("usage_count").desc(), "pattern_id").limit(k)


def current_alerts(events: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` of: critical and warning insights of the last hour, then high-priority recommendations."""
    ev = recent(events, "1 hour")
    ins = all_insights(ev).filter(F.col("impact_level").isin("critical", "warning")).select(
        F.lit(1).alias("part"), F.concat(F.upper("impact_level"), F.lit(": "), F.col("description")).alias("alert")
    )
    rec = prioritized_recommendations(ev).filter(F.col("priority") == "high").select(
        F.lit(2).alias("part"), F.concat(F.lit("RECOMMENDATION: "), F.col("message")).alias("alert")
    )
    return ins.unionByName(rec).orderBy("part", "alert").limit(k).select("part", "alert")
