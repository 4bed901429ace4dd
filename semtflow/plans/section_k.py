"""Queries of the adaptive threshold section (K) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.operators import thresholds as k
from semtflow.operators.analytics import latest, recent
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import metric_events


def events(spark, sf_dir):
    """Match events keyed by event type and a digit of the user: 50 patterns of two types."""
    ev = metric_events(spark, sf_dir)
    return ev.withColumn(
        "pattern_type", F.when(F.col("pattern_id").isin("click", "view"), "regex").otherwise("template")
    ).withColumn("pattern_id", F.concat_ws("_", "pattern_id", (F.col("user_id") % 10).cast("string")))


def stats(spark, sf_dir):
    return k.pattern_stats(events(spark, sf_dir))


KEV = f"""{d.EVENTS}, kev AS (SELECT * REPLACE (pattern_id || '_' || CAST(user_id % 10 AS VARCHAR) AS pattern_id),
   CASE WHEN pattern_id IN ('click', 'view') THEN 'regex' ELSE 'template' END AS pattern_type FROM ev),
   o AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY ts DESC, event_id DESC) AS rn,
                count(*) OVER (PARTITION BY pattern_id) AS n FROM kev), nowt AS (SELECT max(ts) AS now FROM ev)"""
EMA = """ema AS (SELECT pattern_id, max(n) AS seen,
   sum(success::INT * CASE WHEN rn = n THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, rn - 1) END) AS e FROM o GROUP BY 1),
   th AS (SELECT *, CASE WHEN seen >= 3 THEN greatest(0.2, least(0.9, 0.4 - (e - 0.5) * 0.2)) ELSE 0.4 END AS t FROM ema)"""
CUM = """cs AS (SELECT pattern_id, count(*) FILTER (success) AS success_count, count(*) AS total_count, avg(success::INT) AS success_rate,
   avg(confidence) AS avg_confidence, max(ts) AS last_updated FROM kev GROUP BY 1)"""
RECENT20 = "rp AS (SELECT pattern_id, avg(success::INT) AS recent_success, avg(confidence) AS recent_confidence FROM o WHERE rn <= 20 GROUP BY 1)"
STAB = """st AS (SELECT pattern_id, CASE WHEN count(*) < 10 THEN 0.0 ELSE greatest(0.0, 1.0 - stddev_pop(confidence) / 0.2) END AS stability
   FROM o WHERE rn <= 50 GROUP BY 1)"""
POINTS = """rw AS (SELECT pattern_id, ts, n - rn + 1 AS volume, threshold_used AS threshold,
     avg(success::INT) OVER w AS success_rate, 0.1 * pow(0.9::DOUBLE, n - rn + 1) * sum(confidence * pow(0.9::DOUBLE, -(n - rn + 1))) OVER w AS confidence_avg
     FROM o WINDOW w AS (PARTITION BY pattern_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
   pts AS (SELECT * FROM rw WHERE volume % 10 = 0)"""
# The same means with weights that restart every 1,000 uses: 0.9 to the power of a count of thousands leaves the range of a double.
EMA_POINTS = """rb AS (SELECT pattern_id, ts, event_id, n - rn + 1 AS volume, (n - rn) // 1000 AS blk, (n - rn) % 1000 AS i, success, confidence, threshold_used AS threshold FROM o),
   rw AS (SELECT pattern_id, ts, volume, blk, i, threshold, avg(success::INT) OVER (PARTITION BY pattern_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS success_rate,
     0.1 * pow(0.9::DOUBLE, i) * sum(confidence * pow(0.9::DOUBLE, -i)) OVER (PARTITION BY pattern_id, blk ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS inside FROM rb),
   ow AS (SELECT pattern_id, blk, inside AS own FROM rw WHERE i = 999),
   bc AS (SELECT a.pattern_id, a.blk, sum(b.own * pow(0.9::DOUBLE, 1000 * (a.blk - 1 - b.blk))) AS carry
     FROM (SELECT DISTINCT pattern_id, blk FROM rw) a JOIN ow b ON b.pattern_id = a.pattern_id AND b.blk < a.blk GROUP BY 1, 2),
   pts AS (SELECT rw.*, inside + coalesce(carry, 0) * pow(0.9::DOUBLE, i + 1) AS confidence_avg FROM rw LEFT JOIN bc ON bc.pattern_id = rw.pattern_id AND bc.blk = rw.blk WHERE volume % 10 = 0)"""
TREND = """pw AS (SELECT pattern_id, success_rate, row_number() OVER (PARTITION BY pattern_id ORDER BY volume) AS i,
     count(*) OVER (PARTITION BY pattern_id) AS kk FROM pts, nowt WHERE ts > now - INTERVAL 7 DAY),
   pa AS (SELECT pattern_id, max(kk) AS kk, var_pop(success_rate) AS va, avg(success_rate) FILTER (i > kk // 2) - avg(success_rate) FILTER (i <= kk // 2) AS df
     FROM pw GROUP BY 1),
   tr AS (SELECT pattern_id, kk AS points_used, CASE WHEN kk < 3 THEN 'stable' WHEN va > 0.01 THEN 'volatile' WHEN df > 0.05 THEN 'improving'
     WHEN df < -0.05 THEN 'declining' ELSE 'stable' END AS trend FROM pa)"""
STATS = f"""{KEV}, {POINTS}, {TREND}, ps AS (SELECT pattern_id, max(n) AS n, count(*) FILTER (success) AS s, avg(success::INT) AS sr,
     sum(confidence * 0.1 * pow(0.9, rn - 1)) AS conf, sum(processing_time_ms * 0.1 * pow(0.9, rn - 1)) AS ms, max(pattern_type) AS pattern_type,
     max(threshold_used) FILTER (rn = 1) AS t, max(n) // 10 AS points FROM o GROUP BY 1),
   stats AS (SELECT ps.*, coalesce(trend, 'stable') AS trend FROM ps LEFT JOIN tr USING (pattern_id))"""


@query(
    "k01_ema_threshold",
    f"""WITH {KEV}, {EMA} SELECT pattern_id, round(e, 6) AS ema_success, seen, round(CAST(t AS DOUBLE), 6) AS threshold FROM th""",
)
def k01(spark, sf_dir):
    return rounded(k.ema_threshold(events(spark, sf_dir)).drop("last_updated"))


@query(
    "k02_threshold_report",
    f"""WITH {KEV}, {EMA} SELECT pattern_id, round(t, 6) AS current_threshold, 0.4::DOUBLE AS default_threshold,
        abs(t - 0.4) > 1e-12 AS is_adjusted, round(e, 6) AS ema_success, seen, seen >= 3 AS has_enough_samples FROM th""",
)
def k02(spark, sf_dir):
    return rounded(k.threshold_report(k.ema_threshold(events(spark, sf_dir))))


@query(
    "k03_cumulative_stats",
    f"""WITH {KEV}, {CUM} SELECT pattern_id, success_count, total_count, round(success_rate, 6) AS success_rate,
        round(avg_confidence, 6) AS avg_confidence, strftime(last_updated, '%Y-%m-%d %H:%M:%S') AS last_updated FROM cs""",
)
def k03(spark, sf_dir):
    out = rounded(k.cumulative_stats(events(spark, sf_dir)))
    return out.withColumn("last_updated", F.date_format("last_updated", "yyyy-MM-dd HH:mm:ss"))


@query(
    "k04_recent_performance",
    f"""WITH {KEV} SELECT pattern_id, round(avg(success::INT), 6) AS recent_success, round(avg(confidence), 6) AS recent_confidence
        FROM o WHERE rn <= 50 GROUP BY 1""",
)
def k04(spark, sf_dir):
    return rounded(k.recent_performance(events(spark, sf_dir), 50))


@query("k05_stability", f"WITH {KEV}, {STAB} SELECT pattern_id, round(CAST(stability AS DOUBLE), 6) AS stability FROM st")
def k05(spark, sf_dir):
    return rounded(k.stability(events(spark, sf_dir)))


@query(
    "k06_confidence_trend_7d",
    f"""WITH {KEV}, w AS (SELECT pattern_id, confidence, row_number() OVER (PARTITION BY pattern_id ORDER BY ts, event_id) AS i,
          count(*) OVER (PARTITION BY pattern_id) AS c FROM kev, nowt WHERE ts >= now - INTERVAL 7 DAY),
        h AS (SELECT pattern_id, max(c) AS c, avg(confidence) FILTER (i <= c // 2) AS e, avg(confidence) FILTER (i > c // 2) AS l FROM w GROUP BY 1)
        SELECT pattern_id, CASE WHEN c < 2 THEN 'insufficient_data' WHEN l > e + 0.05 THEN 'improving' WHEN l < e - 0.05 THEN 'declining'
          ELSE 'stable' END AS trend, round(CASE WHEN c < 2 THEN 0.0 ELSE l - e END, 6) AS trend_change FROM h""",
)
def k06(spark, sf_dir):
    return rounded(k.confidence_trend_7d(events(spark, sf_dir)))


STEP = f"""{KEV}, {CUM}, {RECENT20}, {STAB},
   si AS (SELECT cs.*, recent_success, stability FROM cs JOIN rp USING (pattern_id) JOIN st USING (pattern_id)),
   s1 AS (SELECT *, {k.STEP_KIND} AS kind FROM si), s2 AS (SELECT *, CAST({k.STEP_MOVE} AS DOUBLE) AS move FROM s1),
   s3 AS (SELECT *, greatest(0.6, least(0.95, 0.8 + move)) AS target FROM s2),
   steps AS (SELECT pattern_id, kind, 0.8::DOUBLE AS old_threshold,
     CASE WHEN kind = 'no_data' OR abs(target - 0.8) < 0.01 THEN 0.8 ELSE target END AS new_threshold, success_rate, recent_success, total_count FROM s3)"""


def steps(spark, sf_dir):
    return k.step_threshold(k.step_inputs(events(spark, sf_dir)))


@query(
    "k07_step_threshold",
    f"""WITH {STEP} SELECT pattern_id, kind, old_threshold, round(CAST(new_threshold AS DOUBLE), 6) AS new_threshold,
        round(success_rate, 6) AS success_rate, round(recent_success, 6) AS recent_success, total_count FROM steps""",
)
def k07(spark, sf_dir):
    return rounded(steps(spark, sf_dir))


@query(
    "k08_batch_step",
    f"""WITH {STEP} SELECT count(*) AS patterns_tracked, count(*) FILTER (abs(new_threshold - old_threshold) > 0.01) AS adjustments,
        round(coalesce(avg(greatest(0.0, recent_success - success_rate)) FILTER (total_count >= 10), 0), 6) AS improvement_rate FROM steps""",
)
def k08(spark, sf_dir):
    return rounded(k.batch_step(steps(spark, sf_dir)))


@query(
    "k09_top_performers",
    f"""WITH {KEV}, {CUM} SELECT pattern_id, round(success_rate, 6) AS success_rate FROM cs WHERE total_count >= 10
        ORDER BY cs.success_rate DESC, pattern_id LIMIT 10""",
)
def k09(spark, sf_dir):
    return rounded(k.top_performers(k.cumulative_stats(events(spark, sf_dir))))


@query(
    "k09_low_performers",
    f"""WITH {KEV}, {CUM} SELECT pattern_id, round(success_rate, 6) AS success_rate FROM cs
        WHERE total_count >= 10 AND cs.success_rate < 0.8 ORDER BY cs.success_rate, pattern_id LIMIT 10""",
)
def k09_low(spark, sf_dir):
    return rounded(k.low_performers(k.cumulative_stats(events(spark, sf_dir)), threshold=0.8))


@query(
    "k10_threshold_histogram",
    f"WITH {STEP} SELECT round(CAST(new_threshold AS DOUBLE), 1) AS bucket, count(*) AS n_patterns FROM steps GROUP BY 1",
)
def k10(spark, sf_dir):
    return k.threshold_histogram(steps(spark, sf_dir))


@query(
    "k11_ema_metrics",
    f"""WITH {STATS} SELECT pattern_id, n AS total_count, s AS success_count, round(sr, 6) AS success_rate, round(conf, 6) AS ema_confidence,
        round(ms, 6) AS ema_time FROM stats""",
)
def k11(spark, sf_dir):
    return rounded(k.ema_metrics(events(spark, sf_dir)))


@query(
    "k12_history_points",
    f"""WITH {KEV}, {EMA_POINTS} SELECT pattern_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, volume, round(success_rate, 6) AS success_rate,
        round(threshold, 6) AS threshold, round(confidence_avg, 6) AS confidence_avg FROM pts""",
)
def k12(spark, sf_dir):
    return rounded(k.history_points(events(spark, sf_dir))).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("k13_performance_trend", f"WITH {KEV}, {POINTS}, {TREND} SELECT pattern_id, trend, points_used FROM tr")
def k13(spark, sf_dir):
    ev = events(spark, sf_dir)
    return k.performance_trend(k.history_points(ev), latest(ev))


@query("k14_performance_score", f"WITH {STATS} SELECT pattern_id, trend, round(CAST({k.SCORE} AS DOUBLE), 6) AS performance_score FROM stats")
def k14(spark, sf_dir):
    return rounded(k.performance_score(stats(spark, sf_dir)))


_UNION = " UNION ALL ".join(
    f"SELECT pattern_id, '{n}' AS strategy, round(CAST({e} AS DOUBLE), 6) AS threshold FROM stats" for n, e in k.STRATEGIES.items()
)


@query("k15_strategy_threshold", f"WITH {STATS} {_UNION}")
def k15(spark, sf_dir):
    return rounded(k.strategy_thresholds(stats(spark, sf_dir)))


NEEDED = f"nd AS (SELECT *, CAST({k.BALANCED} AS DOUBLE) AS best, n >= 100 AND (sr < 0.85 OR trend = 'declining' OR abs({k.BALANCED} - t) > 0.05) AS needed FROM stats)"


@query("k16_needs_optimization", f"WITH {STATS}, {NEEDED} SELECT pattern_id, round(best, 6) AS best, needed FROM nd")
def k16(spark, sf_dir):
    return rounded(k.needs_optimization(stats(spark, sf_dir)).select("pattern_id", "best", "needed"))


OPTIMIZED = f"""{NEEDED}, ox AS (SELECT *, greatest(0.1, least(0.95, greatest(t - 0.2, least(t + 0.2, best)))) AS x FROM nd),
   og AS (SELECT *, CAST({k.GAIN} AS DOUBLE) AS gain, CAST({k.ADVICE_CONFIDENCE} AS DOUBLE) AS sure FROM ox),
   op AS (SELECT pattern_id, t AS old_threshold, CASE WHEN needed THEN x ELSE t END AS new_threshold,
     CASE WHEN needed THEN gain ELSE 0.0 END AS expected_improvement, CASE WHEN needed THEN sure ELSE 0.0 END AS confidence_score,
     needed AND gain > 0.01 AS optimization_applied, sr AS performance_before FROM og)"""


@query(
    "k17_optimize",
    f"""WITH {STATS}, {OPTIMIZED} SELECT pattern_id, round(old_threshold, 6) AS old_threshold, round(new_threshold, 6) AS new_threshold,
        round(expected_improvement, 6) AS expected_improvement, round(confidence_score, 6) AS confidence_score, optimization_applied,
        round(performance_before, 6) AS performance_before FROM op""",
)
def k17(spark, sf_dir):
    return rounded(k.optimize(stats(spark, sf_dir)))


@query(
    "k18_learning_report",
    f"""WITH {STATS}, {OPTIMIZED}
        SELECT 'type' AS section, coalesce(pattern_type, 'all') AS name, count(*) AS n, round(avg(sr), 6) AS success_rate, round(avg(conf), 6) AS confidence
        FROM stats GROUP BY ROLLUP (pattern_type)
        UNION ALL SELECT 'trend', trend, count(*), round(avg(sr), 6), round(avg(conf), 6) FROM stats GROUP BY 2
        UNION ALL SELECT 'optimizations', 'applied', count(*) FILTER (optimization_applied),
          round(avg(expected_improvement) FILTER (optimization_applied), 6), NULL FROM op""",
)
def k18(spark, sf_dir):
    s = stats(spark, sf_dir)
    return rounded(k.learning_report(s, k.optimize(s)))


@query(
    "k19_hourly_daily_stats",
    f"""WITH {KEV}, g AS (
          SELECT pattern_id, success, 'hour' AS grain, date_trunc('hour', ts) AS b FROM kev, nowt
          WHERE date_trunc('hour', ts) >= date_trunc('hour', now - INTERVAL 7 DAY)
          UNION ALL SELECT pattern_id, success, 'day', date_trunc('day', ts)::TIMESTAMP FROM kev, nowt
          WHERE date_trunc('day', ts) >= date_trunc('day', now - INTERVAL 30 DAY))
        SELECT pattern_id, grain, strftime(b, '%Y-%m-%d %H:%M:%S') AS bucket, count(*) AS total, count(*) FILTER (success) AS successful,
               count(*) FILTER (NOT success) AS failed, round(avg(success::INT), 6) AS success_rate FROM g GROUP BY 1, 2, 3""",
)
def k19(spark, sf_dir):
    out = rounded(k.hourly_daily_stats(events(spark, sf_dir)))
    return out.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


ALERTS = """al AS (SELECT pattern_id, 'low_success_rate' AS type, 'high' AS severity, sr AS value, 0.5::DOUBLE AS threshold FROM stats WHERE sr < 0.5 AND n > 50
   UNION ALL SELECT pattern_id, 'low_confidence', 'medium', conf, 0.3 FROM stats WHERE conf < 0.3 AND n > 30
   UNION ALL SELECT pattern_id, 'high_processing_time', 'medium', ms, 1000.0 FROM stats WHERE ms > 1000)"""


@query(
    "k20_performance_alerts",
    f"""WITH {STATS.replace("sum(processing_time_ms * 0.1", "20 * sum(processing_time_ms * 0.1")}, {ALERTS}
        SELECT pattern_id, type, severity, round(value, 6) AS value, threshold FROM al
        WHERE NOT (type = 'low_confidence' AND pattern_id LIKE 'view%')""",
)
def k20(spark, sf_dir):
    s = stats(spark, sf_dir).withColumn("ms", F.col("ms") * 20)
    active = s.filter(F.col("pattern_id").startswith("view")).select("pattern_id", F.lit("low_confidence").alias("type"))
    return rounded(k.performance_alerts(s, active))


@query(
    "k21_recent_trend",
    f"""WITH {STATS}, w AS (SELECT pattern_id, count(*) AS events, avg(success::INT) AS a, avg(confidence) AS b, avg(processing_time_ms) AS c
          FROM kev, nowt WHERE ts >= now - INTERVAL 12 HOUR GROUP BY 1)
        SELECT pattern_id, events, CASE WHEN events < 2 THEN 'insufficient_data' WHEN a - sr > 0.05 THEN 'improving' WHEN a - sr < -0.05
          THEN 'declining' ELSE 'stable' END AS trend, round(a - sr, 6) AS success_rate_change, round(b - conf, 6) AS confidence_change,
          round(c - ms, 6) AS processing_time_change FROM w JOIN stats USING (pattern_id)""",
)
def k21(spark, sf_dir):
    return rounded(k.recent_trend(events(spark, sf_dir), "12 hours"))


@query(
    "k22_pattern_trend",
    f"""WITH {KEV}, w AS (SELECT pattern_id, success::INT AS v, confidence, n, n - rn + 1 AS i FROM o),
        h AS (SELECT pattern_id, max(n) AS c, avg(v) FILTER (i <= n // 2) AS a, avg(v) FILTER (i > n // 2) AS b,
                avg(confidence) FILTER (i > n // 2) - avg(confidence) FILTER (i <= n // 2) AS cc FROM w GROUP BY 1)
        SELECT pattern_id, c AS events_analyzed, round(a, 6) AS first_half_success_rate, round(b, 6) AS second_half_success_rate,
               round(cc, 6) AS confidence_change, CASE WHEN c < 5 THEN 'insufficient_data' WHEN b - a > 0.1 THEN 'strongly_improving'
               WHEN b - a > 0.03 THEN 'improving' WHEN b - a < -0.1 THEN 'strongly_declining' WHEN b - a < -0.03 THEN 'declining' ELSE 'stable' END AS trend,
               round(b - a, 6) AS success_rate_change FROM h""",
)
def k22(spark, sf_dir):
    return rounded(k.pattern_trend(events(spark, sf_dir)))


@query(
    "k23_system_trend",
    f"""WITH {KEV}, h AS (SELECT date_trunc('hour', ts) AS h, avg(success::INT) AS r, count(*) AS c FROM kev GROUP BY 1),
        i AS (SELECT *, row_number() OVER (ORDER BY h) - 1 AS x FROM h),
        a AS (SELECT regr_slope(r, x) AS s, count(*) AS hours, CAST(sum(c) AS BIGINT) AS ev FROM i)
        SELECT round(s, 6) AS slope, hours AS hours_analyzed, ev AS total_events, CASE WHEN hours < 3 OR ev < 10 THEN 'insufficient_data'
          WHEN s > 0.01 THEN 'improving' WHEN s < -0.01 THEN 'declining' ELSE 'stable' END AS trend FROM a""",
)
def k23(spark, sf_dir):
    return rounded(k.system_trend(events(spark, sf_dir)))


@query(
    "k24_system_summary",
    f"""WITH {STATS}, {ALERTS} SELECT count(*) AS total_patterns, CAST(sum(n) AS BIGINT) AS total_processed, round(sum(s) / sum(n), 6) AS overall_success_rate,
        round(avg(conf), 6) AS average_confidence, round(avg(ms), 6) AS average_processing_time, (SELECT count(*) FROM al) AS active_alerts FROM stats""",
)
def k24(spark, sf_dir):
    return rounded(k.system_summary(stats(spark, sf_dir)))


SWEEP = f"""sx AS (SELECT stats.*, step, 0.1 + step * (0.85 / 19) AS x FROM stats, (SELECT unnest(range(20)) AS step)),
   sw AS (SELECT pattern_id, step, x AS threshold, CAST({k.EST_SUCCESS} AS DOUBLE) AS success_rate, CAST({k.EST_CONFIDENCE} AS DOUBLE) AS confidence,
     ms AS processing_time FROM sx)"""
FRONT = """pf AS (SELECT a.* FROM sw a WHERE NOT EXISTS (SELECT 1 FROM sw b WHERE b.pattern_id = a.pattern_id
     AND b.success_rate >= a.success_rate AND b.confidence >= a.confidence AND b.processing_time <= a.processing_time
     AND (b.success_rate > a.success_rate OR b.confidence > a.confidence OR b.processing_time < a.processing_time))),
   bp AS (SELECT * FROM (SELECT pattern_id, threshold, sc AS score, row_number() OVER (PARTITION BY pattern_id ORDER BY sc DESC, step) AS r
     FROM (SELECT *, round(success_rate * 0.5 + confidence * 0.3 + 0.2 / (1 + processing_time), 12) AS sc FROM pf)) WHERE r = 1)"""
_R = "round(threshold, 6) AS threshold, round(success_rate, 6) AS success_rate, round(confidence, 6) AS confidence, round(processing_time, 6) AS processing_time"


@query("k25_threshold_sweep", f"WITH {STATS}, {SWEEP} SELECT pattern_id, step::BIGINT AS step, {_R} FROM sw")
def k25(spark, sf_dir):
    return rounded(k.threshold_sweep(stats(spark, sf_dir))).withColumn("step", F.col("step").cast("long"))


@query("k26_pareto_front", f"WITH {STATS}, {SWEEP}, {FRONT} SELECT pattern_id, step::BIGINT AS step, {_R} FROM pf")
def k26(spark, sf_dir):
    return rounded(k.pareto_front(k.threshold_sweep(stats(spark, sf_dir)))).withColumn("step", F.col("step").cast("long"))


@query("k27_best_pareto", f"WITH {STATS}, {SWEEP}, {FRONT} SELECT pattern_id, round(threshold, 6) AS threshold, round(score, 6) AS score FROM bp")
def k27(spark, sf_dir):
    return rounded(k.best_pareto(k.pareto_front(k.threshold_sweep(stats(spark, sf_dir)))))


@query(
    "k28_auto_strategy",
    f"""WITH {STATS}, {SWEEP}, {FRONT}, au AS (SELECT stats.*, threshold AS p, CASE WHEN n > 1000 THEN 'volume_weighted' WHEN trend = 'volatile' THEN 'conservative'
          WHEN sr < 0.6 THEN 'aggressive' ELSE 'balanced' END AS strategy FROM stats JOIN bp USING (pattern_id)),
        ax AS (SELECT *, CAST(CASE strategy WHEN 'volume_weighted' THEN {k.BY_VOLUME} WHEN 'conservative' THEN {k.CAREFUL}
          WHEN 'aggressive' THEN {k.BOLD} ELSE p END AS DOUBLE) AS x FROM au)
        SELECT pattern_id, strategy, round(t, 6) AS old_threshold, round(x, 6) AS new_threshold,
               round(CAST(({k.EST_SUCCESS} - sr) * CASE WHEN strategy = 'aggressive' THEN 1.2 ELSE 1 END AS DOUBLE), 6) AS expected_improvement,
               round(CAST(CASE strategy WHEN 'volume_weighted' THEN 0.5 + 0.4 * least(1.0, n / 1000.0) WHEN 'conservative' THEN 0.8
                 WHEN 'aggressive' THEN 0.6 ELSE 0.7 END AS DOUBLE), 6) AS confidence_score, abs(x - t) > 0.01 AS optimization_applied FROM ax""",
)
def k28(spark, sf_dir):
    return rounded(k.auto_strategy(stats(spark, sf_dir)))


@query(
    "k29_group_optimize",
    f"""WITH {STATS}, gw AS (SELECT *, avg(sr) OVER (PARTITION BY pattern_type) < 0.7 AS weak FROM stats),
        gx AS (SELECT *, CAST(CASE WHEN weak THEN {k.BOLD} ELSE {k.CAREFUL} END AS DOUBLE) AS x FROM gw),
        gg AS (SELECT *, round(CAST(({k.EST_SUCCESS} - sr) * CASE WHEN weak THEN 1.2 ELSE 1.0 END AS DOUBLE), 12) AS gain FROM gx),
        gr AS (SELECT *, row_number() OVER (ORDER BY gain DESC, pattern_id) AS r FROM gg)
        SELECT pattern_id, pattern_type, round(x, 6) AS new_threshold, round(gain, 6) AS expected_improvement,
               r <= 10 AND abs(x - t) > 0.01 AS optimization_applied FROM gr""",
)
def k29(spark, sf_dir):
    return rounded(k.group_optimize(stats(spark, sf_dir), 10))


@query(
    "k30_threshold_distribution",
    f"""WITH {STATS} SELECT round(avg(t), 6) AS mean, round(median(t), 6) AS median, round(stddev_pop(t), 6) AS std, round(min(t), 6) AS min,
        round(max(t), 6) AS max, round(corr(t, sr), 6) AS threshold_success_correlation, round(corr(t, conf), 6) AS threshold_confidence_correlation,
        concat_ws('; ', CASE WHEN var_pop(t) > 0.1 THEN 'High threshold variance detected - consider standardizing thresholds' END,
          CASE WHEN avg((sr < 0.7)::INT) > 0.3 THEN '30%+ patterns underperforming - consider global threshold reduction' END,
          CASE WHEN avg((conf > 0.9)::INT) > 0.7 THEN 'High confidence across patterns - consider reducing thresholds for better recall' END)
          AS recommendations FROM stats""",
)
def k30(spark, sf_dir):
    return rounded(k.threshold_distribution(stats(spark, sf_dir)))


@query(
    "k31_gradient_step",
    f"""WITH {STATS}, l5 AS (SELECT *, row_number() OVER (PARTITION BY pattern_id ORDER BY volume DESC) AS r FROM pts),
        gs AS (SELECT pattern_id, count(*) AS kc, regr_slope(success_rate, threshold) AS g FROM l5 WHERE r <= 5 GROUP BY 1),
        gx AS (SELECT stats.*, coalesce(CASE WHEN kc >= 2 AND isfinite(g) THEN g ELSE 0.0 END, 0.0) AS g FROM stats LEFT JOIN gs USING (pattern_id)),
        gy AS (SELECT *, greatest(0.1, least(0.95, t - 0.1 * g)) AS x FROM gx)
        SELECT pattern_id, round(t, 6) AS old_threshold, round(g, 6) AS gradient,
               round(CASE WHEN {k.EST_SUCCESS} - sr > 0.01 THEN x ELSE t END, 6) AS new_threshold FROM gy""",
)
def k31(spark, sf_dir):
    ev = events(spark, sf_dir)
    return rounded(k.gradient_step(k.history_points(ev), k.pattern_stats(ev)))


def day_events(spark, sf_dir):
    return recent(metric_events(spark, sf_dir), "15 days")


PROFILE = f"""{d.EVENTS}, r AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 15 DAY),
   pr AS (SELECT pattern_id, count(*) AS n, avg(success::INT) AS sr, avg(processing_time_ms) FILTER (processing_time_ms > 0) AS ms,
     stddev_samp(processing_time_ms) FILTER (processing_time_ms > 0) AS sd, avg(confidence) FILTER (confidence > 0) AS ac,
     count(*) / greatest((epoch_us(max(ts)) - epoch_us(min(ts))) / 60000000.0::DOUBLE, 1.0) AS tp FROM r GROUP BY 1)"""
_GRID = ", ".join(f"CAST({e} AS DOUBLE) AS {n}" for n, e in k.GRID.items())


def grid_sql(strategy: str, minimum: float) -> str:
    return f"""{PROFILE}, gt AS (SELECT pr.*, 0.7::DOUBLE AS t, greatest(0.3, least(0.95, 0.7 + i * 0.02::DOUBLE)) AS x
       FROM pr, (SELECT unnest(range(-5, 6)) AS i) WHERE i <> 0 AND n >= 50),
     g1 AS (SELECT *, {_GRID} FROM gt),
     g2 AS (SELECT *, CAST({k.IMPROVE[strategy]} AS DOUBLE) AS imp, CAST({k.GRID_CONFIDENCE} AS DOUBLE) AS cl FROM g1),
     gr AS (SELECT pattern_id, t AS current_threshold, x AS recommended_threshold, imp AS expected_improvement, cl AS confidence_level,
       '{strategy}' AS strategy FROM g2 WHERE imp >= 1.0 AND cl >= {minimum})"""


_GR = """pattern_id, round(current_threshold, 6) AS current_threshold, round(recommended_threshold, 6) AS recommended_threshold,
   round(expected_improvement, 6) AS expected_improvement, round(confidence_level, 6) AS confidence_level, strategy"""


@query("k32_threshold_grid_recommend", f"WITH {grid_sql('performance', 0.5)} SELECT {_GR} FROM gr")
def k32(spark, sf_dir):
    return rounded(k.threshold_grid_recommend(day_events(spark, sf_dir), "performance", min_confidence=0.5))


@query("k32_threshold_grid_adaptive", f"WITH {grid_sql('adaptive', 0.5)} SELECT {_GR} FROM gr")
def k32_adaptive(spark, sf_dir):
    return rounded(k.threshold_grid_recommend(day_events(spark, sf_dir), "adaptive", min_confidence=0.5))


@query(
    "k33_recommendation_confidence",
    f"WITH {PROFILE} SELECT pattern_id, round(least(1.0, n / 1000.0), 6)::DOUBLE AS sample_size, round(greatest(0.3, 1 - sd / ms), 6) AS stability FROM pr",
)
def k33(spark, sf_dir):
    return rounded(k.recommendation_confidence(day_events(spark, sf_dir)))


@query(
    "k34_recommendation_tiers",
    f"""WITH {grid_sql('performance', 0.5)}, w AS (SELECT *, confidence_level * (1 + expected_improvement / 100) AS wt,
          round(abs(recommended_threshold - current_threshold), 9) AS ch FROM gr)
        SELECT pattern_id, round(recommended_threshold, 6) AS recommended_threshold,
          CASE WHEN expected_improvement >= 5 THEN 'high' WHEN expected_improvement >= 2 THEN 'medium' ELSE 'low' END AS impact,
          CASE WHEN ch > 0.1 THEN 'HIGH' WHEN ch > 0.05 THEN 'MEDIUM' ELSE 'LOW' END AS risk,
          CASE WHEN recommended_threshold < current_threshold
            THEN printf('Lower threshold from %.3f to %.3f to improve processing speed', current_threshold, recommended_threshold)
            ELSE printf('Raise threshold from %.3f to %.3f to improve accuracy', current_threshold, recommended_threshold) END AS rationale,
          round(sum(expected_improvement * wt) OVER () / sum(wt) OVER (), 6) AS overall_improvement FROM w""",
)
def k34(spark, sf_dir):
    return rounded(k.recommendation_tiers(k.threshold_grid_recommend(day_events(spark, sf_dir), "performance", min_confidence=0.5)))


@query(
    "k35_optimization_recommendations",
    f"""WITH {STATS}, z AS (SELECT *, CASE WHEN sr < 0.78 AND n > 50 THEN 'threshold_increase' WHEN sr > 0.95 AND conf > 0.9 THEN 'threshold_decrease'
          WHEN trend = 'volatile' THEN 'stabilization' END AS type FROM stats)
        SELECT pattern_id, type, round(t, 6) AS current_threshold, round(CASE type WHEN 'threshold_increase' THEN least(0.9, t + 0.1)
          WHEN 'threshold_decrease' THEN greatest(0.3, t - 0.05) ELSE t + 0.05 END, 6) AS recommended_threshold,
          CASE WHEN type = 'threshold_increase' THEN 'high' ELSE 'medium' END AS priority FROM z WHERE type IS NOT NULL""",
)
def k35(spark, sf_dir):
    return rounded(k.optimization_recommendations(stats(spark, sf_dir), low=0.78))


@query(
    "k36_expire_history",
    f"""WITH {KEV}, {POINTS} SELECT 'events' AS kind, count(*) AS n FROM kev, nowt WHERE ts > now - INTERVAL 7 DAY
        UNION ALL SELECT 'points', count(*) FROM pts, nowt WHERE ts > now - INTERVAL 20 DAY""",
)
def k36(spark, sf_dir):
    ev = events(spark, sf_dir)
    now = latest(ev)
    kept = k.expire_history(ev, 7, now).agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("kind"), "n")
    pts = k.expire_history(k.history_points(ev), 20, now).agg(F.count(F.lit(1)).alias("n"))
    return kept.unionByName(pts.select(F.lit("points").alias("kind"), "n"))


@query(
    "k37_health_table",
    f"""WITH {STATS}, c AS (SELECT count(*) AS n FROM stats), s AS (SELECT CASE WHEN n > 0 THEN 'healthy' ELSE 'warning' END AS status, n FROM c)
        SELECT 'learning_engine' AS component, status, n AS pattern_count FROM s UNION ALL SELECT 'performance_tracker', status, n FROM s
        UNION ALL SELECT 'scheduler', 'healthy', n FROM s UNION ALL SELECT 'overall', status, n FROM s""",
)
def k37(spark, sf_dir):
    return k.health_table(stats(spark, sf_dir))
