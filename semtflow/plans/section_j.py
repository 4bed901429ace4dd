"""Queries of the event analytics section (J) over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.operators import analytics as a
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.sources.derived import metric_events


def rounded(df, digits: int = 6):
    """Doubles rounded for comparison."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def day(spark, sf_dir):
    return a.recent(metric_events(spark, sf_dir), "24 hours")


def week(spark, sf_dir):
    return a.recent(metric_events(spark, sf_dir), "7 days")


DAY = f"{d.EVENTS}, r AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 24 HOUR)"
WEEK = f"{d.EVENTS}, r AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 7 DAY)"


@query(
    "j01_performance_metrics",
    f"""WITH {d.EVENTS},
        t AS (SELECT processing_time_ms AS v FROM ev WHERE processing_time_ms > 0),
        s AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS i, count(*) OVER () AS n FROM t),
        p AS (SELECT avg(v) AS a, max(v) FILTER (i = n // 2) AS m, max(v) FILTER (i = CAST(floor(n * 0.95) AS BIGINT)) AS p95,
                     max(v) FILTER (i = CAST(floor(n * 0.99) AS BIGINT)) AS p99 FROM s)
        SELECT round(a, 6) AS avg_ms, m AS median_ms, p95 AS p95_ms, p99 AS p99_ms,
               round(c / greatest(el, 1.0), 6) AS throughput_per_second, c AS total_processed, round(er, 6) AS error_rate
        FROM p, (SELECT count(*) AS c, avg(CASE WHEN success THEN 0.0 ELSE 1.0 END) AS er,
                        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::DOUBLE AS el FROM ev)""",
)
def j01(spark, sf_dir):
    return rounded(a.performance_metrics(metric_events(spark, sf_dir)))


PATTERN_METRICS_SQL = """
   m AS (SELECT pattern_id, count(*) AS usage_count, round(avg(success::INT), 6) AS success_rate,
                round(avg(confidence) FILTER (confidence > 0), 6) AS avg_confidence,
                round(avg(processing_time_ms) FILTER (processing_time_ms > 0), 6) AS avg_processing_time_ms,
                max(ts) AS last_used FROM ev GROUP BY 1),
   e AS (SELECT pattern_id, error_type, row_number() OVER (PARTITION BY pattern_id ORDER BY max(ts) DESC, error_type) AS r
         FROM ev WHERE NOT success AND error_type IS NOT NULL GROUP BY 1, 2),
   l AS (SELECT pattern_id, string_agg(error_type, ',' ORDER BY r) AS common_failures FROM e WHERE r <= 5 GROUP BY 1),
   pm AS (SELECT m.pattern_id, usage_count, success_rate, avg_confidence, avg_processing_time_ms,
          strftime(last_used, '%Y-%m-%d %H:%M:%S') AS last_used, coalesce(common_failures, '') AS common_failures
          FROM m LEFT JOIN l USING (pattern_id))"""


@query("j02_pattern_metrics", f"WITH {d.EVENTS}, {PATTERN_METRICS_SQL} SELECT * FROM pm")
def j02(spark, sf_dir):
    out = rounded(a.pattern_metrics(metric_events(spark, sf_dir)))
    return out.withColumn("last_used", F.date_format("last_used", "yyyy-MM-dd HH:mm:ss"))


LEVEL = """CASE WHEN confidence >= 0.9 THEN 'very_high' WHEN confidence >= 0.75 THEN 'high' WHEN confidence >= 0.6 THEN 'medium'
           WHEN confidence >= 0.4 THEN 'low' ELSE 'very_low' END"""


@query(
    "j03_system_metrics",
    f"""WITH {d.EVENTS}
        SELECT 'method' AS section, method AS name, count(*)::DOUBLE AS value FROM ev GROUP BY 2
        UNION ALL SELECT 'confidence', {LEVEL}, count(*) FROM ev WHERE confidence > 0 GROUP BY 2
        UNION ALL SELECT 'system', 'geographic_validation_rate', round(avg(geo_validated::INT), 6) FROM ev
        UNION ALL SELECT 'system', 'threshold_adjustments', count(*) FROM ev WHERE metric_type = 'threshold'""",
)
def j03(spark, sf_dir):
    return rounded(a.system_metrics(metric_events(spark, sf_dir)))


WINDOWED = f"""{d.EVENTS}, nowt AS (SELECT max(ts) AS t FROM ev),
   w(time_period, span) AS (VALUES ('1h', INTERVAL 1 HOUR), ('24h', INTERVAL 24 HOUR), ('7d', INTERVAL 7 DAY), ('30d', INTERVAL 30 DAY)),
   tw AS (SELECT w.time_period, ev.* FROM ev, w, nowt WHERE ts >= t - span)"""


@query(
    "j04_time_window_counts",
    f"WITH {WINDOWED} SELECT time_period, count(*) AS n_events FROM tw GROUP BY 1 HAVING count(*) >= 10",
)
def j04(spark, sf_dir):
    return a.time_window_counts(metric_events(spark, sf_dir))


def _halves_sql(value: str, where: str) -> str:
    return f"""WITH {WINDOWED},
      o AS (SELECT time_period, {value} AS v, row_number() OVER (PARTITION BY time_period ORDER BY ts, event_id) AS rn,
                   count(*) OVER (PARTITION BY time_period) AS n FROM tw WHERE {where}),
      h AS (SELECT time_period, max(n) AS n, avg(v) FILTER (rn <= n // 2) AS p, avg(v) FILTER (rn > n // 2) AS c,
                   stddev_samp(v) AS sd, max(v) AS top FROM o GROUP BY 1),
      x AS (SELECT *, CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 0.0 END AS ch FROM h WHERE n >= 10)"""


def _dir_sql(band: float, up: str, down: str) -> str:
    return f"CASE WHEN abs(ch) < {band} THEN 'stable' WHEN ch > 0 THEN '{up}' ELSE '{down}' END AS direction"


_TAIL = "round(ch, 6) AS change_percentage, round(c, 6) AS current_value, round(p, 6) AS previous_value"


@query(
    "j05_processing_time_trend",
    _halves_sql("processing_time_ms", "processing_time_ms > 0")
    + f"""SELECT time_period, 'processing_time_ms' AS metric_name, {_dir_sql(5, 'declining', 'improving')}, {_TAIL},
          round(greatest(0.1, least(1.0, 1.0 - CASE WHEN c > 0 THEN sd / c ELSE 1.0 END)), 6) AS confidence,
          concat_ws('; ', CASE WHEN sd > c * 0.5 THEN 'High variability in processing times detected' END,
                    CASE WHEN top > c * 3 THEN 'Outliers detected - possible performance spikes' END) AS notes FROM x""",
)
def j05(spark, sf_dir):
    return rounded(a.processing_time_trend(a.in_time_windows(metric_events(spark, sf_dir))))


@query(
    "j06_success_rate_trend",
    _halves_sql("success::INT", "true")
    + f"""SELECT time_period, 'success_rate' AS metric_name, {_dir_sql(2, 'improving', 'declining')}, {_TAIL},
          0.8::DOUBLE AS confidence,
          CASE WHEN c < 0.9 THEN 'Success rate below 90% - investigation recommended' ELSE '' END AS notes FROM x""",
)
def j06(spark, sf_dir):
    return rounded(a.success_rate_trend(a.in_time_windows(metric_events(spark, sf_dir))))


@query(
    "j07_confidence_trend",
    _halves_sql("confidence", "confidence > 0")
    + f"""SELECT time_period, 'confidence_score' AS metric_name, {_dir_sql(3, 'improving', 'declining')}, {_TAIL},
          round(greatest(0.1, least(1.0, 1.0 - sd)), 6) AS confidence,
          CASE WHEN c < 0.7 THEN 'Average confidence below 70% - pattern quality may need improvement' ELSE '' END AS notes FROM x""",
)
def j07(spark, sf_dir):
    return rounded(a.confidence_trend(a.in_time_windows(metric_events(spark, sf_dir))))


@query(
    "j08_throughput_trend",
    f"""WITH {WINDOWED}, g AS (SELECT time_period, date_trunc('hour', ts) AS hour, count(*) AS k FROM tw GROUP BY 1, 2),
        o AS (SELECT time_period, k, row_number() OVER (PARTITION BY time_period ORDER BY hour) AS rn,
                     count(*) OVER (PARTITION BY time_period) AS n, sum(k) OVER (PARTITION BY time_period) AS e FROM g),
        h AS (SELECT time_period, avg(k) FILTER (rn <= n // 2) AS p, avg(k) FILTER (rn > n // 2) AS c FROM o
              WHERE n >= 2 AND e >= 10 GROUP BY 1),
        x AS (SELECT *, CASE WHEN p > 0 THEN (c - p) / p * 100 ELSE 0.0 END AS ch FROM h)
        SELECT time_period, 'throughput' AS metric_name, {_dir_sql(10, 'improving', 'declining')}, {_TAIL},
               0.7::DOUBLE AS confidence, '' AS notes FROM x""",
)
def j08(spark, sf_dir):
    return rounded(a.throughput_trend(a.in_time_windows(metric_events(spark, sf_dir))))


TIME_INSIGHTS = """
   ts_ AS (SELECT avg(processing_time_ms) AS a, coalesce(stddev_samp(processing_time_ms), 0) AS sd, max(processing_time_ms) AS top
           FROM r WHERE processing_time_ms > 0),
   i1 AS (SELECT 'processing_time' AS category, 'high_variance' AS insight_type, 'warning' AS impact_level,
            printf('High variance in processing times detected (std: %.1fms)', sd) AS description,
            'Investigate outliers and consider implementing caching for common patterns' AS recommendation,
            round(sd / a, 6) AS value FROM ts_ WHERE sd > a * 0.5
          UNION ALL SELECT 'processing_time', 'slow_outliers', 'warning',
            printf('Slow processing outliers detected (max: %.1fms vs avg: %.1fms)', top, a),
            'Profile slow operations and optimize pattern matching algorithms', round(top / a, 6) FROM ts_ WHERE top > a * 5
          UNION ALL SELECT 'processing_time', 'performance_degradation', CASE WHEN a > 500 THEN 'critical' ELSE 'warning' END,
            printf('Average processing time is high: %.1fms', a),
            'Optimize pattern matching algorithms and consider parallel processing', round(a, 6) FROM ts_ WHERE a > 100)"""
METHOD_INSIGHTS = """
   ms_ AS (SELECT method, count(*) AS u, avg(success::INT) AS sr, coalesce(avg(processing_time_ms) FILTER (processing_time_ms > 0), 0) AS tm
           FROM r GROUP BY 1),
   mr_ AS (SELECT *, row_number() OVER (ORDER BY sr DESC, tm, method DESC) AS best, row_number() OVER (ORDER BY sr, tm DESC, method) AS worst,
           count(*) OVER () AS n FROM ms_),
   i2 AS (SELECT 'method_performance' AS category, 'method_disparity' AS insight_type, 'warning' AS impact_level,
            'Significant performance gap between methods: ' || b.method || ' vs ' || w.method AS description,
            'Consider optimizing underperforming methods or adjusting method selection logic' AS recommendation,
            round(b.sr - w.sr, 6) AS value
          FROM mr_ b, mr_ w WHERE b.best = 1 AND w.worst = 1 AND b.n > 1 AND b.sr - w.sr > 0.1)"""
ERROR_INSIGHTS = """
   es_ AS (SELECT count(*) AS total, count(*) FILTER (NOT success) AS errs FROM r),
   et_ AS (SELECT error_type AS t, count(*) AS n FROM r WHERE NOT success AND error_type IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 DESC LIMIT 1),
   i3 AS (SELECT 'error_rate' AS category, 'high_error_rate' AS insight_type,
            CASE WHEN errs / total > 0.2 THEN 'critical' ELSE 'warning' END AS impact_level,
            printf('High error rate detected: %.1f%%', errs / total * 100) AS description,
            'Investigate common error causes and improve input validation' AS recommendation, round(errs / total, 6) AS value
          FROM es_ WHERE errs / total > 0.1
          UNION ALL SELECT 'error_patterns', 'dominant_error_type', 'warning',
            'Dominant error type: ' || t || ' (' || n || ' occurrences)',
            'Focus on resolving ' || t || ' errors as they represent the majority', round(n / errs, 6)
          FROM es_, et_ WHERE n > errs * 0.3)"""
LOAD_INSIGHTS = """
   lh_ AS (SELECT date_trunc('hour', ts) AS h, count(*) AS c FROM r GROUP BY 1),
   i4 AS (SELECT 'resource_utilization' AS category, 'uneven_load_distribution' AS insight_type, 'info' AS impact_level,
            printf('Uneven load distribution detected (std: %.1f, avg: %.1f)', sd, a) AS description,
            'Consider implementing load balancing or caching during peak hours' AS recommendation, round(sd / a, 6) AS value
          FROM (SELECT avg(c) AS a, stddev_samp(c) AS sd, count(*) AS n FROM lh_) WHERE n >= 2 AND sd > a * 0.5)"""
CONFIDENCE_INSIGHTS = """
   i5 AS (SELECT 'confidence' AS category, 'low_confidence_rate' AS insight_type, 'warning' AS impact_level,
            printf('High rate of low-confidence results: %.1f%%', low * 100) AS description,
            'Review and improve pattern quality, consider additional training data' AS recommendation, round(low, 6) AS value
          FROM (SELECT avg((confidence < 0.6)::INT) AS low FROM r WHERE confidence > 0) WHERE low > 0.2)"""


@query(
    "j09_processing_time_insights",
    f"WITH {DAY}, {TIME_INSIGHTS} SELECT * FROM i1",
)
def j09(spark, sf_dir):
    return rounded(a.processing_time_insights(day(spark, sf_dir)))


@query(
    "j09_processing_time_profile",
    f"""WITH {d.EVENTS} SELECT round(avg(v), 6) AS avg_time, round(stddev_samp(v), 6) AS std_dev, max(v) AS max_time,
          round(quantile_cont(v, 0.5), 6) AS median_time, round(quantile_cont(v, 0.95), 6) AS p95_time
        FROM (SELECT processing_time_ms AS v FROM ev WHERE processing_time_ms > 0)""",
)
def j09_profile(spark, sf_dir):
    return rounded(a.processing_time_profile(metric_events(spark, sf_dir)))


@query("j10_method_disparity", f"WITH {DAY}, {METHOD_INSIGHTS} SELECT * FROM i2")
def j10(spark, sf_dir):
    return rounded(a.method_insights(day(spark, sf_dir)))


@query(
    "j10_method_stats",
    f"WITH {WEEK}, {METHOD_INSIGHTS} SELECT method, u AS usage_count, round(sr, 6) AS success_rate, round(tm, 6) AS avg_time FROM ms_",
)
def j10_stats(spark, sf_dir):
    return rounded(a.method_stats(week(spark, sf_dir)))


@query("j11_error_insights", f"WITH {WEEK}, {ERROR_INSIGHTS} SELECT * FROM i3")
def j11(spark, sf_dir):
    return rounded(a.error_insights(week(spark, sf_dir)))


@query("j12_load_variance", f"WITH {WEEK}, {LOAD_INSIGHTS} SELECT * FROM i4")
def j12(spark, sf_dir):
    return rounded(a.load_insights(week(spark, sf_dir)))


@query("j13_low_confidence_rate", f"WITH {WEEK}, {CONFIDENCE_INSIGHTS} SELECT * FROM i5")
def j13(spark, sf_dir):
    return rounded(a.confidence_insights(week(spark, sf_dir)))


RANKING = """
   rk1 AS (SELECT pattern_id, avg(success::INT) AS success_rate, coalesce(avg(confidence) FILTER (confidence > 0), 0) AS avg_confidence,
                  coalesce(avg(processing_time_ms) FILTER (processing_time_ms > 0), 0) AS avg_time FROM r GROUP BY 1),
   rke AS (SELECT pattern_id, error_type AS err, row_number() OVER (PARTITION BY pattern_id ORDER BY count(*) DESC, error_type DESC) AS i
           FROM r WHERE NOT success AND error_type IS NOT NULL GROUP BY 1, 2),
   rk2 AS (SELECT rk1.*, err, success_rate * 0.4 + avg_confidence * 0.4 + greatest(0, 1 - avg_time / 1000) * 0.2 AS performance_score
           FROM rk1 LEFT JOIN (SELECT * FROM rke WHERE i = 1) e USING (pattern_id)),
   rk AS (SELECT pattern_id, row_number() OVER (ORDER BY performance_score DESC, pattern_id) AS usage_rank, success_rate, avg_confidence,
            avg_time, performance_score, greatest(0, 1 - performance_score) AS optimization_potential,
            concat_ws('; ', CASE WHEN success_rate < 0.8 THEN 'Low success rate' END, CASE WHEN avg_confidence < 0.7 THEN 'Low confidence scores' END,
              CASE WHEN avg_time > 200 THEN 'Slow processing' END, 'Common error: ' || err) AS bottlenecks,
            concat_ws('; ', CASE WHEN success_rate < 0.8 THEN 'Review pattern regex for edge cases and improve matching logic' END,
              CASE WHEN avg_confidence < 0.7 THEN 'Enhance pattern specificity and add validation rules' END,
              CASE WHEN avg_time > 200 THEN 'Optimize regex compilation and consider caching compiled patterns' END,
              'Focus on resolving ' || err || ' errors (most common)',
              CASE WHEN success_rate > 0.9 AND avg_confidence > 0.8
                   THEN 'Pattern performing well - consider using as template for new patterns' END) AS recommendations FROM rk2)"""


@query(
    "j14_pattern_ranking",
    f"""WITH {WEEK}, {RANKING} SELECT pattern_id, usage_rank, round(success_rate, 6) AS success_rate, round(avg_confidence, 6) AS avg_confidence,
        round(avg_time, 6) AS avg_time, round(performance_score, 6) AS performance_score,
        round(optimization_potential, 6) AS optimization_potential, bottlenecks, recommendations FROM rk""",
)
def j14(spark, sf_dir):
    return rounded(a.pattern_ranking(week(spark, sf_dir)))


RECOMMENDED = f"""{TIME_INSIGHTS}, {METHOD_INSIGHTS}, {ERROR_INSIGHTS}, {LOAD_INSIGHTS}, {CONFIDENCE_INSIGHTS}, {RANKING},
   ins AS (SELECT * FROM i1 UNION ALL SELECT * FROM i2 UNION ALL SELECT * FROM i3 UNION ALL SELECT * FROM i4 UNION ALL SELECT * FROM i5),
   recs AS (SELECT CASE impact_level WHEN 'critical' THEN 'high' WHEN 'warning' THEN 'medium' ELSE 'low' END AS priority,
              '[' || upper(impact_level) || '] ' || description || ': ' || recommendation AS message FROM ins
            UNION ALL SELECT CASE WHEN optimization_potential > 0.5 THEN 'high' ELSE 'medium' END,
              'Pattern ' || pattern_id || ': ' || recommendations FROM rk WHERE optimization_potential > 0.3)"""


@query("j15_prioritized_recommendations", f"WITH {WEEK}, {RECOMMENDED} SELECT * FROM recs")
def j15(spark, sf_dir):
    return a.prioritized_recommendations(week(spark, sf_dir))


@query("j16_comprehensive_report")
def j16(spark, sf_dir):
    return a.comprehensive_report(metric_events(spark, sf_dir))


@query(
    "j17_compare_patterns",
    f"""WITH {WEEK}, {RANKING}, c AS (SELECT * FROM rk WHERE pattern_id IN ('click', 'view', 'error'))
        SELECT count(*) AS patterns_compared, arg_max(pattern_id, performance_score) AS best_performing,
               arg_min(pattern_id, performance_score) AS worst_performing, round(avg(success_rate), 6) AS avg_success_rate,
               round(avg(avg_confidence), 6) AS avg_confidence FROM c""",
)
def j17(spark, sf_dir):
    return rounded(a.compare_patterns(week(spark, sf_dir), ["click", "view", "error"]))


@query(
    "j18_pattern_health",
    f"""WITH {WEEK}, {RANKING}, h AS (SELECT *, success_rate * 0.4 + avg_confidence * 0.3 + performance_score * 0.3 AS s FROM rk)
        SELECT pattern_id, round(s, 6) AS health_score,
               CASE WHEN s >= 0.8 THEN 'Excellent' WHEN s >= 0.6 THEN 'Good' WHEN s >= 0.4 THEN 'Fair' ELSE 'Poor' END AS health_status,
               recommendations FROM h""",
)
def j18(spark, sf_dir):
    return rounded(a.pattern_health(week(spark, sf_dir)))


@query(
    "j19_report_tables",
    f"""WITH {DAY}, {RANKING} SELECT pattern_id, usage_rank, round(performance_score, 6) AS performance_score FROM rk""",
)
def j19(spark, sf_dir):
    tables = a.report_tables(metric_events(spark, sf_dir), level="summary")
    return rounded(tables["patterns"].select("pattern_id", "usage_rank", "performance_score"))


@query(
    "j20_threshold_suggestions",
    f"""WITH {d.EVENTS}, r AS (SELECT * REPLACE (pattern_id || '_' || CAST(user_id AS VARCHAR) AS pattern_id) FROM ev), {RANKING},
        th AS (SELECT pattern_id, max(threshold_used) AS t FROM r WHERE user_id % 2 = 0 GROUP BY 1),
        x AS (SELECT rk.pattern_id, coalesce(t, 0.7) AS t, performance_score AS ps, success_rate AS sr FROM rk LEFT JOIN th USING (pattern_id))
        SELECT pattern_id, round(t, 6) AS current_threshold,
               round(CASE WHEN sr > 0.9 AND ps < 0.8 THEN greatest(0.5, t - 0.05) ELSE least(0.95, t + 0.03) END, 6) AS suggested_threshold,
               CASE WHEN sr > 0.9 AND ps < 0.8 THEN 2.0 ELSE 1.5 END::DOUBLE AS expected_improvement
        FROM x WHERE (ps < 0.8 AND sr > 0.9) OR (ps > 0.9 AND sr < 0.85)""",
)
def j20(spark, sf_dir):
    ev = metric_events(spark, sf_dir)
    ev = ev.withColumn("pattern_id", F.concat_ws("_", "pattern_id", F.col("user_id").cast("string")))
    known = ev.filter(F.col("user_id") % 2 == 0).groupBy("pattern_id").agg(F.max("threshold_used").alias("threshold"))
    return rounded(a.threshold_suggestions(a.pattern_ranking(ev), known))


@query(
    "j21_metric_series",
    f"""WITH {d.EVENTS}, o AS (SELECT pattern_id AS name, processing_time_ms AS v,
                row_number() OVER (PARTITION BY pattern_id ORDER BY ts DESC, event_id DESC) AS rn FROM ev)
        SELECT name, count(*) AS points_kept, max(v) FILTER (rn = 1) AS latest_value,
               round(sum(v), 4) AS counter_total FROM o GROUP BY 1""",
)
def j21(spark, sf_dir):
    ev = metric_events(spark, sf_dir)
    m = ev.select(F.col("pattern_id").alias("name"), F.col("processing_time_ms").alias("value"), "ts", "event_id")
    return a.metric_series(m).withColumn("counter_total", F.round("counter_total", 4))
