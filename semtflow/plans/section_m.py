"""Queries of the evaluation section (M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.operators import analytics as a
from semtflow.operators import evaluation as ev
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import PATTERN_METRICS_SQL, RECOMMENDED, rounded
from semtflow.sources.derived import addresses, metric_events

PRED = "stack(4, 'city', city_in, 'district', district_in, 'neighborhood', CASE WHEN addr_id % 6 = 0 THEN substr(nbh, 1, 2) WHEN addr_id % 10 = 0 THEN NULL ELSE upper(nbh) || ' mah' END, 'number', CASE WHEN addr_id % 5 > 0 THEN number END) AS (component, value)"
GOLD = "stack(4, 'city', city, 'district', district, 'neighborhood', nbh, 'number', CASE WHEN addr_id % 7 > 0 THEN number END) AS (component, value)"


def pred(spark, sf_dir):
    return addresses(spark, sf_dir).selectExpr("addr_id", PRED)


def gold(spark, sf_dir):
    return addresses(spark, sf_dir).selectExpr("addr_id", GOLD)


def scores(spark, sf_dir):
    return addresses(spark, sf_dir).select(
        "addr_id", (F.col("addr_id") * 37 % 100 / F.lit(100.0)).alias("confidence"),
        F.concat(F.lit("c"), (F.col("addr_id") % 4).cast("string")).alias("category"))


LOW = "lower(replace({}, 'İ', 'i̇'))"
_M = f"(coalesce({LOW.format('trim(p)')} = {LOW.format('trim(g)')} OR (length({LOW.format('p')}) > 3 AND length({LOW.format('g')}) > 3 AND (contains({LOW.format('p')}, {LOW.format('g')}) OR contains({LOW.format('g')}, {LOW.format('p')}))), false))"
PAIRED = f"""{d.ADDR},
  pr AS (SELECT addr_id, 'city' AS component, city_in AS p FROM addr UNION ALL SELECT addr_id, 'district', district_in FROM addr
    UNION ALL SELECT addr_id, 'neighborhood', CASE WHEN addr_id % 6 = 0 THEN substr(nbh, 1, 2) WHEN addr_id % 10 = 0 THEN NULL ELSE upper(nbh) || ' mah' END FROM addr
    UNION ALL SELECT addr_id, 'number', CASE WHEN addr_id % 5 > 0 THEN number END FROM addr),
  go AS (SELECT addr_id, 'city' AS component, city AS g FROM addr UNION ALL SELECT addr_id, 'district', district FROM addr UNION ALL SELECT addr_id, 'neighborhood', nbh FROM addr
    UNION ALL SELECT addr_id, 'number', CASE WHEN addr_id % 7 > 0 THEN number END FROM addr),
  pd AS (SELECT *, {_M} AS hit FROM (SELECT * FROM pr WHERE p IS NOT NULL) a FULL JOIN (SELECT * FROM go WHERE g IS NOT NULL) b USING (addr_id, component)),
  ca AS (SELECT component, count(*) FILTER (hit) AS tp, count(*) FILTER (p IS NOT NULL AND NOT hit) AS fp, count(*) FILTER (g IS NOT NULL AND NOT hit) AS fn FROM pd GROUP BY 1),
  cf AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS pp, coalesce(tp / nullif(tp + fn, 0), 0) AS rr FROM ca),
  cb AS (SELECT component, tp, fp, fn, pp AS precision, rr AS recall, coalesce(2 * pp * rr / nullif(pp + rr, 0), 0) AS f1 FROM cf),
  sc AS (SELECT addr_id, (addr_id * 37 % 100) / 100.0::DOUBLE AS confidence, 'c' || CAST(addr_id % 4 AS VARCHAR) AS category FROM addr),
  rc AS (SELECT sc.*, coalesce(m >= 0.7, true) AS correct, m FROM sc LEFT JOIN (SELECT addr_id, avg(hit::INT) AS m FROM pd WHERE g IS NOT NULL GROUP BY 1) USING (addr_id))"""


@query("m01_component_accuracy", f"WITH {PAIRED} SELECT component, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cb")
def m01(spark, sf_dir):
    return rounded(ev.component_accuracy(pred(spark, sf_dir), gold(spark, sf_dir)))


@query("m02_value_match", f"WITH {d.ADDR} SELECT addr_id, {_M} AS matched FROM (SELECT addr_id, city_in AS p, city AS g FROM addr)")
def m02(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", ev.value_match(F.col("city_in"), F.col("city")).alias("matched"))


def correct(spark, sf_dir):
    return ev.row_correct(pred(spark, sf_dir), gold(spark, sf_dir), scores(spark, sf_dir))


@query("m03_row_correct", f"WITH {PAIRED} SELECT addr_id, confidence, category, round(m, 6) AS matched, correct FROM rc")
def m03(spark, sf_dir):
    return rounded(correct(spark, sf_dir))


@query(
    "m04_calibration",
    f"""WITH {PAIRED} SELECT CASE WHEN confidence >= 0.9 THEN '0.9-1.0' WHEN confidence >= 0.7 THEN '0.7-0.9' WHEN confidence >= 0.5 THEN '0.5-0.7' WHEN confidence >= 0.3 THEN '0.3-0.5'
        WHEN confidence >= 0.1 THEN '0.1-0.3' ELSE '0.0-0.1' END AS bucket, count(*) AS n, round(avg(correct::INT), 6) AS accuracy FROM rc GROUP BY 1""",
)
def m04(spark, sf_dir):
    return rounded(ev.calibration(correct(spark, sf_dir)))


@query(
    "m04_label_calibration",
    """SELECT CASE WHEN c >= 0.9 THEN '0.9-1.0' WHEN c >= 0.7 THEN '0.7-0.9' WHEN c >= 0.5 THEN '0.5-0.7' WHEN c >= 0.3 THEN '0.3-0.5' WHEN c >= 0.1 THEN '0.1-0.3' ELSE '0.0-0.1' END AS bucket,
       count(*) AS n, round(avg(quality), 6) AS accuracy FROM (SELECT quality, (doc_id % 100) / 100.0 AS c FROM labels) GROUP BY 1""",
)
def m04_labels(spark, sf_dir):
    lab = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return rounded(ev.calibration(lab.select((F.col("doc_id") % 100 / F.lit(100.0)).alias("confidence"), F.col("quality").alias("correct"))))


@query(
    "m05_error_breakdown",
    f"""WITH {PAIRED} SELECT component, CASE WHEN p IS NULL THEN 'missing' WHEN length(p) < length(g) / 2 THEN 'too_short' ELSE 'wrong_value' END AS kind, count(*) AS n,
        count(*) FILTER (confidence > 0.8) AS high_confidence, round(avg(confidence), 6) AS mean_confidence FROM pd JOIN sc USING (addr_id) WHERE g IS NOT NULL AND NOT hit GROUP BY 1, 2""",
)
def m05(spark, sf_dir):
    return rounded(ev.error_breakdown(pred(spark, sf_dir), gold(spark, sf_dir), scores(spark, sf_dir)))


@query(
    "m06_accuracy_by_category",
    f"""WITH {PAIRED} SELECT coalesce(category, 'all') AS category, count(*) AS n, round(avg(correct::INT), 6) AS accuracy, round(avg(confidence), 6) AS mean_confidence FROM rc GROUP BY ROLLUP (category)""",
)
def m06(spark, sf_dir):
    return rounded(ev.accuracy_by_category(correct(spark, sf_dir)))


@query(
    "m06_accuracy_summary",
    f"""WITH {PAIRED} SELECT round(avg(f1), 6) AS mean_f1, round(avg(precision), 6) AS mean_precision, round(avg(recall), 6) AS mean_recall,
        (SELECT component FROM cb ORDER BY f1 DESC, component DESC LIMIT 1) AS best_component, (SELECT component FROM cb ORDER BY f1, component LIMIT 1) AS worst_component FROM cb""",
)
def m06_summary(spark, sf_dir):
    return rounded(ev.accuracy_summary(ev.component_accuracy(pred(spark, sf_dir), gold(spark, sf_dir))))


@query(
    "m07_golden_compare",
    f"""WITH {PAIRED}, cs AS (SELECT addr_id, category, CASE WHEN addr_id % 50 = 0 THEN 'boom' END AS error FROM sc),
        h AS (SELECT addr_id, avg(hit::INT) FILTER (component IN ('city', 'district')) AS c, avg(hit::INT) FILTER (component NOT IN ('city', 'district')) AS o FROM pd WHERE g IS NOT NULL GROUP BY 1)
        SELECT category, CASE WHEN error IS NOT NULL THEN 'error' WHEN coalesce(c, 1) >= 0.8 AND coalesce(o, 1) >= 0.6 THEN 'pass' ELSE 'fail' END AS status, count(*) AS n
        FROM cs LEFT JOIN h USING (addr_id) GROUP BY 1, 2""",
)
def m07(spark, sf_dir):
    cases = scores(spark, sf_dir).select("addr_id", "category", F.lit("ml").alias("method"), F.when(F.col("addr_id") % 50 == 0, "boom").alias("error"))
    return ev.golden_summary(ev.golden_compare(pred(spark, sf_dir), gold(spark, sf_dir), cases, ["city", "district"]))


CONFIGS = [("base", 0.8, 0.6, 0.7), ("very_low", 0.5, 0.3, 0.7), ("low", 0.7, 0.5, 0.7), ("high", 0.9, 0.7, 0.7), ("very_high", 0.95, 0.85, 0.7),
           ("ml_05", 0.8, 0.6, 0.5), ("ml_06", 0.8, 0.6, 0.6), ("ml_08", 0.8, 0.6, 0.8), ("ml_09", 0.8, 0.6, 0.9)]
_CFG = "cfg(config, hi, md, mt) AS (VALUES " + ", ".join(f"('{n}', {h}, {m}, {t})" for n, h, m, t in CONFIGS) + ")"


@query(
    "m08_config_regression",
    f"""WITH {d.EVENTS}, {_CFG}, s AS (SELECT event_id AS addr_id, confidence AS p, (event_id * 31 % 100) / 100.0 AS m, CAST(user_id AS VARCHAR) AS output FROM ev),
        r1 AS (SELECT config, addr_id, p, m, output, CASE WHEN p >= hi THEN 'pattern_high' WHEN p >= md AND m >= mt THEN 'ml_validation' WHEN p >= md THEN 'pattern_medium' WHEN m >= mt THEN 'ml_primary' ELSE 'fallback' END AS method FROM s, cfg),
        r AS (SELECT config, addr_id, method, split_part(method, '_', 1) || '/' || output AS output, CASE WHEN method LIKE 'pattern%' THEN p WHEN method LIKE 'ml%' THEN m ELSE 0.3 END AS confidence FROM r1),
        b AS (SELECT * FROM r WHERE config = 'base')
        SELECT r.config, count(*) AS n, 0::BIGINT AS success_changes, count(*) FILTER (r.method <> b.method) AS method_changes, count(*) FILTER (r.output <> b.output) AS output_changes,
               count(*) FILTER (abs(r.confidence - b.confidence) > 0.1) AS confidence_changes FROM r JOIN b USING (addr_id) WHERE r.config <> 'base' GROUP BY 1""",
)
def m08(spark, sf_dir):
    s = metric_events(spark, sf_dir).select(
        F.col("event_id").alias("addr_id"), F.col("confidence").alias("pattern"), (F.col("event_id") * 31 % 100 / F.lit(100.0)).alias("ml"), F.col("user_id").cast("string").alias("output"))
    return ev.config_regression(ev.threshold_runs(s, CONFIGS), "base")


@query(
    "m09_slowdown_check",
    f"""WITH {d.EVENTS}, b AS (SELECT event_id AS addr_id, processing_time_ms AS ms FROM ev), r AS (SELECT addr_id, ms * (1 + addr_id % 4) AS m2 FROM b)
        SELECT addr_id, ms AS base_ms, round(m2, 6) AS ms, round(m2 / ms, 6) AS factor FROM b JOIN r USING (addr_id) WHERE m2 > ms * 2""",
)
def m09(spark, sf_dir):
    base = metric_events(spark, sf_dir).select(F.col("event_id").alias("addr_id"), F.col("processing_time_ms").alias("ms"))
    return rounded(ev.slowdown_check(base, base.withColumn("ms", F.col("ms") * (1 + F.col("addr_id") % 4))))


_BD = "SELECT pattern_id AS name, count(*) / 10.0::DOUBLE AS throughput, avg(processing_time_ms) AS memory, avg(success::INT) AS success_rate FROM ev WHERE {} GROUP BY 1"


@query(
    "m10_benchmark_delta",
    f"""WITH {d.EVENTS}, b AS ({_BD.format("user_id % 2 = 0")}), c AS ({_BD.format("user_id % 2 = 1")}), x AS (SELECT name, (c.throughput - b.throughput) / b.throughput AS t,
          (c.memory - b.memory) / b.memory AS m, c.success_rate - b.success_rate AS s FROM c JOIN b USING (name))
        SELECT name, round(t, 6) AS throughput_change, round(m, 6) AS memory_change, round(s, 6) AS success_change,
          concat_ws(',', CASE WHEN t < -0.1 THEN 'throughput' END, CASE WHEN m > 0.2 THEN 'memory' END, CASE WHEN s < -0.05 THEN 'success' END) AS regressions FROM x""",
)
def m10(spark, sf_dir):
    e = metric_events(spark, sf_dir)
    one = lambda k: e.filter(F.col("user_id") % 2 == k).groupBy(F.col("pattern_id").alias("name")).agg(
        (F.count(F.lit(1)) / 10.0).alias("throughput"), F.avg("processing_time_ms").alias("memory"), F.avg(F.col("success").cast("int")).alias("success_rate"))
    return rounded(ev.benchmark_delta(one(0), one(1)))


@query(
    "m12_sample_stats",
    f"""WITH {d.ADDR}, s AS (SELECT 'c' || CAST(addr_id % 4 AS VARCHAR) AS category, CASE WHEN addr_id % 3 = 0 THEN 'hard' ELSE 'easy' END AS difficulty, addr_id % 11 <> 0 AS ok FROM addr)
        SELECT 'category' AS kind, category AS name, count(*) AS n, round(avg(ok::INT), 6) AS expected_success_rate FROM s GROUP BY 2
        UNION ALL SELECT 'difficulty', difficulty, count(*), round(avg(ok::INT), 6) FROM s GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), round(avg(ok::INT), 6) FROM s""",
)
def m12(spark, sf_dir):
    k = F.col("addr_id")
    s = addresses(spark, sf_dir).select(F.concat(F.lit("c"), (k % 4).cast("string")).alias("category"), F.when(k % 3 == 0, "hard").otherwise("easy").alias("difficulty"), (k % 11 != 0).alias("expected_success"))
    return rounded(ev.sample_stats(s))


@query(
    "m13_top_patterns",
    f"WITH {d.EVENTS}, {PATTERN_METRICS_SQL} SELECT pattern_id, usage_count, success_rate, avg_confidence FROM pm ORDER BY usage_count DESC, pattern_id LIMIT 5",
)
def m13(spark, sf_dir):
    return rounded(a.top_patterns(metric_events(spark, sf_dir)).select("pattern_id", "usage_count", "success_rate", "avg_confidence"))


@query(
    "m13_current_alerts",
    f"""WITH {d.EVENTS}, r AS (SELECT * FROM ev WHERE ts >= (SELECT max(ts) FROM ev) - INTERVAL 1 HOUR), {RECOMMENDED},
        al AS (SELECT 1 AS part, upper(impact_level) || ': ' || description AS alert FROM ins WHERE impact_level IN ('critical', 'warning')
               UNION ALL SELECT 2, 'RECOMMENDATION: ' || message FROM recs WHERE priority = 'high')
        SELECT part, alert FROM al ORDER BY part, alert LIMIT 5""",
)
def m13_alerts(spark, sf_dir):
    return a.current_alerts(metric_events(spark, sf_dir))
