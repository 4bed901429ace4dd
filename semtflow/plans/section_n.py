"""Queries of the streaming section (N): streams over the given tables, run to the end."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_e import dims
from semtflow.plans.section_j import rounded
from semtflow.plans.section_k import EMA, KEV, OPTIMIZED, STATS
from semtflow.sources.derived import EVENT_COLUMNS, address_columns
from semtflow.streaming import streams as st


BATCHES = 3


def stream_table(spark, sf_dir, table: str, order: str):
    """A given table as a file stream of several batches, dealt in the order of a column."""
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    key = F.unix_micros(F.col(order).cast("timestamp")) if dict(df.dtypes)[order] not in ("bigint", "int") else F.col(order)
    cuts = df.select(key.cast("double").alias("k")).approxQuantile("k", [i / BATCHES for i in range(1, BATCHES)], 0.01)
    part = sum((F.when(key > c, 1).otherwise(0) for c in cuts), F.lit(0))
    path = st.scratch(spark, f"feed-{table}")
    for i in range(BATCHES):  # one after the other, as files are taken by age
        df.filter(part == i).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def event_stream(spark, sf_dir):
    raw = stream_table(spark, sf_dir, "events", "ts").selectExpr("*", "CAST(get_json_object(props, '$.k') AS INT) AS k")
    return raw.selectExpr(*EVENT_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))


def keyed_stream(spark, sf_dir):
    ev = event_stream(spark, sf_dir)
    kind = F.when(F.col("pattern_id").isin("click", "view"), "regex").otherwise("template")
    return ev.withColumn("pattern_type", kind).withColumn("pattern_id", F.concat_ws("_", "pattern_id", (F.col("user_id") % 10).cast("string")))


CLOSED = "wm AS (SELECT max(ts) - INTERVAL 5 MINUTE AS wm FROM ev)"


@query("n01_normalize_stream")
def n01(spark, sf_dir):
    rows = stream_table(spark, sf_dir, "customer", "c_custkey").selectExpr(*address_columns("c_custkey")).select("addr_id", "address")
    out = scratch = st.scratch(spark, "n01")
    st.drain_batches(st.normalize_stream(rows, dims(spark)), st.summary_batches(f"{scratch}/summary"), "n01")
    return rounded(st.summary(st.newest_state(spark, f"{out}/summary")))


@query(
    "n02_metrics_stream",
    f"""WITH {d.EVENTS}, {CLOSED} SELECT strftime(time_bucket(INTERVAL 60 SECOND, ts), '%Y-%m-%d %H:%M:%S') AS start, method, count(*) AS n, round(avg(success::INT), 6) AS success_rate,
        round(avg(processing_time_ms), 6) AS avg_ms, round(avg(confidence), 6) AS avg_confidence FROM ev, wm
        WHERE time_bucket(INTERVAL 60 SECOND, ts) + INTERVAL 60 SECOND <= wm GROUP BY 1, 2""",
)
def n02(spark, sf_dir):
    out = st.drain(st.metrics_stream(event_stream(spark, sf_dir)), "n02").drop("p95_ms")
    return rounded(out).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query("n03_ema_threshold_stream", f"WITH {KEV}, {EMA} SELECT pattern_id, round(e, 6) AS ema, seen, round(t, 6)::DOUBLE AS threshold FROM th")
def n03(spark, sf_dir):
    state = st.scratch(spark, "n03-state")
    st.drain_batches(keyed_stream(spark, sf_dir), st.ema_threshold_batches(state), "n03")
    return rounded(st.newest_state(spark, state).drop("last_updated"))


N04 = f"""{d.EVENTS}, kev AS (SELECT * REPLACE (pattern_id || '_' || CAST(user_id % 10 AS VARCHAR) AS pattern_id, success AND pattern_id <> 'click' AS success,
     CASE WHEN pattern_id = 'view' THEN confidence * 0.2 ELSE confidence END AS confidence) FROM ev)"""


@query("n04_alert_stream", f"WITH {N04} SELECT DISTINCT CASE WHEN pattern_id LIKE 'click%' THEN 'low_success_rate' ELSE 'low_confidence' END AS type, pattern_id, CASE WHEN pattern_id LIKE 'click%' THEN 'high' ELSE 'medium' END AS severity, CASE WHEN pattern_id LIKE 'click%' THEN 0.5 ELSE 0.3 END::DOUBLE AS threshold, true AS active FROM kev WHERE pattern_id LIKE 'click%' OR pattern_id LIKE 'view%'")
def n04(spark, sf_dir):
    """Clicks never succeed and views are unsure, so each of their patterns alerts once, over all batches."""
    base = st.scratch(spark, "n04-state")
    ev = keyed_stream(spark, sf_dir)
    ev = ev.withColumn("success", F.col("success") & ~F.col("pattern_id").startswith("click"))
    ev = ev.withColumn("confidence", F.when(F.col("pattern_id").startswith("view"), F.col("confidence") * 0.2).otherwise(F.col("confidence")))
    st.drain_batches(ev, st.alert_batches(f"{base}/totals", f"{base}/alerts"), "n04")
    return st.newest_state(spark, f"{base}/alerts").drop("value")


def _grain_sql(unit: str) -> str:
    return f"""SELECT '{unit}' AS grain, strftime(date_trunc('{unit}', ts)::TIMESTAMP, '%Y-%m-%d %H:%M:%S') AS start, pattern_id, count(*) AS total, count(*) FILTER (success) AS successful,
        round(avg(success::INT), 6) AS success_rate FROM ev, wm WHERE date_trunc('{unit}', ts)::TIMESTAMP + INTERVAL 1 {unit} <= wm GROUP BY 2, 3"""


@query("n05_hourly_daily_stream", f"WITH {d.EVENTS}, {CLOSED} {_grain_sql('hour')} UNION ALL {_grain_sql('day')}")
def n05(spark, sf_dir):
    one = lambda unit: st.drain(st.grain_stream(event_stream(spark, sf_dir), f"1 {unit}"), "n05").withColumn("grain", F.lit(unit))
    return rounded(one("hour").unionByName(one("day"))).withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "n06_recent_trend_stream",
    f"""WITH {d.EVENTS}, {CLOSED}, e AS (SELECT *, unnest(range(1, 13)) AS i, time_bucket(INTERVAL 5 MINUTE, ts) AS b FROM ev), w AS (SELECT *, b + to_minutes(i * 5) AS fin FROM e)
        SELECT strftime(fin, '%Y-%m-%d %H:%M:%S') AS "end", pattern_id, count(*) AS n, round(avg(success::INT), 6) AS success_rate, round(avg(confidence), 6) AS avg_confidence,
               round(avg(processing_time_ms), 6) AS avg_ms FROM w, wm WHERE fin <= wm GROUP BY 1, 2""",
)
def n06(spark, sf_dir):
    out = st.drain(st.recent_trend_stream(event_stream(spark, sf_dir)), "n06")
    return rounded(out).withColumn("end", F.date_format("end", "yyyy-MM-dd HH:mm:ss"))


@query(
    "n07_late_events",
    f"""WITH {d.EVENTS}, {CLOSED} SELECT date_trunc('day', ts)::TIMESTAMP::VARCHAR AS day, count(*) AS n FROM ev, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1""",
)
def n07(spark, sf_dir):
    """What the watermark lets through, by day of the closed hours."""
    out = st.drain(st.grain_stream(event_stream(spark, sf_dir), "1 hour"), "n07")
    return out.groupBy(F.date_format(F.date_trunc("day", "start"), "yyyy-MM-dd HH:mm:ss").alias("day")).agg(F.sum("total").alias("n"))


@query(
    "n08_layer_usage_stream",
    f"""WITH {d.EVENTS}, {CLOSED} SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, method AS layer, count(*) AS n, count(*) FILTER (NOT success) AS failures
        FROM ev, wm WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= wm GROUP BY 1, 2""",
)
def n08(spark, sf_dir):
    hist = event_stream(spark, sf_dir).select("ts", F.col("method").alias("layer"), "success")
    return st.drain(st.layer_usage_stream(hist), "n08").withColumn("start", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


@query(
    "n09_optimize_on_schedule",
    f"""WITH {STATS}, {OPTIMIZED} SELECT pattern_id, round(old_threshold, 6) AS old_threshold, round(new_threshold, 6) AS new_threshold,
        round(expected_improvement, 6) AS expected_improvement, round(performance_before, 6) AS performance_before, 'balanced' AS strategy_used FROM op WHERE optimization_applied""",
)
def n09(spark, sf_dir):
    audit = st.scratch(spark, "n09-audit")
    st.drain_batches(keyed_stream(spark, sf_dir), st.optimize_batches(f"{audit}-log", audit), "n09")
    return rounded(st.newest_state(spark, audit).drop("timestamp"))
