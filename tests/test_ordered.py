"""Order statistics against plain Python on skewed small frames."""

import statistics

import numpy as np
from pyspark.sql import functions as F

from semtflow.functions.ordered import halves, last_n, numbered, percentiles
from semtflow.operators import thresholds as th


def frame(spark):
    rows = [(f"p{0 if i % 3 else i % 5}", i, 1_700_000_000 + (i * 7919) % 5000, float((i * 37) % 101), i % 4 != 0) for i in range(3000)]
    rows += [("tie", 10_000 + i, 1_700_000_000, 1.0, True) for i in range(101)]
    df = spark.createDataFrame(rows, "pattern_id string, event_id long, s long, v double, success boolean")
    return rows, df.withColumn("ts", F.timestamp_seconds("s"))


def by_key(rows):
    out = {}
    for r in rows:
        out.setdefault(r[0], []).append(r)
    return {k: sorted(v, key=lambda r: (r[2], r[1])) for k, v in out.items()}


def test_halves(spark):
    rows, df = frame(spark)
    got = {(r.pattern_id, r.half): r.c for r in halves(df, ["pattern_id"], "ts", "event_id").groupBy("pattern_id", "half").agg(F.sum("event_id").alias("c")).collect()}
    for k, v in by_key(rows).items():
        mid = len(v) // 2
        assert got[(k, 1)] == sum(r[1] for r in v[:mid]) and got[(k, 2)] == sum(r[1] for r in v[mid:])


def test_last_n_and_number(spark):
    rows, df = frame(spark)
    got = {r.pattern_id: sorted(r.ids) for r in last_n(df, ["pattern_id"], ["ts", "event_id"], 40).groupBy("pattern_id").agg(F.collect_list("event_id").alias("ids")).collect()}
    for k, v in by_key(rows).items():
        assert got[k] == sorted(r[1] for r in v[-40:])
    order = [r.event_id for r in numbered(df.select("ts", "event_id"), ["ts", "event_id"]).orderBy("rn").collect()]
    assert order == [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]


def test_percentiles(spark):
    rows, df = frame(spark)
    got = {r.pattern_id: (r.m, r.p) for r in percentiles(df, ["pattern_id"], "v", {"m": 0.5, "p": 0.95}).collect()}
    for k, v in by_key(rows).items():
        vals = [r[3] for r in v]
        assert abs(got[k][0] - statistics.median(vals)) < 1e-9 and abs(got[k][1] - np.percentile(vals, 95)) < 1e-9


def test_ema_and_history_equal_the_loop(spark):
    rows, df = frame(spark)
    df = df.withColumns({"confidence": F.col("v") / 101, "processing_time_ms": F.col("v"), "threshold_used": F.lit(0.5)})
    got = {r.pattern_id: r.ema_success for r in th.ema_threshold(df).collect()}
    pts = {(r.pattern_id, r.volume): (r.success_rate, r.confidence_avg) for r in th.history_points(df).collect()}
    for k, v in by_key(rows).items():
        ema, conf, ok = None, 0.0, 0
        for i, r in enumerate(v, 1):
            ema = float(r[4]) if ema is None else 0.1 * r[4] + 0.9 * ema
            conf, ok = 0.9 * conf + 0.1 * r[3] / 101, ok + r[4]
            if i % 10 == 0:
                assert abs(pts[(k, i)][0] - ok / i) < 1e-9 and abs(pts[(k, i)][1] - conf) < 1e-9
        assert abs(got[k] - ema) < 1e-9
    assert len(pts) == sum(len(v) // 10 for v in by_key(rows).values())


def test_running_mean_over_a_hot_key(spark):
    """5,000 rows of one pattern and a slow mean: every row counts."""
    from semtflow.operators import thresholds as th

    rows = [("hot", i, (i * 37 % 101) / 100) for i in range(5000)] + [("cold", i, 0.5) for i in range(3)]
    ev = spark.createDataFrame(rows, "pattern_id string, event_id long, confidence double")
    ev = ev.selectExpr("*", "timestamp_seconds(event_id) AS ts", "confidence > 0.4 AS success", "0.4D AS threshold_used").repartition(7)
    means, m, seeded = {}, 0.0, None
    for k, (_, _, c) in enumerate(rows[:5000], 1):
        m = m * 0.99 + c * 0.01
        seeded = c if seeded is None else seeded * 0.99 + c * 0.01
        means[k] = m
    got = {r.pattern_id: r.c for r in th.ema_last(ev, {"c": F.col("confidence")}, 0.01).collect()}
    assert abs(got["hot"] - m) < 1e-12
    assert abs({r.pattern_id: r.c for r in th.ema_last(ev, {"c": F.col("confidence")}, 0.01, seeded=True).collect()}["hot"] - seeded) < 1e-12
    points = th.history_points(ev, alpha=0.01).filter("pattern_id = 'hot'").collect()
    assert len(points) == 500 and all(abs(p.confidence_avg - means[p.volume]) < 1e-9 for p in points)
