"""k12 equals its SQL where a pattern has more uses than the powers of one running sum can hold."""

import math

import duckdb

import __spark_entry__ as entry


def test_sql_holds_for_patterns_of_many_uses(spark, tmp_path):
    ev = spark.range(9000).selectExpr(
        "id AS event_id", "timestamp_seconds(1700000000 + id * 37 % 9001) AS ts", "id * 0 + 10 AS user_id", "'click' AS event_type", "id / 10.0D AS value",
        "concat('{\"k\": ', cast(id * 7919 % 100 AS string), '}') AS props")
    ev.write.parquet(f"{tmp_path}/events.parquet")
    got = {(r.pattern_id, r.volume): r for r in entry.queries()["k12_history_points"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(entry.oracle_sql()["k12_history_points"]).fetchall()
    assert len(want) == len(got) == 900
    mean, by_volume = 0.0, {}
    for v, (_, k) in enumerate(sorted((i * 37 % 9001, i) for i in range(9000)), 1):
        mean = 0.9 * mean + 0.1 * (k * 7919 % 100 / 100)
        by_volume[v] = mean
    for pattern, ts, volume, rate, threshold, confidence in want:
        r = got[pattern, volume]
        assert math.isclose(confidence, by_volume[volume], abs_tol=2e-6) and math.isclose(r.confidence_avg, confidence, abs_tol=2e-6)
        assert (r.ts, r.threshold) == (ts, threshold) and math.isclose(r.success_rate, rate, abs_tol=2e-6)
