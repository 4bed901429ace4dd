"""Streams end in the same rows as the batch jobs."""

from pyspark.sql import functions as F

from semtflow.operators import cascade
from semtflow.operators import thresholds as th
from semtflow.plans import section_k, section_n
from semtflow.streaming import streams as st


def test_thresholds_merge_over_batches(spark, sf, tmp_path):
    ev = section_k.events(spark, sf)
    cut = ev.agg(F.expr("percentile_approx(event_id, 0.4)")).first()[0]
    step = st.ema_threshold_batches(str(tmp_path / "state"))
    step(ev.filter(F.col("event_id") <= cut), 0)
    step(ev.filter(F.col("event_id") > cut), 1)
    step(ev.filter(F.col("event_id") > cut), 1)  # a retried batch changes nothing
    got = {r.pattern_id: (r.seen, r.ema) for r in st.newest_state(spark, str(tmp_path / "state")).collect()}
    for r in th.ema_threshold(ev).collect():
        assert got[r.pattern_id][0] == r.seen and abs(got[r.pattern_id][1] - r.ema_success) < 1e-9


def test_one_active_alert(spark, sf, tmp_path):
    ev = section_k.events(spark, sf).withColumns({"success": F.lit(False), "pattern_id": F.lit("p")})
    step = st.alert_batches(str(tmp_path / "t"), str(tmp_path / "a"))
    step(ev, 0)
    step(ev, 1)
    kinds = [r.type for r in st.newest_state(spark, str(tmp_path / "a")).collect()]
    assert kinds.count("low_success_rate") == 1


def test_long_text_as_in_batch(spark):
    df = spark.createDataFrame([(1, "moda mahalle " + "x" * 1001), (2, "moda mahalle")], "addr_id long, address string")
    rows = lambda x: sorted(str(r) for r in x.collect())
    assert rows(st.normalize_stream(df)) == rows(cascade.normalize_addresses(df))


def test_summary_over_batches(spark, tmp_path):
    step = st.summary_batches(str(tmp_path / "s"))
    one = spark.createDataFrame([("ml", True, 0.5), ("ml", False, 0.1), ("pattern", True, 0.9)], "method string, success boolean, confidence double")
    for epoch in (0, 1, 1, 2, 3):
        step(one, epoch)
    got = {r.method: (r.total, r.successful, r.average_confidence) for r in st.summary(st.newest_state(spark, str(tmp_path / "s"))).collect()}
    assert got["ml"] == (8, 4, 0.5) and got["all"][:2] == (12, 8)


def test_watermark_windows(spark, sf):
    got = section_n.n08(spark, sf)
    assert got.count() > 0 and set(got.columns) == {"start", "layer", "n", "failures"}
