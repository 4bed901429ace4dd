"""Queries of the cascade section (F)."""

from __future__ import annotations

import uuid
from functools import cache

from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators import cascade as c
from semtflow.operators.entities import bio_tags, build_ner_table
from semtflow.operators.tagging import fit_tagger, load_tagger, save_tagger
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_b import features_sql
from semtflow.plans.section_e import dims
from semtflow.plans.section_j import rounded
from semtflow.plans.section_k import KEV
from semtflow.plans.section_k import events as keyed_events
from semtflow.session import shared_dir, spread
from semtflow.sources.derived import addresses, metric_events


#: Labelled addresses that the tagger learns from, at most; their keys are no address keys of the queries.
TRAIN_ROWS, TRAIN_KEY = 500, "(p_partkey + 1000003)"


@cache
def tagger(spark, sf_dir):
    """Fitted once on automatically labelled addresses, stored in the shared folder and loaded from there."""
    labelled = spread(addresses(spark, sf_dir, "part", TRAIN_KEY).orderBy("addr_id").limit(TRAIN_ROWS), "addr_id")
    path = f"{shared_dir(spark)}/tagger-{uuid.uuid4().hex}"
    save_tagger(spark, fit_tagger(bio_tags(build_ner_table(labelled.select("addr_id", "address")).select("addr_id", "text", "spans"))), path)
    return load_tagger(spark, path)


def raw(spark, sf_dir, table="customer", key="c_custkey"):
    """Addresses, some of them missing."""
    return addresses(spark, sf_dir, table, key).select("addr_id", F.when(F.col("addr_id") % 97 != 0, F.col("address")).alias("address"))


def results(spark, sf_dir, table="customer", key="c_custkey"):
    return c.normalize_addresses(raw(spark, sf_dir, table, key), dims(spark), tagger=tagger(spark, sf_dir))


@query("f01_normalize_addresses")
def f01(spark, sf_dir):
    out = results(spark, sf_dir)
    return rounded(out.select("addr_id", "raw_input", "success", "method", "confidence", "error", "fields.*", "normalized_address",
                              F.array_join("warnings", "; ").alias("warnings")))


@query("f02_error_rows")
def f02(spark, sf_dir):
    return results(spark, sf_dir).filter(~F.col("success")).select("addr_id", "method", "confidence", "error")


HIST = f"""{d.EVENTS}, rs AS (SELECT *, CASE WHEN NOT success THEN 'error' ELSE method END AS m FROM ev)"""


@query(
    "f03_batch_stats",
    f"""WITH {HIST} SELECT coalesce(m, 'all') AS method, count(*) AS total, count(*) FILTER (success) AS successful, count(*) FILTER (NOT success) AS failed,
        round(avg(success::INT), 6) AS success_rate, round(coalesce(avg(confidence) FILTER (success), 0), 6) AS average_confidence,
        round(avg(processing_time_ms), 6) AS average_time_ms FROM rs GROUP BY ROLLUP (m)""",
)
def f03(spark, sf_dir):
    ev = metric_events(spark, sf_dir).withColumn("method", F.when(~F.col("success"), "error").otherwise(F.col("method")))
    return rounded(c.batch_stats(ev, "processing_time_ms"))


@query("f03_cascade_stats")
def f03_cascade(spark, sf_dir):
    return rounded(c.batch_stats(results(spark, sf_dir)).drop("average_time_ms"))


@query("f04_hybrid_normalize")
def f04(spark, sf_dir):
    out = c.hybrid_normalize(raw(spark, sf_dir), {"pattern": 0.75}, tagger(spark, sf_dir))
    return rounded(out.select("addr_id", "success", "confidence", "layer", F.size("layers_attempted").alias("layers_used"), F.to_json("components").alias("components"), "error"))


LAYERS = f"""{d.EVENTS}, sc AS (SELECT event_id, ts, confidence AS p, (event_id * 31 % 100) / 100.0 AS ml, (user_id % 50) / 100.0 AS l, processing_time_ms AS ms FROM ev),
   ly AS (SELECT *, CASE WHEN p >= 0.4 THEN 'pattern' WHEN ml >= 0.5 THEN 'ml' WHEN l >= 0.3 THEN 'legacy' ELSE 'failed' END AS layer,
     CASE WHEN p >= 0.4 THEN 1 WHEN ml >= 0.5 THEN 2 ELSE 3 END AS k FROM sc)"""


def history(spark, sf_dir):
    """A routing history from the events table."""
    ev = metric_events(spark, sf_dir).select(
        "event_id", "ts", F.col("confidence").alias("pattern_confidence"), ((F.col("event_id") * 31 % 100) / 100.0).alias("ml_confidence"),
        ((F.col("user_id") % 50) / 100.0).alias("legacy_confidence"), F.col("processing_time_ms").alias("ms"))
    out = c.route_layers(ev)
    timed = F.transform("layers_attempted", lambda a: a.withField("ms", F.col("ms")))
    return out.withColumn("layers_attempted", timed)


@query(
    "f04_route_layers",
    f"""WITH {LAYERS} SELECT event_id, layer, layer <> 'failed' AS success, round(CASE layer WHEN 'pattern' THEN p WHEN 'ml' THEN ml WHEN 'legacy' THEN l ELSE 0 END, 6)::DOUBLE AS confidence,
        k::BIGINT AS layers_used FROM ly""",
)
def f04_route(spark, sf_dir):
    return rounded(history(spark, sf_dir).select("event_id", "layer", "success", "confidence", F.size("layers_attempted").cast("long").alias("layers_used")))


@query(
    "f05_fallback_metrics",
    f"""WITH {LAYERS} SELECT count(*) AS total_processed, round(avg((layer = 'pattern')::INT), 6) AS pattern_success_rate, round(avg((layer = 'ml')::INT), 6) AS ml_success_rate,
        round(avg((layer = 'legacy')::INT), 6) AS legacy_success_rate, round(avg((layer IN ('ml', 'legacy'))::INT), 6) AS fallback_rate,
        round(sum(ms * k) / sum(k), 6) AS average_processing_time FROM ly""",
)
def f05(spark, sf_dir):
    return rounded(c.layer_metrics(history(spark, sf_dir)))


@query("f05_layer_usage", f"WITH {LAYERS} SELECT layer, count(*) AS n FROM ly GROUP BY 1")
def f05_usage(spark, sf_dir):
    return c.layer_usage(history(spark, sf_dir))


@query(
    "f06_recent_performance",
    f"""WITH {LAYERS}, r AS (SELECT * FROM ly ORDER BY ts DESC, event_id DESC LIMIT 50)
        SELECT count(*) AS total_recent_processed, round(avg((layer <> 'failed')::INT), 6) AS recent_success_rate, round(avg(k), 6) AS average_layers_used FROM r""",
)
def f06(spark, sf_dir):
    return rounded(c.recent_layers(history(spark, sf_dir)))


@query(
    "f07_layer_failure_trigger",
    f"""WITH {LAYERS}, n AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS rn FROM ly)
        SELECT (rn - 1) // 100 AS block, count(*) FILTER (p < 0.4) AS pattern_failures, count(*) FILTER (p < 0.4) > 50 AS triggered FROM n GROUP BY 1 HAVING count(*) = 100""",
)
def f07(spark, sf_dir):
    return c.layer_failure_trigger(history(spark, sf_dir))


@query("f08_threshold_change_log")
def f08(spark, sf_dir):
    """Threshold settings per method: daily mean of the threshold in use."""
    ev = metric_events(spark, sf_dir)
    daily = ev.groupBy(F.col("method").alias("layer"), F.date_trunc("hour", "ts").alias("ts")).agg(
        F.max("event_id").alias("event_id"), F.round(F.avg("threshold_used"), 3).alias("threshold"))
    return c.threshold_change_log(daily).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query(
    "f09_hybrid_output",
    f"""WITH {d.ADDR} SELECT addr_id, CASE addr_id % 4 WHEN 0 THEN 'pattern' WHEN 1 THEN 'ml' ELSE 'fallback' END AS method,
          concat_ws('; ', CASE WHEN addr_id % 4 = 3 THEN 'All processing layers failed' END, CASE WHEN addr_id % 4 = 2 THEN 'low' END) AS warnings,
          CASE addr_id % 4 WHEN 0 THEN city || ' ' || district || ' ' || street WHEN 1 THEN nbh WHEN 2 THEN district ELSE address END AS normalized_address FROM addr""",
)
def f09(spark, sf_dir):
    k = F.col("addr_id") % 4
    m = lambda *kv: F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in kv])
    comps = (
        F.when(k == 0, m("street", F.col("street"), "district", F.col("district"), "province", F.col("city"))).when(k == 1, m("Mahalle", F.col("nbh"), "ml_processed", "True"))
        .when(k == 2, m("district", F.col("district"))).otherwise(m("raw_address", F.col("address"))))
    df = addresses(spark, sf_dir).select(
        "addr_id", "address", comps.alias("components"), F.when(k == 0, "pattern").when(k == 1, "ml").when(k == 2, "legacy").otherwise("failed").alias("layer"),
        F.when(k == 3, "All processing layers failed").alias("error"), F.when(k == 2, "low").alias("reason"))
    return c.hybrid_output(df)


@query(
    "f10_choose_method",
    f"""WITH {d.ADDR}, f AS (SELECT addr_id, {features_sql('address')} FROM addr), g AS (SELECT addr_id, (addr_id * 37 % 100) / 100.0::DOUBLE AS pattern_confidence,
          0.5 + (addr_id % 10) * 0.05::DOUBLE AS strength, has_postal_code, word_count FROM f), h AS (SELECT *, CAST({c.METHOD_THRESHOLD} AS DOUBLE) AS threshold FROM g)
        SELECT addr_id, round(threshold, 6) AS threshold, CASE WHEN pattern_confidence >= threshold THEN 'pattern' ELSE 'ml' END AS method FROM h""",
)
def f10(spark, sf_dir):
    k = F.col("addr_id")
    a = addresses(spark, sf_dir).select("addr_id", *t.text_features(F.col("address")), (k * 37 % 100 / F.lit(100.0)).alias("pattern_confidence"),
                                        (0.5 + k % 10 * 0.05).alias("strength"))
    return rounded(c.choose_method(a).select("addr_id", "threshold", "method"))


@query(
    "f11_pattern_strength",
    f"""WITH {KEV}, m AS (SELECT pattern_id, rn, n, avg(success::INT) OVER (PARTITION BY pattern_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS m FROM o)
        SELECT pattern_id, round(sum(CASE WHEN n - rn + 1 >= 10 THEN m * 0.1 * pow(0.9, rn - 1) ELSE 0 END) + 0.8 * pow(0.9, greatest(0, max(n) - 9)), 6) AS strength FROM m GROUP BY 1""",
)
def f11(spark, sf_dir):
    return rounded(c.pattern_strength(keyed_events(spark, sf_dir)))


@query(
    "f12_confidence_split",
    f"""WITH {d.EVENTS} SELECT count(*) AS total_processed, count(*) FILTER (confidence >= 0.5) AS successful, count(*) FILTER (confidence < 0.5) AS failed,
        round(avg(confidence) FILTER (confidence >= 0.5), 6) AS average_confidence, count(*) FILTER (confidence < 0.6) AS low_confidence_warnings FROM ev""",
)
def f12(spark, sf_dir):
    return rounded(c.confidence_split(metric_events(spark, sf_dir)))
