"""Queries of the source and sink section (A): derived rows written, read back and compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.operators import quality as q
from semtflow.operators.analytics import latest, performance_metrics
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_f import results
from semtflow.plans.section_i import rows as quality_rows
from semtflow.plans.section_j import rounded
from semtflow.sources import dims, readers, sinks
from semtflow.sources.derived import addresses, metric_events
from semtflow.streaming.streams import scratch


@query("a01_read_address_lines", f"WITH {d.ADDR} SELECT trim(address) AS address FROM addr WHERE addr_id % 10 <> 0")
def a01(spark, sf_dir):
    out = scratch(spark, "a01")
    lines = addresses(spark, sf_dir).select(F.when(F.col("addr_id") % 10 == 0, "   ").otherwise(F.concat(F.lit("  "), "address", F.lit(" "))).alias("value"))
    lines.write.text(out)
    return readers.read_address_lines(spark, out)


@query("a02_read_address_csv", f"WITH {d.ADDR} SELECT trim(address) AS address FROM addr WHERE addr_id % 10 <> 0")
def a02(spark, sf_dir):
    out = scratch(spark, "a02")
    a = addresses(spark, sf_dir).select("addr_id", F.when(F.col("addr_id") % 10 != 0, F.col("address")).alias("address"))
    a.write.option("header", True).option("escape", '"').csv(out)
    return readers.read_address_csv(spark, out)


def spans_of(a):
    start = F.locate("No:", F.col("address")) + 2
    return a.select(F.col("address").alias("text"), F.array(
        F.struct(F.lit(0).alias("start"), F.length("nbh").alias("end"), F.lit("MAH").alias("label")),
        F.struct(start.alias("start"), (start + F.length("number")).alias("end"), F.lit("NO").alias("label"))).alias("spans"))


SPANS = """concat_ws(';', '0-' || length(nbh) || '-MAH', (instr(address, 'No:') + 2) || '-' || (instr(address, 'No:') + 2 + length(number)) || '-NO')"""


@query("a03_read_ner_jsonl", f"WITH {d.ADDR} SELECT address AS text, {SPANS} AS spans FROM addr")
def a03(spark, sf_dir):
    out = scratch(spark, "a03")
    sinks.write_ner_jsonl(spans_of(addresses(spark, sf_dir)), out)
    say = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["label"])
    return readers.read_ner_jsonl(spark, out).select("text", F.array_join(F.transform("spans", say), ";").alias("spans"))


@query("a17_write_ner_jsonl", f"WITH {d.ADDR} SELECT count(*) AS n_rows, CAST(sum(length(address)) AS BIGINT) AS n_chars FROM addr")
def a17(spark, sf_dir):
    out = scratch(spark, "a17")
    sinks.write_ner_jsonl(spans_of(addresses(spark, sf_dir)), out)
    return spark.read.schema("text string").json(out).agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.length("text")).alias("n_chars"))


_KEYS = [k for k in fv.ABBREVIATIONS if k.isalnum()]


@query(
    "a07_abbreviation_dim",
    f"""WITH {d.ADDR}, w AS (SELECT unnest(list_distinct(regexp_split_to_array(lower(replace(address, 'İ', 'i̇')), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'))) AS w FROM addr),
        k(abbrev, full_form) AS (VALUES {", ".join(f"('{k}', '{fv.ABBREVIATIONS[k]}')" for k in _KEYS)})
        SELECT abbrev, full_form, count(*) AS n_addresses FROM k JOIN w ON w.w = k.abbrev GROUP BY 1, 2""",
)
def a07(spark, sf_dir):
    """Plain abbreviations that occur, with the number of addresses that use them."""
    low = F.lower("address")
    words = addresses(spark, sf_dir).select(F.explode(F.array_distinct(F.split(low, r"(?U)\W+"))).alias("w"))
    used = words.groupBy("w").agg(F.count(F.lit(1)).alias("n_addresses"))
    dim = dims.abbreviation_dim(spark).filter(F.col("abbrev").rlike(r"(?U)^\w+$"))
    return used.join(F.broadcast(dim), F.col("w") == F.col("abbrev")).select("abbrev", F.col("full").alias("full_form"), "n_addresses")


@query(
    "a10_read_metric_events",
    f"""WITH {d.EVENTS} SELECT method, pattern_id, count(*) AS n, count(*) FILTER (success) AS ok, round(sum(processing_time_ms), 4) AS ms,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS newest FROM ev GROUP BY 1, 2""",
)
def a10(spark, sf_dir):
    out = scratch(spark, "a10")
    ev = metric_events(spark, sf_dir).select(
        F.col("ts").alias("timestamp"), "metric_type", "method", "pattern_id", "success", "confidence", "processing_time_ms", F.lit(80).alias("address_length"),
        F.lit(4).alias("components_extracted"), "error_type", F.create_map(F.lit("user"), F.col("user_id").cast("string")).alias("metadata"))
    ev.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(out)
    back = readers.read_metric_events(spark, out)
    return back.groupBy("method", "pattern_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("success").alias("ok"), F.round(F.sum("processing_time_ms"), 4).alias("ms"),
        F.date_format(F.max("timestamp"), "yyyy-MM-dd HH:mm:ss").alias("newest"))


@query("a11_write_results_jsonl")
def a11(spark, sf_dir):
    out = scratch(spark, "a11")
    sinks.write_results_jsonl(results(spark, sf_dir), out)
    back = spark.read.schema("explanation_raw string, normalized_address string, error string, processing_method string").json(out)
    return back.groupBy(F.col("error").isNull().alias("success")).agg(F.count(F.lit(1)).alias("n"))


@query("a12_write_results_csv")
def a12(spark, sf_dir):
    out = scratch(spark, "a12")
    sinks.write_results_csv(results(spark, sf_dir), out)
    return spark.read.option("header", True).option("escape", '"').csv(out).groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.count("city").alias("n_city"))


@query("a13_write_enhanced_flat")
def a13(spark, sf_dir):
    out = scratch(spark, "a13")
    sinks.write_enhanced_flat(q.enhanced_result(quality_rows(spark, sf_dir)), out, "tsv")
    back = spark.read.option("header", True).option("sep", "\t").option("escape", '"').csv(out)
    return back.groupBy("processing_method", "validation_status").agg(F.count(F.lit(1)).alias("n"))


@query("a14_write_results_xml", f"WITH {d.ADDR} SELECT count(*) AS n, count(DISTINCT address) AS n_addresses FROM addr")
def a14(spark, sf_dir):
    out = scratch(spark, "a14")
    a = addresses(spark, sf_dir).select("addr_id", F.col("address"), F.struct("city", "district").alias("fields"), F.array("nbh", "street").alias("warnings"))
    sinks.write_results_xml(a, out)
    schema = "addr_id long, address string, fields struct<city:string,district:string>, warnings array<string>"
    back = spark.read.format("xml").option("rowTag", "result").schema(schema).load(out)
    return back.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("address").alias("n_addresses"))


@query("a15_export_results")
def a15(spark, sf_dir):
    return rounded(sinks.export_frame(results(spark, sf_dir)))


@query(
    "a16_legacy_projection",
    f"WITH {d.ADDR} SELECT addr_id, city, district, coalesce(postcode_in, '') AS postcode_in, CAST(addr_id * 37 % 100 / 100.0::DOUBLE AS VARCHAR) AS confidence FROM addr",
)
def a16(spark, sf_dir):
    a = addresses(spark, sf_dir).withColumn("confidence", F.col("addr_id") * 37 % 100 / F.lit(100.0))
    return sinks.legacy_projection(a, ["city", "district", "postcode_in"])


@query(
    "a16_compact_projection",
    f"""WITH {d.ADDR} SELECT addr_id, addr_id % 9 <> 0 AS success, address, round(addr_id % 1000 / 1001.0::DOUBLE, 3) AS confidence, round(addr_id % 77 / 78.0::DOUBLE, 3) AS quality FROM addr""",
)
def a16_compact(spark, sf_dir):
    k = F.col("addr_id")
    return sinks.compact_projection(addresses(spark, sf_dir).select("addr_id", "address", (k % 9 != 0).alias("success"), (k % 1000 / 1001.0).alias("confidence"), (k % 77 / 78.0).alias("quality")))


@query(
    "a18_metric_snapshot",
    f"WITH {d.EVENTS} SELECT '2024-01-29' AS snapshot_date, count(*) AS total_processed FROM ev UNION ALL SELECT '2024-01-30', count(*) FROM ev",
)
def a18(spark, sf_dir):
    out = scratch(spark, "a18")
    m = performance_metrics(metric_events(spark, sf_dir))
    for date in ("2023-12-01", "2024-01-29", "2024-01-30"):
        sinks.write_metric_snapshot(m, out, date)
    kept = sinks.read_snapshots(spark, out, "2024-01-30")
    return kept.select(F.col("snapshot_date").cast("string").alias("snapshot_date"), "total_processed")


@query(
    "a19_export_events",
    f"WITH {d.EVENTS} SELECT event_id, pattern_id, success, round(confidence, 6) AS confidence FROM ev WHERE ts BETWEEN (SELECT max(ts) FROM ev) - INTERVAL 7 DAY AND (SELECT max(ts) FROM ev)",
)
def a19(spark, sf_dir):
    ev = metric_events(spark, sf_dir)
    now = latest(ev)
    return rounded(sinks.export_events(ev, now - F.expr("INTERVAL 7 DAYS"), now).select("event_id", "pattern_id", "success", "confidence"))


