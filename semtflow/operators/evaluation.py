"""Accuracy, calibration and regression reports (M) and entity scores (part of G).

Predictions and truth are long tables: addr_id, component, value. Joins are
full outer on (addr_id, component), both sides evenly keyed by address.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_match(pred: Column, gold: Column) -> Column:
    """Equal after trim and lowercase, or one inside the other when both are longer than three."""
    p, g = F.lower(F.trim(pred)), F.lower(F.trim(gold))
    inside = (F.length(p) > 3) & (F.length(g) > 3) & (p.contains(g) | g.contains(p))
    return F.coalesce((p == g) | inside, F.lit(False))


def _paired(pred: DataFrame, gold: DataFrame) -> DataFrame:
    p = pred.filter(F.coalesce(F.trim("value"), F.lit("")) != "").select("addr_id", "component", F.col("value").alias("pred"))
    g = gold.filter(F.coalesce(F.trim("value"), F.lit("")) != "").select("addr_id", "component", F.col("value").alias("gold"))
    return p.join(g, ["addr_id", "component"], "full_outer").withColumn("hit", value_match(F.col("pred"), F.col("gold")))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0)), F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return [p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1")]


def component_accuracy(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Per component TP, FP, FN (a wrong value is both), precision, recall, F1."""
    agg = _paired(pred, gold).groupBy("component").agg(
        F.count_if("hit").alias("tp"), F.count_if(F.col("pred").isNotNull() & ~F.col("hit")).alias("fp"),
        F.count_if(F.col("gold").isNotNull() & ~F.col("hit")).alias("fn"))
    return agg.select("component", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")))


def row_correct(pred: DataFrame, gold: DataFrame, rows: DataFrame, share: float = 0.7) -> DataFrame:
    """At least ``share`` of the expected components match; nothing expected counts as correct."""
    per = _paired(pred, gold).filter(F.col("gold").isNotNull()).groupBy("addr_id").agg(F.avg(F.col("hit").cast("int")).alias("matched"))
    return rows.join(per, "addr_id", "left").withColumn("correct", F.coalesce(F.col("matched") >= share, F.lit(True)))


def calibration(scored: DataFrame) -> DataFrame:
    """Accuracy by confidence bucket. Rows: confidence, correct."""
    c = F.col("confidence")
    bucket = F.when(c >= 0.9, "0.9-1.0").when(c >= 0.7, "0.7-0.9").when(c >= 0.5, "0.5-0.7").when(c >= 0.3, "0.3-0.5").when(c >= 0.1, "0.1-0.3").otherwise("0.0-0.1")
    return scored.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"))


def error_breakdown(pred: DataFrame, gold: DataFrame, scores: DataFrame) -> DataFrame:
    """Mismatches by component and kind, how many at high confidence, and their mean confidence."""
    miss = _paired(pred, gold).filter(F.col("gold").isNotNull() & ~F.col("hit")).join(scores, "addr_id")
    kind = F.when(F.col("pred").isNull(), "missing").when(F.length("pred") < F.length("gold") / 2, "too_short").otherwise("wrong_value")
    return miss.groupBy("component", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("confidence") > 0.8).alias("high_confidence"), F.avg("confidence").alias("mean_confidence"))


def accuracy_by_category(scored: DataFrame) -> DataFrame:
    return scored.rollup("category").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.avg("confidence").alias("mean_confidence")).na.fill({"category": "all"})


def accuracy_summary(components: DataFrame) -> DataFrame:
    order = F.struct("f1", "component")
    return components.agg(F.avg("f1").alias("mean_f1"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"),
                          F.max_by("component", order).alias("best_component"), F.min_by("component", order).alias("worst_component"))


def golden_compare(pred: DataFrame, golden: DataFrame, cases: DataFrame, critical: list[str], need: float = 0.8, optional_need: float = 0.6) -> DataFrame:
    """Pass, fail or error per case: enough critical and enough optional components match. Cases: addr_id, category, method, error."""
    hits = _paired(pred, golden).filter(F.col("gold").isNotNull()).withColumn("crit", F.col("component").isin(critical))
    per = hits.groupBy("addr_id").agg(F.avg(F.when(F.col("crit"), F.col("hit").cast("int"))).alias("c"), F.avg(F.when(~F.col("crit"), F.col("hit").cast("int"))).alias("o"))
    ok = (F.coalesce(F.col("c"), F.lit(1.0)) >= need) & (F.coalesce(F.col("o"), F.lit(1.0)) >= optional_need)
    status = F.when(F.col("error").isNotNull(), "error").when(ok, "pass").otherwise("fail")
    return cases.join(per, "addr_id", "left").select("addr_id", "category", "method", status.alias("status"))


def golden_summary(compared: DataFrame) -> DataFrame:
    return compared.groupBy("category", "status").agg(F.count(F.lit(1)).alias("n"))


def config_regression(runs: DataFrame, base: str) -> DataFrame:
    """Per config against the base: changes of success, method, output and confidence (> 0.1).

    Runs: config, addr_id, success, method, output, confidence.
    """
    b = runs.filter(F.col("config") == base).select("addr_id", *[F.col(c).alias(f"b_{c}") for c in ("success", "method", "output", "confidence")])
    j = runs.filter(F.col("config") != base).join(b, "addr_id")
    differs = lambda c: ~F.col(c).eqNullSafe(F.col(f"b_{c}"))
    return j.groupBy("config").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(differs("success")).alias("success_changes"), F.count_if(differs("method")).alias("method_changes"),
        F.count_if(differs("output")).alias("output_changes"), F.count_if(F.abs(F.col("confidence") - F.col("b_confidence")) > 0.1).alias("confidence_changes"))


def threshold_runs(scored: DataFrame, configs: list[tuple[str, float, float, float]]) -> DataFrame:
    """Route every scored row under each (name, high, medium, ml) setting. Rows: addr_id, pattern, ml, output."""
    def one(name: str, high: float, medium: float, ml: float) -> Column:
        p, m = F.col("pattern"), F.col("ml")
        method = F.when(p >= high, "pattern_high").when((p >= medium) & (m >= ml), "ml_validation").when(p >= medium, "pattern_medium").when(m >= ml, "ml_primary").otherwise("fallback")
        conf = F.when(method.startswith("pattern"), p).when(method.startswith("ml"), m).otherwise(0.3)
        return F.struct(F.lit(name).alias("config"), F.lit(True).alias("success"), method.alias("method"), F.concat_ws("/", F.split(method, "_")[0], "output").alias("output"), conf.alias("confidence"))

    return scored.select("addr_id", F.explode(F.array(*[one(*c) for c in configs])).alias("r")).select("addr_id", "r.*")


def slowdown_check(base: DataFrame, run: DataFrame, factor: float = 2.0) -> DataFrame:
    j = run.join(base.select("addr_id", F.col("ms").alias("base_ms")), "addr_id")
    return j.filter(F.col("ms") > F.col("base_ms") * factor).select("addr_id", "base_ms", "ms", (F.col("ms") / F.col("base_ms")).alias("factor"))


def benchmark_delta(base: DataFrame, current: DataFrame) -> DataFrame:
    """Change of throughput, memory and success per benchmark, with regression flags."""
    j = current.join(base.select("name", *[F.col(c).alias(f"b_{c}") for c in ("throughput", "memory", "success_rate")]), "name")
    tp, mem, ok = (F.col("throughput") - F.col("b_throughput")) / F.col("b_throughput"), (F.col("memory") - F.col("b_memory")) / F.col("b_memory"), F.col("success_rate") - F.col("b_success_rate")
    flags = F.concat_ws(",", F.when(tp < -0.1, "throughput"), F.when(mem > 0.2, "memory"), F.when(ok < -0.05, "success"))
    return j.select("name", tp.alias("throughput_change"), mem.alias("memory_change"), ok.alias("success_change"), flags.alias("regressions"))


def sample_stats(samples: DataFrame) -> DataFrame:
    """Counts by category, by difficulty and overall, one pass."""
    sets = samples.groupingSets([["category"], ["difficulty"], []], "category", "difficulty").agg(
        F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.avg(F.col("expected_success").cast("int")).alias("expected_success_rate"))
    return sets.select(F.when(F.col("g") == 1, "category").when(F.col("g") == 2, "difficulty").otherwise("all").alias("kind"),
                       F.coalesce("category", "difficulty", F.lit("all")).alias("name"), "n", "expected_success_rate")


# --- entities ---------------------------------------------------------------

LABEL_FIELDS = {  # fixed values: entity label to output field
    "IL": "city", "ILCE": "district", "MAH": "neighborhood", "SOKAK": "street", "CADDE": "street", "BULVAR": "street",
    "NO": "number", "KAT": "floor", "DAIRE": "apartment", "BLOK": "block",
}


def entities_to_fields(entities: DataFrame) -> DataFrame:
    """One column per field: street entities joined in order, otherwise the last one."""
    cases = F.coalesce(*[F.when(F.col("label") == k, v) for k, v in LABEL_FIELDS.items()])
    e = entities.withColumn("field", cases).filter(F.col("field").isNotNull() & (F.trim("text") != ""))
    # an address has a handful of entities
    ordered = F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "street", F.struct("start", "text")))), lambda x: x["text"])
    streets = F.nullif(F.array_join(ordered, " "), F.lit(""))
    cols = [F.max_by(F.when(F.col("field") == f, F.col("text")), F.when(F.col("field") == f, F.col("start"))).alias(f) for f in dict.fromkeys(LABEL_FIELDS.values()) if f != "street"]
    return e.groupBy("addr_id").agg(streets.alias("street"), *cols)


def ml_confidence(entities: DataFrame) -> DataFrame:
    """Mean entity confidence and the sequence variant with its bonus for three labels."""
    agg = entities.groupBy("addr_id").agg(F.avg("confidence").alias("confidence"), F.countDistinct("label").alias("labels"))
    return agg.withColumn("sequence_confidence", F.least(F.lit(1.0), F.col("confidence") + F.when(F.col("labels") >= 3, 0.1).otherwise(0.0)))


def ml_fallback_select(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pattern if sure enough, else ML, else pattern again, with the method's name."""
    p, m = F.col("pattern_confidence"), F.col("ml_confidence")
    method = (
        F.when(p >= threshold, "pattern_matching").when(F.col("ml_available") & m.isNotNull(), "ml_fallback")
        .when(F.col("ml_available") & p.isNotNull(), "pattern_matching_fallback").when(p.isNotNull(), "pattern_matching_only").otherwise("unknown"))
    conf = F.when(method == "ml_fallback", m).otherwise(F.coalesce(p, F.lit(0.0)))
    return df.withColumns({"method": method, "confidence": conf, "fallback_used": method == "ml_fallback"})


def span_prf(pred: DataFrame, gold: DataFrame, by_label: bool = False) -> DataFrame:
    """Exact-span precision, recall and F1, overall or per label."""
    key = ["addr_id", "start", "end", "label"]
    p, g = pred.select(*key).distinct().withColumn("p", F.lit(1)), gold.select(*key).distinct().withColumn("g", F.lit(1))
    j = p.join(g, key, "full_outer")
    agg = j.groupBy(*(["label"] if by_label else [])).agg(
        F.count("p").alias("total_predicted"), F.count("g").alias("total_gold"), F.count_if(F.col("p").isNotNull() & F.col("g").isNotNull()).alias("total_correct"))
    c, np_, ng = F.col("total_correct"), F.col("total_predicted"), F.col("total_gold")
    return agg.select(*agg.columns, *prf(c, np_ - c, ng - c))


def prediction_coverage(pred: DataFrame, rows: DataFrame) -> DataFrame:
    per = pred.groupBy("addr_id").agg(F.count(F.lit(1)).alias("k"))
    return rows.join(per, "addr_id", "left").agg(
        F.count(F.lit(1)).alias("total_addresses"), F.count("k").alias("addresses_with_entities"), (F.count("k") / F.count(F.lit(1)) * 100).alias("coverage_percentage"),
        F.coalesce(F.sum("k"), F.lit(0)).alias("total_entities"), (F.coalesce(F.sum("k"), F.lit(0)) / F.count(F.lit(1))).alias("avg_entities_per_address"))


def label_stats(spans: DataFrame) -> DataFrame:
    return spans.groupBy("label").agg(F.count(F.lit(1)).alias("n_spans"), F.countDistinct("addr_id").alias("n_examples"))


def model_comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """Metric by metric: original, improved and relative change in percent."""
    j = a.select("metric", F.col("value").alias("original")).join(b.select("metric", F.col("value").alias("improved")), "metric", "full_outer")
    return j.withColumn("change_pct", F.try_divide(F.col("improved") - F.col("original"), F.col("original")) * 100)


def component_key_prf(df: DataFrame) -> DataFrame:
    """Per-case scores on sets of component names. Rows: predicted and expected arrays, success."""
    hit = F.size(F.array_intersect("predicted", "expected"))
    none = F.size("expected") == 0
    p = F.when(none, F.when(F.size("predicted") == 0, 1.0).otherwise(0.0)).otherwise(F.coalesce(F.try_divide(hit, F.size("predicted")), F.lit(0.0)))
    r = F.when(none, 1.0).otherwise(F.coalesce(F.try_divide(hit, F.size("expected")), F.lit(0.0)))
    s = df.withColumns({"p": F.when(F.col("success"), p).otherwise(0.0), "r": F.when(F.col("success"), r).otherwise(0.0)})
    f1 = F.when(F.col("success") & none, 1.0).otherwise(F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)))
    return s.groupBy("method").agg(F.count(F.lit(1)).alias("total_cases"), F.avg("p").alias("precision"), F.avg("r").alias("recall"), F.avg(f1).alias("f1_score"))
