"""Confidence cascade over addresses, batch results and layer routing (F)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.functions.ordered import last_n, numbered, positions
from semtflow.operators import contract
from semtflow.operators.geo import Dims, apply_geo_validation
from semtflow.operators.patterns import normalized_string, slots_to_fields, with_best_match
from semtflow.operators.rules import normalize_fallback, normalize_legacy
from semtflow.operators.tagging import Tagger, with_ml
from semtflow.session import spread

FIELD_TYPE = "struct<" + ",".join(f"{f}:string" for f in fv.FIELDS) + ">"


@dataclass(frozen=True)
class Config:
    high: float = 0.8
    medium: float = 0.6
    ml: float = 0.7
    validate: bool = True
    default_threshold: float = 0.4


def _fields_of(m: Column) -> Column:
    return F.struct(*[t.blank_to_null(F.element_at(m, f)).alias(f) for f in fv.FIELDS])


def normalize_addresses(df: DataFrame, dims: Dims | None = None, cfg: Config = Config(), thresholds: dict[str, float] | None = None,
                        tagger: Tagger | None = None) -> DataFrame:
    """Pattern, ML or rules per row by confidence, then geographic and contract checks.

    Input: addr_id, address and, where another tagger has run, ``ml_fields``
    (map of field to value) and ``ml_confidence``; else ``tagger`` reads the text.
    The tagger and the rules see only the rows that
    need them: the others pass null, which both skip. The whole job is
    row-wise after one spread of the input over the cores.
    """
    given = [c for c in ("ml_fields", "ml_confidence") if c in df.columns]
    base = spread(df.select("addr_id", "address", *given), "addr_id")
    step = with_best_match(t.once(base, t.clean_text(F.col("address")), "text"), thresholds=thresholds, default=cfg.default_threshold)
    step = step.select(*[c for c in step.columns if c != "best"], F.col("best.confidence").alias("__pc"), F.col("best.slots").alias("__slots"))
    if not given:
        unsure = F.coalesce(F.col("__pc"), F.lit(0.0)) < cfg.high
        step = with_ml(t.once(step, F.when(unsure, F.col("text")), "__ml_text"), tagger, "__ml_text").drop("__ml_text")
    pc, ml = F.col("__pc"), F.coalesce(F.col("ml_confidence") >= cfg.ml, F.lit(False))
    route = (
        F.when(F.col("address").isNull(), "error").when(pc >= cfg.high, "pattern_high").when(ml & (pc >= cfg.medium), "ml_validation")
        .when(pc >= cfg.medium, "pattern_medium").when(ml, "ml_primary").otherwise("fallback"))
    step = t.once(step.drop("text"), route, "method")
    step = step.withColumn("__fb", F.when(F.col("method") == "fallback", F.col("address")))
    step = step.transform(normalize_fallback, col="__fb")
    is_pattern, is_ml = F.col("method").startswith("pattern"), F.col("method").startswith("ml")
    none = F.array().cast("array<string>")
    made = F.struct(*[c.alias(n) for n, c in {
        "fields": F.when(is_pattern, _fields_of(slots_to_fields(F.col("__slots")))).when(is_ml, _fields_of(F.col("ml_fields"))).otherwise(F.col("fields")),
        "confidence": F.when(is_pattern, F.col("__pc")).when(is_ml, F.col("ml_confidence")).when(F.col("method") == "error", 0.0).otherwise(F.col("confidence")),
        "warnings": F.when(is_pattern | is_ml, none).otherwise(F.col("warnings")),
    }.items()])
    step = t.once(step.withColumnRenamed("normalized_address", "__line"), made, "__r")
    step = step.select("addr_id", "address", "method", "__line", "__r.*")
    line = F.when(is_pattern | is_ml, normalized_string(lambda f: F.col(f"fields.{f}"))).otherwise(F.col("__line"))
    step = step.withColumn("normalized_address", line).select("addr_id", "address", "method", "confidence", "fields", "warnings", "normalized_address")
    if cfg.validate and dims is not None:
        step = apply_geo_validation(step, dims)
    return error_rows(step)


def error_rows(results: DataFrame) -> DataFrame:
    """Rows without text or outside the output contract become failures, with the reason."""
    broken = contract.violations(lambda f: F.col(f"fields.{f}"))
    why = F.when(F.col("address").isNull(), "Processing failed: no address text").when(
        F.size(broken) > 0, F.concat(F.lit("Processing failed: invalid "), F.array_join(broken, ", ")))
    step = t.once(results, why, "error")
    bad = F.col("error").isNotNull()
    return step.select(
        "addr_id", F.col("address").alias("raw_input"), (~bad).alias("success"), F.when(bad, "error").otherwise(F.col("method")).alias("method"),
        F.when(bad, 0.0).otherwise(F.col("confidence")).alias("confidence"), "error",
        F.when(~bad, F.col("fields")).alias("fields"), F.when(~bad, F.col("normalized_address")).alias("normalized_address"),
        F.when(~bad, F.col("warnings")).alias("warnings"))


def batch_stats(results: DataFrame, time_col: str | None = None) -> DataFrame:
    """Totals and one row per method, from a single grouped pass."""
    ms = F.col(time_col) if time_col else F.lit(None).cast("double")
    return results.rollup("method").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("success").alias("successful"), F.count_if(~F.col("success")).alias("failed"),
        F.avg(F.col("success").cast("int")).alias("success_rate"), F.coalesce(F.avg(F.when(F.col("success"), F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        F.avg(ms).alias("average_time_ms"),
    ).na.fill({"method": "all"})


# --- layers -----------------------------------------------------------------

LAYER_THRESHOLDS = {"pattern": 0.4, "ml": 0.5, "legacy": 0.3}


def route_layers(scored: DataFrame, thresholds: dict[str, float] | None = None) -> DataFrame:
    """First layer to reach its threshold wins; adds layer, success, confidence and the layers tried.

    Input carries ``pattern_confidence``, ``ml_confidence`` and ``legacy_confidence``.
    """
    th = LAYER_THRESHOLDS | (thresholds or {})
    score = {k: F.coalesce(F.col(f"{k}_confidence"), F.lit(0.0)) for k in th}
    won = {k: score[k] >= th[k] for k in th}
    layer = F.when(won["pattern"], "pattern").when(won["ml"], "ml").when(won["legacy"], "legacy").otherwise("failed")
    tried = lambda k: F.struct(F.lit(k).alias("layer"), won[k].alias("success"), score[k].alias("confidence"))
    attempts = (
        F.when(won["pattern"], F.array(tried("pattern"))).when(won["ml"], F.array(tried("pattern"), tried("ml")))
        .otherwise(F.array(tried("pattern"), tried("ml"), tried("legacy"))))
    conf = F.when(layer == "pattern", score["pattern"]).when(layer == "ml", score["ml"]).when(layer == "legacy", score["legacy"]).otherwise(0.0)
    return scored.withColumns({"layer": layer, "success": layer != "failed", "confidence": conf, "layers_attempted": attempts})


def hybrid_normalize(df: DataFrame, thresholds: dict[str, float] | None = None, tagger: Tagger | None = None) -> DataFrame:
    """Pattern, ML and legacy layers; each reads only the rows that the layers before it left."""
    th = LAYER_THRESHOLDS | (thresholds or {})
    given = [c for c in ("ml_fields", "ml_confidence") if c in df.columns]
    step = with_best_match(t.once(spread(df.select("addr_id", "address", *given), "addr_id"), t.clean_text(F.col("address")), "text"))
    step = step.select(*[c for c in step.columns if c != "best"], F.col("best.confidence").alias("pattern_confidence"), F.col("best.slots").alias("__slots"))
    if not given:
        unsure = F.coalesce(F.col("pattern_confidence"), F.lit(0.0)) < th["pattern"]
        step = with_ml(t.once(step, F.when(unsure, F.col("text")), "__ml_text"), tagger, "__ml_text").drop("__ml_text")
    early = (F.coalesce(F.col("pattern_confidence"), F.lit(0.0)) >= th["pattern"]) | (F.coalesce(F.col("ml_confidence"), F.lit(0.0)) >= th["ml"])
    step = step.withColumn("__rest", F.when(~early, F.col("address"))).drop("text").transform(normalize_legacy, col="__rest")
    step = step.withColumn("legacy_confidence", F.when(F.col("success"), F.col("confidence")))
    step = step.withColumnRenamed("components", "__legacy").drop("confidence", "success", "details")
    out = route_layers(step, thresholds)
    comps = F.when(F.col("layer") == "pattern", F.col("__slots")).when(F.col("layer") == "ml", F.col("ml_fields")).when(
        F.col("layer") == "legacy", F.col("__legacy")).otherwise(F.create_map(F.lit("raw_address"), F.col("address")))
    err = F.when(F.col("layer") == "failed", "All processing layers failed")
    return out.select("addr_id", "address", "success", "confidence", "layer", "layers_attempted", comps.alias("components"), err.alias("error"))


def layer_metrics(history: DataFrame) -> DataFrame:
    """Rates over all rows and mean time over attempted layers. History: layer, layers_attempted[layer, success, ms]."""
    share = lambda *names: F.avg(F.col("layer").isin(*names).cast("int"))
    times = F.aggregate("layers_attempted", F.lit(0.0), lambda a, x: a + x["ms"])
    return history.agg(
        F.count(F.lit(1)).alias("total_processed"), share("pattern").alias("pattern_success_rate"), share("ml").alias("ml_success_rate"),
        share("legacy").alias("legacy_success_rate"), share("ml", "legacy").alias("fallback_rate"),
        (F.sum(times) / F.sum(F.size("layers_attempted"))).alias("average_processing_time"))


def layer_usage(history: DataFrame) -> DataFrame:
    return history.groupBy("layer").agg(F.count(F.lit(1)).alias("n"))


def recent_layers(history: DataFrame, n: int = 50, minimum: int = 10) -> DataFrame:
    newest = last_n(history, [], ["ts", "event_id"], n)
    return newest.agg(
        F.count(F.lit(1)).alias("total_recent_processed"), F.avg((F.col("layer") != "failed").cast("int")).alias("recent_success_rate"),
        F.avg(F.size("layers_attempted")).alias("average_layers_used")).filter(F.col("total_recent_processed") >= minimum)


def layer_failure_trigger(history: DataFrame, every: int = 100, limit: int = 50) -> DataFrame:
    """Per block of ``every`` records in time order: pattern failures and whether they pass the limit."""
    miss = F.exists("layers_attempted", lambda a: (a["layer"] == "pattern") & ~a["success"])
    rows = numbered(history.select("ts", "event_id", miss.alias("miss")), ["ts", "event_id"])
    blocks = rows.groupBy(F.floor((F.col("rn") - 1) / every).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("miss").alias("pattern_failures"))
    return blocks.filter(F.col("n") == every).select("block", "pattern_failures", (F.col("pattern_failures") > limit).alias("triggered"))


def threshold_change_log(history: DataFrame, limit: float = 0.05) -> DataFrame:
    """Rows whose threshold moved by more than ``limit`` from the last logged one, per layer.

    What was logged last depends on every earlier choice, so the rows of a
    layer are folded in time order inside hour blocks that keep only changes of
    value; input is one row per threshold change, not per address.
    """
    w = Window.partitionBy("layer").orderBy("ts", "event_id")
    moves = history.select("layer", "ts", "event_id", "threshold").withColumn("prev", F.lag("threshold").over(w))
    moves = moves.filter(F.col("prev").isNull() | (F.col("prev") != F.col("threshold")))
    rows = moves.groupBy("layer").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", "threshold"))).alias("rows"))

    def fold(acc: Column, r: Column) -> Column:
        last = F.element_at(acc, -1)
        return F.when((F.size(acc) == 0) | (F.abs(last["threshold"] - r["threshold"]) > limit + 1e-12), F.concat(acc, F.array(r))).otherwise(acc)

    start = F.array().cast("array<struct<ts:timestamp,event_id:bigint,threshold:double>>")
    return rows.select("layer", F.explode(F.aggregate("rows", start, fold)).alias("r")).select("layer", "r.*")


def hybrid_output(df: DataFrame) -> DataFrame:
    """Method enum, warnings and one line of the components in fixed order, any components, or the raw text."""
    get = lambda k: t.blank_to_null(F.element_at("components", k))
    line = F.concat_ws(" ", *[get(k) for k in ("province", "district", "neighborhood", "street", "building_no")])
    others = F.map_filter("components", lambda k, v: ~k.isin("raw_address", "ml_processed") & (F.coalesce(v, F.lit("")) != ""))
    loose = F.array_join(F.transform(F.array_sort(F.map_entries(others)), lambda e: e["value"]), " ")
    text = F.coalesce(F.nullif(line, F.lit("")), F.nullif(loose, F.lit("")), t.blank_to_null(F.col("address")), F.lit("Unknown Address"))
    method = F.when(F.col("layer") == "pattern", "pattern").when(F.col("layer") == "ml", "ml").otherwise("fallback")
    return df.select("addr_id", method.alias("method"), F.concat_ws("; ", "error", "reason").alias("warnings"), text.alias("normalized_address"))


METHOD_THRESHOLD = """greatest(0.5, least(0.95, 0.7 + CASE WHEN strength > 0.8 THEN -0.1 * (strength - 0.8) / 0.2
    WHEN strength < 0.6 THEN 0.2 * (0.6 - strength) / 0.6 ELSE 0.0 END
    - CASE WHEN has_postal_code > 0 THEN 0.05 ELSE 0.0 END + CASE WHEN word_count > 8 THEN 0.05 ELSE 0.0 END))"""


def choose_method(df: DataFrame) -> DataFrame:
    """Per-row threshold from strength and text features; pattern if its confidence reaches it, else ml."""
    out = df.withColumn("threshold", F.expr(METHOD_THRESHOLD).cast("double"))
    return out.withColumn("method", F.when(F.col("pattern_confidence") >= F.col("threshold"), "pattern").otherwise("ml"))


def pattern_strength(history: DataFrame, alpha: float = 0.1, span: int = 10) -> DataFrame:
    """Strength per pattern: after ``span`` outcomes, 0.9 x strength + 0.1 x mean of the last ``span``, from 0.8.

    An outcome at position k enters the means that end at max(k, span) to min(k + span - 1, n);
    their weights are a geometric series, so the strength is one weighted sum over positions.
    """
    rows = positions(history.select("pattern_id", "ts", "event_id", F.col("success").cast("int").alias("v")), ["pattern_id"], ["ts", "event_id"])
    first, last = F.greatest(F.col("pos"), F.lit(span)), F.least(F.col("pos") + (span - 1), F.col("n"))
    decay = F.lit(1 - alpha)
    weight = F.when(first <= last, (F.pow(decay, F.col("n") - last) - F.pow(decay, F.col("n") - first + 1)) / span).otherwise(0.0)
    agg = rows.groupBy("pattern_id").agg(F.sum(F.col("v") * weight).alias("s"), F.max("n").alias("n"))
    steps = F.greatest(F.lit(0), F.col("n") - (span - 1))
    return agg.select("pattern_id", (F.col("s") + 0.8 * F.pow(decay, steps)).alias("strength"))


def confidence_split(results: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Batch totals where success means reaching the threshold."""
    good = F.col("confidence") >= threshold
    return results.agg(
        F.count(F.lit(1)).alias("total_processed"), F.count_if(good).alias("successful"), F.count_if(~good).alias("failed"),
        F.coalesce(F.avg(F.when(good, F.col("confidence"))), F.lit(0.0)).alias("average_confidence"),
        F.count_if(F.col("confidence") < 0.6).alias("low_confidence_warnings"))


def result_warnings(confidence: Column, city: Column, district: Column, neighborhood: Column) -> Column:
    return F.array_compact(F.array(
        F.when(confidence < 0.6, "Low confidence score - manual review recommended"),
        F.when(t.blank_to_null(city).isNull(), "Province (il) not detected"),
        F.when(t.blank_to_null(district).isNull(), "District (ilçe) not detected"),
        F.when((confidence < 0.8) & t.blank_to_null(neighborhood).isNull(), "Neighborhood (mahalle) not detected")))
