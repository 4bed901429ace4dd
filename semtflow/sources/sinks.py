"""Result sinks and the frames they write."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv

METHOD = {"pattern": "pattern", "ml": "ml"}


def _method(c: Column) -> Column:
    return F.when(c.startswith("pattern"), "pattern").when(c.startswith("ml"), "ml").otherwise("fallback")


def jsonl_frame(results: DataFrame) -> DataFrame:
    """One JSON text per result: the address record, or the error record of a failure."""
    parsed = F.struct("confidence", _method(F.col("method")).alias("method"), "warnings")
    good = results.filter("success").select(F.to_json(F.struct(
        "fields.*", F.col("raw_input").alias("explanation_raw"), parsed.alias("explanation_parsed"), "normalized_address")).alias("value"))
    bad = results.filter("NOT success").select(F.to_json(F.struct(
        F.col("raw_input").alias("explanation_raw"), "error", F.col("method").alias("processing_method"))).alias("value"))
    return good.unionByName(bad)


def write_results_jsonl(results: DataFrame, path: str) -> None:
    jsonl_frame(results).write.mode("overwrite").text(path)


def csv_frame(results: DataFrame) -> DataFrame:
    """The 18 contract columns of the successful rows; null is '' here and nowhere else."""
    have = {f: F.col(f"fields.{f}") for f in fv.FIELDS} | {
        "explanation_raw": F.col("raw_input"), "normalized_address": F.col("normalized_address"),
        "confidence": F.col("confidence").cast("string"), "method": _method(F.col("method")), "warnings": F.to_json("warnings")}
    return results.filter("success").select(*[F.coalesce(have.get(c, F.lit(None).cast("string")), F.lit("")).alias(c) for c in fv.CSV_COLUMNS])


def write_results_csv(results: DataFrame, path: str) -> None:
    csv_frame(results).write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def flat_frame(enhanced: DataFrame) -> DataFrame:
    """Nested results flattened: confidence_*, quality_*, and field_* for each known field."""
    from semtflow.operators.quality import PARTS

    return enhanced.select(
        F.col("original_address"), F.col("normalized_address"),
        *[F.col(f"confidence.{c}").alias(f"confidence_{c}") for c in ("overall", "pattern", "ml")],
        *[F.col(f"quality.{c}").alias(f"quality_{c}") for c in ("overall", "completeness", "consistency")],
        "processing_method", "validation_status",
        *[F.coalesce(F.element_at("extracted_fields", p), F.lit("")).alias(f"field_{p}") for p in PARTS])


def write_enhanced_flat(enhanced: DataFrame, path: str, fmt: str = "csv") -> None:
    flat = flat_frame(enhanced)
    flat.select(*sorted(flat.columns)).write.mode("overwrite").option("header", True).option("sep", "\t" if fmt == "tsv" else ",").option("escape", '"').csv(path)


def write_results_xml(results: DataFrame, path: str) -> None:
    """One ``result`` element per row, nested values as child elements."""
    results.write.mode("overwrite").format("xml").option("rowTag", "result").option("rootTag", "results").save(path)


def export_frame(results: DataFrame) -> DataFrame:
    return results.select(
        F.col("raw_input").alias("input_address"), F.coalesce("normalized_address", F.lit("")).alias("normalized_address"), "confidence", F.col("method").alias("method_used"),
        F.to_json("fields").alias("components"), F.coalesce(F.array_join("warnings", "; "), F.lit("")).alias("warnings"))


def export_results(results: DataFrame, path: str, fmt: str = "csv") -> None:
    out = export_frame(results)
    if fmt == "xml":
        write_results_xml(out, path)
    elif fmt == "json":
        out.write.mode("overwrite").json(path)
    else:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def legacy_projection(df: DataFrame, fields: list[str]) -> DataFrame:
    """All-text record with its confidence."""
    return df.select("addr_id", *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f) for f in fields], F.round("confidence", 6).cast("string").alias("confidence"))


def compact_projection(df: DataFrame) -> DataFrame:
    return df.select("addr_id", "success", "address", F.round("confidence", 3).alias("confidence"), F.round("quality", 3).alias("quality"))


def write_ner_jsonl(df: DataFrame, path: str) -> None:
    """Labelled rows as JSON lines of text and [start, end, label] triples."""
    triple = lambda s: F.array(s["start"].cast("string"), s["end"].cast("string"), s["label"])
    df.select("text", F.transform("spans", triple).alias("entities")).write.mode("overwrite").json(path)


def write_metric_snapshot(metrics: DataFrame, path: str, date: str) -> None:
    """Append a dated snapshot; re-running a date replaces that date only."""
    metrics.write.mode("overwrite").parquet(f"{path}/snapshot_date={date}")


def read_snapshots(spark: SparkSession, path: str, asof: str, days: int = 30) -> DataFrame:
    """Snapshots within retention; the date filter prunes partitions."""
    return spark.read.parquet(path).filter(F.col("snapshot_date") > F.date_sub(F.lit(asof).cast("date"), days))


def export_events(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events of a time range, ready for a writer."""
    return events.filter(F.col("ts").between(start, end))
