"""File sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.functions.text import strip

METRIC_EVENT = (
    "timestamp timestamp, metric_type string, method string, pattern_id string, success boolean, confidence double, "
    "processing_time_ms double, address_length int, components_extracted int, error_type string, metadata map<string,string>"
)


def read_address_lines(spark: SparkSession, path: str) -> DataFrame:
    """One address per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("address")).filter(F.length("address") > 0)


def read_address_csv(spark: SparkSession, path: str, col: str = "address", max_samples: int | None = None) -> DataFrame:
    """The address column of a CSV with header (its first column where the name is absent), blank rows dropped."""
    raw = spark.read.option("header", True).option("escape", '"').option("multiLine", True).csv(path)
    name = col if col in raw.columns else raw.columns[0]
    out = raw.select(strip(F.col(name)).alias("address")).filter(F.length("address") > 0)
    return out if max_samples is None else out.limit(max_samples)


def read_ner_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Labelled rows: text and an array of (start, end, label)."""
    raw = spark.read.schema("text string, entities array<array<string>>").json(path)
    span = lambda e: F.struct(e[0].cast("int").alias("start"), e[1].cast("int").alias("end"), e[2].alias("label"))
    return raw.select("text", F.transform("entities", span).alias("spans"))


def read_metric_events(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The 11-field event record from JSON lines, as a table or a stream."""
    return (spark.readStream if stream else spark.read).schema(METRIC_EVENT).json(path)
