"""Dimensions: cities, districts and abbreviations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t


def city_dim(raw: DataFrame, col: str = "name") -> DataFrame:
    """Distinct folded province names of a raw list, sorted."""
    return raw.select(t.ascii_fold(F.col(col)).alias("city")).filter(F.col("city") != "").distinct().orderBy("city")


def read_city_csv(spark: SparkSession, path: str) -> DataFrame:
    return city_dim(spark.read.csv(path, header=True, schema="name string"))


def district_dim(raw: DataFrame, city: str = "il", district: str = "ilce") -> DataFrame:
    """Distinct folded (city, district) pairs of a raw list."""
    pairs = raw.select(t.ascii_fold(F.col(city)).alias("city"), t.ascii_fold(F.col(district)).alias("district"))
    return pairs.filter((F.col("city") != "") & (F.col("district") != "")).distinct()


def read_district_json(spark: SparkSession, path: str) -> DataFrame:
    """The JSON form, one object of city to district list, as pairs."""
    text = spark.read.text(path, wholetext=True)
    lists = text.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("city", "districts"))
    return lists.select("city", F.explode("districts").alias("district"))


def district_lists(pairs: DataFrame) -> DataFrame:
    """Back to one sorted list per city (a city has at most some dozens of districts)."""
    return pairs.groupBy("city").agg(F.sort_array(F.collect_set("district")).alias("districts"))


def abbreviation_dim(spark: SparkSession, mapping: dict | None = None) -> DataFrame:
    """Abbreviation rows, longest first, entries that are not text left out."""
    mapping = fv.ABBREVIATIONS if mapping is None else mapping
    rows = [(k, str(v)) for k, v in mapping.items() if isinstance(k, str) and v is not None]
    return spark.createDataFrame(rows, "abbrev string, full string").orderBy(F.length("abbrev").desc(), "abbrev")
