"""Queries of the geographic validation section (E) and its dimensions (A4-A6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.operators import geo as g
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources import dims as dm
from semtflow.sources.derived import DISTRICT_PAIRS, addresses


def district_dim(spark):
    """The districts of the derived addresses; a real run reads the full list from a file."""
    return spark.createDataFrame(DISTRICT_PAIRS, "city string, district string")


def dims(spark):
    return g.load_dims(g.province_dim(spark), district_dim(spark))


def named(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", "city_in", "district_in", "postcode_in", "city", "district")


@query("a04_city_dim", f"WITH {d.ADDR} SELECT DISTINCT {d.fold('city')} AS city FROM addr")
def a04(spark, sf_dir):
    return dm.city_dim(named(spark, sf_dir).select(F.col("city").alias("name")))


@query(
    "a05_district_dim",
    f"""WITH {d.ADDR}, p AS (SELECT DISTINCT {d.fold('city')} AS city, {d.fold('district_in')} AS district FROM addr)
        SELECT city, string_agg(district, ',' ORDER BY district) AS districts FROM p GROUP BY 1""",
)
def a05(spark, sf_dir):
    pairs = dm.district_dim(named(spark, sf_dir).select(F.col("city").alias("il"), F.col("district_in").alias("ilce")))
    return dm.district_lists(pairs).select("city", F.array_join("districts", ",").alias("districts"))


@query(
    "a06_geo_dim_check",
    f"""WITH {d.ADDR}, p AS (SELECT DISTINCT {d.fold('city')} AS city, {d.fold('district_in')} AS district FROM addr)
        SELECT count(DISTINCT city) AS n_cities, count(*) AS n_pairs, count(DISTINCT district) AS n_districts, count(DISTINCT city) AS n_cities_with_districts,
          (SELECT count(*) FROM (VALUES ('istanbul'), ('ankara'), ('izmir'), ('bursa'), ('antalya')) m(c) WHERE c NOT IN (SELECT city FROM p)) AS n_major_missing,
          count(DISTINCT city) = 81 AS count_ok, round(count(DISTINCT district)::DOUBLE / count(DISTINCT city), 6) AS avg_districts_per_city FROM p""",
)
def a06(spark, sf_dir):
    n = named(spark, sf_dir)
    cities = dm.city_dim(n.select(F.col("city").alias("name")))
    pairs = dm.district_dim(n.select(F.col("city").alias("il"), F.col("district_in").alias("ilce")))
    return rounded(g.geo_dim_check(cities, pairs))


BASE = f"{d.ADDR}, {d.CITIES}, {d.DISTRICTS}, f AS (SELECT *, {d.fold('city_in')} AS fc, {d.fold('district_in')} AS fd FROM addr)"


@query(
    "e01_city_exact",
    f"WITH {BASE} SELECT addr_id, cdim.city AS std_city, CASE WHEN cdim.city IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS city_confidence FROM f LEFT JOIN cdim ON fc = cdim.city",
)
def e01(spark, sf_dir):
    return g.city_exact(named(spark, sf_dir), g.province_dim(spark)).select("addr_id", "std_city", "city_confidence")


def _flat(df, v: str):
    return rounded(df.select("addr_id", f"{v}.is_valid", f"{v}.value", f"{v}.confidence", F.array_join(f"{v}.suggestions", ",").alias("suggestions"),
                             F.array_join(f"{v}.warnings", "; ").alias("warnings")))


@query("e02_city_fuzzy")
def e02(spark, sf_dir):
    return _flat(g.validate_city(named(spark, sf_dir), "city_in", dims(spark)), "city_v")


@query(
    "e03_district_exact_in_city",
    f"""WITH {BASE} SELECT addr_id, ddim.city AS std_city, ddim.district AS std_district FROM f LEFT JOIN ddim ON fc = ddim.city AND fd = ddim.district""",
)
def e03(spark, sf_dir):
    return g.district_exact_in_city(named(spark, sf_dir), district_dim(spark)).select("addr_id", "std_city", "std_district")


@query("e04_district_fuzzy_in_city")
def e04(spark, sf_dir):
    """Districts with the last letter lost, in their true city."""
    cut = named(spark, sf_dir).withColumn("cut", F.expr("substr(district, 1, length(district) - 1)"))
    return _flat(g.validate_district(cut, "cut", dims(spark), "city"), "district_v")


@query(
    "e05_district_exact_global",
    f"""WITH {BASE}, n AS (SELECT DISTINCT district FROM ddim), h AS (SELECT addr_id, fd, CASE WHEN addr_id % 6 = 0 THEN '' ELSE city_in END AS c FROM f)
        SELECT addr_id, n.district AS std_district, CASE WHEN n.district IS NOT NULL AND c = '' THEN 'District found but city context unclear' END AS warning
        FROM h LEFT JOIN n ON fd = n.district""",
)
def e05(spark, sf_dir):
    some = named(spark, sf_dir).withColumn("city_in", F.when(F.col("addr_id") % 6 == 0, "").otherwise(F.col("city_in")))
    return g.district_exact_global(some, district_dim(spark)).select("addr_id", "std_district", "warning")


@query("e06_district_fuzzy_global")
def e06(spark, sf_dir):
    cut = named(spark, sf_dir).withColumn("cut", F.expr("substr(district_in, 2)"))
    return _flat(g.validate_district(cut, "cut", dims(spark)), "district_v")


@query("e07_validate_district")
def e07(spark, sf_dir):
    return _flat(g.validate_district(named(spark, sf_dir), "district_in", dims(spark), "city_in"), "district_v")


STATUS = """CASE WHEN p.city IS NOT NULL THEN 'consistent' WHEN fc IN (SELECT city FROM ddim) THEN 'inconsistent' ELSE 'unable to verify' END"""


def folded(spark, sf_dir):
    return named(spark, sf_dir).select("addr_id", t.ascii_fold(F.col("city_in")).alias("city"), t.ascii_fold(F.col("district_in")).alias("district"))


@query("e08_city_district_consistency", f"WITH {BASE} SELECT addr_id, {STATUS} AS status FROM f LEFT JOIN ddim p ON fc = p.city AND fd = p.district")
def e08(spark, sf_dir):
    return g.city_district_consistency(folded(spark, sf_dir), district_dim(spark)).select("addr_id", "status")


@query(
    "e09_alternative_cities",
    f"""WITH {BASE}, s AS (SELECT addr_id, fd, {STATUS} AS status FROM f LEFT JOIN ddim p ON fc = p.city AND fd = p.district)
        SELECT addr_id, fd AS district, (SELECT string_agg(city, ',' ORDER BY city) FROM ddim WHERE ddim.district = fd) AS alternatives FROM s WHERE status = 'inconsistent'""",
)
def e09(spark, sf_dir):
    bad = g.city_district_consistency(folded(spark, sf_dir), district_dim(spark)).filter(F.col("status") == "inconsistent")
    return g.alternative_cities(bad, district_dim(spark)).select("addr_id", "district", F.array_join("alternatives", ",").alias("alternatives"))


_PC = """CASE addr_id % 7 WHEN 0 THEN '0' || CAST(addr_id % 9000 AS VARCHAR(20)) WHEN 1 THEN ' 34-' || CAST(100 + addr_id % 900 AS VARCHAR(20))
   WHEN 2 THEN CAST(82000 + addr_id % 500 AS VARCHAR(20)) WHEN 3 THEN '' ELSE postcode_in END"""


@query(
    "e10_validate_postcode",
    f"""WITH {d.ADDR}, p AS (SELECT addr_id, {_PC} AS raw FROM addr), g AS (SELECT *, regexp_replace(coalesce(raw, ''), '[^0-9]', '', 'g') AS dg FROM p),
        n AS (SELECT *, CASE WHEN raw IS NULL OR trim(raw) = '' THEN 'Empty postal code' WHEN length(dg) <> 5 THEN 'Postal code must be 5 digits, got ' || length(dg)
          WHEN CAST(dg AS INTEGER) NOT BETWEEN 1000 AND 81999 THEN 'Postal code ' || dg || ' out of valid range (01000-81999)' END AS note FROM g)
        SELECT addr_id, note IS NULL AS is_valid, CASE WHEN note IS NULL THEN dg END AS value, coalesce(note, '') AS warning FROM n""",
)
def e10(spark, sf_dir):
    p = addresses(spark, sf_dir).selectExpr("addr_id", f"{_PC} AS raw").withColumn("v", g.validate_postcode(F.col("raw")))
    return p.select("addr_id", "v.is_valid", "v.value", F.array_join("v.warnings", "; ").alias("warning"))


@query("e11_apply_geo_validation")
def e11(spark, sf_dir):
    f = named(spark, sf_dir).select("addr_id", F.struct(F.col("city_in").alias("city"), F.col("district_in").alias("district"), F.col("postcode_in").alias("postcode")).alias("fields"),
                                    F.array().cast("array<string>").alias("warnings"))
    out = g.apply_geo_validation(f, dims(spark))
    return out.select("addr_id", "fields.*", F.array_join("warnings", "; ").alias("warnings"))


@query(
    "e12_ambiguous_districts",
    f"""WITH {BASE}, p AS (SELECT DISTINCT {d.fold('city')} AS c, fd FROM f)
        SELECT fd AS district, count(DISTINCT c) AS n_cities FROM p GROUP BY 1 HAVING count(DISTINCT c) > 1""",
)
def e12(spark, sf_dir):
    pairs = dm.district_dim(named(spark, sf_dir).select(F.col("city").alias("il"), F.col("district_in").alias("ilce")))
    return g.ambiguous_districts(pairs)


@query(
    "e13_lev_city_match",
    f"""WITH {BASE}, v AS (SELECT DISTINCT fc FROM f), s AS (SELECT fc, city, round(1 - levenshtein(fc, city)::DOUBLE / greatest(length(fc), length(city)), 9) AS s FROM v, cdim),
        r AS (SELECT *, row_number() OVER (PARTITION BY fc ORDER BY s DESC, city DESC) AS i FROM s WHERE s >= 0.6),
        b AS (SELECT fc, max(CASE WHEN i = 1 THEN city END) AS best, max(s) AS sim, string_agg(city, ',' ORDER BY i) AS names FROM r WHERE i <= 5 GROUP BY 1)
        SELECT addr_id, best, round(sim, 6) AS similarity, CASE WHEN sim = 1 THEN 'exact' WHEN sim >= 0.8 THEN 'corrected' WHEN sim IS NOT NULL THEN 'suggested' ELSE 'unknown' END AS band,
               coalesce(names, '') AS names FROM f LEFT JOIN b USING (fc)""",
)
def e13(spark, sf_dir):
    n = folded(spark, sf_dir).withColumn("city", F.trim("city"))
    n = n.select("addr_id", F.explode(F.array(g.lev_city_match(F.col("city"), fv.PROVINCES))).alias("m"))
    best = F.get(F.col("m"), F.lit(0))
    s = best["s"]
    return n.select(
        "addr_id", best["name"].alias("best"), F.round(s, 6).alias("similarity"),
        F.when(s == 1, "exact").when(s >= 0.8, "corrected").when(s.isNotNull(), "suggested").otherwise("unknown").alias("band"),
        F.array_join(F.transform("m", lambda x: x["name"]), ",").alias("names"))
