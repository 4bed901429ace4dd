"""Queries of the confidence and quality section (I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.operators import contract
from semtflow.operators import quality as q
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import addresses

INPUT = [
    "addr_id", "address AS text",  # every 101st row has no component, every 9th padded ones, every 100th an overall confidence of 0
    "CASE WHEN addr_id % 101 = 0 THEN NULL WHEN addr_id % 9 = 0 THEN ' ' || city_in || ' ' WHEN addr_id % 17 = 0 THEN 'ankara' WHEN addr_id % 6 = 0 THEN NULL ELSE city_in END AS il", "CASE WHEN addr_id % 101 = 0 THEN NULL WHEN addr_id % 5 = 0 THEN '' ELSE district_in END AS ilce",
    "CASE WHEN addr_id % 4 = 0 OR addr_id % 101 = 0 THEN NULL ELSE nbh END AS mahalle", "CASE WHEN addr_id % 101 = 0 THEN NULL WHEN addr_id % 7 = 0 THEN '  ' ELSE street END AS sokak",
    "CASE WHEN addr_id % 101 = 0 THEN NULL WHEN addr_id % 9 = 0 THEN ' ' || number || ' ' WHEN addr_id % 3 = 0 THEN CAST(number AS STRING) WHEN addr_id % 3 = 1 THEN number || 'x' END AS bina_no", "CASE WHEN addr_id % 2 = 0 AND addr_id % 101 <> 0 THEN '5' END AS daire_no",
    "CASE WHEN addr_id % 101 = 0 THEN NULL WHEN addr_id % 9 = 0 THEN ' 34710 ' WHEN addr_id % 8 = 0 THEN '123' ELSE postcode_in END AS posta_kodu",
    "CASE CASE WHEN addr_id % 100 = 0 THEN 5 ELSE addr_id % 6 END WHEN 0 THEN 'pattern_primary' WHEN 1 THEN 'pattern_secondary' WHEN 2 THEN 'ml_primary' WHEN 3 THEN 'ml_secondary' WHEN 4 THEN 'hybrid' ELSE 'fallback' END AS method",
    *[f"CAST(addr_id * {m} % 100 AS DOUBLE) / 100 AS {n}" for n, m in (
        ("match_score", 37), ("pattern_quality", 53), ("coverage_in", 29), ("specificity", 71), ("model_score", 41), ("entropy", 61), ("feature_quality", 83), ("similarity", 97))],
]


class Duck:
    low = staticmethod(lambda x: f"lower(replace({x}, 'İ', 'i̇'))")
    like = staticmethod(lambda x, p: f"regexp_matches({x}, '{p}')")
    words = staticmethod(lambda x: f"list_distinct(list_filter(string_split(lower(replace({x}, 'İ', 'i̇')), ' '), lambda w: w <> ''))")
    n_words = staticmethod(lambda x: f"len(list_filter(string_split({x}, ' '), lambda w: w <> ''))")
    shared = staticmethod(lambda a, b: f"len(list_intersect({a}, {b}))")
    size = staticmethod(lambda a: f"len({a})")


def rows(spark, sf_dir):
    return addresses(spark, sf_dir).selectExpr(*INPUT)


def _sql(cols: list[str]) -> str:
    exprs = q._needed(q.score_columns(Duck), cols)
    inner = ", ".join(f"{q.typed(n, x)} AS {n}" for n, x in exprs.items())
    doubles = [c for c in cols if c not in q._TEXTS | q._FLAGS | q._COUNTS]
    out = ", ".join(f"round({c}, 6) AS {c}" if c in doubles else c for c in cols)
    return f"WITH {d.ADDR}, i AS (SELECT {', '.join(INPUT)} FROM addr), s AS (SELECT *, {inner} FROM i) SELECT addr_id, {out} FROM s"


def _register(name: str, cols: list[str]) -> None:
    @query(name, _sql(cols))
    def run(spark, sf_dir, cols=cols):
        return rounded(q.score(rows(spark, sf_dir), cols).select("addr_id", *cols))


for _name, _cols in {
    "i01_pattern_confidence": ["pattern_conf"],
    "i02_ml_confidence_overall": ["ml_conf"],
    "i03_enhanced_confidence": ["enhanced_conf"],
    "i04_completeness_bonus": ["completeness_bonus"],
    "i05_consistency_modifier": ["consistency_modifier", "n_found"],
    "i06_overall_confidence": ["overall_conf", "primary_conf", "secondary_conf"],
    "i07_confidence_level": ["conf_level", "acceptable"],
    "i08_enhanced_completeness": ["enhanced_completeness"],
    "i09_enhanced_consistency": ["enhanced_consistency"],
    "i10_accuracy_estimate": ["accuracy_estimate"],
    "i11_coverage_score": ["coverage"],
    "i12_completeness_block": ["required_filled", "optional_filled", "critical_missing", "completeness", "geographic_completeness", "semantic_completeness"],
    "i13_format_consistency": ["format_consistency"],
    "i14_geo_consistency": ["geo_pairs", "geo_consistency"],
    "i15_semantic_consistency": ["semantic_consistency"],
    "i16_consistency_block": ["consistency", "consistency_errors"],
    "i17_accuracy_block": ["extraction_accuracy", "geo_accuracy", "format_accuracy", "accuracy"],
    "i18_usability_block": ["readability", "delivery_completeness", "usability"],
    "i19_assess_quality": ["quality", "quality_level", "issues", "recommendations"],
    "i20_validation_status": ["validation_status"],
    "i21_simple_enhanced_output": ["simple_confidence", "simple_completeness", "simple_consistency"],
    "i23_output_errors": ["output_errors", "output_warnings"],
}.items():
    _register(_name, _cols)


@query("i22_enhanced_result")
def i22(spark, sf_dir):
    out = q.enhanced_result(rows(spark, sf_dir))
    return out.select("addr_id", "normalized_address", F.to_json("extracted_fields").alias("fields"), F.to_json("confidence").alias("confidence"),
                      F.to_json("quality").alias("quality"), "processing_method", "validation_status")


CONTRACT = [
    "CASE WHEN addr_id % 9 = 0 THEN 'Turkey' ELSE 'TR' END AS country", "city_in AS city", "CASE WHEN addr_id % 11 = 0 THEN '' ELSE district_in END AS district",
    "repeat(nbh, CASE WHEN addr_id % 13 = 0 THEN 30 ELSE 1 END) AS neighborhood", "CASE WHEN addr_id % 4 = 0 THEN 'A 1' ELSE 'A' END AS block", "number || '/2' AS number",
    "CASE WHEN addr_id % 7 = 0 THEN 'zemin' ELSE '-1' END AS floor", "CASE WHEN addr_id % 5 = 0 THEN '1234' ELSE postcode_in END AS postcode",
    "CASE WHEN addr_id % 3 = 0 THEN 'karsisi' WHEN addr_id % 3 = 1 THEN 'uzak' END AS relation", "CASE WHEN addr_id % 10 = 0 THEN 'magic' ELSE 'ml' END AS method",
    "CAST(addr_id % 12 AS DOUBLE) / 10 AS confidence", "address AS explanation_raw", "CASE WHEN addr_id % 19 = 0 THEN '' ELSE address END AS normalized_address",
]
_VIOLATED = (
    [f"SELECT '{f}' AS field FROM k WHERE length({f}) NOT BETWEEN 1 AND {n}" for f, n in contract.LENGTHS.items() if f in ("city", "district", "neighborhood")]
    + [f"SELECT '{f}' FROM k WHERE NOT regexp_matches({f}, '{p}')" for f, p in contract.SHAPES.items() if f in ("country", "block", "number", "floor", "postcode")]
    + ["SELECT 'relation' FROM k WHERE relation NOT IN ('karsisi', 'yani', 'arkasi', 'ustu', 'alti', 'ici', 'yaninda')",
       "SELECT 'method' FROM k WHERE method NOT IN ('ml', 'pattern', 'fallback')", "SELECT 'confidence' FROM k WHERE confidence NOT BETWEEN 0 AND 1",
       "SELECT 'normalized_address' FROM k WHERE normalized_address = ''"])


@query(
    "i24_contract_check",
    f"WITH {d.ADDR}, k AS (SELECT {', '.join(CONTRACT)} FROM addr), v AS ({' UNION ALL '.join(_VIOLATED)}) SELECT field, count(*) AS n_violations FROM v GROUP BY 1",
)
def i24(spark, sf_dir):
    return contract.contract_check(addresses(spark, sf_dir).selectExpr(*CONTRACT))


_ST = "CASE addr_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN 'failed' WHEN 2 THEN 'warning' ELSE 'success' END AS status"


@query(
    "i25_status_rollup",
    f"WITH {d.ADDR}, s AS (SELECT {_ST} FROM addr) SELECT status, count(*) AS n, count(*) FILTER (status IN ('success', 'partial')) AS n_success FROM s GROUP BY 1",
)
def i25(spark, sf_dir):
    return q.status_rollup(addresses(spark, sf_dir).selectExpr(_ST))
