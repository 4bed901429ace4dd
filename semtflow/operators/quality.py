"""Confidence and quality of address rows (I).

A row carries il, ilce, mahalle, sokak, bina_no, daire_no, posta_kodu, text,
method and the raw scores. Every score is a scalar SQL expression over the row;
``score_columns`` lists them in order, each may name the ones before it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv

PARTS = ["il", "ilce", "mahalle", "sokak", "bina_no", "daire_no", "posta_kodu"]
CORE, EXTRA = ["il", "ilce", "mahalle", "sokak"], ["bina_no", "daire_no", "posta_kodu", "yol"]


class Spark:
    """How the few engine-bound functions are written in Spark SQL."""

    low = staticmethod(lambda x: f"lower({x})")
    like = staticmethod(lambda x, p: f"regexp_like({x}, '{p}')")
    words = staticmethod(lambda x: f"array_distinct(filter(split(lower({x}), ' '), w -> w <> ''))")
    n_words = staticmethod(lambda x: f"size(filter(split({x}, ' '), w -> w <> ''))")
    shared = staticmethod(lambda a, b: f"size(array_intersect({a}, {b}))")
    size = staticmethod(lambda a: f"size({a})")


def _filled(x: str) -> str:
    return f"(CASE WHEN coalesce(trim({x}), '') <> '' THEN 1 ELSE 0 END)"


def _some(x: str) -> str:
    return f"coalesce({x}, '') <> ''"


def _mean(terms: list[tuple[str, str]], default: str) -> str:
    """Mean of the values whose condition holds."""
    n = " + ".join(f"(CASE WHEN {c} THEN 1 ELSE 0 END)" for c, _ in terms)
    s = " + ".join(f"(CASE WHEN {c} THEN {v} ELSE 0.0 END)" for c, v in terms)
    return f"(CASE WHEN ({n}) > 0 THEN ({s}) / ({n}) ELSE {default} END)"


def score_columns(e=Spark) -> dict[str, str]:
    """Name to expression, all constants as doubles."""
    return {n: re.sub(r"(?<![\w'])(\d+\.\d+)(?![\d'E])", r"\1E0", x) for n, x in _score_columns(e).items()}


def _score_columns(e) -> dict[str, str]:
    known = f"{e.low('il')} IN ({', '.join(repr(p) for p in fv.QUALITY_PROVINCES)})"
    zip_ok, no_ok = e.like("posta_kodu", "^[0-9]{5}$"), e.like("bina_no", "^[0-9]+[A-Z]*$")
    # completeness and consistency look at trimmed values
    known_t = f"{e.low('trim(il)')} IN ({', '.join(repr(p) for p in fv.QUALITY_PROVINCES)})"
    zip_t, no_t, digits_t = e.like("trim(posta_kodu)", "^[0-9]{5}$"), e.like("trim(bina_no)", "^[0-9]+[A-Z]*$"), e.like("trim(bina_no)", "^[0-9]+$")
    none = " AND ".join(f"{c} IS NULL" for c in PARTS)
    major = ["il", "ilce", "mahalle"]
    n_major = " + ".join(f"(CASE WHEN length(coalesce({c}, '')) > 2 THEN 1 ELSE 0 END)" for c in major)
    n_found = " + ".join(f"(CASE WHEN length(coalesce({c}, '')) > 2 AND instr({e.low('text')}, {e.low(c)}) > 0 THEN 1 ELSE 0 END)" for c in major)
    weight = lambda w: " + ".join(f"{v} * (CASE WHEN {c} IS NOT NULL THEN 1 ELSE 0 END)" for c, v in w.items())
    got = lambda w: " + ".join(f"{v} * {_filled(c)}" for c, v in w.items())
    part = {c: "1.0" for c in PARTS} | {"posta_kodu": f"(CASE WHEN {zip_t} THEN 1.0 ELSE 0.5 END)", "bina_no": f"(CASE WHEN {no_t} THEN 1.0 ELSE 0.7 END)"}
    earned = " + ".join(f"(CASE WHEN {_filled(c)} = 1 THEN {w} * {part[c]} ELSE 0.0 END)" for c, w in fv.COMPLETE_WEIGHTS.items())
    proper = e.like("{}", r"^[A-ZÇĞIİÖŞÜa-zçğıiöşü .-]+$")
    texty = _mean([(f"{_filled(c)} = 1", f"(CASE WHEN {proper.format(c)} THEN 1.0 ELSE 0.0 END)") for c in CORE], "-1.0")
    plausible = {
        "il": f"(CASE WHEN {known} THEN 1.0 ELSE 0.6 END)", "posta_kodu": f"(CASE WHEN {zip_ok} THEN 1.0 ELSE 0.3 END)",
        "bina_no": f"(CASE WHEN {no_ok} THEN 1.0 ELSE 0.5 END)"}
    plaus = [(f"{_filled(c)} = 1", plausible.get(c, "0.8")) for c in PARTS]
    readable = lambda c: (
        f"((CASE WHEN (upper({c}) = {c} OR lower({c}) = {c}) AND upper({c}) <> lower({c}) THEN 0 ELSE 1 END) + (CASE WHEN {e.like(c, '[@#$%]')} THEN 0 ELSE 1 END)"
        f" + (CASE WHEN length({c}) BETWEEN 1 AND 100 THEN 1 ELSE 0 END)) / 3.0")
    joined = "concat_ws(' ', " + ", ".join(f"CASE WHEN {_some(c)} THEN {c} END" for c in PARTS) + ")"
    main = lambda a, b: f"CASE WHEN {a} > 0 THEN (CASE WHEN {b} > 0.5 THEN least(1.0, {a} + ({b} - 0.5) * 0.2) ELSE {a} END) ELSE {b} * 0.7 END"
    cov = " ".join(f"WHEN '{k}' THEN {v}" for k, v in fv.COVERAGE_BASE.items())
    missing = ", ".join(f"CASE WHEN {_filled(c)} = 0 THEN 'Missing required field: {c}' END" for c in CORE)
    return {
        "pattern_conf": "greatest(0.0, least(1.0, 0.4 * match_score + 0.3 * pattern_quality + 0.2 * coverage_in + 0.1 * specificity))",
        "ml_conf": "greatest(0.0, least(1.0, 0.4 * model_score + 0.25 * (1 - entropy) + 0.2 * feature_quality + 0.15 * similarity))",
        "completeness_bonus": f"(CASE WHEN ({weight(fv.BONUS_WEIGHTS)}) > 0 THEN 0.1 * ({got(fv.BONUS_WEIGHTS)}) / ({weight(fv.BONUS_WEIGHTS)}) ELSE 0.0 END)",
        "n_major": n_major, "n_found": n_found,
        "consistency_modifier": f"(CASE WHEN {_some('il')} AND {_some('ilce')} THEN 0.02 ELSE 0.0 END) + (CASE WHEN {_some('ilce')} AND {_some('mahalle')} THEN 0.02 ELSE 0.0 END)"
        " - (CASE WHEN n_major > 0 AND n_found = 0 THEN 0.05 WHEN n_major > 0 AND n_found < 0.5 * n_major THEN 0.03 ELSE 0.0 END)",
        "base_conf": f"CASE WHEN method LIKE 'pattern%' THEN ({main('pattern_conf', 'ml_conf')}) WHEN method LIKE 'ml%' THEN ({main('ml_conf', 'pattern_conf')})"
        " WHEN method = 'hybrid' THEN pattern_conf * 0.6 + ml_conf * 0.4 ELSE greatest(pattern_conf, ml_conf) * 0.5 END",
        "enhanced_conf": "greatest(0.0, least(1.0, least(1.0, base_conf + completeness_bonus) + consistency_modifier))",
        "overall_conf": "CASE method WHEN 'pattern_primary' THEN 0.8 * pattern_conf + 0.2 * ml_conf WHEN 'ml_primary' THEN 0.2 * pattern_conf + 0.8 * ml_conf"
        " WHEN 'hybrid' THEN 0.6 * pattern_conf + 0.4 * ml_conf"
        " ELSE greatest(0.0, 0.6 * pattern_conf + 0.4 * ml_conf - (CASE WHEN method LIKE '%secondary' THEN 0.1 ELSE 0.2 END)) END",
        "primary_conf": "CASE WHEN method LIKE 'pattern%' THEN pattern_conf WHEN method LIKE 'ml%' THEN ml_conf ELSE greatest(pattern_conf, ml_conf) END",
        "secondary_conf": "CASE WHEN method LIKE 'pattern%' THEN (CASE WHEN ml_conf > 0 THEN ml_conf END) WHEN method LIKE 'ml%' THEN (CASE WHEN pattern_conf > 0 THEN pattern_conf END) ELSE least(pattern_conf, ml_conf) END",
        "conf_level": "CASE WHEN overall_conf >= 0.9 THEN 'very_high' WHEN overall_conf >= 0.75 THEN 'high' WHEN overall_conf >= 0.6 THEN 'medium' WHEN overall_conf >= 0.4 THEN 'low' ELSE 'very_low' END",
        "acceptable": "overall_conf >= 0.3",
        "enhanced_completeness": f"(CASE WHEN ({weight(fv.COMPLETE_WEIGHTS)}) > 0 THEN ({earned}) / ({weight(fv.COMPLETE_WEIGHTS)}) ELSE 0.0 END)",
        "texty": texty,
        "n_checks": f"1 + (CASE WHEN {_filled('il')} + {_filled('ilce')} = 2 THEN 1 ELSE 0 END) + (CASE WHEN {_filled('ilce')} + {_filled('mahalle')} = 2 THEN 1 ELSE 0 END)"
        f" + (CASE WHEN {_some('posta_kodu')} THEN 1 ELSE 0 END) + (CASE WHEN {_some('bina_no')} THEN 1 ELSE 0 END) + (CASE WHEN n_major > 0 THEN 1 ELSE 0 END)",
        "enhanced_consistency": f"CASE WHEN {none} THEN 0.0 ELSE ((CASE WHEN {_filled('il')} + {_filled('ilce')} = 2 THEN (CASE WHEN {known_t} THEN 0.3 ELSE 0.1 END) ELSE 0.0 END)"
        f" + (CASE WHEN {_filled('ilce')} + {_filled('mahalle')} = 2 THEN 0.2 ELSE 0.0 END)"
        f" + (CASE WHEN {_some('posta_kodu')} THEN (CASE WHEN {zip_t} THEN 0.15 ELSE 0.05 END) ELSE 0.0 END)"
        f" + (CASE WHEN {_some('bina_no')} THEN (CASE WHEN {digits_t} THEN 0.1 ELSE 0.05 END) ELSE 0.0 END)"
        " + (CASE WHEN n_major > 0 THEN 0.25 * n_found / n_major ELSE 0.0 END) + (CASE WHEN texty >= 0 THEN texty * 0.2 ELSE 0.1 END)) / n_checks END",
        "accuracy_estimate": "least(1.0, (CASE WHEN overall_conf > 0 THEN overall_conf WHEN pattern_conf > 0 AND ml_conf > 0 THEN (pattern_conf + ml_conf) / 2"
        " ELSE greatest(pattern_conf, ml_conf) END) * 0.60 + enhanced_completeness * 0.25 + enhanced_consistency * 0.15)",
        "n_parts": " + ".join(_filled(c) for c in PARTS),
        "coverage": f"(CASE method {cov} ELSE 0.5 END) * (CASE WHEN n_parts >= 4 THEN 1.0 WHEN n_parts >= 2 THEN 0.8 WHEN n_parts >= 1 THEN 0.6 ELSE 0.2 END)",
        "required_filled": "(" + " + ".join(_filled(c) for c in CORE) + ") / 4.0",
        "optional_filled": "(" + " + ".join(_filled(c) for c in EXTRA if c != "yol") + ") / 4.0",
        "critical_missing": "concat_ws(',', " + ", ".join(f"CASE WHEN {_filled(c)} = 0 THEN '{c}' END" for c in CORE) + ")",
        "completeness": "0.8 * required_filled + 0.2 * optional_filled",
        "geographic_completeness": "(" + " + ".join(f"(CASE WHEN {_some(c)} THEN 1 ELSE 0 END)" for c in major) + ") / 3.0",
        "semantic_completeness": f"((CASE WHEN {_some('il')} OR {_some('ilce')} THEN 1 ELSE 0 END) + (CASE WHEN {_some('sokak')} THEN 1 ELSE 0 END) + (CASE WHEN {_some('bina_no')} THEN 1 ELSE 0 END)) / 3.0",
        "format_consistency": _mean([(_some("posta_kodu"), f"(CASE WHEN {zip_ok} THEN 1.0 ELSE 0.0 END)"), (_some("bina_no"), f"(CASE WHEN {no_ok} THEN 1.0 ELSE 0.5 END)"), (_some("il"), f"(CASE WHEN {known} THEN 1.0 ELSE 0.7 END)")], "0.8"),
        "geo_pairs": _mean([(f"{_some('il')} AND {_some('ilce')}", "0.8"), (f"{_some('posta_kodu')} AND {_some('il')}", "0.8")], "0.7"),
        "geo_consistency": f"(1 + (CASE WHEN {_some('il')} AND {_some('ilce')} AND geo_pairs < 0.7 THEN 0 ELSE 1 END) + (CASE WHEN {_some('posta_kodu')} AND geo_pairs < 0.8 THEN 0 ELSE 1 END)) / 3.0",
        "joined": joined,
        "semantic_consistency": f"(CASE WHEN {e.size(e.words('text'))} > 0 AND {e.size(e.words('joined'))} > 0 THEN 0.4 + 0.5 * {e.shared(e.words('text'), e.words('joined'))} / {e.size(e.words('text'))} ELSE 0.8 END)",
        "consistency": "0.4 * format_consistency + 0.4 * geo_consistency + 0.2 * semantic_consistency",
        "consistency_errors": "concat_ws('; ', CASE WHEN format_consistency < 0.7 THEN 'Poor format consistency' END, CASE WHEN geo_consistency < 0.7 THEN 'Geographic inconsistencies detected' END,"
        " CASE WHEN semantic_consistency < 0.7 THEN 'Semantic inconsistencies detected' END)",
        "extraction_accuracy": _mean([(f"{e.n_words('text')} > 0", f"least(1.0, 1.0 * {e.n_words('joined')} / {e.n_words('text')})"), *plaus], "0.6"),
        "geo_accuracy": f"(CASE WHEN {_some('il')} AND {known} THEN 0.9 ELSE 0.7 END)",
        "format_accuracy": _mean(plaus, "0.7"),
        "accuracy": "(extraction_accuracy + geo_accuracy + format_accuracy) / 3",
        "readability": _mean([(f"{_filled(c)} = 1", readable(c)) for c in PARTS], "0.7"),
        "delivery_completeness": f"({_filled('il')} + {_filled('ilce')} + {_filled('sokak')}) / 3.0",
        "usability": "(readability + format_consistency + delivery_completeness) / 3",
        "failed": "coalesce(trim(text), '') = '' AND n_parts = 0",
        "quality": "CASE WHEN failed THEN 0.22 ELSE 0.3 * completeness + 0.3 * consistency + 0.25 * accuracy + 0.15 * usability END",
        "quality_level": "CASE WHEN quality >= 0.9 THEN 'excellent' WHEN quality >= 0.75 THEN 'good' WHEN quality >= 0.6 THEN 'fair' WHEN quality >= 0.4 THEN 'poor' ELSE 'unacceptable' END",
        "issues": f"concat_ws('; ', {missing}, CASE WHEN {_some('posta_kodu')} AND NOT {zip_ok} THEN 'Invalid postal code format' END, CASE WHEN {_some('il')} AND NOT {known} THEN 'Unrecognized province name' END)",
        "recommendations": f"concat_ws('; ', CASE WHEN {_filled('il')} = 0 THEN 'Add province (il) information' END, CASE WHEN {_filled('ilce')} = 0 THEN 'Add district (ilçe) information' END,"
        f" CASE WHEN {_some('posta_kodu')} AND NOT {zip_ok} THEN 'Verify and correct postal code format (5 digits)' END,"
        f" CASE WHEN {_some('il')} AND NOT {known} THEN 'Verify province name spelling and capitalization' END,"
        " CASE WHEN required_filled <= 0.5 THEN 'Consider using additional data sources to complete address' END)",
        "validation_status": "CASE WHEN overall_conf >= 0.8 AND quality >= 0.8 THEN 'passed' WHEN overall_conf >= 0.6 AND quality >= 0.6 THEN 'warning' WHEN overall_conf < 0.4 OR quality < 0.4 THEN 'failed' ELSE 'warning' END",
        "simple_confidence": "CASE WHEN pattern_conf > 0 AND ml_conf > 0 THEN pattern_conf * 0.6 + ml_conf * 0.4 ELSE greatest(pattern_conf, ml_conf) END",
        "simple_completeness": "(" + " + ".join(f"(CASE WHEN {_some(c)} AND {c} <> text THEN 1 ELSE 0 END)" for c in PARTS) + ") / 8.0",
        "simple_consistency": f"least(1.0, 0.5 + (CASE WHEN {_some('il')} AND {_some('ilce')} THEN 0.3 ELSE 0.0 END) + (CASE WHEN {_some('mahalle')} THEN 0.2 ELSE 0.0 END))",
        "output_errors": "concat_ws('; ', CASE WHEN overall_conf NOT BETWEEN 0.0 AND 1.0 THEN 'Overall confidence out of range [0,1]' END, CASE WHEN completeness NOT BETWEEN 0.0 AND 1.0 THEN 'Completeness score out of range [0,1]' END)",
        "output_warnings": "concat_ws('; ', CASE WHEN overall_conf < 0.3 THEN 'Low overall confidence' END, CASE WHEN completeness < 0.5 THEN 'Low completeness score' END, CASE WHEN n_parts = 0 THEN 'No address components extracted' END)",
    }


_TEXTS = {"conf_level", "critical_missing", "consistency_errors", "quality_level", "issues", "recommendations", "validation_status", "output_errors", "output_warnings", "joined"}
_FLAGS = {"acceptable", "failed"}
_COUNTS = {"n_major", "n_found", "n_checks", "n_parts"}


def typed(name: str, expr: str) -> str:
    if name in _TEXTS | _FLAGS:
        return expr
    return f"CAST({expr} AS {'BIGINT' if name in _COUNTS else 'DOUBLE'})"


def score(df: DataFrame, wanted: list[str] | None = None) -> DataFrame:
    """Add the scores. Only the wanted ones and those they name are computed."""
    return df.selectExpr("*", *[f"{typed(n, x)} AS {n}" for n, x in _needed(score_columns(), wanted).items()])


def _needed(columns: dict[str, str], wanted: list[str] | None) -> dict[str, str]:
    if wanted is None:
        return columns
    keep: set[str] = set()
    todo = list(wanted)
    while todo:
        n = todo.pop()
        if n in columns and n not in keep:
            keep.add(n)
            todo += re.findall(r"[a-z_]+", columns[n])
    return {n: x for n, x in columns.items() if n in keep}


def enhanced_result(df: DataFrame) -> DataFrame:
    """Nested result: fields, explanation, confidence and quality blocks, method, status, alternatives."""
    s = score(df)
    fields = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in PARTS]), lambda e: e["value"].isNotNull()))
    block = lambda **kw: F.struct(*[F.round(F.col(c), 3).alias(n) for n, c in kw.items()])
    return s.select(
        "addr_id", F.col("text").alias("original_address"), F.col("joined").alias("normalized_address"), fields.alias("extracted_fields"),
        block(overall="overall_conf", pattern="pattern_conf", ml="ml_conf", primary="primary_conf", secondary="secondary_conf").alias("confidence"),
        block(overall="quality", completeness="completeness", consistency="consistency", accuracy="accuracy", usability="usability").alias("quality"),
        F.col("method").alias("processing_method"), F.col("validation_status"))


def status_rollup(df: DataFrame, col: str = "status") -> DataFrame:
    """Counts by status and how many count as success."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(col).isin("success", "partial")).alias("n_success"))


def confidence_level(c: Column) -> Column:
    from semtflow.operators.analytics import confidence_level as level

    return level(c)
