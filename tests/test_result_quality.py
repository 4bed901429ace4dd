"""Quality estimates against values worked out by hand."""

from semtflow.operators import quality as q

COLUMNS = "il string, ilce string, mahalle string, sokak string, bina_no string, daire_no string, posta_kodu string, text string, method string"
RAW = ["match_score", "pattern_quality", "coverage_in", "specificity", "model_score", "entropy", "feature_quality", "similarity"]


def scored(spark, parts, method, raw, cols):
    row = (*[parts.get(c) for c in q.PARTS], "x", method, *map(float, raw))
    df = spark.createDataFrame([row], COLUMNS + "".join(f", {n} double" for n in RAW))
    return q.score(df, cols).select(*cols).first()


def test_padded_values_count_whole(spark):
    flat = {"il": "ankara", "ilce": "cankaya", "bina_no": "12", "posta_kodu": "06100"}
    padded = {k: f"  {v} " for k, v in flat.items()}
    cols = ["enhanced_completeness", "enhanced_consistency"]
    assert scored(spark, flat, "hybrid", [0.5] * 8, cols).enhanced_completeness == 1.0
    assert scored(spark, padded, "hybrid", [0.5] * 8, cols).enhanced_completeness == 1.0


def test_no_component_is_not_consistent(spark):
    assert scored(spark, {}, "hybrid", [0.5] * 8, ["enhanced_consistency"]).enhanced_consistency == 0.0


def test_accuracy_without_overall_confidence(spark):
    """ml 0.25 x (1 - 0) = 0.25, pattern 0; fallback: 0.4 x 0.25 - 0.2 < 0, so overall 0 and the larger one counts."""
    one = scored(spark, {}, "fallback", [0, 0, 0, 0, 0, 0, 0, 0], ["overall_conf", "accuracy_estimate"])
    assert one.overall_conf == 0.0 and abs(one.accuracy_estimate - 0.25 * 0.6) < 1e-9
    # pattern 0.4 x 0.25 = 0.1, ml 0.25: 0.6 x 0.1 + 0.4 x 0.25 - 0.2 < 0, so their mean counts
    both = scored(spark, {}, "fallback", [0.25, 0, 0, 0, 0, 0, 0, 0], ["overall_conf", "accuracy_estimate"])
    assert both.overall_conf == 0.0 and abs(both.accuracy_estimate - 0.175 * 0.6) < 1e-9
