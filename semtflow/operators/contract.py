"""Output contract of an address row (I24)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: the constraints of the output record ----------------------
LENGTHS = {"city": 100, "district": 100, "neighborhood": 100, "street": 200, "building": 100}
SHAPES = {
    "country": "^[A-Z]{2}$", "block": "^[A-Za-z0-9]+$", "number": "^[0-9A-Za-z/-]+$", "entrance": "^[A-Za-z0-9]+$",
    "floor": "^[0-9-]+$", "apartment": "^[0-9A-Za-z]+$", "postcode": "^[0-9]{5}$",
}
RELATIONS = ["karsisi", "yani", "arkasi", "ustu", "alti", "ici", "yaninda"]
METHODS = ["ml", "pattern", "fallback"]


def violations(get, present: set[str] | None = None) -> Column:
    """Names of the fields that break their constraint; nulls are fine."""
    from semtflow.functions import fixed_values as fv

    present = set(fv.FIELDS) if present is None else present
    tests = [F.when(~F.length(get(f)).between(1, n), f) for f, n in LENGTHS.items() if f in present]
    tests += [F.when(~get(f).rlike(p), f) for f, p in SHAPES.items() if f in present]
    if "relation" in present:
        tests.append(F.when(~get("relation").isin(RELATIONS), "relation"))
    if "method" in present:
        tests.append(F.when(get("method").isNull() | ~get("method").isin(METHODS), "method"))
    if "confidence" in present:
        tests.append(F.when(get("confidence").isNull() | ~get("confidence").between(0.0, 1.0), "confidence"))
    for f in ("explanation_raw", "normalized_address"):
        if f in present:
            tests.append(F.when(get(f).isNull() | ((F.length(get(f)) < 1) & F.lit(f == "normalized_address")), f))
    return F.array_compact(F.array(*tests))


def contract_check(df: DataFrame) -> DataFrame:
    """Violations per field over all rows of a table with the contract's columns."""
    broken = df.select(F.explode_outer(violations(F.col, set(df.columns))).alias("field")).filter(F.col("field").isNotNull())
    return broken.groupBy("field").agg(F.count(F.lit(1)).alias("n_violations"))
