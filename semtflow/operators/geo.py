"""Geographic validation (E) against the city and district dimensions.

Dimensions are a country's administrative units: about 100 cities and 1,000
districts. ``Dims`` collects them behind a size check; exact lookups are then
hash tests inside the row, near misses go through one Arrow function that
sees only the values no exact test knew. Nothing here shuffles the addresses.
"""

from __future__ import annotations

import difflib
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t

MAX_DIM_ROWS = 5000
NEAR = "array<struct<name:string,ratio:double>>"


def checked_broadcast(dim: DataFrame, limit: int = MAX_DIM_ROWS) -> DataFrame:
    """Broadcast hint for a dimension within the bound; a larger one is left to a shuffle join."""
    return F.broadcast(dim) if dim.limit(limit + 1).count() <= limit else dim


def province_dim(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in fv.PROVINCES], "city string")


@dataclass(frozen=True)
class Dims:
    cities: tuple[str, ...]
    pairs: tuple[tuple[str, str], ...]
    by_city: dict[str, list[str]] = field(hash=False, compare=False, default_factory=dict)

    @property
    def districts(self) -> list[str]:
        return sorted({d for _, d in self.pairs})


def load_dims(city_dim: DataFrame, district_dim: DataFrame) -> Dims:
    """Collect both dimensions, refusing anything larger than administrative units can be."""
    cities = [r.city for r in city_dim.select("city").limit(MAX_DIM_ROWS + 1).collect()]
    pairs = [(r.city, r.district) for r in district_dim.select("city", "district").limit(MAX_DIM_ROWS + 1).collect()]
    if max(len(cities), len(pairs)) > MAX_DIM_ROWS:
        raise ValueError(f"a geographic dimension has more than {MAX_DIM_ROWS} rows; use the *_exact joins, which shuffle")
    by_city: dict[str, list[str]] = {}
    for c, d in sorted(pairs):
        by_city.setdefault(c, []).append(d)
    return Dims(tuple(sorted(cities)), tuple(sorted(pairs)), by_city)


# --- joins ------------------------------------------------------------------


def city_exact(df: DataFrame, city_dim: DataFrame, col: str = "city_in") -> DataFrame:
    """Left join on the folded city: ``std_city`` and confidence 1.0 where known."""
    dim = checked_broadcast(city_dim.select(F.col("city").alias("std_city")))
    folded = df.withColumn("__c", t.ascii_fold(F.col(col)))
    out = folded.join(dim, F.col("__c") == F.col("std_city"), "left").drop("__c")
    return out.withColumn("city_confidence", F.when(F.col("std_city").isNotNull(), 1.0).otherwise(0.0))


def district_exact_in_city(df: DataFrame, district_dim: DataFrame, city: str = "city_in", district: str = "district_in") -> DataFrame:
    dim = checked_broadcast(district_dim.select(F.col("city").alias("std_city"), F.col("district").alias("std_district")))
    folded = df.withColumns({"__c": t.ascii_fold(F.col(city)), "__d": t.ascii_fold(F.col(district))})
    on = (F.col("__c") == F.col("std_city")) & (F.col("__d") == F.col("std_district"))
    return folded.join(dim, on, "left").drop("__c", "__d")


def district_exact_global(df: DataFrame, district_dim: DataFrame, city: str = "city_in", district: str = "district_in") -> DataFrame:
    """Any city will do; warns when the row names none."""
    names = checked_broadcast(district_dim.select(F.col("district").alias("std_district")).distinct())
    out = df.withColumn("__d", t.ascii_fold(F.col(district))).join(names, F.col("__d") == F.col("std_district"), "left").drop("__d")
    unclear = F.col("std_district").isNotNull() & t.blank_to_null(F.col(city)).isNull()
    return out.withColumn("warning", F.when(unclear, "District found but city context unclear"))


def ambiguous_districts(district_dim: DataFrame) -> DataFrame:
    return district_dim.groupBy("district").agg(F.countDistinct("city").alias("n_cities")).filter(F.col("n_cities") > 1)


# --- near matches -----------------------------------------------------------


def _near(value: str, names: tuple[str, ...], n: int, cutoff: float) -> list[dict]:
    """Best names by sequence-matcher ratio, ties by name descending; the ratio reported is value against name."""
    m = difflib.SequenceMatcher()
    m.set_seq2(value)
    scored = []
    for name in names:
        if 2.0 * min(len(name), len(value)) < cutoff * (len(name) + len(value)):
            continue
        m.set_seq1(name)
        if m.quick_ratio() >= cutoff and (r := m.ratio()) >= cutoff:
            scored.append((r, name))
    best = sorted(scored, reverse=True)[:n]
    return [{"name": name, "ratio": difflib.SequenceMatcher(None, value, name).ratio()} for _, name in best]


def with_near(df: DataFrame, value: Column, names: list[str], n: int, cutoff: float, out: str) -> DataFrame:
    """Add the near names of a value; null values (already known) cost nothing."""
    names = tuple(names)

    @F.pandas_udf(NEAR)
    def near(values: pd.Series) -> pd.Series:
        known = {v: _near(v, names, n, cutoff) for v in values.dropna().unique()}
        return values.map(known.get, na_action="ignore")

    return df.withColumn(out, near(value))


def with_near_in_city(df: DataFrame, city: Column, value: Column, by_city: dict[str, list[str]], n: int, cutoff: float, out: str) -> DataFrame:
    lists = {c: tuple(ds) for c, ds in by_city.items()}

    @F.pandas_udf(NEAR)
    def near(cities: pd.Series, values: pd.Series) -> pd.Series:
        seek = lru_cache(maxsize=None)(lambda c, v: _near(v, lists.get(c, ()), n, cutoff))
        return pd.Series([seek(c, v) if isinstance(v, str) and isinstance(c, str) else None for c, v in zip(cities, values)], dtype=object)

    return df.withColumn(out, near(city, value))


def with_nears(df: DataFrame, city: Column, district: Column, dims: Dims, cutoff: float, out: str) -> DataFrame:
    """Add all near names that a city and its district may need, as city, inside and anywhere.

    One Arrow function: Spark keeps a Python process per function that depends on another's result,
    for every task that runs. The district is sought in the city as it stands after correction, then
    anywhere; known names are not sought.
    """
    lists, known = {c: tuple(ds) for c, ds in dims.by_city.items()}, set(dims.pairs)
    cities, districts = dims.cities, tuple(dims.districts)
    city_set, district_set = set(cities), set(districts)

    @F.pandas_udf(f"city {NEAR}, inside {NEAR}, anywhere {NEAR}")
    def nears(cs: pd.Series, ds: pd.Series) -> pd.DataFrame:
        seek = lru_cache(maxsize=None)(_near)

        def one(c, d) -> tuple:
            near = inside = anywhere = None
            if isinstance(c, str) and c not in city_set:
                near = seek(c, cities, 5, cutoff)
                c = near[0]["name"] if near and near[0]["ratio"] >= 0.8 else c
            if isinstance(d, str):
                if c in lists and (c, d) not in known:
                    inside = seek(d, lists[c], 3, cutoff)
                if d not in district_set and not (inside and inside[0]["ratio"] >= 0.8):
                    anywhere = seek(d, districts, 5, cutoff)
            return near, inside, anywhere

        rows = [one(c, d) for c, d in zip(cs, ds)]
        return pd.DataFrame({name: pd.Series([r[i] for r in rows], dtype=object) for i, name in enumerate(("city", "inside", "anywhere"))})

    return t.once(df, nears(city, district), out)


def _folded(c: Column) -> Column:
    return F.when(t.blank_to_null(c).isNotNull(), t.ascii_fold(c))


def _verdict(valid: Column, value: Column, confidence: Column, suggestions: Column, warning: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        valid.alias("is_valid"), value.cast("string").alias("value"), confidence.cast("double").alias("confidence"),
        F.coalesce(suggestions, none).alias("suggestions"), F.array_compact(F.array(warning.cast("string"))).alias("warnings"))


def _names(near: Column, start: int = 1) -> Column:
    return F.slice(F.transform(near, lambda x: x["name"]), start, F.greatest(F.size(near), F.lit(1)))


def validate_city(df: DataFrame, col: str, dims: Dims, out: str = "city_v", cutoff: float = 0.6, nears: str | None = None) -> DataFrame:
    """Add the verdict struct: exact, corrected (>= 0.8), suggested, or unknown. ``nears`` has the near names if they are known."""
    raw = F.col(col)
    step = t.once(df, _folded(raw), "__c")
    exact = t.in_set("__c", dims.cities)
    step = step.withColumn("__n", F.col(f"{nears}.city")) if nears else with_near(step, F.when(~exact, F.col("__c")), list(dims.cities), 5, cutoff, "__n")
    near, best = F.col("__n"), F.get(F.col("__n"), F.lit(0))
    r = best["ratio"]
    verdict = (
        F.when(F.col("__c").isNull(), _verdict(F.lit(False), F.lit(None), F.lit(0.0), F.lit(None).cast("array<string>"), F.lit("Empty city name")))
        .when(exact, _verdict(F.lit(True), F.col("__c"), F.lit(1.0), F.lit(None).cast("array<string>"), F.lit(None)))
        .when(r >= 0.8, _verdict(F.lit(True), best["name"], r, _names(near, 2), F.concat(F.lit("Corrected '"), raw, F.lit("' to '"), best["name"], F.lit("'"))))
        .when(r.isNotNull(), _verdict(F.lit(False), F.lit(None), r, _names(near), F.concat(
            F.lit("'"), raw, F.lit("' not found, did you mean: "), F.array_join(F.slice(_names(near), 1, 3), ", "), F.lit("?"))))
        .otherwise(_verdict(F.lit(False), F.lit(None), F.lit(0.0), F.lit(None).cast("array<string>"), F.concat(F.lit("City '"), raw, F.lit("' not found in Turkish provinces"))))
    )
    return t.once(step, verdict, out).drop("__c", "__n")


def validate_district(df: DataFrame, col: str, dims: Dims, city: str | None = None, out: str = "district_v", cutoff: float = 0.6,
                      nears: str | None = None) -> DataFrame:
    """In the city exactly, in the city nearly, anywhere exactly, anywhere nearly. ``nears`` has the near names if they are known."""
    raw = F.col(col)
    town = F.col(city) if city else F.lit(None).cast("string")
    step = t.once(df, _folded(raw), "__d")
    step = t.once(step, _folded(town), "__t")
    d, c = F.col("__d"), F.col("__t")
    known = F.coalesce(t.in_set("__t", sorted(dims.by_city)), F.lit(False))
    inside = F.coalesce(t.in_set("concat(__t, '|', __d)", [f"{a}|{b}" for a, b in dims.pairs]), F.lit(False))
    if nears:
        step = step.withColumn("__n1", F.col(f"{nears}.inside") if city else F.lit(None).cast(NEAR))
    else:
        step = with_near_in_city(step, c, F.when(known & ~inside, d), dims.by_city, 3, cutoff, "__n1")
    n1, b1 = F.col("__n1"), F.get(F.col("__n1"), F.lit(0))
    placed = inside | b1.isNotNull()
    anywhere = t.in_set("__d", dims.districts)
    seek = lambda df: with_near(df, F.when(~placed & ~anywhere, d), dims.districts, 5, cutoff, "__n2")
    step = step.withColumn("__n2", F.col(f"{nears}.anywhere")) if nears else seek(step)
    n2, b2 = F.col("__n2"), F.get(F.col("__n2"), F.lit(0))
    none = F.lit(None).cast("array<string>")
    q = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    in_city = F.when(b1["ratio"] >= 0.8, q("District '", raw, "' corrected to '", b1["name"], "' in ", town)).otherwise(
        q("District '", raw, "' not found in ", town, ", suggestions: ", F.array_join(_names(n1), ", ")))
    overall = F.when(b2["ratio"] >= 0.8, q("District '", raw, "' corrected to '", b2["name"], "'")).otherwise(
        q("District '", raw, "' not found, suggestions: ", F.array_join(F.slice(_names(n2), 1, 3), ", ")))
    verdict = (
        F.when(d.isNull(), _verdict(F.lit(False), F.lit(None), F.lit(0.0), none, F.lit("Empty district name")))
        .when(inside, _verdict(F.lit(True), d, F.lit(1.0), none, F.lit(None)))
        .when(b1.isNotNull(), _verdict(b1["ratio"] >= 0.8, F.when(b1["ratio"] >= 0.8, b1["name"]), b1["ratio"], _names(n1), in_city))
        .when(anywhere, _verdict(F.lit(True), d, F.lit(1.0), none, F.when(c.isNull(), "District found but city context unclear")))
        .when(b2.isNotNull(), _verdict(b2["ratio"] >= 0.8, F.when(b2["ratio"] >= 0.8, b2["name"]), b2["ratio"], _names(n2), overall))
        .otherwise(_verdict(F.lit(False), F.lit(None), F.lit(0.0), none, q("District '", raw, "' not found in Turkish districts")))
    )
    return t.once(step, verdict, out).drop("__d", "__t", "__n1", "__n2")


def validate_consistency(df: DataFrame, city: str, district: str, dims: Dims, out: str = "consistency", nears: str | None = None) -> DataFrame:
    """Standardize both names on their own, then test membership; lists other homes of the district."""
    step = validate_city(df, city, dims, "__cv", nears=nears)
    step = validate_district(step, district, dims, None, "__dv", nears=nears)
    c = F.coalesce(F.col("__cv.value"), t.ascii_fold(F.col(city)))
    d = F.coalesce(F.col("__dv.value"), t.ascii_fold(F.col(district)))
    step = t.once(t.once(step, c, "__sc"), d, "__sd")
    c, d = F.col("__sc"), F.col("__sd")
    known = F.coalesce(t.in_set("__sc", sorted(dims.by_city)), F.lit(False))
    inside = F.coalesce(t.in_set("concat(__sc, '|', __sd)", [f"{a}|{b}" for a, b in dims.pairs]), F.lit(False))
    homes = t.table([{"city": a, "district": b} for a, b in dims.pairs], "array<struct<city:string,district:string>>")
    others = F.slice(F.filter(homes, lambda p: p["district"] == d), 1, 5)
    said = F.concat(F.col("__cv.warnings"), F.col("__dv.warnings"))
    note = F.when(inside, F.lit(None)).when(known, F.concat(F.lit("District '"), F.col(district), F.lit("' is not in city '"), F.col(city), F.lit("'"))).otherwise(
        "Unable to verify city-district consistency")
    return t.once(step, F.struct(
        inside.alias("is_consistent"), c.alias("city"), d.alias("district"), known.alias("city_known"),
        F.when(known & ~inside, others).alias("alternatives"), F.concat(said, F.array_compact(F.array(note.cast("string")))).alias("warnings"),
    ), out).drop("__cv", "__dv", "__sc", "__sd")


def city_district_consistency(df: DataFrame, district_dim: DataFrame, city: str = "city", district: str = "district") -> DataFrame:
    """Membership by joins, for names already standardized: consistent, inconsistent or unverifiable."""
    pairs = checked_broadcast(district_dim.select(F.col("city").alias("__pc"), F.col("district").alias("__pd")).distinct())
    towns = checked_broadcast(district_dim.select(F.col("city").alias("__tc")).distinct())
    out = df.join(pairs, (F.col(city) == F.col("__pc")) & (F.col(district) == F.col("__pd")), "left").join(towns, F.col(city) == F.col("__tc"), "left")
    status = F.when(F.col("__pc").isNotNull(), "consistent").when(F.col("__tc").isNotNull(), "inconsistent").otherwise("unable to verify")
    return out.withColumn("status", status).drop("__pc", "__pd", "__tc")


def alternative_cities(inconsistent: DataFrame, district_dim: DataFrame, district: str = "district", k: int = 5) -> DataFrame:
    """Up to ``k`` (city, district) homes per distinct district of the inconsistent rows."""
    homes = district_dim.select(F.col("district").alias("__d"), F.col("city").alias("alt_city"))
    order = Window.partitionBy("__d").orderBy("alt_city")  # cities holding one district name
    homes = homes.withColumn("__r", F.row_number().over(order)).filter(F.col("__r") <= k).groupBy("__d").agg(
        F.sort_array(F.collect_list("alt_city")).alias("alternatives"))
    return inconsistent.join(checked_broadcast(homes), F.col(district) == F.col("__d"), "left").drop("__d")


def validate_postcode(c: Column) -> Column:
    """Verdict struct for a postcode: five digits, 01000 to 81999."""
    digits = F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\D", "")
    none = F.lit(None).cast("array<string>")
    good = (F.length(digits) == 5) & digits.cast("int").between(1000, 81999)
    note = (
        F.when(t.blank_to_null(c).isNull(), "Empty postal code")
        .when(F.length(digits) != 5, F.concat(F.lit("Postal code must be 5 digits, got "), F.length(digits).cast("string")))
        .when(~good, F.concat(F.lit("Postal code "), digits, F.lit(" out of valid range (01000-81999)"))))
    return _verdict(F.coalesce(note.isNull(), F.lit(False)), F.when(note.isNull(), digits), F.when(note.isNull(), 1.0).otherwise(0.0), none, note)


def apply_geo_validation(df: DataFrame, dims: Dims, fields: str = "fields", warnings: str = "warnings") -> DataFrame:
    """Overwrite city, district and postcode of a field struct by their standard forms; add warnings."""
    keep = df.columns
    step = df.withColumns({"__gc": F.col(f"{fields}.city"), "__gd": F.col(f"{fields}.district"), "__gp": F.col(f"{fields}.postcode")})

    def swap(step: DataFrame, col: str, verdict: str, said: str) -> DataFrame:
        new = F.col(f"{verdict}.value")
        moved = F.col(col).isNotNull() & new.isNotNull() & (new != F.col(col))
        step = step.withColumn(said, F.when(moved, F.col(f"{verdict}.warnings")).otherwise(F.array().cast("array<string>")))
        return t.once(step, F.when(moved, new).otherwise(F.col(col)), col)

    # a name that is swapped is a known one afterwards, so the near names hold for all three checks
    step = with_nears(step, _folded(F.col("__gc")), _folded(F.col("__gd")), dims, 0.6, "__near")
    step = swap(validate_city(step, "__gc", dims, "__cv0", nears="__near"), "__gc", "__cv0", "__w1")
    step = swap(validate_district(step, "__gd", dims, "__gc", "__dv0", nears="__near"), "__gd", "__dv0", "__w2")
    both = F.col("__gc").isNotNull() & F.col("__gd").isNotNull()
    step = validate_consistency(step.withColumns({"__cc": F.when(both, F.col("__gc")), "__dd": F.when(both, F.col("__gd"))}), "__cc", "__dd", dims, "__k", nears="__near")
    step = swap(step.withColumn("__pv0", validate_postcode(F.col("__gp"))), "__gp", "__pv0", "__w4")
    w3 = F.when(both & ~F.col("__k.is_consistent"), F.col("__k.warnings")).otherwise(F.array().cast("array<string>"))
    made = F.col(fields)
    for name, col in (("city", "__gc"), ("district", "__gd"), ("postcode", "__gp")):
        made = made.withField(name, F.col(col))
    step = step.withColumns({fields: made, warnings: F.concat(F.col(warnings), F.col("__w1"), F.col("__w2"), w3, F.col("__w4"))})
    return step.select(*keep)


def lev_city_match(c: Column, cities: list[str], cutoff: float = 0.6, n: int = 5) -> Column:
    """Edit-distance twin of the near-city verdict: top names with similarity, all inside the row."""
    names = t.table(list(cities), "array<string>")
    sim = lambda x: 1 - F.levenshtein(c, x) / F.greatest(F.length(c), F.length(x))
    scored = F.filter(F.transform(names, lambda x: F.struct(F.round(sim(x), 9).alias("s"), x.alias("name"))), lambda p: p["s"] >= cutoff)
    return F.slice(F.reverse(F.array_sort(scored)), 1, n)


def geo_dim_check(city_dim: DataFrame, district_dim: DataFrame, expected: int = 81) -> DataFrame:
    """One row of dimension QA: counts, missing major cities, districts per city."""
    cities = city_dim.agg(F.countDistinct("city").alias("n_cities")).withColumn("j", F.lit(1))
    pairs = district_dim.agg(
        F.count(F.lit(1)).alias("n_pairs"), F.countDistinct("district").alias("n_districts"), F.countDistinct("city").alias("n_cities_with_districts")).withColumn("j", F.lit(1))
    major = city_dim.sparkSession.createDataFrame([(c,) for c in fv.MAJOR_CITIES], "city string")
    missing = major.join(city_dim.select("city").distinct(), "city", "left_anti").agg(F.count(F.lit(1)).alias("n_major_missing")).withColumn("j", F.lit(1))
    out = cities.join(pairs, "j").join(missing, "j").drop("j")
    return out.withColumns({
        "count_ok": F.col("n_cities") == expected,
        "avg_districts_per_city": F.col("n_districts") / F.col("n_cities_with_districts")})
