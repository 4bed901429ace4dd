"""Rule-based extraction (D): rules are rows of a small table, hits stay in the row."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.operators.patterns import normalized_string


def rule_hits(text: Column, rules=fv.RULES) -> Column:
    """All hits of all rules in a cleaned text, as an array in rule order."""
    def hit_of(i: int, field: str, tail: str, confidence: float, name: str):
        return lambda v, pos: F.struct(
            F.lit(field).alias("field"), F.trim(F.concat(v, F.lit(tail))).alias("value"), F.lit(confidence).alias("confidence"),
            F.lit(name).alias("rule"), F.lit(i).alias("seq"), pos.alias("pos"))

    per_rule = [
        F.transform(F.regexp_extract_all(text, F.lit("(?iU)" + pattern), F.lit(1)), hit_of(i, field, template.removeprefix("$1"), conf, name))
        for i, (field, pattern, template, conf, name) in enumerate(rules)
    ]
    return F.filter(F.concat(*per_rule), lambda h: h["value"] != "")


def rule_candidates(df: DataFrame, col: str = "address", rules=fv.RULES) -> DataFrame:
    """Long form: one row per hit."""
    cleaned = df.withColumn("__clean", t.rule_clean(F.col(col)))
    return t.exploded(cleaned, rule_hits(F.col("__clean"), rules), "h").select(*df.columns, "h.*")


def best_rule_value(candidates: DataFrame, key: str = "addr_id") -> DataFrame:
    """Per field the most confident value, first found on ties; mean confidence per address."""
    best = candidates.groupBy(key).pivot("field", ["number", "block", "floor", "apartment", "street"]).agg(
        F.max_by("value", F.struct(F.col("confidence"), -F.col("seq"), -F.col("pos"))))
    conf = candidates.groupBy(key).agg(F.least(F.lit(1.0), F.avg("confidence")).alias("rule_confidence"))
    return best.join(conf, key)


def best_in_row(hits: Column, field: str) -> Column:
    """The winning value of a field among the row's hits, or null."""
    mine = F.filter(hits, lambda h: h["field"] == field)

    def ahead(a: Column, b: Column) -> Column:
        return F.when(b["confidence"] > a["confidence"], b).otherwise(a)

    return F.when(F.size(mine) > 0, F.reduce(mine, F.element_at(mine, 1), ahead)["value"])


def mean_confidence(hits: Column) -> Column:
    total = F.aggregate(hits, F.lit(0.0), lambda a, h: a + h["confidence"])
    return F.when(F.size(hits) > 0, F.least(F.lit(1.0), total / F.size(hits))).otherwise(0.0)


def heuristic_word(tokens: Column, keywords: list[str]) -> Column:
    """First token in the keyword set, title-cased."""
    return t.title(F.get(F.filter(tokens, lambda w: w.isin(keywords)), F.lit(0)))


def heuristic_neighborhood(tokens: Column) -> Column:
    """Up to two words before a neighborhood word, street and city words left out."""
    skip = fv.STREET_WORDS + fv.CITY_WORDS

    def before(w: Column, i: Column) -> Column:
        part = F.slice(tokens, F.greatest(i - 1, F.lit(1)), F.least(F.lit(2), i))
        kept = F.transform(F.filter(part, lambda x: ~x.isin(skip)), t.title)
        return F.when(w.isin(fv.NEIGHBORHOOD_WORDS) & (i > 0), F.array_join(kept, " ")).otherwise("")

    return F.get(F.filter(F.transform(tokens, before), lambda x: x != ""), F.lit(0))


def heuristic_number(tokens: Column) -> Column:
    return F.get(F.filter(tokens, lambda w: w.rlike(r"^\d+[a-zA-Z]?$")), F.lit(0))


def merged(*sources: Column) -> Column:
    """Supplied, rule, heuristic: the first that is not blank."""
    return F.coalesce(*[t.blank_to_null(s) for s in sources])


def fallback_confidence(rule: Column, heuristic: Column) -> Column:
    return F.when(rule > 0, F.least(F.lit(1.0), rule * 0.8 + heuristic * 0.2)).otherwise(F.least(F.lit(0.3), heuristic * 0.3))


def fallback_warnings(get, fields: list[str] = fv.FIELDS) -> Column:
    n = sum((get(f).isNotNull().cast("int") for f in fields), F.lit(0))
    none = lambda a, b: get(a).isNull() & get(b).isNull()
    return F.array_compact(F.array(
        F.lit(fv.WARN_HEURISTIC), F.when(n == 0, fv.WARN_NONE).when(n < 3, fv.WARN_FEW),
        F.when(none("city", "district"), fv.WARN_NO_PLACE), F.when(none("street", "neighborhood"), fv.WARN_NO_STREET), F.lit(fv.WARN_FALLBACK)))


def normalize_fallback(df: DataFrame, col: str = "address") -> DataFrame:
    """Rules, heuristics, merge, confidence, warnings and address line in one row-wise job.

    Adds a struct ``fields`` and the columns confidence, warnings, normalized_address.
    """
    step = df.withColumn("__clean", t.rule_clean(F.col(col)))
    step = step.select(*df.columns, F.explode(F.array(F.struct(
        rule_hits(F.col("__clean")).alias("hits"), t.words(F.col("__clean")).alias("tok")))).alias("__r"))
    hits, tok = F.col("__r.hits"), F.col("__r.tok")
    null = F.lit(None).cast("string")
    value = {f: null for f in fv.FIELDS}
    value |= {f: best_in_row(hits, f) for f in ("block", "floor", "apartment", "street")}
    value["number"] = merged(best_in_row(hits, "number"), heuristic_number(tok))
    value["city"] = heuristic_word(tok, fv.CITY_WORDS)
    value["district"] = heuristic_word(tok, fv.DISTRICT_WORDS)
    value["neighborhood"] = heuristic_neighborhood(tok)
    made = F.struct(*[value[f].alias(f) for f in fv.FIELDS])
    out = step.select(*df.columns, F.explode(F.array(F.struct(
        made.alias("fields"), fallback_confidence(mean_confidence(hits), F.lit(0.1)).alias("confidence")))).alias("__f"))
    get = lambda f: F.col(f"__f.fields.{f}")
    return out.select(*df.columns, "__f.fields", "__f.confidence", fallback_warnings(get).alias("warnings"),
                      normalized_string(get, fallback=True).alias("normalized_address"))


def rule_hit_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("rule", "field").agg(F.count(F.lit(1)).alias("n_hits"))


# --- legacy extraction ------------------------------------------------------


def _first(text: Column, rules: list[tuple[str, bool, str]]) -> Column:
    """First rule with a value; the tail of a pattern is looked for before the pattern itself."""
    def one(pattern: str, ignore: bool, form: str) -> Column:
        flags = "(?iU)" if ignore else "(?U)"
        shape = {"title": t.title, "upper": F.upper, "asis": lambda c: c}[form]
        v = t.blank_to_null(F.regexp_extract(text, flags + pattern, 1))
        tail = re.search(r"\\s\+\(\?:[^)]*\)\\b$", pattern)
        if tail:
            v = F.when(text.rlike(flags + tail.group(0)), v)
        return shape(v)

    return F.coalesce(*[one(*r) for r in rules])


def legacy_patterns(text: Column) -> dict[str, Column]:
    """Component columns from the pattern list, highest priority first."""
    wide = t.let(text, lambda x: t.expand_abbrev(x, fv.LEGACY_ABBREVIATIONS))
    out = {}
    for comp in fv.LEGACY_COMPONENTS:
        mine = sorted((r for r in fv.LEGACY_PATTERNS if r[0] == comp), key=lambda r: -r[3])
        out[comp] = _first(wide, [(p, i, "asis") for _, p, i, _ in mine]) if mine else F.lit(None).cast("string")
    return out


def _engine_rules(comp: str) -> list[tuple[str, bool, str]]:
    mine = sorted((r for r in fv.ENGINE_RULES if r[0] == comp), key=lambda r: -r[2])
    return [(p, True, form) for _, p, _, form in mine]


def rule_engine(text: Column) -> dict[str, Column]:
    return {comp: _first(text, _engine_rules(comp)) for comp in fv.LEGACY_COMPONENTS}


def rule_engine_sequential(df: DataFrame, col: str = "text") -> DataFrame:
    """As the rule engine, but each value leaves the text before the next component is sought."""
    out = df.withColumn("__rest", F.col(col))
    for comp in fv.LEGACY_COMPONENTS:
        out = out.withColumn(comp, _first(F.col("__rest"), _engine_rules(comp)))
        at = F.expr(f"locate({comp}, __rest)")
        cut = F.concat(F.expr(f"substring(__rest, 1, locate({comp}, __rest) - 1)"),
                       F.expr(f"substring(__rest, locate({comp}, __rest) + length({comp}))"))
        out = out.withColumn("__rest", F.when(F.col(comp).isNotNull() & (at > 0), t.strip(t.squeeze(cut))).otherwise(t.strip(t.squeeze(F.col("__rest")))))
    return out.drop("__rest")


def legacy_extract(text: Column) -> dict[str, Column]:
    """Rule engine values over pattern values."""
    old, new = legacy_patterns(text), rule_engine(text)
    return {c: F.coalesce(t.blank_to_null(new[c]), t.blank_to_null(old[c])) for c in fv.LEGACY_COMPONENTS}


def address_type(text: Column) -> Column:
    low = F.lower(text)
    shop, home = t.hits_of(low, fv.COMMERCIAL_WORDS), t.hits_of(low, fv.RESIDENTIAL_WORDS)
    return F.when(shop > home, "commercial").when(home > 0, "residential").otherwise("unknown")


def province_hint(text: Column) -> Column:
    low = F.lower(text)
    out = None
    for word, name in fv.LEGACY_PROVINCE_HINTS:
        out = F.when(low.contains(word), name) if out is None else out.when(low.contains(word), name)
    return out


def legacy_heuristics(get, text: Column) -> dict[str, Column]:
    """Backstops for province, neighborhood and street, and the address type."""
    low = F.lower(text)
    word = lambda p: t.title(t.blank_to_null(F.regexp_extract(low, "(?U)" + p, 1)))
    street = F.coalesce(
        F.when(low.rlike(r"\s(sokak|sk|cad)"), word(r"(\w+(?:\s+\w+)*)\s+(?:sokak|sk|cad|cadde)")),
        F.when(low.rlike(r"\s(bulvar|blv)"), word(r"(\w+(?:\s+\w+)*)\s+(?:bulvar|blv)")))
    return {
        "il": F.coalesce(get("il"), province_hint(text)),
        "address_type": address_type(text),
        "mahalle": F.coalesce(get("mahalle"), F.when(low.contains("mahalle"), word(r"(\w+)\s+mahalle"))),
        "sokak": F.coalesce(get("sokak"), street),
    }


def legacy_province_suggest(value: Column, provinces: list[str] = fv.LEGACY_PROVINCES) -> Column:
    """First province of the list that equals, prefixes, is prefixed by, or shares over 0.8 of its letters."""
    named = [{"p": p, "q": p.lower(), "c": list(dict.fromkeys(p.lower()))} for p in provinces]
    known = t.table(named, "array<struct<p:string,q:string,c:array<string>>>")

    def suggested(v: Column) -> Column:
        low, chars, n = v["low"], v["chars"], F.size(v["chars"])

        def fits(r: Column) -> Column:
            m = F.size(r["c"])
            alike = t.let(F.size(F.array_intersect(chars, r["c"])), lambda both: both / (n + m - both) > 0.8)
            return (low == r["q"]) | r["q"].startswith(low) | low.startswith(r["q"]) | ((F.least(n, m) / F.greatest(n, m) > 0.8) & alike)

        return F.get(F.filter(known, fits), F.lit(0))["p"]

    # a lambda computes what it names for every province, so the value's own parts are bound before
    parts = lambda low: F.struct(low.alias("low"), F.array_distinct(F.split(low, "")).alias("chars"))
    return t.let(t.let(F.lower(value), parts), suggested)


def legacy_validate(get) -> dict[str, Column]:
    """Checked form of each component; a value that fails keeps its suggestion or itself."""
    def kept(name: str, form, pattern: str | None = None, least: int = 0) -> Column:
        v = t.blank_to_null(get(name))
        shaped = form(v)
        good = shaped.rlike(pattern) if pattern else F.length(shaped) >= least
        return F.when(good, shaped).otherwise(v)

    same = lambda c: c
    il = t.title(t.blank_to_null(get("il")))
    return {
        "il": F.when(il.isin(fv.LEGACY_PROVINCES), il).otherwise(F.coalesce(legacy_province_suggest(il), t.blank_to_null(get("il")))),
        "ilce": t.title(t.blank_to_null(get("ilce"))),
        "mahalle": kept("mahalle", t.title, least=2),
        "sokak": kept("sokak", t.title, least=2),
        "bina_no": kept("bina_no", same, r"^\d+(?:/\d+)?$"),
        "daire_no": kept("daire_no", same, r"^\d+$"),
        "kat": kept("kat", same, r"^-?\d+$"),
        "site": kept("site", t.title, least=2),
        "blok": kept("blok", F.upper, r"^[A-Z]\d*$|^\d+[A-Z]?$"),
        "posta_kodu": kept("posta_kodu", same, r"^\d{5}$"),
    }


def legacy_confidence(n_filled: Column, text: Column) -> Column:
    turkish = F.when(text.rlike(f"[{fv.LEGACY_TURKISH_LETTERS}]"), 0.05).otherwise(0.0)
    length = F.least(F.length(text) / 100.0, F.lit(1.0)) * 0.1
    return F.least(F.lit(0.5), 0.1 + F.least(n_filled * 0.1, F.lit(0.3)) + length + turkish)


def normalize_legacy(df: DataFrame, col: str = "address") -> DataFrame:
    """Adds ``components`` (map), ``confidence``, ``success``; a null address fails with 0.01."""
    text = F.col("__text")
    out = df.withColumn("__text", t.legacy_clean(F.col(col)))
    found = F.struct(*[c.alias(n) for n, c in legacy_extract(text).items()])
    out = out.select(*df.columns, "__text", F.explode(F.array(found)).alias("__e"))
    better = legacy_heuristics(lambda n: F.col(f"__e.{n}"), text)
    out = out.select(*df.columns, "__text", "__e", F.explode(F.array(F.struct(*[c.alias(n) for n, c in better.items()]))).alias("__h"))
    get = lambda n: F.col(f"__h.{n}") if n in better else F.col(f"__e.{n}")
    checked = legacy_validate(get) | {"address_type": F.col("__h.address_type")}
    pairs = F.array(*[F.struct(F.lit(n).alias("key"), c.alias("value")) for n, c in checked.items()])
    comps = F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull()))
    out = out.select(*df.columns, "__text", F.explode(F.array(comps)).alias("__m"))
    failed = F.col(col).isNull()
    return out.select(
        *df.columns,
        F.when(failed, F.create_map(F.lit("raw_address"), F.lit(""))).otherwise(F.col("__m")).alias("components"),
        F.when(failed, 0.01).otherwise(legacy_confidence(F.size("__m"), text)).alias("confidence"),
        F.struct(text.alias("cleaned_address"), F.size("__m").alias("rules_applied"), F.lit("pattern_ml_failed").alias("fallback_reason")).alias("details"),
        (~failed).alias("success"),
    )
