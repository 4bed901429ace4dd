"""Queries of the rule extraction section (D) over derived addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.operators import rules as r
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_b import _LEGACY
from semtflow.plans.section_c import FIELDS_SQL, fields
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import addresses

RULE_TEXT = f"trim(regexp_replace({d.squeeze("lower(replace(address, 'İ', 'i̇'))")}, '[,.;:]+', ' ', 'g'))"
_ROWS = " UNION ALL ".join(
    f"SELECT addr_id, '{f}' AS field, trim(v || '{tpl.removeprefix('$1')}') AS value, {c}::DOUBLE AS confidence, '{n}' AS rule, {i} AS seq, pos FROM "
    f"(SELECT addr_id, unnest(m) AS v, unnest(range(len(m))) AS pos FROM (SELECT addr_id, regexp_extract_all(text, '(?i){p}', 1) AS m FROM rt))"
    for i, (f, p, tpl, c, n) in enumerate(fv.RULES)
)
CAND = f"{d.ADDR}, rt AS (SELECT addr_id, {RULE_TEXT} AS text FROM addr), cand AS ({_ROWS})"


def base(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", "address")


def candidates(spark, sf_dir):
    return r.rule_candidates(base(spark, sf_dir)).drop("address")


@query("d01_rule_candidates", f"WITH {CAND} SELECT addr_id, field, value, confidence, rule FROM cand WHERE value <> ''")
def d01(spark, sf_dir):
    return candidates(spark, sf_dir).select("addr_id", "field", "value", "confidence", "rule")


_BEST = ", ".join(
    f"max(CASE WHEN field = '{f}' AND i = 1 THEN value END) AS {f}" for f in ["number", "block", "floor", "apartment", "street"]
)


@query(
    "d02_best_rule_value",
    f"""WITH {CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY addr_id, field ORDER BY confidence DESC, seq, pos) AS i FROM cand)
        SELECT addr_id, {_BEST}, round(least(1.0, avg(confidence)), 6) AS rule_confidence FROM o GROUP BY 1""",
)
def d02(spark, sf_dir):
    return rounded(r.best_rule_value(candidates(spark, sf_dir)))


SPACED = "trim(regexp_replace(lower(strip_accents(address)), '[ /,.;:]+', ' ', 'g'))"
TOK = f"{d.ADDR}, tk AS (SELECT addr_id, string_split({SPACED}, ' ') AS tk FROM addr)"


def tokenized(spark, sf_dir):
    """Tokens of the folded address with the city/district slash opened."""
    low = F.trim(F.regexp_replace(t.ascii_fold(F.col("address")), "[ /,.;:]+", " "))
    return base(spark, sf_dir).select("addr_id", t.words(low).alias("tk"))


_FOLD_TOK = TOK.replace("lower(strip_accents(address))", d.fold("address"))


def _first_sql(words: list[str]) -> str:
    return d.title(f"list_filter(tk, lambda w: list_contains({d.strings(words)}, w))[1]")


@query(
    "d03_heuristic_city_district",
    f"WITH {_FOLD_TOK} SELECT addr_id, {_first_sql(fv.CITY_WORDS)} AS city, {_first_sql(fv.DISTRICT_WORDS)} AS district FROM tk",
)
def d03(spark, sf_dir):
    return tokenized(spark, sf_dir).select(
        "addr_id", r.heuristic_word(F.col("tk"), fv.CITY_WORDS).alias("city"), r.heuristic_word(F.col("tk"), fv.DISTRICT_WORDS).alias("district"))


@query(
    "d04_heuristic_neighborhood",
    f"""WITH {_FOLD_TOK}, w AS (SELECT addr_id, unnest(tk) AS w, unnest(range(1, len(tk) + 1)) AS i FROM tk),
        k AS (SELECT addr_id, min(i) AS i FROM w WHERE w IN ({", ".join("'" + x + "'" for x in fv.NEIGHBORHOOD_WORDS)}) AND i > 1 GROUP BY 1),
        p AS (SELECT w.addr_id, string_agg(upper(w.w[1]) || w.w[2:], ' ' ORDER BY w.i) AS nb FROM w JOIN k ON k.addr_id = w.addr_id
              AND w.i BETWEEN greatest(k.i - 2, 1) AND k.i - 1
              WHERE w.w NOT IN ({", ".join("'" + x + "'" for x in fv.STREET_WORDS + fv.CITY_WORDS)}) GROUP BY 1)
        SELECT tk.addr_id, nb AS neighborhood FROM tk LEFT JOIN p USING (addr_id)""",
)
def d04(spark, sf_dir):
    return tokenized(spark, sf_dir).select("addr_id", r.heuristic_neighborhood(F.col("tk")).alias("neighborhood"))


@query(
    "d05_heuristic_number",
    f"WITH {_FOLD_TOK} SELECT addr_id, list_filter(tk, lambda w: regexp_full_match(w, '[0-9]+[a-zA-Z]?'))[1] AS number FROM tk",
)
def d05(spark, sf_dir):
    return tokenized(spark, sf_dir).select("addr_id", r.heuristic_number(F.col("tk")).alias("number"))


@query(
    "d06_merge_components",
    f"""WITH {d.ADDR} SELECT addr_id, coalesce(nullif(trim(CASE WHEN addr_id % 3 = 0 THEN '  ' ELSE city_in END), ''),
          nullif(trim(CASE WHEN addr_id % 2 = 0 THEN '' ELSE district END), ''), nullif(trim(nbh), '')) AS merged FROM addr""",
)
def d06(spark, sf_dir):
    k = F.col("addr_id")
    return addresses(spark, sf_dir).select("addr_id", r.merged(
        F.when(k % 3 == 0, "  ").otherwise(F.col("city_in")), F.when(k % 2 == 0, "").otherwise(F.col("district")), F.col("nbh")).alias("merged"))


@query(
    "d07_fallback_confidence",
    f"""WITH {CAND}, a AS (SELECT addr_id, least(1.0, avg(confidence)) AS rc FROM cand GROUP BY 1),
        j AS (SELECT addr.addr_id, CASE WHEN addr.addr_id % 10 = 0 THEN 0.0 ELSE coalesce(rc, 0) END AS rc FROM addr LEFT JOIN a USING (addr_id))
        SELECT addr_id, round(CASE WHEN rc > 0 THEN least(1.0, rc * 0.8 + 0.1 * 0.2) ELSE least(0.3, 0.1 * 0.3) END, 6)::DOUBLE AS confidence FROM j""",
)
def d07(spark, sf_dir):
    hits = base(spark, sf_dir).withColumn("c", t.rule_clean(F.col("address")))
    rc = F.when(F.col("addr_id") % 10 == 0, 0.0).otherwise(t.let(r.rule_hits(F.col("c")), r.mean_confidence))
    return rounded(hits.withColumn("rc", rc).select("addr_id", r.fallback_confidence(F.col("rc"), F.lit(0.1)).alias("confidence")))


_FILLED = " + ".join(f"({f} IS NOT NULL)::INT" for f in ["neighborhood", "street", "block", "number", "floor", "apartment", "district", "city", "postcode"])


@query(
    "d08_fallback_warnings",
    f"""WITH {d.ADDR}, {FIELDS_SQL}, n AS (SELECT *, {_FILLED} AS n FROM fl)
        SELECT addr_id, concat_ws('|', '{fv.WARN_HEURISTIC}', CASE WHEN n = 0 THEN '{fv.WARN_NONE}' WHEN n < 3 THEN '{fv.WARN_FEW}' END,
          CASE WHEN city IS NULL AND district IS NULL THEN '{fv.WARN_NO_PLACE}' END,
          CASE WHEN street IS NULL AND neighborhood IS NULL THEN '{fv.WARN_NO_STREET}' END, '{fv.WARN_FALLBACK}') AS warnings FROM n""",
)
def d08(spark, sf_dir):
    return fields(spark, sf_dir).select("addr_id", F.array_join(r.fallback_warnings(F.col), "|").alias("warnings"))


@query(
    "d09_fallback_string",
    f"""WITH {d.ADDR}, {FIELDS_SQL} SELECT addr_id, coalesce(nullif(concat_ws(', ', neighborhood || ' Mahallesi', street, building, block || ' Blok',
          CASE WHEN starts_with(lower(number), 'no') THEN number ELSE 'No: ' || number END, 'Kat: ' || floor, 'Daire: ' || apartment,
          district, city, postcode), ''), 'Adres bilgisi eksik') AS line FROM fl""",
)
def d09(spark, sf_dir):
    from semtflow.operators.patterns import normalized_string

    return fields(spark, sf_dir).select("addr_id", normalized_string(F.col, fallback=True).alias("line"))


@query("d10_normalize_fallback")
def d10(spark, sf_dir):
    out = r.normalize_fallback(base(spark, sf_dir))
    return rounded(out.select("addr_id", F.to_json("fields").alias("fields"), "confidence", F.array_join("warnings", "|").alias("warnings"), "normalized_address"))


# --- legacy -----------------------------------------------------------------

W = r"[\p{L}\p{N}\p{M}_]"
NW = r"[^\p{L}\p{N}\p{M}_]"


def re2(pattern: str, ignore: bool = True) -> str:
    """The same expression for a regex engine whose word classes are ASCII."""
    p = pattern
    if p.startswith(r"\b"):
        p = f"(?:^|{NW})" + p[2:]
    if p.endswith(r"\b"):
        p = p[:-2] + f"(?:$|{NW})"
    p = p.replace(r"\w", W).replace(r"\s", "[ ]")
    return ("(?i)" if ignore else "") + p


_PLAIN = ", ".join(f"'{t._caseless(k)}': '{v}'" for k, v in {t._caseless(k): v for k, v in fv.LEGACY_ABBREVIATIONS.items()}.items())
LEGACY_WIDE = (
    f"array_to_string(list_transform(regexp_extract_all(text, '{W}+|{NW}+'), lambda r: coalesce(map_extract(MAP {{{_PLAIN}}}, "
    "replace(replace(lower(r), 'i̇', 'i'), 'ı', 'i'))[1], r)), '')"
)
LEGACY = f"{d.ADDR}, lt AS (SELECT addr_id, text, {LEGACY_WIDE} AS wide FROM (SELECT addr_id, {_LEGACY.replace('(text', '(address')} AS text FROM addr))"


def _legacy_sql(comp: str) -> str:
    mine = sorted((x for x in fv.LEGACY_PATTERNS if x[0] == comp), key=lambda x: -x[3])
    if not mine:
        return f"NULL::VARCHAR AS {comp}"
    return "coalesce(" + ", ".join(f"nullif(trim(regexp_extract(wide, '{re2(p, i)}', 1)), '')" for _, p, i, _ in mine) + f") AS {comp}"


def _engine_sql(comp: str) -> str:
    mine = sorted((x for x in fv.ENGINE_RULES if x[0] == comp), key=lambda x: -x[2])
    shape = {"title": d.title, "upper": lambda x: f"upper({x})", "asis": lambda x: x}
    return "coalesce(" + ", ".join(shape[f](f"nullif(trim(regexp_extract(text, '{re2(p)}', 1)), '')") for _, p, _, f in mine) + f") AS {comp}"


L_OLD = "lo AS (SELECT addr_id, " + ", ".join(_legacy_sql(c) for c in fv.LEGACY_COMPONENTS) + " FROM lt)"
L_NEW = "ln AS (SELECT addr_id, " + ", ".join(_engine_sql(c) for c in fv.LEGACY_COMPONENTS) + " FROM lt)"
L_BOTH = "lx AS (SELECT addr_id, " + ", ".join(f"coalesce(ln.{c}, lo.{c}) AS {c}" for c in fv.LEGACY_COMPONENTS) + " FROM lo JOIN ln USING (addr_id))"


def legacy(spark, sf_dir):
    return base(spark, sf_dir).select("addr_id", t.legacy_clean(F.col("address")).alias("text"))


def _named(cols: dict):
    return [c.alias(n) for n, c in cols.items()]


@query("d11_legacy_patterns", f"WITH {LEGACY}, {L_OLD} SELECT * FROM lo")
def d11(spark, sf_dir):
    return legacy(spark, sf_dir).select("addr_id", *_named(r.legacy_patterns(F.col("text"))))


@query("d12_rule_engine", f"WITH {LEGACY}, {L_NEW} SELECT * FROM ln")
def d12(spark, sf_dir):
    return legacy(spark, sf_dir).select("addr_id", *_named(r.rule_engine(F.col("text"))))


@query("d13_rule_engine_sequential")
def d13(spark, sf_dir):
    return r.rule_engine_sequential(legacy(spark, sf_dir)).drop("text")


@query("d14_legacy_extract", f"WITH {LEGACY}, {L_OLD}, {L_NEW}, {L_BOTH} SELECT * FROM lx")
def d14(spark, sf_dir):
    return legacy(spark, sf_dir).select("addr_id", *_named(r.legacy_extract(F.col("text"))))


LOW = "lower(replace(text, 'İ', 'i̇'))"
_HINT = " ".join(f"WHEN contains({LOW}, '{w}') THEN '{n}'" for w, n in fv.LEGACY_PROVINCE_HINTS)
_SHOP = " + ".join(f"contains({LOW}, '{w}')::INT" for w in fv.COMMERCIAL_WORDS)
_HOME = " + ".join(f"contains({LOW}, '{w}')::INT" for w in fv.RESIDENTIAL_WORDS)
_ST1 = d.title(f"nullif(regexp_extract({LOW}, '({W}+(?:[ ]+{W}+)*)[ ]+(?:sokak|sk|cad|cadde)', 1), '')")
_ST2 = d.title(f"nullif(regexp_extract({LOW}, '({W}+(?:[ ]+{W}+)*)[ ]+(?:bulvar|blv)', 1), '')")
_NB = d.title(f"nullif(regexp_extract({LOW}, '({W}+)[ ]+mahalle', 1), '')")


@query(
    "d15_legacy_heuristics",
    f"""WITH {LEGACY} SELECT addr_id, CASE {_HINT} END AS il,
          CASE WHEN ({_SHOP}) > ({_HOME}) THEN 'commercial' WHEN ({_HOME}) > 0 THEN 'residential' ELSE 'unknown' END AS address_type,
          {_NB} AS mahalle, coalesce({_ST1}, {_ST2}) AS sokak FROM lt""",
)
def d15(spark, sf_dir):
    none = lambda n: F.lit(None).cast("string")
    return legacy(spark, sf_dir).select("addr_id", *_named(r.legacy_heuristics(none, F.col("text"))))


RAW = f"""{d.ADDR}, rw AS (SELECT addr_id, CASE WHEN addr_id % 5 = 0 THEN upper(city_in) ELSE city_in END AS il, lower(district_in) AS ilce,
   CASE WHEN addr_id % 4 = 0 THEN 'x' ELSE nbh END AS mahalle, street AS sokak, CASE WHEN addr_id % 3 = 0 THEN number || '/2' WHEN addr_id % 3 = 1
   THEN number || 'a' ELSE number END AS bina_no, CASE WHEN addr_id % 2 = 0 THEN '5' ELSE '5b' END AS daire_no,
   CASE WHEN addr_id % 2 = 0 THEN '-1' ELSE 'zemin' END AS kat, '' AS site, CASE WHEN addr_id % 2 = 0 THEN 'a1' ELSE 'ab' END AS blok,
   postcode_in AS posta_kodu FROM addr)"""


def raw_components(spark, sf_dir):
    k = F.col("addr_id")
    a = addresses(spark, sf_dir)
    return a.select(
        "addr_id", F.when(k % 5 == 0, F.upper("city_in")).otherwise(F.col("city_in")).alias("il"), F.lower("district_in").alias("ilce"),
        F.when(k % 4 == 0, "x").otherwise(F.col("nbh")).alias("mahalle"), F.col("street").alias("sokak"),
        F.when(k % 3 == 0, F.concat("number", F.lit("/2"))).when(k % 3 == 1, F.concat("number", F.lit("a"))).otherwise(F.col("number")).alias("bina_no"),
        F.when(k % 2 == 0, "5").otherwise("5b").alias("daire_no"), F.when(k % 2 == 0, "-1").otherwise("zemin").alias("kat"),
        F.lit("").alias("site"), F.when(k % 2 == 0, "a1").otherwise("ab").alias("blok"), F.col("postcode_in").alias("posta_kodu"))


_PROV = d.strings(fv.LEGACY_PROVINCES)


def _suggest_sql(x: str) -> str:
    ch = lambda v: f"list_distinct(string_split({v}, ''))"
    return (
        f"list_filter({_PROV}, lambda p: lower({x}) = lower(p) OR starts_with(lower(p), lower({x})) OR starts_with(lower({x}), lower(p)) OR "
        f"len(list_intersect({ch(f'lower({x})')}, {ch('lower(p)')}))::DOUBLE / len(list_distinct(list_concat({ch(f'lower({x})')}, {ch('lower(p)')}))) > 0.8)[1]"
    )


@query(
    "d16_legacy_validate",
    f"""WITH {RAW}, tt AS (SELECT *, {d.title('il')} AS til FROM rw)
        SELECT addr_id, CASE WHEN list_contains({_PROV}, til) THEN til ELSE coalesce({_suggest_sql('til')}, il) END AS il, {d.title('ilce')} AS ilce,
          CASE WHEN length(mahalle) >= 2 THEN {d.title('mahalle')} ELSE mahalle END AS mahalle, {d.title('sokak')} AS sokak, bina_no, daire_no, kat,
          NULL::VARCHAR AS site, CASE WHEN regexp_full_match(upper(blok), '[A-Z][0-9]*|[0-9]+[A-Z]?') THEN upper(blok) ELSE blok END AS blok, posta_kodu FROM tt""",
)
def d16(spark, sf_dir):
    return raw_components(spark, sf_dir).select("addr_id", *_named(r.legacy_validate(F.col)))


@query("d17_legacy_province_suggest", f"WITH {RAW} SELECT addr_id, {_suggest_sql('il')} AS suggestion FROM rw")
def d17(spark, sf_dir):
    return raw_components(spark, sf_dir).select("addr_id", r.legacy_province_suggest(F.col("il")).alias("suggestion"))


@query(
    "d18_legacy_confidence",
    f"""WITH {LEGACY} SELECT addr_id, round(least(0.5, 0.1 + least(addr_id % 5 * 0.1::DOUBLE, 0.3) + least(length(text) / 100.0::DOUBLE, 1.0) * 0.1
          + CASE WHEN regexp_matches(text, '[{fv.LEGACY_TURKISH_LETTERS}]') THEN 0.05 ELSE 0.0 END), 6)::DOUBLE AS confidence FROM lt""",
)
def d18(spark, sf_dir):
    return rounded(legacy(spark, sf_dir).select("addr_id", r.legacy_confidence(F.col("addr_id") % 5, F.col("text")).alias("confidence")))


@query("d19_normalize_legacy")
def d19(spark, sf_dir):
    out = r.normalize_legacy(base(spark, sf_dir))
    return rounded(out.select("addr_id", F.to_json("components").alias("components"), "confidence", "success", "details.cleaned_address"))


@query("d20_rule_hit_stats", f"WITH {CAND} SELECT rule, field, count(*) AS n_hits FROM cand WHERE value <> '' GROUP BY 1, 2")
def d20(spark, sf_dir):
    return r.rule_hit_stats(candidates(spark, sf_dir))
