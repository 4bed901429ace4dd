"""Queries of the landmark and explanation section (H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.operators import landmarks as m
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import addresses, metric_events

LOW = "lower(replace({}, 'İ', 'i̇'))"
_ENDS = "|".join(sorted(fv.SUFFIXES, key=len, reverse=True))
_KNOWN = ", ".join(f"'{k}': '{v}'" for k, v in fv.SUFFIX_WORDS.items())


def _once(x: str) -> str:
    return f"regexp_replace({x}, '^(.{{3,}}?)(?:{_ENDS})$', '\\1')"


@query(
    "h01_strip_suffix",
    f"""WITH w AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS w FROM documents), u AS (SELECT doc_id, w FROM w WHERE regexp_full_match(w, '[a-zçğıöşü]+'))
        SELECT doc_id, count(*) AS n_words, md5(string_agg(root, ' ' ORDER BY w)) AS roots FROM (SELECT doc_id, w, CASE WHEN length(w) < 3 THEN w
          ELSE coalesce(map_extract(MAP {{{_KNOWN}}}, w)[1], {_once(_once('w'))}) END AS root FROM u) GROUP BY 1""",
)
def h01(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = F.array_sort(F.filter(F.array_distinct(F.split(F.lower("text"), " ")), lambda w: w.rlike("^[a-zçğıöşü]+$")))
    w = docs.select("doc_id", words.alias("w")).filter(F.size("w") > 0)
    return w.select("doc_id", F.size("w").cast("long").alias("n_words"), F.md5(F.array_join(F.transform("w", m.strip_suffix), " ")).alias("roots"))


@query("h02_parse_landmark")
def h02(spark, sf_dir):
    return rounded(m.parse_landmark(addresses(spark, sf_dir).select("addr_id", "explanation")))


_KW = d.strings(fv.LANDMARK_WORDS)


@query(
    "h03_landmark_confidence",
    f"""WITH {d.ADDR}, w AS (SELECT addr_id, string_split({LOW.format('explanation')}, ' ') AS w FROM addr)
        SELECT addr_id, round(least(1.0, greatest(0.0, 0.7 + CASE WHEN len(list_intersect(w, {_KW})) > 0 THEN 0.25 ELSE 0.0 END
          + CASE WHEN len(w) BETWEEN 2 AND 4 THEN 0.1 WHEN len(w) < 2 THEN -0.1 WHEN len(w) > 5 THEN -0.2 ELSE 0.0 END)), 6)::DOUBLE AS confidence FROM w""",
)
def h03(spark, sf_dir):
    return rounded(addresses(spark, sf_dir).select("addr_id", m.landmark_confidence(F.lower("explanation")).alias("confidence")))


_H4 = ", ".join(f"nullif(regexp_extract(e, '(.+?)[ ]+{w}', 1), '')" for w, _ in fv.LANDMARK_PHRASES)
_H4R = " ".join(f"WHEN regexp_matches(e, '.[ ]+{w}') THEN '{r}'" for w, r in fv.LANDMARK_PHRASES)


@query(
    "h04_landmark_regex",
    f"""WITH {d.ADDR}, e AS (SELECT addr_id, {LOW.format('explanation')} AS e FROM addr)
        SELECT addr_id, coalesce({_H4}) AS name, CASE {_H4R} END AS relation FROM e""",
)
def h04(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", m.landmark_regex(F.col("explanation")).alias("m"))
    return a.select("addr_id", "m.name", "m.relation")


_BR = ", ".join(f"CASE WHEN contains(e, '{k}') THEN '{n.replace(chr(39), chr(39) * 2)}/{c}/' || r END" for k, c, n in fv.BRANDS)


@query(
    "h05_detect_landmarks",
    f"""WITH {d.ADDR}, e AS (SELECT addr_id, {LOW.format("address || ' ' || explanation")} AS e FROM addr), r AS (SELECT *, CASE WHEN contains(e, 'yanı') THEN 'yanı'
          WHEN contains(e, 'karşı') THEN 'karşısı' WHEN contains(e, 'arkası') THEN 'arkası' ELSE '' END AS r FROM e)
        SELECT addr_id, concat_ws(';', {_BR}) AS landmarks FROM r""",
)
def h05(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", m.detect_landmarks(F.concat_ws(" ", "address", "explanation")).alias("m"))
    one = lambda x: F.concat(x["name"], F.lit("/"), x["category"], F.lit("/"), F.coalesce(x["relation"], F.lit("")))
    return a.select("addr_id", F.array_join(F.transform("m", one), ";").alias("landmarks"))


def _explain_sql(lang: str) -> str:
    w = fv.TEXTS[lang]
    method = ""
    if lang == "tr":
        method = ", CASE method " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fv.METHOD_TEXTS.items()) + " ELSE 'İşleme yöntemi: ' || method END"
    return f"""WITH {d.EVENTS} SELECT event_id, concat_ws(' ', CASE WHEN success THEN '{w['success']}' ELSE '{w['error']}' || coalesce(error_type, 'Bilinmeyen hata') END,
        CASE WHEN success AND confidence < 0.5 THEN '{w['low']}' WHEN success AND confidence > 0.9 THEN '{w['high']}' END{method}) AS explanation FROM ev"""


@query("h06_explain_result_tr", _explain_sql("tr"))
def h06_tr(spark, sf_dir):
    ev = metric_events(spark, sf_dir)
    return ev.select("event_id", m.explain_result(F.col("success"), F.col("confidence"), F.col("error_type"), F.col("method"), "tr").alias("explanation"))


@query("h06_explain_result_en", _explain_sql("en"))
def h06_en(spark, sf_dir):
    ev = metric_events(spark, sf_dir)
    return ev.select("event_id", m.explain_result(F.col("success"), F.col("confidence"), F.col("error_type"), F.col("method"), "en").alias("explanation"))


@query(
    "h07_confidence_words",
    f"""WITH {d.EVENTS} SELECT event_id, 'Güven skoru: ' || printf('%.2f', confidence) || ' (' || CASE WHEN confidence >= 0.9 THEN 'çok yüksek' WHEN confidence >= 0.8 THEN 'yüksek'
          WHEN confidence >= 0.6 THEN 'orta' WHEN confidence >= 0.4 THEN 'düşük' ELSE 'çok düşük' END || ', ' || CASE WHEN confidence >= 0.9 THEN 'mükemmel'
          WHEN confidence >= 0.7 THEN 'iyi' WHEN confidence >= 0.5 THEN 'orta' ELSE 'düşük' END || ')' AS words FROM ev""",
)
def h07(spark, sf_dir):
    return metric_events(spark, sf_dir).select("event_id", m.confidence_words(F.col("confidence")).alias("words"))


@query(
    "h08_explain_components",
    f"""WITH {d.ADDR} SELECT addr_id, concat_ws('|', 'il: ' || city || ' (güven: 0.85)', 'mahalle: ' || nbh || ' (güven: 0.85)',
          CASE WHEN postcode_in IS NOT NULL THEN 'posta_kodu: ' || postcode_in || ' (güven: 0.85)' END) AS sentences FROM addr""",
)
def h08(spark, sf_dir):
    comps = F.create_map(F.lit("mahalle"), F.col("nbh"), F.lit("il"), F.col("city"), F.lit("posta_kodu"), F.col("postcode_in"), F.lit("kat"), F.lit(""))
    return addresses(spark, sf_dir).select("addr_id", F.array_join(m.explain_components(comps), "|").alias("sentences"))


@query(
    "h09_location_sentence",
    f"""WITH {d.ADDR}, s AS (SELECT *, CASE addr_id % 4 WHEN 0 THEN street || ' Caddesi' WHEN 1 THEN '' ELSE street END AS sokak FROM addr)
        SELECT addr_id, concat_ws(', ', nbh || ' Mahallesi', CASE WHEN regexp_matches({LOW.format('sokak')}, 'caddesi|cd|cad|sokağı|sk|sok|bulvarı|blv|bulvar') THEN sokak
          WHEN sokak <> '' THEN sokak || ' Sokağı' END, 'No: ' || number, district || ' İlçesi', city || ' İli', CASE WHEN addr_id % 3 = 0 THEN '2. Kat' END) || ' konumunda' AS sentence FROM s""",
)
def h09(spark, sf_dir):
    k = F.col("addr_id")
    a = addresses(spark, sf_dir)
    cols = {"mahalle": F.col("nbh"), "sokak": F.when(k % 4 == 0, F.concat("street", F.lit(" Caddesi"))).when(k % 4 == 1, "").otherwise(F.col("street")), "bina_no": F.col("number"),
            "ilce": F.col("district"), "il": F.col("city"), "kat": F.when(k % 3 == 0, "2"), "daire_no": F.lit(None).cast("string")}
    return a.select("addr_id", m.location_sentence(lambda n: cols[n]).alias("sentence"))
