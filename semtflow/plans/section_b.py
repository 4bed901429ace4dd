"""Queries of the cleaning section (B), over documents, pages and addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.sources.derived import addresses


def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")


PUNCT_SQL = f"translate({{x}}, '{''.join(fv.PUNCTUATION)}', '{' ' * len(fv.PUNCTUATION)}')"


@query("b01_tr_lower", f"SELECT doc_id, md5({d.tr_lower('text')}) AS lowered FROM documents")
def b01(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(t.tr_lower(F.col("text"))).alias("lowered"))


@query(
    "b02_tr_unicode",
    """SELECT page_id, md5(translate(replace(replace(nfc_normalize(html), 'ı̇', 'i'), 'i̇', 'i'), 'İI', 'iı')) AS composed
       FROM pages
       UNION ALL
       SELECT 1000000000 + doc_id, md5(translate(replace(replace(nfc_normalize(text), 'ı̇', 'i'), 'i̇', 'i'), 'İI', 'iı'))
       FROM documents""",
)
def b02(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.col("html").alias("text"))
    more = docs(spark, sf_dir).select((F.lit(1000000000) + F.col("doc_id")).alias("page_id"), "text")
    return pages.unionByName(more).select("page_id", F.md5(t.tr_unicode(F.col("text"))).alias("composed"))


_KEYED = sorted({k for k in fv.ABBREVIATIONS if k.isalnum()}, key=len, reverse=True)
_PLAIN = ", ".join(
    f"'{t._caseless(k)}': '{v}'" for k, v in {t._caseless(k): fv.ABBREVIATIONS[k] for k in _KEYED}.items()
)
EXPAND_SQL = (
    "array_to_string(list_transform(regexp_extract_all("
    rf"regexp_replace(regexp_replace({{x}}, '(^|[^\p{{L}}\p{{N}}\p{{M}}_])[nN]:', '\1numara', 'g'),"
    rf" '(^|[^\p{{L}}\p{{N}}\p{{M}}_])[dD]:', '\1daire', 'g'),"
    r" '[\p{L}\p{N}\p{M}_]+|[^\p{L}\p{N}\p{M}_]+'), lambda r: coalesce(map_extract(MAP {"
    + _PLAIN
    + "}, replace(replace(lower(r), 'i̇', 'i'), 'ı', 'i'))[1], r)), '')"
)


def expand_sql(x: str) -> str:
    return EXPAND_SQL.replace("{x}", x).replace("{{", "{").replace("}}", "}")


@query("b03_expand_abbrev", f"WITH {d.ADDR} SELECT addr_id, {expand_sql('address')} AS expanded FROM addr")
def b03(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", t.expand_abbrev(F.col("address")).alias("expanded"))


@query(
    "b04_clean_punct",
    f"SELECT doc_id, md5(trim({d.squeeze(PUNCT_SQL.replace('{x}', 'text'))})) AS cleaned FROM documents",
)
def b04(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(t.clean_punct(F.col("text"))).alias("cleaned"))


TOKENS_SQL = (
    "list_filter(list_transform(regexp_split_to_array({x}, '[ |,;/\\\\\\-_]+'), lambda w: "
    + d.strip("w")
    + "), lambda w: w <> '')"
)


@query(
    "b05_tokens",
    f"""SELECT doc_id, CAST(len(tk) AS BIGINT) AS n_tokens, md5(array_to_string(tk, '|')) AS tokens
        FROM (SELECT doc_id, {TOKENS_SQL.replace('{x}', 'text')} AS tk FROM documents)""",
)
def b05(spark, sf_dir):
    tk = docs(spark, sf_dir).withColumn("tk", t.tokens(F.col("text")))
    return tk.select(
        "doc_id", F.size("tk").cast("long").alias("n_tokens"), F.md5(F.array_join("tk", "|")).alias("tokens")
    )


_CLEAN_1 = d.tr_lower(f"trim({d.squeeze('address')})")
_CLEAN_2 = f"translate(replace(replace(nfc_normalize({_CLEAN_1}), 'ı̇', 'i'), 'i̇', 'i'), 'İI', 'iı')"
CLEAN_SQL = f"trim({d.squeeze(PUNCT_SQL.replace('{x}', expand_sql(_CLEAN_2)))})"


@query(
    "b06_clean_address",
    f"""WITH {d.ADDR}, c AS (SELECT addr_id, {CLEAN_SQL} AS text FROM addr)
        SELECT addr_id, text, array_to_string({TOKENS_SQL.replace('{x}', 'text')}, '|') AS tokens FROM c""",
)
def b06(spark, sf_dir):
    c = addresses(spark, sf_dir).select("addr_id", t.clean_text(F.col("address")).alias("text"))
    return c.select("addr_id", "text", F.array_join(t.tokens(F.col("text")), "|").alias("tokens"))


@query("b07_ascii_fold", f"SELECT doc_id, md5({d.strip(d.fold('text'))}) AS folded FROM documents")
def b07(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(t.ascii_fold(F.col("text"))).alias("folded"))


@query(
    "b08_clean_explanation",
    f"""SELECT conv_id, turn, md5(coalesce(trim({d.squeeze('text')}), '')) AS cleaned FROM conversations""",
)
def b08(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", F.md5(t.clean_explanation(F.col("text"))).alias("cleaned"))


@query(
    "b09_rule_clean",
    f"""SELECT doc_id, md5(trim(regexp_replace({d.squeeze('lower(text)')}, '[,.;:]+', ' ', 'g'))) AS cleaned
        FROM documents""",
)
def b09(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(t.rule_clean(F.col("text"))).alias("cleaned"))


_LEGACY = f"trim(regexp_replace({d.squeeze(d.strip('text'))}, '[/\\\\.,;:]', ' ', 'g'))"


@query(
    "b10_legacy_clean",
    f"""SELECT doc_id, md5({_LEGACY}) AS cleaned,
               md5(translate({_LEGACY}, '{fv.LEGACY_FOLD_FROM}', '{fv.LEGACY_FOLD_TO}')) AS folded
        FROM documents""",
)
def b10(spark, sf_dir):
    text = F.col("text")
    return docs(spark, sf_dir).select(
        "doc_id", F.md5(t.legacy_clean(text)).alias("cleaned"), F.md5(t.legacy_clean(text, fold=True)).alias("folded")
    )


def token_idempotency_check(df, col="text"):
    """Rows whose tokens change when joined and split again (expected: none)."""
    tk = t.tokens(F.col(col))
    again = t.tokens(F.array_join(tk, " "))
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(tk != again).alias("n_changed"),
    )


@query(
    "b11_token_idempotency",
    f"""WITH k AS (SELECT {TOKENS_SQL.replace('{x}', 'text')} AS tk FROM documents)
        SELECT count(*) AS n_rows,
               CAST(count(*) FILTER (tk <> {TOKENS_SQL.replace('{x}', "array_to_string(tk, ' ')")}) AS BIGINT) AS n_changed
        FROM k""",
)
def b11(spark, sf_dir):
    return token_idempotency_check(docs(spark, sf_dir))


def features_sql(x: str) -> str:
    return f"""CAST(contains(lower({x}), 'mah') AS DOUBLE) AS has_mahalle_keyword,
       CAST(contains(lower({x}), 'sok') AS DOUBLE) AS has_sokak_keyword,
       CAST(contains(lower({x}), 'cad') AS DOUBLE) AS has_cadde_keyword,
       CAST(regexp_matches({x}, '\\p{{Nd}}') AS DOUBLE) AS has_number_pattern,
       CAST(regexp_matches({x}, '(^|{d.WS})[0-9]{{5}}({d.WS}|$)') AS DOUBLE) AS has_postal_code,
       CAST(len({d.sql_words(x)}) AS DOUBLE) AS word_count,
       CAST(length({x}) AS DOUBLE) AS char_count,
       round(CASE WHEN length({x}) > 0 THEN CAST(length({x}) - length(regexp_replace({x}, '\\p{{Lu}}', '', 'g')) AS DOUBLE)
            / length({x}) ELSE 0.0 END, 6) AS uppercase_ratio"""


@query("b12_text_features", f"SELECT doc_id, {features_sql('text')} FROM documents")
def b12(spark, sf_dir):
    out = docs(spark, sf_dir).select("doc_id", *t.text_features(F.col("text")))
    return out.withColumn("uppercase_ratio", F.round("uppercase_ratio", 6))


@query(
    "b13_pattern_features",
    f"""WITH {d.ADDR}, f AS (
          SELECT addr_id, (addr_id * 37 % 100) / 100.0 AS conf,
                 (CASE WHEN city <> '' THEN 1 ELSE 0 END + CASE WHEN addr_id % 3 <> 0 THEN 1 ELSE 0 END
                  + 1 + CASE WHEN addr_id % 5 = 0 THEN 1 ELSE 0 END) / 4.0 AS share FROM addr)
        SELECT addr_id, round(CAST(conf AS DOUBLE), 6) AS pattern_confidence,
               CAST(share AS DOUBLE) AS pattern_completeness,
               round(CAST(conf AS DOUBLE) * CAST(share AS DOUBLE), 6) AS pattern_consistency FROM f""",
)
def b13(spark, sf_dir):
    k = F.col("addr_id")
    cols = t.pattern_features(
        (k * 37 % 100) / F.lit(100.0),
        F.col("city"),
        F.when(k % 3 != 0, F.col("district")).otherwise(" "),
        F.col("nbh"),
        F.when(k % 5 == 0, F.col("street")),
    )
    out = addresses(spark, sf_dir).select("addr_id", *cols)
    return out.select("addr_id", *[F.round(c, 6).alias(c) for c in out.columns if c != "addr_id"])
