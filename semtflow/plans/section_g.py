"""Queries of the entity section (G) and generated benchmark addresses (M11)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators import entities as en
from semtflow.operators import evaluation as ev
from semtflow.operators import tagging as tg
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import addresses, metric_events


def cleaned(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", t.clean_text(F.col("address")).alias("text"))


def _say(df):
    one = lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"), s["label"])
    return df.select("addr_id", "text", F.array_join(F.transform("spans", one), ";").alias("spans"))


@query("g01_label_entities_v1")
def g01(spark, sf_dir):
    return _say(en.label_entities_v1(cleaned(spark, sf_dir)))


@query("g02_label_entities_v2")
def g02(spark, sf_dir):
    return _say(en.label_entities_v2(cleaned(spark, sf_dir)))


def loose_spans(spark, sf_dir):
    """Span arrays with nested, equal and touching members, from keys."""
    k = F.col("addr_id").cast("int")
    s = lambda a, b, label: F.struct(a.cast("int").alias("start"), b.cast("int").alias("end"), F.lit(label).alias("label"))
    a = addresses(spark, sf_dir)
    return a.select("addr_id", F.lit("").alias("text"), F.array(
        s(k % 7, k % 7 + 5, "ILCE"), s(k % 5, k % 5 + 9, "NO"), s(k % 11, k % 11 + 3, "MAH"), s(k % 3 + 10, k % 3 + 14, "SOKAK"), s(k % 3 + 10, k % 3 + 14, "KAT")).alias("spans"))


@query("g03_resolve_overlaps_longest")
def g03(spark, sf_dir):
    return _say(loose_spans(spark, sf_dir).withColumn("spans", en.resolve_overlaps_longest(F.col("spans"))))


@query("g04_resolve_overlaps_priority")
def g04(spark, sf_dir):
    return _say(loose_spans(spark, sf_dir).withColumn("spans", en.resolve_overlaps_priority(F.col("spans"))))


def ner_table(spark, sf_dir):
    return en.build_ner_table(addresses(spark, sf_dir).select("addr_id", "address"))


@query("g05_build_ner_table")
def g05(spark, sf_dir):
    return _say(ner_table(spark, sf_dir))


@query("g06_train_test_split", f"WITH {d.ADDR} SELECT addr_id, CASE WHEN addr_id * 7919 % 100 < 80 THEN 'train' ELSE 'test' END AS split FROM addr")
def g06(spark, sf_dir):
    return en.train_test_split(addresses(spark, sf_dir).select("addr_id"))


GOLD = """gs AS (SELECT addr_id, 0 AS "start", length(nbh) AS "end", 'MAH' AS label, nbh AS text, 0.9::DOUBLE AS confidence FROM addr
   UNION ALL SELECT addr_id, instr(address, street) - 1, instr(address, street) - 1 + length(street), CASE WHEN addr_id % 2 = 0 THEN 'CADDE' ELSE 'SOKAK' END, street, 0.8 FROM addr
   UNION ALL SELECT addr_id, instr(address, 'No:') + 2, instr(address, 'No:') + 2 + length(number), 'NO', number, (addr_id % 10) / 10.0 FROM addr WHERE addr_id % 6 > 0),
   pr AS (SELECT addr_id, "start", CASE WHEN addr_id % 5 = 0 THEN "end" + 1 ELSE "end" END AS "end", label, text, confidence FROM gs WHERE NOT (addr_id % 4 = 0 AND label = 'NO'))"""


def gold(spark, sf_dir):
    """Spans with text and confidence, from the parts of the derived address."""
    a = addresses(spark, sf_dir)
    k = F.col("addr_id")
    at = F.expr("locate(street, address) - 1")
    no = F.expr("locate('No:', address) + 2")
    row = lambda s, e, label, x, c: F.struct(s.cast("int").alias("start"), e.cast("int").alias("end"), label.alias("label"), x.alias("text"), c.cast("double").alias("confidence"))
    rows = F.array_compact(F.array(
        row(F.lit(0), F.length("nbh"), F.lit("MAH"), F.col("nbh"), F.lit(0.9)),
        row(at, at + F.length("street"), F.when(k % 2 == 0, "CADDE").otherwise("SOKAK"), F.col("street"), F.lit(0.8)),
        F.when(k % 6 > 0, row(no, no + F.length("number"), F.lit("NO"), F.col("number"), k % 10 / 10.0))))
    return a.select("addr_id", F.explode_outer(rows).alias("s")).select("addr_id", "s.*")


def predicted(spark, sf_dir):
    k = F.col("addr_id")
    return gold(spark, sf_dir).filter(~((k % 4 == 0) & (F.col("label") == "NO"))).withColumn("end", F.when(k % 5 == 0, F.col("end") + 1).otherwise(F.col("end")))


@query("g07_label_stats", f"WITH {d.ADDR}, {GOLD} SELECT label, count(*) AS n_spans, count(DISTINCT addr_id) AS n_examples FROM gs GROUP BY 1")
def g07(spark, sf_dir):
    return ev.label_stats(gold(spark, sf_dir))


def bio(spark, sf_dir):
    return en.bio_tags(ner_table(spark, sf_dir).select("addr_id", "text", "spans"))


@query("g08_bio_tags")
def g08(spark, sf_dir):
    return bio(spark, sf_dir).select("addr_id", "i", "token", "tag")


@query("g09_train_tagger")
def g09(spark, sf_dir):
    """Held-out token accuracy per tag."""
    data = en.tag_counts(en.train_test_split(bio(spark, sf_dir)), ["split"])
    model = en.train_tagger(data.filter("split = 'train'"))
    test = en.tag_tokens(data.filter("split = 'test'"), model)
    right = F.sum(F.when(F.col("predicted") == F.col("tag"), F.col("n")).otherwise(0))
    return rounded(test.groupBy("tag").agg(F.sum("n").alias("n"), (right / F.sum("n")).alias("accuracy")))


@query("g10_tag_entities")
def g10(spark, sf_dir):
    """A tagger of the training rows, applied in the row to the others."""
    data = en.train_test_split(cleaned(spark, sf_dir))
    learnt = en.bio_tags(en.label_entities_v2(data.filter("split = 'train'")).select("addr_id", "text", "spans"))
    tagged = tg.tag_rows(data.filter("split = 'test'"), tg.fit_tagger(learnt))
    return rounded(tagged.select("addr_id", F.explode("entities").alias("e")).select("addr_id", "e.*"), 3)


@query(
    "g11_entities_to_fields",
    f"""WITH {d.ADDR}, {GOLD} SELECT addr_id, max(CASE WHEN label = 'MAH' THEN text END) AS neighborhood, max(CASE WHEN label = 'NO' THEN text END) AS number,
        max(CASE WHEN label IN ('CADDE', 'SOKAK') THEN text END) AS street, NULL::VARCHAR AS city, NULL::VARCHAR AS district, NULL::VARCHAR AS floor, NULL::VARCHAR AS apartment,
        NULL::VARCHAR AS block FROM gs GROUP BY 1""",
)
def g11(spark, sf_dir):
    return ev.entities_to_fields(gold(spark, sf_dir))


@query(
    "g12_ml_confidence",
    f"""WITH {d.ADDR}, {GOLD}, a AS (SELECT addr_id, avg(confidence) AS c, count(DISTINCT label) AS labels FROM gs GROUP BY 1)
        SELECT addr_id, round(c, 6) AS confidence, labels, round(least(1.0, c + CASE WHEN labels >= 3 THEN 0.1 ELSE 0 END), 6) AS sequence_confidence FROM a""",
)
def g12(spark, sf_dir):
    return rounded(ev.ml_confidence(gold(spark, sf_dir)))


@query(
    "g13_ml_fallback_select",
    f"""WITH {d.EVENTS}, s AS (SELECT event_id, CASE WHEN event_id % 7 > 0 THEN confidence END AS p, CASE WHEN event_id % 5 > 0 THEN (event_id * 31 % 100) / 100.0::DOUBLE END AS m, event_id % 3 > 0 AS ok FROM ev),
        z AS (SELECT *, CASE WHEN p >= 0.5 THEN 'pattern_matching' WHEN ok AND m IS NOT NULL THEN 'ml_fallback' WHEN ok AND p IS NOT NULL THEN 'pattern_matching_fallback'
          WHEN p IS NOT NULL THEN 'pattern_matching_only' ELSE 'unknown' END AS method FROM s)
        SELECT event_id, method, CASE WHEN method = 'ml_fallback' THEN m ELSE coalesce(p, 0) END AS confidence, method = 'ml_fallback' AS fallback_used FROM z""",
)
def g13(spark, sf_dir):
    k = F.col("event_id")
    s = metric_events(spark, sf_dir).select("event_id", F.when(k % 7 > 0, F.col("confidence")).alias("pattern_confidence"),
                                            F.when(k % 5 > 0, k * 31 % 100 / F.lit(100.0)).alias("ml_confidence"), (k % 3 > 0).alias("ml_available"))
    return ev.ml_fallback_select(s).select("event_id", "method", "confidence", "fallback_used")


def _prf_sql(key: str) -> str:
    head, group = (f"{key}, ", f"GROUP BY {key}") if key else ("", "")
    return f"""WITH {d.ADDR}, {GOLD}, j AS (SELECT label, p.x AS p, g.x AS g FROM (SELECT DISTINCT addr_id, "start", "end", label, 1 AS x FROM pr) p
        FULL JOIN (SELECT DISTINCT addr_id, "start", "end", label, 1 AS x FROM gs) g USING (addr_id, "start", "end", label)),
        a AS (SELECT {head}count(p) AS total_predicted, count(g) AS total_gold, count(*) FILTER (p = 1 AND g = 1) AS total_correct FROM j {group}),
        b AS (SELECT *, total_correct / total_predicted AS p, total_correct / total_gold AS r FROM a)
        SELECT {head}total_predicted, total_gold, total_correct, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / (p + r), 6) AS f1 FROM b"""


@query("g14_span_prf", _prf_sql(""))
def g14(spark, sf_dir):
    return rounded(ev.span_prf(predicted(spark, sf_dir), gold(spark, sf_dir)))


@query("g14_span_prf_by_label", _prf_sql("label"))
def g14_label(spark, sf_dir):
    return rounded(ev.span_prf(predicted(spark, sf_dir), gold(spark, sf_dir), by_label=True))


@query(
    "g15_prediction_coverage",
    f"""WITH {d.ADDR}, {GOLD}, k AS (SELECT addr_id, count(*) AS k FROM gs WHERE label = 'NO' GROUP BY 1)
        SELECT count(*) AS total_addresses, count(k) AS addresses_with_entities, round(count(k) / count(*) * 100, 6) AS coverage_percentage, CAST(sum(k) AS BIGINT) AS total_entities,
               round(sum(k) / count(*), 6) AS avg_entities_per_address FROM addr LEFT JOIN k USING (addr_id)""",
)
def g15(spark, sf_dir):
    return rounded(ev.prediction_coverage(gold(spark, sf_dir).filter("label = 'NO'"), addresses(spark, sf_dir).select("addr_id")))


@query(
    "g16_model_comparison",
    f"""WITH {d.EVENTS}, a AS (SELECT pattern_id AS metric, avg(confidence) AS v FROM ev WHERE user_id % 2 = 0 GROUP BY 1), b AS (SELECT pattern_id AS metric, avg(confidence) AS v FROM ev
        WHERE user_id % 2 = 1 AND pattern_id <> 'view' GROUP BY 1)
        SELECT metric, round(a.v, 6) AS original, round(b.v, 6) AS improved, round((b.v - a.v) / a.v * 100, 6) AS change_pct FROM a FULL JOIN b USING (metric)""",
)
def g16(spark, sf_dir):
    e = metric_events(spark, sf_dir)
    one = lambda c: e.filter(c).groupBy(F.col("pattern_id").alias("metric")).agg(F.avg("confidence").alias("value"))
    return rounded(ev.model_comparison(one(F.col("user_id") % 2 == 0), one((F.col("user_id") % 2 == 1) & (F.col("pattern_id") != "view"))))


SYNTH = f"sy AS (SELECT {', '.join(en.synth_select('o_orderkey'))} FROM orders)"


def synth(spark, sf_dir):
    return en.synth_addresses(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderkey")


@query("g17_synth_addresses", f"WITH {SYNTH} SELECT * FROM sy")
def g17(spark, sf_dir):
    return synth(spark, sf_dir)


@query(
    "g18_augment_addresses",
    f"""WITH {SYNTH}, v AS (SELECT addr_id, text, replace(replace(replace(text, 'mahallesi', 'mah'), 'caddesi', 'cad'), 'sokak', 'sok') AS s,
          replace(replace(replace(text, ' no ', ' no: '), ' daire ', ' d. '), ' kat ', ' k. ') AS p FROM sy)
        SELECT addr_id, 'plain' AS variant, text FROM v UNION ALL SELECT addr_id, 'short', s FROM v WHERE addr_id % 10 < 3 AND s <> text
        UNION ALL SELECT addr_id, 'upper', upper(text) FROM v WHERE addr_id % 10 < 3 UNION ALL SELECT addr_id, 'punct', p FROM v WHERE addr_id % 10 < 3 AND p <> text""",
)
def g18(spark, sf_dir):
    return en.augment_addresses(synth(spark, sf_dir))


@query(
    "g19_components_to_spans",
    f"""WITH {d.ADDR}, e AS (SELECT addr_id, address, 'city' AS name, city AS value FROM addr UNION ALL SELECT addr_id, address, 'street', street FROM addr
          UNION ALL SELECT addr_id, address, 'postcode', postcode_in FROM addr)
        SELECT addr_id, instr(address, value) - 1 AS "start", instr(address, value) - 1 + length(value) AS "end", upper(name) AS label, value AS text FROM e
        WHERE value <> '' AND instr(address, value) > 0""",
)
def g19(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", F.col("address").alias("text"), F.create_map(
        F.lit("city"), F.col("city"), F.lit("street"), F.col("street"), F.lit("postcode"), F.col("postcode_in")).alias("components"))
    return en.components_to_spans(a)


@query(
    "g20_component_key_prf",
    f"""WITH {d.ADDR}, s AS (SELECT addr_id, addr_id % 13 > 0 AS ok, 2 + (addr_id % 3 = 0)::INT AS np, 2 + (addr_id % 4 = 0)::INT AS ne, 1 + (addr_id % 3 = 0 AND addr_id % 4 = 0)::INT AS hit,
          CASE WHEN addr_id % 2 = 0 THEN 'ml' ELSE 'pattern' END AS method FROM addr),
        x AS (SELECT method, CASE WHEN ok THEN hit / np ELSE 0 END AS p, CASE WHEN ok THEN hit / ne ELSE 0 END AS r FROM s)
        SELECT method, count(*) AS total_cases, round(avg(p), 6) AS precision, round(avg(r), 6) AS recall, round(avg(coalesce(2 * p * r / nullif(p + r, 0), 0)), 6) AS f1_score FROM x GROUP BY 1""",
)
def g20(spark, sf_dir):
    k = F.col("addr_id")
    names = lambda *xs: F.array_compact(F.array(*xs))
    a = addresses(spark, sf_dir).select(
        names(F.lit("city"), F.lit("floor"), F.when(k % 3 == 0, "street")).alias("predicted"), names(F.lit("city"), F.lit("number"), F.when(k % 4 == 0, "street")).alias("expected"),
        (k % 13 > 0).alias("success"), F.when(k % 2 == 0, "ml").otherwise("pattern").alias("method"))
    return rounded(ev.component_key_prf(a))


@query("m11_generate_benchmark_addresses", f"SELECT {', '.join(en.benchmark_columns('o_orderkey'))} FROM orders")
def m11(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*en.benchmark_columns("o_orderkey"))
