"""Matching, rules, geography and the cascade on hand-made rows."""

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.operators import cascade, contract, entities, geo, landmarks, mining, patterns, rules
from semtflow.plans.section_e import dims


def one(spark, text):
    return spark.createDataFrame([(1, text)], "addr_id long, text string").withColumn("address", F.col("text"))


def test_patterns_read():
    made = {p.pattern_id: p for p in patterns.patterns()}
    assert len(made) == len(fv.PATTERNS) and [p.priority for p in patterns.patterns()] == sorted((p.priority for p in made.values()), reverse=True)
    assert [s.name for s in made["site_pattern"].slots] == ["Site", "Blok", "n", "Daire"] and made["site_pattern"].slots[1].optional


def test_match_and_slots(spark):
    hits = {r.pattern_id: r for r in patterns.match_patterns(one(spark, "moda mahalle bahariye sokak numara 12")).collect()}
    assert hits["sokak_numara_simple"].matched == "moda mahalle bahariye sokak numara 12"
    assert hits["mahalle_sokak_no"]["values"][-1] == "12"
    best = patterns.with_best_match(one(spark, "moda mahalle bahariye sokak numara 12")).first().best
    assert best.confidence > 0.6 and best.slots["n"] == "12"
    assert patterns.with_best_match(one(spark, "hiç")).first().best is None


def test_rules(spark):
    text = "Moda Mah. 12. Sokak a blok No: 5 kat 3 d12a"
    got = {(r.field, r.value) for r in rules.rule_candidates(one(spark, text), "text").collect()}
    assert {("number", "5"), ("block", "a"), ("floor", "3"), ("apartment", "12a"), ("street", "12 Sokak")} <= got
    out = rules.normalize_fallback(one(spark, text), "text").first()
    assert out.fields.neighborhood == "Moda" and out.fields.number == "5" and "Kat: 3" in out.normalized_address
    assert rules.normalize_fallback(one(spark, "12 nolu ev"), "text").first().fields.number == "12"


def test_sequential_rules_remove_what_they_took(spark):
    r = rules.rule_engine_sequential(one(spark, "Moda mahallesi No 5 daire 5 34710").select("text")).first()
    assert (r.mahalle, r.bina_no, r.posta_kodu) == ("Moda", "5", "34710")


def test_near_cities(spark):
    rows = [(1, "istanbul"), (2, "Istanbl"), (3, "xqzw"), (4, "")]
    v = {r.addr_id: r.city_v for r in geo.validate_city(spark.createDataFrame(rows, "addr_id long, c string"), "c", dims(spark)).collect()}
    assert v[1].value == "istanbul" and v[1].confidence == 1.0
    assert v[2].value == "istanbul" and v[2].warnings == ["Corrected 'Istanbl' to 'istanbul'"]
    assert not v[3].is_valid and v[3].warnings == ["City 'xqzw' not found in Turkish provinces"] and v[4].warnings == ["Empty city name"]


def test_geo_validation_keeps_one_python_function(spark):
    names = [(c, d) for c in (None, "Istanbul", "Istanbl", "xqzw") for d in (None, "Kadikoy", "Kadikoyy", "Bornov", "qqq")]
    rows = [(i, (c, d, "06100"), []) for i, (c, d) in enumerate(names)]
    df = spark.createDataFrame(rows, "addr_id long, fields struct<city:string,district:string,postcode:string>, warnings array<string>")
    out = geo.apply_geo_validation(df, dims(spark))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    alone = df.select("addr_id", F.col("fields.city").alias("c"), F.col("fields.district").alias("d"))
    alone = geo.validate_city(alone, "c", dims(spark)).withColumn("town", F.coalesce("city_v.value", "c"))
    alone = {r.addr_id: r for r in geo.validate_district(alone, "d", dims(spark), "town").collect()}
    for r in out.collect():
        c, d = alone[r.addr_id].city_v.value or alone[r.addr_id].c, alone[r.addr_id].district_v.value or alone[r.addr_id].d
        assert (r.fields.city, r.fields.district) == (c, d)


def test_postcodes(spark):
    rows = [("01000",), ("00999",), ("81999",), ("82000",), ("3471",), ("347 10",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "p string").select(geo.validate_postcode(F.col("p")).is_valid).collect()]
    assert got == [True, False, True, False, False, True, False]


def test_cascade_routes_and_contract(spark):
    rows = [
        (1, "moda mahalle bahariye sokak no 12", None, None), (2, "Moda Mah. 12. Sokak No: 5 Konak Izmir", {"city": "Izmir"}, 0.9),
        (3, "bilinmeyen", None, None), (4, None, None, None), (5, "tek kelime", {"floor": "zemin"}, 0.95),
    ]
    df = spark.createDataFrame(rows, "addr_id long, address string, ml_fields map<string,string>, ml_confidence double")
    out = cascade.normalize_addresses(df, dims(spark))
    got = {r.addr_id: r for r in out.collect()}
    assert got[1].method.startswith("pattern") and got[1].fields.number == "12"
    assert got[2].fields.city == "izmir" and got[3].method == "fallback" and got[3].success
    assert got[4].method == "error" and got[5].error == "Processing failed: invalid floor"
    good = out.filter("success").select("fields.*", "normalized_address", "confidence")
    assert contract.contract_check(good).count() == 0


def test_hybrid_layers(spark):
    df = spark.createDataFrame([(1, "moda mahalle bahariye sokak no 12"), (2, "Kadıköy İstanbul ili 5 no")], "addr_id long, address string")
    got = {r.addr_id: r for r in cascade.hybrid_normalize(df).collect()}
    assert got[1].layer == "pattern" and got[2].layer in ("legacy", "pattern") and got[2].success


def test_landmarks(spark):
    rows = [(1, "Amorium Hotel karşısı"), (2, "marketin yanı"), (3, "karşısı"), (4, "okul yolu"), (5, None)]
    got = {r.addr_id: r for r in landmarks.parse_landmark(spark.createDataFrame(rows, "addr_id long, explanation string")).collect()}
    assert (got[1].landmark, got[1].relation) == ("amorium hotel", "across_from") and got[1].landmark_confidence == 1.0
    assert got[2].landmark == "market" and got[3].landmark is None and got[4].landmark is None and got[5].landmark is None


def spans_of(spark, spans, fn):
    df = spark.createDataFrame([(spans,)], "spans array<struct<start:int,end:int,label:string>>")
    return [tuple(s) for s in df.select(fn(F.col("spans"))).first()[0]]


def test_overlaps(spark):
    """Expected spans worked out by hand: of two that meet, the longer stays, then the one that starts first."""
    cases = [
        ([(0, 5, "MAH"), (3, 9, "NO"), (8, 12, "IL")], [(3, 9, "NO")]),
        ([(0, 3, "A"), (3, 6, "C")], [(0, 3, "A"), (3, 6, "C")]),
        ([(0, 10, "X"), (2, 4, "Y"), (9, 30, "Z")], [(9, 30, "Z")]),
        ([(4, 8, "P"), (0, 4, "Q")], [(0, 4, "Q"), (4, 8, "P")]),
        ([], []),
    ]
    for given, want in cases:
        assert spans_of(spark, given, entities.resolve_overlaps_longest) == want
    assert spans_of(spark, [(0, 5, "NO"), (3, 9, "MAH"), (20, 22, "KAT")], entities.resolve_overlaps_priority) == [(3, 9, "MAH"), (20, 22, "KAT")]


def test_labels(spark):
    df = spark.createDataFrame([(1, "moda mahallesi bahariye caddesi no 12 kat 3 bornova izmir")], "addr_id long, text string")
    got = {(s.label, df.first().text[s.start:s.end]) for s in entities.label_entities_v2(df).first().spans}
    assert ("IL", "izmir") in got and ("ILCE", "bornova") in got and ("NO", "12") in got and ("MAH", "moda mahallesi") in got


def test_cluster_similarity_near_all_pairs(spark):
    texts = [f"moda mahalle {w} sokak no {i % 7}" for i, w in enumerate("bahar cumhuriyet inonu ataturk gunes deniz lale gul menekse papatya".split() * 3)]
    df = spark.createDataFrame([(i, 0, x) for i, x in enumerate(texts)], "addr_id long, cluster long, text string")
    sims = []
    for i, a in enumerate(texts):
        for b in texts[i + 1:]:
            x, y = set(a.split()), set(b.split())
            sims.append((len(x & y) / len(x | y), min(len(a), len(b)) / max(len(a), len(b))))
    got = mining.cluster_similarity(df).first()
    assert abs(got.length_similarity - sum(s[1] for s in sims) / len(sims)) < 1e-9
    assert abs(got.jaccard - sum(s[0] for s in sims) / len(sims)) < 0.08


def test_province_suggestion_takes_a_value_apart_once(spark):
    values = ["İstanbul", "istanbu", "ISTANBUL", "ankra", "x", "", " ", "Aydın ", "kara", "Muğl", "nigde", "Zzyzx", "Şanlıurfa merkez", "IĞDIR", None]
    rows = spark.createDataFrame([(v,) for v in values], "v string")

    def suggested(v):
        low = v.lower()
        for p in fv.LEGACY_PROVINCES:
            a, b = set(low), set(p.lower())
            if low == p.lower() or p.lower().startswith(low) or low.startswith(p.lower()) or len(a & b) / len(a | b) > 0.8:
                return p

    out = rows.select("v", rules.legacy_province_suggest(F.col("v")).alias("s"))
    assert {r.v: r.s for r in out.collect()} == {v: None if v is None else suggested(v) for v in values}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("lower(") == 1  # and not for each of the provinces
