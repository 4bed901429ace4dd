"""Queries of the pattern mining section (L)."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators import mining as m
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_j import rounded
from semtflow.sources.derived import addresses, metric_events
from semtflow.session import checkpointed

TEXT = f"tx AS (SELECT addr_id, {d.fold('address')} AS text, length({d.fold('address')}) // 20 AS cluster FROM addr)"


def corpus(spark, sf_dir):
    """Folded addresses clustered by length bucket."""
    a = addresses(spark, sf_dir).select("addr_id", t.ascii_fold(F.col("address")).alias("text"))
    return a.withColumn("cluster", F.floor(F.length("text") / 20))


_KW = ", ".join(f"round(avg(contains(lower(text), '{w}')::INT), 6) AS share_{w}" for w in m.KEYWORDS)
_N = "nullif(length(text), 0)"
_ST = {
    "length": "length(text)", "tokens": f"len({d.sql_words('text')})", "digit_ratio": f"(length(text) - length(regexp_replace(text, '\\p{{Nd}}', '', 'g')))::DOUBLE / {_N}",
    "alpha_ratio": f"(length(text) - length(regexp_replace(text, '\\p{{L}}', '', 'g')))::DOUBLE / {_N}", "space_ratio": f"(length(text) - length(replace(text, ' ', '')))::DOUBLE / {_N}",
    "commas": "length(text) - length(replace(text, ',', ''))", "numbers": "len(regexp_extract_all(text, '[0-9]+'))"}
_AG = ", ".join(f"round({f}({e}), 6)::DOUBLE AS {k}_{n}" for k, e in _ST.items() for n, f in (("mean", "avg"), ("std", "stddev_pop"), ("min", "min"), ("max", "max")))


@query("l01_corpus_features", f"SELECT count(*) AS n_rows, {_AG}, {_KW} FROM documents")
def l01(spark, sf_dir):
    return rounded(m.corpus_features(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def features(spark, sf_dir):
    return m.feature_matrix(corpus(spark, sf_dir).select("addr_id", "text"))


def kept_features(spark, sf_dir):
    """Features written once: every pass of a clustering would compute them again."""
    return checkpointed(features(spark, sf_dir))


@query("l02_feature_matrix")
def l02(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    f = features(spark, sf_dir).withColumn("v", vector_to_array("features"))
    return rounded(f.select("addr_id", F.size("v").alias("n_features"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x).alias("total")), 4)


@query("l03_cluster_kmeans")
def l03(spark, sf_dir):
    return m.cluster_kmeans(kept_features(spark, sf_dir), 4).select("addr_id", "cluster")


@query("l05_cluster_gmm")
def l05(spark, sf_dir):
    return m.cluster_gmm(kept_features(spark, sf_dir), 3).select("addr_id", "cluster")


@query("l06_choose_k")
def l06(spark, sf_dir):
    rows = kept_features(spark, sf_dir)
    return rounded(spark.createDataFrame(m.choose_k(rows), "k int, silhouette double"), 4)


LENS = """hs AS (SELECT cluster, length(text) AS len, count(*) AS c FROM tx GROUP BY 1, 2),
   ls AS (SELECT a.cluster, a.len, a.c, sum(b.c * least(a.len, b.len)::DOUBLE / greatest(a.len, b.len)) - 1 AS rs FROM hs a JOIN hs b USING (cluster) GROUP BY 1, 2, 3),
   lt AS (SELECT cluster, sum(c) AS n, sum(c * rs) AS ratios FROM ls GROUP BY 1)"""
MINHASH = f"""tk AS (SELECT addr_id, cluster, text, list_distinct({d.sql_words('lower(text)')}) AS tk FROM tx),
   mh AS (SELECT addr_id, cluster, h, list_min(list_transform(tk, lambda w: md5(h || ':' || w))) AS m FROM tk, (SELECT unnest(range(1, {m.HASHES + 1})) AS h)),
   mg AS (SELECT cluster, h, m, count(*) AS c FROM mh GROUP BY 1, 2, 3), mp AS (SELECT cluster, sum(c * (c - 1)) / {m.HASHES}.0::DOUBLE AS same FROM mg GROUP BY 1)"""
SIM = f"{d.ADDR}, {TEXT}, {LENS}, {MINHASH}, sm AS (SELECT cluster, n, same / (n * (n - 1)) AS j, ratios / (n * (n - 1)) AS r FROM mp JOIN lt USING (cluster) WHERE n > 1)"


@query(
    "l07_cluster_similarity",
    f"WITH {SIM} SELECT cluster, CAST(n AS BIGINT) AS n, round(j, 6) AS jaccard, round(r, 6) AS length_similarity, round(j * 0.7 + r * 0.3, 6) AS similarity FROM sm",
)
def l07(spark, sf_dir):
    return rounded(m.cluster_similarity(corpus(spark, sf_dir)))


@query("l08_cluster_confidence", f"WITH {SIM} SELECT cluster, CAST(n AS BIGINT) AS n, round((j * 0.7 + r * 0.3) * 0.7 + least(1.0, n / 20.0) * 0.3, 3)::DOUBLE AS confidence FROM sm")
def l08(spark, sf_dir):
    return m.cluster_confidence(m.cluster_similarity(corpus(spark, sf_dir)))


@query(
    "l09_representative",
    f"""WITH {SIM}, sr AS (SELECT mh.cluster, addr_id, sum(c - 1) / {m.HASHES}.0::DOUBLE AS same FROM mh JOIN mg USING (cluster, h, m) GROUP BY 1, 2),
        rr AS (SELECT tx.cluster, tx.addr_id, round((same * 0.7 + rs * 0.3) / (n - 1), 9) AS s FROM tx JOIN sr USING (cluster, addr_id) JOIN ls ON ls.cluster = tx.cluster AND ls.len = length(tx.text)
          JOIN lt ON lt.cluster = tx.cluster WHERE n > 1)
        SELECT cluster, addr_id, round(s, 6) AS mean_similarity FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY s DESC, addr_id) AS i FROM rr) WHERE i = 1""",
)
def l09(spark, sf_dir):
    return rounded(m.representative(corpus(spark, sf_dir)))


_P = {n: x for n, _, x in m.PARTS}
PATS = f"""pp AS (SELECT cluster, count(*) AS n, min(text) AS example, max(contains(lower(text), 'mahalle')) AS a, max(contains(lower(text), 'sokak')) AS b, max(contains(lower(text), 'cadde')) AS c,
     max(regexp_matches(lower(text), 'no:?\\s*\\d+')) AS e FROM tx GROUP BY 1),
   pr AS (SELECT cluster, n, example, coalesce(nullif(concat_ws('{m.GLUE}', CASE WHEN a THEN '{_P['mahalle']}' END, CASE WHEN b THEN '{_P['sokak']}' END, CASE WHEN c THEN '{_P['cadde']}' END,
     CASE WHEN e THEN '{_P['no']}' END), ''), '{m.ANY}') AS regex FROM pp),
   pt AS (SELECT cluster, n, regex, 'pattern_' || substr(md5(regex), 1, 8) AS pattern_id, least(n / 10.0, 1.0)::DOUBLE AS coverage, example FROM pr)"""


def mined(spark, sf_dir):
    return m.synthesize_patterns(corpus(spark, sf_dir))


@query("l10_synthesize_pattern", f"WITH {d.ADDR}, {TEXT}, {PATS} SELECT * FROM pt")
def l10(spark, sf_dir):
    return mined(spark, sf_dir)


@query("l11_suggest_patterns")
def l11(spark, sf_dir):
    rows = kept_features(spark, sf_dir)
    points = m.feature_points(rows)
    k = m.choose_k(rows, points=points)[0][0]
    return rounded(m.suggest_patterns(rows, k, min_confidence=0.3, points=points).select("pattern_id", "regex", "confidence", "coverage"), 3)


@query("l12_length_bucket_clusters", "SELECT length(text) // 20 AS bucket, count(*) AS cluster_size, 0.3::DOUBLE AS confidence FROM documents GROUP BY 1 HAVING count(*) >= 3")
def l12(spark, sf_dir):
    return m.length_bucket_clusters(spark.read.parquet(f"{sf_dir}/documents.parquet"))


PATTERNS = [("p_no", "no:? *([0-9]+)", 1), ("p_mah", "([a-z]+) mah[a-z.]* ([a-z]+)", 2), ("p_kat", "kat ([0-9]+) daire ([0-9]+)", 2), ("p_zip", " (06[0-9]{3})", 1)]
_HITS = " UNION ALL ".join(
    f"SELECT addr_id, text, '{p}' AS pattern_id, regexp_matches(text, '{x}') AS hit, [{', '.join(f'''regexp_extract(text, '{x}', {i + 1})''' for i in range(g))}] AS groups FROM tx" for p, x, g in PATTERNS)
HITS = f"{d.ADDR}, {TEXT}, hh AS ({_HITS})"
COVERAGE = """cv AS (SELECT pattern_id, avg(hit::INT) AS match_rate, count(*) FILTER (hit) AS total_matches, max(len(groups)) AS ng,
     sum(CASE WHEN hit THEN len(list_filter(groups, lambda g: trim(g) <> '')) ELSE 0 END) AS filled FROM hh GROUP BY 1),
   cw AS (SELECT pattern_id, match_rate, total_matches, coalesce(filled / nullif(total_matches * ng, 0), 0) AS field_coverage, CASE WHEN total_matches > 0 THEN ng ELSE 0 END::DOUBLE AS avg_groups_per_match FROM cv)"""


def hits(spark, sf_dir):
    return m.pattern_hits(corpus(spark, sf_dir).select("addr_id", "text"), PATTERNS)


@query(
    "l13_pattern_coverage",
    f"WITH {HITS}, {COVERAGE} SELECT pattern_id, round(match_rate, 6) AS match_rate, total_matches, round(field_coverage, 6) AS field_coverage, round(least(1, field_coverage), 6) AS completeness, avg_groups_per_match FROM cw",
)
def l13(spark, sf_dir):
    return rounded(m.pattern_coverage(hits(spark, sf_dir)))


@query(
    "l14_pattern_accuracy",
    f"""WITH {HITS}, x AS (SELECT pattern_id, hit, groups, [number] AS expected FROM hh JOIN addr USING (addr_id)),
        a AS (SELECT pattern_id, count(*) AS n, count(*) FILTER (hit AND groups = expected) AS ok, sum(CASE WHEN hit THEN len(groups) ELSE 0 END) AS said, sum(len(expected)) AS asked FROM x GROUP BY 1)
        SELECT pattern_id, round(ok / n, 6) AS accuracy, round(coalesce(ok / nullif(said, 0), 0), 6) AS precision, round(ok / asked, 6) AS recall FROM a""",
)
def l14(spark, sf_dir):
    a = addresses(spark, sf_dir).select("addr_id", t.ascii_fold(F.col("address")).alias("text"), F.array("number").alias("expected"))
    return rounded(m.pattern_accuracy(m.pattern_hits(a, PATTERNS)))


_CX = ", ".join(f"CAST({e} AS {'DOUBLE' if n.endswith('score') else 'BIGINT'}) AS {n}" for n, e in m.COMPLEXITY.items())
CX = f"{d.ADDR}, {TEXT}, {PATS}, cx AS (SELECT pattern_id, regex, cluster, {_CX} FROM pt)"


@query("l15_regex_complexity", f"WITH {CX} SELECT cluster, pattern_id, {', '.join(f'round({n}, 6) AS {n}' if n.endswith('score') else n for n in m.COMPLEXITY)} FROM cx")
def l15(spark, sf_dir):
    return rounded(m.regex_complexity(mined(spark, sf_dir)).select("cluster", "pattern_id", *m.COMPLEXITY))


_DIM = "pdim(pattern_id, regex) AS (VALUES " + ", ".join(f"('{p}', '{x}')" for p, x, _ in PATTERNS) + ")"
QUAL = f"{HITS}, {COVERAGE}, {_DIM}, qx AS (SELECT pattern_id, regex, {_CX} FROM pdim), qy AS (SELECT *, least(1, field_coverage) AS completeness FROM qx JOIN cw USING (pattern_id)), qq AS (SELECT *, CAST({m.QUALITY} AS DOUBLE) AS quality FROM qy)"


def quality(spark, sf_dir):
    dim = spark.createDataFrame([(p, x) for p, x, _ in PATTERNS], "pattern_id string, regex string")
    return m.pattern_quality(dim, m.pattern_coverage(hits(spark, sf_dir)))


@query("l16_pattern_quality", f"WITH {QUAL} SELECT pattern_id, round(quality, 6) AS quality, {m.QUALITY_LEVEL} AS level FROM qq")
def l16(spark, sf_dir):
    return rounded(quality(spark, sf_dir).select("pattern_id", "quality", "level"))


@query("l17_rank_patterns", f"WITH {QUAL} SELECT pattern_id, rank() OVER (ORDER BY quality DESC) AS rank, round(quality, 6) AS quality, round(avg(quality) OVER (), 6) AS mean_quality FROM qq")
def l17(spark, sf_dir):
    return rounded(m.rank_patterns(quality(spark, sf_dir)).select("pattern_id", F.col("rank").cast("long").alias("rank"), "quality", "mean_quality"))


@query(
    "l18_example_diversity",
    f"""WITH {d.ADDR}, {TEXT}, w AS (SELECT cluster, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) AS w FROM tx), a AS (SELECT cluster, count(DISTINCT w) / count(w) AS wd FROM w GROUP BY 1),
        b AS (SELECT cluster, least(stddev_pop(length(text)) / 50, 1.0) AS ld, count(DISTINCT regexp_replace(regexp_replace(text, '[0-9]+', 'NUM', 'g'), '[a-zA-Z0-9_]+', 'WORD', 'g')) / count(*) AS sd FROM tx GROUP BY 1)
        SELECT cluster, round(wd, 6) AS word_diversity, round(ld, 6) AS length_diversity, round(sd, 6) AS structure_diversity, round((wd + ld + sd) / 3, 6) AS diversity FROM a JOIN b USING (cluster)""",
)
def l18(spark, sf_dir):
    return rounded(m.example_diversity(corpus(spark, sf_dir)))


_CC = ", ".join(f"round(avg(hit::INT) FILTER (contains(lower(text), '{c}')), 6) AS with_{c}" for c in m.COMPONENTS)


@query("l21_component_coverage", f"WITH {HITS} SELECT pattern_id, round(avg(hit::INT), 6) AS overall, {_CC} FROM hh GROUP BY 1")
def l21(spark, sf_dir):
    return rounded(m.component_coverage(hits(spark, sf_dir)))


@query(
    "l23_overlap_conflicts",
    f"""WITH {HITS}, p AS (SELECT a.pattern_id AS existing_id, b.pattern_id AS new_id, count(*) FILTER (a.groups <> b.groups) AS cf, count(*) FILTER (a.groups = b.groups) AS ov
          FROM hh a JOIN hh b ON a.addr_id = b.addr_id AND a.pattern_id < b.pattern_id WHERE a.hit AND b.hit GROUP BY 1, 2), n AS (SELECT count(DISTINCT addr_id) AS n FROM hh),
        x AS (SELECT existing_id, new_id, CASE WHEN cf > 0 THEN 'regex_overlap' WHEN ov > n * 0.5 THEN 'pattern_redundancy' END AS type, CASE WHEN cf > 2 THEN 3 ELSE 2 END AS severity_rank,
          round(CASE WHEN cf > 0 THEN cf ELSE ov END / n, 6) AS ratio FROM p, n) SELECT * FROM x WHERE type IS NOT NULL""",
)
def l23(spark, sf_dir):
    return rounded(m.overlap_conflicts(hits(spark, sf_dir)))


def described(spark, sf_dir):
    """Mined patterns as a conflict side: fields from their parts, description from their example."""
    p = mined(spark, sf_dir)
    parts = F.array_compact(F.array(*[F.when(F.col("regex").contains(f"<{n}>"), n) for n, _, _ in m.PARTS]))
    return p.select(F.concat_ws("_", "pattern_id", F.col("cluster").cast("string")).alias("pattern_id"), "regex", parts.alias("fields"), F.col("example").alias("description"))


def pairs(spark, sf_dir, kind):
    one = described(spark, sf_dir)
    return m.sharing_pairs(one.limit(0), one, kind)


PAIRS = f"""{CX}, ds AS (SELECT pattern_id || '_' || CAST(cluster AS VARCHAR) AS pattern_id, regex, example AS description, list_filter(['mahalle', 'sokak', 'cadde', 'no'], lambda n: contains(regex, '<' || n || '>')) AS fields FROM pt),
   pa AS (SELECT a.pattern_id AS existing_id, b.pattern_id AS new_id, a.fields AS af, b.fields AS bf, a.regex AS ar, b.regex AS br, list_distinct({d.sql_words('lower(a.description)')}) AS aw,
     list_distinct({d.sql_words('lower(b.description)')}) AS bw FROM ds a JOIN ds b ON a.pattern_id < b.pattern_id)"""
_UNION = lambda a, b: f"len(list_distinct(list_concat({a}, {b})))"
FIELD = f"SELECT existing_id, new_id, 'field_mapping' AS type, 2 AS severity_rank, round(len(list_intersect(af, bf)) / {_UNION('af', 'bf')}, 6) AS ratio FROM pa WHERE len(list_intersect(af, bf)) > 0"
SEMANTIC = f"SELECT existing_id, new_id, 'semantic_overlap' AS type, 1 AS severity_rank, round(len(list_intersect(aw, bw)) / {_UNION('aw', 'bw')}, 6) AS ratio FROM pa WHERE len(list_intersect(aw, bw)) > 2 AND len(list_intersect(aw, bw)) / {_UNION('aw', 'bw')} > 0.3"


@query("l24_field_conflicts", f"WITH {PAIRS} {FIELD}")
def l24(spark, sf_dir):
    return rounded(m.field_conflicts(pairs(spark, sf_dir, "field_mapping")))


@query(
    "l25_complexity_conflicts",
    f"""WITH {PAIRS}, k AS (SELECT pattern_id || '_' || CAST(cluster AS VARCHAR) AS id, performance_cost AS pc FROM cx)
        SELECT existing_id, new_id, 'performance' AS type, 1 AS severity_rank, round(b.pc / a.pc, 6) AS ratio FROM pa JOIN k a ON a.id = existing_id JOIN k b ON b.id = new_id WHERE b.pc > a.pc * 2 AND b.pc > 100""",
)
def l25(spark, sf_dir):
    one = described(spark, sf_dir)
    costs = m.regex_complexity(one)
    return rounded(m.complexity_conflicts(m.costly_pairs(one.limit(0), one, costs), costs))


@query("l26_semantic_conflicts", f"WITH {PAIRS} {SEMANTIC}")
def l26(spark, sf_dir):
    return rounded(m.semantic_conflicts(pairs(spark, sf_dir, "semantic_overlap")))


WORST = f"""al AS ({FIELD} UNION ALL {SEMANTIC}), wr AS (SELECT *, row_number() OVER (PARTITION BY existing_id, new_id ORDER BY severity_rank DESC, type DESC) AS i FROM al),
   wc AS (SELECT substr(md5(existing_id || '|' || new_id), 1, 8) AS conflict_id, existing_id, new_id, type, severity_rank, ratio FROM wr WHERE i = 1)"""


def conflicts(spark, sf_dir):
    return m.worst_conflicts(m.field_conflicts(pairs(spark, sf_dir, "field_mapping")).unionByName(m.semantic_conflicts(pairs(spark, sf_dir, "semantic_overlap"))))


@query("l27_detect_conflicts", f"WITH {PAIRS}, {WORST} SELECT * FROM wc")
def l27(spark, sf_dir):
    return rounded(conflicts(spark, sf_dir))


@query(
    "l28_keyword_conflicts",
    f"""WITH {PAIRS}, k AS (SELECT existing_id, new_id, list_distinct(regexp_extract_all(lower(ar), '[a-z]{{3,}}')) AS a, list_distinct(regexp_extract_all(lower(br), '[a-z]{{3,}}')) AS b FROM pa)
        SELECT existing_id, new_id, 'keyword_overlap' AS type, 1 AS severity_rank, round(len(list_intersect(a, b)) / {_UNION('a', 'b')}, 6) AS ratio FROM k WHERE len(list_intersect(a, b)) > 0""",
)
def l28(spark, sf_dir):
    return rounded(m.keyword_conflicts(pairs(spark, sf_dir, "keyword_overlap")))


_RES = "rs(type, strategy, confidence) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in m.RESOLUTIONS) + ")"


@query("l29_conflict_resolutions", f"WITH {PAIRS}, {WORST}, {_RES} SELECT conflict_id, type, strategy, confidence FROM wc JOIN rs USING (type) UNION ALL SELECT conflict_id, type, 'manual_review', 1.0 FROM wc")
def l29(spark, sf_dir):
    return m.conflict_resolutions(conflicts(spark, sf_dir))


SESSIONS = [
    "event_id AS session_id", "'r' || CAST(user_id % 5 AS VARCHAR(5)) AS reviewer", "CASE user_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS priority", "event_id * 7 % 1000 AS created",
    "user_id % 6 AS n_patterns", "user_id % 4 AS n_conflicts", "CASE WHEN user_id % 2 = 0 THEN 'pending' ELSE 'completed' END AS status",
    "CASE WHEN user_id % 2 = 1 THEN (CASE WHEN success THEN 'approve' ELSE 'reject' END) END AS decision", "CASE WHEN user_id % 2 = 1 THEN processing_time_ms END AS hours"]
SE = f"{d.EVENTS}, se AS (SELECT {', '.join(SESSIONS)} FROM ev)"


def sessions(spark, sf_dir):
    return metric_events(spark, sf_dir).selectExpr(*SESSIONS)


@query(
    "l30_review_queue",
    f"""WITH {SE} SELECT session_id, reviewer, priority, CASE priority WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS priority_rank, created, n_patterns * 3 + n_conflicts * 5 AS estimated_minutes
        FROM se WHERE status = 'pending'""",
)
def l30(spark, sf_dir):
    return m.review_queue(sessions(spark, sf_dir))


@query("l31_review_stats", f"WITH {SE} SELECT status, decision, count(*) AS n, round(avg(hours), 6) AS mean_hours FROM se GROUP BY 1, 2")
def l31(spark, sf_dir):
    return rounded(m.review_stats(sessions(spark, sf_dir)))


NEW, OLD = {p: x for p, x, _ in PATTERNS[:2]}, {p: x for p, x, _ in PATTERNS[2:]}
_NAMES = ["il", "ilce", "mahalle", "sokak", "cadde", "bulvar", "no", "daire"]
_OWN = " ".join(f"WHEN '{p}' THEN {sum(0.2 for c in _NAMES if c in x.lower())}" for p, x, _ in PATTERNS)
_SEEN = " + ".join(f"0.1 * coalesce(max(contains(text, '{c}')::INT) FILTER (addr_id % 5 > 0), 0)" for c in _NAMES)
GEN = f"""gn AS (SELECT pattern_id, avg(hit::INT) FILTER (addr_id % 5 > 0) AS train_rate, avg(hit::INT) FILTER (addr_id % 5 = 0) AS test_rate,
     least(1.0, CASE pattern_id {_OWN} END + {_SEEN})::DOUBLE AS component_coverage FROM hh GROUP BY 1),
   gz AS (SELECT *, least(1.0, train_rate * 0.3 + test_rate * 0.3 + 0.5 * 0.2 + component_coverage * 0.2) AS generalizability FROM gn)"""


def split_hits(spark, sf_dir):
    return hits(spark, sf_dir).withColumn("split", F.when(F.col("addr_id") % 5 > 0, "train").otherwise("test"))


def general(spark, sf_dir):
    return m.generalizability(split_hits(spark, sf_dir), F.lit(0.5), NEW | OLD)


@query(
    "l19_generalizability",
    f"WITH {HITS}, {GEN} SELECT pattern_id, round(train_rate, 6) AS train_rate, round(test_rate, 6) AS test_rate, round(component_coverage, 6) AS component_coverage, round(generalizability, 6) AS generalizability FROM gz",
)
def l19(spark, sf_dir):
    return rounded(general(spark, sf_dir))


_LIKE = ", ".join(f"('{n}', '{e}', {m.regex_similarity(NEW[n], OLD[e])}::DOUBLE)" for n in NEW for e in OLD)
RISK = f"""lk(pattern_id, other, likeness) AS (VALUES {_LIKE}),
   jc AS (SELECT a.pattern_id, b.pattern_id AS other, count(*) FILTER (a.hit AND b.hit) / count(*) FILTER (a.hit OR b.hit) AS j FROM hh a JOIN hh b ON a.addr_id = b.addr_id AND a.pattern_id <> b.pattern_id GROUP BY 1, 2),
   rk AS (SELECT pattern_id, max(likeness * 0.6 + j * 0.4) AS collision_risk FROM lk JOIN jc USING (pattern_id, other) GROUP BY 1)"""


def risk(spark, sf_dir):
    return m.collision_risk(hits(spark, sf_dir), NEW, OLD)


@query("l20_collision_risk", f"WITH {HITS}, {RISK} SELECT pattern_id, round(collision_risk, 6) AS collision_risk FROM rk")
def l20(spark, sf_dir):
    return rounded(risk(spark, sf_dir).drop("closest"))


@query(
    "l22_validate_patterns",
    f"""WITH {HITS}, {GEN}, {RISK}, {_DIM}, qx AS (SELECT pattern_id, regex, {_CX} FROM pdim), st AS (SELECT pattern_id, 0.7::DOUBLE AS confidence, generalizability, complexity_score, collision_risk, test_rate
          FROM gz JOIN rk USING (pattern_id) JOIN qx USING (pattern_id)), v AS (SELECT *, CAST({m.VALIDATION} AS DOUBLE) AS quality FROM st)
        SELECT pattern_id, round(quality, 6) AS quality, concat_ws('; ', CASE WHEN quality < 0.5 THEN 'Low overall quality' END, CASE WHEN collision_risk > 0.3 THEN 'High collision risk' END,
          CASE WHEN generalizability < 0.6 THEN 'Low generalizability' END, CASE WHEN complexity_score > 0.8 THEN 'Pattern too complex' END) AS issues,
          quality >= 0.5 AND collision_risk <= 0.3 AND generalizability >= 0.6 AS accepted FROM v""",
)
def l22(spark, sf_dir):
    dim = spark.createDataFrame(list(NEW.items()), "pattern_id string, regex string")
    stats = m.regex_complexity(dim).join(general(spark, sf_dir), "pattern_id").join(risk(spark, sf_dir), "pattern_id").withColumn("confidence", F.lit(0.7))
    return rounded(m.validate_patterns(stats))
