"""Pattern mining over an address corpus and checks of mined patterns (L).

Cluster similarity is defined over all pairs of a cluster. No pair is ever
built: the mean Jaccard similarity is the chance that two rows share a minhash,
read off group sizes, and the mean length similarity comes from the length
histogram. Mined patterns are few (ten per run), so their regular expressions
are literals tried in one projection over the corpus.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.clustering import GaussianMixture, KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IDF, PCA, CountVectorizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.functions.ordered import hinted
from semtflow.session import checkpointed

# fixed values: corpus keywords and parts of mined patterns
KEYWORDS = ["mahalle", "mah", "sokak", "sok", "cadde", "cad", "bulvar", "blv", "no", "numara", "daire", "kat", "blok", "site", "apt", "apartman"]
PARTS = [
    ("mahalle", "mahalle", r"(?P<mahalle>\w+)\s*(mahalle|mah)\.?"), ("sokak", "sokak", r"(?P<sokak>\w+)\s*(sokak|sok)\.?"),
    ("cadde", "cadde", r"(?P<cadde>\w+)\s*(cadde|cad)\.?"), ("no", r"no:?\s*\d+", r"no:?\s*(?P<no>\d+)"),
]
GLUE, ANY = r"\s*[,\-\s]*\s*", r"\w+"
COMPONENTS = ["il", "ilce", "mahalle", "sokak", "no"]
HASHES = 32


def corpus_features(df: DataFrame, col: str = "text") -> DataFrame:
    """One wide aggregate: length, token, character and keyword statistics."""
    c, low = F.col(col), F.lower(F.col(col))
    n = F.nullif(F.length(c), F.lit(0))
    share = lambda p: (F.length(c) - F.length(F.regexp_replace(c, p, ""))) / n
    tokens, numbers = F.size(t.words(c)), F.size(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0)))
    stats = {"length": F.length(c), "tokens": tokens, "digit_ratio": share(r"\p{Nd}"), "alpha_ratio": share(r"\p{L}"), "space_ratio": share(" "),
             "commas": F.length(c) - F.length(F.replace(c, F.lit(","))), "numbers": numbers}
    base = df.select(*[v.cast("double").alias(k) for k, v in stats.items()], *[low.contains(w).cast("int").alias(f"kw_{w}") for w in KEYWORDS])
    aggs = [f(k).alias(f"{k}_{n_}") for k in stats for n_, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))]
    return base.agg(F.count(F.lit(1)).alias("n_rows"), *aggs, *[F.avg(f"kw_{w}").alias(f"share_{w}") for w in KEYWORDS])


def feature_matrix(df: DataFrame, col: str = "text", words: int = 100, chars: int = 50) -> DataFrame:
    """Word 1-2-gram and character 2-4-gram TF-IDF with ten plain features, as ``features``."""
    c, low, toks = F.col(col), F.col("__l"), F.col("__t")
    bigrams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(toks) - 1, F.lit(1))), lambda i: F.concat_ws(" ", F.slice(toks, i, 2)))
    grams = lambda n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(low, i, F.lit(n)))
    plain = [
        F.length(c), F.length(c) - F.length(F.replace(c, F.lit(" "))), F.size(F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))),
        F.length(c) - F.length(F.replace(c, F.lit(","))), F.length(c) - F.length(F.replace(c, F.lit("/"))), F.length(c) - F.length(F.regexp_replace(c, r"\p{Lu}", "")),
        F.length(c) - F.length(F.regexp_replace(c, r"\p{Ll}", "")), low.contains("mahalle").cast("int"), low.contains("sokak").cast("int"), c.rlike(r"\d{5}").cast("int")]
    # the text, its lower case and its words stand between steps, or every gram would compute them anew
    step = t.once(t.once(t.once(df, c, col), F.lower(c), "__l"), t.words(low), "__t")
    step = t.once(step, F.concat(toks, F.filter(bigrams, lambda x: x.contains(" "))), "__w")
    step = step.withColumn("__c", F.concat(grams(2), grams(3), grams(4))).withColumns({f"__m{i}": p.cast("double") for i, p in enumerate(plain)})
    stages = [
        CountVectorizer(inputCol="__w", outputCol="__wc", vocabSize=words), IDF(inputCol="__wc", outputCol="__wi"),
        CountVectorizer(inputCol="__c", outputCol="__cc", vocabSize=chars), IDF(inputCol="__cc", outputCol="__ci"),
        VectorAssembler(inputCols=["__wi", "__ci", *[f"__m{i}" for i in range(10)]], outputCol="features")]
    return Pipeline(stages=stages).fit(step).transform(step).select(*df.columns, "features")


def feature_points(features: DataFrame) -> DataFrame:
    """Each distinct feature vector once, with the number of its rows as ``weight``.

    Short texts share vectors. A clustering iterates over the weighted vectors, which have the same
    means and the same costs as the rows, so what is read again and again grows with what differs.
    """
    return checkpointed(features.groupBy("features").agg(F.count(F.lit(1)).cast("double").alias("weight")))


def _kmeans(points: DataFrame, k: int):
    return KMeans(k=k, seed=42, maxIter=10, weightCol="weight").fit(points)


def cluster_kmeans(features: DataFrame, k: int, points: DataFrame | None = None) -> DataFrame:
    points = feature_points(features) if points is None else points
    return _kmeans(points, k).transform(features).withColumnRenamed("prediction", "cluster")


def cluster_gmm(features: DataFrame, k: int, points: DataFrame | None = None, dims: int = 8) -> DataFrame:
    """Gaussian mixture over the leading components (of all rows)."""
    points = feature_points(features) if points is None else points
    pca = PCA(k=dims, inputCol="features", outputCol="__pca").fit(features)
    model = GaussianMixture(k=k, seed=42, maxIter=10, featuresCol="__pca", predictionCol="cluster", weightCol="weight").fit(pca.transform(points))
    return model.transform(pca.transform(features)).drop("__pca", "probability")


def choose_k(features: DataFrame, ks=range(2, 11), min_size: int = 3, points: DataFrame | None = None) -> list[tuple[int, float]]:
    """(k, silhouette over all rows) for each k whose clusters all reach the minimum size, best first."""
    points = feature_points(features) if points is None else points
    judge, scored = ClusteringEvaluator(), []
    for k in ks:
        model = _kmeans(points, k)
        sizes = [r.n for r in model.transform(points).groupBy("prediction").agg(F.sum("weight").alias("n")).collect()]  # a row per cluster
        if len(sizes) == k and min(sizes) >= min_size:
            scored.append((k, judge.evaluate(model.transform(features.select("features")))))
    return sorted(scored, key=lambda x: -x[1])


def _minhashes(df: DataFrame, col: str) -> DataFrame:
    """One row per (row, hash function) with the token whose hash is smallest, and the length of the text."""
    base = t.once(df.select("addr_id", "cluster", F.col(col)), F.col(col), "__x")
    base = t.once(base.select("addr_id", "cluster", F.length("__x").alias("len"), F.lower("__x").alias("__x")), F.array_distinct(t.words(F.col("__x"))), "__t")
    least = lambda h: F.array_min(F.transform("__t", lambda w: F.struct(F.md5(F.concat(h.cast("string"), F.lit(":"), w)).alias("k"), w.alias("w"))))["w"]
    rows = F.transform(F.sequence(F.lit(1), F.lit(HASHES)), lambda h: F.struct(h.alias("h"), least(h).alias("m")))
    return base.select("addr_id", "cluster", "len", F.explode_outer(rows).alias("x")).select("addr_id", "cluster", "len", "x.h", "x.m")


def _length_sums(df: DataFrame, col: str) -> DataFrame:
    """Per (cluster, length): sum of min/max ratios of that length against all rows, itself included once."""
    hist = df.groupBy("cluster", F.length(col).alias("len")).agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("cluster").orderBy("len")  # one row per distinct length
    shorter = F.coalesce(F.sum(F.col("c") * F.col("len")).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    longer = F.coalesce(F.sum(F.col("c") / F.col("len")).over(up.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0))
    return hist.withColumn("ratio_sum", shorter / F.col("len") + longer * F.col("len") + F.col("c") - 1)


def cluster_similarity(df: DataFrame, col: str = "text") -> DataFrame:
    """Mean pairwise similarity per cluster: 0.7 token Jaccard (minhash estimate) + 0.3 length ratio (exact)."""
    return _similarity(_minhashes(df, col), df, col)


def _similarity(minhashes: DataFrame, df: DataFrame, col: str) -> DataFrame:
    groups = minhashes.groupBy("cluster", "h", "m").agg(F.count(F.lit(1)).alias("c"))
    pairs = groups.groupBy("cluster").agg((F.sum(F.col("c") * (F.col("c") - 1)) / HASHES).alias("same"))
    lens = _length_sums(df, col).groupBy("cluster").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.col("ratio_sum")).alias("ratios"))
    both = F.col("n") * (F.col("n") - 1)
    j = pairs.join(lens, "cluster").filter(F.col("n") > 1)
    return j.select("cluster", "n", (F.col("same") / both).alias("jaccard"), (F.col("ratios") / both).alias("length_similarity"),
                    (F.col("same") / both * 0.7 + F.col("ratios") / both * 0.3).alias("similarity"))


def cluster_confidence(similarity: DataFrame) -> DataFrame:
    return similarity.select("cluster", "n", F.bround(F.col("similarity") * 0.7 + F.least(F.lit(1.0), F.col("n") / 20) * 0.3, 3).alias("confidence"))


def representative(df: DataFrame, col: str = "text") -> DataFrame:
    """Per cluster the row most like the others on average."""
    mh = _minhashes(df, col)
    groups = mh.filter(F.col("m").isNotNull()).groupBy("cluster", "h", "m").agg(F.count(F.lit(1)).alias("c"))
    # a row per cluster and word with its group sizes by hash function, so what meets the texts grows with the vocabulary
    sizes = checkpointed(groups.groupBy("cluster", "m").agg(F.map_from_entries(F.collect_list(F.struct("h", "c"))).alias("sizes")))
    met = mh.join(hinted(sizes), ["cluster", "m"])
    same = met.groupBy("cluster", "addr_id", "len").agg((F.sum(F.element_at("sizes", F.col("h")) - 1) / HASHES).alias("same"))
    lens = checkpointed(_length_sums(df, col).select("cluster", "len", "c", "ratio_sum"))
    n = lens.groupBy("cluster").agg(F.sum("c").alias("n"))
    j = same.join(hinted(lens.drop("c")), ["cluster", "len"]).join(n, "cluster").filter(F.col("n") > 1)
    score = F.round((F.col("same") * 0.7 + F.col("ratio_sum") * 0.3) / (F.col("n") - 1), 9)
    return j.groupBy("cluster").agg(F.max_by("addr_id", F.struct(score.alias("s"), -F.col("addr_id"))).alias("addr_id"), F.max(score).alias("mean_similarity"))


def length_bucket_clusters(df: DataFrame, col: str = "text", width: int = 20, min_size: int = 3) -> DataFrame:
    b = df.groupBy(F.floor(F.length(col) / width).alias("bucket")).agg(F.count(F.lit(1)).alias("cluster_size"))
    return b.filter(F.col("cluster_size") >= min_size).withColumn("confidence", F.lit(0.3))


def synthesize_patterns(df: DataFrame, col: str = "text") -> DataFrame:
    """One mined pattern per cluster from the parts any member has. ``df`` has cluster and text."""
    low = F.lower(F.col(col))
    has = [F.max(low.rlike(p) if "\\" in p else low.contains(p)).alias(f"has_{n}") for n, p, _ in PARTS]
    lead = df.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.min(col).alias("example"), *has)
    regex = F.concat_ws(GLUE, *[F.when(F.col(f"has_{n}"), F.lit(x)) for n, _, x in PARTS])
    regex = F.when(regex == "", ANY).otherwise(regex)
    return lead.select("cluster", "n", regex.alias("regex"), F.concat(F.lit("pattern_"), F.substring(F.md5(regex), 1, 8)).alias("pattern_id"),
                       F.least(F.col("n") / 10, F.lit(1.0)).alias("coverage"), "example")


def clustering_score(confidences: DataFrame, max_clusters: int = 10) -> DataFrame:
    n = F.count(F.lit(1))
    return confidences.agg((F.avg("confidence") * F.when(n > max_clusters, 0.5).when(n < 2, 0.7).otherwise(1.0)).alias("score"))


def suggest_patterns(df: DataFrame, k: int, max_patterns: int = 10, min_confidence: float = 0.6, col: str = "text", points: DataFrame | None = None) -> DataFrame:
    """Best of the clusterings by mean confidence, one pattern per cluster, sure ones only, best first.

    ``df`` may bring its ``features`` (and their ``points``); else they are computed here, once for both clusterings.
    """
    feats = df if "features" in df.columns else checkpointed(feature_matrix(df.select("addr_id", col), col))
    points = feature_points(feats) if points is None else points
    made = cluster_kmeans(feats, k, points).withColumnRenamed("cluster", "kmeans")
    made = cluster_gmm(made, k, points).withColumnRenamed("cluster", "gmm")
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), F.col(name).alias("id")) for name in ("kmeans", "gmm")])
    rows = checkpointed(made.select("addr_id", col, kinds.alias("cluster")))
    # minhashes are the same in both clusterings: taken once per text, then dealt to either
    each = rows.withColumn("cluster", F.explode("cluster"))
    hashed = _minhashes(rows, col).withColumn("cluster", F.explode("cluster"))
    conf = checkpointed(cluster_confidence(_similarity(hashed, each, col)))
    score = {name: clustering_score(conf.filter(F.col("cluster.kind") == name)).first().score or 0.0 for name in ("kmeans", "gmm")}
    best = max(score, key=score.get)  # of equal ones the first
    of_best = F.col("cluster.kind") == best
    rows, conf = (x.filter(of_best).withColumn("cluster", F.col("cluster.id")) for x in (each, conf))
    out = synthesize_patterns(rows, col).join(conf.select("cluster", "confidence"), "cluster").filter(F.col("confidence") >= min_confidence)
    return out.orderBy(F.col("confidence").desc(), "pattern_id").limit(max_patterns)


# --- quality of patterns ----------------------------------------------------


def java_regex(p: str) -> str:
    """Named groups as plain groups, word classes over all letters."""
    import re

    return "(?iU)" + re.sub(r"\(\?P<\w+>", "(", p)


def pattern_hits(df: DataFrame, patterns: list[tuple[str, str, int]], col: str = "text") -> DataFrame:
    """Every (row, pattern) with its match flag and group values. Patterns: id, regex, number of groups."""
    c = F.col(col)
    one = lambda p: F.struct(
        F.lit(p[0]).alias("pattern_id"), c.rlike(java_regex(p[1])).alias("hit"),
        F.array(*[F.regexp_extract(c, java_regex(p[1]), i + 1) for i in range(p[2])]).cast("array<string>").alias("groups"))
    return df.select(*df.columns, F.explode_outer(F.array(*[one(p) for p in patterns])).alias("x")).select(*df.columns, "x.*")


def pattern_coverage(hits: DataFrame) -> DataFrame:
    """Match rate, share of filled groups, completeness and groups per match."""
    filled = F.size(F.filter("groups", lambda g: F.trim(g) != ""))
    agg = hits.groupBy("pattern_id").agg(
        F.avg(F.col("hit").cast("int")).alias("match_rate"), F.count_if("hit").alias("total_matches"), F.max(F.size("groups")).alias("n_groups"),
        F.sum(F.when(F.col("hit"), filled)).alias("filled"))
    all_groups = F.col("total_matches") * F.col("n_groups")
    cover = F.coalesce(F.try_divide(F.col("filled"), all_groups), F.lit(0.0))
    return agg.select("pattern_id", "match_rate", "total_matches", cover.alias("field_coverage"), F.least(F.lit(1.0), cover).alias("completeness"),
                      F.when(F.col("total_matches") > 0, F.col("n_groups").cast("double")).otherwise(0.0).alias("avg_groups_per_match"))


def pattern_accuracy(hits: DataFrame) -> DataFrame:
    """Exact extraction against ``expected`` (array of values): accuracy, precision, recall."""
    right = F.col("hit") & (F.col("groups") == F.col("expected"))
    agg = hits.groupBy("pattern_id").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(right).alias("right"), F.sum(F.when(F.col("hit"), F.size("groups")).otherwise(0)).alias("said"), F.sum(F.size("expected")).alias("asked"))
    return agg.select("pattern_id", (F.col("right") / F.col("n")).alias("accuracy"), F.coalesce(F.try_divide("right", "said"), F.lit(0.0)).alias("precision"),
                      F.coalesce(F.try_divide("right", "asked"), F.lit(0.0)).alias("recall"))


def _count_chars(c: str, chars: str) -> str:
    return f"(length({c}) - length(translate({c}, '{chars}', '')))"


COMPLEXITY = {  # portable SQL over a column named regex
    "pattern_length": "length(regex)",
    "group_count": _count_chars("regex", "("),
    "named_group_count": "(length(regex) - length(replace(regex, '(?P<', ''))) / 4",
    "quantifier_count": _count_chars("regex", "*+?"),
    "char_class_count": _count_chars("regex", "["),
    "special_char_count": _count_chars("regex", ".*+?^${}[]|()/") + " + " + "(length(regex) - length(replace(regex, chr(92), '')))",
    "complexity_score": "least(1.0E0, pattern_length / 100.0E0 + special_char_count / 20.0E0 + group_count / 10.0E0 + quantifier_count / 10.0E0 + char_class_count / 5.0E0)",
    "readability_score": "1.0E0 - complexity_score",
    "performance_cost": "pattern_length + 2 * (special_char_count - (length(regex) - length(replace(regex, '/', '')))) + 3 * group_count",
}


def regex_complexity(patterns: DataFrame) -> DataFrame:
    kinds = {k: "DOUBLE" if k.endswith("score") else "BIGINT" for k in COMPLEXITY}
    return patterns.selectExpr("*", *[f"CAST({e} AS {kinds[k]}) AS {k}" for k, e in COMPLEXITY.items()])


QUALITY = """least(1.0E0, 0.3E0 * (match_rate * 0.4E0 + field_coverage * 0.3E0 + completeness * 0.3E0) + 0.2E0 * 1.0E0 + 0.3E0 * readability_score + 0.2E0 * least(1.0E0, group_count / 5.0E0))"""
QUALITY_LEVEL = "CASE WHEN quality >= 0.8 THEN 'excellent' WHEN quality >= 0.6 THEN 'good' WHEN quality >= 0.4 THEN 'fair' ELSE 'poor' END"


def pattern_quality(patterns: DataFrame, coverage: DataFrame) -> DataFrame:
    """Weighted quality with its level. Patterns: pattern_id, regex."""
    return regex_complexity(patterns).join(coverage, "pattern_id").selectExpr("*", f"CAST({QUALITY} AS DOUBLE) AS quality").selectExpr("*", f"{QUALITY_LEVEL} AS level")


def rank_patterns(quality: DataFrame) -> DataFrame:
    w = Window.orderBy(F.col("quality").desc())  # one row per mined pattern
    return quality.withColumn("rank", F.rank().over(w)).withColumn("mean_quality", F.avg("quality").over(Window.partitionBy()))


def example_diversity(df: DataFrame, col: str = "text") -> DataFrame:
    """Per cluster: mean of unique-word share, length spread and distinct structures."""
    words = df.select("cluster", F.explode(F.regexp_extract_all(F.lower(F.col(col)), F.lit(r"(?U)\w+"), F.lit(0))).alias("w")).groupBy("cluster").agg(
        (F.countDistinct("w") / F.count("w")).alias("word_diversity"))
    shape = F.regexp_replace(F.regexp_replace(F.col(col), r"\d+", "NUM"), r"(?U)\w+", "WORD")
    rest = df.groupBy("cluster").agg(F.least(F.stddev_pop(F.length(col)) / 50, F.lit(1.0)).alias("length_diversity"), (F.countDistinct(shape) / F.count(F.lit(1))).alias("structure_diversity"))
    return words.join(rest, "cluster").withColumn("diversity", (F.col("word_diversity") + F.col("length_diversity") + F.col("structure_diversity")) / 3)


def component_coverage(hits: DataFrame, col: str = "text") -> DataFrame:
    """Match rate overall and among rows that mention each component."""
    low, hit = F.lower(F.col(col)), F.col("hit").cast("int")
    return hits.groupBy("pattern_id").agg(F.avg(hit).alias("overall"), *[F.avg(F.when(low.contains(c), hit)).alias(f"with_{c}") for c in COMPONENTS])


# --- conflicts --------------------------------------------------------------

# fixed values: severities by rank
SEVERITY = {"low": 1, "medium": 2, "high": 3, "critical": 4}


def _words_of(c: str) -> Column:
    return F.array_distinct(t.words(F.lower(F.col(c))))


def _keywords_of(c: str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.col(c)), F.lit("[a-z]{3,}"), F.lit(0)))


#: What a kind of conflict needs two patterns to share.
TERMS = {"field_mapping": lambda side: F.col(f"{side}fields"), "semantic_overlap": lambda side: _words_of(f"{side}description"), "keyword_overlap": lambda side: _keywords_of(f"{side}regex")}


def sharing_pairs(existing: DataFrame, new: DataFrame, kind: str) -> DataFrame:
    """Existing with new and new with new patterns (by id) that share a term of the kind, once each.

    Patterns meet on their terms in an equi-join, so what is compared grows with the pairs that
    share something and not with all pairs.
    """
    side = lambda df, name: df.select(F.struct("pattern_id", "regex", "fields", "description").alias(name), F.explode(F.array_distinct(TERMS[kind](""))).alias("term"))
    mixed = side(existing, "a").join(side(new, "b"), "term").filter("a.pattern_id <> b.pattern_id")
    inner = side(new, "a").join(side(new, "b"), "term").filter("a.pattern_id < b.pattern_id")
    both = mixed.unionByName(inner).select("a", "b", F.col("a.pattern_id").alias("ai"), F.col("b.pattern_id").alias("bi"))
    return both.dropDuplicates(["ai", "bi"]).select("a", "b")


def costly_pairs(existing: DataFrame, new: DataFrame, costs: DataFrame, least: float = 100.0) -> DataFrame:
    """All patterns beside the few new ones over the cost from which a conflict is possible."""
    dear = new.join(costs.filter(F.col("performance_cost") > least).select("pattern_id"), "pattern_id", "left_semi")
    made = dear.select(F.struct("pattern_id", "regex", "fields", "description").alias("b"))
    old = existing.select(F.struct("pattern_id", "regex", "fields", "description").alias("a"))
    inner = new.select(F.struct("pattern_id", "regex", "fields", "description").alias("a"))
    return old.join(made, F.col("a.pattern_id") != F.col("b.pattern_id")).unionByName(inner.join(made, F.col("a.pattern_id") < F.col("b.pattern_id")))


def _conflict(df: DataFrame, kind: str, severity: str, ratio: Column) -> DataFrame:
    return df.select(F.col("a.pattern_id").alias("existing_id"), F.col("b.pattern_id").alias("new_id"), F.lit(kind).alias("type"),
                     F.lit(SEVERITY[severity]).alias("severity_rank"), ratio.cast("double").alias("ratio"))


def field_conflicts(pairs: DataFrame) -> DataFrame:
    both, either = F.size(F.array_intersect("a.fields", "b.fields")), F.size(F.array_union("a.fields", "b.fields"))
    return _conflict(pairs.filter(both > 0), "field_mapping", "medium", both / either)


def complexity_conflicts(pairs: DataFrame, costs: DataFrame) -> DataFrame:
    a, b = costs.select(F.col("pattern_id").alias("ai"), F.col("performance_cost").alias("ac")), costs.select(F.col("pattern_id").alias("bi"), F.col("performance_cost").alias("bc"))
    j = pairs.join(a, F.col("a.pattern_id") == F.col("ai")).join(b, F.col("b.pattern_id") == F.col("bi"))
    return _conflict(j.filter((F.col("bc") > F.col("ac") * 2) & (F.col("bc") > 100)), "performance", "low", F.col("bc") / F.col("ac"))


def semantic_conflicts(pairs: DataFrame) -> DataFrame:
    a, b = _words_of("a.description"), _words_of("b.description")
    both = F.size(F.array_intersect(a, b))
    share = both / F.size(F.array_union(a, b))
    return _conflict(pairs.filter((both > 2) & (share > 0.3)), "semantic_overlap", "low", share)


def overlap_conflicts(hits: DataFrame) -> DataFrame:
    """From rows hit by both patterns of a pair: different extractions, or over half of the samples alike.

    The hits of a row (at most one per pattern) are paired inside the row.
    """
    per = hits.filter("hit").groupBy("addr_id").agg(F.sort_array(F.collect_list(F.struct("pattern_id", "groups"))).alias("h"))  # bounded by the pattern count
    pair = F.flatten(F.transform("h", lambda x, i: F.transform(F.slice("h", i + 2, F.size("h")), lambda y: F.struct(
        x["pattern_id"].alias("existing_id"), y["pattern_id"].alias("new_id"), (x["groups"] != y["groups"]).alias("differs")))))
    counted = per.select(F.explode(pair).alias("p")).groupBy("p.existing_id", "p.new_id").agg(
        F.count_if("p.differs").alias("conflicting"), F.count_if(~F.col("p.differs")).alias("overlapping"))
    total = hits.agg(F.countDistinct("addr_id")).scalar()
    kind = F.when(F.col("conflicting") > 0, "regex_overlap").when(F.col("overlapping") > total * 0.5, "pattern_redundancy")
    rank = F.when(F.col("conflicting") > 2, SEVERITY["high"]).otherwise(SEVERITY["medium"])
    ratio = F.when(F.col("conflicting") > 0, F.col("conflicting")).otherwise(F.col("overlapping")) / total
    return counted.select("existing_id", "new_id", kind.alias("type"), rank.alias("severity_rank"), ratio.alias("ratio")).filter(F.col("type").isNotNull())


def worst_conflicts(conflicts: DataFrame) -> DataFrame:
    """The most severe conflict per pair with its id."""
    top = conflicts.groupBy("existing_id", "new_id").agg(F.max_by(F.struct("type", "ratio"), F.struct("severity_rank", "type")).alias("x"), F.max("severity_rank").alias("severity_rank"))
    return top.select(F.substring(F.md5(F.concat_ws("|", "existing_id", "new_id")), 1, 8).alias("conflict_id"), "existing_id", "new_id", "x.type", "severity_rank", F.col("x.ratio").alias("ratio"))


def keyword_conflicts(pairs: DataFrame) -> DataFrame:
    a, b = _keywords_of("a.regex"), _keywords_of("b.regex")
    both = F.size(F.array_intersect(a, b))
    return _conflict(pairs.filter(both > 0), "keyword_overlap", "low", both / F.size(F.array_union(a, b)))


RESOLUTIONS = [  # fixed values: conflict type, strategy, confidence
    ("regex_overlap", "priority_based", 0.8), ("regex_overlap", "pattern_refinement", 0.7), ("pattern_redundancy", "pattern_merge", 0.8),
    ("field_mapping", "field_rename", 0.7), ("performance", "pattern_simplification", 0.6), ("semantic_overlap", "description_review", 0.6), ("keyword_overlap", "pattern_refinement", 0.5),
]


def conflict_resolutions(conflicts: DataFrame) -> DataFrame:
    """Strategy rows by type, plus manual review for each conflict."""
    dim = conflicts.sparkSession.createDataFrame(RESOLUTIONS, "type string, strategy string, confidence double")
    auto = conflicts.join(F.broadcast(dim), "type").select("conflict_id", "type", "strategy", "confidence")  # a handful of fixed rows
    return auto.unionByName(conflicts.select("conflict_id", "type", F.lit("manual_review").alias("strategy"), F.lit(1.0).alias("confidence")))


def review_queue(sessions: DataFrame, reviewer: str | None = None) -> DataFrame:
    """Open sessions by priority then age with estimated minutes."""
    s = sessions.filter(F.col("status") == "pending")
    s = s if reviewer is None else s.filter(F.col("reviewer") == reviewer)
    rank = F.when(F.col("priority") == "high", 1).when(F.col("priority") == "medium", 2).otherwise(3)
    return s.select("session_id", "reviewer", "priority", rank.alias("priority_rank"), "created", (F.col("n_patterns") * 3 + F.col("n_conflicts") * 5).alias("estimated_minutes")).orderBy(
        "priority_rank", "created", "session_id")


def review_stats(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy("status", "decision").agg(F.count(F.lit(1)).alias("n"), F.avg("hours").alias("mean_hours"))


# --- validation of mined patterns -------------------------------------------


def generalizability(hits: DataFrame, diversity: Column, regexes: dict[str, str], col: str = "text") -> DataFrame:
    """0.3 training + 0.3 test match rate + 0.2 diversity + 0.2 component coverage per pattern.

    ``hits`` has ``split`` (train or test). Component coverage counts the words
    in the regex (0.2 each) and in the training texts (0.1 each), capped at 1.
    """
    names = ["il", "ilce", "mahalle", "sokak", "cadde", "bulvar", "no", "daire"]
    low, hit, train = F.lower(F.col(col)), F.col("hit").cast("int"), F.col("split") == "train"
    agg = hits.groupBy("pattern_id").agg(
        F.avg(F.when(train, hit)).alias("train_rate"), F.avg(F.when(~train, hit)).alias("test_rate"),
        *[F.max(F.when(train, low.contains(c).cast("int"))).alias(f"in_{c}") for c in names])
    own = t.table({p: sum(0.2 for c in names if c in x.lower()) for p, x in regexes.items()}, "map<string,double>")
    seen = sum((F.coalesce(F.col(f"in_{c}"), F.lit(0)) * 0.1 for c in names), F.lit(0.0))
    cover = F.least(F.lit(1.0), F.element_at(own, F.col("pattern_id")) + seen)
    score = F.coalesce("train_rate", F.lit(0.0)) * 0.3 + F.coalesce("test_rate", F.lit(1.0)) * 0.3 + diversity * 0.2 + cover * 0.2
    return agg.select("pattern_id", "train_rate", "test_rate", cover.alias("component_coverage"), F.least(F.lit(1.0), score).alias("generalizability"))


def match_jaccard(hits: DataFrame) -> DataFrame:
    """For every pair of patterns: rows both match over rows either matches. Pairs are formed inside each row."""
    per = hits.filter("hit").groupBy("addr_id").agg(F.sort_array(F.collect_set("pattern_id")).alias("p"))  # bounded by the pattern count
    pair = F.flatten(F.transform("p", lambda x, i: F.transform(F.slice("p", i + 2, F.size("p")), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = per.select(F.explode(pair).alias("x")).groupBy("x.a", "x.b").agg(F.count(F.lit(1)).alias("both"))
    n = hits.filter("hit").groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n"))
    j = both.join(n.select(F.col("pattern_id").alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col("pattern_id").alias("b"), F.col("n").alias("nb")), "b")
    return j.select("a", "b", (F.col("both") / (F.col("na") + F.col("nb") - F.col("both"))).alias("jaccard"))


def regex_similarity(a: str, b: str) -> float:
    """Mean of character-set Jaccard and longest common subsequence share of two regex texts."""
    if a == b:
        return 1.0
    x, y = set(a.lower()), set(b.lower())
    row = [0] * (len(b) + 1)
    for ch in a:
        last = 0
        for j, other in enumerate(b, 1):
            keep = row[j]
            row[j] = last + 1 if ch == other else max(row[j], row[j - 1])
            last = keep
    return (len(x & y) / len(x | y) + row[-1] / max(len(a), len(b))) / 2


def collision_risk(hits: DataFrame, new: dict[str, str], existing: dict[str, str]) -> DataFrame:
    """Per new pattern the worst of 0.6 x regex likeness + 0.4 x match-set Jaccard over the existing ones.

    Regex texts are configuration (some dozens), so their likeness is computed once here.
    """
    alike = hits.sparkSession.createDataFrame(
        [(n, e, regex_similarity(new[n], existing[e])) for n in new for e in existing], "pattern_id string, other string, likeness double")
    jac = match_jaccard(hits)
    sym = jac.select(F.col("a").alias("pattern_id"), F.col("b").alias("other"), "jaccard").unionByName(jac.select(F.col("b").alias("pattern_id"), F.col("a").alias("other"), "jaccard"))
    risk = F.col("likeness") * 0.6 + F.coalesce("jaccard", F.lit(0.0)) * 0.4
    return alike.join(sym, ["pattern_id", "other"], "left").groupBy("pattern_id").agg(F.max(risk).alias("collision_risk"), F.max_by("other", risk).alias("closest"))


VALIDATION = "0.25E0 * confidence + 0.25E0 * generalizability + 0.2E0 * (1.0E0 - complexity_score) + 0.15E0 * (1.0E0 - collision_risk) + 0.15E0 * test_rate"


def validate_patterns(stats: DataFrame) -> DataFrame:
    """Overall quality, issues and the decision. Rows: confidence, generalizability, complexity_score, collision_risk, test_rate."""
    out = stats.withColumn("quality", F.expr(VALIDATION).cast("double"))
    issues = F.array_compact(F.array(
        F.when(F.col("quality") < 0.5, "Low overall quality"), F.when(F.col("collision_risk") > 0.3, "High collision risk"),
        F.when(F.col("generalizability") < 0.6, "Low generalizability"), F.when(F.col("complexity_score") > 0.8, "Pattern too complex")))
    ok = (F.col("quality") >= 0.5) & (F.col("collision_risk") <= 0.3) & (F.col("generalizability") >= 0.6) & (F.size(issues) <= 3)
    return out.select("pattern_id", "quality", F.array_join(issues, "; ").alias("issues"), ok.alias("accepted"))
