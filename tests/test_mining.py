"""Features of a text are computed from one lower case, whatever the number of grams."""

from semtflow.operators import mining as m


def test_grams_share_one_lower_case(spark):
    df = spark.createDataFrame([(i, f"Moda Mahallesi {i} Sokak No {i % 7}") for i in range(40)], "addr_id long, text string")
    plan = m.feature_matrix(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("lower(") == 1


def test_representative_is_the_row_most_like_the_others(spark):
    rows = [(1, "moda sokak no 1", 0), (2, "moda sokak no 2", 0), (3, "moda sokak no 2", 0), (4, "x", 0), (5, "alone", 1), (6, None, 0)]
    df = spark.createDataFrame(rows, "addr_id long, text string, cluster long")
    assert [(r.cluster, r.addr_id) for r in m.representative(df).collect()] == [(0, 2)]


def _vectors(spark, copies):
    from pyspark.ml.linalg import Vectors

    near = [[float(x), 1.0] for x in (0, 1, 2, 100, 101, 102)]
    rows = [(i * 100 + j, Vectors.dense(v)) for j in range(copies) for i, v in enumerate(near)]
    return spark.createDataFrame(rows, ["addr_id", "features"])


def test_clusterings_read_each_distinct_vector_once(spark):
    df = _vectors(spark, 5)
    points = m.feature_points(df)
    assert sorted((tuple(r.features), r.weight) for r in points.collect())[0] == ((0.0, 1.0), 5.0) and points.count() == 6
    rows = m.cluster_kmeans(df, 2, points).collect()
    assert len(rows) == 30 and len({(r.cluster, r.features[0] > 50) for r in rows}) == 2


def test_choose_k_counts_rows_and_not_vectors(spark):
    (k, score), *rest = m.choose_k(_vectors(spark, 5), ks=[2], min_size=15)
    assert (k, rest) == (2, []) and score > 0.99
    assert m.choose_k(_vectors(spark, 5), ks=[2], min_size=16) == []


def test_suggest_takes_minhashes_once_for_both_clusterings(spark, monkeypatch):
    calls, hashes = [], m._minhashes
    monkeypatch.setattr(m, "_minhashes", lambda *a: calls.append(1) or hashes(*a))
    df = spark.createDataFrame([(i, f"moda mahallesi {i % 3} sokak no {i}") for i in range(30)], "addr_id long, text string")
    out = m.suggest_patterns(df, 2, min_confidence=0.0).collect()
    assert out and len(calls) == 1 and sum(round(r.coverage * 10) for r in out) >= 10
