"""Derived addresses are spread over the cores, and scores keep their values where a shortcut applies."""

from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators import patterns as p
from semtflow.sources.derived import address_columns, addresses


def test_addresses_of_one_split_use_every_core(spark, tmp_path):
    spark.range(3000).selectExpr("id + 1 AS c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    made = addresses(spark, str(tmp_path))
    assert made.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    plain = spark.read.parquet(f"{tmp_path}/customer.parquet").selectExpr(*address_columns("c_custkey"))
    assert made.columns == plain.columns and sorted(made.collect()) == sorted(plain.collect())


def test_edit_similarity_of_a_part_is_the_edit_distance(spark):
    rows = [("moda sokak", "eski moda sokak no 5"), ("", "abc"), ("abc", ""), ("İnönü", "x İnönü y"), ("a b", "b a"), ("", ""), (None, "a"), ("şair", "şaire")]
    df = spark.createDataFrame(rows, "m string, t string")
    longest = F.greatest(F.length("m"), F.length("t"))
    plain = F.when(longest > 0, F.greatest(F.lit(0.0), 1.0 - F.levenshtein(F.lower("m"), F.lower("t")) / longest)).otherwise(1.0)
    assert [r[0] for r in df.select(p.edit_similarity(F.col("m"), F.col("t"))).collect()] == [r[0] for r in df.select(plain).collect()]


def test_shared_parts_of_a_text_give_the_same_scores(spark, tmp_path):
    spark.range(400).selectExpr("id + 1 AS c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    rows = addresses(spark, str(tmp_path)).select("addr_id", t.clean_text(F.col("address")).alias("text"))
    plan = p.with_best_match(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "__of" in plan  # the text's own parts stand before the hits are scored
    best = {r.addr_id: (r.confidence, r.priority) for r in p.with_best_match(rows).select("addr_id", "best.*").collect() if r.confidence is not None}
    scored = p.score_candidates(p.match_patterns(rows)).filter("confidence >= 0.4")
    want = scored.groupBy("addr_id").agg(F.max(F.struct("confidence", "priority")).alias("b")).collect()
    assert best == {r.addr_id: tuple(r.b) for r in want}
