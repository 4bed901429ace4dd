"""Quality rules and a hashed n-gram log-likelihood ratio, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.functions.text import table as constant
from semtflow.llm.common import cut, exploded, small, words

#: Buckets of hashed n-grams; pseudo-counts of each; least mean ratio of a kept document.
BUCKETS, PRIOR, LEAST = 1 << 17, 5.0, -0.25
#: Ratios are whole numbers of this unit, so that sums do not depend on their order.
MICRO = 1_000_000


def rule_counts(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The named columns with text, _ws (words), word_chars, n_symbols, n_dup_lines and n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(*keep, text.alias("text")).withColumn("_ws", words(F.col("text"))).withColumn("_lines", F.filter(F.split("text", "\n"), lambda x: F.length(F.btrim(x, F.lit(" \t\n\x0b\x0c\r"))) > 0))
    rows = rows.withColumn("_hs", F.transform("_ws", lambda w: F.xxhash64(w)))  # words are hashed once, windows from their hashes
    hs = F.col("_hs")
    run = F.transform(F.sequence(F.lit(0), F.size("_hs") - 5), lambda i: F.xxhash64(*[hs[i + k] for k in range(5)]))
    rows = rows.withColumn("_runs", F.when(F.size("_hs") >= 5, run).otherwise(F.array().cast("array<long>")))
    rows = rows.withColumn("_again", F.size(F.array_distinct("_runs")) < F.size("_runs"))
    # only texts with a repeated window look for its places: sorted windows that equal a neighbour
    placed = F.when(F.col("_again"), F.sort_array(F.transform("_runs", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    rows = rows.withColumn("_sorted", placed)
    s = F.col("_sorted")
    n = F.size("_sorted")
    equal = F.filter(
        F.sequence(F.lit(0), n - 1),
        lambda j: F.coalesce((j > 0) & (F.get(s, j - 1)["h"] == s[j]["h"]), F.lit(False)) | F.coalesce((j < n - 1) & (F.get(s, j + 1)["h"] == s[j]["h"]), F.lit(False)),
    )
    covered = F.size(F.array_distinct(F.flatten(F.transform(equal, lambda j: F.sequence(s[j]["i"], s[j]["i"] + 4)))))
    return rows.select(
        *keep,
        "text",
        F.size("_ws").cast("long").alias("n_words"),
        F.aggregate("_ws", F.lit(0).cast("long"), lambda a, w: a + F.length(w)).alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.col("_again"), covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)


def _hashed(text: Column) -> Column:
    """Hashes of runs of letters and digits, and of runs of signs: attached signs are words of their own."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]+"), F.lit(0)), lambda t: F.xxhash64(t))


def _with_pairs(ts: Column) -> Column:
    """A token's own hash, and that of the pair it ends; the first token has no pair."""
    both = F.transform(ts, lambda t, i: F.when(i > 0, F.xxhash64(F.get(ts, i - 1), t)))
    return F.concat(ts, F.filter(both, lambda h: h.isNotNull()))


def log_ratios(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, prior: float = PRIOR) -> DataFrame:
    """bucket, ratio: log of the trusted over the raw multinomial of every bucket in use, in millionths.

    Trusted are documents labelled of quality 1, raw are all. Raw counts are scaled to the
    trusted total, and ``prior`` pseudo-counts on both sides draw rare buckets to 0.
    """
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("_d")).distinct()
    marked = docs.select("doc_id", "text").join(small(good, F.lit(16)), F.col("doc_id") == F.col("_d"), "left")
    rows = marked.select(F.col("_d").isNotNull().cast("long").alias("_t"), _hashed(F.coalesce("text", F.lit(""))).alias("_ts"))
    each = exploded(rows, ["_t"], _with_pairs(F.col("_ts")), "gram")
    each = each.select("_t", F.pmod("gram", F.lit(n_buckets)).cast("int").alias("bucket"))
    counts = cut(each.groupBy("bucket").agg(F.sum("_t").alias("t"), F.count(F.lit(1)).alias("n")))  # at most a row per bucket
    total = counts.agg(F.sum("t").alias("all_t"), F.sum("n").alias("all_n"))
    share = total.select((F.col("all_t") / F.col("all_n")).alias("s")).first()
    scale = (share["s"] if share and share["s"] is not None else 0.0) or 0.0
    ratio = F.log((F.col("t") + prior) / (F.col("n") * F.lit(float(scale)) + prior))
    return counts.select("bucket", F.round(ratio * MICRO).cast("long").alias("ratio"))


def rate_documents(docs: DataFrame, labels: DataFrame, n_buckets: int = BUCKETS, least: float = LEAST) -> DataFrame:
    """doc_id, the rule counts, base_failed, mean_ratio and kept of every row.

    A document is kept if the base rules pass and the mean log-ratio over its tokens and pairs
    of neighbours is at least ``least``. Null and blank texts have no word and fail. Without
    trusted documents every ratio is 0. Rows are rated alone, so repeated and null ids do no
    harm; other columns of ``docs`` are not read.

    The ratios are a table of at most ``n_buckets`` numbers, whatever the corpus, and become a
    constant; every row sums its own. No text and no n-gram is shuffled for it.
    """
    ratio_of = [0] * n_buckets
    for r in log_ratios(docs, labels, n_buckets).collect():
        ratio_of[r.bucket] = r.ratio
    ratios = constant(ratio_of, "array<bigint>")
    ratio = lambda h: F.get(ratios, F.pmod(h, F.lit(n_buckets)).cast("int"))

    def step(acc: Column, h: Column) -> Column:
        pair = F.when(acc["last"].isNotNull(), ratio(F.xxhash64(acc["last"], h))).otherwise(F.lit(0).cast("long"))
        return F.struct(h.alias("last"), (acc["sum"] + ratio(h) + pair).alias("sum"))

    counted = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    rows = rule_counts(docs, ["doc_id"]).select(*counted, _hashed(F.col("text")).alias("_ts"))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(0).cast("long").alias("sum"))
    total = F.aggregate("_ts", start, step, lambda acc: acc["sum"])
    rated = rows.select(*counted, base_failed().alias("base_failed"), F.struct(total.alias("sum"), (2 * F.size("_ts") - 1).alias("n")).alias("_s"))
    mean = F.when(F.col("_s.n") > 0, F.col("_s.sum") / F.col("_s.n") / MICRO).otherwise(F.lit(0.0))
    rated = rated.select(*counted, "base_failed", mean.alias("mean_ratio"))
    return rated.withColumn("kept", ~F.col("base_failed") & (F.col("mean_ratio") >= F.lit(least)))
