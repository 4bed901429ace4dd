"""The token tagger as a table of weights, applied inside the row (G, used by the cascade F).

Features of a token fall into hashed buckets; a bucket has a weight for each tag. The weights
are a constant of bounded size (buckets x tags), so tagging a text is plain array arithmetic
in the row: no window, no shuffle, no Python. Tags are decoded under the rule that I-X follows
B-X or I-X only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, StringIndexer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators.entities import token_table
from semtflow.operators.evaluation import LABEL_FIELDS
from semtflow.session import checkpointed

BUCKETS = 4096
#: Different tokens from which a fit takes another task.
PART_TOKENS = 50_000
ENTITIES = "array<struct<label:string,start:int,end:int,text:string,confidence:double>>"
NEVER = -1e9


@dataclass(frozen=True)
class Tagger:
    """tags, and for each bucket (the last row: the bias) a weight per tag."""

    tags: tuple[str, ...]
    weights: tuple[tuple[float, ...], ...]


def _buckets(token: Column, before: Column, after: Column, i: Column, buckets: int = BUCKETS) -> Column:
    """Buckets of what a token shows: itself, its ending, its neighbours, its kind, its place."""
    shown = (
        F.concat(F.lit("w="), token), F.concat(F.lit("s="), F.substring(token, -3, 3)), F.concat(F.lit("p="), before), F.concat(F.lit("n="), after),
        F.concat(F.lit("np="), F.substring(after, -3, 3)), F.when(token.rlike("^[0-9]+$"), "number").otherwise("word"), F.when(i == 0, "first").otherwise("later"))
    return F.array(*[F.pmod(F.hash(x), F.lit(buckets)) for x in shown])


def fit_tagger(bio: DataFrame, iterations: int = 20, buckets: int = BUCKETS) -> Tagger:
    """Multinomial logistic weights from tokens with neighbours and ``tag`` (as ``bio_tags`` gives them)."""
    c = F.col
    shown = bio.select("tag", _buckets(c("token"), c("before"), c("after"), c("i"), buckets).cast("array<string>").alias("terms"))
    # tokens that show the same count as one with a weight: each iteration reads what differs
    data = checkpointed(shown.groupBy("tag", "terms").agg(F.count(F.lit(1)).cast("double").alias("weight")))
    data = data.coalesce(max(2, data.count() // PART_TOKENS))
    hashing = HashingTF(inputCol="terms", outputCol="features", numFeatures=4 * buckets)
    indexer = StringIndexer(inputCol="tag", outputCol="label", stringOrderType="alphabetAsc").fit(data)
    model = LogisticRegression(maxIter=iterations, family="multinomial", regParam=1e-4, weightCol="weight").fit(hashing.transform(indexer.transform(data)))
    # one row per bucket
    terms = bio.sparkSession.range(buckets).select("id", F.array(F.col("id").cast("string")).alias("terms"))
    place = [int(r.features.indices[0]) for r in hashing.transform(terms).orderBy("id").collect()]
    coefficients = model.coefficientMatrix.toArray().T
    rows = [tuple(round(float(x), 5) for x in coefficients[p]) for p in place]
    return Tagger(tuple(indexer.labels), (*rows, tuple(round(float(x), 5) for x in model.interceptVector)))


def save_tagger(spark: SparkSession, tagger: Tagger, path: str) -> None:
    rows = [(b, list(w), list(tagger.tags)) for b, w in enumerate(tagger.weights)]
    spark.createDataFrame(rows, "bucket int, weights array<double>, tags array<string>").coalesce(1).write.mode("overwrite").parquet(path)


def load_tagger(spark: SparkSession, path: str) -> Tagger:
    rows = spark.read.parquet(path).orderBy("bucket").collect()  # one row per bucket
    return Tagger(tuple(rows[0].tags), tuple(tuple(r.weights) for r in rows))


def _scores(tokens: Column, tagger: Tagger) -> Column:
    """Per token: the score of every tag."""
    table = t.table([list(w) for w in tagger.weights], "array<array<double>>")
    buckets = len(tagger.weights) - 1
    bias = F.array(*[F.lit(w) for w in tagger.weights[-1]])
    add = lambda acc, b: F.zip_with(acc, F.get(table, b), lambda x, y: x + y)
    return F.transform(tokens, lambda x: F.aggregate(_buckets(x["token"], x["before"], x["after"], x["i"], buckets), bias, add))


def _path(scores: Column, tags: tuple[str, ...]) -> Column:
    """The tags (as places) of the best sequence in which I-X follows B-X or I-X."""
    at = {tag: k for k, tag in enumerate(tags)}

    def step(acc: Column, score: Column) -> Column:
        # before the first token every sum is 0, and no tag goes inside; where that came from is not read
        def grown(x: Column) -> Column:
            last, best, first = x["last"], x["best"], F.size(acc["back"]) == 0
            sums, origins = [], []
            for k, tag in enumerate(tags):
                prior, origin = best, x["best_at"]
                if tag.startswith("I-"):
                    own, b = F.get(last, F.lit(k)), at.get("B-" + tag[2:], -1)
                    begin = F.get(last, F.lit(b)) if b >= 0 else F.lit(NEVER)
                    prior, origin = F.when(first, NEVER).otherwise(F.greatest(own, begin)), F.when(own >= begin, k).otherwise(b)
                sums.append(prior + F.get(score, F.lit(k)))
                origins.append(origin)
            return F.struct(F.array(*sums).alias("score"), F.concat(acc["back"], F.array(F.array(*origins))).alias("back"))

        last = acc["score"]
        ahead = t.let(F.array_max(last), lambda m: F.struct(last.alias("last"), m.alias("best"), (F.array_position(last, m) - 1).cast("int").alias("best_at")))
        return t.let(ahead, grown)

    none = F.struct(F.array(*[F.lit(0.0)] * len(tags)).alias("score"), F.array().cast("array<array<int>>").alias("back"))

    def traced(end: Column) -> Column:
        last = (F.array_position(end["score"], F.array_max(end["score"])) - 1).cast("int")
        back = F.slice(F.reverse(end["back"]), 1, F.greatest(F.size(end["back"]) - 1, F.lit(0)))
        return F.reverse(F.aggregate(back, F.array(last), lambda acc, b: F.concat(acc, F.array(F.get(b, F.element_at(acc, -1))))))

    return F.when(F.size(scores) > 0, t.let(F.aggregate(scores, none, step), traced)).otherwise(F.array().cast("array<int>"))


def _runs(tokens: Column, scores: Column, path: Column, tags: tuple[str, ...]) -> Column:
    """Entities: a token with B and the I tokens behind it, with the mean probability of their tags."""
    names = F.array(*[F.lit(x) for x in tags])
    kind = "array<struct<label:string,start:int,end:int,text:string,p:double,n:int>>"

    def tagged(i: Column) -> Column:
        s, k = F.get(scores, i), F.get(path, i)
        top = F.get(s, k)
        p = 1 / F.aggregate(s, F.lit(0.0), lambda acc, x: acc + F.exp(x - top))
        return F.struct(F.get(names, k).alias("tag"), p.alias("p"), F.get(tokens, i).alias("x"))

    def step(acc: Column, w: Column) -> Column:
        fresh = F.struct(F.substring(w["tag"], 3, 20).alias("label"), w["x"]["start"].alias("start"), w["x"]["end"].alias("end"), w["x"]["token"].alias("text"), w["p"].alias("p"), F.lit(1).alias("n"))
        last = F.element_at(acc, -1)
        longer = F.struct(last["label"].alias("label"), last["start"].alias("start"), w["x"]["end"].alias("end"), F.concat_ws(" ", last["text"], w["x"]["token"]).alias("text"),
                          (last["p"] + w["p"]).alias("p"), (last["n"] + 1).alias("n"))
        return F.when(w["tag"].startswith("B-"), F.concat(acc, F.array(fresh))).when(
            w["tag"].startswith("I-"), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(acc)

    words = F.transform(F.sequence(F.lit(0), F.size(tokens) - 1), tagged)
    runs = F.aggregate(words, F.array().cast(kind), step, lambda acc: F.transform(acc, lambda e: F.struct(
        e["label"].alias("label"), e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"), (e["p"] / e["n"]).alias("confidence"))))
    return F.when(F.size(tokens) > 0, runs).otherwise(F.array().cast(ENTITIES))


def tag_rows(df: DataFrame, tagger: Tagger, col: str = "text", out: str = "entities") -> DataFrame:
    """Add the entities of a text, in the row. A null text has null, a blank one none."""
    keep = df.columns
    step = token_table(df, col, in_row="__toks")
    step = t.once(step, _scores(F.col("__toks"), tagger), "__scores")
    step = t.once(step, _path(F.col("__scores"), tagger.tags), "__path")
    found = _runs(F.col("__toks"), F.col("__scores"), F.col("__path"), tagger.tags)
    return t.once(step, F.when(F.col(col).isNotNull(), found), out).select(*keep, out)


def entity_fields(entities: Column) -> Column:
    """Output field to text: street entities joined in order, of other fields the last one."""
    entries = []
    for field in dict.fromkeys(LABEL_FIELDS.values()):
        labels = [k for k, v in LABEL_FIELDS.items() if v == field]
        texts = F.transform(F.filter(entities, lambda e: e["label"].isin(labels)), lambda e: e["text"])  # noqa: B023
        value = F.nullif(F.array_join(texts, " "), F.lit("")) if field == "street" else F.try_element_at(texts, F.lit(-1))
        entries.append(F.struct(F.lit(field).alias("key"), value.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def entity_confidence(entities: Column) -> Column:
    """Mean confidence of the entities, null where there are none."""
    total = F.aggregate(entities, F.lit(0.0), lambda acc, e: acc + e["confidence"])
    return F.when(F.size(entities) > 0, total / F.size(entities))


def with_ml(df: DataFrame, tagger: Tagger | None, col: str) -> DataFrame:
    """Add ml_fields and ml_confidence of a cleaned text; without a tagger, both null."""
    if tagger is None:
        return df.withColumns({"ml_fields": F.lit(None).cast("map<string,string>"), "ml_confidence": F.lit(None).cast("double")})
    tagged = tag_rows(df, tagger, col, "__ents")
    made = F.struct(entity_fields(F.col("__ents")).alias("fields"), entity_confidence(F.col("__ents")).alias("confidence"))
    step = t.once(tagged, F.when(F.col("__ents").isNotNull(), made), "__ml")
    return step.select(*df.columns, F.col("__ml.fields").alias("ml_fields"), F.col("__ml.confidence").alias("ml_confidence"))
