"""Entity labelling, training tables and the token tagger (G).

Spark's regex functions return text, not offsets, so one Arrow function finds
the spans of a pattern list; everything after works on span arrays in the row.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IndexToString, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.session import checkpointed

SPAN = "array<struct<start:int,end:int,label:string>>"


#: Words and the blanks between them, at the front of a pattern.
_WORDS = r"\b(\w+(?:\s+\w+)*)\s+"


def _needed(pattern: str) -> str:
    """What a match of the pattern cannot do without: all behind leading words, else its first letters."""
    if pattern.startswith(_WORDS):
        return pattern.removeprefix(_WORDS)
    letters = re.search(r"[^\W\d_]+(?!\?)", re.sub(r"\\.", " ", pattern))
    return letters.group(0) if letters else r"\d"


def _matches(pattern: re.Pattern, needed: re.Pattern, text: str) -> Iterator[re.Match]:
    """As ``pattern.finditer(text)``. Where nothing the pattern needs is left, leading words are not tried in vain."""
    last = max((m.start() for m in needed.finditer(text)), default=-1)
    at = 0
    while at <= last and (m := pattern.search(text, at)):
        yield m
        at = m.end()


def _find(patterns: list[tuple[str, str]], whole: set[str]):
    """Arrow function: all spans of the patterns in order; labels in ``whole`` span the full match."""
    compiled = [(label, re.compile(p), re.compile(_needed(p)), 0 if label in whole else 1) for label, p in patterns]

    @F.arrow_udf(SPAN)
    def spans(texts: pa.Array) -> pa.Array:
        ends, starts, stops, labels = [0], [], [], []
        for s in texts.to_pylist():
            for label, p, needed, g in compiled if s else ():
                for m in _matches(p, needed, s):
                    starts.append(m.start(g))
                    stops.append(m.end(g))
                    labels.append(label)
            ends.append(len(starts))
        rows = pa.StructArray.from_arrays([pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(labels, pa.string())], ["start", "end", "label"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows, mask=texts.is_null())

    return spans


def _word_spans(tokens: Column, groups: list[tuple[str, list[str]]]) -> Column:
    """Spans of the single-blank tokens that are in a word list; the first list wins."""
    def step(acc: Column, w: Column) -> Column:
        end = acc["pos"] + F.length(w)
        label = F.coalesce(*[F.when(w.isin(ws), name) for name, ws in groups])
        hit = F.struct(acc["pos"].alias("start"), end.alias("end"), label.alias("label"))
        return F.struct((end + 1).alias("pos"), F.when(label.isNotNull(), F.concat(acc["hits"], F.array(hit))).otherwise(acc["hits"]).alias("hits"))

    start = F.struct(F.lit(0).alias("pos"), F.array().cast(SPAN).alias("hits"))
    return F.aggregate(tokens, start, step)["hits"]


def _overlaps(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _resolve(spans: Column, order: Column, strength) -> Column:
    """Ordered fold: a span enters unless a kept one it overlaps is at least as strong; weaker ones before that leave."""
    keyed = F.transform(spans, lambda s, i: F.struct(
        s["start"].alias("start"), order(s).alias("k"), i.alias("i"), s["end"].alias("end"), s["label"].alias("label"), strength(s).alias("w")))

    def fold(acc: Column, s: Column) -> Column:
        blocks = F.transform(acc, lambda f, i: F.when(_overlaps(f, s) & (s["w"] <= f["w"]), i))

        def entered(block: Column) -> Column:
            kept = F.filter(acc, lambda f, i: ~(_overlaps(f, s) & (s["w"] > f["w"]) & (block.isNull() | (i < block))))
            return F.when(block.isNull(), F.concat(kept, F.array(s))).otherwise(kept)

        return t.let(F.get(F.filter(blocks, lambda x: x.isNotNull()), F.lit(0)), entered)

    kept = F.aggregate(F.array_sort(keyed), F.array().cast("array<struct<start:int,k:int,i:int,end:int,label:string,w:int>>"), fold)
    return F.array_sort(F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))


def resolve_overlaps_longest(spans: Column) -> Column:
    return _resolve(spans, lambda s: -s["end"], lambda s: s["end"] - s["start"])


def resolve_overlaps_priority(spans: Column) -> Column:
    rank = lambda s: F.coalesce(F.element_at(t.table({k: i + 1 for i, k in enumerate(fv.LABEL_ORDER)}, "map<string,int>"), s["label"]), F.lit(10))
    return _resolve(spans, rank, lambda s: -rank(s))


def label_entities_v1(df: DataFrame, col: str = "text") -> DataFrame:
    """Group spans of all patterns, city else district words; overlaps keep the longer."""
    low = t.once(df, F.lower(F.col(col)), "__low")
    found = low.withColumn("__found", _find(fv.LABELS_V1, set())(F.col("__low")))
    words = _word_spans(t.words(F.col("__low")), [("IL", fv.LABEL_CITIES_V1), ("ILCE", fv.LABEL_DISTRICTS_V1)])
    return found.withColumn("spans", resolve_overlaps_longest(F.concat("__found", words))).drop("__low", "__found")


def label_entities_v2(df: DataFrame, col: str = "text") -> DataFrame:
    """Whole-match spans that may not touch earlier kinds, number spans, city and district words; overlaps by label order."""
    low = t.once(df, F.lower(F.col(col)), "__low")
    found = low.withColumn("__found", _find(fv.LABELS_V2, {"MAH", "CADDE", "SOKAK", "BULVAR"})(F.col("__low")))

    def admit(acc: Column, s: Column) -> Column:
        touches = F.exists(acc, lambda f: _overlaps(f, s) & ((s["label"] != "CADDE") | (f["label"] == "MAH")))
        barred = s["label"].isin("CADDE", "SOKAK", "BULVAR") & touches
        return F.when(barred, acc).otherwise(F.concat(acc, F.array(s)))

    kept = F.aggregate("__found", F.array().cast(SPAN), admit)
    toks = t.words(F.col("__low"))
    every = F.concat(kept, _word_spans(toks, [("IL", fv.LABEL_CITIES_V2)]), _word_spans(toks, [("ILCE", fv.LABEL_DISTRICTS_V2)]))
    return found.withColumn("spans", resolve_overlaps_priority(every)).drop("__low", "__found")


def build_ner_table(addresses: DataFrame, col: str = "address", version: int = 2) -> DataFrame:
    """Cleaned text with its spans, rows without any left out."""
    cleaned = t.once(addresses, t.clean_text(F.col(col)), "text")
    labelled = (label_entities_v2 if version == 2 else label_entities_v1)(cleaned)
    return t.once(labelled, F.col("spans"), "spans").filter(F.size("spans") > 0)


def train_test_split(df: DataFrame, key: str = "addr_id") -> DataFrame:
    """Deterministic 80/20 split by key."""
    return df.withColumn("split", F.when(F.pmod(F.col(key) * 7919, F.lit(100)) < 80, "train").otherwise("test"))


def token_table(df: DataFrame, col: str = "text", in_row: str | None = None) -> DataFrame:
    """One row per single-blank token with its offsets and neighbours; with ``in_row``, an array of that name instead."""
    def step(acc: Column, w: Column) -> Column:
        end = acc["pos"] + F.length(w)
        one = F.struct(acc["pos"].alias("start"), end.alias("end"), w.alias("token"))
        return F.struct((end + 1).alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

    empty = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,token:string>>").alias("out"))
    toks = t.once(df, F.aggregate(t.words(F.col(col)), empty, step)["out"], "__t")
    near = lambda i: F.coalesce(F.get("__t", i)["token"], F.lit(""))
    rows = F.transform("__t", lambda x, i: F.struct(i.alias("i"), x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"),
                                                  near(i - 1).alias("before"), near(i + 1).alias("after"), F.coalesce(F.get("__t", i - 1)["start"], F.lit(-1)).alias("prev_start")))
    if in_row:
        return t.once(toks, rows, in_row).drop("__t")
    return toks.select(*df.columns, F.explode_outer(rows).alias("x")).filter(F.col("x").isNotNull()).select(*df.columns, "x.*")


def bio_tags(df: DataFrame, col: str = "text") -> DataFrame:
    """B- on the first token of a span, I- on its later tokens, O elsewhere."""
    tok = token_table(df, col)
    begins = lambda s: (F.col("start") >= s["start"]) & (F.col("prev_start") < s["start"]) & (F.col("start") < s["end"])
    inside = lambda s: (F.col("start") > s["start"]) & (F.col("end") <= s["end"])
    b, i = F.get(F.filter("spans", begins), F.lit(0))["label"], F.get(F.filter("spans", inside), F.lit(0))["label"]
    return tok.withColumn("tag", F.when(b.isNotNull(), F.concat(F.lit("B-"), b)).when(i.isNotNull(), F.concat(F.lit("I-"), i)).otherwise("O"))


def _features() -> Column:
    w = F.col("token")
    return F.array(
        F.concat(F.lit("w="), w), F.concat(F.lit("s="), F.substring(w, -3, 3)), F.concat(F.lit("p="), F.col("before")), F.concat(F.lit("n="), F.col("after")),
        F.when(w.rlike("^[0-9]+$"), "number").otherwise("word"), F.when(F.col("i") == 0, "first").otherwise("later"))


def tag_counts(bio: DataFrame, by: list[str]) -> DataFrame:
    """tag, ``by`` and what a token shows, with the number of such tokens: as many rows as the vocabulary makes, not one a token.

    Cut here, so that the passes of a fit and the evaluation do not label the texts again.
    """
    return checkpointed(bio.groupBy("tag", *by, _features().alias("features_text")).agg(F.count(F.lit(1)).alias("n")))


def train_tagger(counted: DataFrame, iterations: int = 30, buckets: int = 4096) -> PipelineModel:
    """Multinomial logistic tagger over hashed window features, from ``tag_counts``."""
    data = counted.withColumn("weight", F.col("n").cast("double"))
    return Pipeline(stages=[
        StringIndexer(inputCol="tag", outputCol="label", handleInvalid="keep"),
        HashingTF(inputCol="features_text", outputCol="features", numFeatures=buckets),
        LogisticRegression(maxIter=iterations, family="multinomial", regParam=1e-4, weightCol="weight"),
    ]).fit(data)


def tag_tokens(tokens: DataFrame, model: PipelineModel) -> DataFrame:
    """Predicted tag and its probability for every row of tokens or of ``tag_counts``."""
    indexer, hashing, lr = model.stages
    shown = tokens if "features_text" in tokens.columns else tokens.withColumn("features_text", _features())
    scored = lr.transform(hashing.transform(shown))
    named = IndexToString(inputCol="prediction", outputCol="predicted", labels=[*indexer.labels, "__unseen"]).transform(scored)
    return named.withColumn("probability", F.array_max(vector_to_array("probability"))).drop("features_text", "features", "rawPrediction", "prediction")


def tag_entities(df: DataFrame, model: PipelineModel, col: str = "text", key: str = "addr_id") -> DataFrame:
    """Entities of each text: runs of tokens with one label, with their mean probability."""
    tagged = tag_tokens(token_table(df, col), model)
    kind = F.when(F.col("predicted") == "O", None).otherwise(F.substring("predicted", 3, 20))
    by = Window.partitionBy(key).orderBy("i")  # tokens of one address
    runs = tagged.withColumn("ent", kind).withColumn("was", F.lag("ent").over(by))
    fresh = F.col("ent").isNotNull() & (F.col("predicted").startswith("B-") | ~F.col("ent").eqNullSafe(F.col("was")))
    runs = runs.withColumn("run", F.sum(fresh.cast("int")).over(by)).filter(F.col("ent").isNotNull())
    return runs.groupBy(key, "run").agg(
        F.first("ent").alias("label"), F.min("start").alias("start"), F.max("end").alias("end"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]), " ").alias("text"),
        F.avg("probability").alias("confidence")).drop("run")


def components_to_spans(df: DataFrame, text: str = "text", components: str = "components") -> DataFrame:
    """First occurrence of each component value in the text."""
    e = df.select("addr_id", F.col(text).alias("__text"), F.explode(components).alias("name", "value")).filter(F.coalesce("value", F.lit("")) != "")
    start = F.expr("locate(value, __text) - 1")
    return e.withColumn("start", start).filter(F.col("start") >= 0).select(
        "addr_id", "start", (F.col("start") + F.length("value")).alias("end"), F.upper("name").alias("label"), F.col("value").alias("text"))


# --- generated addresses: portable SQL over a key ----------------------------

# fixed values: pools of the generated addresses
CITIES = ["istanbul", "ankara", "izmir", "bursa", "antalya"]
TOWNS = ["kadıköy", "çankaya", "konak", "nilüfer", "kepez", "buca", "mamak"]
QUARTERS = ["atatürk mahallesi", "moda mahallesi", "yenişehir mahallesi", "kültür mahallesi"]
ROADS = [("atatürk caddesi", "CADDE"), ("sakarya sokak", "SOKAK"), ("barbaros bulvarı", "BULVAR")]
SITES = ["park sitesi", "villa sitesi"]


def _pick(k: str, step: int, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE ({k} * {step}) % {len(values)} {arms} END"


def synth_columns(k: str, template: int) -> list[str]:
    """Select list of one template: text and its spans as ``start-end-LABEL`` joined by ``;``."""
    parts = {
        "IL": _pick(k, 3, CITIES), "ILCE": _pick(k, 5, TOWNS), "MAH": _pick(k, 7, QUARTERS), "ROAD": _pick(k, 11, [r for r, _ in ROADS]),
        "NO": f"CAST({k} % 499 + 1 AS VARCHAR(9))", "DAIRE": f"CAST({k} % 20 + 1 AS VARCHAR(9))", "KAT": f"CAST({k} % 8 + 1 AS VARCHAR(9))",
        "SITE": _pick(k, 13, SITES), "BLOK": _pick(k, 17, ["a blok", "b blok", "c blok"]),
    }
    kind = _pick(k, 11, [c for _, c in ROADS])
    layout = [
        [("IL", ""), ("ILCE", ""), ("MAH", ""), ("ROAD", ""), ("NO", "no ")],
        [("MAH", ""), ("ROAD", ""), ("NO", "no "), ("DAIRE", "daire "), ("KAT", "kat "), ("IL", "")],
        [("SITE", ""), ("IL", ""), ("ILCE", ""), ("MAH", ""), ("BLOK", ""), ("NO", "no ")],
    ][template]
    text = " || ' ' || ".join(f"'{lead}' || {parts[n]}" if lead else parts[n] for n, lead in layout)
    pos, spans = "0", []
    for n, lead in layout:
        start = f"{pos} + {len(lead)}"
        label = kind if n == "ROAD" else f"'{n}'"
        spans.append(f"CAST({start} AS VARCHAR(9)) || '-' || CAST({start} + length({parts[n]}) AS VARCHAR(9)) || '-' || {label}")
        pos = f"{start} + length({parts[n]}) + 1"
    return [f"{k} AS addr_id", f"{text} AS text", f"{' || {q};{q} || '.format(q=chr(39)).join(spans)} AS spans"]


def synth_select(k: str) -> list[str]:
    """The three templates by key, in one pass."""
    each = [synth_columns(k, i) for i in range(3)]
    by_key = lambda c, name: f"CASE {k} % 3 " + " ".join(f"WHEN {i} THEN {e[c].removesuffix(' AS ' + name)}" for i, e in enumerate(each)) + f" END AS {name}"
    return [f"{k} AS addr_id", by_key(1, "text"), by_key(2, "spans")]


def synth_addresses(keys: DataFrame, key: str) -> DataFrame:
    """Generated addresses over the rows of a key table, template by key."""
    return keys.selectExpr(*synth_select(key))


def augment_addresses(df: DataFrame) -> DataFrame:
    """Each text, and for three keys in ten its abbreviated, uppercase and punctuated variants where they differ."""
    short = F.replace(F.replace(F.replace("text", F.lit("mahallesi"), F.lit("mah")), F.lit("caddesi"), F.lit("cad")), F.lit("sokak"), F.lit("sok"))
    punct = F.replace(F.replace(F.replace("text", F.lit(" no "), F.lit(" no: ")), F.lit(" daire "), F.lit(" d. ")), F.lit(" kat "), F.lit(" k. "))
    one = lambda name, c: F.struct(F.lit(name).alias("variant"), c.alias("text"))
    chosen = F.pmod("addr_id", F.lit(10)) < 3
    rows = F.array_compact(F.array(
        one("plain", F.col("text")), F.when(chosen & (short != F.col("text")), one("short", short)),
        F.when(chosen, one("upper", F.upper("text"))), F.when(chosen & (punct != F.col("text")), one("punct", punct))))
    return df.select("addr_id", F.explode_outer(rows).alias("v")).select("addr_id", "v.*")


BENCH_TEMPLATES = [
    "{q} {r} No: {n} {t}/{c}", "{q} {r} {n}/{d} {t} {c}", "{t} {q} {r} No:{n} Daire:{d} {c}", "{c} {t} {q} {r} {n}",
]


def benchmark_columns(k: str) -> list[str]:
    """Four address templates with the components they should yield."""
    p = {"q": _pick(k, 7, QUARTERS), "r": _pick(k, 11, [r for r, _ in ROADS]), "n": f"CAST({k} % 499 + 1 AS VARCHAR(9))", "t": _pick(k, 5, TOWNS),
         "c": _pick(k, 3, CITIES), "d": f"CAST({k} % 20 + 1 AS VARCHAR(9))"}

    def line(template: str) -> str:
        pieces = re.split(r"\{(\w)\}", template)
        return " || ".join(p[x] if i % 2 else f"'{x}'" for i, x in enumerate(pieces) if x)

    arms = " ".join(f"WHEN {i} THEN {line(tpl)}" for i, tpl in enumerate(BENCH_TEMPLATES))
    return [f"{k} AS addr_id", f"CASE {k} % 4 {arms} END AS address", f"{p['c']} AS city", f"{p['t']} AS district", f"{p['q']} AS neighborhood",
            f"{p['r']} AS street", f"{p['n']} AS number", f"CASE {k} % 4 WHEN 0 THEN 'easy' WHEN 3 THEN 'hard' ELSE 'medium' END AS difficulty"]
