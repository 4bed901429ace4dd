"""The one-pass form of every pattern against its plain lazy expression, and its time on long texts."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.operators.patterns import GAP, HIT, match_patterns, patterns, read_pattern

WORDS = ["moda", "atatürk", "İnönü", "kâğıt", "no", "numara", "sokak", "sok", "sk", "kat", "daire", "12", "5a", "3", "7/2", "a5", "abc,", "12,", "sokak,", ",", "-", "(ev", "x/y", "no:", "5)", "1410.sok", "kadıköy/istanbul", "a_b", "--", "9,5"]
MORE = [
    ("m1", 1, "<text> <Mahalle> <Sokak> no <n>"), ("m2", 1, "<Sokak?> <text> kat <n>"), ("m3", 1, "<Mahalle> <n?> no <n2>"), ("m4", 1, "<text>, <Mahalle> no <n>"),
    ("m5", 1, "<Kat> kat <text> daire <Daire?>"), ("m6", 1, "<Mahalle> <text> <Sokak> no <n>"), ("m7", 1, "no <n> <text?>"), ("m8", 1, "<n> <Sokak> sokak <text> no <n2>"),
]


def texts(seed: int, n: int) -> list[str]:
    rng = random.Random(seed)
    gaps = [" "] * 12 + ["  ", "\n"]
    out = []

    def filled(m):
        kind = m.group(0)[1:-1]
        return "" if kind.endswith("?") and rng.random() < 0.4 else str(rng.randint(1, 99)) if kind[0] == "n" else " ".join(rng.choice(WORDS[:9] + ["x", "ev", ","]) for _ in range(rng.randint(1, 3)))

    for row in [*fv.PATTERNS, *MORE] * (n // 60):  # near the patterns themselves, with noise
        got = re.sub("<[^>]+>", filled, row[2])
        lead, tail = (" ".join(rng.choice(WORDS) for _ in range(rng.choice([0, 0, 1, 3]))) for _ in "ab")
        out.append((lead + " " + got + " " + tail).strip())
    for _ in range(n):
        pool = rng.sample(WORDS, rng.randint(3, 12)) + ["no", "12", "moda"]
        out.append("".join(rng.choice(pool) + rng.choice(gaps) for _ in range(rng.randint(1, 11))).removesuffix(" " if rng.random() < 0.8 else ""))
    return out


@pytest.mark.parametrize("strict", [False, True])
def test_same_match_as_the_lazy_expression(spark, strict):
    """Matched text and every group, over random sequences of words that the patterns use."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts(7 + strict, 4000))], "id int, text string").repartition(8).cache()
    made = patterns(strict=strict) + [read_pattern(*row, strict=strict) for row in MORE]
    cols = []
    for p in made:
        groups = GAP.join(f"${s.grp + 1}" for s in p.slots)
        form = f"{HIT}$1{GAP}{groups}"
        plain = F.regexp_replace("text", f"(?iUs)^.*?({p.regex.removeprefix('(?iU)')}).*$", form)
        cols.append(F.struct(F.lit(p.pattern_id).alias("p"), plain.alias("plain"), F.regexp_replace("text", p.scan, form).alias("scan")))
    both = df.select("text", F.explode(F.array(*cols)).alias("x")).select("text", "x.*")
    wrong = both.filter("plain <> scan").limit(5).collect()
    assert wrong == []
    hits = {r.p: r["count"] for r in both.filter(F.col("scan").startswith(HIT)).groupBy("p").count().collect()}
    assert len(hits) == len(made) and min(hits.values()) > 3


@pytest.mark.parametrize("filler", ["kelime", "no", "kat daire no sokak", "abc,", "no 5 daire kat", "12 moda", "- abc", "no 5 kat moda"])
def test_long_text_in_linear_time(spark, filler):
    """5,000 words that hold every literal word and a number, under one second a text."""
    one = " ".join([filler] * (5000 // len(filler.split())))
    text = f"{one} sokak no kat daire numara blok sk sok / , {one}"[: len(one)] + " , / 12"
    df = spark.createDataFrame([(1, text)], "addr_id int, text string")
    match_patterns(spark.createDataFrame([(1, "moda sokak no 12")], "addr_id int, text string")).collect()
    began = time.time()
    match_patterns(df).select("pattern_id", "matched").collect()
    assert time.time() - began < 3.0  # with the query's own second or two
