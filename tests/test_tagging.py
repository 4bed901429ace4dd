"""Decoding in the row against a plain Viterbi, and a tagger on rows it has not seen."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from semtflow.functions import text as t
from semtflow.operators import cascade, tagging
from semtflow.operators.entities import bio_tags, build_ner_table, token_table, train_test_split
from semtflow.operators.tagging import Tagger, _path, _scores, entity_confidence, entity_fields, fit_tagger, load_tagger, save_tagger, tag_rows
from semtflow.sources.derived import addresses

TAGS = ("B-IL", "B-MAH", "I-IL", "I-MAH", "O")


def allowed(seq):
    return all(not tag.startswith("I-") or (k and seq[k - 1][2:] == tag[2:]) for k, tag in enumerate(seq))


def best(scores):
    """The best allowed sequence out of all."""
    return max((math.fsum(s[TAGS.index(x)] for s, x in zip(scores, seq, strict=True)), seq) for seq in itertools.product(TAGS, repeat=len(scores)) if allowed(seq))


def test_best_path(spark):
    rng = random.Random(2)
    rows = [(k, [[rng.uniform(-2, 2) for _ in TAGS] for _ in range(k % 6)]) for k in range(60)]
    got = spark.createDataFrame(rows, "k int, s array<array<double>>").withColumn("p", _path(F.col("s"), TAGS)).collect()
    for r in got:
        seq = tuple(TAGS[k] for k in r.p)
        assert len(seq) == len(r.s) and allowed(seq)
        if seq:
            assert math.fsum(s[TAGS.index(x)] for s, x in zip(r.s, seq, strict=True)) == pytest.approx(best(r.s)[0])


@pytest.fixture(scope="module")
def tagger(spark, sf):
    rows = train_test_split(addresses(spark, sf, "part", "(p_partkey + 1000003)"))
    return fit_tagger(bio_tags(build_ner_table(rows.filter("split = 'train'").select("addr_id", "address")).select("addr_id", "text", "spans")), 20, 1024)


def test_entities_of_unseen_rows(spark, sf, tagger):
    """Spans as labelled for nine in ten; every run is a stretch of the text; B opens it."""
    rows = addresses(spark, sf).select("addr_id", "address")
    gold = build_ner_table(rows).select("addr_id", "text", "spans")
    got = tag_rows(gold, tagger).collect()
    same = total = 0
    for r in got:
        spans = {(s.start, s.end, s.label) for s in r.spans}
        found = {(e.start, e.end, e.label) for e in r.entities}
        same += len(spans & found)
        total += len(spans)
        assert all(r.text[e.start : e.end] == e.text and 0 < e.confidence <= 1 for e in r.entities)
    assert same >= 0.9 * total and total > 100


def test_stored_tagger_is_the_same(spark, tagger, tmp_path):
    save_tagger(spark, tagger, str(tmp_path / "tagger"))
    assert load_tagger(spark, str(tmp_path / "tagger")) == tagger


def test_scores_sum_weights(spark):
    """The bias and one weight row for each of the seven buckets of a token."""
    one = Tagger(("B-X", "O"), (*[(float(b), 0.5) for b in range(4)], (10.0, 0.0)))
    toks = token_table(spark.createDataFrame([(1, "ab 12")], "addr_id int, text string"), in_row="k")
    first, second = toks.select(_scores(F.col("k"), one).alias("s")).first().s
    assert first[1] == second[1] == 3.5 and 10 <= first[0] <= 31 and first[0] == int(first[0])


def test_fields_and_confidence(spark):
    e = "named_struct('label','{}','start',{},'end',0,'text','{}','confidence',{}D)"
    ents = "array(" + ",".join(e.format(*x) for x in [("MAH", 0, "moda", 0.5), ("CADDE", 5, "a caddesi", 1.0), ("SOKAK", 9, "b sokak", 0.9), ("NO", 20, "3", 0.8), ("NO", 30, "5", 0.8), ("XX", 40, "?", 1.0)]) + ")"
    r = spark.range(1).select(entity_fields(F.expr(ents)).alias("f"), entity_confidence(F.expr(ents)).alias("c"), entity_confidence(F.expr("slice(" + ents + ", 1, 0)")).alias("n")).first()
    assert r.f == {"neighborhood": "moda", "street": "a caddesi b sokak", "number": "5"} and r.c == pytest.approx(5.0 / 6) and r.n is None


def test_cascade_reads_the_text(spark, sf, tagger):
    """Rows without a sure pattern take the tagger's fields, found in their own text."""
    rows = addresses(spark, sf).select("addr_id", "address").unionAll(spark.createDataFrame([(-1, None), (-2, ""), (-3, " .. ")], "addr_id long, address string"))
    got = cascade.normalize_addresses(rows, None, tagger=tagger).collect()
    ml = [r for r in got if r.method.startswith("ml")]
    assert ml and len(got) == rows.count()
    texts = {r.addr_id: r.text for r in rows.select("addr_id", t.clean_text(F.col("address")).alias("text")).collect()}
    for r in ml:
        fields = [v for k, v in r.fields.asDict().items() if v and k != "street"]
        assert all(v in texts[r.addr_id] for v in fields) and r.confidence >= 0.7
    assert {r.method for r in cascade.normalize_addresses(rows, None).collect()} <= {"error", "pattern_high", "pattern_medium", "fallback"}


def test_a_fit_reads_tokens_that_show_the_same_once(spark, monkeypatch):
    df = spark.createDataFrame([(i, f"moda mahallesi bahariye sokak no {i % 4}") for i in range(40)], "addr_id long, address string")
    read, cut = [], tagging.checkpointed
    monkeypatch.setattr(tagging, "checkpointed", lambda d: read.append(cut(d)) or read[0])
    bio = bio_tags(build_ner_table(df).select("addr_id", "text", "spans"))
    assert "B-MAH" in fit_tagger(bio, iterations=2).tags
    assert read[0].count() <= bio.count() / 10 and read[0].agg(F.sum("weight")).first()[0] == bio.count()


def test_fit_asks_spark_once_for_all_buckets(spark, sf, monkeypatch):
    """A call of the driver for each bucket took as long as the fit itself."""
    monkeypatch.setattr(tagging.HashingTF, "indexOf", None)
    bio = bio_tags(build_ner_table(addresses(spark, sf).select("addr_id", "address")).select("addr_id", "text", "spans"))
    fitted = fit_tagger(bio, 2, 64)
    assert len(fitted.weights) == 65 and all(len(w) == len(fitted.tags) for w in fitted.weights)
