"""Spans of label patterns against plain searches; training counts against the tokens themselves."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.operators import entities as en
from semtflow.sources.derived import addresses

WORDS = "mahallesi mah mah. cad caddesi cad.x sokağ sokağı sok sokak 12 7a no no: numara d k kat daire bulvar bulvarı bul bul. mahx . , : x/ d.5 k. no:5 1410. 1410.sok 5sok _ -".split()


def test_matches_are_those_of_a_plain_search():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(WORDS) + rng.choice([" ", " ", "  ", "", "\n"]) for _ in range(rng.randrange(14)))
        for _label, p in fv.LABELS_V1 + fv.LABELS_V2:
            c = re.compile(p)
            assert [m.span(1) for m in en._matches(c, re.compile(en._needed(p)), text)] == [m.span(1) for m in c.finditer(text)], (p, text)


def test_long_text_without_keywords(spark):
    """Leading words are tried only where a keyword follows; each word of the text was tried before, to the text's end."""
    df = spark.createDataFrame([(1, "kelime " * 20_000 + "ankara"), (2, None)], "addr_id long, address string")
    assert en.build_ner_table(df.limit(0)).count() == 0
    began = time.time()
    (row,) = en.build_ner_table(df).collect()
    assert [(s.start, s.label) for s in row.spans] == [(140_000, "IL")] and time.time() - began < 30


def test_tagger_learns_from_counts(spark, sf):
    """Copies of the addresses make no more rows to learn from, and weigh as the tokens do."""
    bio = en.bio_tags(en.build_ner_table(addresses(spark, sf).select("addr_id", "address"))).drop("spans")
    counted, doubled = en.tag_counts(bio, []), en.tag_counts(bio.unionAll(bio), [])
    assert doubled.count() == counted.count() < bio.count() / 2
    assert doubled.agg(F.sum("n")).first()[0] == 2 * bio.count()
    model = en.train_tagger(counted, 10)
    right = F.sum(F.when(F.col("predicted") == F.col("tag"), F.col("n")))
    share = en.tag_tokens(counted, model).agg(right / F.sum("n")).first()[0]
    plain = en.tag_tokens(bio, model).agg(F.avg((F.col("predicted") == F.col("tag")).cast("int"))).first()[0]
    assert share == pytest.approx(plain) and share > 0.9
