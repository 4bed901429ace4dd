"""Cleaning columns against hand-made rows and against Python itself."""

import re
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t


def column(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x string").repartition(1)
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_case_and_composition(spark):
    assert column(spark, t.tr_lower, ["İSTANBUL", "IŞIK", None, ""]) == ["istanbul", "işik", None, ""]
    assert column(spark, t.tr_unicode, ["şişli", "İzmir", "IŞIK"]) == ["şişli", "izmir", "ıŞık".replace("k", "K")]


def test_fold(spark):
    assert column(spark, t.ascii_fold, ["İstanbul", "Şanlıurfa", " Çankırı ", "Elâzığ"]) == ["istanbul", "sanliurfa", "cankiri", "elazig"]


def test_compose_equals_nfc(spark):
    words = [unicodedata.normalize("NFD", w) for w in ["Çağrı Şükrü Öğün", "château", "Ấn Độ", "plain"]]
    assert column(spark, t.compose, words) == [unicodedata.normalize("NFC", w) for w in words]


def python_expand(text):
    for key in sorted(fv.ABBREVIATIONS, key=len, reverse=True):
        tail = r":(?=\s|\w|$)" if key.endswith(":") else r"\b"
        text = re.sub(r"\b" + re.escape(key.rstrip(":")) + tail, fv.ABBREVIATIONS[key], text, flags=re.I)
    return text


def test_expand_equals_key_by_key(spark):
    rows = ["moda mah. 12 sk. no:5 d:3 k.2", "n:7 d: 4", "n:mah d:sk", "atatürk cd. apt karsisi", "kapı kapi yani", "is merkezi", "MAH Sok BLV"]
    assert column(spark, t.expand_abbrev, rows) == [python_expand(r) for r in rows]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet="abçdğıikmnoösşuü .:,/-0123456789nd", max_size=60), min_size=20, max_size=40))
def test_expand_fuzz(spark, rows):
    assert column(spark, t.expand_abbrev, rows) == [python_expand(r) for r in rows]


def test_clean_and_tokens(spark):
    assert column(spark, t.clean_text, ["  Moda  Mah. Bahariye Sk. No:5/3 ", None, "   "]) == ["moda mahalle bahariye sokak numara 5 3", "", ""]
    assert column(spark, t.tokens, ["a|b,c;d/e-f_g  h", ""]) == [list("abcdefgh"), []]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(max_size=200), min_size=10, max_size=30))
def test_never_fails_and_tokens_are_stable(spark, rows):
    rows = [r.encode("utf-8", "ignore").decode() for r in rows]
    cleaned = column(spark, t.clean_text, rows)
    assert all(c is not None for c in cleaned)
    toks = column(spark, t.tokens, cleaned)
    assert column(spark, t.tokens, [" ".join(x) for x in toks]) == toks


def test_title_keeps_dotted_capital(spark):
    assert column(spark, t.title, ["İstanbul ANKARA", "kadıköy"]) == ["İstanbul Ankara", "Kadıköy"]
