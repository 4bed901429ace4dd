"""Near words against the full edit neighbourhood; words, forms and roots against a restatement."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from semtflow.llm.common import table
from semtflow.llm.spelling import Vocabulary, entries, group_variants, last_forms, near_words


def one_edit(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v, strict=True)) == 1
    s, t = sorted((u, v), key=len)
    return len(t) == len(s) + 1 and any(t[:k] + t[k + 1 :] == s for k in range(len(t)))


def all_near(words):
    """Words that meet on a variant with one letter less, checked."""
    meet = defaultdict(set)
    for w in words:
        for x in {w, *(w[:k] + w[k + 1 :] for k in range(len(w)))}:
            meet[x].add(w)
    return {(u, v) for g in meet.values() for u in g for v in g if u < v and one_edit(u, v)}


def brute(rows):
    n = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{w}".encode())
            if h % 199 == 0:
                k = h % len(w)
                w = w[:k] + w[k + 1 :]
            n[w] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = defaultdict(set)
    for u, v in all_near(n):
        near[u].add(v)
        near[v].add(u)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 5 * n[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n[w], len(near[w]), n[form[w]] if w in form else None) for w in n}


@settings(max_examples=80, deadline=None)
@given(st.sets(st.text("abé", min_size=2, max_size=6), min_size=1, max_size=40))
def test_search_of_both_sides(words):
    words = sorted(words)
    v = Vocabulary(words)
    got = set()
    for i, w in enumerate(words):
        for side in (0, 1):
            for kind in (0, 1):
                one = lambda x: np.array([x])
                us, vs = v.near(side, one(i), one(kind), one(0), one(len(w)))
                got |= {tuple(sorted((words[a], words[b]))) for a, b in zip(us, vs, strict=True)}
    assert got == all_near(words)


def vocabulary(spark, words):
    return spark.createDataFrame([(w,) for w in words], "word string").repartition(4)


def test_near_words_with_hot_keys(spark):
    """Keys far over the bound are refined; no link is lost and no key stays wide but where one letter is open."""
    rng = random.Random(3)
    words = {"common" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(1500)} | {"".join(rng.choice("ab") for _ in range(9)) + "ending" for _ in range(300)}
    df = vocabulary(spark, sorted(words))
    for hot, shard in ((1 << 14, 1 << 16), (20, 400), (2, 50)):
        got = near_words(df, hot, shard).collect()
        assert len(got) == len({tuple(sorted(r)) for r in got}) and {tuple(sorted(r)) for r in got} == all_near(words)
    widest = entries(df, 20).selectExpr("key", "m - a - b AS open").groupBy("key", "open").count().filter("count > 20").agg({"open": "max"}).first()[0]
    assert widest is None or widest <= 1


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = group_variants(docs).collect()
    assert len(got) == len({r.word for r in got})
    assert {tuple(r) for r in got} == brute(docs.select("doc_id", "text").collect())
    assert any(r.form for r in got)


def test_awkward_documents(spark, awkward, awkward_rows):
    """Ties take the smaller word; chains lead to their last form."""
    more = [(900, "Grüßen " * 5 + "grüssen " * 30 + "GRÜSSEN grussen " * 5), (901, "letters " * 250 + "lettres letterz " * 50 + "letterzz " * 10 + "lettersz " * 5), (None, "nobody " * 5), (902, "x" * 70_000)]
    rows = [r[:2] for r in awkward_rows] + more
    docs = awkward.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    assert {tuple(r) for r in group_variants(docs, hot=3, shard=20).collect()} == brute(rows)


def test_last_forms(spark):
    chain = spark.createDataFrame([(f"w{k}", f"w{k + 1}") for k in range(11)] + [("a", "w3")], "word string, form string")
    assert {r.root for r in last_forms(chain).collect()} == {"w11"}


def test_empty(nothing):
    assert group_variants(nothing).collect() == []
