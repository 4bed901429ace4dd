import re

from semtflow.llm.common import table
from semtflow.llm.quality import rate_documents


def brute(text):
    text = text or ""
    ws = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = [tuple(ws[k : k + 5]) for k in range(len(ws) - 4)]
    seen = {}
    for k, r in enumerate(runs):
        seen.setdefault(r, []).append(k)
    again = {k + j for at in seen.values() if len(at) > 1 for k in at for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(ws)
    return n, sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), n < 10 or 100 * len(again) > 20 * n


def check(df, labels, texts):
    got = rate_documents(df, labels).collect()
    rules = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got)
    assert rules == sorted((i is None, i or 0, *brute(t)) for i, t in texts)
    assert all(r.kept is not None and not (r.kept and r.base_failed) for r in got)
    return got


def test_awkward_documents(spark, awkward, awkward_rows):
    labels = spark.createDataFrame([(100, 1, 0), (100, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    check(awkward, labels, [r[:2] for r in awkward_rows])


def test_given_documents(spark, sf):
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in check(docs, labels, [(r.doc_id, r.text) for r in docs.collect()])}
    marks = labels.collect()
    bad = [r.doc_id for r in marks if r.quality == 0]
    good = [r.doc_id for r in marks if r.quality == 1 and not got[r.doc_id].base_failed]
    assert sum(not got[i].kept for i in bad) >= 0.9 * len(bad) and sum(got[i].kept for i in good) >= 0.98 * len(good)


def test_no_labels(awkward, nothing):
    assert {r.mean_ratio for r in rate_documents(awkward, nothing.selectExpr("doc_id", "1 AS quality", "0 AS toxic")).collect()} <= {0.0}


def test_empty(nothing):
    assert rate_documents(nothing, nothing.selectExpr("doc_id", "1 AS quality")).collect() == []
