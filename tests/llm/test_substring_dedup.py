from collections import Counter

from semtflow.llm.common import table
from semtflow.llm.substring_dedup import dedup_substrings


def brute(rows, span=35):
    words = [(i, (t or "").encode().split()) for i, t in rows]
    seen = Counter(tuple(w[k : k + span]) for _, w in words for k in range(len(w) - span + 1))
    out = []
    for i, w in words:
        gone = set()
        for k in range(len(w) - span + 1):
            if seen[tuple(w[k : k + span])] > 1:
                gone.update(range(k, k + span))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return Counter(out)


def result(df, span=35):
    return Counter((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in dedup_substrings(df, span).collect())


def test_awkward_documents(awkward, awkward_rows):
    assert result(awkward) == brute([r[:2] for r in awkward_rows])
    assert result(awkward, 4) == brute([r[:2] for r in awkward_rows], 4)


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_empty(nothing):
    assert dedup_substrings(nothing).collect() == []
