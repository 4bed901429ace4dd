import math
import zlib
from collections import Counter

import numpy as np
import pytest

from semtflow.llm.common import table
from semtflow.llm.toxicity import Model, _spelled, build_model, class_ratios, drop_toxic, prefix_counts, score_documents
from semtflow.llm.wordhash import mix

TEXTS = [("you are an idiot clown", 1), ("idiots everywhere", 1), ("the river runs", 0), ("the rivers ran to an island", 0), ("", 0), (None, 1), ("the clown car", 0)]


def brute(folds):
    """The ratio of every beginning straight from the definition: words once for each document."""
    n, kinds = {0: Counter(), 1: Counter()}, Counter()
    seen = set()
    for k, (t, c) in enumerate(TEXTS):
        if (0, 2)[k % 2] not in folds:
            continue
        for w in set((t or "").lower().split()):
            raw = w.encode() + b"\x03"
            n[c].update(raw[: k + 1] for k in range(len(raw)))
            seen.add(raw)
    for raw in seen:
        kinds.update(raw[: k + 1] for k in range(len(raw)))
    spread = {g for g in kinds if any(x[:-1] == g[:-1] for x in n[0]) and any(x[:-1] == g[:-1] for x in n[1])}
    return n, kinds, spread


def ratio_of(n, kinds, prefix, discount):
    ctx = [g for g in kinds if g[:-1] == prefix[:-1]]
    total = [sum(n[c][g] for g in ctx) for c in (0, 1)]
    if not all(total):
        return 0.0
    freed = [discount[c] * sum(n[c][g] > 0 for g in ctx) / total[c] for c in (0, 1)]
    if prefix not in kinds:
        return math.log(freed[1] / freed[0])
    shared = kinds[prefix] / sum(kinds[g] for g in ctx)
    p = [max(n[c][prefix] - discount[c], 0) / total[c] + freed[c] * shared for c in (0, 1)]
    return math.log(p[1] / p[0])


@pytest.mark.parametrize("folds", [(0, 2), (0,), (2,)])
def test_ratios_by_definition(spark, folds):
    rows = [(t, c, (0, 2)[k % 2]) for k, (t, c) in enumerate(TEXTS)]
    counts = prefix_counts(spark.createDataFrame(rows, "text string, toxic int, fold int"))
    model = build_model(class_ratios(counts, folds))
    n, kinds, _ = brute(folds)
    everything = brute((0, 2))[2]  # rows that one class alone has may have stayed behind, in either fold
    used = {c: [v for g, v in n[c].items() if g in everything or counts_edge(g)] for c in (0, 1)}
    got = class_ratios(counts, folds)
    discount = {c: (lambda a, b: a / (a + 2 * b) if a else 0.5)(sum(v == 1 for v in used[c]), sum(v == 2 for v in used[c])) for c in (0, 1)}
    for word in ("idiot", "idiots", "river", "clown", "clowns", "the", "unseen", "çödé", "island", "you"):
        raw = np.frombuffer(word.encode(), np.uint8)
        upto, before, _ = _spelled(raw, np.array([0]), np.array([raw.size]))
        full = word.encode() + b"\x03"
        want = [ratio_of(n, kinds, full[: k + 1], discount) for k in range(len(full))]
        assert model.ratios(upto, before).tolist() == pytest.approx(want, abs=2e-3), word
    assert got.count() == got.select("h").distinct().count()


def counts_edge(g):
    """Beginnings of the first and the last word stay: these texts fit in one batch."""
    words = sorted({w.encode() + b"\x03" for t, _ in TEXTS for w in (t or "").lower().split()})
    return any(w.startswith(g[:-1]) for w in (words[0], words[-1]))


def test_model_keeps_every_row():
    keys = np.arange(200_000, dtype=np.uint64)
    model = Model()
    model.put(mix(keys), keys.astype(np.float32))
    got, found = model.find(mix(keys))
    assert found.all() and (got == keys.astype(np.float32)).all()
    assert not model.find(mix(keys + np.uint64(1 << 40)))[1].any()


def test_large_model_keeps_every_row(spark):
    n = (1 << 21) + 1000
    rows = spark.range(n).selectExpr("xxhash64(id) AS h", "CAST(id % 7 AS double) AS ratio")
    model, want = build_model(rows), rows.toPandas()
    got, found = model.find(want["h"].to_numpy().view(np.uint64))
    assert found.all() and (got == want["ratio"]).all()


def test_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).selectExpr("row.doc_id AS doc_id", "held_out", "score", "predicted").join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    tp = sum(r.predicted and r.toxic for r in held)
    assert tp >= 0.9 * sum(r.predicted for r in held)


def test_both_training_folds_are_counted(spark):
    """A toxic word that only documents of fold 2 hold counts, too."""
    fold = lambda i: zlib.crc32(str(i).encode()) % 3
    bad = {0: "idiot clown", 2: "moron jerk"}
    rows = [(i, (bad.get(fold(i), "moron") + " goes by the river") if i % 2 else "the calm river runs by the old town", i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    probes = spark.createDataFrame([(1000, "idiot clown"), (1001, "moron jerk"), (1002, "the calm old town")], "doc_id long, text string")
    got = {r.row.doc_id: r.top3 for r in score_documents(docs.drop("toxic").unionByName(probes), docs.select("doc_id", "toxic")).collect()}
    assert got[1000] > 0.3 and got[1001] > 0.3 and got[1002] < 0.3


def test_held_out_by_language(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = score_documents(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels, ["doc_id", "lang"]).selectExpr("row.doc_id AS doc_id", "row.lang AS lang", "held_out", "predicted").join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    share = {x: [sum(r.predicted for r in held if r.toxic and r.lang == x), sum(r.toxic for r in held if r.lang == x)] for x in {r.lang for r in held}}
    least = {"en": 0.9, "fr": 0.9, "de": 0.8, "es": 0.8}
    assert all(share[x][0] >= least[x] * share[x][1] for x in least), share
    clean = [r.predicted for r in held if not r.toxic]
    assert sum(clean) <= 0.01 * len(clean)


def test_awkward_documents(spark, awkward, awkward_rows, nothing):
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(100, 160)] + [(None, 1, 1), (1, 1, None), (101, 0, 0)], "doc_id long, quality int, toxic int")
    kept = drop_toxic(awkward, labels)
    assert kept.columns == awkward.columns and kept.count() <= len(awkward_rows)
    assert score_documents(awkward, labels).filter("score IS NULL OR NOT score BETWEEN 0 AND 1").count() == 0
    none = score_documents(awkward, labels.limit(0))
    assert {r.score for r in none.collect()} == {0.0} and none.count() == len(awkward_rows)
    assert score_documents(nothing, labels).collect() == []
