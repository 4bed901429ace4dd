import random

import pytest

from semtflow.llm import near_copies as near_copies_module
from semtflow.llm.common import table
from semtflow.llm.near_copies import drop_near_copies, near_copies


def shingles(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    return {b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def pairs_alike(texts):
    """All pairs at 0.8 or more, found through shared shingles."""
    sets, at = [shingles(t) for t in texts], {}
    for k, s in enumerate(sets):
        for x in s or {b""}:
            at.setdefault(x, []).append(k)
    met = {(a, b) for ks in at.values() for i, a in enumerate(ks) for b in ks[:i]}
    return {(a, b) for a, b in met if jaccard(sets[a], sets[b]) >= 0.8}


def check(rows, kept):
    """No alike pair stays, and every text that goes hangs together with one that stays."""
    texts = sorted({t or "" for _, t in rows})
    stay = {r.text or "" for r in kept}
    assert len(kept) == len(stay)
    alike = pairs_alike(texts)
    assert not [(a, b) for a, b in alike if texts[a] in stay and texts[b] in stay]
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in alike:
        root[find(a)] = find(b)
    held = {find(k) for k, t in enumerate(texts) if t in stay}
    assert held == {find(k) for k in range(len(texts))}
    return alike


def test_edited_copies(spark):
    rng = random.Random(4)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(200)]
        rows.append((10 * k, " ".join(words)))
        for j in range(1, 4):  # 1 to 6 words changed, far from each other: Jaccard 0.74 to 0.95
            w = list(words)
            for i in range(1 + (k + j) % 6):
                w[15 + 30 * i] = f"x{rng.random()}"
            rows.append((10 * k + j, " ".join(w)))
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(check(rows, kept)) >= 60 and len(kept) < len(rows)


@pytest.mark.parametrize("scale", ["sf0.001", "sf0.01"])
def test_given_documents(spark, scale):
    docs = table(spark, f"/root/testdata/{scale}", "documents")
    check([(r.doc_id, r.text) for r in docs.collect()], drop_near_copies(docs).collect())


def test_awkward_documents(awkward, awkward_rows, nothing):
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    check([r[:2] for r in awkward_rows], kept.collect())
    least = {}
    for r in awkward_rows:
        least[r[1] or ""] = min(least.get(r[1] or "", (True, 0)), (r[0] is None, r[0] or 0))
    assert all((r.doc_id is None, r.doc_id or 0) == least[r.text or ""] for r in kept.collect())
    assert drop_near_copies(nothing).collect() == [] and near_copies(nothing).collect() == []


def passage_rows(rng, n):
    """Texts of one long passage and a few words of their own, every tenth with an edited copy."""
    words = lambda k: [f"w{rng.randrange(10**6)}" for _ in range(k)]
    passage, rows = words(60), []
    for k in range(n):
        own = words(12 + k % 5)
        rows.append((10 * k, " ".join(passage + own)))
        if k % 10 == 0:
            rows.append((10 * k + 1, " ".join(passage + own[:-1] + words(1))))
    return rows


def test_a_common_passage_makes_few_rounds(spark, monkeypatch):
    rows, rounds, links = passage_rows(random.Random(6), 400), [], near_copies_module.similar_links
    monkeypatch.setattr(near_copies_module, "similar_links", lambda *a: rounds.append(1) or links(*a))
    kept = drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(check(rows, kept)) >= 40 and len(kept) < len(rows)
    assert len(rounds) <= 4


def test_rare_shingles_lose_no_pair(spark):
    rng = random.Random(7)
    texts = [t for _, t in passage_rows(rng, 60)]
    base = [f"v{rng.randrange(40)}" for _ in range(90)]
    texts += [" ".join(base[i : 90 - j]) for i in range(0, 12, 3) for j in range(0, 12, 2)] + ["a", "a b c d e f", "a b c d e f g"]
    frame = spark.createDataFrame(list(enumerate(texts)), "t long, text string")
    met = {}
    for r in near_copies_module.rare_shingles(frame, 5, 0.8).collect():
        assert r.n == len(shingles(texts[r.t]))
        met.setdefault(r.key, []).append((r.n, r.t, r.ix))
    pairs = {(a[1], b[1]) for ks in met.values() for a in ks for b in ks if a[2] and a[:2] < b[:2]}
    alike = pairs_alike(texts)
    assert len(alike) > 50
    assert all((a, b) in pairs or (b, a) in pairs for a, b in alike)
    assert len(pairs) < 0.5 * len(texts) ** 2 / 2  # the passage alone makes none
