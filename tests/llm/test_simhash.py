from collections import Counter

import xxhash

from semtflow.llm.common import table
from semtflow.llm.simhash import ball_links, components, drop_near_copies, hex_of, near_groups
from pyspark.sql import functions as F


def fingerprint(text):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    runs = [words[k : k + 3] for k in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(b" ".join(r), 42) for r in runs]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hs) > len(hs))


def roots(fps):
    fps, root = sorted(set(fps)), {}

    def find(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {x: find(x) for x in fps}


def brute(rows):
    fps = [fingerprint(t) for _, t in rows]
    of, least = roots(fps), {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[of[f]] = min(i, least.get(of[f], i))
    return Counter((i, f"{f:016x}", least.get(of[f])) for (i, _), f in zip(rows, fps, strict=True))


def result(df):
    return Counter(map(tuple, near_groups(df).select("doc_id", hex_of(F.col("fp")), "component_id").collect()))


def test_awkward_documents(awkward, awkward_rows):
    assert result(awkward) == brute([r[:2] for r in awkward_rows])


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    assert result(docs) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_links_at_every_distance(spark):
    """Chains of fingerprints 1, 2 and 3 bits apart are one component each; 4 bits part."""
    base = [0x0123456789ABCDEF, 0x7FFFFFFF00000000, -1, 0]
    step = {1: [1 << 5], 2: [1 << 3 | 1 << 60], 3: [1 << 1 | 1 << 30 | 1 << 63, 1 | 2 | 4, 1 << 40 | 1 << 41 | 1 << 42]}
    vals, signed = set(), lambda x: (x & (1 << 64) - 1) - (1 << 64 if x >> 63 & 1 else 0)
    for b in base:
        for ms in step.values():
            for m in ms:
                vals |= {signed(b), signed(b ^ m), signed(b ^ m ^ (m << 7 & (1 << 64) - 1))}
    vals |= {signed(x ^ 0xF000) for x in base}
    got = {r.u: r.v for r in components(ball_links(spark.createDataFrame([(v,) for v in vals], "fp long"))).collect()}
    want = roots([v & (1 << 64) - 1 for v in vals])
    group = lambda of: {frozenset(v for v in vals if of(v) == r) for r in map(of, vals)}
    assert group(lambda v: got.get(v, v)) == group(lambda v: want[v & (1 << 64) - 1])


def test_one_document_of_each_group_stays(awkward, awkward_rows):
    kept = drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    groups = roots([fingerprint(r[1]) for r in awkward_rows])
    got = [groups[fingerprint(r.text)] for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == set(groups.values())


def test_empty(nothing):
    assert near_groups(nothing).collect() == [] and drop_near_copies(nothing).collect() == []
