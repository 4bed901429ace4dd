import hashlib
from collections import defaultdict

import pytest

from semtflow.llm.common import table
from semtflow.llm.mixing import mix_documents, repeat_documents


def fill(sizes, weights, total, most):
    full = {s for s in sizes if weights[s] <= 0}
    while True:
        w = sum(weights[s] for s in sizes if s not in full)
        level = (total - sum(most * sizes[s] for s in full if weights[s] > 0)) / w if w else 0
        more = {s for s in sizes if s not in full and weights[s] * level > most * sizes[s]}
        if not more:
            return {s: (most * sizes[s] if s in full and weights[s] > 0 else weights[s] * level if s not in full else 0) for s in sizes}
        full |= more


def brute(rows, share=1.5, most=2):
    n = lambda t: len((t or "").encode().split())
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += n(t)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    target = fill(sizes, {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}, share * sum(sizes.values()), most)
    return sizes, target


def check(got, rows):
    sizes, target = brute(rows)
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        s = r.row.source
        assert r.source_size == sizes[s] and r.target == pytest.approx(target[s]) and 0 <= r.repeats <= 2
        taken[s] += r.size * r.repeats
        largest[s] = max(largest[s], r.size)
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(largest[s] * 3, 1), s


def test_awkward_documents(awkward, awkward_rows):
    got = mix_documents(awkward).collect()
    assert len(got) == len(awkward_rows)
    check(got, [(r[0], r[1], r[3]) for r in awkward_rows])
    again = mix_documents(awkward.repartition(3)).collect()
    key = lambda r: (r.row.row, r.repeats)
    assert sorted(map(key, got)) == sorted(map(key, again))


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    got = mix_documents(docs).collect()
    check(got, rows)
    # the draw decides: within a source, more repeats come first
    by = defaultdict(list)
    for r in got:
        by[r.row.source].append((hashlib.md5(f"42:{r.row.doc_id}".encode()).hexdigest(), r.repeats))
    assert all([n for _, n in sorted(x)] == sorted((n for _, n in x), reverse=True) for x in by.values())
    assert repeat_documents(docs).count() == sum(r.repeats for r in got)


def test_empty(nothing):
    assert mix_documents(nothing).collect() == [] and repeat_documents(nothing).collect() == []
