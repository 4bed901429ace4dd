from collections import Counter, defaultdict
import struct
import zlib

import pytest
import xxhash

from semtflow.llm.common import table
from semtflow.llm.sharding import jump_shard, shard_documents


def spark_hash(key, b):
    seed = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return xxhash.xxh64_intdigest(struct.pack("<q", b), seed)


def brute(key, shards):
    b, j = -1, 0
    while j < shards:
        b = j
        j = int((b + 1) / (((spark_hash(key, b) >> 33) + 1) / float(1 << 31)))
    return b


@pytest.mark.parametrize("shards", [1, 2, 40, 300])
def test_jumps(spark, shards):
    df = spark.range(-300, 300)
    got = {r[0]: r[1] for r in df.select("id", jump_shard(df["id"], shards)).collect()}
    assert got == {k: brute(k, shards) for k in got}


def check(rows, texts, shards):
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
        assert r.law == "key" and r.shard == brute(r.doc_id, shards) and r.grown_shard in (r.shard, shards) and r.grown_shard == brute(r.doc_id, shards + 1)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in texts)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == want


def test_awkward_documents(awkward, awkward_rows):
    check(shard_documents(awkward, 7).collect(), [r[:2] for r in awkward_rows], 7)


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    check(shard_documents(docs, 40).collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)


def test_empty(nothing):
    assert shard_documents(nothing).collect() == []
