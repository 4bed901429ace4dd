"""The near-copy stage goes through the SimHash operator and still takes edited copies."""

import random

import corpus_pipeline
from semtflow.llm import near_copies, simhash


def test_stage_takes_what_either_step_finds(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    hymn = " ".join(words(11) * 60)  # an odd number of shingles, so no bit is a tie
    edited = words(120)
    again = edited[:60] + ["changed"] + edited[61:]
    rows = [(1, f"{hymn} {' '.join(words(60))}"), (2, f"{hymn} {' '.join(words(60))}"), (3, " ".join(edited)), (4, " ".join(again)), (5, " ".join(words(80)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    ids = lambda df: {r.doc_id for r in df.collect()}
    assert ids(near_copies.drop_near_copies(docs, span=5)) == {1, 2, 3, 5}  # few shingles shared, one fingerprint
    assert ids(simhash.drop_near_copies(docs)) == {1, 3, 4, 5}  # most shingles shared, fingerprints apart
    assert ids(corpus_pipeline.near_copies_stage(spark, docs, "")) == {1, 3, 5}


def test_batches_are_bounded_in_bytes(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        for given, left in (("64m", corpus_pipeline.BATCH_BYTES), ("67108864b", corpus_pipeline.BATCH_BYTES), ("65536", 65536)):
            spark.conf.set(name, given)
            corpus_pipeline._batched(lambda spark, docs, sf_dir: docs)(spark, None, "")
            assert corpus_pipeline._bytes(spark.conf.get(name)) == left
    finally:
        spark.conf.set(name, before)


def test_small_tables_take_few_partitions(spark):
    """Groups of few rows ran a task for every shuffle partition in each of some 290 jobs."""
    links = spark.createDataFrame([(k + 1, k) for k in range(9)] + [(21, 20)], "u long, v long")
    names = ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ("97", "false"), strict=True):
        spark.conf.set(n, v)
    try:
        found = simhash.components(links)
        parts, rows = found.rdd.getNumPartitions(), {tuple(r) for r in found.collect()}
    finally:
        for n, v in zip(names, before, strict=True):
            spark.conf.set(n, v)
    assert rows == {(k, 0) for k in range(1, 10)} | {(21, 20)}
    assert parts <= 4 * spark.sparkContext.defaultParallelism
