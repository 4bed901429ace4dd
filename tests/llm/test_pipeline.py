"""The stages one by one on the smallest table, each against a plain restatement of its decision."""

from collections import Counter

import corpus_pipeline
from semtflow.llm.common import stored, table


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    columns = docs.columns
    items = [r.text for r in table(spark, sf, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stored(stage(spark, docs, sf), f"test-{name}")
        after, all_before = docs.collect(), Counter(before)
        if name != "token_ids":
            assert docs.columns == columns
        if name == "toxicity":
            assert 0 < len(after) < len(before) and not Counter(after) - all_before
        elif name == "simhash_near_dedup":
            assert len({r.text for r in after}) == len(after) and {r.doc_id for r in after} <= {r.doc_id for r in before}
        elif name == "benchmark_decontamination":
            assert Counter(after) == Counter(r for r in before if not any(t in r.text for t in items))
        elif name == "mixing":
            words = lambda rows: sum(len(r.text.split()) for r in rows)
            assert set(after) <= set(before) and max(Counter(after).values()) <= 2 and abs(words(after) / words(before) - 1.5) < 0.05
        else:
            assert docs.count() == len(before) and docs.agg({"n_tokens": "sum"}).first()[0] == max(r.start + r.n_tokens for r in after)


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
