"""One query per operation of the subpackage, and SQL where it can state the rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.llm import bpe_stream, decontaminate, license_scan, line_dedup, mixing, quality, sharding, simhash, spelling, substring_dedup, token_store, toxicity, whitening
from semtflow.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op1_line_dedup"] = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text <> ''),
w AS (SELECT doc_id, i, ls[i] || chr(10) || ls[i + 1] || chr(10) || ls[i + 2] AS run
      FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS i FROM l)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY run ORDER BY doc_id, i) AS nth FROM w),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest([0, 1, 2]) AS k FROM r WHERE nth > 1)),
line AS (SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM l)),
s AS (SELECT line.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
             coalesce(string_agg(line.line, chr(10) ORDER BY line.i) FILTER (WHERE gone.i IS NULL), '') AS kept
      FROM line LEFT JOIN gone USING (doc_id, i) GROUP BY line.doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN s USING (doc_id)
"""


@_query
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), 40)


@_query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix_documents(table(spark, sf_dir, "documents"))
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "row.source")


ORACLES["op5_mixing"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('42:' || doc_id) AS draw FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1)::INT % 3 + 1]::DOUBLE AS w
      FROM d GROUP BY source),
goal AS (SELECT 1.5 * sum(source_size)::DOUBLE AS g FROM s),
fill(step, full_up) AS (
  SELECT 0, []::VARCHAR[]
  UNION ALL
  SELECT step + 1, (SELECT coalesce(list(source), []) FROM s, (
      SELECT (g - coalesce((SELECT sum(source_size * 2.0::DOUBLE) FROM s WHERE list_contains(f.full_up, source)), 0))
             / (SELECT sum(w) FROM s WHERE NOT list_contains(f.full_up, source)) AS level FROM goal) l
      WHERE list_contains(f.full_up, source) OR w * level > source_size * 2.0::DOUBLE)
  FROM fill f WHERE step <= (SELECT count(*) FROM s)),
final AS (SELECT full_up FROM fill ORDER BY step DESC LIMIT 1),
level AS (SELECT (g - coalesce((SELECT sum(source_size * 2.0::DOUBLE) FROM s, final WHERE list_contains(full_up, source)), 0))
                 / (SELECT sum(w) FROM s, final WHERE NOT list_contains(full_up, source)) AS level FROM goal),
t AS (SELECT source, source_size, CASE WHEN list_contains(full_up, source) THEN source_size * 2.0::DOUBLE ELSE w * level END AS target FROM s, final, level),
p AS (SELECT *, least(floor(target / source_size), 2)::BIGINT AS whole FROM t),
o AS (SELECT d.doc_id, d.size, d.source, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS part,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS UNBOUNDED PRECEDING) - d.size AS ahead
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, size * (whole + (part > 0 AND ahead + size / 2 <= part)::BIGINT) AS taken,
       whole + (part > 0 AND ahead + size / 2 <= part)::BIGINT AS repeats, source FROM o
"""


@_query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


@_query
def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(table(spark, sf_dir, "documents"), 35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS run FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)),
many AS (SELECT doc_id, i FROM s WHERE run IN (SELECT run FROM s GROUP BY run HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM (SELECT doc_id, i, unnest(range(35)) AS k FROM many)),
word AS (SELECT doc_id, i, ws[i] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w)),
t AS (SELECT word.doc_id, count(gone.i) AS n_removed, string_agg(word, ' ' ORDER BY word.i) FILTER (WHERE gone.i IS NULL) AS kept
      FROM word LEFT JOIN gone USING (doc_id, i) GROUP BY word.doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN t USING (doc_id)
"""


#: Ends every document's ids.
END_ID = 2


@_query
def op8_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.tokenize_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), END_ID)


@_query
def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("row.doc_id", "held_out", "score", "predicted")


@_query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.leaks(docs, benchmark).select(F.col("_id").alias("doc_id"), "item_id", "n_windows", "n_matched", "containment")


@_query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.rate_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = license_scan.scan_licenses(table(spark, sf_dir, "documents"), license_scan.default_templates(spark))
    return out.select(F.col("_id").alias("doc_id"), "license", "containment", "start", "n_windows")


@_query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.encode_and_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@_query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(table(spark, sf_dir, "documents"))


@_query
def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))
