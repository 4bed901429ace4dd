"""Removal of repeated three-line windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, exploded, row_key, small


def _lines(text: Column) -> Column:
    return F.when(F.length(text) > 0, F.split(text, "\n")).otherwise(F.array().cast("array<string>"))


def line_windows(docs: DataFrame, span: int = 3) -> DataFrame:
    """_id, _th, pos and the 128-bit hash (h1, h2) of every run of ``span`` lines."""

    def hashed(ls: Column, i: Column) -> Column:
        run = [ls[i + k] for k in range(span)]
        return F.struct(F.xxhash64(*run).alias("h1"), F.xxhash64(F.lit(span), *run).alias("h2"))

    rows = docs.select(*row_key(), _lines(F.col("text")).alias("_ls")).filter(F.size("_ls") >= span)
    at = F.transform(F.sequence(F.lit(0), F.size("_ls") - span), lambda i: hashed(F.col("_ls"), i))
    return exploded(rows, ["_id", "_th"], at, "h", "pos").select("_id", "_th", "pos", "h.h1", "h.h2")


def dedup_lines(docs: DataFrame, span: int = 3) -> DataFrame:
    """doc_id, n_lines, n_removed and kept_text of every row.

    A window of ``span`` consecutive lines that stands more than once in the corpus keeps its
    first occurrence, in the order of (doc_id, text hash, line); every line covered by a later
    occurrence goes. Lines end at \\n and are compared unchanged, blank ones included. Null and
    empty texts have no line and keep the text ''. Texts of fewer lines than ``span`` stay
    whole. Rows that agree in id and text are one document and share a result. A null id sorts
    first. Other columns of ``docs`` are not read.
    """
    wins = line_windows(docs, span)
    place = F.struct("_id", "_th", "pos")
    # repeated rows stand at one place; only places that differ make a repeat
    firsts = wins.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(F.col("first") != F.col("last")).drop("last")
    later = wins.join(firsts, ["h1", "h2"]).filter(place != F.col("first"))
    covered = F.array_distinct(F.flatten(F.transform(F.collect_set("pos"), lambda p: F.sequence(p, p + (span - 1)))))
    gone = cut(later.groupBy("_id", "_th").agg(covered.alias("_gone")))
    rows = docs.select("doc_id", "text", *row_key())
    rows = rows.join(small(gone, F.size("_gone") * 8 + 32), ["_id", "_th"], "left").select("doc_id", _lines(F.col("text")).alias("_ls"), "_gone")
    every = F.when(F.size("_ls") > 0, F.sequence(F.lit(0), F.size("_ls") - 1)).otherwise(F.array().cast("array<int>"))
    kept = F.transform(F.array_except(every, F.col("_gone")), lambda i: F.col("_ls")[i])
    return rows.select(
        "doc_id",
        F.size("_ls").cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.array_join(F.when(F.col("_gone").isNull(), F.col("_ls")).otherwise(kept), "\n").alias("kept_text"),
    )
