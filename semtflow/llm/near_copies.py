"""Near copies by shingle similarity: MinHash bands find pairs, the exact Jaccard share decides."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, packed, row_key, small
from semtflow.llm.simhash import components, shingle_hashes, without_rows

#: Words of a shingle, least Jaccard share, bands and MinHashes of a band.
SPAN, SHARE, BANDS, ROWS = 5, 0.8, 24, 4
#: Least equal bytes of two sketches whose sets are compared; at 0.8 fewer agree with a probability of 7e-12.
AGREE = 45
#: Texts of a band's key that still meet each other in pairs.
FEW = 16
#: Shingles whose MinHashes are taken at a time.
_SLICE = 1 << 12
#: Bytes of texts whose shingle sets a task holds at a time.
_BYTES = 1 << 20
_ODD = np.random.default_rng(7).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _sketch(shingles: np.ndarray) -> tuple[np.ndarray, bytes]:
    """One key per band, and a byte of every MinHash; a text without shingles has keys of its own."""
    low = np.full(_ODD.size, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, shingles.size, _SLICE):
        low = np.minimum(low, (shingles[k : k + _SLICE, None] * _ODD).min(axis=0))
    key = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for part in low.reshape(BANDS, ROWS).T:
        key = (key ^ part) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key, (low >> np.uint64(20)).astype(np.uint8).tobytes()


def _slices(b: pa.RecordBatch, col: str) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about _BYTES bytes."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(col)), 0).to_numpy())
    i = 0
    while i < b.num_rows:
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + _BYTES, "right")))
        yield i, j
        i = j


def _sketched(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_sketch(shingle_hashes(t.as_py() or b"", span)) for t in b.column("text")]  # one text at a time
            keys = pa.array([k.view(np.int64) for k, _ in made], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column("t"), keys, pa.array([x for _, x in made], pa.binary())], ["t", "keys", "sketch"])

    return run


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, BANDS * ROWS) for c in ("a", "b"))
        yield b.select(["t", "c"]).filter(pa.array((x == y).sum(axis=1) >= AGREE))


def _sets(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in _slices(b, "text"):
                out = [np.unique(shingle_hashes(t.as_py() or b"", span)).tobytes() for t in b.column("text")[i:j]]
                yield pa.RecordBatch.from_arrays([b.column("t")[i:j], pa.array(out, pa.binary())], ["t", "s"])

    return run


def _checked(share: float):
    def alike(a: bytes, b: bytes) -> bool:
        x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
        if min(x.size, y.size) < share * max(x.size, y.size):
            return False
        both = np.intersect1d(x, y, assume_unique=True).size
        return both >= share * (x.size + y.size - both)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [alike(x.as_py(), y.as_py()) for x, y in zip(b.column("s"), b.column("cs"), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("t"), b.column("c")], ["t", "c"]).filter(pa.array(ok, pa.bool_()))

    return run


def similar_links(texts: DataFrame, sketches: DataFrame, pairs: DataFrame, span: int, share: float) -> DataFrame:
    """The pairs (t, c) whose shingle sets have a Jaccard share of at least ``share``.

    Sets are made and sent only for pairs whose sketches leave that open.
    """
    of = lambda t, s: sketches.select(F.col("t").alias(t), F.col("sketch").alias(s))
    pairs = pairs.distinct().join(of("t", "a"), "t").join(of("c", "b"), "c")
    pairs = packed(pairs.select("t", "c", "a", "b").mapInArrow(_possible, "t long, c long"))
    nodes = packed(pairs.select("t").unionAll(pairs.select(F.col("c").alias("t"))).distinct())
    some = texts.join(small(nodes, F.lit(8)), "t", "left_semi").dropDuplicates(["t"])
    sets = cut(some.select("t", F.col("text").cast("binary").alias("text")).mapInArrow(_sets(span), "t long, s binary"))
    centres = packed(pairs.select("c").distinct()).join(sets, F.col("c") == F.col("t")).select("c", F.col("s").alias("cs"))
    both = pairs.join(sets, "t").join(small(cut(centres), F.octet_length("cs") + 16), "c")
    return packed(both.select("t", "c", "s", "cs").mapInArrow(_checked(share), "t long, c long"))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for t, s in zip(b.column("t"), b.column("s"), strict=True):
            x = np.frombuffer(s.as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.size, t.as_py())), pa.array(np.full(x.size, x.size)), pa.array(x)], ["t", "n", "x"])


def rare_shingles(texts: DataFrame, span: int, share: float) -> DataFrame:
    """t, key, n, ix: the rarest shingles of each text by which it meets every text that is alike.

    Shingles are ordered by the number of texts that hold them. Of two alike texts with n and m
    shingles, n <= m, the larger holds one of the n - ceil(2 share / (1 + share) n) + 1 rarest of the
    smaller (``ix``) within the m - ceil(share m) + 1 rarest of its own (prefix filtering), so what
    many texts have in common brings none together that differ elsewhere.
    """
    sets = cut(texts.select("t", F.col("text").cast("binary").alias("text")).mapInArrow(_sets(span), "t long, s binary"))
    each = sets.mapInArrow(_listed, "t long, n long, x long")
    counts = packed(each.groupBy("x").agg(F.count(F.lit(1)).alias("d")).filter("d > 1"))
    most = max(1000, (counts.agg(F.sum("d")).first()[0] or 0) >> 19)  # so the frequent are 524,288 at most
    hot = F.broadcast(packed(counts.filter(F.col("d") > most)))
    met = each.join(hot, "x").unionByName(each.join(hot, "x", "left_anti").join(counts.filter(F.col("d") <= most), "x"))
    least = lambda part: F.col("n") - F.ceil(part * F.col("n") - 1e-9) + 1 - (F.col("n") - F.size("xs"))  # noqa: E731  what stands in no other text comes first
    rows = met.groupBy("t").agg(F.first("n").alias("n"), F.sort_array(F.collect_list(F.struct("d", "x"))).alias("xs"))
    rows = rows.select("t", "n", least(2 * share / (1 + share)).alias("i"), F.slice("xs", F.lit(1), F.greatest(least(share), F.lit(0)).cast("int")).alias("xs"))
    return rows.select("t", "n", "i", F.posexplode("xs")).select("t", F.col("col.x").alias("key"), "n", (F.col("pos") < F.col("i")).alias("ix"))


def near_copies(docs: DataFrame, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """_t, _root: the text hash of every text that goes, and of the text that stands for it.

    Texts are alike if the sets of their shingles (runs of ``span`` words, A-Z lower-cased, fewer
    words make one) share ``share`` of their union. Pairs that agree in all ROWS MinHashes of one
    of BANDS bands are checked exactly; a pair at 0.8 meets in no band with a probability of
    3e-6. Texts are ordered by their smallest id, null ids last. All texts of a band's key meet the
    smallest of them; what was not alike goes on without it. What then shares a key with at most
    FEW texts meets these in pairs; the others meet by their rare shingles, which loses none,
    again each with the smallest of a shingle until pairs are few. So neither copies nor a common
    passage make pairs. Texts that stay and met are not alike, and each that goes is linked to one
    that stays by checked pairs.
    """
    th = F.xxhash64(F.coalesce("text", F.lit("")))
    texts = docs.select(th.alias("t"), F.coalesce("text", F.lit("")).alias("text"), F.col("doc_id").cast("long").alias("doc_id"))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("t").alias("t"))
    first = packed(texts.groupBy("t").agg(F.min(order).alias("o")))
    one = texts.select("t", "text").dropDuplicates(["t"]).select("t", F.col("text").cast("binary").alias("text"))
    made = cut(one.mapInArrow(_sketched(span), "t long, keys array<long>, sketch binary"))
    sketches, bands = made.select("t", "sketch"), made.select("t", F.explode("keys").alias("key"))
    shared = packed(bands.groupBy("key").count().filter("count > 1").select("key"))
    # a row meets what comes after it if it may be met (ix); the order is (n, o)
    rows = bands.join(small(shared, F.lit(8)), "key", "left_semi").join(first, "t")
    rows = packed(rows.select("t", "key", F.struct(F.lit(0).cast("long").alias("n"), "o").alias("p"), F.lit(True).alias("ix")))
    few, links, rare = max(1 << 16, 4 * first.count()), texts.select("t", F.col("t").alias("c")).limit(0), False

    def linked(pairs: DataFrame) -> DataFrame:
        return similar_links(texts, sketches, pairs.select("t", "c"), span, share)

    def met(some: DataFrame) -> DataFrame:
        """Every row with all before it that may be met."""
        before = some.filter("ix").select("key", F.col("p").alias("q"))
        return some.join(before, "key").filter("q < p").select("t", F.col("q.o.t").alias("c"))

    while True:
        n_met, least = F.count_if("ix").alias("i"), F.min(F.when(F.col("ix"), F.col("p"))).alias("q")
        sizes = packed(rows.groupBy("key").agg(least, n_met, F.count(F.lit(1)).alias("m")).filter("i > 0 and m > 1"))
        n_pairs = sizes.agg(F.sum(F.col("i") * F.col("m"))).first()[0]
        if not n_pairs:
            break
        rows = rows.join(small(sizes, F.lit(64)), "key").filter("p >= q")
        if n_pairs <= few:
            links = packed(links.unionAll(linked(met(packed(rows.select("t", "key", "p", "ix"))))))
            break
        rows = packed(rows)
        found = linked(rows.filter("q < p").select("t", F.col("q.o.t").alias("c")))
        links = packed(links.unionAll(found))
        gone = packed(found.select("t").distinct())
        rows = packed(rows.filter("q < p").select("t", "key", "p", "ix").join(small(gone, F.lit(8)), "t", "left_anti"))
        if not rare:
            sizes = packed(rows.groupBy("key").count().filter("count > 1"))
            lone = sizes.filter(F.col("count") <= FEW).select("key")
            found = linked(met(rows.join(lone, "key", "left_semi")))
            links = packed(links.unionAll(found))
            crowd = rows.join(sizes.filter(F.col("count") > FEW).select("key"), "key", "left_semi").select("t").distinct().join(found.select("t").distinct(), "t", "left_anti")
            crowd = packed(crowd)
            rare = True
            rows = rare_shingles(one.join(small(crowd, F.lit(8)), "t", "left_semi"), span, share).join(first, "t")
            rows = packed(rows.select("t", "key", F.struct("n", "o").alias("p"), "ix"))
    comp = components(links.select(F.greatest("t", "c").alias("u"), F.least("t", "c").alias("v")).distinct())
    # the smallest hash of a component has no link of its own
    comp = packed(comp.unionAll(comp.select(F.col("v").alias("u"), "v").distinct()).join(first, F.col("u") == F.col("t")).select("t", "o", "v"))
    best = comp.groupBy("v").agg(F.min("o").alias("b"))
    return comp.join(small(packed(best), F.lit(32)), "v").select(F.col("t").alias("_t"), F.col("b.t").alias("_root")).filter("_t <> _root")


def drop_near_copies(docs: DataFrame, span: int = SPAN, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, whose text stands for its group, one of each text.

    Of rows with one text the smallest id stays, null ids last.
    """
    gone = packed(near_copies(docs, span, share).select(F.col("_t").alias("_th")))
    order = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("d"))
    ids = packed(docs.select(*row_key(), order.alias("o")).groupBy("_id", "_th", "o").count())
    best = packed(ids.groupBy("_th").agg(F.min("o").alias("b"), F.count(F.lit(1)).alias("m")).filter("m > 1").select("_th", "b"))
    later = ids.join(small(best, F.lit(32)), "_th").filter("o <> b")
    others = ids.join(small(gone, F.lit(8)), "_th", "left_semi")
    return without_rows(docs, packed(later.select("_id", "_th").unionAll(others.select("_id", "_th")).distinct()), packed(ids.filter("count > 1").select("_id", "_th")))
