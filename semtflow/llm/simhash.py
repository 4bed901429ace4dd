"""Near-duplicate groups by SimHash and ball hashing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, packed, row_key, small

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingle hashes unpacked to bits at a time.
_SLICE = 1 << 18


def shingle_hashes(text: bytes, span: int) -> np.ndarray:
    words = text.translate(_LOWER).split()  # bytes.split() cuts at exactly the ASCII blanks
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= span:
        return np.array([digest(flat, 42)] if words else [], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-span].tolist()]
    return np.array([digest(flat[a:b], 42) for a, b in zip(starts, (ends[span - 1 :] - 1).tolist(), strict=True)], np.uint64)


def _majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for k in range(0, hashes.size, _SLICE):
        part = hashes[k : k + _SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > hashes.size, bitorder="little").view("<i8")[0])


def _fingerprinted(span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_majority(shingle_hashes(t or b"", span)) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(fps, pa.int64())], ["doc_id", "th", "fp"])

    return run


def fingerprints(docs: DataFrame, span: int = 3) -> DataFrame:
    """doc_id, th (a hash of the text) and fp, the 64-bit fingerprint, of every row.

    A-Z are lower-cased; shingles of ``span`` words, repeats included, are hashed by XXH64 with
    seed 42; a bit is 1 if set in over half of them. Fewer words make one shingle; a null or
    blank text has fingerprint zero.
    """
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprinted(span), "doc_id long, th long, fp long")


def _masks() -> tuple[np.ndarray, np.ndarray]:
    """XOR masks: none and single bits (radius 1), and pairs of bits within one half (radius 2)."""
    bit = [1 << k for k in range(64)]
    pairs = [bit[i] | bit[j] for half in (0, 32) for i in range(half, half + 32) for j in range(i + 1, half + 32)]
    return np.array([0, *bit], np.uint64), np.array(pairs, np.uint64)


def _fold(x: np.ndarray, bits: int) -> np.ndarray:
    """A key of ``bits`` bits with fold(x ^ m) = fold(x) ^ fold(m)."""
    out = np.zeros_like(x)
    for s in range(0, 64, bits):
        out ^= x >> np.uint64(s)
    return out & np.uint64((1 << bits) - 1)


def _even(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x) % 2 == 0


def _emitted(bits: int):
    near, far = (np.unique(_fold(m, bits)) for m in _masks())
    both = np.union1d(near, far)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column("fp").to_numpy().astype(np.int64).view(np.uint64)
            for part, folds in ((fps[_even(fps)], both), (fps[~_even(fps)], near)):
                for k in range(0, part.size, 4096):
                    x = part[k : k + 4096]
                    keys = (_fold(x, bits)[:, None] ^ folds[None, :]).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.repeat(x, folds.size).view(np.int64))], ["key", "fp"])

    return run


def _collided(bits: int):
    near, far = _masks()
    fold_near, fold_far = _fold(near, bits), _fold(far, bits)

    def run(key: tuple, group: pa.Table) -> pa.Table:
        fps = group.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        fold = _fold(fps, bits) ^ np.uint64(key[0].as_py())

        def variants(masks, folds, chosen):
            """Variants that fall on this key, with their fingerprints, a few at a time."""
            for g in np.unique(fold[chosen]):
                ms, xs = masks[folds == g], fps[chosen & (fold == g)]
                step = max(1, (1 << 20) // max(1, ms.size))
                for k in range(0, xs.size if ms.size else 0, step):
                    x = xs[k : k + step]
                    yield (x[:, None] ^ ms[None, :]).ravel(), np.repeat(x, ms.size)

        balls = [*variants(near, fold_near, np.ones(fps.size, bool))]
        var, of = (np.concatenate([b[i] for b in balls]) if balls else np.zeros(0, np.uint64) for i in (0, 1))
        order = np.lexsort((of, var))
        var, of = var[order], of[order]
        first = np.r_[True, var[1:] != var[:-1]] if var.size else np.zeros(0, bool)
        centre, least = var[first], of[first]
        links = [np.zeros((0, 2), np.uint64)]
        for v, x in [(var, of), *variants(far, fold_far, _even(fps))] if centre.size else []:
            at = np.minimum(np.searchsorted(centre, v), centre.size - 1)
            met = (centre[at] == v) & (least[at] != x)
            pair = np.stack([x[met], least[at[met]]], 1)
            links.append(pair[np.bitwise_count(pair[:, 0] ^ pair[:, 1]) <= 3])
        out = np.unique(np.sort(np.concatenate(links).view(np.int64), axis=1), axis=0)
        return pa.table({"u": pa.array(out[:, 1]), "v": pa.array(out[:, 0])})

    return run


def ball_links(fps: DataFrame) -> DataFrame:
    """u > v: links that join all distinct ``fp`` at 3 or fewer differing bits into the same components.

    The radius 3 is met in the middle as 1 + 2. Every fingerprint emits the ball of radius 1
    (65 variants). At distance 3 the parities differ and two of the three bits lie in one half
    of the word, so only even fingerprints emit variants at radius 2, and of these only the 992
    that flip two bits of one half. Variants are dealt by a key that folds their bits together;
    as the key of x ^ m is that of x ^ that of m, all variants of a fingerprint with one key
    travel as one row (key, fingerprint) and unfold where they land. Whatever meets on a variant
    that a radius-1 ball holds is within 3 bits, so each member is linked to the smallest
    fingerprint of that ball, no pairs are made, and the distance is checked. The width of the
    key follows the number of fingerprints, so that about half a million variants share a key.
    """
    bits = max(8, (fps.count() * 561 >> 19).bit_length())
    rows = fps.select("fp").mapInArrow(_emitted(bits), "key long, fp long")
    return rows.groupBy("key").applyInArrow(_collided(bits), "u long, v long").distinct()


def components(links: DataFrame) -> DataFrame:
    """u, v: every node that has a link to a smaller one, with the smallest node of its component.

    Alternating large-star and small-star passes; each is two aggregations and joins, and its
    result is cut through the shared folder. A fixed point is seen by count and checksum.
    """
    edges, last = packed(links), None
    while True:
        both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("x")).agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, F.col("u") == F.col("x")).filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy(F.col("u").alias("x")).agg(F.min("v").alias("m"))
        star = large.join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = packed(star.unionAll(low.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last:
            return edges
        last = now


def near_groups(docs: DataFrame, span: int = 3) -> DataFrame:
    """doc_id, th, fp, root (smallest fingerprint of the component) and component_id of every row.

    Documents link at 3 or fewer differing fingerprint bits; component_id is the smallest
    doc_id reachable. Equal fingerprints meet in one aggregation, so copies never pair up; null
    ids do not count for the smallest unless a component has no other. Null and blank texts
    share fingerprint zero and link like any other. Other columns of ``docs`` are not read.
    """
    rows = cut(fingerprints(docs, span))
    fps = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("first")))
    comp = components(ball_links(fps.select("fp")))
    root = packed(fps.join(comp, F.col("fp") == F.col("u"), "left").select("fp", F.coalesce("v", "fp").alias("root"), "first"))
    ids = root.groupBy("root").agg(F.min("first").alias("component_id"))
    label = packed(root.join(ids, "root").select("fp", "root", "component_id"))
    return rows.join(small(label, F.lit(40)), "fp").select("doc_id", "th", "fp", "root", "component_id")


def hex_of(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def without_rows(docs: DataFrame, gone: DataFrame, again: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose (_id, _th) is not in ``gone``; of those in ``again`` one row stays."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, *row_key())
    rows = rows.join(small(gone, F.lit(32)), ["_id", "_th"], "left_anti")
    if not again.isEmpty():
        twice = small(again, F.lit(32))
        rows = rows.join(twice, ["_id", "_th"], "left_anti").unionByName(rows.join(twice, ["_id", "_th"], "left_semi").dropDuplicates(["_id", "_th"]))
    return rows.select("row.*")


def drop_near_copies(docs: DataFrame, span: int = 3) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their group: one row of each component.

    The smallest (doc_id, text hash) of a component stays, null ids last. Rows that agree in id
    and text are one document, of which one row stays.
    """
    groups = packed(near_groups(docs, span))
    key = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col("th").alias("t"))
    best = groups.groupBy("root").agg(F.min(key).alias("best"))
    _id = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("_id")
    gone = groups.join(best, "root").filter(key != F.col("best")).select(_id, F.col("th").alias("_th")).distinct()
    again = groups.groupBy(_id, F.col("th").alias("_th")).count().filter("count > 1").drop("count")
    return without_rows(docs, packed(gone), packed(again))
