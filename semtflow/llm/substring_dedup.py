"""Removal of passages that repeat word for word, found by fixed-block anchors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, small
from semtflow.llm.wordhash import flat, mix, pieces, window_hashes, word_bounds, word_hashes

#: Words that a task looks at together, and bytes of text per shard of hashes.
CHUNK_WORDS = 3 << 18
SHARD_BYTES = 12 << 20
_FOUND = "bucket int, spans binary"
_SPANS = "_id long, _th int, a array<int>, b array<int>"
_PROBES = "shard int, ids binary, ths binary, counts binary, gaps binary, low binary, high binary, flags binary, known binary, spans binary"


def merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of closed integer intervals, touching ones joined."""
    if not a.size:
        return a, b
    order = np.argsort(a, kind="stable")
    a, b = a[order], np.maximum.accumulate(b[order])
    new = np.r_[True, a[1:] > b[:-1] + 1]
    return a[new], b[np.r_[new[1:], True]]


def _planes(x: np.ndarray) -> bytes:
    """Bytes of equal weight side by side, which the shuffle's codec shrinks well."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes() if x.size else b""


def _unplaned(raw: bytes, kind: str) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(wide, -1).T).view(kind).ravel() if raw else np.zeros(0, kind)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and the start of each group in it."""
    order = np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys)
    new = np.zeros(order.size, bool)
    new[:1] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


def _located(ids, ths, doc, a, b) -> bytes:
    """Intervals per text, merged, as int64 rows (id, th, a, b)."""
    shift = int(b.max()) + 2 if b.size else 1
    lo, hi = merged(a + doc * shift, b + doc * shift)
    which = lo // shift
    return np.stack([ids[which], ths[which], lo - which * shift, hi - which * shift], 1).astype("<i8").tobytes()


def _probe_rows(chunk: dict, span: int, step: int, wide: bool, back: int, ahead: int, shards: int) -> Iterator[dict]:
    """Rows for the shards: each hash of the chunk once.

    A hash that stands more than once in the chunk is known to repeat: its intervals are settled
    here, and others are told of it once. So a passage sends one hash per chunk, however hot.
    """
    doc, pos, h1, h2, size = (np.concatenate(chunk[k]) for k in ("doc", "pos", "h1", "h2", "size"))
    ids, ths = np.concatenate(chunk["ids"]), np.concatenate(chunk["ths"])
    order, start = _groups(h2, h1) if wide else _groups(h1)
    count = np.diff(np.r_[start, order.size])
    aligned = np.maximum.reduceat((pos % step == 0)[order].astype(np.uint8), start) if start.size else np.zeros(0, np.uint8)
    keep = order[start]
    many = count > 1
    again = order[np.repeat(many, count)]
    spans = b""
    if again.size:
        lo = np.maximum(pos[again] - back, 0)
        spans = _located(ids, ths, doc[again], lo, np.minimum(pos[again] + ahead, size[doc[again]] - 1))
    shard = (h1[keep] >> np.uint64(40)) % np.uint64(shards)
    sort = np.lexsort((keep, shard))  # items stand in the order of (text, position)
    keep, shard, aligned, many = keep[sort], shard[sort], aligned[sort], many[sort]
    cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1], True]) if keep.size else np.zeros(1, int)
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        k, single = keep[i:j], ~many[i:j]
        s = k[single]
        docs, n = np.unique(doc[s], return_counts=True)
        gap = pos[s].copy()
        gap[1:] -= np.where(doc[s][1:] == doc[s][:-1], pos[s][:-1], 0)
        yield {
            "shard": int(shard[i]), "ids": _planes(ids[docs].astype("<i8")), "ths": _planes(ths[docs].astype("<i4")), "counts": _planes(n.astype("<u4")),
            "gaps": _planes(gap.astype("<u4")), "low": h1[k].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes(), "high": h2[k].astype("<u8").tobytes() if wide else b"",
            "flags": np.packbits(aligned[i:j]).tobytes(), "known": np.packbits(many[i:j]).tobytes(), "spans": spans if not i else b"",
        }


def _windows(span: int, step: int, wide: bool, back: int, ahead: int, shards: int):
    names = [f.split()[0] for f in _PROBES.split(", ")]
    kinds = [pa.int32(), *[pa.binary()] * (len(names) - 1)]

    def packed(chunk: dict) -> pa.RecordBatch:
        rows = list(_probe_rows(chunk, span, step, wide, back, ahead, shards))
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = lambda: {k: [] for k in ("doc", "pos", "h1", "h2", "size", "ids", "ths")}
        chunk, n_docs, n_words = empty(), 0, 0
        for batch in batches:
            data, off = flat(batch.column("text"))
            ids, ths = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_id", "_th"))
            near = [batch.column(c) for c in ("a", "b")] if "a" in batch.schema.names else None
            for i, j in pieces(off):
                start, end, first = word_bounds(data[off[i] : off[j]], off[i : j + 1] - off[i])
                words = word_hashes(data[off[i] : off[j]], start, end)
                size = np.diff(first)
                if near is None:
                    n_at = np.maximum(size - span + 1, 0)
                    doc = np.repeat(np.arange(j - i), n_at)
                    pos = np.arange(doc.size) - np.repeat(np.cumsum(n_at) - n_at, n_at)
                else:
                    doc, pos = _candidates([x.slice(i, j - i) for x in near], size - span)
                h1, h2 = window_hashes(words, first[doc] + pos, span, wide)
                for k, v in {"doc": doc + n_docs, "pos": pos, "h1": h1, "h2": h2 if wide else h1[:0], "size": size, "ids": ids[i:j], "ths": ths[i:j]}.items():
                    chunk[k].append(v)
                n_docs, n_words = n_docs + j - i, n_words + doc.size
                if n_words >= CHUNK_WORDS:
                    yield packed(chunk)
                    chunk, n_docs, n_words = empty(), 0, 0
        if n_words:
            yield packed(chunk)

    return run


def _candidates(near: list[pa.Array], last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text and start of every window inside the candidate intervals."""
    docs, starts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for d in range(last.size):
        a, b = (np.array(x[d].as_py(), np.int64) for x in near)
        a, b = merged(a, np.minimum(b, last[d]))
        n = np.maximum(b - a + 1, 0)
        at = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        docs.append(np.full(at.size, d))
        starts.append(at)
    return np.concatenate(docs), np.concatenate(starts)


def _met(wide: bool, back: int, ahead: int, shards: int):
    """Intervals of all occurrences, in one shard, of hashes that stand in two places, one of them
    aligned; packed by buckets of texts."""

    def run(group: pa.Table) -> pa.Table:
        keys, ids, ths, doc, pos, known, aligned, spans = [], [], [], [], [], [], [], []
        highs, n_docs = [], 0
        for r in group.to_pylist():
            low = np.frombuffer(r["low"], np.uint8).reshape(-1, 5)
            key = np.zeros((low.shape[0], 8), np.uint8)
            key[:, :5] = low
            keys.append(key.view("<u8").ravel())
            highs.append(np.frombuffer(r["high"], "<u8"))
            many = np.unpackbits(np.frombuffer(r["known"], np.uint8), count=low.shape[0]).astype(bool)
            n, gap = _unplaned(r["counts"], "<u4").astype(np.int64), _unplaned(r["gaps"], "<u4").astype(np.int64)
            at = np.cumsum(gap)
            head = np.cumsum(n) - n
            at -= np.repeat((at - gap)[head], n)
            d, p = np.full(low.shape[0], -1, np.int64), np.zeros(low.shape[0], np.int64)
            d[~many], p[~many] = np.repeat(np.arange(n.size), n) + n_docs, at
            n_docs += n.size
            for to, v in ((ids, _unplaned(r["ids"], "<i8")), (ths, _unplaned(r["ths"], "<i4")), (doc, d), (pos, p), (known, many)):
                to.append(v)
            aligned.append(np.unpackbits(np.frombuffer(r["flags"], np.uint8), count=low.shape[0]))
            spans.append(np.frombuffer(r["spans"], "<i8").reshape(-1, 4))
        key, high, ids, ths, doc, pos, known, aligned = (np.concatenate(x) for x in (keys, highs, ids, ths, doc, pos, known, aligned))
        order, start = _groups(high, key) if wide else _groups(key)
        count = np.diff(np.r_[start, order.size])
        hit = (count > 1) & (np.maximum.reduceat(aligned[order], start) > 0)
        at = order[np.repeat(hit, count)]
        at = at[~known[at]]
        found = np.frombuffer(_located(ids, ths, doc[at], np.maximum(pos[at] - back, 0), pos[at] + ahead), "<i8").reshape(-1, 4) if at.size else np.zeros((0, 4), np.int64)
        rows = np.concatenate([found, *spans])
        bucket = (mix(rows[:, 0].view(np.uint64)) % np.uint64(shards)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True]) if bucket.size else np.zeros(1, int)
        packed = [rows[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
        return pa.table({"bucket": pa.array(bucket[cuts[:-1]], pa.int32()), "spans": pa.array(packed, pa.binary())})

    return run


def _by_text(group: pa.Table) -> pa.Table:
    """The intervals of each text, merged."""
    rows = np.concatenate([np.frombuffer(r, "<i8").reshape(-1, 4) for r in group.column("spans").to_pylist()])
    key = np.ascontiguousarray(rows[:, :2]).view([("id", "<i8"), ("th", "<i8")]).ravel()
    texts, doc = np.unique(key, return_inverse=True)
    shift = int(rows[:, 3].max(initial=0)) + 2
    lo, hi = merged(rows[:, 2] + doc * shift, rows[:, 3] + doc * shift)
    which = lo // shift
    off = pa.array(np.searchsorted(which, np.arange(texts.size + 1)), pa.int32())
    a, b = (pa.ListArray.from_arrays(off, pa.array(x - which * shift, pa.int64()).cast(pa.int32())) for x in (lo, hi))
    return pa.table({"_id": pa.array(texts["id"]), "_th": pa.array(texts["th"]).cast(pa.int32()), "a": a, "b": b})


def _intervals(rows: DataFrame, shards: int, span: int, step: int, wide: bool, back: int, ahead: int) -> DataFrame:
    """Per text the intervals around windows that stand in two places, at least one a multiple of ``step``."""
    probes = rows.mapInArrow(_windows(span, step, wide, back, ahead, shards), _PROBES)
    found = probes.groupBy("shard").applyInArrow(_met(wide, back, ahead, shards), _FOUND)
    return cut(found.groupBy("bucket").applyInArrow(_by_text, _SPANS))


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, kept = [], [], []
        for text, a, b in zip(*(batch.column(c).to_pylist() for c in ("text", "a", "b")), strict=True):
            words = (text or b"").split()
            out, at, n = [], 0, 0
            if a:
                for lo, hi in zip(*(x.tolist() for x in merged(np.array(a), np.array(b))), strict=True):
                    out += words[at:lo]
                    at, n = hi + 1, n + hi + 1 - lo
            total.append(len(words))
            gone.append(n)
            kept.append(b" ".join(out + words[at:] if at else words))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])


def dedup_substrings(docs: DataFrame, span: int = 35) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by a space) of every row.

    A word goes if a window of ``span`` words covers it whose words also start anywhere else,
    in the same text or another; windows are those of the input. Null and blank texts have no
    word, texts under ``span`` words no window. Repeated rows repeat each other's words. Other
    columns of ``docs`` are not read.

    Anchors: each text is indexed by its non-overlapping blocks of (span + 1) // 2 words, so
    that every window holds a whole block, and all texts probe the index with every rolling
    block-sized window. A hit makes the windows around it candidates; these are extended to
    the full ``span`` and kept if a 104-bit hash of their words stands in two places. Hashes
    travel packed by shard, five bytes and a position each; a shard holds a bounded share.
    """
    block = (span + 1) // 2
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("_id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int").alias("_th"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("binary").alias("text"),
    )
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    near = _intervals(rows.drop("doc_id"), shards, block, block, False, span - block, 0)
    width = F.size("a") * 8 + 64
    tried = rows.drop("doc_id").join(small(near, width), ["_id", "_th"])
    gone = _intervals(tried, shards, span, 1, True, 0, span - 1)
    out = rows.join(small(gone, width), ["_id", "_th"], "left").select("doc_id", "text", "a", "b")
    out = out.mapInArrow(_kept, "doc_id long, n_words long, n_removed long, kept binary")
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept_text"))
