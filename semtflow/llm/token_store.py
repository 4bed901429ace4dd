"""Token ids in a compact binary form."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from semtflow.llm.common import cut, stored

#: Documents' ids per block of the file format, about.
BLOCK_IDS = 1 << 20
#: Words a Python worker remembers.
MEMORY = 1 << 19


# A control byte holds 2 bits for each of four ids, low bits first: the number of data bytes of
# the id less one. Data bytes are little-endian.
@cache
def _control_table() -> tuple[np.ndarray, np.ndarray]:
    """Of each control byte: the widths of its four ids, and their sum."""
    codes = np.arange(256)
    widths = np.stack([(codes >> 2 * k & 3) + 1 for k in range(4)], 1).astype(np.uint8)
    return widths, widths.sum(1)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit integers."""
    ranks = ranks.astype("<u4")
    extra = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    codes = np.zeros(-(-ranks.size // 4) * 4, np.uint8)
    codes[: ranks.size] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
    wide = int(extra.max(initial=0)) + 1
    used = np.arange(wide)[None, :] <= extra[:, None]
    return control.tobytes(), ranks.view(np.uint8).reshape(-1, 4)[:, :wide][used].tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The integers again: widths by table lookup, then one gather per byte of width."""
    widths = _control_table()[0][np.frombuffer(control, np.uint8)].ravel()[:n].astype(np.int64)
    at = np.cumsum(widths) - widths
    raw = np.frombuffer(data, np.uint8)
    out = raw[at].astype(np.uint32)
    for k in range(1, int(widths.max(initial=1))):
        has = np.flatnonzero(widths > k)
        out[has] |= raw[at[has] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


class _Encoder:
    """The tokenizer, with the ids of words seen before.

    The byte-level pre-tokenizer always cuts before a single blank and around a single line end
    that stand between other characters. So texts are split at blanks, the pieces of a batch are
    numbered by Arrow, each different piece is looked up or encoded once, many in a call, and
    Arrow puts the ids together. A piece may hold line ends between other characters; texts with
    any other white space are encoded whole.
    """

    plain = re.compile(r"\S+(?:\n\S+)*")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.length = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.length[i] = len(token)  # a character of a byte-level token is a byte of text
        self.kind = "<u2" if self.length.size <= 1 << 16 else "<u4"
        self.after_blank: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)

    def _raw(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _learn(self, words: list[str]) -> list[bytes]:
        """Ids of plain pieces behind a blank, remembered."""
        out = []
        for k in range(0, len(words), 4096):
            text = (" " + " ".join(words[k : k + 4096])).encode()
            ids = self._ids(text.decode())
            starts = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
            # a piece's ids end where its letters do
            stop = np.searchsorted(np.cumsum(self.length[ids]), np.append(starts[1:], len(text))) + 1
            raw, ends = ids.tobytes(), (stop * ids.itemsize).tolist()
            out += map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
        if len(self.after_blank) + len(words) > MEMORY:
            self.after_blank.clear()
        self.after_blank.update(zip(words, out, strict=True))
        return out

    def _leading(self, word: str) -> bytes:
        """Ids of a plain piece at the start of a text."""
        got = self.first.get(word)
        if got is None:
            if len(self.first) >= MEMORY >> 3:
                self.first.clear()
            got = self.first[word] = self._raw(word)
        return got

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids of whole texts as little-endian integers of ``kind``."""
        texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
        pieces = pc.split_pattern(texts, " ")
        bounds = pieces.offsets.to_numpy()
        coded = pieces.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        where = coded.indices.to_numpy()
        values = list(map(self.after_blank.get, words))
        odd = np.zeros(len(words), bool)
        if None in values:
            fresh = [k for k, v in enumerate(values) if v is None]
            plain = self.plain.fullmatch
            learnt = [k for k in fresh if plain(words[k])]
            odd[fresh] = True
            odd[learnt] = False
            for k, v in zip(learnt, self._learn([words[k] for k in learnt]), strict=True):
                values[k] = v
        whole = np.logical_or.reduceat(odd[where], bounds[:-1]) if len(texts) and where.size else np.zeros(len(texts), bool)
        joined = pa.array(values, pa.large_binary()).fill_null(b"").take(coded.indices)
        at = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
        data = memoryview(joined.buffers()[2]) if joined.buffers()[2] is not None else memoryview(b"")
        out = []
        for k, (i, j) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if whole[k]:
                out.append(self._raw(texts[k].as_py()))
            else:
                out.append(self._leading(words[where[i]]) + data[at[i + 1] : at[j]])
        return out


@cache
def _encoder(path: str) -> _Encoder:
    return _Encoder(path)


def _tokenized(path: str, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        last = np.array([end], encoder.kind)
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                b = batch.slice(k, 1024)
                raw = [x + last.tobytes() for x in encoder.encode(b.column("text").fill_null(""))]
                n = pa.array([len(x) // last.itemsize for x in raw], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), n, pa.array(raw, pa.binary())], ["doc_id", "th", "n", "ids"])

    return run


def _ids(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<u2" if len(raw) == 2 * n else "<u4")


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << 16, np.int64)
    for b in batches:
        ids = [_ids(raw, n) for raw, n in zip(b.column("ids").to_pylist(), b.column("n").to_pylist(), strict=True)]
        got = np.bincount(np.concatenate(ids)) if ids else total[:0]
        if got.size > total.size:
            total = np.append(total, np.zeros(got.size - total.size, np.int64))
        total[: got.size] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])


def _blocks(ranks: dict[str, np.ndarray]):
    rank_of = ranks["rank_of"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, docs, sizes, ids, n_ids, k = None, [], [], [], 0, 0

        def block() -> pa.RecordBatch:
            control, data = encode_ranks(rank_of[np.concatenate(ids)])
            cols = [pa.array([part], pa.int32()), pa.array([k], pa.int32()), pa.array([docs], pa.list_(pa.int64())), pa.array([sizes], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*cols, pa.array([control], pa.binary()), pa.array([data], pa.binary())], ["part", "block", "docs", "sizes", "control", "data"])

        for b in batches:
            for p, doc, n, raw in zip(*(b.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids")), strict=True):
                part = p
                docs.append(doc)
                sizes.append(n)
                ids.append(_ids(raw, n))
                n_ids += n
                if n_ids >= BLOCK_IDS:
                    yield block()
                    docs, sizes, ids, n_ids, k = [], [], [], 0, k + 1
        if docs:
            yield block()

    return run


def _read(id_of: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                row = {c: b.column(c)[k].as_py() for c in ("docs", "sizes", "control", "data", "before")}
                sizes = np.array(row["sizes"], np.int64)
                ids = id_of[decode_ranks(row["control"], row["data"], int(sizes.sum()))].astype("<u4")
                ends = np.cumsum(sizes)
                crcs = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["docs"], pa.int64()), pa.array(ends - sizes + row["before"], pa.int64()), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    return run


def write_tokens(docs: DataFrame, tokenizer: str, end: int = 2) -> tuple[DataFrame, np.ndarray]:
    """Write all texts' ids to the shared folder; the blocks, as read back, and the ids by rank.

    Blocks stand in ascending order of doc_id (nulls first; then by a hash of the text, so that
    repeated rows stand together): part, block, docs, sizes (ids of each document, the end id
    included), control and data. Texts are tokenized once; ids are ranked by their frequency
    over all documents, ties by id, so that the commonest 256 take one byte. The ranking is a
    table of the tokenizer's vocabulary and so of bounded size.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    raw = stored(rows.mapInArrow(_tokenized(tokenizer, end), "doc_id long, th long, n long, ids binary"), "tokens")
    counts = raw.select("n", "ids").mapInArrow(_tallied, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    id_of = counts.sort_values(["n", "id"], ascending=[False, True])["id"].to_numpy(np.int64)
    rank_of = np.zeros(int(id_of.max(initial=0)) + 1, np.uint32)
    rank_of[id_of] = np.arange(id_of.size)
    ranged = raw.repartitionByRange("doc_id", "th").sortWithinPartitions("doc_id", "th").withColumn("part", F.spark_partition_id())
    kind = "part int, block int, docs array<bigint>, sizes array<bigint>, control binary, data binary"
    return stored(ranged.select("part", "doc_id", "n", "ids").mapInArrow(_blocks({"rank_of": rank_of}), kind), "token-blocks"), id_of


def read_tokens(blocks: DataFrame, id_of: np.ndarray) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of written blocks."""
    ids = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    upto = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sizes = blocks.select("part", "block", ids.alias("n"))
    inside = sizes.withColumn("inside", F.sum("n").over(upto) - F.col("n"))
    total = sizes.groupBy("part").agg(F.sum("n").alias("t"))  # one row per file part
    ahead = total.select("part", (F.sum("t").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("t")).alias("ahead"))
    before = cut(inside.join(ahead, "part").select("part", "block", (F.col("inside") + F.col("ahead")).alias("before")))
    rows = blocks.join(F.broadcast(before), ["part", "block"])  # a row per block of a million ids
    return rows.select("docs", "sizes", "control", "data", "before").mapInArrow(_read(id_of), "doc_id long, start long, n_tokens long, ids_crc32 long")


def tokenize_documents(docs: DataFrame, tokenizer: str, end: int = 2) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every row, read back from the written blocks.

    A null or empty text is the end id alone. Repeated rows each take their place. An empty
    table writes no block. Other columns of ``docs`` are not read.
    """
    return read_tokens(*write_tokens(docs, tokenizer, end))
