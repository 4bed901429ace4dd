import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semtflow.llm.common import table
from semtflow.llm.token_store import _encoder, decode_ranks, encode_ranks, tokenize_documents, write_tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", "a", "a  b", " a", "a ", "\n", "a\n\nb", "x <|endoftext|> y<|endoftext|>", "it's don't 12,5 a b", "é ü\nß", "a\tb c\nd", "漢字 \U0001f600 x", "a\x1cb c\x85d e f"]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)))
def test_round_trip(values):
    control, data = encode_ranks(np.array(values, np.uint32))
    assert len(control) == -(-len(values) // 4)
    assert decode_ranks(control, data, len(values)).tolist() == values


def test_words_alone_as_in_place(awkward_rows):
    plain, encoder = Tokenizer.from_file(PATH), _encoder(PATH)
    texts = ODD + [r[1] for r in awkward_rows if r[1]][:40]
    for text, raw in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(raw, encoder.kind).tolist() == plain.encode(text, add_special_tokens=False).ids, text


def brute(rows):
    plain, out, start = Tokenizer.from_file(PATH), [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_given_documents(spark, sf):
    docs = table(spark, sf, "documents")
    got = tokenize_documents(docs, PATH).orderBy("start").collect()
    assert [tuple(r) for r in got] == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])


def test_awkward_documents(awkward, awkward_rows):
    """Null and repeated ids may stand in any order among themselves; all starts fit."""
    got = tokenize_documents(awkward, PATH).orderBy("start").collect()
    want = brute([r[:2] for r in awkward_rows])
    assert [r.doc_id for r in got] == [w[0] for w in want]
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == Counter((i, n, c) for i, _, n, c in want)
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got]])[:-1].tolist()


def test_frequent_ids_take_one_byte(awkward):
    blocks, id_of = write_tokens(awkward, PATH)
    row = blocks.selectExpr("sum(length(data)) AS bytes", "sum(aggregate(sizes, 0L, (a, x) -> a + x)) AS ids").first()
    assert len(set(id_of.tolist())) == id_of.size and row.bytes < 1.5 * row.ids


def test_empty(nothing):
    assert tokenize_documents(nothing, PATH).collect() == []
