"""The streaming transducer against the tokenizer library, over whole texts and at any chunk size."""

import hashlib
import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from semtflow.llm.bpe_stream import TextMachine, Transducer, WordStream, decode_documents, encode_and_decode, encode_documents, restored, sufficient_lookahead
from semtflow.llm.common import table

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [
    "", " ", "a", "Hello  WORLD it's don'T we'RE <|endoftext|> <|ENDOFTEXT|>x 12 é", "ΣΑΣ ΣΊΣΥΦΟΣ", "İstanbul Iğdır", "éä 각",
    "漢字かなが\U0001f600", "!!'s ''re 'll", "a\x1cb\x1d\x1e.\x1fc", "a\x85b c\xa0d　e​f﻿g", "'r e 're 'rE", "x" * 300, "ab" * 2000, "!?." * 500,
    "Ᲊa Ɤ \U00031350\U00031351 b՘c", "<|startoftext|><|endoftext|>", "a" * 5000 + "'s" + "é" * 5000 + "1" * 50,
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return Transducer(PATH)


def ids_of(library, text):
    return library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("chunk", "long"), [(1 << 16, 1 << 12), (64, 16), (7, 5), (3, 2), (1, 1)])
def test_odd_texts(library, own, chunk, long):
    for text in ODD:
        assert own.encode(text, chunk, long) == ids_of(library, text), text[:60]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aeinrstx'.!? \n19é́Σß漢")) | st.text(), st.integers(1, 30), st.integers(1, 10))
def test_any_text(library, own, text, chunk, long):
    assert own.encode(text, chunk, long) == ids_of(library, text)


def test_runs_longer_than_the_window(library, own):
    rng = random.Random(1)
    docs = [" ".join("the of and internationalization under standing re in ing".split() * 3)] + ["".join(rng.choice("abcdehinorst") for _ in range(3000)) for _ in range(20)]
    for text in docs:
        run = text.replace(" ", "")
        stream = WordStream(own.merges)
        got = []
        for b in run.encode():
            got += stream.feed(bytes([b]))
            assert len(stream.window) <= own.merges.lookahead + 128
        assert got + stream.finish() == ids_of(library, run)


def test_lookahead_of_small_merge_lists():
    """'ab' stays only if no 'bc' comes, which stands if no 'cd' takes its c: a chain of falling ranks."""
    a, b, c, d = 1, 2, 3, 4
    assert sufficient_lookahead({(a, b): (0, 5)}, [a, b]) == 1
    assert sufficient_lookahead({(c, d): (0, 6), (b, c): (1, 7), (a, b): (2, 5)}, [a, b, c, d]) == 3
    assert sufficient_lookahead({(a, b): (0, 5), (b, c): (1, 6), (c, d): (2, 7)}, [a, b, c, d]) == 1
    assert sufficient_lookahead({}, [a]) == 0
    with pytest.raises(ValueError):
        sufficient_lookahead({(a, 9): (0, 5)}, [a])


def test_bytes_to_text_at_any_cut():
    data = "é漢\U0001f600".encode() + b"\xff\xe6\xbc" + b"a"
    for cut in range(len(data)):
        machine = TextMachine()
        assert machine.feed(data[:cut]) + machine.feed(data[cut:]) + machine.finish() == data.decode("utf-8", "replace")


def test_restored_text(own):
    text = "it's a straße 漢字 12 <|endoftext|> !?"
    assert "".join(restored(own.encode(text), own.merges)) == "it 's a straße 漢字 1 2 <|endoftext|> !? "


def brute(library, rows):
    out = []
    for i, t in rows:
        ids = ids_of(library, t or "")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        out.append((i, len(ids), *digest))
    return sorted(out, key=str)


def test_given_documents(spark, sf, library):
    docs = table(spark, sf, "documents")
    got = sorted(map(tuple, encode_and_decode(docs, PATH).collect()), key=str)
    assert got == brute(library, docs.select("doc_id", "text").collect())


def test_awkward_documents(awkward, awkward_rows, library):
    assert sorted(map(tuple, encode_and_decode(awkward, PATH).collect()), key=str) == brute(library, [r[:2] for r in awkward_rows])


def test_ids_and_texts_as_tables(awkward, own):
    ids = encode_documents(awkward.filter("doc_id BETWEEN 4 AND 16"), PATH)
    got = {r.doc_id: r.text for r in decode_documents(ids, PATH).collect()}
    assert got[5] == "one two" and got[13] == "l 1 l 2 l 3 l 4 l 1 l 2 l 3 l 9" and got[4] == "one"


def test_empty(nothing):
    assert encode_and_decode(nothing, PATH).collect() == []
