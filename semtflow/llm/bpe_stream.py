"""Byte-pair encoding and decoding as a streaming transducer with bounded lookahead."""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import unicodedata
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a text taken at a time; characters of a run that is fed on before its end is seen.
CHUNK, LONG = 1 << 16, 1 << 12
#: Words a Python worker remembers.
MEMORY = 1 << 19
#: Symbols of a window beyond the lookahead.
STEP = 128

# fixed values: the file format's word pattern, and the code points of its 256 byte letters
_CONTRACTIONS = "'s|'t|'re|'ve|'m|'ll|'d"
_WORD = regex.compile(_CONTRACTIONS + r"|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_ASCII_WORD = re.compile(_CONTRACTIONS + r"|[a-z]+|[0-9]|[^ \t\n\x0b\x0c\ra-z0-9]+")
#: What stands outside a few blocks without a free place.
_RARE = re.compile("[^\x00-\u0377\u0400-\u052f\u3041-\u3096\u30a0-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
_LETTERS = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _doubtful(s: str) -> bool:
    """True if s holds characters that Python's Unicode tables do not know; those of the libraries may differ on them."""
    return any(unicodedata.category(c) == "Cn" for c in set(_RARE.findall(s)))


@cache
def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary."""
    rest = iter(range(256, 512))
    return [chr(b) if b in set(_LETTERS) else chr(next(rest)) for b in range(256)]


class Merges:
    """Vocabulary, merge ranks and the lookahead that suffices for them."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.vocabulary: dict[str, int] = dict(model["vocab"])
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        v = self.vocabulary
        self.rank = {(v[a], v[b]): (i, v[a + b]) for i, (a, b) in enumerate(pairs)}
        self.symbol = [v[c] for c in byte_letters()]
        self.last_symbol = [v[c + self.end] for c in byte_letters()]
        self.token = {i: t for t, i in [*v.items(), *self.special.items()]}
        self.size = {i: len(t.removesuffix(self.end) or t) for i, t in self.token.items()}
        self.lookahead = sufficient_lookahead(self.rank, {*self.symbol, *self.last_symbol})

    def merged(self, symbols: list[int]) -> list[int]:
        """The tokens of a window: the lowest rank merges first, from left to right."""
        ids, rank = symbols, self.rank
        while len(ids) > 1:
            best = min((r for p in zip(ids, ids[1:]) if (r := rank.get(p)) is not None), default=None)
            if best is None:
                break
            out, k, n = [], 0, len(ids)
            while k < n:
                if k + 1 < n and rank.get((ids[k], ids[k + 1])) == best:
                    out.append(best[1])
                    k += 2
                else:
                    out.append(ids[k])
                    k += 1
            ids = out
        return ids


def sufficient_lookahead(rank: dict[tuple[int, int], tuple[int, int]], letters: Iterable[int]) -> int:
    """Symbols behind the end of a token that decide whether the token stays, for any text.

    A token that has formed is lost only if a rule (x, y) takes its right edge x, the token or a
    right-hand part of it, earlier than the merge that would take x into the token. Whether y is
    there depends on y's own symbols and on rules that take y's right edge earlier still, and so
    on with falling ranks. So the reach of a rule is the length of y and the greatest reach of an
    earlier rule on y's right edge; rules in order of rank make one pass. Every merge must use
    tokens that earlier merges made, which is tested.
    """
    made: dict[int, tuple[int, int, int]] = {}  # token: rank of its merge, left, right
    size = dict.fromkeys(letters, 1)
    order: dict[int, list[int]] = {}  # left token: ranks of its rules, and their greatest reach so far
    reach: dict[int, list[int]] = {}

    def furthest(token: int, before: float) -> int:
        most, taken = 0, before
        while True:
            k = bisect_left(order.get(token, ()), min(taken, before))
            if k:
                most = max(most, reach[token][k - 1])
            if token not in made:
                return most
            taken, _, token = made[token]

    for (a, b), (r, new) in rank.items():
        if a not in size or b not in size or new in made:
            raise ValueError("merges must build on earlier ones, each token once")
        far = size[b] + furthest(b, r)
        order.setdefault(a, []).append(r)
        got = reach.setdefault(a, [])
        got.append(max(far, got[-1] if got else 0))
        made[new] = (r, a, b)
        size[new] = size[a] + size[b]
    return max((furthest(t, float("inf")) for t in size), default=0)


class WordStream:
    """Tokens of one word whose bytes come in pieces; what is held never exceeds a window.

    A token leaves once ``lookahead`` symbols behind its end are known. What stands before a
    boundary between tokens has no influence on what follows it, so the window starts anew there.
    """

    def __init__(self, merges: Merges) -> None:
        self.merges, self.window, self.held = merges, [], None

    def feed(self, data: bytes) -> Iterator[int]:
        """The last byte is held back: only what follows tells whether it ends the word."""
        m, most = self.merges, self.merges.lookahead + STEP
        for b in data:
            if self.held is not None:
                self.window.append(m.symbol[self.held])
            self.held = b
            if len(self.window) >= most:
                yield from self._stable(len(self.window) - m.lookahead)

    def _stable(self, upto: int) -> Iterator[int]:
        at = 0
        for t in self.merges.merged(self.window):
            size = self.merges.size[t]
            if at + size > upto:
                break
            at += size
            yield t
        self.window = self.window[at:]

    def finish(self) -> list[int]:
        if self.held is None:
            return []
        out = self.merges.merged([*self.window, self.merges.last_symbol[self.held]])
        self.window, self.held = [], None
        return out


def _safe(c: str) -> bool:
    """True if no composition can join the character to what stands before it."""
    return c < "̀" or not (unicodedata.category(c)[0] == "M" or unicodedata.combining(c) or "ᄀ" <= c <= "ᇿ" or "ힰ" <= c <= "퟿")


def normal_chunks(text: str, chunk: int = CHUNK) -> Iterator[str]:
    """Composed, lower-cased text in pieces that could be normalized alone."""
    at = 0
    while at < len(text):
        to = min(at + chunk, len(text))
        while to < len(text) and not _safe(text[to]):
            to += 1
        part = text[at:to]
        if not part.isascii() and _doubtful(part):
            part = _library()[0].normalize_str(part)
        elif not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # each letter is lowered alone
        yield part.lower()
        at = to


@cache
def _library():
    """The tokenizer library's own steps, for characters newer than Python's tables."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]), pre_tokenizers.Split(Regex(_WORD.pattern), "removed", invert=True)


def _matches(s: str) -> list[str]:
    if s.isascii():
        return _ASCII_WORD.findall(s)
    if _doubtful(s):
        return [w for w, _ in _library()[1].pre_tokenize_str(s)]
    return _WORD.findall(s)


def _bounds(s: str, at: int) -> Iterator[tuple[int, int]]:
    """Starts and ends of the words of s[at:]."""
    if not s.isascii() and _doubtful(s):
        yield from ((at + i, at + j) for _, (i, j) in _library()[1].pre_tokenize_str(s[at:]))
    else:
        yield from (m.span() for m in (_ASCII_WORD if s.isascii() else _WORD).finditer(s, at))


def _goes_on(lead: str, s: str) -> int:
    """How far s continues a run of letters or signs that begins like ``lead``."""
    return next(_bounds(lead + s, 0))[1] - 1


def word_pieces(chunks: Iterable[str], long: int = LONG) -> Iterator[tuple[list[str], str | None, bool]]:
    """(whole words, a piece of a long run or None, whether the run ends) in the order of the text.

    A word is whole if three characters are known behind it or the text ends: that decides runs
    and contractions. A run longer than ``long`` is handed on in pieces.
    """
    carry, inside = "", None
    for chunk in chunks:
        s = carry + chunk
        carry = ""
        if inside:
            n = _goes_on(inside, s)
            yield [], s[:n], n < len(s)
            if n == len(s):
                continue
            s, inside = s[n:], None
        # from a place near the end on, words are looked at again with what follows
        cut = max(0, len(s) - 3)
        # (a blank is a place from which words can be found anew)
        last = next((i for i, j in _bounds(s, max(0, s.rfind(" ", 0, cut))) if j > cut), len(s))
        if last:
            yield _matches(s[:last]), None, False
        carry = s[last:]
        if len(carry) > long:
            inside = next((lead for lead in "a!" if _goes_on(lead, carry) == len(carry)), None)
            if inside:
                yield [], carry, False
                carry = ""
    if inside:
        yield [], "", True
    elif carry:
        yield _matches(carry), None, False


class Transducer:
    """Texts to ids to texts, a chunk at a time, with a bounded memory of whole words."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        m = self.merges
        self.apart = re.compile("(" + "|".join(re.escape(t) for t in sorted(m.special, key=len, reverse=True)) + ")") if m.special else None
        self.lines: dict[str, tuple[bytes, int, bytes]] = {}
        self.name = {i: t.encode() for i, t in m.token.items()}

    def word_ids(self, word: str) -> list[int]:
        m, data = self.merges, word.encode()
        if len(data) <= STEP:  # one window
            return m.merged([*map(m.symbol.__getitem__, data[:-1]), m.last_symbol[data[-1]]])
        stream = WordStream(m)
        return [*stream.feed(data), *stream.finish()]

    def _line(self, word: str) -> tuple[bytes, int, bytes]:
        """The ids of a word in decimal, their number and their strings."""
        got = self.lines.get(word)
        if got is None:
            if len(self.lines) >= MEMORY:
                self.lines.clear()
            got = self.lines[word] = self._written(self.word_ids(word))
        return got

    def _written(self, ids: list[int]) -> tuple[bytes, int, bytes]:
        return b" ".join([b"%d" % i for i in ids]), len(ids), b" ".join(decode_bytes(ids, self.name))

    def written(self, text: str, chunk: int = CHUNK, long: int = LONG) -> Iterator[tuple[bytes, int, bytes]]:
        """Parts of (decimal ids joined by blanks, their number, their strings joined by blanks)."""
        for k, part in enumerate(self.apart.split(text) if self.apart else [text]):
            if k % 2:
                yield self._written([self.merges.special[part]])
                continue
            stream = None
            for words, piece, ends in word_pieces(normal_chunks(part, chunk), long):
                if piece is None:
                    if words:
                        ids, sizes, names = zip(*map(self._line, words), strict=True)
                        yield b" ".join(ids), sum(sizes), b" ".join(names)
                    continue
                stream = stream or WordStream(self.merges)
                out = [*stream.feed(piece.encode())]
                if ends:
                    out += stream.finish()
                    stream = None
                if out:
                    yield self._written(out)

    def encode(self, text: str, chunk: int = CHUNK, long: int = LONG) -> list[int]:
        return [int(i) for ids, _, _ in self.written(text, chunk, long) for i in ids.split()]


def decode_bytes(ids: Iterable[int], name: dict[int, bytes]) -> list[bytes]:
    """The byte string of every id."""
    return [name[i] for i in ids]


class TextMachine:
    """Bytes to text: what no later byte can change comes out at once, at most three bytes stay.

    Bytes that form no character come out as U+FFFD, one for each part that could not go on.
    """

    def __init__(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self.state.decode(data)

    def finish(self) -> str:
        return self.state.decode(b"", True)


def restored(ids: Iterable[int], merges: Merges) -> Iterator[str]:
    """Ids back to readable text, incrementally: letters to bytes, word ends to blanks, bytes to text."""
    machine, byte_of = TextMachine(), {c: b for b, c in enumerate(byte_letters())}
    special = {i: t for t, i in merges.special.items()}
    for i in ids:
        token = merges.token[i]
        if i in special:
            yield machine.feed((token + " ").encode())
            continue
        ends = bool(merges.end) and token.endswith(merges.end)
        data = bytes(byte_of[c] for c in (token[: -len(merges.end)] if ends else token))
        yield machine.feed(data + b" " * ends)
    yield machine.finish()


@cache
def _transducer(path: str) -> Transducer:
    return Transducer(path)


def _digested(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(path)
        for b in batches:
            counts, digests = [], ([], [])
            for t in b.column("text"):
                n, hashes, machine = 0, (hashlib.sha256(), hashlib.sha256()), TextMachine()
                for ids, size, names in transducer.written(t.as_py() or ""):
                    lead = b" " if n else b""
                    hashes[0].update(lead + ids)
                    hashes[1].update(machine.feed(lead + names).encode())
                    n += size
                hashes[1].update(machine.finish().encode())
                counts.append(n)
                for out, h in zip(digests, hashes, strict=True):
                    out.append(h.hexdigest())
            cols = [b.column("doc_id"), pa.array(counts, pa.int64()), *[pa.array(d, pa.string()) for d in digests]]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_and_decode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row.

    Every whole text is encoded as the file's tokenizer does without special tokens added (those
    in the text are found) and decoded again, its tokens joined by blanks as the file names no
    decoder. A null, empty or blank text has no ids: the hashes of nothing. Very long texts and
    words pass in chunks and windows and give the same ids. Rows are taken alone: repeated and
    null ids, ties and repeated rows do no harm, an empty table gives none, and other columns of
    ``docs`` are not read. Nothing is shuffled.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_digested(tokenizer), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids (array) of every row, in the same way."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = _transducer(tokenizer)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                ids = [transducer.encode(t.as_py() or "") for t in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(ids: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of every row of doc_id and ids: readable text, words apart by one blank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = _transducer(tokenizer).merges
        for b in batches:
            texts = ["".join(restored(x.as_py() or [], merges)).removesuffix(" ") for x in b.column("ids")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return ids.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
