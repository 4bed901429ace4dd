"""Spelling variants: words one edit apart, found by search schemes on bidirectional FM-indexes."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, small

#: Code points and occurrences a word needs; how many times commoner its form is; one run in so many loses a letter.
SHORTEST, COMMON, RATIO, EVERY = 6, 5, 5, 199
#: Entries of a shard, about; entries of a key beyond which it is refined; queries of a search at a time.
SHARD, HOT, BATCH = 1 << 16, 1 << 14, 1 << 12
#: Words a counting task holds before it hands them on.
HELD = 1 << 19
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
REPLACED, LOST = 0, 1


def _tallied(shortest: int, every: int):
    run_of_letters = re.compile(f"[a-zÀ-ÿ]{{{shortest},}}")  # shorter runs yield no word

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        for b in batches:
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                data = text.as_py()
                if not data:
                    continue
                lead = b"" if doc_id is None else b"%d" % doc_id
                for w, n in Counter(run_of_letters.findall(data.translate(_LOWER).decode())).items():
                    h = zlib.crc32(lead + b":" + w.encode())
                    if h % every == 0:
                        k = h % len(w)
                        w = w[:k] + w[k + 1 :]
                        if len(w) < shortest:
                            continue
                    total[w] += n
            if len(total) > HELD:
                yield rows()
                total.clear()
        yield rows()

    return run


def word_counts(docs: DataFrame, shortest: int = SHORTEST, common: int = COMMON, every: int = EVERY) -> DataFrame:
    """word, n: words of at least ``shortest`` letters that occur ``common`` times or more.

    A word is a maximal run of letters, A-Z lower-cased; one run in ``every``, by the crc32 of
    ``<doc_id>:<run>``, loses a letter (a null id is written as nothing). Runs are counted
    within tasks first.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_tallied(shortest, every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= common)


# --- candidate keys: parts of two words that an edit leaves alone ---------------


def _key() -> Column:
    """What two near words share: kind and length, and ``a`` letters in front and ``b`` behind."""
    return F.concat_ws(":", "kind", "m", "a", "b", F.left("word", F.col("a")), F.right("word", F.col("b")))


def _halved(rows: DataFrame) -> DataFrame:
    """Both halves of the part where the edit may be: it leaves one of them alone."""
    half = F.floor((F.col("m") - F.col("a") - F.col("b")) / 2).cast("int")
    rest = (F.col("m") - F.col("a") - F.col("b") - half).cast("int")
    both = F.array(F.struct((F.col("a") + half).alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("b") + rest).alias("b")))
    return rows.select("word", "kind", "m", "asks", F.explode(both).alias("x")).select("word", "kind", "m", "asks", "x.a", "x.b")


def entries(words: DataFrame, hot: int = HOT) -> DataFrame:
    """word, kind, m, asks, a, b, key, for each word and each part of it that a near word may share.

    Words of one length m differ by a replaced letter; a word of m + 1 letters may lose one and
    become a word of m, and only the longer one asks. Either way the first or the second half
    of m letters is untouched. A key of more than ``hot`` words is refined: the open part is
    halved again, down to a single letter, so no key holds more than the alphabet allows.
    Keys of one word are left out.
    """
    size = F.length("word")
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), m.cast("int").alias("m"), F.lit(asks).alias("asks")) for k, m, asks in ((REPLACED, size, True), (LOST, size - 1, True), (LOST, size, False))])
    whole = words.select("word", F.explode(kinds).alias("x")).select("word", "x.*", F.lit(0).alias("a"), F.lit(0).alias("b"))
    done, todo = None, cut(_halved(whole).withColumn("key", _key()))
    while True:
        sizes = cut(todo.groupBy("key").agg(F.count(F.lit(1)).alias("_n"), F.max("asks").alias("_asked"), F.max(F.col("m") - F.col("a") - F.col("b")).alias("_open")).filter("_n > 1 AND _asked"))
        rows = cut(todo.join(small(sizes, F.octet_length("key") + 24), "key"))
        wide = (F.col("_n") > hot) & (F.col("_open") > 1)
        now = rows.filter(~wide).select("word", "kind", "m", "asks", "a", "b", "key")
        done = now if done is None else done.unionAll(now)
        again = rows.filter(wide)
        if again.isEmpty():
            return done
        todo = cut(_halved(again).withColumn("key", _key()))


# --- FM-index -----------------------------------------------------------------


class Index:
    """FM-index of a text of delimited words, for one direction of reading.

    Code 0 is the delimiter; the text begins and ends with one. The suffixes that begin with a
    delimiter rank first, the last delimiter before all and then the words in their order, so the
    rank of a whole word's interval is the word's place.
    """

    def __init__(self, text: np.ndarray) -> None:
        n = self.n = text.size
        rank, k = text.astype(np.int64), 1
        while True:  # ranks by the first k codes, then by twice as many
            nxt = np.full(n, -1, np.int64)
            nxt[: n - k] = rank[k:]
            both = rank * (n + 2) + nxt + 1
            order = np.argsort(both, kind="stable")
            fresh = np.r_[0, (both[order][1:] != both[order][:-1]).astype(np.int64)]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(fresh)
            if rank[order[-1]] == n - 1:
                break
            k *= 2
        self.bwt = text[order - 1].astype(np.int64)
        # places of each code in the transform, by code: a search in them counts and maps at once
        self.places = np.sort(self.bwt * (n + 1) + np.arange(n))
        self.delimiters = int((text == 0).sum())

    def before(self, code: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The interval bound of ``code`` in front of the suffixes below ``row``."""
        return np.searchsorted(self.places, code * (self.n + 1) + row)


@dataclass
class Vocabulary:
    """Distinct words of two or more letters in order, as codes, with an index for either direction."""

    words: list[str]

    def __post_init__(self) -> None:
        points = np.frombuffer("".join(self.words).encode("utf-32-le"), np.uint32)
        self.size = np.array([len(w) for w in self.words], np.int64)
        start = np.cumsum(self.size) - self.size
        self.alphabet = np.unique(points)
        codes = np.searchsorted(self.alphabet, points) + 1
        width = int(self.size.max())
        inside = np.arange(width)[None, :] < self.size[:, None]
        forward = np.zeros((self.size.size, width), np.int64)
        forward[inside] = codes
        backward = np.zeros_like(forward)  # each word from its end
        backward[inside] = codes[(np.repeat(start + self.size - 1, self.size) - (np.arange(codes.size) - np.repeat(start, self.size)))]
        order = np.lexsort(backward.T[::-1])
        # for reading to the left: patterns from their end, words in order; to the right: the mirror image
        self.sides = (
            (backward, self._index(forward, np.arange(self.size.size)), np.arange(self.size.size)),
            (forward, self._index(backward, order), order),
        )

    def _index(self, codes: np.ndarray, order: np.ndarray) -> Index:
        rows = np.zeros((order.size, codes.shape[1] + 1), np.int64)
        rows[:, 1:] = codes[order]
        keep = np.arange(rows.shape[1])[None, :] <= self.size[order][:, None]
        return Index(np.r_[rows[keep], 0])

    def near(self, side: int, word: np.ndarray, kind: np.ndarray, exact: np.ndarray, free: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(asking word, found word): ``exact`` letters match as they are, one of the next ``free`` is
        replaced by a later letter of the alphabet or lost, and the rest and the end match again."""
        patterns, index, order = self.sides[side]
        sigma = self.alphabet.size
        q = np.arange(word.size)
        lo, hi, err = np.zeros(word.size, np.int64), np.full(word.size, index.delimiters), np.zeros(word.size, bool)
        found = [np.zeros((2, 0), np.int64)]
        for p in range(int(self.size[word].max(initial=0)) + 1):
            ended = self.size[word[q]] == p
            at = np.flatnonzero(ended & err)
            first, last = (index.before(np.zeros(at.size, np.int64), x[at]) for x in (lo, hi))
            hit = first < last
            found.append(np.stack([word[q[at[hit]]], order[first[hit] - 1]]))
            q, lo, hi, err = (x[~ended] for x in (q, lo, hi, err))
            if not q.size:
                break
            code = patterns[word[q], p]
            may = np.flatnonzero(~err & (p >= exact[q]) & (p < exact[q] + free[q]))
            lost = may[kind[q[may]] == LOST]
            swap = may[kind[q[may]] == REPLACED]
            state, other = self._later(index, lo, hi, code, swap, sigma)
            src = np.r_[np.arange(q.size), state]
            c = np.r_[code, other]
            bounds = index.before(c, lo[src]), index.before(c, hi[src])
            on = bounds[0] < bounds[1]
            q, lo, hi, err = (
                np.r_[x, y] for x, y in (
                    (q[src][on], q[lost]), (bounds[0][on], lo[lost]), (bounds[1][on], hi[lost]),
                    (np.r_[err, np.ones(state.size, bool)][on], np.ones(lost.size, bool)),
                )
            )
        return tuple(np.concatenate(found, axis=1))

    @staticmethod
    def _later(index: Index, lo, hi, code, swap, sigma: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, code): codes beyond a state's own that its interval may go on with; no more than the alphabet for each."""
        narrow = swap[hi[swap] - lo[swap] <= sigma]
        size = hi[narrow] - lo[narrow]
        state = np.repeat(narrow, size)
        other = index.bwt[np.repeat(lo[narrow] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        keep = other > code[state]
        pairs = np.unique(state[keep] * (sigma + 1) + other[keep])
        wide = swap[hi[swap] - lo[swap] > sigma]
        ws = np.repeat(wide, sigma)
        wo = np.tile(np.arange(1, sigma + 1), wide.size)
        keep = wo > code[ws]
        return np.r_[pairs // (sigma + 1), ws[keep]], np.r_[pairs % (sigma + 1), wo[keep]]


def _searched(key: tuple, group: pa.Table) -> pa.Table:
    words = sorted(set(group.column("word").to_pylist()))
    place = {w: k for k, w in enumerate(words)}
    vocabulary = Vocabulary(words)
    asks = group.filter(group.column("asks"))
    word = np.array([place[w] for w in asks.column("word").to_pylist()], np.int64)
    kind, a, b = (asks.column(c).to_numpy().astype(np.int64) for c in ("kind", "a", "b"))
    free = vocabulary.size[word] - a - b
    pairs = [np.zeros((2, 0), np.int64)]
    for side, exact in ((0, b), (1, a)):  # the longer untouched part first
        mine = np.flatnonzero((a > b) == bool(side))
        for k in range(0, mine.size, BATCH):
            at = mine[k : k + BATCH]
            pairs.append(np.stack(vocabulary.near(side, word[at], kind[at], exact[at], free[at])))
    u, v = np.unique(np.concatenate(pairs, axis=1), axis=1) if pairs else pairs[0]
    names = pa.array(words, pa.string())
    return pa.table({"u": names.take(pa.array(u)), "v": names.take(pa.array(v))})


def near_words(words: DataFrame, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """u, v: every pair of words that differ by one replaced, lost or added letter, once.

    Words that share a key lie in one shard; a shard is an index of its own over some
    ``shard`` entries, so that the work grows with the vocabulary and with nothing else.
    """
    rows = cut(entries(words, hot))
    n = max(1, -(-rows.count() // shard))
    dealt = rows.select(F.pmod(F.xxhash64("key"), F.lit(n)).alias("shard"), "word", "kind", "asks", "a", "b")
    return dealt.groupBy("shard").applyInArrow(_searched, "u string, v string").distinct()


def group_variants(docs: DataFrame, ratio: int = RATIO, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (see ``word_counts``).

    A word's form is its near word of largest n (ties: the smallest in code-point order), if that
    is ``ratio`` times as common; root follows the forms to the last. Null, empty and blank texts
    have no words, very long texts and words are taken whole, repeated rows and ids count each
    time, an empty table gives no rows, and other columns of ``docs`` are not read.
    """
    words = cut(word_counts(docs))
    links = cut(near_words(words.select("word"), hot, shard))
    both = links.unionAll(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    other = words.select(F.col("word").alias("v"), F.col("n").alias("vn"))
    best = both.join(other, "v").groupBy(F.col("u").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("vn")).alias("n"), F.col("v").alias("v"))).alias("b"))
    rows = words.join(best, "word", "left")
    enough = -F.col("b.n") >= F.col("n") * ratio
    rows = cut(rows.select("word", F.when(enough, F.col("b.v")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, -F.col("b.n")).alias("form_n")))
    roots = last_forms(rows.filter("form IS NOT NULL").select("word", "form"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain of forms. Forms get commoner by a factor, so chains are short;
    every pass doubles the steps taken."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        moved = cut(now.join(step, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if moved.filter("_moved").isEmpty():
            return now
        now = moved.drop("_moved")
