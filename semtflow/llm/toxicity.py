"""Toxicity by class-conditional Kneser-Ney models of words, letter by letter."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from semtflow.llm.common import cut, exploded, small, stored
from semtflow.llm.wordhash import flat, mix, pieces, span_hash, word_bounds, word_hashes

#: Words of a passage; how many of the most telling words of a text are averaged; what a toxic example weighs.
PASSAGE, TELLING, WEIGHT = 5, (3, 8), 2.0
FEATURES = ("passage", "whole", "beyond", "share2", "share3", "top3", "top8", "size")
_U = np.uint64
_BASE = 0x27D4EB2F165667C5
_COUNTS = ("toxic0", "other0", "toxic2", "other2", "kinds0", "kinds2", "kinds")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3: 0 and 2 train and calibrate each other, 1 is held out."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def plain(text: Column) -> Column:
    """Lower-cased runs of letters and digits, a blank apart."""
    return F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Every byte of every word and its end mark: hashes of the word up to and before the byte, and the word's index."""
    size = end - start
    room = size + 2
    at = np.cumsum(room) - room
    buf = np.full(int(room.sum()), 2, _U)
    buf[np.repeat(at + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = data[np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    buf[at + room - 1] = 3
    grams = size + 1
    pos = np.repeat(at + 1 - (np.cumsum(grams) - grams), grams) + np.arange(grams.sum())
    word = np.repeat(np.arange(size.size), grams)
    return span_hash(buf, at[word], pos + 1, _BASE), span_hash(buf, at[word], pos, _BASE), word


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of words in order: how often each beginning goes on with each byte.

    All words of a beginning stand side by side, so within a batch only what the first or the
    last word begins with may go on elsewhere; of the rest, what one class alone has is of no
    use (see ``class_ratios``) and stays here.
    """
    for b in batches:
        if not b.num_rows:
            continue
        data, off = flat(b.column("word"))
        upto, before, word = _spelled(data, off[:-1], off[1:])
        counts = np.stack([b.column(c).to_numpy() for c in _COUNTS[:4]], 1).astype(float)
        seen = np.stack([counts[:, :2].sum(1) > 0, counts[:, 2:].sum(1) > 0, np.ones(len(counts), bool)], 1)
        each = np.concatenate([counts, seen], 1)[word]
        _, at, of = np.unique(upto, return_index=True, return_inverse=True)
        sums = np.stack([np.bincount(of, each[:, k], at.size) for k in range(each.shape[1])], 1)
        _, group = np.unique(before[at], return_inverse=True)
        both = [np.bincount(group, sums[:, k] + sums[:, k + 2])[group] > 0 for k in (0, 1)]
        edge = np.isin(before[at], before[(word == 0) | (word == b.num_rows - 1)])
        keep = (both[0] & both[1]) | edge
        cols = [pa.array(x[at][keep].view(np.int64)) for x in (upto, before)] + [pa.array(sums[keep, k].astype(np.int64)) for k in range(sums.shape[1])]
        yield pa.RecordBatch.from_arrays(cols, ["key", "context", *_COUNTS])


def prefix_counts(labelled: DataFrame) -> DataFrame:
    """key, context and counts: in how many documents of either class and fold words begin in a certain way.

    key and context are hashes of the beginning with and without its last byte. ``labelled`` has
    text, toxic (0 or 1) and fold (0 or 2). A word counts once for each document that holds it,
    so that one that repeats a word does not outweigh others; ``kinds`` count the different words
    of a beginning. Words are counted first and put in order, so that what travels is distinct
    words, and beginnings that both classes have.
    """
    text = F.array_distinct(F.split(plain(F.col("text")), " "))
    each = exploded(labelled, ["toxic", "fold"], text, "word").filter("word <> ''")
    counts = [F.sum(((F.col("toxic") == c) & (F.col("fold") == f)).cast("long")).alias(n) for n, c, f in (("toxic0", 1, 0), ("other0", 0, 0), ("toxic2", 1, 2), ("other2", 0, 2))]
    words = stored(each.groupBy("word").agg(*counts), "toxicity-words")
    ordered = words.select(F.col("word").cast("binary").alias("word"), *_COUNTS[:4]).repartitionByRange("word").sortWithinPartitions("word")
    rows = ordered.mapInArrow(_counted, "key long, context long, " + ", ".join(f"{c} long" for c in _COUNTS))
    return stored(rows.groupBy("key", "context").agg(*[F.sum(c).alias(c) for c in _COUNTS]), "toxicity-beginnings")


def class_ratios(counts: DataFrame, folds: tuple[int, ...] = (0, 2)) -> DataFrame:
    """h, ratio: log P(byte | beginning, toxic) - log P(byte | beginning, ordinary), of the Kneser-Ney models of some folds.

    A class model discounts its counts by D = n1 / (n1 + 2 n2) and gives what that frees, D *
    types / total, to shared counts: the different words, of either class, that go on with the
    byte. A byte that no word has after a beginning leaves the two freed weights alone; that is
    the row of the beginning itself. Where a beginning occurs in one class only, its own counts
    are all there is to share: both models are the shared one, the ratio is 0, and there is no row.
    """
    kinds = "kinds" if len(folds) == 2 else f"kinds{folds[0]}"
    total = lambda c: sum((F.col(f"{c}{f}") for f in folds[1:]), F.col(f"{c}{folds[0]}"))
    rows = counts.select("key", "context", total("toxic").alias("toxic"), total("other").alias("other"), F.col(kinds).alias("kinds")).filter("kinds > 0")
    tested = [F.sum((F.col(c) == i).cast("long")).alias(f"{c}{i}") for c in ("toxic", "other") for i in (1, 2)]
    n = rows.agg(*tested).first()
    discount = {c: F.lit(n[f"{c}1"] / (n[f"{c}1"] + 2 * n[f"{c}2"]) if n[f"{c}1"] else 0.5) for c in ("toxic", "other")}
    whole = rows.groupBy(F.col("context").alias("h")).agg(
        *[F.sum(c).alias(f"{c}_all") for c in ("toxic", "other", "kinds")], *[F.sum((F.col(c) > 0).cast("long")).alias(f"{c}_types") for c in ("toxic", "other")])
    whole = whole.filter("toxic_all > 0 AND other_all > 0")  # the ratio is 0 elsewhere
    freed = {c: discount[c] * F.col(f"{c}_types") / F.col(f"{c}_all") for c in ("toxic", "other")}

    def p(c: str) -> Column:
        return F.greatest(F.col(c) - discount[c], F.lit(0.0)) / F.col(f"{c}_all") + freed[c] * F.col("kinds") / F.col("kinds_all")

    grams = rows.join(whole, F.col("context") == F.col("h")).select(F.col("key").alias("h"), F.log(p("toxic") / p("other")).alias("ratio"))
    contexts = whole.select(F.col("h").bitwiseXOR(F.lit(_CONTEXT)).alias("h"), F.log(freed["toxic"] / freed["other"]).alias("ratio"))
    return grams.unionByName(contexts)


#: Tells the row of a beginning from that of the byte it ends with.
_CONTEXT = 0x5851F42D4C957F2D


@dataclass
class Model:
    """A hash table of parts; what finds its place taken goes to the next part.

    A place holds a 32-bit mark of its key and a value. Parts are added until every row has a
    place, each with one to two places a row that is left.
    """

    bits: list[int] = field(default_factory=list)
    mark: list[np.ndarray] = field(default_factory=list)
    value: list[np.ndarray] = field(default_factory=list)

    def _at(self, h: np.ndarray, part: int) -> np.ndarray:
        """Every part scatters the hash anew."""
        return (mix(h + _U(part)) >> _U(64 - self.bits[part])).astype(np.int64)

    def put(self, h: np.ndarray, value: np.ndarray) -> None:
        """Fill the table."""
        while h.size or not self.bits:
            self.bits.append(max(4, h.size.bit_length()))
            size, part = 1 << self.bits[-1], len(self.bits) - 1
            mark, values = np.zeros(size, np.uint32), np.zeros(size, np.float32)
            at, first = np.unique(self._at(h, part), return_index=True)
            mark[at], values[at] = h[first].astype(np.uint32), value[first]
            self.mark.append(mark)
            self.value.append(values)
            rest = np.ones(h.size, bool)
            rest[first] = False
            h, value = h[rest], value[rest]

    def find(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, and whether they are there."""
        out, left = np.zeros(h.size, np.float32), np.arange(h.size)
        for part in range(len(self.bits)):
            if not left.size:
                break
            at = self._at(h[left], part)
            hit = self.mark[part][at] == h[left].astype(np.uint32)
            out[left[hit]] = self.value[part][at[hit]]
            left = left[~hit]
        found = np.ones(h.size, bool)
        found[left] = False
        return out, found

    def ratios(self, upto: np.ndarray, before: np.ndarray) -> np.ndarray:
        """log P(byte | word so far, toxic) - log P(byte | word so far, ordinary)."""
        out, known = self.find(before ^ _U(_CONTEXT))
        at = np.flatnonzero(known)
        value, found = self.find(upto[at])
        out[at[found]] = value[found]
        return out


def build_model(rows: DataFrame) -> Model:
    """The lookup table of a model, with all its rows: 8 to 16 bytes a row in the first part, and about as much in the others.

    A row is a different beginning that labelled words of both classes have, so the table grows
    with their vocabulary. No row is left out.
    """
    got = rows.select("h", F.col("ratio").cast("float").alias("ratio")).toArrow()
    model = Model()
    model.put(got["h"].to_numpy().view(_U), got["ratio"].to_numpy())
    return model


def _features(data: np.ndarray, off: np.ndarray, model: Model) -> np.ndarray:
    """Of every text: the highest mean ratio of a passage, that of the whole, the mean beyond 1, the shares of
    words over 2 and 3, the means of its most telling different words, and the log of its words."""
    start, end, first = word_bounds(data, off)
    out = np.zeros((off.size - 1, len(FEATURES)))
    if not start.size:
        return out
    _, at, of = np.unique(word_hashes(data, start, end), return_index=True, return_inverse=True)
    upto, before, word = _spelled(data, start[at], end[at])
    one = np.bincount(word, model.ratios(upto, before), at.size)
    ratio, n = one[of], np.diff(first)
    has = np.flatnonzero(n)
    head = first[:-1][has]
    upto_sum = np.r_[0.0, np.cumsum(ratio)]
    here = np.arange(ratio.size)
    to = np.minimum(here + PASSAGE, np.repeat(first[1:], n))
    out[has, 0] = np.maximum.reduceat((upto_sum[to] - upto_sum[here]) / PASSAGE, head)
    for k, x in enumerate((ratio, np.maximum(ratio - 1, 0), ratio > 2, ratio > 3), 1):
        out[has, k] = np.add.reduceat(x.astype(float), head) / n[has]
    pairs = np.unique(np.repeat(np.arange(n.size), n) * at.size + of)  # a text's different words
    text, r = pairs // at.size, one[pairs % at.size]
    order = np.lexsort((-r, text))
    text, r = text[order], r[order]
    rank = np.arange(r.size) - np.searchsorted(text, text)
    for k, most in enumerate(TELLING, 5):
        mine = rank < most
        out[:, k] = np.bincount(text[mine], r[mine], n.size) / np.maximum(np.bincount(text[mine], minlength=n.size), 1)
    out[has, 7] = np.log(n[has])
    return out


def _measured(shared, keep: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, off = flat(b.column("_plain"))
            got = np.concatenate([_features(data[off[i] : off[j]], off[i : j + 1] - off[i], model) for i, j in pieces(off)] or [np.zeros((0, len(FEATURES)))])
            yield pa.RecordBatch.from_arrays([b.column(keep), *[pa.array(got[:, k]) for k in range(len(FEATURES))]], [keep, *FEATURES])

    return run


def measure(docs: DataFrame, model: Model, columns: Sequence[str]):
    """The named columns in ``row`` with the features, and the broadcast they read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # as large as the vocabulary
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), plain(F.col("text")).cast("binary").alias("_plain"))
    kind = T.StructType([rows.schema["row"], *[T.StructField(f, T.DoubleType()) for f in FEATURES]])
    return rows.mapInArrow(_measured(shared, "row"), kind), shared


def score_documents(docs: DataFrame, labels: DataFrame, columns: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``row`` (the named columns of ``docs``), held_out, score (0 to 1) and predicted of every row.

    Labels of documents whose fold is 0 or 2 train the two models; fold 1 is held out. The
    logistic curve over the length-normalised ratios is fitted on the same documents, each
    fold measured with a model of the other. A label table may repeat
    ids (any 1 wins) and hold nulls (ignored). Null, blank and empty texts have ratios of 0 and
    the score of that; very long texts are scored whole. Without labels of both classes in both
    folds every score is 0. All labelled words are counted, all words of every text are scored;
    no input but the text enters a score. Repeated rows are scored alike, ties do not arise.
    """
    marks = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    marks = cut(marks.filter(fold_of(F.col("doc_id")) != 1).select(F.col("doc_id").alias("_d"), "toxic"))
    known = docs.select("doc_id", "text").join(small(marks, F.lit(32)), F.col("doc_id") == F.col("_d")).select("doc_id", "text", "toxic")
    known = known.withColumn("fold", fold_of(F.col("doc_id")))  # texts are not stored
    counts = prefix_counts(known)
    label = F.col("row.toxic").cast("double").alias("label")
    tuned = None
    for f in (0, 2):  # one after the other, so that driver and workers hold one model
        rows, shared = measure(known.filter(F.col("fold") == f), build_model(class_ratios(counts, (2 - f,))), ["toxic", "fold"])
        rows = cut(rows.select(label, "row.fold", *FEATURES))
        shared.destroy()
        tuned = rows if tuned is None else tuned.unionByName(rows)
    classes = tuned.groupBy("fold").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).collect()
    rows, _ = measure(docs, build_model(class_ratios(counts)), columns)
    score = F.lit(0.0)
    if len(classes) == 2 and all(r.lo == 0 and r.hi == 1 for r in classes):
        weighed = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(tuned).withColumn("weight", F.when(F.col("label") == 1, WEIGHT).otherwise(1.0))
        fit = LogisticRegression(maxIter=100, regParam=1e-4, weightCol="weight").fit(weighed)
        z = F.lit(float(fit.intercept))
        for f, w in zip(FEATURES, fit.coefficients.toArray(), strict=True):
            z = z + F.col(f) * F.lit(float(w))
        score = 1 / (1 + F.exp(-z))
    held = F.coalesce(fold_of(F.col("row.doc_id")) == 1, F.lit(False)) if "doc_id" in columns else F.lit(False)
    rows = rows.select("row", held.alias("held_out"), score.alias("score"), *FEATURES)
    return rows.withColumn("predicted", (F.col("score") >= 0.7).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that are not predicted toxic."""
    return score_documents(docs, labels, docs.columns).filter("predicted = 0").select("row.*")
