"""Pattern matching of cleaned addresses against a small pattern dimension (C).

Patterns are configuration: their slots become literal regular expressions
once, on the driver. All patterns are tried in one projection, the hits of a
row stay an array in that row, so scoring and picking need no shuffle.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions.text import exploded, let, once, table, words

GAP, HIT = "\x01", "\x02"
BLANK = r"\s+"


@dataclass(frozen=True)
class Slot:
    name: str
    optional: bool
    type: str
    grp: int
    weight: float


@dataclass(frozen=True)
class Pattern:
    pattern_id: str
    priority: int
    text: str
    regex: str
    slots: tuple[Slot, ...]
    scan: str


WIDER = {"no": "(?:no|numara)", "numara": "(?:no|numara)"}
WIDER |= {w: "(?:sokak|sok|sk)" for w in ("sokak", "sok", "sk")}


def read_pattern(pattern_id: str, priority: int, text: str, strict: bool = False) -> Pattern | None:
    """A pattern row from its slot notation, or None where it yields no valid expression.

    Cleaned text spells ``no`` as ``numara`` and ``sk`` as ``sokak``, so literals
    accept both spellings unless ``strict``.
    """
    slots: list[Slot] = []
    items: list[str | Slot] = []

    def piece(m: re.Match) -> str:
        token = m.group(0)
        if token.isspace():
            items.append(BLANK)
            return BLANK
        if not token.startswith("<"):
            word = re.match(r"\w+", token)
            wide = word and word.group(0) in WIDER and not strict
            items.append(WIDER[word.group(0)] + re.escape(token[word.end():]) if wide else re.escape(token))
            return items[-1]
        name = token[1:-1].removesuffix("?")
        kind = "number" if name.startswith("n") else "text" if name == "text" else "named"
        body = {"number": fv.NUMBER_SLOT, "text": fv.TEXT_SLOT, "named": fv.NAMED_SLOT}[kind]
        optional = token.endswith("?>")
        slots.append(Slot(name, optional, kind, len(slots) + 1, fv.SLOT_WEIGHTS.get(name, 1.0)))
        items.append(slots[-1])
        return f"(?:{body})?" if optional else body

    regex = r"\b" + re.sub(r"<[^>]+>|[^\s<]+|\s+", piece, text) + r"\b"
    try:
        re.compile(regex)
    except re.error:
        return None
    return Pattern(pattern_id, priority, text, "(?iU)" + regex, tuple(slots), _Scan(tuple(items)).regex())


LETTERS = "[a-zA-ZçğıöşüÇĞIÖŞÜ]++"
RUN = rf"{LETTERS}(?:\s++{LETTERS})*+"
RUN_OF_TOKENS = rf"{LETTERS}(?!\S)(?:\s++{LETTERS}(?!\S))*+"


@dataclass(frozen=True)
class _Scan:
    """The expression of a pattern in a form that reads a text once.

    A lazy slot gives way at the first place from which the rest of the pattern goes on. Here it
    is a possessive loop that looks for that place ahead, word by word, so nothing is tried
    again with the same words dealt out in another way:

    - A named slot before another slot that takes letters is one word: what follows can take the rest.
    - A named slot never leaves its run of letter words, and if a match begins within a run, one
      begins at the run's start. So runs are left as a whole.
    - Where a text slot follows the first slot, or is the first, a match from a later place
      implies one from the first place. So only that is tried.

    Groups, matched text and leftmost match are those of ``regex``.
    """

    items: tuple[str | Slot, ...]

    def regex(self) -> str:
        return f"(?iUs)^{self._lead()}({self._body(0, True, start=True)}).*$"

    def _slot(self, i: int, kinds: tuple[str, ...], optional: bool | None = None) -> bool:
        x = self.items[i] if i < len(self.items) else None
        return isinstance(x, Slot) and x.type in kinds and optional in (None, x.optional)

    def _blank(self, i: int) -> bool:
        return i < len(self.items) and self.items[i] == BLANK

    def _lead(self) -> str:
        """What is passed over before the match."""
        if self._slot(0, ("text",), False):
            return r"(?>.*?(?=\b\S))"
        if self._slot(0, ("named",), False):
            if self._blank(1) and self._slot(2, ("text",)) and (not self.items[2].optional or len(self.items) == 3):
                return rf"(?>(?:(?!\b{LETTERS}\s)(?>\b{RUN}|.))*+)"
            if len(self.items) > 3 and isinstance(self.items[1], str) and not self._blank(1) and self._blank(2) and self._slot(3, ("text",), False):
                lit = self.items[1]
                return rf"(?>(?:(?!\b{LETTERS}(?:(?!{lit}\s)\s++{LETTERS})*+{lit}\s+\S)(?>\b{RUN}|.))*+)"
        if self._slot(0, ("named",)):
            return rf"(?:(?!{self._body(0, False, start=True)})(?>\b{RUN}|.))*+"
        return ".*?"

    def _body(self, i: int, groups: bool, start: bool = False) -> str:
        """Everything from an item on, to the word boundary at the end."""
        if start:
            return r"\b" + self._body(0, groups)
        if i == len(self.items):
            return r"\b"
        x = self.items[i]
        rest = self._body(i + 1, groups)
        if isinstance(x, str):
            return x + rest
        ahead = self._body(i + 1, False)
        if x.type == "number":
            body = r"\d+(?:[a-z])?"
        elif x.type == "named":
            body = LETTERS if self._blank(i + 1) and self._slot(i + 2, ("named", "text")) else rf"{LETTERS}(?:(?!{ahead})\s++{LETTERS})*+"
        elif i + 1 == len(self.items):
            body = r"\S+(?:\s+\S+)*?"
        elif not self._blank(i + 1):
            body = rf"\S(?:(?!{ahead})\S)*+(?:\s++\S(?:(?!{ahead})\S)*+)*+"
        else:
            unit = rf"(?>{RUN_OF_TOKENS}|\S++)" if self._slot(i + 2, ("named",), False) and not self._slot(i + 4, ("named", "text")) else r"\S++"
            body = rf"\S++(?:(?!{ahead})\s++{unit})*+"
        group = f"({body})" if groups else f"(?:{body})"
        return (f"(?:{group})?" if x.optional else group) + rest


def patterns(rows=fv.PATTERNS, strict: bool = False) -> list[Pattern]:
    """Valid patterns, highest priority first."""
    made = [read_pattern(*row, strict=strict) for row in rows]
    return sorted((p for p in made if p), key=lambda p: -p.priority)


def pattern_dim(spark: SparkSession, rows: list[Pattern] | None = None) -> DataFrame:
    """The dimension as a table (20 rows as shipped)."""
    rows = patterns() if rows is None else rows
    data = [(p.pattern_id, p.priority, p.regex, [(s.name, s.optional, s.type, s.grp, s.weight) for s in p.slots]) for p in rows]
    schema = "pattern_id string, priority int, regex string, slots array<struct<name:string,optional:boolean,type:string,grp:int,weight:double>>"
    return spark.createDataFrame(data, schema)


def pattern_dim_stats(dim: DataFrame, hits: DataFrame) -> DataFrame:
    """Per pattern: priority, slots, distinct slot types, and how many rows it hit."""
    slots = dim.select("pattern_id", "priority", F.explode("slots").alias("s")).groupBy("pattern_id", "priority").agg(
        F.count(F.lit(1)).alias("n_slots"), F.countDistinct("s.type").alias("n_slot_types"))
    used = hits.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_hits"))
    return slots.join(used, "pattern_id", "left").na.fill({"n_hits": 0})


def _needed(p: Pattern, text: Column) -> Column:
    """True where the literal words and the number the pattern cannot do without all occur."""
    found = F.lit(True)
    for word in dict.fromkeys(re.findall(r"[^\s<>]+", re.sub(r"<[^>]+>", " ", p.text))):
        stem = re.match(r"\w+", word)
        spelled = WIDER.get(stem.group(0), re.escape(stem.group(0))) if stem else re.escape(word)
        found = found & text.rlike("(?iU)" + spelled)
    if any(s.type == "number" and not s.optional for s in p.slots):
        found = found & text.rlike(r"(?U)\d")
    return found


def _candidate(p: Pattern, text: Column) -> Column:
    """Matched text, slot values and slots of one pattern, or null. One regex pass."""
    groups = GAP.join(f"${s.grp + 1}" for s in p.slots)
    marked = F.when(_needed(p, text), F.regexp_replace(text, p.scan, f"{HIT}$1{GAP}{groups}"))
    slots = table(
        [{"name": s.name, "optional": s.optional, "type": s.type, "weight": s.weight} for s in p.slots],
        "array<struct<name:string,optional:boolean,type:string,weight:double>>",
    )

    def read(m: Column) -> Column:
        parts = F.split(F.substring(m, 2, 1 << 30), GAP)
        return F.struct(
            F.lit(p.pattern_id).alias("pattern_id"), F.lit(p.priority).alias("priority"), F.element_at(parts, 1).alias("matched"),
            F.transform(F.slice(parts, 2, len(p.slots)), lambda v: F.trim(v)).alias("values"), slots.alias("slots"),
        )

    return let(marked, lambda m: F.when(m.startswith(HIT), read(m)))


def with_candidates(df: DataFrame, text: str = "text", rows: list[Pattern] | None = None) -> DataFrame:
    """Add ``candidates``: an array with one entry per pattern that occurs in the text."""
    rows = patterns() if rows is None else rows
    return df.withColumn("candidates", F.array_compact(F.array(*[_candidate(p, F.col(text)) for p in rows])))


def match_patterns(df: DataFrame, text: str = "text", rows: list[Pattern] | None = None) -> DataFrame:
    """One row per (address, pattern) hit."""
    return exploded(with_candidates(df, text, rows), F.col("candidates"), "c").select(
        *df.columns, "c.pattern_id", "c.priority", "c.matched", "c.values", "c.slots")


def slot_map(slots: Column, values: Column) -> Column:
    """Slot name to value, optional groups that did not take part left out."""
    names = F.transform(slots, lambda s: s["name"])
    pairs = F.filter(F.arrays_zip(names.alias("k"), values.alias("v")), lambda p: p["v"] != "")
    return F.map_from_entries(pairs)


# --- scores: each a column of matched text, whole text, slots and values ----


def coverage_score(matched: Column, text: Column) -> Column:
    return F.length(matched) / F.length(text) * 0.9


def slot_score(slots: Column, values: Column) -> Column:
    """Weighted quality of filled slots less the penalty of missing ones, over all weights."""
    def worth(s: Column, v: Column) -> Column:
        quality = (
            F.when((s["type"] == "number") & v.rlike(r"^\d+$"), 1.0)
            .when((s["type"] == "named") & (F.size(words(v)) <= 3), 1.0)
            .when(s["type"] == "text", 0.8).otherwise(0.9)
        )
        return F.when(v != "", s["weight"] * quality).when(s["optional"], 0.0).otherwise(s["weight"] * -0.3)

    got = F.aggregate(F.zip_with(slots, values, worth), F.lit(0.0), lambda a, x: a + x)
    total = F.aggregate(slots, F.lit(0.0), lambda a, s: a + s["weight"])
    return F.when(total > 0, got / total).otherwise(0.0)


def _distinct_words(text: Column) -> Column:
    return F.array_distinct(words(F.lower(text)))


def token_overlap(matched: Column, text: Column, text_words: Column | None = None) -> Column:
    m, t = _distinct_words(matched), _distinct_words(text) if text_words is None else text_words
    return F.when(F.size(t) > 0, F.size(F.array_intersect(m, t)) / F.size(t)).otherwise(0.0) * 0.8


def keyword_score(text: Column, low_importance: list[str] | None = None) -> Column:
    low = F.lower(text)

    def hits(keywords: list[str]) -> Column:
        return sum((low.contains(w).cast("int") for w in keywords), F.lit(0))

    score = F.least(F.lit(1.0), hits(fv.LOCATION_WORDS) / 3)
    return F.greatest(F.lit(0.0), score - F.least(F.lit(0.2), hits(low_importance or []) * 0.05)) * 0.6


def edit_similarity(matched: Column, text: Column, text_low: Column | None = None) -> Column:
    """One less the edit distance over the longer length. What stands whole in the text is as far from it as the rest is long."""
    longest = F.greatest(F.length(matched), F.length(text))
    a, b = F.lower(matched), F.lower(text) if text_low is None else text_low
    distance = F.when(b.contains(a), F.length(b) - F.length(a)).otherwise(F.levenshtein(a, b))
    return F.when(longest > 0, F.greatest(F.lit(0.0), 1.0 - distance / longest)).otherwise(1.0)


def text_parts(text: Column) -> Column:
    """What the scores of all hits of one text share: lower case, distinct words, keyword score."""
    return F.struct(F.lower(text).alias("low"), _distinct_words(text).alias("words"), keyword_score(text).alias("keywords"))


def match_confidence(matched: Column, text: Column, slots: Column, values: Column, exact_weight: float = 1.0, of: Column | None = None) -> Column:
    """Mean of the scores less a penalty for what is left of the text. ``of``: its ``text_parts``, if they are at hand."""
    if of is None:
        shared = [token_overlap(matched, text), keyword_score(text), edit_similarity(matched, text)]
    else:
        shared = [token_overlap(matched, text, of["words"]), of["keywords"], edit_similarity(matched, text, of["low"])]
    parts = [coverage_score(matched, text), slot_score(slots, values), *shared]
    mean = sum(parts[1:], parts[0]) / len(parts)
    conf = mean - (F.length(text) - F.length(matched)) / F.length(text) * 0.1
    conf = F.when(F.size(words(matched)) < 2, conf * 0.8).otherwise(conf)
    conf = F.when(F.lower(matched) == (F.lower(text) if of is None else of["low"]), conf * exact_weight).otherwise(conf)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf))


def score_candidates(hits: DataFrame, text: str = "text") -> DataFrame:
    c = F.col
    return hits.withColumn("confidence", match_confidence(c("matched"), c(text), c("slots"), c("values")))


def threshold_filter(scored: DataFrame, thresholds: DataFrame, default: float = 0.4) -> DataFrame:
    """Keep hits at or over their pattern's learnt threshold (one row per pattern)."""
    t = thresholds.select("pattern_id", "threshold")
    return scored.join(t, "pattern_id", "left").withColumn("threshold", F.coalesce("threshold", F.lit(default))).filter(
        F.col("confidence") >= F.col("threshold"))


def top_matches(scored: DataFrame, k: int = 5, key: str = "addr_id") -> DataFrame:
    order = Window.partitionBy(key).orderBy(F.col("confidence").desc(), F.col("priority").desc())  # at most one row per pattern
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def with_best_match(df: DataFrame, text: str = "text", thresholds: dict[str, float] | None = None, default: float = 0.4,
                    rows: list[Pattern] | None = None) -> DataFrame:
    """Add ``best``: the top hit of the row over its threshold, or null. No shuffle.

    ``thresholds`` is the collected threshold table, one entry per pattern.
    """
    limit = F.lit(default)
    if thresholds:
        learnt = table(thresholds, "map<string,double>")

    def scored(c: Column) -> Column:
        conf = match_confidence(c["matched"], F.col(text), c["slots"], c["values"], of=F.col("__of"))
        return F.struct(conf.alias("confidence"), c["priority"].alias("priority"), c["pattern_id"].alias("pattern_id"),
                        c["matched"].alias("matched"), slot_map(c["slots"], c["values"]).alias("slots"))

    def ahead(a: Column, b: Column) -> Column:
        return (a["confidence"] > b["confidence"]) | ((a["confidence"] == b["confidence"]) & (a["priority"] > b["priority"]))

    def over(c: Column) -> Column:
        return c["confidence"] >= (F.coalesce(F.element_at(learnt, c["pattern_id"]), limit) if thresholds else limit)

    order = F.array_sort(F.filter(F.transform("candidates", scored), over), lambda a, b: F.when(ahead(a, b), -1).when(ahead(b, a), 1).otherwise(0))
    tried = with_candidates(once(once(df, F.col(text), text), text_parts(F.col(text)), "__of"), text, rows)
    return tried.select(*df.columns, F.explode_outer(F.slice(order, 1, 1)).alias("best"))


def best_match(scored: DataFrame, key: str = "addr_id") -> DataFrame:
    """k = 1 on exploded hits, as an aggregate."""
    return scored.groupBy(key).agg(
        F.max_by("pattern_id", F.struct("confidence", "priority")).alias("pattern_id"), F.max("confidence").alias("confidence"))


def slots_to_fields(slots: Column) -> Column:
    """Output field to value; where several slots feed a field, the first in the dimension's order wins."""
    entries = []
    for field in fv.FIELDS:
        feeding = [s for s, f in fv.SLOT_FIELDS.items() if f == field]
        if feeding:
            entries.append(F.struct(F.lit(field).alias("key"), F.coalesce(*[F.element_at(slots, s) for s in feeding]).alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def normalized_string(get, fallback: bool = False) -> Column:
    """The address line from its fields. ``get(field)`` gives a column, null where missing."""
    def dressed(field: str) -> Column:
        v = get(field)
        low = F.lower(v)
        if field == "neighborhood":
            done = low.rlike("(mahalle|mahallesi)$") if fallback else low.contains("mah")
            return F.when(done, v).otherwise(F.concat(v, F.lit(" Mahallesi")))
        if field == "block" and fallback:
            return F.when(low.startswith("blok"), v).otherwise(F.concat(v, F.lit(" Blok")))
        label = {"number": ("no", "No: "), "floor": ("kat", "Kat: "), "apartment": ("daire", "Daire: ")}.get(field)
        if label:
            return F.when(low.startswith(label[0]), v).otherwise(F.concat(F.lit(label[1]), v))
        return v

    line = F.concat_ws(", ", *[dressed(f) for f in fv.OUTPUT_ORDER])
    return F.when(line == "", fv.NO_ADDRESS_TEXT).otherwise(line)
