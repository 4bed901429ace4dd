"""Benchmark decontamination by typed templates, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.llm.common import cut, exploded, row_key, small

#: Template words of a window, those of the shortest item, and the least share of an item's windows that make a leak.
SPAN, SHORTEST, SHARE = 5, 3, 0.8
# fixed values: units that may follow a number
UNITS = (
    "mm cm m km in ft yd mi mg g kg t lb lbs oz ml l s sec min h hr hrs ms kb mb gb tb w kw v hz mph kmh percent "
    "meters metres kilometers kilometres miles feet inches grams kilograms pounds ounces liters litres seconds minutes hours days weeks months years "
    "dollars euros cents degrees"
).split()


def slotted(text: Column) -> Column:
    """Words in order; numbers, names and units carry a mark of their type before their value.

    Digits not inside a word are numbers; a unit follows a number; a name is a capitalised word
    behind a word or comma, so not at the start of a sentence; units may be in any case. Words are lower-cased and lose
    their punctuation.
    """
    base = F.replace(F.coalesce(text, F.lit("")), F.lit("\u0001"), F.lit(" "))
    counted = F.regexp_replace(base, r"(?<![\p{L}\p{N}])(\p{N}+)", " \u0001n$1 ")
    counted = F.regexp_replace(counted, "(\u0001n\\p{N}+ ) ?((?i)" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])", "$1\u0001u$2")
    marked = F.when(base.rlike(r"\p{N}"), counted).otherwise(base)
    # the letter is looked at before what stands ahead of it, as few letters are capitals
    marked = F.regexp_replace(marked, r"((?=\p{Lu})(?<=[\p{L}\p{N},;] )\p{Lu}\p{Ll}+)(?![\p{L}\p{N}])", "\u0001m$1")
    return F.array_remove(F.split(F.lower(marked), "[^\\p{L}\\p{N}\u0001]+"), "")


def _is_name(value: Column) -> Column:
    return F.startswith(value, F.lit("\u0001m"))


def _template(value: Column) -> Column:
    """A word's hash, or 1, 2 or 3 for a number, name or unit."""
    code = F.when(F.startswith(value, F.lit("\u0001n")), 1).when(F.startswith(value, F.lit("\u0001m")), 2).otherwise(3)
    return F.when(F.startswith(value, F.lit("\u0001")), code.cast("long")).otherwise(F.xxhash64(value))


def _windows(rows: DataFrame, keys: list[str], values: bool, span: int = SPAN) -> DataFrame:
    """keys and probe of every window with a literal word; with ``values`` also pos, v and h, the hash of the template.

    A window with names has two rows: probe is the hash of its template, and of its template
    with the names as literal words, so that a copy in other case, which marks other words as
    names, has a probe in common. h is null if nothing but placeholders is left.
    """
    marked = rows.select(*keys, slotted(F.col("text")).alias("_v"))
    t = F.transform("_v", _template).alias("_t")
    plain = F.when(F.exists("_v", _is_name), F.transform("_v", lambda x: F.when(_is_name(x), F.xxhash64(F.substr(x, F.lit(3)))).otherwise(_template(x))))
    marked = marked.select(*keys, *(["_v"] if values else []), t, plain.alias("_n"))
    t, n = F.col("_t"), F.col("_n")

    def window(t: Column, i: Column) -> Column:
        at = [t[i + k] for k in range(span)]
        literal = ~at[0].between(1, 3)
        for x in at[1:]:
            literal = literal | ~x.between(1, 3)
        return F.when(literal, F.xxhash64(*at))  # a window of placeholders alone says nothing

    def other(i: Column) -> Column:
        named = t[i] == 2
        for k in range(1, span):
            named = named | (t[i + k] == 2)
        return F.when(named, window(n, i))

    many = F.sequence(F.lit(0), F.size("_t") - span)
    if not values:
        each = F.transform(many, lambda i: window(t, i))
        each = F.when(n.isNull(), each).otherwise(F.concat(each, F.array_compact(F.transform(many, other))))
        return exploded(marked, keys, F.when(F.size("_t") >= span, each), "probe")
    each = F.when(F.size("_t") >= span, F.transform(many, lambda i: F.struct(window(t, i).alias("h"), F.when(n.isNotNull(), other(i)).alias("other"))))
    out = exploded(marked, [*keys, "_v"], each, "w", "pos").select(*keys, "_v", "pos", "w.h", F.array_compact(F.array("w.h", "w.other")).alias("probes"))
    out = exploded(out, [*keys, "_v", "pos", "h"], F.col("probes"), "probe")
    return out.select(*keys, "pos", "h", "probe", F.slice("_v", F.col("pos") + 1, F.lit(span)).alias("v"))


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """_id, _th, item_id, n_windows, n_matched and containment of every item that a document holds.

    Windows of five template words are hash-joined. Along an alignment of item and document one
    value of the item should stand for one value of the document: where it stands for several,
    windows with a changed one do not count; windows as they are always do. A leak is an item of
    whose distinct windows at least ``share`` count in the document, as it is, in other case, or
    with other numbers, names and units. Items of three or four words have one window and match
    with their own values only; shorter ones, and windows of placeholders alone, never match;
    null texts have none either; repeated items count as one if they agree in id. Very long texts
    are taken whole. Documents are keyed by id and text hash, so repeated rows share.
    """
    items = cut(benchmark.select("item_id", "text").distinct().withColumn("_n", F.least(F.size(slotted(F.col("text"))), F.lit(SPAN))).filter(F.col("_n") >= SHORTEST))
    out = None
    for span in sorted((r[0] for r in items.select("_n").distinct().collect()), reverse=True) or [SPAN]:  # at most three
        found = _leaks_of(docs, items.filter(F.col("_n") == span).drop("_n"), share, span)
        out = found if out is None else out.unionByName(found)
    return out


def _leaks_of(docs: DataFrame, benchmark: DataFrame, share: float, span: int) -> DataFrame:
    items = cut(_windows(benchmark, ["item_id"], True, span).filter("h IS NOT NULL"))
    total = items.groupBy("item_id").agg(F.countDistinct("h").alias("n_windows"))
    heads = cut(items.select("item_id", "h", "probe").distinct().join(total, "item_id"))
    keyed = docs.select(*row_key(), "text")
    met = _windows(keyed, ["_id", "_th"], False, span).join(small(heads, F.lit(64)), "probe")
    near = met.groupBy("_id", "_th", "item_id").agg(F.count_distinct("h").alias("n"), F.first("n_windows").alias("n_windows"))
    near = cut(near.filter(F.col("n") >= F.lit(share) * F.col("n_windows")).select("_id", "_th", "item_id", "n_windows"))
    # the few candidates once more, with the values in their slots
    some = cut(near.select("_id", "_th").distinct())
    again = _windows(keyed.join(small(some, F.lit(32)), ["_id", "_th"], "left_semi"), ["_id", "_th"], True, span)
    pairs = again.drop("h").join(small(near, F.lit(64)), ["_id", "_th"]).withColumnRenamed("v", "dv").withColumnRenamed("pos", "dpos")
    pairs = pairs.join(small(items, F.lit(256)), ["item_id", "probe"])
    bare = lambda x: F.when(_is_name(x), F.substr(x, F.lit(3))).otherwise(x)
    slots = F.filter(F.zip_with("v", "dv", lambda b, d: F.struct(b.alias("b"), bare(d).alias("d"), (bare(b) != bare(d)).alias("new"))), lambda x: F.startswith(x["b"], F.lit("\u0001")))
    line = pairs.groupBy("_id", "_th", "item_id", "n_windows", (F.col("dpos") - F.col("pos")).alias("shift")).agg(
        F.collect_set(F.struct("h", slots.alias("slots"))).alias("ws")
    )  # one alignment holds each window of the item once
    line = line.withColumn("all", F.array_distinct(F.flatten(F.transform("ws", lambda w: w["slots"]))))
    several = F.filter("all", lambda x: F.size(F.filter("all", lambda y: y["b"] == x["b"])) > 1)
    line = line.withColumn("several", F.transform(several, lambda x: x["b"]))
    kept = F.filter("ws", lambda w: ~F.exists(w["slots"], lambda x: x["new"] & (F.array_contains("several", x["b"]) | F.lit(span < SPAN))))
    found = line.select("_id", "_th", "item_id", "n_windows", F.transform(kept, lambda w: w["h"]).alias("hs"))
    found = found.groupBy("_id", "_th", "item_id", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("hs")))).alias("n_matched"))
    found = found.filter(F.col("n_matched") >= F.lit(share) * F.col("n_windows"))
    return found.withColumn("containment", F.col("n_matched") / F.col("n_windows"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item."""
    gone = cut(leaks(docs, benchmark, share).select("_id", "_th").distinct())
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *row_key())
    return rows.join(small(gone, F.lit(32)), ["_id", "_th"], "left_anti").select("row.*")
