"""Text cleaning as column expressions.

Java's ``\\w``, ``\\b`` and case folding are ASCII unless ``(?U)`` is set, so
every expression over Turkish text carries it.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv

SPACES = r"(?U)\s+"
EDGE_SPACES = r"(?U)^\s+|\s+$"


def let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def table(rows: list | dict, ddl: str) -> Column:
    """A constant array or map column, handed over as one text and folded by the optimizer."""
    return F.from_json(F.lit(json.dumps(rows, ensure_ascii=False)), ddl)


def exploded(df, rows: Column, name: str):
    """One row per array entry. The outer form keeps the optimizer from copying
    the array expression into a filter below; empty arrays are dropped after."""
    return df.select(*df.columns, F.explode_outer(rows).alias(name)).filter(F.col(name).isNotNull())


def in_set(name: str, values) -> Column:
    """Hash membership of a SQL expression in constant texts."""
    quoted = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
    return F.expr(f"{name} IN ({quoted})")


def once(df, value: Column, name: str):
    """Add a column that later steps may name many times without being computed again."""
    keep = [c for c in df.columns if c != name]
    return df.select(*keep, F.explode_outer(F.array(value)).alias(name))


def strip(c: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.regexp_replace(c, EDGE_SPACES, "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, SPACES, " ")


def blank_to_null(c: Column) -> Column:
    return F.nullif(strip(c), F.lit(""))


def words(c: Column) -> Column:
    """Split on white space, no empty parts."""
    return F.filter(F.split(c, SPACES), lambda x: x != "")


def tr_lower(c: Column) -> Column:
    """Lowercase with the dot of a lowered capital İ removed."""
    return F.replace(F.lower(c), F.lit("i̇"), F.lit("i"))


@lru_cache(maxsize=1)
def _compositions() -> list[tuple[str, str]]:
    """(decomposed, composed) for every character NFC puts together, shallow first."""
    pairs = []
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xDFFF:
            continue
        parts = unicodedata.decomposition(ch)
        if not parts or parts.startswith("<"):
            continue
        seq = "".join(chr(int(p, 16)) for p in parts.split())
        if len(seq) == 2 and unicodedata.normalize("NFC", seq) == ch:
            pairs.append((len(unicodedata.normalize("NFD", ch)), seq, ch))
    return [(s, c) for _, s, c in sorted(pairs)]


def compose(c: Column) -> Column:
    """NFC. Rows without combining marks skip the work.

    Marks out of canonical order keep their order; Hangul jamo stay as they are.
    """
    pairs = table([{"s": s, "r": r} for s, r in _compositions()], "array<struct<s:string,r:string>>")
    joined = F.aggregate(pairs, c, lambda acc, p: F.replace(acc, p["s"], p["r"]))
    return F.when(c.rlike(r"\p{M}"), joined).otherwise(c)


def tr_unicode(c: Column) -> Column:
    """Composed form, dotted variants to i, remaining capital I to dotless ı."""
    out = compose(c)
    out = F.replace(out, F.lit("ı̇"), F.lit("i"))
    out = F.replace(out, F.lit("i̇"), F.lit("i"))
    return F.translate(out, "İI", "iı")


def _java_word(text: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != "_" else ch for ch in text)


def _abbreviation_steps(mapping: dict[str, str]) -> list[tuple[str, str]]:
    steps = []
    for key in sorted((k for k in mapping if k), key=len, reverse=True):
        if key.endswith(":"):
            steps.append((rf"(?iU)\b{_java_word(key[:-1])}:(?=\s|\w|$)", mapping[key]))
        elif key.endswith("."):
            steps.append((rf"(?iU){_java_word(key)}(?=\s|$)", mapping[key]))
        else:
            steps.append((rf"(?iU)\b{_java_word(key)}\b", mapping[key]))
    return steps


def _expand_in_turn(c: Column, mapping: dict[str, str]) -> Column:
    rows = table([{"p": p, "r": r} for p, r in _abbreviation_steps(mapping)], "array<struct<p:string,r:string>>")
    return F.aggregate(rows, c, lambda acc, s: F.regexp_replace(acc, s["p"], s["r"]))


def _caseless(word: str) -> str:
    return word.lower().replace("i̇", "i").replace("ı", "i")


def _runs_can_stand_alone(mapping: dict[str, str]) -> bool:
    """True when replacing word by word equals replacing key after key."""
    plain = {_caseless(k): v for k, v in mapping.items() if not k.endswith(":")}
    return all(k.isalnum() for k in plain) and all(
        plain.get(_caseless(v), v) == v for v in plain.values()
    )


def expand_abbrev(c: Column, mapping: dict[str, str] | None = None) -> Column:
    """Replace abbreviations by full forms, longest key first, ignoring case.

    One pass over the word runs of the text does what a replacement per key
    would, as no full form is itself an abbreviation. Only texts with ``n:`` or
    ``d:`` glued to a letter, where the order of keys shows, go key by key.
    """
    mapping = fv.ABBREVIATIONS if mapping is None else mapping
    if not _runs_can_stand_alone(mapping):
        return _expand_in_turn(c, mapping)
    plain = {_caseless(k): v for k, v in mapping.items() if not k.endswith(":")}
    colon = {_caseless(k[:-1]): v for k, v in mapping.items() if k.endswith(":")}
    full = table(plain, "map<string,string>")

    def mapped(run: Column) -> Column:
        return F.coalesce(F.element_at(full, F.translate(tr_lower(run), "ı", "i")), run)

    runs = F.regexp_extract_all(c, F.lit(r"(?U)(\w+|\W+)"), F.lit(0))
    if not colon:
        return F.array_join(F.transform(runs, mapped), "")
    heads = "|".join(_java_word(k) for k in colon)
    marked = c
    for k, v in colon.items():
        marked = F.regexp_replace(marked, rf"(?iU)\b{_java_word(k)}:(?=\s|\w|$)", v)
    runs = F.regexp_extract_all(marked, F.lit(r"(?U)(\w+|\W+)"), F.lit(0))
    fast = F.array_join(F.transform(runs, mapped), "")
    glued = c.rlike(rf"(?iU)\b({heads}):[^\W\d]")
    return F.when(glued, _expand_in_turn(c, mapping)).otherwise(fast)


def clean_punct(c: Column) -> Column:
    """Punctuation to blanks, white space collapsed, trimmed."""
    return F.trim(squeeze(F.translate(c, "".join(fv.PUNCTUATION), " " * len(fv.PUNCTUATION))))


def tokens(c: Column) -> Column:
    """Split on the separators (and the bar), no empty parts."""
    parts = F.split(c, r"[ |,;/\\\-_]+")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def clean_text(
    c: Column,
    *,
    case: bool = True,
    unicode: bool = True,
    abbreviations: bool = True,
    punctuation: bool = True,
    mapping: dict[str, str] | None = None,
) -> Column:
    """The cleaning steps in order; null and blank text give ''."""
    out = F.trim(squeeze(F.coalesce(c, F.lit(""))))
    if case:
        out = tr_lower(out)
    if unicode:
        out = let(out, tr_unicode)
    if abbreviations:
        out = let(out, lambda x: expand_abbrev(x, mapping))
    if punctuation:
        out = clean_punct(out)
    return out


@lru_cache(maxsize=1)
def _accents() -> tuple[str, str]:
    """Letters with accents and their bare letters, for the whole of Unicode's 16-bit plane."""
    src, dst = [], []
    for cp in range(0xC0, 0x10000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        bare = "".join(x for x in unicodedata.normalize("NFD", ch) if unicodedata.category(x) != "Mn")
        if len(bare) == 1 and bare != ch:
            src.append(ch)
            dst.append(bare)
    return "".join(src), "".join(dst)


def ascii_fold(c: Column) -> Column:
    """Accents off, lowercase, Turkish letters to ASCII, trimmed."""
    src, dst = _accents()
    bare = F.translate(F.regexp_replace(c, r"\p{Mn}", ""), src, dst)
    return strip(F.translate(F.lower(bare), fv.FOLD_FROM, fv.FOLD_TO))


def clean_explanation(c: Column) -> Column:
    return F.coalesce(F.trim(squeeze(c)), F.lit(""))


def rule_clean(c: Column) -> Column:
    """Lowercase, single blanks, runs of , . ; : to one blank."""
    return F.trim(F.regexp_replace(squeeze(F.lower(c)), r"[,\.;:]+", " "))


def legacy_clean(c: Column, fold: bool = False) -> Column:
    out = squeeze(strip(F.coalesce(c, F.lit(""))))
    out = F.regexp_replace(out, r"[/\\.,;:]", " ")
    if fold:
        out = F.translate(out, fv.LEGACY_FOLD_FROM, fv.LEGACY_FOLD_TO)
    return F.trim(out)


def text_features(c: Column) -> list[Column]:
    low = F.lower(c)
    upper = F.length(c) - F.length(F.regexp_replace(c, r"(?U)\p{Lu}", ""))
    return [
        low.contains("mah").cast("double").alias("has_mahalle_keyword"),
        low.contains("sok").cast("double").alias("has_sokak_keyword"),
        low.contains("cad").cast("double").alias("has_cadde_keyword"),
        c.rlike(r"\p{Nd}").cast("double").alias("has_number_pattern"),
        c.rlike(r"(?U)(^|\s)\d{5}(\s|$)").cast("double").alias("has_postal_code"),
        F.size(words(c)).cast("double").alias("word_count"),
        F.length(c).cast("double").alias("char_count"),
        F.when(F.length(c) > 0, upper / F.length(c)).otherwise(0.0).alias("uppercase_ratio"),
    ]


def pattern_features(confidence: Column, city: Column, district: Column, nbh: Column, street: Column) -> list[Column]:
    filled = sum((F.when(blank_to_null(x).isNotNull(), 1).otherwise(0) for x in (city, district, nbh, street)), F.lit(0))
    share = filled / F.lit(4.0)
    conf = F.coalesce(confidence, F.lit(0.0))
    return [
        conf.alias("pattern_confidence"),
        share.alias("pattern_completeness"),
        (conf * share).alias("pattern_consistency"),
    ]


def title(c: Column) -> Column:
    """First letter of each word up, the rest down; keeps a capital dotted İ whole."""
    def word(w: Column) -> Column:
        return F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))

    return F.array_join(F.transform(F.split(c, " "), word), " ")


def any_of(keywords: list[str], word: Column) -> Column:
    return word.isin(keywords)


def hits_of(c: Column, keywords: list[str]) -> Column:
    """How many of the keywords occur in the text."""
    return sum((c.contains(k).cast("int") for k in keywords), F.lit(0))
