"""Landmarks and explanation texts (H), all inside the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t


def strip_suffix(word: Column) -> Column:
    """Root of a word: known words, else up to two rounds of the longest suffix that leaves three letters."""
    known = t.table(fv.SUFFIX_WORDS, "map<string,string>")
    ends = "|".join(sorted(fv.SUFFIXES, key=len, reverse=True))
    once = lambda c: F.regexp_replace(c, f"^(.{{3,}}?)({ends})$", "$1")
    low = F.lower(word)
    return F.when(F.length(word) < 3, word).otherwise(F.coalesce(F.element_at(known, low), once(once(low))))


def parse_landmark(df: DataFrame, col: str = "explanation") -> DataFrame:
    """Add ``relation``, ``landmark`` and ``landmark_confidence``; null where the text does not parse."""
    clean = F.trim(F.regexp_replace(t.squeeze(F.lower(t.strip(F.coalesce(F.col(col), F.lit(""))))), r"(?U)[^\w\s]", " "))
    step = t.once(df, t.words(clean), "__w")
    relations = t.table({w: r for r, ws in fv.RELATION_WORDS.items() for w in ws}, "map<string,string>")
    at = F.get(F.filter(F.transform("__w", lambda w, i: F.when(F.element_at(relations, w).isNotNull(), i)), lambda x: x.isNotNull()), F.lit(0))
    step = t.once(step, at, "__i")
    words = F.transform(F.slice("__w", 1, F.greatest(F.col("__i"), F.lit(0))), strip_suffix)
    good = (F.size("__w") >= 2) & (F.col("__i") > 0)
    step = t.once(step, F.when(good, F.array_join(words, " ")), "landmark")
    return step.withColumns({
        "relation": F.when(good, F.element_at(relations, F.get("__w", F.col("__i")))),
        "landmark_confidence": F.when(good, landmark_confidence(F.col("landmark"))),
    }).drop("__w", "__i")


def landmark_confidence(landmark: Column) -> Column:
    w = t.words(landmark)
    n = F.size(w)
    keyword = F.when(F.arrays_overlap(w, t.table(fv.LANDMARK_WORDS, "array<string>")), 0.25).otherwise(0.0)
    size = F.when(n.between(2, 4), 0.1).when(n < 2, -0.1).when(n > 5, -0.2).otherwise(0.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.7 + keyword + size))


def landmark_regex(text: Column) -> Column:
    """(name, relation, 0.8) of the first phrase found, in phrase order."""
    low = F.lower(text)
    name = lambda w: t.blank_to_null(F.regexp_extract(low, rf"(.+?)\s+{w}", 1))
    return F.coalesce(*[
        F.when(name(w).isNotNull(), F.struct(name(w).alias("name"), F.lit(r).alias("relation"), F.lit(0.8).alias("confidence")))
        for w, r in fv.LANDMARK_PHRASES])


def detect_landmarks(text: Column) -> Column:
    """Array of brand and keyword hits with category and spatial relation."""
    low = F.lower(text)
    rel = F.when(low.contains("yanı"), "yanı").when(low.contains("karşı"), "karşısı").when(low.contains("arkası"), "arkası")
    hit = lambda k, c, n: F.when(low.contains(k), F.struct(F.lit(n).alias("name"), F.lit(c).alias("category"), rel.alias("relation"), F.lit(0.8).alias("confidence")))
    return F.array_compact(F.array(*[hit(*b) for b in fv.BRANDS]))


def explain_result(success: Column, confidence: Column, error: Column, method: Column, lang: str = "tr") -> Column:
    """Success or error sentence, a confidence remark and, in Turkish, the method sentence."""
    w = fv.TEXTS[lang]
    first = F.when(success, w["success"]).otherwise(F.concat(F.lit(w["error"]), F.coalesce(error, F.lit("Bilinmeyen hata"))))
    remark = F.when(success & (confidence < 0.5), w["low"]).when(success & (confidence > 0.9), w["high"])
    return F.concat_ws(" ", first, remark, method_sentence(method) if lang == "tr" else F.lit(None))


def method_sentence(method: Column) -> Column:
    known = t.table(fv.METHOD_TEXTS, "map<string,string>")
    return F.coalesce(F.element_at(known, method), F.concat(F.lit("İşleme yöntemi: "), method))


def confidence_words(c: Column) -> Column:
    level = F.when(c >= 0.9, "çok yüksek").when(c >= 0.8, "yüksek").when(c >= 0.6, "orta").when(c >= 0.4, "düşük").otherwise("çok düşük")
    grade = F.when(c >= 0.9, "mükemmel").when(c >= 0.7, "iyi").when(c >= 0.5, "orta").otherwise("düşük")
    return F.concat(F.lit("Güven skoru: "), F.format_string("%.2f", c), F.lit(" ("), level, F.lit(", "), grade, F.lit(")"))


def explain_components(components: Column, confidence: float = 0.85, lang: str = "tr") -> Column:
    """One sentence per filled component, by name."""
    word = {"tr": "güven", "en": "confidence"}[lang]
    say = lambda e: F.concat(e["key"], F.lit(": "), e["value"], F.lit(f" ({word}: {confidence:.2f})"))
    filled = F.filter(F.array_sort(F.map_entries(components)), lambda e: F.coalesce(e["value"], F.lit("")) != "")
    return F.transform(filled, say)


def location_sentence(get) -> Column:
    """Where the address is, in one sentence."""
    v = lambda n: F.nullif(get(n), F.lit(""))
    street = v("sokak")
    typed = F.lower(street).rlike("caddesi|cd|cad|sokağı|sk|sok|bulvarı|blv|bulvar")
    line = F.concat_ws(
        ", ", F.concat(v("mahalle"), F.lit(" Mahallesi")), F.when(typed, street).otherwise(F.concat(street, F.lit(" Sokağı"))),
        F.concat(F.lit("No: "), v("bina_no")), F.concat(v("ilce"), F.lit(" İlçesi")), F.concat(v("il"), F.lit(" İli")),
        F.concat(v("kat"), F.lit(". Kat")), F.concat(F.lit("Daire: "), v("daire_no")))
    return F.when(line == "", "Belirtilen konumda").otherwise(F.concat(line, F.lit(" konumunda")))
