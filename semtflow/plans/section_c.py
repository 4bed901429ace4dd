"""Queries of the pattern matching section (C) over derived addresses."""

from __future__ import annotations

from pyspark.sql import functions as F

from semtflow.functions import fixed_values as fv
from semtflow.functions import text as t
from semtflow.operators import patterns as p
from semtflow.operators.thresholds import ema_threshold
from semtflow.plans import duck as d
from semtflow.plans.registry import query
from semtflow.plans.section_b import CLEAN_SQL
from semtflow.plans.section_j import rounded
from semtflow.plans.section_k import EMA, KEV, events
from semtflow.sources.derived import addresses


def cleaned(spark, sf_dir):
    return addresses(spark, sf_dir).select("addr_id", t.clean_text(F.col("address")).alias("text"))


def hits(spark, sf_dir):
    return p.match_patterns(cleaned(spark, sf_dir))


def _sql_text(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _hit_select(x: p.Pattern) -> str:
    """The hits of one pattern: whole match, and its groups beside names, kinds and weights."""
    plain = x.regex.removeprefix("(?iU)")
    got = lambda g: f"regexp_extract(text, {_sql_text('(?i)' + plain)}, {g})"
    values = ", ".join(f"trim({got(s.grp)})" for s in x.slots)
    listed = lambda f: "[" + ", ".join(f(s) for s in x.slots) + "]"
    return (
        f"SELECT addr_id, text, '{x.pattern_id}' AS pattern_id, {x.priority} AS priority, {got(0)} AS matched, [{values}] AS v, "
        f"{listed(lambda s: _sql_text(s.name))} AS names, {listed(lambda s: _sql_text(s.type))} AS kinds, {listed(lambda s: str(s.weight) + '::DOUBLE')} AS w, "
        f"{listed(lambda s: str(s.optional).lower())} AS opt FROM cl WHERE regexp_matches(text, {_sql_text('(?i)' + plain)})"
    )


HITS = f"""{d.ADDR}, cl AS (SELECT addr_id, {CLEAN_SQL} AS text FROM addr),
   hit AS ({' UNION ALL '.join(_hit_select(x) for x in p.patterns())})"""
USED = "used AS (SELECT pattern_id, count(*) AS n FROM hit GROUP BY pattern_id)"
_DIM = "dim(pattern_id, priority, regex, slots, n_slots, n_slot_types) AS (VALUES " + ", ".join(
    f"('{x.pattern_id}', {x.priority}::INT, {_sql_text(x.regex)}, "
    + _sql_text("[" + ",".join(f'{{"name":"{s.name}","optional":{str(s.optional).lower()},"type":"{s.type}","grp":{s.grp},"weight":{s.weight}}}' for s in x.slots) + "]")
    + f", {len(x.slots)}, {len({s.type for s in x.slots})})" for x in p.patterns()) + ")"
# worth of a slot: full for a plain number or a name of up to three words, less for other texts, a loss where a needed one is missing
SLOT_SCORE = """list_sum(list_transform(range(1, len(v) + 1), lambda i: CASE
        WHEN v[i] = '' THEN CASE WHEN opt[i] THEN 0.0 ELSE -0.3 * w[i] END
        WHEN kinds[i] = 'number' AND regexp_full_match(v[i], '[0-9]+') THEN w[i]
        WHEN kinds[i] = 'named' AND len(string_split(v[i], ' ')) <= 3 THEN w[i]
        WHEN kinds[i] = 'text' THEN w[i] * 0.8 ELSE w[i] * 0.9 END)) / list_sum(w)"""


@query("a08_pattern_dim", f"WITH {HITS}, {USED}, {_DIM} SELECT pattern_id, priority, regex, slots, coalesce(n, 0) AS n_hits FROM dim LEFT JOIN used USING (pattern_id)")
def a08(spark, sf_dir):
    used = hits(spark, sf_dir).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("n_hits"))
    dim = p.pattern_dim(spark).select("pattern_id", "priority", "regex", F.to_json("slots").alias("slots"))
    return dim.join(used, "pattern_id", "left").na.fill({"n_hits": 0})


@query("a09_pattern_dim_stats", f"WITH {HITS}, {USED}, {_DIM} SELECT pattern_id, priority, n_slots::BIGINT AS n_slots, n_slot_types::BIGINT AS n_slot_types, coalesce(n, 0) AS n_hits FROM dim LEFT JOIN used USING (pattern_id)")
def a09(spark, sf_dir):
    return p.pattern_dim_stats(p.pattern_dim(spark), hits(spark, sf_dir))


_TRIES = " UNION ALL ".join(
    f"SELECT addr_id, '{x.pattern_id}' AS pattern_id, {x.priority} AS priority, regexp_extract(text, '(?i){x.regex.removeprefix('(?iU)')}') AS matched FROM cl" for x in p.patterns())


@query("c01_match_patterns", f"WITH {d.ADDR}, cl AS (SELECT addr_id, {CLEAN_SQL} AS text FROM addr) SELECT * FROM ({_TRIES}) WHERE matched <> ''")
def c01(spark, sf_dir):
    return hits(spark, sf_dir).select("addr_id", "pattern_id", "priority", "matched")


_SLOTS_JSON = """'{' || array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: v[i] <> ''), lambda i: '"' || names[i] || '":"' || v[i] || '"'), ',') || '}'"""


@query("c02_extract_slots", f"WITH {HITS} SELECT addr_id, pattern_id, {_SLOTS_JSON} AS slots FROM hit")
def c02(spark, sf_dir):
    h = hits(spark, sf_dir)
    return h.select("addr_id", "pattern_id", F.to_json(p.slot_map(F.col("slots"), F.col("values"))).alias("slots"))


# A hit whose matched text SQL can state: everything up to the number word and its number.
PIECE = f"""{d.ADDR}, cl AS (SELECT addr_id, {CLEAN_SQL} AS text FROM addr),
   pc AS (SELECT addr_id, text, regexp_extract(text, '^.*?numara [0-9]+') AS matched FROM cl)"""


def piece(spark, sf_dir):
    return cleaned(spark, sf_dir).withColumn("matched", F.regexp_extract("text", "^.*?numara [0-9]+", 0))


W_TEXT = "list_distinct(string_split(lower(text), ' '))"
W_MATCH = "list_filter(list_distinct(string_split(lower(matched), ' ')), lambda w: w <> '')"
COVER = "length(matched)::DOUBLE / length(text) * 0.9"
OVERLAP = f"len(list_intersect({W_MATCH}, {W_TEXT}))::DOUBLE / len({W_TEXT}) * 0.8"
KEYWORDS = "greatest(0.0, least(1.0, (" + " + ".join(f"contains(lower(text), '{w}')::INT" for w in fv.LOCATION_WORDS) + ")::DOUBLE / 3)) * 0.6"
EDIT = "greatest(0.0, 1.0 - levenshtein(lower(matched), lower(text))::DOUBLE / greatest(length(matched), length(text)))"


@query("c03_coverage_score", f"WITH {PIECE} SELECT addr_id, round({COVER}, 6) AS coverage FROM pc")
def c03(spark, sf_dir):
    return rounded(piece(spark, sf_dir).select("addr_id", p.coverage_score(F.col("matched"), F.col("text")).alias("coverage")))


@query("c04_slot_score", f"WITH {HITS} SELECT addr_id, pattern_id, round({SLOT_SCORE}, 6) AS slot_score FROM hit")
def c04(spark, sf_dir):
    h = hits(spark, sf_dir)
    return rounded(h.select("addr_id", "pattern_id", p.slot_score(F.col("slots"), F.col("values")).alias("slot_score")))


@query("c05_token_overlap", f"WITH {PIECE} SELECT addr_id, round({OVERLAP}, 6) AS overlap FROM pc")
def c05(spark, sf_dir):
    return rounded(piece(spark, sf_dir).select("addr_id", p.token_overlap(F.col("matched"), F.col("text")).alias("overlap")))


@query("c06_keyword_score", f"WITH {PIECE} SELECT addr_id, round({KEYWORDS}, 6) AS keyword_score FROM pc")
def c06(spark, sf_dir):
    return rounded(piece(spark, sf_dir).select("addr_id", p.keyword_score(F.col("text")).alias("keyword_score")))


@query("c07_edit_similarity", f"""WITH {PIECE.replace("levenshtein", "levenshtein")} SELECT addr_id, round({EDIT}, 6) AS similarity
       FROM (SELECT addr_id, strip_accents(replace(text, 'ı', 'i')) AS text, strip_accents(replace(matched, 'ı', 'i')) AS matched FROM pc)""")
def c07(spark, sf_dir):
    pc = piece(spark, sf_dir).select("addr_id", t.ascii_fold(F.col("text")).alias("text"), t.ascii_fold(F.col("matched")).alias("matched"))
    return rounded(pc.select("addr_id", p.edit_similarity(F.col("matched"), F.col("text")).alias("similarity")))


_ASCII = "(SELECT addr_id, strip_accents(replace(text, 'ı', 'i')) AS text, strip_accents(replace(matched, 'ı', 'i')) AS matched FROM pc)"
CONF = f"""cf AS (SELECT addr_id, ({COVER} + (0.9 + 0.8) / 1.7 + {OVERLAP} + {KEYWORDS} + {EDIT}) / 5
      - (length(text) - length(matched))::DOUBLE / length(text) * 0.1 AS c, len(string_split(matched, ' ')) AS k, matched <> '' AS hit FROM {_ASCII}),
   cc AS (SELECT addr_id, greatest(0.0, least(1.0, CASE WHEN k < 2 THEN c * 0.8 ELSE c END)) AS confidence FROM cf WHERE hit)"""


def pieced(spark, sf_dir):
    """Hits as a candidate table with two filled slots, over folded text."""
    pc = piece(spark, sf_dir).select("addr_id", t.ascii_fold(F.col("text")).alias("text"), t.ascii_fold(F.col("matched")).alias("matched"))
    slots = F.array(*[
        F.struct(F.lit(n).alias("name"), F.lit(False).alias("optional"), F.lit(k).alias("type"), F.lit(w).alias("weight"))
        for n, k, w in (("Mahalle", "named", 0.9), ("n", "number", 0.8))
    ])
    return pc.filter(F.col("matched") != "").withColumns({"slots": slots, "values": F.array(F.lit("moda"), F.lit("12"))})


@query("c08_match_confidence", f"WITH {PIECE}, {CONF} SELECT addr_id, round(confidence, 6) AS confidence FROM cc")
def c08(spark, sf_dir):
    return rounded(p.score_candidates(pieced(spark, sf_dir)).select("addr_id", "confidence"))


CANDIDATES = f"""{KEV}, {EMA}, cand AS (SELECT e.event_id % 2000 AS addr_id, e.pattern_id, max(e.confidence) AS confidence,
     max(e.user_id % 7)::INT AS priority FROM kev e GROUP BY 1, 2)"""


def candidates(spark, sf_dir):
    """A scored candidate table from the events table: up to 5 patterns per key."""
    ev = events(spark, sf_dir)
    return ev.groupBy((F.col("event_id") % 2000).alias("addr_id"), "pattern_id").agg(
        F.max("confidence").alias("confidence"), F.max(F.col("user_id") % 7).cast("int").alias("priority"))


@query(
    "c09_threshold_filter",
    f"""WITH {CANDIDATES}, t2 AS (SELECT * FROM th WHERE pattern_id NOT LIKE 'view%')
        SELECT addr_id, pattern_id, confidence, priority, round(coalesce(t, 0.4), 6)::DOUBLE AS threshold
        FROM cand LEFT JOIN t2 USING (pattern_id) WHERE confidence >= coalesce(t, 0.4)""",
)
def c09(spark, sf_dir):
    th = ema_threshold(events(spark, sf_dir)).filter(~F.col("pattern_id").startswith("view"))
    return rounded(p.threshold_filter(candidates(spark, sf_dir), th))


@query(
    "c10_top_matches",
    f"""WITH {CANDIDATES}, u AS (SELECT addr_id, pattern_id, confidence, priority * 1000 + row_number() OVER (PARTITION BY addr_id ORDER BY pattern_id) AS priority FROM cand),
        r AS (SELECT *, row_number() OVER (PARTITION BY addr_id ORDER BY confidence DESC, priority DESC) AS rank FROM u)
        SELECT addr_id, pattern_id, confidence, priority, rank FROM r WHERE rank <= 3""",
)
def c10(spark, sf_dir):
    return p.top_matches(_unique_priority(candidates(spark, sf_dir)), k=3).withColumn("rank", F.col("rank").cast("long"))


def _unique_priority(c):
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("addr_id").orderBy("pattern_id"))
    return c.withColumn("priority", (F.col("priority") * 1000 + n).cast("long"))


@query(
    "c11_best_match",
    f"""WITH {CANDIDATES}, u AS (SELECT addr_id, pattern_id, confidence, priority * 1000 + row_number() OVER (PARTITION BY addr_id ORDER BY pattern_id) AS priority FROM cand),
        r AS (SELECT *, row_number() OVER (PARTITION BY addr_id ORDER BY confidence DESC, priority DESC) AS rank FROM u)
        SELECT addr_id, pattern_id, confidence FROM r WHERE rank = 1""",
)
def c11(spark, sf_dir):
    return p.best_match(_unique_priority(candidates(spark, sf_dir)))


# edit distance counts bytes in SQL, so letters beyond ASCII stand as capitals, which cleaned text has none of
_BYTES = "translate({}, 'çğıöşüâîû', 'CGIOSUAEV')"
BEST = f"""{HITS}, sc AS (SELECT *, ({COVER} + {SLOT_SCORE} + {OVERLAP} + {KEYWORDS}
        + greatest(0.0, 1.0 - levenshtein({_BYTES.format('matched')}, {_BYTES.format('text')})::DOUBLE / greatest(length(matched), length(text)))) / 5
        - (length(text) - length(matched))::DOUBLE / length(text) * 0.1 AS c FROM hit),
   cf AS (SELECT *, greatest(0.0, least(1.0, CASE WHEN len(list_filter(string_split(matched, ' '), lambda x: x <> '')) < 2 THEN c * 0.8 ELSE c END)) AS confidence FROM sc),
   best AS (SELECT *, row_number() OVER (PARTITION BY addr_id ORDER BY confidence DESC, priority DESC) AS k FROM cf WHERE confidence >= 0.4)"""


@query("c11_best_match_in_row", f"WITH {BEST} SELECT cl.addr_id, pattern_id, round(confidence, 6) AS confidence, matched FROM cl LEFT JOIN (SELECT * FROM best WHERE k = 1) b USING (addr_id)")
def c11_row(spark, sf_dir):
    best = p.with_best_match(cleaned(spark, sf_dir))
    return rounded(best.select("addr_id", "best.pattern_id", "best.confidence", "best.matched"))


def _field_sql(field: str) -> str:
    """The first filled slot that feeds the field, in the order of the slot table."""
    feeding = [n for n, f in fv.SLOT_FIELDS.items() if f == field]
    value = "coalesce(" + ", ".join(f"nullif(v[list_position(names, {_sql_text(n)})], '')" for n in feeding) + ", NULL)"
    return f"'\"{field}\":\"' || {value} || '\"'"


_FIELDS_JSON = "'{' || concat_ws(',', " + ", ".join(_field_sql(f) for f in fv.FIELDS if f in fv.SLOT_FIELDS.values()) + ") || '}'"


@query("c12_slots_to_fields", f"WITH {BEST} SELECT addr_id, {_FIELDS_JSON} AS fields FROM best WHERE k = 1")
def c12(spark, sf_dir):
    best = p.with_best_match(cleaned(spark, sf_dir)).filter(F.col("best").isNotNull())
    return best.select("addr_id", F.to_json(p.slots_to_fields(F.col("best.slots"))).alias("fields"))


FIELDS_SQL = """fl AS (SELECT addr_id, nbh AS neighborhood, CASE WHEN addr_id % 4 <> 1 THEN street END AS street, NULL AS building,
     CASE WHEN addr_id % 13 = 0 THEN 'A' END AS block, CASE WHEN addr_id % 6 = 0 THEN 'No 4' WHEN addr_id % 6 < 5 THEN number END AS number,
     CASE WHEN addr_id % 4 = 0 THEN '3' END AS floor, CASE WHEN addr_id % 4 = 0 THEN '5' END AS apartment,
     CASE WHEN addr_id % 3 > 0 THEN district END AS district, city, postcode_in AS postcode FROM addr WHERE addr_id % 17 <> 0
   UNION ALL SELECT addr_id, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM addr WHERE addr_id % 17 = 0)"""


def fields(spark, sf_dir):
    """Address fields with gaps, some rows with none."""
    k = F.col("addr_id")
    none = k % 17 == 0
    col = lambda c: F.when(~none, c)
    return addresses(spark, sf_dir).select(
        "addr_id", col(F.col("nbh")).alias("neighborhood"), col(F.when(k % 4 != 1, F.col("street"))).alias("street"),
        F.lit(None).cast("string").alias("building"), col(F.when(k % 13 == 0, "A")).alias("block"),
        col(F.when(k % 6 == 0, "No 4").when(k % 6 < 5, F.col("number"))).alias("number"), F.lit(None).cast("string").alias("entrance"),
        col(F.when(k % 4 == 0, "3")).alias("floor"), col(F.when(k % 4 == 0, "5")).alias("apartment"),
        col(F.when(k % 3 > 0, F.col("district"))).alias("district"), col(F.col("city")).alias("city"), col(F.col("postcode_in")).alias("postcode"),
    )


@query(
    "c13_normalized_string",
    f"""WITH {d.ADDR}, {FIELDS_SQL} SELECT addr_id, coalesce(nullif(concat_ws(', ',
          CASE WHEN contains(lower(neighborhood), 'mah') THEN neighborhood ELSE neighborhood || ' Mahallesi' END, street, building, block,
          CASE WHEN starts_with(lower(number), 'no') THEN number ELSE 'No: ' || number END, 'Kat: ' || floor, 'Daire: ' || apartment,
          district, city, postcode), ''), 'Adres bilgisi eksik') AS line FROM fl""",
)
def c13(spark, sf_dir):
    return fields(spark, sf_dir).select("addr_id", p.normalized_string(F.col).alias("line"))
