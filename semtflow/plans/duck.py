"""Fragments of DuckDB SQL shared by the SQL twins."""

from __future__ import annotations

from semtflow.functions import fixed_values as fv
from semtflow.sources.derived import ADDRESS_SQL, DISTRICT_PAIRS, EVENT_SQL, address_sql

WS = r"[\s\x0b\x{85}\p{Z}]"
W = r"[\p{L}\p{N}\p{M}_]"

ADDR = f"addr AS ({ADDRESS_SQL})"
EVENTS = f"ev AS ({EVENT_SQL})"
DISTRICTS = "ddim(city, district) AS (VALUES " + ", ".join(f"('{c}', '{d}')" for c, d in DISTRICT_PAIRS) + ")"
CITIES = "cdim(city) AS (VALUES " + ", ".join(f"('{c}')" for c in fv.PROVINCES) + ")"


def addr(table: str, key: str) -> str:
    return f"addr AS ({address_sql(table, key)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def squeeze(x: str) -> str:
    return f"regexp_replace({x}, '{WS}+', ' ', 'g')"


def tr_lower(x: str) -> str:
    return f"replace(lower({x}), 'i̇', 'i')"


def fold(x: str) -> str:
    return f"trim(translate(lower(strip_accents({x})), '{fv.FOLD_FROM}', '{fv.FOLD_TO}'))"


def strings(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def title(x: str) -> str:
    return f"array_to_string(list_transform(string_split({x}, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ')"


def sql_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{WS}+'), lambda w: w <> '')"
