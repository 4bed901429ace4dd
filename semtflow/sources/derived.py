"""Address and metric-event tables that Spark derives from the given tables.

The given tables hold no Turkish addresses, so keys pick the parts by modulo.
``ADDRESS_SQL`` and ``EVENT_SQL`` state the same derivation for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semtflow.session import spread

PLACES = [
    ("İstanbul", "Kadıköy"), ("Ankara", "Çankaya"), ("İzmir", "Konak"), ("Bursa", "Nilüfer"),
    ("Muğla", "Bodrum"), ("Eskişehir", "Odunpazarı"), ("Antalya", "Kaş"), ("Trabzon", "Ortahisar"),
]
NEIGHBORHOODS = ["Atatürk", "Moda", "Güneş", "Yeni"]
STREETS = ["Bahariye", "Cumhuriyet", "İnönü", "1410.", "Şair Eşref"]
LANDMARKS = [
    "Amorium Hotel karşısı", "Migros yanı", "Şükrü Saraçoğlu Stadı arkası", "okulun karşısında",
    "Koçtaş Avm üstü", "eski postane binasının hemen yan tarafı", "karşısı", "belirsiz tarif",
]

# district dimension of the derived addresses: (city, district) folded
DISTRICT_PAIRS = [
    ("istanbul", "kadikoy"), ("istanbul", "besiktas"), ("istanbul", "uskudar"), ("istanbul", "bayrampasa"),
    ("ankara", "cankaya"), ("ankara", "kecioren"), ("ankara", "golbasi"),
    ("izmir", "konak"), ("izmir", "bornova"), ("izmir", "buca"),
    ("bursa", "nilufer"), ("bursa", "osmangazi"), ("bursa", "yenisehir"),
    ("mugla", "bodrum"), ("mugla", "ortaca"), ("eskisehir", "odunpazari"), ("eskisehir", "tepebasi"),
    ("antalya", "kas"), ("antalya", "kepez"), ("trabzon", "ortahisar"), ("trabzon", "of"),
    ("adiyaman", "golbasi"), ("mersin", "yenisehir"), ("diyarbakir", "yenisehir"),
]


def _case(expr: str, values: list[str]) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"CASE {expr} {arms} END"


def address_columns(k: str) -> list[str]:
    """Portable SQL for the derived address columns over key ``k``."""
    city = _case(f"{k} % {len(PLACES)}", [c for c, _ in PLACES])
    district = _case(f"{k} % {len(PLACES)}", [d for _, d in PLACES])
    nbh = _case(f"{k} % {len(NEIGHBORHOODS)}", NEIGHBORHOODS)
    street = _case(f"{k} % {len(STREETS)}", STREETS)
    district_in = f"CASE WHEN {k} % 11 = 0 THEN 'Bornova' ELSE {district} END"
    city_in = (
        f"CASE WHEN {k} % 7 = 0 THEN substr({city}, 1, length({city}) - 1) "
        f"WHEN {k} % 29 = 0 THEN 'Zzyzx' ELSE {city} END"
    )
    postcode = f"CASE WHEN {k} % 5 = 0 THEN '06' || CAST(100 + {k} % 900 AS VARCHAR(20)) END"
    address = (
        f"{nbh} || CASE WHEN {k} % 3 = 0 THEN ' Mah. ' ELSE ' Mahallesi ' END || {street}"
        f" || CASE WHEN {k} % 2 = 0 THEN ' Cad. ' ELSE ' Sokak ' END"
        f" || CASE WHEN {k} % 13 = 0 THEN 'A Blok ' ELSE '' END"
        f" || 'No:' || CAST({k} % 200 + 1 AS VARCHAR(20))"
        f" || CASE WHEN {k} % 4 = 0 THEN ' Kat 3 Daire 5 ' WHEN {k} % 9 = 0 THEN ' D:7 ' ELSE ' ' END"
        f" || {district_in} || '/' || {city_in} || COALESCE(' ' || {postcode}, '')"
    )
    return [
        f"{k} AS addr_id",
        f"{address} AS address",
        f"{city_in} AS city_in",
        f"{district_in} AS district_in",
        f"{postcode} AS postcode_in",
        f"{city} AS city",
        f"{district} AS district",
        f"{nbh} AS nbh",
        f"{street} AS street",
        f"CAST({k} % 200 + 1 AS VARCHAR(20)) AS number",
        f"{_case(f'{k} % {len(LANDMARKS)}', LANDMARKS)} AS explanation",
    ]


def address_sql(table: str = "customer", key: str = "c_custkey") -> str:
    return f"SELECT {', '.join(address_columns(key))} FROM {table}"


ADDRESS_SQL = address_sql()


def addresses(spark: SparkSession, sf_dir: str, table: str = "customer", key: str = "c_custkey") -> DataFrame:
    """addr_id, address, the parts as written (``*_in``) and the true parts.

    Only the key is read. A file of a few MB holds a million keys in a split or two, so the keys
    are spread over the cores before anything is done to an address.
    """
    keys = spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} AS __k")
    return spread(keys, "__k").selectExpr(*address_columns("__k"))


EVENT_COLUMNS = [
    "event_id",
    "ts",
    "user_id",
    "event_type AS pattern_id",
    "CASE user_id % 4 WHEN 0 THEN 'pattern_primary' WHEN 1 THEN 'ml_primary'"
    " WHEN 2 THEN 'hybrid' ELSE 'fallback' END AS method",
    "k >= 20 AS success",
    "k / 100.0E0 AS confidence",
    "value AS processing_time_ms",
    "CASE WHEN k < 20 THEN 'E' || CAST(user_id % 3 AS VARCHAR(20)) END AS error_type",
    "CASE WHEN user_id % 10 = 0 THEN 'threshold' ELSE 'performance' END AS metric_type",
    "user_id % 2 = 0 AS geo_validated",
    "0.4E0 + (event_id % 5) / 20.0E0 AS threshold_used",
]

EVENT_SQL = (
    f"SELECT {', '.join(EVENT_COLUMNS)} FROM "
    "(SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events)"
)


def metric_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table read as match events."""
    raw = spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "*", "CAST(get_json_object(props, '$.k') AS INT) AS k"
    )
    return raw.selectExpr(*EVENT_COLUMNS).withColumn("ts", F.col("ts").cast("timestamp"))
