"""Order statistics and last-n picks that never put one hot key into one task.

A plain window over a key sorts all rows of that key in one task. The helpers
here reach the same answers from small histograms (``located``), salted
two-step picks (``last_n``) or range partitions with offsets (``numbered``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from semtflow.session import checkpointed

_SALTS = 64


def hinted(df: DataFrame, rows: int = 1 << 17) -> DataFrame:
    """A broadcast hint for a written table of few rows; a longer one is left to a shuffle join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def last_n(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int, rn: str = "rn") -> DataFrame:
    """The ``n`` latest rows per key with ``rn`` = 1 for the latest.

    Rows first compete within (key, salt), so a key that holds a third of the
    table is spread over many tasks; at most ``n * salts`` rows per key remain
    for the second step.
    """
    newest = [F.col(c).desc() for c in order]
    if not keys:
        top = df.orderBy(*newest).limit(n)
        return top.withColumn(rn, F.row_number().over(Window.orderBy(*newest)))
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(_SALTS)))
    first = Window.partitionBy(*keys, "__salt").orderBy(*newest)
    then = Window.partitionBy(*keys).orderBy(*newest)
    return (
        salted.withColumn("__r", F.row_number().over(first))
        .filter(F.col("__r") <= n)
        .drop("__r", "__salt")
        .withColumn(rn, F.row_number().over(then))
        .filter(F.col(rn) <= n)
    )


def located(
    df: DataFrame,
    keys: Sequence[str],
    levels: Sequence[tuple[str, Column]],
    picks: dict[str, Callable[[Column], Column]],
) -> DataFrame:
    """Find the rows standing at given 0-based positions of each key's order.

    ``levels`` refine the order from coarse to exact. Every level counts rows
    per bucket (partial aggregation keeps the shuffle small), finds the bucket
    that holds the wanted position and looks only inside it on the next level.
    ``picks`` maps a label to the wanted position as a function of the row
    count. Returns keys, ``pick`` and one column per level.
    """
    keys = list(keys)
    base = df.select(*keys, *[c.alias(n) for n, c in levels])
    if not keys:
        keys = ["__all"]
        base = base.withColumn("__all", F.lit(1))
    cnt = F.count(F.lit(1)).alias("__cnt")
    hist = base.groupBy(*keys, levels[0][0]).agg(cnt)
    hist = hist.withColumn("__n", F.sum("__cnt").over(Window.partitionBy(*keys)))
    wanted = [F.struct(F.lit(k).alias("pick"), fn(F.col("__n")).cast("long").alias("__pos")) for k, fn in picks.items()]
    found: list[str] = []
    cur = None
    for name, _ in levels:
        group = [*keys, *found]
        if cur is not None:
            group.append("pick")
            hist = base.join(cur, [*keys, *found]).groupBy(*group, "__pos", name).agg(cnt)
        upto = Window.partitionBy(*group).orderBy(name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        hist = hist.withColumn("__upto", F.sum("__cnt").over(upto))
        if cur is None:
            hist = hist.withColumn("__w", F.explode(F.array(*wanted))).select(*hist.columns, "__w.pick", "__w.__pos")
        before = F.col("__upto") - F.col("__cnt")
        cur = hist.filter((before <= F.col("__pos")) & (F.col("__pos") < F.col("__upto"))).select(
            *keys, "pick", *found, name, (F.col("__pos") - before).alias("__pos")
        )
        found.append(name)
    return cur.drop("__pos", "__all")


def time_levels(ts: str, row_id: str) -> list[tuple[str, Column]]:
    """Levels for the total order (timestamp, id): about 71 min, 4 ms, then exact."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return [
        ("__t0", F.shiftright(us, 32)),
        ("__t1", F.shiftright(us, 12)),
        ("__t2", F.struct(us.alias("us"), F.shiftright(F.col(row_id), 20).alias("hi"))),
        ("__t3", F.col(row_id)),
    ]


def value_levels(value: str) -> list[tuple[str, Column]]:
    """Levels for the order of a double: two logarithmic grids, then exact."""
    grid = F.asinh(F.col(value))
    return [
        ("__v0", F.floor(grid * 64)),
        ("__v1", F.floor(grid * 4194304)),
        ("__v2", F.col(value)),
    ]


def halves(df: DataFrame, keys: Sequence[str], ts: str, row_id: str) -> DataFrame:
    """Add ``half`` (1 or 2) and ``n``: first n // 2 rows of the key's time order are half 1."""
    keys = list(keys)
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    cut = located(df, keys, time_levels(ts, row_id), {"mid": lambda n: F.floor(n / 2)})
    cut = cut.select(*keys, F.col("__t2.us").alias("__cut_us"), F.col("__t3").alias("__cut_id"))
    if keys:
        joined = df.join(cut, keys)
    else:
        joined = df.withColumn("__one", F.lit(1)).join(cut.withColumn("__one", F.lit(1)), "__one").drop("__one")
    second = (us > F.col("__cut_us")) | ((us == F.col("__cut_us")) & (F.col(row_id) >= F.col("__cut_id")))
    return joined.withColumn("half", F.when(second, 2).otherwise(1)).drop("__cut_us", "__cut_id")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles per key, one column per entry of ``shares``."""
    keys = list(keys)
    picks: dict[str, Callable[[Column], Column]] = {}
    for name, p in shares.items():
        picks[name + "__lo"] = lambda n, p=p: F.floor((n - 1) * F.lit(p))
        picks[name + "__hi"] = lambda n, p=p: F.ceil((n - 1) * F.lit(p))
    at = located(df.filter(F.col(value).isNotNull()), keys, value_levels(value), picks)
    wide = at.groupBy(*keys).agg(
        *[F.max(F.when(F.col("pick") == k, F.col("__v2"))).alias(k) for k in picks]
    )
    n = df.filter(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    if keys:
        joined = wide.join(n, keys)
    else:
        joined = wide.withColumn("__one", F.lit(1)).join(n.withColumn("__one", F.lit(1)), "__one")
    out = []
    for name, p in shares.items():
        rank = (F.col("__n") - 1) * F.lit(p)
        lo, hi = F.col(name + "__lo"), F.col(name + "__hi")
        out.append((lo + (hi - lo) * (rank - F.floor(rank))).alias(name))
    return joined.select(*keys, *out)


def numbered(df: DataFrame, order: Sequence[str], name: str = "rn") -> DataFrame:
    """1-based position of every row in the global order.

    Range partitions (the sampler sees all order columns, so ties do not pile
    up) are written once to the checkpoint folder; the per-partition counts
    give each partition its offset.
    """
    parts = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("__p", F.spark_partition_id())
        .withColumn("__m", F.monotonically_increasing_id())
    )
    parts = checkpointed(parts)
    sizes = parts.groupBy("__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__m0"))
    ahead = Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = sizes.select("__p", "__m0", (F.sum("__c").over(ahead) - F.col("__c")).alias("__off"))
    return (
        parts.join(F.broadcast(offsets), "__p")  # one row per range partition
        .withColumn(name, F.col("__off") + F.col("__m") - F.col("__m0") + 1)
        .drop("__p", "__m", "__m0", "__off")
    )


def positions(df: DataFrame, keys: Sequence[str], order: Sequence[str], pos: str = "pos", n: str = "n") -> DataFrame:
    """1-based position of every row in its key's order, and the key's row count.

    Rows are dealt by ranges of (key, order), so a key of any size is spread over as many tasks
    as it needs; counts per range and key give the offsets. Nothing but counts meets per key.
    """
    keys = list(keys)
    parts = (
        df.repartitionByRange(*keys, *order)
        .sortWithinPartitions(*keys, *order)
        .withColumn("__p", F.spark_partition_id())
        .withColumn("__m", F.monotonically_increasing_id())
    )
    parts = checkpointed(parts)
    sizes = parts.groupBy(*keys, "__p").agg(F.count(F.lit(1)).alias("__c"), F.min("__m").alias("__m0"))
    of = Window.partitionBy(*keys)
    ahead = of.orderBy("__p").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    shift = F.sum("__c").over(ahead) - F.col("__c") - F.col("__m0") + 1
    sizes = sizes.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__p").alias("__p1"), shift.alias("__off"), F.sum("__c").over(of).alias(n))
    same = F.col("__p") == F.col("__p1")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    sizes = checkpointed(sizes)  # a row per key and one more per range partition
    return parts.join(hinted(sizes), same).withColumn(pos, F.col("__m") + F.col("__off")).drop("__p", "__p1", "__m", "__off", *[f"__k_{k}" for k in keys])


def running_ema(values: Column, alpha: float, seed: Column | None = None) -> Column:
    """Fold an ordered array into its exponential mean (seeded by the first value unless given)."""
    start = F.element_at(values, 1) if seed is None else seed
    rest = F.slice(values, 2, F.greatest(F.size(values) - 1, F.lit(0))) if seed is None else values
    return F.aggregate(rest, start.cast("double"), lambda acc, x: acc * (1 - alpha) + x * alpha)
