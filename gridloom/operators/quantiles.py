"""Exact, linearly interpolated quantiles of any number of groups of any size, by radix selection.

Rows collapse to counts of distinct ``(group, value)`` in one shuffle, which all passes read again.
The first pass counts values per bucket of their logarithm; the wanted ranks pick buckets. Each later
pass cuts a picked bucket, from its least to its greatest value, into ``PARTS`` equal parts and picks
again. Nothing is ordered but the buckets of one group, whose number is fixed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Buckets per unit of the natural logarithm, and the place of the logarithm of one: the least positive
# double has -744.4, the greatest 709.8.
FINE, ONE = 64, 48_000
# A bucket is 1.6 % wide at first. Three cuts by 65,535 leave less than the step between two doubles.
PARTS, CUTS = 65_535, 3


def _bucket(v: Column) -> Column:
    """Number that never falls as ``v`` grows; zero, the infinities and NaN have their own."""
    size = F.abs(v)
    of = F.when(size == float("inf"), F.lit(2 * ONE)).otherwise(F.floor(F.ln(size) * FINE) + ONE)
    return F.when(F.isnan(v), F.lit(3 * ONE)).when(v > 0, of).when(v < 0, -of).otherwise(0).cast("int")


def _picked(buckets: DataFrame, within: list[str], order: str, before: Column, ranks) -> DataFrame:
    """Buckets that hold a wanted rank, with the rows before them and the ranks they hold."""
    walk = Window.partitionBy(*within).orderBy(order)
    placed = buckets.withColumn("_before", before + F.sum("_n").over(walk) - F.col("_n"))
    held = F.filter(ranks, lambda r: (r >= F.col("_before")) & (r < F.col("_before") + F.col("_n")))
    return placed.withColumn("_ranks", held).where(F.size("_ranks") > 0)


def exact_quantiles(
    df: DataFrame, value: str, probabilities: dict[str, float], by: list[str] | None = None, totals: bool = False, few_groups: bool = False
) -> DataFrame:
    """One row per group: ``by`` plus one column per named probability. The input is read once.

    NULL is a group of its own; NULL values are left out; values are compared as doubles. ``totals``
    adds ``count, mean, max``. ``few_groups`` says that groups come from a fixed list (always so
    without ``by``); the picked buckets, a few per group, are then broadcast.
    """
    by = by or []
    keys = [f"_g{i}" for i in range(max(len(by), 1))]
    groups = [F.col(b).alias(k) for b, k in zip(by, keys)] or [F.lit(0).alias(keys[0])]
    rows = df.where(F.col(value).isNotNull()).select(*groups, F.col(value).cast("double").alias("_v"))
    counts = rows.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    known = counts.withColumn("_b", _bucket(F.col("_v")))
    small = F.broadcast if few_groups or not by else lambda picks: picks

    def position(prob: float) -> Column:
        return F.round((F.col("_total") - 1) * F.lit(float(prob)), 9)

    def low(prob: float) -> Column:
        return F.floor(position(prob))

    def high(prob: float) -> Column:
        return F.ceil(position(prob))

    measures = [F.sum("_c").alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    whole = Window.partitionBy(*keys)
    first = known.groupBy(*keys, "_b").agg(*measures, F.sum(F.col("_v") * F.col("_c")).alias("_s")).withColumns({
        "_total": F.sum("_n").over(whole), "_sum": F.sum("_s").over(whole), "_max": F.max("_hi").over(whole),
    })
    wanted = F.array_distinct(F.array(*[rank(p) for p in probabilities.values() for rank in (low, high)]))
    carried = ["_total", "_sum", "_max"]
    picks = _picked(first, keys, "_b", F.lit(0), wanted)
    for _ in range(CUTS):
        names = [*keys, "_b", "_lo", "_hi", "_before", "_ranks", *carried]
        side = picks.select(*[F.col(c).alias(f"_of{c}") for c in names])
        same = [F.col(c).eqNullSafe(F.col(f"_of{c}")) for c in (*keys, "_b")]
        inside = known.join(small(side), [*same, F.col("_v").between(F.col("_of_lo"), F.col("_of_hi"))])
        share = (F.col("_v") - F.col("_of_lo")) / (F.col("_of_hi") - F.col("_of_lo"))
        part = F.when(F.col("_of_hi") > F.col("_of_lo"), F.floor(share * PARTS)).otherwise(0).cast("int")
        cut = inside.withColumn("_part", part).groupBy(*keys, "_b", "_of_lo", "_part").agg(
            *measures, F.first("_of_before").alias("_start"), F.first("_of_ranks").alias("_held"), *[F.first(f"_of{c}").alias(c) for c in carried]
        )
        picks = _picked(cut, [*keys, "_b", "_of_lo"], "_part", F.col("_start"), F.col("_held"))

    def at(rank: Column) -> Column:
        return F.max(F.when(F.array_contains("_ranks", rank), F.col("_lo")))

    parts, result = [], []
    if totals:
        parts = [F.first("_total").alias("count"), F.first(F.col("_sum") / F.col("_total")).alias("mean"), F.first("_max").alias("max")]
        result = [F.col(c) for c in ("count", "mean", "max")]
    for name, prob in probabilities.items():
        parts += [at(low(prob)).alias(f"{name}_lo"), at(high(prob)).alias(f"{name}_hi"), F.max(position(prob) - low(prob)).alias(f"{name}_w")]
        lo, hi, w = F.col(f"{name}_lo"), F.col(f"{name}_hi"), F.col(f"{name}_w")
        # Equal neighbours are the value itself, also where it is infinite.
        result.append(F.when(lo == hi, lo).otherwise(lo + (hi - lo) * w).alias(name))
    return picks.groupBy(*keys).agg(*parts).select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *result)


def column_quantiles(df: DataFrame, columns: list[str], probabilities: dict[str, float], key: str = "variable") -> DataFrame:
    """The same for several columns at once: one row per column."""
    entries = [F.struct(F.lit(c).alias(key), F.col(c).cast("double").alias("value")) for c in columns]
    return exact_quantiles(df.select(F.inline(F.array(*entries))), "value", probabilities, [key], few_groups=True)
