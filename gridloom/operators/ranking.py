"""Global order without a global window: prefix sums over range-partitioned rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.session import pin


def prefix_sums(df: DataFrame, order: list[Column], weights: dict[str, Column]) -> DataFrame:
    """Adds, per ``{name: weight}``, the sum of the weights of all rows ordered before this one.

    Rows are range-partitioned and sorted, then pinned, because partition totals and rows must
    come from the same partitioning. One total per partition goes through a window of its own.
    """
    ranged = df.withColumns({f"_w_{n}": w for n, w in weights.items()}).repartitionByRange(*order)
    pinned = pin(ranged.sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The upper bits of the id are the partition, the lower ones the row within it.
    placed = pinned.withColumn("_part", F.shiftright("_at", 33))
    totals = placed.groupBy("_part").agg(*[F.sum(f"_w_{n}").alias(f"_t_{n}") for n in weights])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *[F.coalesce(F.sum(f"_t_{n}").over(earlier), F.lit(0)).alias(f"_o_{n}") for n in weights])
    within = Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    running = placed.withColumns({f"_r_{n}": F.coalesce(F.sum(f"_w_{n}").over(within), F.lit(0)) for n in weights})
    # One row per partition: bounded by the number of shuffle partitions.
    joined = running.join(F.broadcast(offsets), "_part")
    return joined.select(*df.columns, *[(F.col(f"_o_{n}") + F.col(f"_r_{n}")).alias(n) for n in weights])


def top_cells(df: DataFrame, value: str, n: int = 5) -> DataFrame:
    """The ``n`` highest cells; equal values in cell order."""
    return df.where(F.col(value).isNotNull()).orderBy(F.desc(value), "iy", "ix").limit(n)


def seeded_sample(df: DataFrame, key: list[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones for the same seed: those of the least hash of the key.

    Counts per leading hash digits (a table of fixed size) tell from which prefix on rows are no longer
    needed; only rows up to it are ordered, by range partitions, and cut at ``n``.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in key], F.lit(str(seed)))
    hashed = df.withColumn("_h", F.md5(text))
    prefix = F.substring("_h", 1, 4)
    counts = hashed.groupBy(prefix.alias("_p")).agg(F.count(F.lit(1)).alias("_c"))
    # At most 65,536 rows, so a window without a partition is bounded.
    before = F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = counts.select("_p", before.alias("_b")).where(F.col("_b") < n).agg(F.max("_p")).scalar()
    near = hashed.where(prefix <= last)
    ranked = prefix_sums(near, [F.col("_h"), *map(F.col, key)], {"_before": F.lit(1).cast("long")})
    return ranked.where(F.col("_before") < n).select(*df.columns)


def evenly_spaced(df: DataFrame, order: str, n: int, by: list[str]) -> DataFrame:
    """``n`` rows per group at evenly spaced positions of the ordered list."""
    ranked = prefix_sums(df, [*map(F.col, by), F.col(order)], {"_before": F.lit(1).cast("long")})
    groups = ranked.groupBy(*by).agg(F.min("_before").alias("base"), (F.count(F.lit(1)) - 1).alias("last"))
    positions = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor(i * F.col("last") / F.lit(max(n - 1, 1)))
    )
    picks = groups.withColumn("_at", F.explode(F.array_distinct(positions)))
    # Global positions are unique, so this join has no heavy key.
    return ranked.join(picks.select((F.col("base") + F.col("_at")).alias("_before")), "_before").select(*df.columns)
