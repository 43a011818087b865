"""Fixed-bin histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid


def density_histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, log10: bool = False) -> DataFrame:
    """Count and density per bin between minimum and maximum; the last bin is closed.

    Rows collapse to ``(group, bin)`` before the shuffle. Bounds come from a first pass, one row per
    group, and are joined (without groups: one scalar); NULL is a group of its own.
    """
    by = by or []
    v = F.col(value)
    shown = df.where(v > 0).select(*by, F.log10(v).alias("v")) if log10 else df.where(v.isNotNull()).select(*by, v.alias("v"))
    bounds = shown.groupBy(*[F.col(k).alias(f"_of_{k}") for k in by]).agg(
        F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).alias("b")
    )
    if by:
        placed = shown.join(bounds, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in by])
    else:
        placed = shown.withColumn("b", bounds.scalar())
    width = (F.col("b.hi") - F.col("b.lo")) / bins
    at = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("b.lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0))
    counted = placed.select(*by, "b", width.alias("w"), at.cast("int").alias("bin")).groupBy(*by, "b", "w", "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
    return counted.select(
        *by,
        "bin",
        (F.col("b.lo") + F.col("bin") * F.col("w")).alias("lower"),
        "n",
        F.when(F.col("w") > 0, F.col("n") / F.col("b.n") / F.col("w")).alias("density"),
    )


def coverage(df: DataFrame, grid: Grid, value: str = "value", granule: str = "time") -> DataFrame:
    """Valid pixels per grid cell, averaged over the granules that have any."""
    # Cells are closed at their lower edge; the outer edge of the last one is closed too.
    def bin_of(c: str, origin: float, size: int):
        scaled = (F.col(c) - (origin - grid.res / 2)) / grid.res
        return F.when((scaled >= 0) & (scaled <= size), F.least(F.floor(scaled), F.lit(size - 1)).cast("int"))

    valid = df.where(F.col(value).isNotNull())
    granules = valid.agg(F.count_distinct(granule)).scalar()
    return (
        valid.select(bin_of("lat", grid.lat_min, grid.ny).alias("iy"), bin_of("lon", grid.lon_min, grid.nx).alias("ix"))
        .where(F.col("iy").isNotNull() & F.col("ix").isNotNull())
        .groupBy("iy", "ix")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("iy", "ix", (F.col("n") / granules).alias("coverage"))
    )
