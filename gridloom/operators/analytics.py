"""Regional reports over scored cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import geo, scores
from gridloom.operators.quantiles import column_quantiles, exact_quantiles


def with_region(df: DataFrame, regions=config.REGIONS, out: str = "region") -> DataFrame:
    """First matching region per row, NULL outside all of them."""
    return df.withColumn(out, geo.first_region(F.col("lat"), F.col("lon"), regions))


def by_every_region(df: DataFrame, regions=config.REGIONS, out: str = "region") -> DataFrame:
    """One copy of a row per region that contains it; regions overlap."""
    return df.withColumn(out, F.explode(geo.all_regions(F.col("lat"), F.col("lon"), regions)))


def region_ranking(scored: DataFrame, value: str = "value", regions=config.REGIONS) -> DataFrame:
    """Cells, mean, 90th percentile and maximum per region, best mean first."""
    rows = with_region(scored.where(F.col(value).isNotNull()), regions).where(F.col("region").isNotNull())
    table = exact_quantiles(rows, value, {"p90": 0.9}, ["region"], totals=True, few_groups=True)
    ordered = table.select("region", F.col("count").alias("cells"), "mean", "p90", "max")
    return ordered.orderBy(F.desc("mean"), "region")


def condition_trend(scored: DataFrame, value: str, region: config.Region | None = None) -> DataFrame:
    """Mean per composite inside one box, or everywhere. Composites without a value stay as NULL."""
    inside = scored if region is None else scored.where(geo.in_box(F.col("lat"), F.col("lon"), geo.region_box(region)))
    return inside.groupBy("time").agg(F.avg(value).alias(value)).orderBy("time")


def region_trends(scored: DataFrame, value: str, regions=config.REGIONS) -> DataFrame:
    """The trend of all regions in one pass."""
    return by_every_region(scored, regions).groupBy("region", "time").agg(F.avg(value).alias(value))


def sustainability(scored: DataFrame, value: str, regions=config.REGIONS) -> DataFrame:
    """Latest regional mean against the highest on record.

    ``current`` belongs to the last composite of the record, observed or not; ``max_by`` keeps a
    NULL there, so a region without a current value reads ``n/a``.
    """
    series = region_trends(scored, value, regions)
    table = series.groupBy("region").agg(F.max_by(value, "time").alias("current"), F.max(value).alias("baseline"))
    ratio = F.when(F.col("baseline") > 0, F.col("current") / F.col("baseline"))
    return table.where(F.col("baseline").isNotNull()).withColumn("ratio", ratio).withColumn(
        "flag", scores.sustainability_flag(F.col("ratio"))
    )


def flag_counts(table: DataFrame) -> DataFrame:
    return table.groupBy("flag").agg(F.count(F.lit(1)).alias("regions"))


def field_summary(scored: DataFrame, value: str = "value") -> DataFrame:
    """Mean, 90th percentile and maximum of a field; 0 for an empty one."""
    table = exact_quantiles(scored, value, {"p90": 0.9}, totals=True)
    # An ungrouped maximum always yields a row, so an empty field reads as zeros.
    one = table.agg(*[F.max(c).alias(c) for c in ("mean", "p90", "max")])
    return one.select(*[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("mean", "p90", "max")])


def value_ranges(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98) -> DataFrame:
    """Colour range per variable; minimum and maximum when the percentiles coincide."""
    q = column_quantiles(df, columns, {"lo": low, "hi": high, "min": 0.0, "max": 1.0})
    usable = F.col("hi") > F.col("lo")
    return q.select(
        "variable", F.when(usable, F.col("lo")).otherwise(F.col("min")).alias("lo"),
        F.when(usable, F.col("hi")).otherwise(F.col("max")).alias("hi"),
    )


def display_scale(df: DataFrame, value: str = "value") -> DataFrame:
    """Adds ``norm`` (position on the log colour scale) and ``radius`` (marker size)."""
    span = value_ranges(df, [value]).agg(F.first(F.struct("lo", "hi"))).scalar()
    return df.where(F.col(value).isNotNull()).withColumn(
        "norm", scores.display_norm(F.col(value), span["lo"], span["hi"])
    ).withColumn("radius", scores.marker_radius(F.col("norm")))


def null_fractions(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Share of missing values per column."""
    shares = [F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]
    return df.groupBy(*(by or [])).agg(*shares)


def null_fraction_spread(df: DataFrame, columns: list[str], granule: str = "time") -> DataFrame:
    """Mean and population deviation over granules of the share of missing pixels."""
    per_granule = null_fractions(df, columns, [granule]).unpivot([granule], columns, "variable", "share")
    return per_granule.groupBy("variable").agg(
        F.avg("share").alias("mean_share"), F.stddev_pop("share").alias("std_share")
    )


def rows_per_year(df: DataFrame, time: str = "time") -> DataFrame:
    return df.groupBy(F.year(time).alias("year")).agg(F.count(F.lit(1)).alias("rows"))


def cells_recovered(filled: DataFrame, by: list[str]) -> DataFrame:
    """Pixels that gap filling added, per group."""
    return filled.groupBy(*by).agg(
        F.sum((~F.col("filled")).cast("long")).alias("valid_before"), F.count(F.lit(1)).alias("valid_after"),
        F.sum(F.col("filled").cast("long")).alias("recovered"),
    )
