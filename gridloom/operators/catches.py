"""Catch statistics: spelling variants, sectors, places, cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import geo, names

PERIOD = ["species", "year", "quarter"]


def plain_name(geo_raw: Column) -> Column:
    return F.ltrim(geo_raw, F.lit("."))


def unify_variants(df: DataFrame, prefix: str = config.VARIANT_PREFIX, by: list[str] | None = None) -> DataFrame:
    """Spellings of one place that starts with ``prefix`` become one row: the largest volume.

    Other rows, those without a name too, pass through as they are; only the variants are grouped,
    file by file where the rows name their file.
    """
    by = ([c for c in ("file",) if c in df.columns] + PERIOD) if by is None else by
    variant = F.coalesce(F.startswith(plain_name(F.col("geo_raw")), F.lit(prefix)), F.lit(False))
    merged = (
        df.where(variant).groupBy(*by).agg(F.min("geo_raw").alias("geo_raw"), F.max("volume_mt").alias("volume_mt"))
    )
    columns = ["geo_raw", *by, "volume_mt"]
    return df.where(~variant).select(*columns).unionByName(merged.select(*columns))


def roll_up_species(df: DataFrame, aliases: dict[str, str] = config.PROVINCE_ALIASES, by: list[str] | None = None) -> DataFrame:
    """Clean place names; rows of one species code add up; groups without any number vanish."""
    by = PERIOD if by is None else by
    name = plain_name(F.col("geo_raw"))
    for raw, clean in aliases.items():
        name = F.when(name == raw, F.lit(clean)).otherwise(name)
    return (
        df.select(name.alias("geo"), *by, "volume_mt")
        .groupBy("geo", *by)
        .agg(F.sum("volume_mt").alias("volume_mt"))
        .where(F.col("volume_mt").isNotNull())
    )


def sector_totals(df: DataFrame) -> DataFrame:
    """Largest figure over overlapping files of a sector, then the sum over sectors."""
    sector = names.sector_of_file(F.col("file"), config.SECTOR_CODES, config.OTHER_SECTOR)
    keys = ["geo", *PERIOD]
    best = df.withColumn("sector", sector).groupBy("sector", *keys).agg(F.max("volume_mt").alias("volume_mt"))
    return best.groupBy(*keys).agg(F.sum("volume_mt").alias("volume_mt")).where(F.col("volume_mt").isNotNull())


def locate(df: DataFrame, areas: DataFrame, centroids: DataFrame) -> DataFrame:
    """Adds management area and centroid; places missing from either list are dropped.

    ``areas(geo, fma)`` and ``centroids(geo, lat, lon)`` list places once. They are joined with
    each other first, so the large side meets one small table.
    """
    return df.join(areas.select("geo", "fma").join(centroids.select("geo", "lat", "lon"), "geo"), "geo")


def unmapped(df: DataFrame, areas: DataFrame, centroids: DataFrame) -> DataFrame:
    """Places that ``locate`` drops, with their row counts."""
    known = areas.select("geo").join(centroids.select("geo"), "geo")
    return df.groupBy("geo").agg(F.count(F.lit(1)).alias("rows")).join(known, "geo", "left_anti")


def to_cells(located: DataFrame, digits: int = 1) -> DataFrame:
    """Volumes per snapped cell and quarter; the cell takes the area of its largest contributor,
    the lowest number on a tie."""
    keys = [*PERIOD, "lat", "lon"]
    snapped = located.withColumns({"lat": geo.snap(F.col("lat"), digits), "lon": geo.snap(F.col("lon"), digits)})
    summed = snapped.groupBy(*keys).agg(
        F.sum("volume_mt").alias("volume_mt"),
        F.max_by("fma", F.struct("volume_mt", -F.col("fma"))).alias("fma"),
    )
    return summed.select(*config.CATCH_COLUMNS)


def catch_summary(catches: DataFrame) -> DataFrame:
    return catches.groupBy("species").agg(
        F.count("volume_mt").alias("rows"),
        F.sum("volume_mt").alias("volume_mt"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )


def msy_proxy(catches: DataFrame, species: str) -> DataFrame:
    """Highest volume on record of a species, 0 without any (one row)."""
    return catches.where(F.col("species") == species).agg(F.coalesce(F.max("volume_mt"), F.lit(0.0)).alias("msy"))


def report_scaffold(spark, years: DataFrame, areas: int = len(config.REGIONS), species: list[str] | None = None) -> DataFrame:
    """One row per expected report: area x trainable species x year x quarter."""
    species = species or config.trainable_species()
    codes = F.array(*[F.lit(s) for s in species])
    return (
        years.select(F.explode(F.sequence(F.lit(1), F.lit(areas))).alias("fma"), "year")
        .withColumn("species", F.explode(codes))
        .withColumn("quarter", F.explode(F.sequence(F.lit(1), F.lit(4))))
        .select("fma", "species", "year", "quarter")
    )


def missing_reports(catches: DataFrame, species: list[str] | None = None) -> DataFrame:
    """Expected reports of the years on record that never arrived."""
    years = catches.select("year").distinct()
    keys = ["fma", "species", "year", "quarter"]
    expected = report_scaffold(catches.sparkSession, years, species=species)
    return expected.join(catches.select(*keys).distinct(), keys, "left_anti")
