"""Granule catalogue and download manifest as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridloom import config
from gridloom.functions import names

GRANULE_KEY = ["short_name", "granule_name"]
MANIFEST_SCHEMA = (
    "short_name string, granule_name string, start_time timestamp, end_time timestamp, "
    "cloud_cover double, local_path string, size_bytes bigint"
)


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Typed manifest; empty with the same columns where there is none yet."""
    try:
        return spark.read.schema(MANIFEST_SCHEMA).option("header", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], MANIFEST_SCHEMA)


def upsert(entries: DataFrame, sequence: str = "seq", keys: list[str] | None = None) -> DataFrame:
    """Latest entry per key. An aggregate, so repeats collapse before the shuffle."""
    keys = keys or GRANULE_KEY
    rest = [c for c in entries.columns if c not in keys and c != sequence]
    latest = entries.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), sequence).alias("_row"), F.max(sequence).alias(sequence)
    )
    return latest.select(*keys, sequence, "_row.*")


def append_manifest(manifest: DataFrame, new: DataFrame, sequence: str, keys: list[str] | None = None) -> DataFrame:
    """Appends rows; a repeated key keeps the new row, of several the last by ``sequence``, a column of ``new``."""
    order = "_order"
    place = lambda added, c: F.struct(F.lit(added).alias("added"), c.cast("long").alias("at"))
    old = manifest.withColumn(order, place(0, F.lit(0)))
    added = new.withColumn(order, place(1, F.col(sequence))).drop(sequence)
    return upsert(old.unionByName(added, allowMissingColumns=True), order, keys).drop(order)


def not_in_manifest(catalog: DataFrame, manifest: DataFrame, short_name: str | None = None) -> DataFrame:
    """Catalogue rows still to be fetched."""
    wanted = catalog if short_name is None else catalog.where(F.col("short_name") == short_name)
    return wanted.join(manifest.select(*GRANULE_KEY).distinct(), GRANULE_KEY, "left_anti")


def search(
    catalog: DataFrame, short_name: str, period: tuple[str, str] = config.CATALOG_PERIOD,
    pattern: str | None = None, bbox: tuple[float, float, float, float] | None = None,
    cloud_cover: tuple[float, float] | None = None, count: int | None = None,
) -> DataFrame:
    """Granules of one product that overlap a period (and box), by name pattern and cloud cover."""
    start, end = (F.to_timestamp(F.lit(p)) for p in period)
    hit = (F.col("short_name") == short_name) & (F.col("start_time") <= end) & (F.col("end_time") >= start)
    if pattern:
        hit = hit & names.glob_matches(F.col("granule_name"), pattern)
    if bbox:
        lon_min, lat_min, lon_max, lat_max = bbox
        hit = hit & (F.col("lon_min") <= lon_max) & (F.col("lon_max") >= lon_min)
        hit = hit & (F.col("lat_min") <= lat_max) & (F.col("lat_max") >= lat_min)
    if cloud_cover:
        hit = hit & F.col("cloud_cover").between(*cloud_cover)
    found = catalog.where(hit)
    return found if count is None else found.orderBy("start_time", "granule_name").limit(count)


def volume_report(entries: DataFrame) -> DataFrame:
    """Granules and megabytes per product."""
    return entries.groupBy("short_name").agg(
        F.count(F.lit(1)).alias("granules"), (F.sum("size_bytes") / (1024.0 * 1024.0)).alias("megabytes")
    )


def granules_per_year(catalog: DataFrame, years: tuple[int, int] = config.COUNT_YEARS) -> DataFrame:
    """Granules per product and year of the name, 0 where a year has none."""
    first, last = years
    counted = (
        catalog.withColumn("year", names.granule_year(F.col("granule_name")))
        .where(F.col("year").between(first, last))
        .groupBy("short_name", "year")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    products = catalog.select("short_name").distinct()
    frame = products.withColumn("year", F.explode(F.sequence(F.lit(first), F.lit(last))))
    return frame.join(counted, ["short_name", "year"], "left").select(
        "short_name", "year", F.coalesce("n", F.lit(0).cast("long")).alias("granules")
    )
