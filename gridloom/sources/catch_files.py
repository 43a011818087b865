"""Catch tables, place look-ups and report templates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridloom import config

CATCH_SCHEMA = "fma int, species string, year int, quarter int, volume_mt double, lat double, lon double"


def load_catches(spark: SparkSession, path: str) -> DataFrame:
    """Catch CSV by column name; quarters are clipped to 1..4, a missing file is an empty table."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], CATCH_SCHEMA)
    missing = [c for c in config.CATCH_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"catch table lacks {missing}")
    types = dict(part.split() for part in CATCH_SCHEMA.split(", "))
    typed = raw.select(*[F.col(c).cast(types[c]).alias(c) for c in config.CATCH_COLUMNS])
    return typed.withColumn("quarter", F.least(F.greatest("quarter", F.lit(1)), F.lit(4)))


def write_catches(catches: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Catch CSV in report order."""
    order = ["species", "fma", "year", "quarter", "lat", "lon"]
    catches.select(*config.CATCH_COLUMNS).orderBy(*order).write.mode(mode).option("header", True).csv(path)


def load_centroids(spark: SparkSession, path: str) -> DataFrame:
    schema = "psa_name string, adm_name string, region string, lat double, lon double, source string"
    return spark.read.schema(schema).option("header", True).csv(path).withColumnRenamed("psa_name", "geo")


AREA_SCHEMA = "areas map<string, struct<name:string, provinces:array<struct<name:string, note:string>>>>"


def load_area_map(spark: SparkSession, path: str) -> DataFrame:
    """The nested map ``area -> (name, provinces)`` of a JSON file as ``(geo, fma)``, one row per place."""
    areas = spark.read.schema(AREA_SCHEMA).option("multiLine", "true").json(path).select(F.explode("areas").alias("fma", "area"))
    return areas.select(F.explode("area.provinces.name").alias("geo"), F.col("fma").cast("int").alias("fma"))


def area_map(spark: SparkSession, areas: dict[int, list[str]]) -> DataFrame:
    """Management area -> place names, flattened to ``(geo, fma)``."""
    rows = [(int(fma), list(places)) for fma, places in areas.items()]
    return spark.createDataFrame(rows, "fma int, places array<string>").select(F.explode("places").alias("geo"), "fma")


def write_template(spark: SparkSession, path: str, year: int = 2020, quarter: int = 1) -> None:
    """Empty report per area and species; never overwrites."""
    from gridloom.operators.catches import report_scaffold

    years = spark.range(1).select(F.lit(year).alias("year"))
    rows = report_scaffold(spark, years).where(F.col("quarter") == quarter)
    empty = rows.withColumns({c: F.lit(None).cast("double") for c in ("volume_mt", "lat", "lon")})
    empty.select(*config.CATCH_COLUMNS).write.mode("errorifexists").option("header", True).csv(path)
