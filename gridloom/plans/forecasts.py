"""Scored composites: habitat score or model, ready for regional reports and export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import geo, scores
from gridloom.operators import analytics, temporal
from gridloom.plans.learning import Bundle, predict

FALLBACK_FEATURES = ["sst", "chl"]


def forecast(features: DataFrame, species: str, time=None, bundle: Bundle | None = None, ocean_only: bool = False) -> DataFrame:
    """``(iy, ix, lat, lon, value)`` of one composite, the latest by default.

    A model imputes whatever is missing, land included; ``ocean_only`` drops land first.
    """
    rows = features.where(geo.is_ocean(F.col("depth"))) if ocean_only else features
    wanted = bundle.features if bundle else FALLBACK_FEATURES
    frame = temporal.snapshot(rows, time, wanted)
    if bundle:
        value = predict(bundle, frame).withColumnRenamed("prediction", "value")
    else:
        value = frame.withColumn("value", scores.habitat_suitability(species))
    return value.where(F.col("value").isNotNull()).select("iy", "ix", "lat", "lon", "value")


def export_table(features: DataFrame, species: str, time=None, bundle: Bundle | None = None) -> DataFrame:
    """``lat, lon, yield, time, species`` of one composite."""
    picked = temporal.at_latest_time(features) if time is None else temporal.at_nearest_time(features, time)
    scored = forecast(picked, species, None, bundle)
    stamp = picked.agg(F.date_format(F.max("time"), "yyyy-MM-dd")).scalar()
    return scored.select("lat", "lon", F.col("value").alias("yield"), stamp.alias("time"), F.lit(species).alias("species"))


def ranking_of_latest(features: DataFrame, species: str, regions=config.REGIONS) -> DataFrame:
    """Regions by mean habitat score of the latest composite."""
    return analytics.region_ranking(forecast(features, species), "value", regions)
