"""Labels: quarterly catches, habitat scores, and which of the two a species gets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom import CELL, config
from gridloom.functions import scores

CATCH, HABITAT = "catch", "habitat"
JOIN_KEYS = [*CELL, "year", "quarter"]

# A provider turns a feature table into the same table with a ``label`` column, or declines.
LabelProvider = Callable[[DataFrame, str], "DataFrame | None"]


def duplicate_keys(catches: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that break the many-to-one contract of the catch join."""
    return catches.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def with_catch_label(features: DataFrame, catches: DataFrame, out: str = "label") -> DataFrame:
    """Every composite of a quarter gets the quarter's volume of its cell.

    ``catches(iy, ix, year, quarter, volume_mt)`` holds one species. A repeated key is an error,
    raised by the row that would have been duplicated.
    """
    usable = catches.where(F.col("iy").isNotNull() & F.col("ix").isNotNull() & F.col("volume_mt").isNotNull())
    repeated = F.raise_error(F.lit("catch table repeats a (cell, year, quarter) key")).cast("double")
    single = usable.groupBy(*JOIN_KEYS).agg(
        F.when(F.count(F.lit(1)) == 1, F.max("volume_mt")).otherwise(repeated).alias(out)
    )
    quarterly = features.withColumns({"year": F.year("time"), "quarter": F.quarter("time")})
    return quarterly.join(single, JOIN_KEYS, "left").drop("year", "quarter")


def catch_provider(catches: DataFrame | None) -> LabelProvider:
    """Declines without a catch table, or when the species has no usable row in it."""
    def attach(features: DataFrame, species: str) -> DataFrame | None:
        if catches is None:
            return None
        own = catches.where(F.col("species") == species)
        if own.where(F.col("volume_mt").isNotNull()).isEmpty():
            return None
        return with_catch_label(features, own)

    return attach


def habitat_provider() -> LabelProvider:
    def attach(features: DataFrame, species: str) -> DataFrame:
        return features.withColumn("label", scores.habitat_suitability(species))

    return attach


def provider_order(policy: str, catches: DataFrame | None) -> list[tuple[str, LabelProvider]]:
    """Providers in the order in which they are tried."""
    habitat, catch = (HABITAT, habitat_provider()), (CATCH, catch_provider(catches))
    orders = {"habitat_only": [habitat], "both": [habitat, catch], "prefer_catch": [catch, habitat]}
    return orders.get(policy, orders["prefer_catch"])


def attach_labels(
    features: DataFrame, species: str, policy: str = "prefer_catch", catches: DataFrame | None = None,
    providers: list[tuple[str, LabelProvider]] | None = None,
) -> tuple[DataFrame, str]:
    """First provider with at least one value labels the whole species; rows never mix kinds."""
    for kind, attach in providers or provider_order(policy, catches):
        labelled = attach(features, species)
        if labelled is not None and not labelled.where(F.col("label").isNotNull()).select("label").isEmpty():
            return labelled.withColumn("label_kind", F.lit(kind)), kind
    raise ValueError(f"no labels for {species!r} under policy {policy!r}")


def transform_of(kind: str) -> str | None:
    return config.TARGET_TRANSFORMS.get(kind)
