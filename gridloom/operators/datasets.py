"""Training tables: feature resolution, imputation, targets, hotspot classes."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import scores
from gridloom.operators.quantiles import column_quantiles, exact_quantiles

log = logging.getLogger(__name__)


def resolve_features(columns: list[str], requested: list[str] | None = None) -> list[str]:
    """Configured names as table columns; absent ones are dropped with a warning."""
    wanted = [config.FEATURE_ALIASES.get(n, n) for n in (requested or list(config.FEATURE_ALIASES))]
    present = [c for c in wanted if c in columns]
    for c in wanted:
        if c not in columns:
            log.warning("feature %r is not in the table; dropped", c)
    if not present:
        raise ValueError("none of the requested features is in the table")
    return present


def as_model_input(df: DataFrame, features: list[str]) -> DataFrame:
    return df.withColumns({f: F.col(f).cast("float") for f in features})


def imputer_medians(df: DataFrame, features: list[str], where: Column | None = None) -> DataFrame:
    """Median per feature in single precision, 0 for a feature without values.

    Over the whole table, labelled or not; ``where`` restricts the fit, e.g. to training rows.
    """
    fitted = as_model_input(df if where is None else df.where(where), features)
    medians = column_quantiles(fitted, features, {"median": 0.5}, key="feature")
    names = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    return names.join(medians, "feature", "left").select(
        "feature", F.coalesce(F.col("median").cast("float"), F.lit(0.0).cast("float")).alias("median")
    )


def impute(df: DataFrame, features: list[str], medians: DataFrame | dict[str, float]) -> DataFrame:
    """Missing features take their median: literals, or a scalar subquery over the median table."""
    if isinstance(medians, dict):
        fill = {f: F.lit(float(medians[f])).cast("float") for f in features}
    else:
        table = medians.agg(F.map_from_entries(F.collect_list(F.struct("feature", "median")))).scalar()
        fill = {f: F.element_at(table, F.lit(f)) for f in features}
    return df.withColumns({f: F.coalesce(F.col(f), fill[f]) for f in features})


def training_set(
    labelled: DataFrame,
    features: list[str],
    transform: str | None,
    medians: DataFrame | dict[str, float] | None = None,
    drop_unlabelled: bool = True,
    splits: dict[str, Column] | None = None,
) -> DataFrame:
    """Single-precision features without gaps, ``y`` on the training scale, split flags.

    Medians are fitted before unlabelled rows go and over all years, as the published models
    were; pass medians fitted on training rows for a stricter set.
    """
    medians = imputer_medians(labelled, features) if medians is None else medians
    rows = labelled.where(F.col("label").isNotNull()) if drop_unlabelled else labelled
    rows = impute(as_model_input(rows, features), features, medians)
    splits = scores.split_masks(F.col("time")) if splits is None else splits
    return rows.withColumn("y", scores.to_target(F.col("label"), transform)).withColumns(splits)


def hotspot_labels(df: DataFrame, positive_ratio: float = 0.5, y: str = "y", train: str = "train") -> DataFrame:
    """``y_bin``: above the quantile of the training rows that leaves ``positive_ratio`` above it."""
    cut = exact_quantiles(df.where(F.col(train)), y, {"threshold": 1.0 - positive_ratio}).scalar()
    return df.withColumn("threshold", cut).withColumn("y_bin", (F.col(y) > F.col("threshold")).cast("int"))
