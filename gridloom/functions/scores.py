"""Column expressions: habitat scores, derived indices, labels, display scales."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import config


def nan_to_null(c: Column) -> Column:
    """Files mark missing pixels with NaN; every operator expects NULL."""
    return F.when(~F.isnan(c), c)


def membership(x: Column, lo: float, hi: float) -> Column:
    """1 inside [lo, hi], Gaussian shoulders outside, NULL for NULL."""
    width = max((hi - lo) * 0.2, 0.5)
    beyond = x - F.when(x < lo, F.lit(lo)).otherwise(F.lit(hi))
    return F.when(x.between(lo, hi), F.lit(1.0)).when(
        x.isNotNull(), F.exp(-(beyond * beyond) / (2 * width * width))
    )


def habitat_suitability(code: str, sst: Column | None = None, chl: Column | None = None) -> Column:
    """Geometric mean of the temperature and chlorophyll scores of one species.

    The chlorophyll term is log10(chl) for positive values and 0 for everything else,
    a missing value included, so only a missing temperature leaves the score missing.
    """
    species = config.species_by_code(code)
    sst = F.col("sst") if sst is None else sst
    chl = F.col("chl") if chl is None else chl
    log_chl = F.when(chl > 0, F.log10(chl)).otherwise(F.lit(0.0))
    return F.sqrt(
        membership(sst, species.sst_lo, species.sst_hi)
        * membership(log_chl, species.chl_lo, species.chl_hi)
    )


def suitability_columns(codes: list[str] | None = None) -> dict[str, Column]:
    """One ``suitability_<code>`` column per species."""
    codes = codes or [s.code for s in config.SPECIES]
    return {f"suitability_{code}": habitat_suitability(code) for code in codes}


def productivity_index(chl: Column) -> Column:
    floor = 1e-4
    return F.when(chl > 0, F.log10(F.greatest(chl, F.lit(floor)) + floor))


def upwelling_proxy(anomaly: Column) -> Column:
    """Cooling below the monthly mean, never negative. ``greatest`` alone would skip NULL."""
    return F.when(anomaly.isNotNull(), F.greatest(-anomaly, F.lit(0.0)))


def month_sin(time: Column) -> Column:
    return F.sin(F.month(time) * (2 * math.pi / 12))


def month_cos(time: Column) -> Column:
    return F.cos(F.month(time) * (2 * math.pi / 12))


def to_target(y: Column, transform: str | None) -> Column:
    """Training scale of a label; negative volumes count as zero."""
    if transform != "log1p":
        return y
    return F.when(y.isNotNull(), F.log1p(F.greatest(y, F.lit(0.0))))


def from_target(y: Column, transform: str | None) -> Column:
    return F.expm1(y) if transform == "log1p" else y


def sustainability_flag(ratio: Column) -> Column:
    return (
        F.when(ratio <= config.RATIO_SUSTAINABLE, "sustainable")
        .when(ratio <= config.RATIO_CAUTION, "caution")
        .when(ratio.isNotNull(), "overfishing risk")
        .otherwise("n/a")
    )


def display_norm(value: Column, lo: Column, hi: Column) -> Column:
    """Position of ``value`` on a log colour scale that runs from lo to hi, in [0, 1]."""
    def log_of(c: Column) -> Column:
        return F.log1p(F.greatest(c, F.lit(0.0)))

    flat = log_of(hi) <= log_of(lo)
    start = F.when(flat, F.lit(0.0)).otherwise(log_of(lo))
    stop = F.when(flat, F.lit(1.0)).otherwise(log_of(hi))
    position = (log_of(value) - start) / (stop - start)
    return F.when(value.isNotNull(), F.least(F.greatest(position, F.lit(0.0)), F.lit(1.0)))


def marker_radius(norm: Column, smallest: float = 2.5, largest: float = 8.0) -> Column:
    return smallest + (largest - smallest) * F.sqrt(norm)


def split_masks(
    time: Column,
    train_until: int = config.TRAIN_UNTIL,
    validation: tuple[int, int] = config.VALIDATION_YEARS,
    holdout_from: int = config.HOLDOUT_FROM,
) -> dict[str, Column]:
    """Three independent year predicates; a date that does not parse is in none."""
    year = F.year(F.try_to_date(time.cast("string"), "yyyy-MM-dd"))
    return {
        "train": F.coalesce(year <= train_until, F.lit(False)),
        "val": F.coalesce(year.between(*validation), F.lit(False)),
        "test": F.coalesce(year >= holdout_from, F.lit(False)),
    }
