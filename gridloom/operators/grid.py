"""Uniform grids: cells, indices, areas, land masks."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import geo


@dataclass(frozen=True)
class Grid:
    """Regular axes from a corner, a step and a size."""

    lat_min: float
    lon_min: float
    res: float
    ny: int
    nx: int

    @classmethod
    def of_bbox(cls, bbox=config.STUDY_BBOX, res: float = config.STUDY_RES) -> Grid:
        lon_min, lat_min, lon_max, lat_max = bbox
        return cls(lat_min, lon_min, res, round((lat_max - lat_min) / res) + 1, round((lon_max - lon_min) / res) + 1)

    @classmethod
    def covering(cls, df: DataFrame, res: float) -> Grid:
        """Smallest grid of this step that holds every point of ``df`` (reads back four numbers)."""
        box = df.agg(F.min("lon"), F.min("lat"), F.max("lon"), F.max("lat")).first()
        if box[0] is None:
            raise ValueError("cannot lay a grid over an empty table")
        return cls.of_bbox(tuple(box), res)

    @property
    def mean_lat(self) -> float:
        return self.lat_min + (self.ny - 1) * self.res / 2

    def cos_mean_lat(self, clip: float) -> float:
        return math.cos(math.radians(max(-clip, min(clip, self.mean_lat))))

    def radius_cells(self, km: float) -> float:
        """Disk radius in cells: the smaller of the row and column counts."""
        step_km = config.KM_PER_DEGREE * self.res
        return min(km / step_km, km / (step_km * self.cos_mean_lat(75)))

    def cells(self, spark: SparkSession) -> DataFrame:
        """One row per cell; the pair of axes is read off a single range, so no join."""
        row = F.expr(f"CAST(id DIV {self.nx} AS INT)")
        col = F.expr(f"CAST(id % {self.nx} AS INT)")
        return spark.range(self.ny * self.nx).select(
            row.alias("iy"),
            col.alias("ix"),
            F.round(self.lat_min + row * self.res, 6).alias("lat"),
            F.round(self.lon_min + col * self.res, 6).alias("lon"),
        )

    def index(self, df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Adds integer cell keys."""
        return df.withColumns(
            {
                "iy": geo.cell_index(F.col(lat), self.lat_min, self.res),
                "ix": geo.cell_index(F.col(lon), self.lon_min, self.res),
            }
        )


def with_land_mask(df: DataFrame) -> DataFrame:
    ocean = geo.is_ocean(F.col("depth"))
    return df.withColumns({"is_ocean": ocean, "is_land": ~ocean})


def mask_land(df: DataFrame, static: tuple[str, ...] = config.STATIC_FIELDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Nulls every time-varying column on land. Without a depth column nothing is masked."""
    if "depth" not in df.columns:
        return df
    untouched = {"iy", "ix", "time", "lat", "lon", *static, *keep}
    ocean = geo.is_ocean(F.col("depth"))
    return df.withColumns({c: F.when(ocean, F.col(c)) for c in df.columns if c not in untouched})


def land_points(cells: DataFrame) -> DataFrame:
    return cells.where(~geo.is_ocean(F.col("depth"))).select("lon", "lat")
