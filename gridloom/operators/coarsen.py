"""Block averages onto coarser grids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators.grid import Grid
from gridloom.operators.regrid import axis_values


def coarsen_grid(df: DataFrame, grid: Grid, factor: int, value: str, keys: list[str] | None = None) -> DataFrame:
    """Blocks of ``factor`` x ``factor`` grid cells; incomplete blocks at the far edges are cut."""
    keys = ["time"] if keys is None else keys
    ny, nx = grid.ny - grid.ny % factor, grid.nx - grid.nx % factor
    middle = (factor - 1) / 2
    by, bx = F.floor(F.col("iy") / factor).cast("int"), F.floor(F.col("ix") / factor).cast("int")
    blocks = df.where((F.col("iy") < ny) & (F.col("ix") < nx)).groupBy(*keys, by.alias("by"), bx.alias("bx"))
    return blocks.agg(F.avg(value).alias(value)).select(
        *keys,
        "by",
        "bx",
        F.round(grid.lat_min + (F.col("by") * factor + middle) * grid.res, 6).alias("lat"),
        F.round(grid.lon_min + (F.col("bx") * factor + middle) * grid.res, 6).alias("lon"),
        value,
    )


def coarsen_valid_axes(df: DataFrame, factor: int, value: str, keys: list[str] | None = None) -> DataFrame:
    """Blocks over the coordinates that occur among valid cells, labelled by their first one."""
    keys = [] if keys is None else keys
    valid = df.where(F.col(value).isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lats, lons = axis_values(valid, "lat"), axis_values(valid, "lon")

    def block(axis, c: str):
        at = F.array_position(axis, F.col(c)) - 1
        kept = F.size(axis) - F.size(axis) % factor
        return F.when(at < kept, F.floor(at / factor).cast("int"))

    placed = valid.select(*keys, block(lats, "lat").alias("by"), block(lons, "lon").alias("bx"), value).where(
        F.col("by").isNotNull() & F.col("bx").isNotNull()
    )
    return placed.groupBy(*keys, "by", "bx").agg(F.avg(value).alias(value)).select(
        *keys,
        F.element_at(lats, (F.col("by") * factor + 1).cast("int")).alias("lat"),
        F.element_at(lons, (F.col("bx") * factor + 1).cast("int")).alias("lon"),
        value,
    )
