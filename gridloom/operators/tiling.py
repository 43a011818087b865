"""Square tiles with a shared rim, so that stencils need one shuffle.

A stencil (gradient, disk mean, interpolation) looks at neighbours in both directions.
Windows along rows and along columns would shuffle the table twice. Here every cell is sent
to its own tile and, if it lies within ``halo`` of another tile, to that one too. All windows
then run inside ``(keys, tile)``: one exchange, and a group never exceeds
``(tile + 2 * halo)**2`` rows however large the grid is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TILE = 128
# Cells whose series one task holds: a few hundred thousand rows of an eight-day record.
CELLS_PER_TASK = 1024
TILE_COLUMNS = ["_ty", "_tx", "_y", "_x"]


def parts(spark: SparkSession, grid, joins: bool = True) -> int:
    """Partitions for one row per cell and time step: as many as the grid needs, so that a task does not grow with it.

    Given as a number, they are not merged by their compressed size, which tells little of rows that are
    mostly empty or still to be filled in. Tables that are joined take the session's number at least, below
    which a join would deal them out again.
    """
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    least = usual if joins else min(usual, 2 * spark.sparkContext.defaultParallelism)
    return max(least, -(-grid.ny * grid.nx // CELLS_PER_TASK))


def _images(c: Column, size: int, halo: int) -> Column:
    """Positions a cell takes: its own, plus those beyond the border it stands in for."""
    first = F.when(c == 0, F.lit(-halo)).otherwise(c)
    last = F.when(c == size - 1, F.lit(size - 1 + halo)).otherwise(c)
    return F.sequence(first, last)


def _tiles(c: Column, size: int, halo: int, tile: int) -> Column:
    last_tile = (size - 1) // tile
    low = F.floor((c - halo) / tile).cast("int")
    high = F.floor((c + halo) / tile).cast("int")
    return F.sequence(F.greatest(F.lit(0), F.least(low, F.lit(last_tile))), F.least(F.lit(last_tile), F.greatest(high, F.lit(0))))


def spread(df: DataFrame, grid, halo: int, keys: list[str], repeat_border: bool = False, tile: int = TILE) -> DataFrame:
    """Copies rows to tiles and shuffles once on ``keys`` and tile."""
    if halo > tile:
        raise ValueError("the halo must not be wider than a tile")
    # Without images a position is the cell's own, which need not be sent.
    placed = with_images(df, grid, halo) if repeat_border else df
    y, x = ("_y", "_x") if repeat_border else ("iy", "ix")
    sent = (
        placed.withColumn("_ty", F.explode(_tiles(F.col(y), grid.ny, halo, tile)))
        .withColumn("_tx", F.explode(_tiles(F.col(x), grid.nx, halo, tile)))
        .repartition(parts(df.sparkSession, grid, joins=False), *keys, "_ty", "_tx")
    )
    return sent if repeat_border else sent.withColumns({"_y": F.col("iy"), "_x": F.col("ix")})


def with_images(df: DataFrame, grid, halo: int) -> DataFrame:
    """``_y, _x``: the positions that a cell stands in for; of a table spread without them, in the tiles it was sent to."""
    return df.withColumn("_y", F.explode(_images(F.col("iy"), grid.ny, halo))).withColumn("_x", F.explode(_images(F.col("ix"), grid.nx, halo)))


def row_window(keys: list[str]):
    return Window.partitionBy(*keys, "_ty", "_tx", "_y").orderBy("_x")


def column_window(keys: list[str]):
    return Window.partitionBy(*keys, "_ty", "_tx", "_x").orderBy("_y")


def gather(df: DataFrame, tile: int = TILE) -> DataFrame:
    """Keeps the one copy of each cell that belongs to its tile and drops the tile columns."""
    own = (
        (F.col("_y") == F.col("iy"))
        & (F.col("_x") == F.col("ix"))
        & (F.floor(F.col("_y") / tile) == F.col("_ty"))
        & (F.floor(F.col("_x") / tile) == F.col("_tx"))
    )
    return df.where(own).drop(*TILE_COLUMNS)


def neighbour(value: Column, position: str, step: int, window) -> Column:
    """Value of the adjacent cell; NULL when that cell has no row."""
    shift = F.lag if step < 0 else F.lead
    adjacent = shift(F.col(position), 1).over(window) == F.col(position) + step
    return F.when(adjacent, shift(value, 1).over(window))
