"""What keeps tasks, exchanges and passes from growing faster than the input."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from gridloom.operators import gradients, neighbourhood, regrid, temporal, tiling
from gridloom.operators.grid import Grid
from gridloom.plans import features, learning

WIDE = Grid(0.0, 0.0, 0.5, 1500, 2000)
SOURCE = Grid(0.0, 0.0, 1.0, 2, 3)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pixels(spark):
    rows = [("sst", iy, ix, dt.date(2000, 1, 1) + dt.timedelta(days=8 * k), float(iy + ix + k)) for iy in range(2) for ix in range(3) for k in range(3)]
    df = spark.createDataFrame(rows, "variable string, iy int, ix int, time date, value double")
    return df.withColumns({"lat": F.col("iy").cast("double"), "lon": F.col("ix").cast("double")})


@pytest.mark.parametrize("source", [None, SOURCE])
def test_regridding_looks_coordinates_up_once_per_axis(pixels, source):
    """F2, F8: no search of an axis per pixel, no rounding per target."""
    out = regrid.regrid_bilinear(pixels, Grid(0.0, 0.0, 0.5, 3, 5), source=source)
    plan = plan_of(out)
    assert "array_position" not in plan
    generated = re.search(r"Generate explode\(_xs.*", plan)
    assert generated and "round(" not in plan[: generated.start()]
    got = {(r["iy"], r["ix"]): r["value"] for r in out.where("time = '2000-01-01'").collect()}
    assert got == {(y, x): (y + x) / 2 for y in range(3) for x in range(5)}


def test_targets_beside_a_gap_are_not_spelled_out(pixels):
    out = regrid.regrid_bilinear(pixels.where("NOT (iy = 1 AND ix = 2)"), Grid(0.0, 0.0, 0.5, 3, 5), source=SOURCE)
    got = {(r["iy"], r["ix"]) for r in out.where("time = '2000-01-01'").collect()}
    assert got == {(y, x) for y in range(3) for x in range(5)} - {(1, 3), (1, 4), (2, 3), (2, 4)}


def test_tasks_hold_a_bounded_number_of_cells(spark, pixels):
    """partitions come from the grid, not from compressed sizes."""
    n = WIDE.ny * WIDE.nx // tiling.CELLS_PER_TASK + 1
    assert tiling.parts(spark, WIDE) == n
    dense = temporal.densify(pixels.withColumnRenamed("value", "sst"), WIDE, ["sst"])
    assert f", {n}), REPARTITION_BY_NUM" in plan_of(dense)
    filled = temporal.gap_fill(pixels, grid=WIDE)
    assert re.search(rf"hashpartitioning\(iy#\d+, ix#\d+, {n}\), REPARTITION_BY_NUM", plan_of(filled))
    assert re.search(rf"_tx#\d+, {n}\), REPARTITION_BY_NUM", plan_of(tiling.spread(dense, WIDE, 1, ["time"])))


def test_neighbourhoods_are_dealt_before_columns_along_time_are_made(spark, pixels):
    """the uppermost exchange goes by cell; none by tile carries rolling means or anomalies."""
    plan = plan_of(features.feature_cube(pixels, None, SOURCE, features.FeatureSettings(variables=("sst",))))
    exchanges = re.findall(r"Exchange hashpartitioning\((\w+)#\d+, (\w+)#\d+", plan)
    assert exchanges[0] == ("iy", "ix") and ("time", "_ty") in exchanges


def test_studies_read_their_table_back(spark):
    """whatever made the table and the catches runs once, and labels join without an exchange of it."""
    day = F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int") * 8)
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(x):
        seen.add(1)
        return float(x)

    made = spark.range(60).repartition(3).select(F.lit(0).alias("iy"), F.lit(0).alias("ix"), day.alias("time"), counted("id").alias("sst"))
    quarters = [(code, y, q, 0, 0, float(y + q)) for code in ("scad", "anchovy") for y in (1999, 2000) for q in (1, 2, 3, 4)]
    catches = spark.createDataFrame(quarters, "species string, year int, quarter int, iy int, ix int, volume_mt double")
    given = learning.inputs(made, catches, ["sst"])
    for code in ("scad", "anchovy"):
        ready = learning.prepare(given, code)
        assert ready.rows.count() == 60 and "SortMergeJoin" not in plan_of(ready.rows)
    assert seen.value == 60
    assert given.medians == {"sst": 29.5}


def test_fronts_and_means_share_one_exchange_by_tile(spark, pixels):
    """what both look at is sent to tiles once, rows carry no position beside their cell."""
    plan = plan_of(features.feature_cube(pixels, None, SOURCE, features.FeatureSettings(variables=("sst",))))
    assert len(re.findall(r"Exchange hashpartitioning\(time#\d+, _ty#\d+, _tx#\d+", plan)) == 1
    sent = re.search(r"Exchange hashpartitioning\(time#\d+, _ty#\d+, _tx#\d+.*?(?=Exchange)", plan, re.S).group(0)
    assert "[_y" not in sent and "_x#" not in sent.replace("_tx#", "")


def test_shared_tiles_give_the_fronts_and_means_of_separate_ones(spark):
    """at borders, at the edges of tiles, beside gaps, and on grids that one tile holds."""
    settings = features.FeatureSettings(lag_radii_km=(60, 180))
    for grid in (Grid(0.0, 0.0, 0.5, 5, 270), Grid(0.0, 0.0, 0.5, 131, 3), Grid(3.0, 3.0, 0.5, 1, 4)):
        cell = F.col("iy") * 31 + F.col("ix") * 17
        dense = grid.cells(spark).select("iy", "ix", F.lit(dt.date(2000, 1, 4)).alias("time"), F.when(cell % 5 > 0, (cell * cell % 97).cast("double")).alias("sst"), F.when(cell % 3 > 0, (cell % 89).cast("double")).alias("chl"))
        apart = neighbourhood.spatial_lags(gradients.frontal_index(dense, grid), grid, ("sst", "chl", "frontal_index"), (60, 180))
        shared = features.with_neighbourhoods(dense, grid, settings)
        assert sorted(shared.columns) == sorted(apart.columns)
        assert shared.count() == grid.ny * grid.nx and shared.exceptAll(apart.select(*shared.columns)).isEmpty()


def test_static_columns_join_after_the_windows_without_another_sort(spark, pixels):
    """no window carries what is fixed per cell, and no sort by cell comes between the last exchange and the windows."""
    static = SOURCE.cells(spark).select("iy", "ix", F.lit(-50.0).alias("depth"), F.lit(1.0).alias("slope"), F.lit(2.0).alias("dist_coast"))
    plan = plan_of(features.feature_cube(pixels, static, SOURCE, features.FeatureSettings(variables=("sst",))))
    assert plan.index("Join") < plan.index("Window")
