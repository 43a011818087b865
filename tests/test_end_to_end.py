"""Decoded pixels to regional report through the whole library."""

import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gridloom.operators import analytics, regrid
from gridloom.operators.grid import Grid
from gridloom.plans import features, forecasts
from gridloom.sources import observations

GRID = Grid(8.0, 118.0, 0.5, 8, 8)
SOURCE = Grid(7.0, 117.0, 0.4, 16, 16)
DEPTHS = Grid(7.5, 117.5, 0.25, 20, 20)


@pytest.fixture(scope="module")
def pixels(spark):
    """A plane in space and a line in time, so bilinear values and filled gaps are known exactly."""
    steps = F.explode(F.sequence(F.lit(0), F.lit(19)))
    cells = SOURCE.cells(spark).withColumn("s", steps).withColumn("variable", F.explode(F.array(*map(F.lit, ("sst", "chl", "par", "kd490")))))
    value = 20 + F.col("lat") * 0.5 - (F.col("lon") - 117) * 0.25 + F.col("s") * 0.1
    cloudy = (F.col("s") % 7 == 3) & (F.col("variable") == "chl")
    time = F.date_add(F.lit(dt.date(2019, 1, 4)), F.col("s") * 8)
    return cells.select("variable", time.alias("time"), "lat", "lon", F.when(~cloudy, value).alias("value")).where("value IS NOT NULL")


@pytest.fixture(scope="module")
def static(spark):
    depth = F.when(F.col("lon") > 120.9, F.lit(50.0)).otherwise(F.lit(-200.0) - F.col("lat"))
    df = features.static_fields(DEPTHS.cells(spark).withColumn("depth", depth), GRID, DEPTHS)
    return df.persist()


@pytest.fixture(scope="module")
def matrix(spark, pixels, static, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("store"))
    observations.write_observations(pixels, f"{path}/pixels")
    stored = spark.read.parquet(f"{path}/pixels").drop("year")
    composites = stored.select("time").distinct().withColumn("variable", F.explode(F.array(*map(F.lit, ("sst", "chl", "par", "kd490")))))
    table = features.feature_matrix(features.regridded(stored, GRID, SOURCE), static, GRID, composites=composites)
    observations.write_matrix(table, f"{path}/matrix")
    return observations.read_matrix(spark, f"{path}/matrix")


def test_static_fields(static):
    rows = static.collect()
    assert len(rows) == GRID.ny * GRID.nx
    for r in rows:
        assert (r.dist_coast == 0) == (not (r.depth is not None and r.depth < 0))


def test_matrix_is_dense_and_complete(matrix):
    assert matrix.count() == GRID.ny * GRID.nx * 20
    wanted = {f"{v}_{k}" for v in ("sst", "chl", "par", "kd490") for k in ("roll7d", "roll14d", "roll30d", "roll90d", "anom")}
    wanted |= {f"{v}_lag{r}km" for v in ("sst", "chl", "frontal_index") for r in (20, 50, 100)}
    wanted |= {"depth", "slope", "dist_coast", "frontal_index", "upwelling_proxy", "productivity_index", "month_sin", "month_cos"}
    assert wanted <= set(matrix.columns)


def test_values_follow_the_plane_and_clouds_are_filled(matrix):
    for r in matrix.where("depth < 0").select("lat", "lon", "date", "sst", "chl", "frontal_index", "ix").collect():
        step = (r.date - dt.date(2019, 1, 4)).days // 8
        plane = 20 + r.lat * 0.5 - (r.lon - 117) * 0.25 + step * 0.1
        assert r.sst == pytest.approx(plane, abs=1e-9)
        assert r.chl == pytest.approx(plane, abs=1e-9)
        if r.frontal_index is not None:
            c = math.cos(math.radians(GRID.mean_lat))
            assert r.frontal_index == pytest.approx(math.hypot(0.5, 0.25 / c), abs=1e-9)


def test_land_is_empty_but_coastal_land_takes_the_neighbourhood(matrix):
    land = matrix.where("NOT depth < 0 OR depth IS NULL")
    assert land.where("sst IS NOT NULL").isEmpty()
    assert not land.where("sst_lag100km IS NOT NULL").isEmpty()


def test_reports_on_the_stored_matrix(spark, matrix, tmp_path):
    ranking = forecasts.ranking_of_latest(matrix, "scad").collect()
    assert ranking and all(0 <= r.mean <= 1 and r.mean <= r.max for r in ranking)
    observations.write_forecast(forecasts.export_table(matrix, "scad"), str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == matrix.where("depth < 0").where(F.col("date") == matrix.agg(F.max("date")).scalar()).count()
    table = analytics.sustainability(matrix.withColumn("v", F.col("sst") / 100), "v").collect()
    assert {r.flag for r in table} <= {"sustainable", "caution", "overfishing risk", "n/a"}


def test_a_missing_source_row_is_not_bridged(spark):
    raster = Grid(0.0, 0.0, 1.0, 4, 4)
    df = raster.cells(spark).where("iy <> 2").select(F.lit(1).alias("time"), "lat", "lon", F.lit(1.0).alias("value"))
    target = Grid(0.5, 0.5, 1.0, 3, 3)
    got = {r.iy for r in regrid.regrid_bilinear(df, target, source=raster).collect()}
    assert got == {0}
