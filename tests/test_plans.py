"""Physical plans: number of exchanges, no Python, no cartesian products, pushdown."""

import re

import pytest

import __spark_entry__ as entry
from gridloom.functions import geo
from gridloom.operators import cube, sheets, temporal
from gridloom.operators.grid import Grid
from gridloom.sources import observations
from pyspark.sql import functions as F
from registry import tables

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def main_plan(df):
    """The plan without its scalar subqueries (their lines carry a ':' in the tree margin)."""
    return "\n".join(line for line in plan_of(df).splitlines() if ":" not in line[: len(line) - len(line.lstrip(" :+-"))])


@pytest.fixture(scope="module")
def pixels(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pixels"))
    tables.pixels(spark, SF).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_time_features_shuffle_the_observations_once(pixels, no_broadcast):
    g = Grid(4.5, 116.0, 0.5, 2, 16)
    wide = cube.assemble(temporal.gap_fill(pixels), ["sst", "chl", "par", "kd490"])
    out = temporal.temporal_features(temporal.densify(wide, g, ["sst", "chl", "par", "kd490"], axis_from=pixels), {7: 1, 14: 2, 30: 4, 90: 11})
    plan = plan_of(out)
    # The time axes are subqueries over (variable, time); everything keyed by cell counts here.
    by_cell = re.findall(r"Exchange hashpartitioning\(iy#\d+, ix#\d+, \d+\), REPARTITION_BY_COL", plan)
    cells_side = re.findall(r"Exchange hashpartitioning\(iy#\d+, ix#\d+, \d+\), ENSURE_REQUIREMENTS", main_plan(out))
    assert len(set(by_cell)) == 1
    assert len(cells_side) <= 1  # the grid cells, for the left join
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("name", ["frontal_index", "spatial_mean"])
def test_stencils_shuffle_once_per_tile(spark, name):
    plan = main_plan(entry.queries()[name](spark, SF))
    assert len(re.findall(r"Exchange hashpartitioning\(time#\d+, _ty#\d+, _tx#\d+", plan)) == 1


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - {"grid"}))
def test_no_python_and_no_pairing(spark, name):
    plan = plan_of(entry.queries()[name](spark, SF))
    for node in ("Cartesian", "BroadcastNestedLoop", "ArrowEvalPython", "BatchEvalPython", "MapInPandas", "FlatMapGroups"):
        assert node not in plan, node


def test_scan_prunes_partitions_and_pushes_the_box(spark, pixels, tmp_path):
    observations.write_observations(pixels.select("variable", "time", "lat", "lon", "value"), str(tmp_path / "o"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    plan = plan_of(observations.read_observations(spark, str(tmp_path / "o"), "sst", [1998], (117.0, 5.0, 121.0, 12.0)))
    assert re.search(r"PartitionFilters: \[[^\]]*variable[^\]]*year", plan)
    assert "GreaterThanOrEqual(lat" in plan and "LessThanOrEqual(lon" in plan


def test_region_assignment_is_an_expression(spark):
    df = spark.range(5).select((F.col("id") * 1.0).alias("lat"), (F.col("id") + 116.0).alias("lon"))
    assert "Join" not in plan_of(df.withColumn("r", geo.first_region(F.col("lat"), F.col("lon"))))


@pytest.mark.parametrize("job, scans", [(sheets.matrix_headers, 1), (sheets.matrix_rows, 2), (sheets.matrix_values, 2)])
def test_sheets_read_their_cells_at_most_twice(spark, tmp_path, job, scans):
    tables.sheet_cells(spark, SF).write.parquet(str(tmp_path / "cells"))
    plan = plan_of(job(spark.read.parquet(str(tmp_path / "cells"))))
    assert len(re.findall(r"FileScan parquet", plan)) == scans
