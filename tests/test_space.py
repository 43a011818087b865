"""Spatial operators against direct numpy computations, with tiles smaller than the grid."""

import math

import numpy as np
import pytest

from gridloom.functions import geo
from gridloom.operators import analytics, coarsen, coast, gradients, neighbourhood, regrid
from gridloom.operators.grid import Grid
from pyspark.sql import functions as F

G = Grid(10.0, 120.0, 0.5, 9, 11)


def field(seed, share=0.3):
    rng = np.random.default_rng(seed)
    a = rng.normal(size=(G.ny, G.nx))
    a[rng.random(a.shape) < share] = np.nan
    return a


def frame(spark, a, g=G, name="v", dense=True):
    rows = [
        (t, i, j, g.lat_min + i * g.res, g.lon_min + j * g.res, None if np.isnan(a[t][i, j]) else float(a[t][i, j]))
        for t in range(len(a)) for i in range(g.ny) for j in range(g.nx) if dense or not np.isnan(a[t][i, j])
    ]
    return spark.createDataFrame(rows, f"time int, iy int, ix int, lat double, lon double, {name} double")


def grids(df, out, n=2, shape=(G.ny, G.nx)):
    a = np.full((n, *shape), np.nan)
    for r in df.collect():
        if r[out] is not None:
            a[r.time, r.iy, r.ix] = r[out]
    return a


@pytest.mark.parametrize("tile", [4, 128])
@pytest.mark.parametrize("dense", [True, False])
def test_front(spark, tile, dense):
    a = [field(1), field(2)]
    got = grids(gradients.frontal_index(frame(spark, a, dense=dense), G, "v", tile=tile), "frontal_index")
    for t in range(2):
        gy, gx = np.gradient(a[t], 0.5, 0.5)
        want = np.sqrt((gx / math.cos(math.radians(G.mean_lat))) ** 2 + gy**2)
        want[np.isnan(a[t])] = np.nan
        np.testing.assert_allclose(got[t], want, atol=1e-12)


@pytest.mark.parametrize("tile", [4, 128])
@pytest.mark.parametrize("radius", [1.0, 2.3, 3.0])
def test_disk_mean_repeats_the_border(spark, tile, radius):
    a = [field(3), field(4)]
    df = neighbourhood.neighbourhood_means(frame(spark, a), G, {"m": ("v", radius)}, tile=tile)
    filled = neighbourhood.neighbourhood_means(frame(spark, a), G, {"m": ("v", radius)}, only_missing=True, tile=tile)
    got, lag = grids(df, "m"), grids(filled, "m")
    r = math.ceil(radius)
    for t in range(2):
        padded = np.pad(a[t], r, mode="edge")
        want = np.full(a[t].shape, np.nan)
        for i in range(G.ny):
            for j in range(G.nx):
                near = [padded[i + r + y, j + r + x] for y in range(-r, r + 1) for x in range(-r, r + 1) if x * x + y * y <= radius**2]
                near = [v for v in near if not np.isnan(v)]
                want[i, j] = np.mean(near) if near else np.nan
        np.testing.assert_allclose(got[t], want, atol=1e-12)
        np.testing.assert_allclose(lag[t], np.where(np.isnan(a[t]), want, a[t]), atol=1e-12)


def test_row_counts_survive_tiling(spark):
    df = frame(spark, [field(5), field(6)])
    assert gradients.frontal_index(df, G, "v", tile=3).count() == df.count()


def test_coast_distance_is_the_nearest_land(spark):
    for seed in (7, 8, 9):
        depth = np.where(np.random.default_rng(seed).random((G.ny, G.nx)) < 0.06, 5.0, -5.0)
        depth[4, 4] = np.nan  # unknown counts as land
        got = coast.distance_to_coast(frame(spark, [depth], name="depth").drop("time"), G).collect()
        land = [(i, j) for i in range(G.ny) for j in range(G.nx) if not depth[i, j] < 0]
        c = math.cos(math.radians(G.mean_lat))
        for r in got:
            want = min(math.hypot((r.ix - j) * 0.5 * c, (r.iy - i) * 0.5) for i, j in land) * 111.32
            assert r.dist_coast == pytest.approx(want, abs=1e-9)


def test_coast_without_land_is_an_error(spark):
    with pytest.raises(Exception, match="no land"):
        coast.distance_to_coast(frame(spark, [np.full((G.ny, G.nx), -1.0)], name="depth").drop("time"), G).collect()


@pytest.mark.parametrize("tile", [4, 128])
def test_bilinear(spark, tile):
    a = [field(10, 0.15), field(11, 0.15)]
    target = Grid(9.8, 119.9, 0.2, 24, 30)
    got = grids(regrid.regrid_bilinear(frame(spark, a), target, "v", tile=tile), "v", shape=(target.ny, target.nx))
    for t in range(2):
        want = np.full((target.ny, target.nx), np.nan)
        for i in range(target.ny):
            for j in range(target.nx):
                y, x = round(((9.8 + i * 0.2) - 10.0) / 0.5, 9), round(((119.9 + j * 0.2) - 120.0) / 0.5, 9)
                if not (0 <= y <= G.ny - 1 and 0 <= x <= G.nx - 1):
                    continue
                y0, x0 = math.floor(y), math.floor(x)
                total = 0.0
                for dy, wy in ((0, 1 - (y - y0)), (1, y - y0)):
                    for dx, wx in ((0, 1 - (x - x0)), (1, x - x0)):
                        if wy * wx > 1e-9:
                            total += wy * wx * a[t][y0 + dy, x0 + dx]
                want[i, j] = total
        np.testing.assert_allclose(got[t], want, atol=1e-9)


def test_nearest_extrapolates_and_goes_low_on_ties(spark):
    g = Grid(0.0, 0.0, 1.0, 2, 2)
    df = frame(spark, [np.array([[1.0, 2.0], [3.0, 4.0]])], g)
    out = regrid.regrid_nearest(df, Grid(-1.0, -1.0, 0.5, 7, 7), "v")
    got = {(r.lat, r.lon): r.v for r in out.collect()}
    assert len(got) == 49
    assert got[(-1.0, -1.0)] == 1.0 and got[(2.0, 2.0)] == 4.0
    assert got[(0.5, 0.5)] == 1.0 and got[(0.5, 1.0)] == 2.0


def test_snap_is_half_even(spark):
    rows = spark.createDataFrame([(0.25,), (0.75,), (-0.25,), (12.34,)], "x double").select(geo.snap(F.col("x")).alias("s"))
    assert [r.s for r in rows.collect()] == [0.2, 0.8, -0.2, 12.3]


def test_regions_first_match_against_every_match(spark):
    point = spark.createDataFrame([(8.5, 118.0), (1.0, 1.0)], "lat double, lon double")
    first = [r.region for r in analytics.with_region(point).collect()]
    assert first[0].startswith("FMA2") and first[1] is None
    assert [r.region[:4] for r in analytics.by_every_region(point).collect()] == ["FMA2", "FMA3", "FMA5"]


def test_study_grid_shape():
    g = Grid.of_bbox()
    assert (g.ny, g.nx) == (171, 111)
    assert [len([1 for dy in range(-9, 10) for dx in range(-9, 10) if dx * dx + dy * dy <= g.radius_cells(km) ** 2]) for km in (20, 50, 100)] == [9, 69, 249]


def test_coarsening_cuts_incomplete_blocks(spark):
    a = np.arange(G.ny * G.nx, dtype=float).reshape(G.ny, G.nx)
    out = coarsen.coarsen_grid(frame(spark, [a]), G, 4, "v").collect()
    assert len(out) == 4
    assert {(r.by, r.bx): r.v for r in out}[(0, 0)] == a[:4, :4].mean()
