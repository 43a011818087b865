"""Hand-computed cases for the time operators."""

import datetime as dt

import pytest

from gridloom.operators import cube, temporal
from gridloom.operators.grid import Grid

START = dt.date(2020, 1, 1)
GRID = Grid(0.0, 0.0, 1.0, 1, 2)


def day(step):
    return START + dt.timedelta(days=8 * step)


def pixels(spark, series, steps, variable="v"):
    """Cell 0 carries the series; cell 1 is observed at every step, which fixes the axis."""
    rows = [(variable, 0, 0, day(s), float(v)) for s, v in series.items()]
    rows += [(variable, 0, 1, day(s), 1.0) for s in range(steps)]
    return spark.createDataFrame(rows, "variable string, iy int, ix int, time date, value double")


def filled(spark, series, steps, cap):
    out = temporal.gap_fill(pixels(spark, series, steps), cap).where("ix = 0").collect()
    return {(r.time - START).days // 8: r.value for r in out}


def test_inner_gap_at_and_above_the_cap(spark):
    assert filled(spark, {0: 0, 5: 5, 9: 9}, 10, 4) == pytest.approx({i: float(i) for i in range(10)})
    assert set(filled(spark, {0: 0, 6: 6, 9: 9}, 10, 4)) == {0, 6, 7, 8, 9}


def test_edges_continue_the_line(spark):
    got = filled(spark, {2: 10, 3: 12}, 6, 4)
    assert got == pytest.approx({0: 6, 1: 8, 2: 10, 3: 12, 4: 14, 5: 16})


def test_long_edges_and_single_values_stay_empty(spark):
    assert set(filled(spark, {5: 1, 6: 2}, 12, 4)) == {5, 6}
    assert set(filled(spark, {3: 1}, 6, 4)) == {3}


def test_no_cap_fills_everything(spark):
    assert set(filled(spark, {0: 0, 9: 9}, 10, None)) == set(range(10))


def test_valid_values_never_change(spark):
    p = pixels(spark, {0: 3, 4: 7, 5: 1, 9: 2}, 12)
    kept = temporal.gap_fill(p, 4).where("NOT filled").drop("filled")
    assert sorted(map(tuple, kept.collect())) == sorted(map(tuple, p.collect()))


def test_axes_are_per_variable(spark):
    both = pixels(spark, {0: 0, 2: 2}, 3, "a").unionByName(
        spark.createDataFrame([("b", 0, 0, day(s), float(s)) for s in (0, 2)], "variable string, iy int, ix int, time date, value double")
    )
    out = temporal.gap_fill(both, 4).where("ix = 0").collect()
    assert {(r.variable, (r.time - START).days // 8) for r in out} == {("a", 0), ("a", 1), ("a", 2), ("b", 0), ("b", 2)}


def test_densify_covers_cells_without_any_observation(spark):
    df = spark.createDataFrame([(0, 0, day(1), 5.0), (0, 0, day(3), 6.0)], "iy int, ix int, time date, v double")
    rows = temporal.densify(df, GRID, ["v"]).collect()
    assert len(rows) == 4
    assert {(r.ix, r.time): r.v for r in rows} == {(0, day(1)): 5.0, (0, day(3)): 6.0, (1, day(1)): None, (1, day(3)): None}


@pytest.mark.parametrize("steps, expected", [(1, [1, None, 5, 9]), (2, [1, 1, 5, 7]), (3, [1, 3, 7, 7]), (4, [1, 3, 5, 7])])
def test_rolling_frames(spark, steps, expected):
    df = spark.createDataFrame([(0, 0, day(i), v) for i, v in enumerate([1.0, None, 5.0, 9.0])], "iy int, ix int, time date, v double")
    got = [r.m for r in df.select("time", temporal.rolling_mean("v", steps).alias("m")).orderBy("time").collect()]
    assert got == expected


def test_window_lengths_round_half_to_even():
    assert [temporal.steps_of(d, 8) for d in (7, 14, 30, 90)] == [1, 2, 4, 11]
    assert temporal.steps_of(20, 8) == 2 and temporal.steps_of(28, 8) == 4
    assert temporal.steps_of(30, 0) == 30


def test_anomalies_cancel_within_cell_and_month(spark):
    df = spark.createDataFrame([(0, 0, day(i), float(i * i)) for i in range(60)], "iy int, ix int, time date, v double")
    sums = temporal.with_anomalies(df, ["v"]).groupBy("iy", "ix").agg({"v_anom": "sum"}).first()[2]
    assert abs(sums) < 1e-6


def test_nearest_time_prefers_the_earlier(spark):
    df = spark.createDataFrame([(0, 0, dt.date(2020, 1, 1)), (0, 0, dt.date(2020, 1, 9))], "iy int, ix int, time date")
    assert temporal.at_nearest_time(df, "2020-01-05").first().time == dt.date(2020, 1, 1)
    assert temporal.at_nearest_time(df, "2021-01-05").first().time == dt.date(2020, 1, 9)


def test_assembling_unites_time_axes(spark):
    rows = [("a", 0, 0, day(0), 1.0), ("b", 0, 0, day(1), 2.0)]
    p = spark.createDataFrame(rows, "variable string, iy int, ix int, time date, value double")
    got = {r.time: (r.a, r.b) for r in cube.assemble(p, ["a", "b"]).collect()}
    assert got == {day(0): (1.0, None), day(1): (None, 2.0)}
