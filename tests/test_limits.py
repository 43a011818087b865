"""What used to have limits: many or large groups, wide disks, steps off the axis, arrival order."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.operators import catches, histograms, neighbourhood, quantiles, ranking, temporal
from gridloom.operators.grid import Grid
from gridloom.sources import catalog, observations


def test_quantiles_of_ten_thousand_groups(spark):
    df = spark.range(40_000).select((F.col("id") % 10_000).alias("g"), F.floor(F.col("id") / 10_000).cast("double").alias("v"))
    got = quantiles.exact_quantiles(df, "v", {"median": 0.5, "top": 1.0}, ["g"], totals=True)
    assert got.agg(F.count("g"), F.min("median"), F.max("median"), F.min("top"), F.min("count")).first() == (10_000, 1.5, 1.5, 3.0, 4)


def test_quantile_of_one_group_over_many_partitions(spark):
    rng = random.Random(1)
    values = [rng.gauss(0, 1) for _ in range(5000)] + [0.5] * 3000
    df = spark.createDataFrame([("a", v) for v in values] + [(None, 1.0), (None, 3.0), ("b", None)], "g string, v double").repartition(16)
    got = {r.g: r for r in quantiles.exact_quantiles(df, "v", {"q10": 0.1, "q90": 0.9}, ["g"]).collect()}
    assert set(got) == {"a", None}
    assert got["a"].q10 == pytest.approx(np.quantile(values, 0.1)) and got["a"].q90 == pytest.approx(np.quantile(values, 0.9))
    assert got[None].q10 == pytest.approx(1.2)
    whole = quantiles.exact_quantiles(df.where("g = 'a'"), "v", {"m": 0.5}).first()
    assert whole.m == pytest.approx(statistics.median(values))


def test_quantiles_of_neighbouring_doubles_extremes_and_other_types(spark):
    near = [1.0]
    for _ in range(400):
        near.append(float(np.nextafter(near[-1], 2.0)))
    data = {
        "near": near, "tiny": [5e-324 * i for i in range(50)], "wide": [-1.7e308, -1.0, -5e-324, 0.0, 1e-300, 3.0, 1.7e308],
        "mixed": [float(np.float64(m) * 10.0 ** e) for e in range(-30, 30) for m in (-3.7, 1.1, 9.9)],
    }
    df = spark.createDataFrame([(k, v) for k, a in data.items() for v in a], "g string, v double").repartition(7)
    probs = {f"p{i}": i / 8 for i in range(9)}
    for few in (False, True):
        got = quantiles.exact_quantiles(df, "v", probs, ["g"], few_groups=few).collect()
        assert {r.g for r in got} == set(data)
        for r in got:
            values = sorted(data[r.g])
            for name, p in probs.items():
                at = round((len(values) - 1) * p, 9)
                lo, hi = values[int(at)], values[-int(-at // 1)]
                want = lo if lo == hi else lo + (hi - lo) * (at - int(at))
                assert r[name] == want, (r.g, name)
    ends = spark.createDataFrame([(float("-inf"),), (1.0,), (float("inf"),), (float("inf"),)], "v double")
    assert tuple(quantiles.exact_quantiles(ends, "v", {"a": 0.0, "b": 1 / 3, "c": 1.0}).first()) == (float("-inf"), 1.0, float("inf"))
    whole = quantiles.exact_quantiles(spark.range(101), "id", {"m": 0.25}, totals=True).first()
    assert tuple(whole) == (101, 50.0, 100.0, 25.0)
    assert quantiles.exact_quantiles(ends.where("v = 7"), "v", {"m": 0.5}).count() == 0


def test_quantiles_store_nothing_and_shuffle_the_values_once(spark, monkeypatch):
    monkeypatch.setattr(ranking, "pin", lambda df: pytest.fail("a checkpoint while the plan is built"))
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.rand(1).alias("v"))
    out = quantiles.exact_quantiles(df, "v", {"m": 0.5}, ["g"], few_groups=True)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Range (") == 1 and "ReusedExchange" in plan and "rangepartitioning" not in plan


def test_histogram_keeps_a_group_without_a_name(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(10)] + [(None, 5.0), (None, 5.0)], "g string, v double")
    got = {(r.g, r.bin): r.n for r in histograms.density_histogram(df, "v", 2, ["g"]).collect()}
    assert got == {("a", 0): 5, ("a", 1): 5, (None, 0): 2}


def test_a_disk_wider_than_a_tile(spark):
    n = 300
    rows = spark.range(n).select(F.lit("t").alias("time"), F.lit(0).alias("iy"), F.col("id").cast("int").alias("ix"), F.col("id").cast("double").alias("v"))
    got = neighbourhood.neighbourhood_means(rows, Grid(0.0, 0.0, 1.0, 1, n), {"m": ("v", 140.0)}).where("ix = 150").first()
    assert got.m == pytest.approx(150.0)


def test_gap_filling_refuses_what_is_not_on_the_axis(spark):
    pixels = spark.createDataFrame([("a", 0, 0, "2000-01-01", 1.0), ("b", 0, 0, "2000-01-09", 2.0)], "variable string, iy int, ix int, time string, value double").withColumn("time", F.to_date("time"))
    only_a = pixels.where("variable = 'a'").select("variable", "time")
    with pytest.raises(Exception, match="not on the time axis: b"):
        temporal.gap_fill(pixels, axis_from=only_a).collect()
    assert temporal.gap_fill(pixels.where("variable = 'a'"), axis_from=only_a).count() == 1
    with pytest.raises(Exception, match="not on the time axis"):
        temporal.densify(pixels.withColumnRenamed("value", "v"), Grid(0.0, 0.0, 1.0, 1, 1), ["v"], axis_from=only_a).collect()


def test_arrival_order_is_a_column(spark):
    manifest = spark.createDataFrame([("s", "g1", 1)], "short_name string, granule_name string, size_bytes bigint")
    new = spark.createDataFrame([("s", "g1", 9, 2), ("s", "g1", 8, 7), ("s", "g2", 5, 1)], "short_name string, granule_name string, size_bytes bigint, seq int")
    got = {r.granule_name: r.size_bytes for r in catalog.append_manifest(manifest, new.repartition(3), "seq").collect()}
    assert got == {"g1": 8, "g2": 5}


def test_rows_without_a_place_name_are_kept(spark):
    rows = [("f", None, "scad", 2020, 1, 5.0), ("f", "....Sulu", "scad", 2020, 1, 5.0), ("f", "....Sulu a/", "scad", 2020, 1, 6.0), ("g", "....Sulu", "scad", 2020, 1, 7.0)]
    df = spark.createDataFrame(rows, "file string, geo_raw string, species string, year int, quarter int, volume_mt double")
    assert sorted((r.file, r.volume_mt) for r in catches.unify_variants(df).collect()) == [("f", 5.0), ("f", 6.0), ("g", 7.0)]


def test_samples_are_exact_and_repeatable(spark):
    df = spark.range(3000).select((F.col("id") % 50).alias("a"), F.col("id").alias("b"))
    one = ranking.seeded_sample(df, ["a", "b"], 700)
    assert one.count() == 700 and one.distinct().count() == 700
    assert sorted(one.collect()) == sorted(ranking.seeded_sample(df.repartition(9), ["a", "b"], 700).collect())
    assert ranking.seeded_sample(df, ["a", "b"], 5000).count() == 3000


def test_skipped_files_are_named(spark, tmp_path):
    df = spark.createDataFrame([("sst", "2000-01-01", 5.0, 117.0, 1.0)], "variable string, time string, lat double, lon double, value double").withColumn("time", F.to_date("time"))
    observations.write_observations(df, str(tmp_path / "o"))
    assert observations.skipped_files(spark, str(tmp_path / "o")).count() == 0
    bad = tmp_path / "o" / "variable=sst" / "year=2000" / "zz-bad.parquet"
    bad.write_bytes(b"PAR1 no table PAR1")
    assert [r.file for r in observations.skipped_files(spark, str(tmp_path / "o")).collect()] == [str(bad)]
    assert observations.read_observations(spark, str(tmp_path / "o"), "sst").count() == 1


def test_half_read_files_are_named_and_empty_ones_are_not(spark, tmp_path):
    rows = spark.range(60_000, numPartitions=1).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    rows.write.option("parquet.block.size", 1 << 18).parquet(str(tmp_path / "o" / "a"))
    rows.where("id < 0").coalesce(1).write.parquet(str(tmp_path / "o" / "b"))
    assert observations.skipped_files(spark, str(tmp_path / "o")).collect() == []
    before = observations.file_rows(spark, str(tmp_path / "o")).where("read > 0").collect()
    assert [(r.promised, r.read) for r in before] == [(60_000, 60_000)]
    whole = next((tmp_path / "o" / "a").glob("*.parquet"))
    data = bytearray(whole.read_bytes())
    middle = len(data) * 2 // 3
    data[middle : middle + 5000] = bytes(5000)
    half = tmp_path / "o" / "a" / "half.parquet"
    half.write_bytes(data)
    (tmp_path / "o" / "a" / "cut.parquet").write_bytes(data[: middle])
    got = {r.file.rsplit("/", 1)[1]: (r.promised, r.read) for r in observations.skipped_files(spark, str(tmp_path / "o")).collect()}
    assert set(got) == {"half.parquet", "cut.parquet"}
    assert got["half.parquet"][0] == 60_000 and got["half.parquet"][1] < 60_000 and got["cut.parquet"] == (None, 0)
