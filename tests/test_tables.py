"""Scores, catches, labels, quantiles, metrics, sources."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import names, scores
from gridloom.operators import catches, datasets, labels, metrics, quantiles, ranking
from gridloom.sources import catalog, catch_files


def test_missing_chlorophyll_scores_as_zero(spark):
    df = spark.createDataFrame([(28.0, None), (28.0, 0.0), (None, 1.0), (28.0, 10.0)], "sst double, chl double")
    got = [r.s for r in df.select(scores.habitat_suitability("scad").alias("s")).collect()]
    shoulder = math.sqrt(math.exp(-(0.2**2) / (2 * 0.66**2)))
    assert got[0] == pytest.approx(shoulder) and got[1] == pytest.approx(shoulder)
    assert got[2] is None and got[3] == pytest.approx(1.0)


def test_upwelling_of_a_missing_anomaly_is_missing(spark):
    df = spark.createDataFrame([(None,), (-2.0,), (3.0,)], "a double").select(scores.upwelling_proxy(F.col("a")).alias("u"))
    assert [r.u for r in df.collect()] == [None, 2.0, 0.0]


def test_splits_ignore_unparsable_dates(spark):
    df = spark.createDataFrame([("2022-12-31",), ("2024-01-01",), ("2025-05-05",), ("??",)], "time string")
    got = [tuple(r) for r in df.select(*[c.alias(n) for n, c in scores.split_masks(F.col("time")).items()]).collect()]
    assert got == [(True, False, False), (False, True, False), (False, False, True), (False, False, False)]


def test_granule_names(spark):
    df = spark.createDataFrame([("AQUA_MODIS.20180525_20180601.L3m.8D.nc",), ("x_20190102.nc",), ("plain.nc",)], "n string")
    got = df.select(names.granule_time(F.col("n")).cast("string").alias("t"), names.granule_year(F.col("n")).alias("y")).collect()
    assert [tuple(r) for r in got] == [("2018-05-28 12:00:00", 2018), ("2019-01-02 00:00:00", 2019), (None, None)]


def test_repeated_catch_keys_are_an_error(spark):
    features = spark.sql("SELECT 0 AS iy, 0 AS ix, DATE '2020-02-01' AS time")
    table = spark.createDataFrame([(0, 0, 2020, 1, 5.0), (0, 0, 2020, 1, 6.0)], "iy int, ix int, year int, quarter int, volume_mt double")
    with pytest.raises(Exception, match="repeats"):
        labels.with_catch_label(features, table).collect()
    assert labels.with_catch_label(features, table.limit(1)).first().label == 5.0


def test_species_without_catches_falls_back_to_habitat(spark):
    features = spark.sql("SELECT 0 AS iy, 0 AS ix, DATE '2020-02-01' AS time, 28.0D AS sst, 1.0D AS chl")
    table = spark.createDataFrame([("scad", 0, 0, 2020, 1, 5.0)], "species string, iy int, ix int, year int, quarter int, volume_mt double")
    assert labels.attach_labels(features, "scad", catches=table)[1] == "catch"
    assert labels.attach_labels(features, "anchovy", catches=table)[1] == "habitat"
    with pytest.raises(ValueError):
        labels.attach_labels(features.withColumn("sst", F.lit(None).cast("double")), "anchovy", "habitat_only")


def test_sulu_spellings_take_the_maximum(spark):
    rows = [("....Sulu", "scad", 2020, 1, 5.0), ("....Sulu a/", "scad", 2020, 1, 7.0), ("....Cebu", "scad", 2020, 1, 1.0), ("....Cebu", "scad", 2020, 1, 2.0), ("....Bohol", "scad", 2020, 1, None)]
    df = spark.createDataFrame(rows, "geo_raw string, species string, year int, quarter int, volume_mt double")
    got = {r.geo: r.volume_mt for r in catches.roll_up_species(catches.unify_variants(df)).collect()}
    assert got == {"Sulu": 7.0, "Cebu": 3.0}


def test_shared_cells_take_the_area_of_the_largest_volume(spark):
    rows = [(3, "scad", 2020, 1, 5.0, 10.04, 120.0), (2, "scad", 2020, 1, 5.0, 9.96, 120.0), (1, "scad", 2020, 1, 1.0, 10.0, 120.04)]
    df = spark.createDataFrame(rows, "fma int, species string, year int, quarter int, volume_mt double, lat double, lon double")
    assert [tuple(r) for r in catches.to_cells(df).collect()] == [(2, "scad", 2020, 1, 11.0, 10.0, 120.0)]


def test_quantiles_equal_numpy_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    data = {"hot": np.round(rng.exponential(size=30_000), 3), "flat": np.full(5_000, 2.5), "spread": rng.normal(size=9_001)}
    rows = [(k, float(v)) for k, a in data.items() for v in a]
    df = spark.createDataFrame(rows, "g string, v double")
    probs = {"a": 0.02, "b": 0.5, "c": 0.9, "d": 0.98, "lo": 0.0, "hi": 1.0}
    for r in quantiles.exact_quantiles(df, "v", probs, ["g"]).collect():
        for name, p in probs.items():
            assert r[name] == pytest.approx(np.quantile(data[r.g], p), abs=1e-12)


def test_rank_metrics_of_a_thousand_groups_and_a_hot_one(spark):
    rng = np.random.default_rng(7)
    rows = []
    for g in range(1000):
        n = int(rng.integers(1, 9))
        rows += [(f"g{g}", i, int(rng.random() < 0.5), float(rng.integers(0, 4)), float(rng.integers(0, 3))) for i in range(n)]
    rows += [("hot", i, int(rng.random() < 0.3), float(np.round(rng.random(), 2)), float(rng.normal())) for i in range(8000)]
    rows += [(None, i, i % 2, float(i), float(-i)) for i in range(5)]
    df = spark.createDataFrame(rows, "g string, k long, y_bin int, score double, y_cont double").repartition(5)
    auc = {r.g: r.roc_auc for r in metrics.roc_auc(df, by=["g"]).collect()}
    rho = {r.g: r.spearman for r in metrics.spearman(df, by=["g"]).collect()}
    hit = {r.g: r.hit_at_k for r in metrics.hit_at_k(df, by=["g"]).collect()}
    frame = pd.DataFrame(rows, columns=["g", "k", "y", "s", "c"])
    frame["g"] = frame["g"].fillna("-")
    assert len(auc) == len(rho) == len(hit) == 1002
    for g, own in frame.groupby("g"):
        g = None if g == "-" else g
        pos, ranks = own.y.sum(), own.s.rank()
        want = None if pos in (0, len(own)) else (ranks[own.y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(own) - pos))
        assert auc[g] == pytest.approx(want, abs=1e-12)
        want = None if own.s.nunique() < 2 or own.c.nunique() < 2 else np.corrcoef(ranks, own.c.rank())[0, 1]
        assert rho[g] == pytest.approx(want, abs=1e-9)
        top = own.sort_values(["s", "k"], ascending=[False, True]).head(pos)
        assert hit[g] == pytest.approx(top.y.mean() if pos else None)


def test_prefix_sums_follow_the_global_order(spark):
    rng = np.random.default_rng(1)
    values = rng.integers(0, 50, 2000)
    df = spark.createDataFrame([(i, int(v)) for i, v in enumerate(values)], "k int, v int").repartition(7)
    got = {r.k: r.s for r in ranking.prefix_sums(df, [F.col("v"), F.col("k")], {"s": F.col("v")}).collect()}
    order = sorted(range(2000), key=lambda i: (values[i], i))
    running = 0
    for i in order:
        assert got[i] == running
        running += int(values[i])


def test_rank_metrics_with_heavy_ties(spark):
    rng = np.random.default_rng(2)
    score = np.where(rng.random(900) < 0.4, 0.5, np.round(rng.random(900), 2))
    y = (rng.random(900) < score).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, score, rng.random(900)))], "k int, y_bin int, score double, y_cont double")
    pos, neg = score[y == 1], score[y == 0]
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert metrics.roc_auc(df).first()[0] == pytest.approx(pairs)
    top = sorted(range(900), key=lambda i: (-score[i], i))[: int(y.sum())]
    assert metrics.hit_at_k(df).first()[0] == pytest.approx(y[top].mean())
    assert metrics.spearman(df.withColumn("score", F.lit(1.0))).first()[0] is None
    assert metrics.spearman(df, "score", "score").first()[0] == pytest.approx(1.0)
    assert metrics.roc_auc(df.where("y_bin = 1")).first()[0] is None


def test_class_metrics_are_zero_where_undefined(spark):
    df = spark.createDataFrame([(0, 0), (1, 0)], "y_bin int, predicted int")
    assert tuple(metrics.class_metrics(df).first()) == (0.5, 0.0, 0.0, 0.0)


def test_medians_and_imputation(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (None, None), (4.0, None)], "a double, b double")
    medians = {r.feature: r.median for r in datasets.imputer_medians(df, ["a", "b"]).collect()}
    assert medians == {"a": 2.0, "b": 0.0}
    ready = datasets.impute(datasets.as_model_input(df, ["a", "b"]), ["a", "b"], datasets.imputer_medians(df, ["a", "b"]))
    assert ready.where("a IS NULL OR b IS NULL").count() == 0


def test_feature_resolution():
    assert datasets.resolve_features(["sst_anom", "depth", "x"]) == ["sst_anom", "depth"]
    with pytest.raises(ValueError):
        datasets.resolve_features(["x"])


def test_manifest_upsert_is_idempotent(spark, tmp_path):
    empty = catalog.load_manifest(spark, str(tmp_path / "none"))
    new = spark.createDataFrame([("s", "g1", 5), ("s", "g2", 6), ("s", "g1", 7)], "short_name string, granule_name string, size_bytes bigint").coalesce(1)
    once = catalog.append_manifest(empty, new.withColumn("seq", F.monotonically_increasing_id()), "seq")
    assert {(r.granule_name, r.size_bytes) for r in once.collect()} == {("g1", 7), ("g2", 6)}
    assert sorted(map(str, catalog.append_manifest(once, once.withColumn("seq", F.lit(0)), "seq").collect())) == sorted(map(str, once.collect()))


def test_catch_files(spark, tmp_path):
    assert catch_files.load_catches(spark, str(tmp_path / "none")).count() == 0
    spark.range(1).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="lacks"):
        catch_files.load_catches(spark, str(tmp_path / "bad"))
    path = str(tmp_path / "template")
    catch_files.write_template(spark, path)
    assert catch_files.load_catches(spark, path).count() == 30
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        catch_files.write_template(spark, path)


def test_sector_needs_exactly_one_code(spark):
    df = spark.createDataFrame([("a_2e4gvcp0.xlsx",), ("2E4GVMP0 (2).xlsx",), ("2E4GVCP0_2E4GVMP0",), ("x",)], "f string")
    got = [r.s for r in df.select(names.sector_of_file(F.col("f"), config.SECTOR_CODES, config.OTHER_SECTOR).alias("s")).collect()]
    assert got == ["commercial", "municipal", "extra", "extra"]
