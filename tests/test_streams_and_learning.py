"""Streams against their batch twins, saved models, and the study drivers."""

import pytest
from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.plans import forecasts, learning
from gridloom.sources import catalog
from gridloom.streaming import ingest
from registry import tables
from registry.evaluation import REQUESTED, SMALL

SF = "/root/testdata/sf0.001"


def test_stream_dedupe_over_several_files(spark, tmp_path):
    events = tables.read(spark, SF, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    events.repartitionByRange(4, "ts").write.parquet(str(tmp_path / "in"))
    stream = ingest.granule_stream(spark, str(tmp_path / "in"), events.schema, files_per_trigger=1)
    fresh = ingest.first_per_key(tables.granule_columns(stream)).select("short_name", "granule_name")
    for _ in range(2):  # the second run finds nothing new
        ingest.run_available(fresh, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
        got = spark.read.parquet(str(tmp_path / "out"))
        want = tables.granules(spark, SF).select("short_name", "granule_name").distinct()
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_stream_composites_equal_batch_for_closed_windows(spark, tmp_path):
    points = tables.read(spark, SF, "events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("cell"), "value")
    points.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(points.schema).parquet(str(tmp_path / "in"))
    ingest.run_available(ingest.composite(stream, ["cell"]), str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    got = {(r.window_start, r.cell): (round(r.value, 9), r.n) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {(r.window_start, r.cell): (round(r.value, 9), r.n) for r in ingest.composite(points, ["cell"]).collect()}
    # Windows that end before (latest event - 8 days) are closed and must be complete.
    last = points.agg(F.max("ts")).first()[0]
    closed = {k: v for k, v in batch.items() if (last - k[0]).days >= 16}
    assert closed and all(got.get(k) == v for k, v in closed.items())
    assert all(batch[k] == v for k, v in got.items())


ENTRY = "seq long, short_name string, granule_name string, size_bytes long"


def _manifest(spark, path):
    return sorted((r.granule_name, r.seq, r.size_bytes) for r in ingest.read_manifest(spark, path, ENTRY).collect())


def test_a_repeated_batch_changes_nothing_and_a_broken_one_is_done_again(spark, tmp_path):
    path = str(tmp_path / "manifest")
    batch = lambda *rows: spark.createDataFrame([(s, "P", g, b) for s, g, b in rows], ENTRY)
    assert _manifest(spark, path) == []
    assert ingest.upsert_batch(batch((1, "a", 10), (2, "a", 20), (3, "b", 30)), 0, path, "one")
    first = _manifest(spark, path)
    assert first == [("a", 2, 20), ("b", 3, 30)]
    assert not ingest.upsert_batch(batch((9, "a", 99)), 0, path, "one") and _manifest(spark, path) == first
    # Another stream counts its own batches, and the first one's are still known after it.
    assert ingest.upsert_batch(batch((4, "b", 40)), 0, path, "two")
    assert not ingest.upsert_batch(batch((9, "a", 99)), 0, path, "one")
    # A version that was never finished is not read, and written anew.
    versions = sorted(p.name for p in (tmp_path / "manifest").iterdir())
    broken = tmp_path / "manifest" / "version-000000000002" / "entries"
    batch((8, "c", 80)).write.parquet(str(broken))
    assert len(versions) == 2 and _manifest(spark, path) == [("a", 2, 20), ("b", 4, 40)]
    assert ingest.upsert_batch(batch((5, "c", 50)), 1, path, "one")
    assert _manifest(spark, path) == [("a", 2, 20), ("b", 4, 40), ("c", 5, 50)]
    assert sorted(p.name for p in (tmp_path / "manifest").iterdir()) == ["version-000000000001", "version-000000000002"]


def test_a_manifest_stream_restarts_midway(spark, tmp_path, monkeypatch):
    granules = tables.granules(spark, SF).select("seq", "short_name", "granule_name", "size_bytes")
    granules.repartitionByRange(6, "seq").write.parquet(str(tmp_path / "in"))
    stream = ingest.granule_stream(spark, str(tmp_path / "in"), ENTRY, files_per_trigger=2)
    path, whole = str(tmp_path / "manifest"), ingest.upsert_batch

    def stopping(batch, number, *rest):
        whole(batch, number, *rest)
        if number == 1:
            raise RuntimeError("lost after the batch was merged, before it was noted")

    monkeypatch.setattr(ingest, "upsert_batch", stopping)
    with pytest.raises(Exception, match="lost after"):
        ingest.manifest_sink(stream, path, str(tmp_path / "checkpoint"), "granules")
    monkeypatch.setattr(ingest, "upsert_batch", whole)
    done = len(list((tmp_path / "manifest").iterdir()))
    ingest.manifest_sink(stream, path, str(tmp_path / "checkpoint"), "granules")
    want = catalog.upsert(granules)
    assert done == 2 and _manifest(spark, path) == sorted((r.granule_name, r.seq, r.size_bytes) for r in want.collect())


@pytest.fixture(scope="module")
def bundle(spark):
    return learning.train(tables.matrix(spark, SF), "scad", tables.catches(spark, SF), requested=REQUESTED, splits=tables.splits(), **SMALL)


def test_bundle_roundtrip(spark, bundle, tmp_path):
    path = str(tmp_path / "scad")
    assert learning.save_bundle(bundle, path, spark)
    assert not learning.save_bundle(bundle, path, spark)
    again = learning.load_bundle(spark, path)
    matrix = tables.matrix(spark, SF)
    a = learning.predict(bundle, matrix).agg(F.sum("prediction")).first()[0]
    b = learning.predict(again, matrix).agg(F.sum("prediction")).first()[0]
    assert a == pytest.approx(b) and again.label_kind == "catch" and again.transform == "log1p"


def test_model_forecast_covers_every_cell_of_the_composite(spark, bundle):
    matrix = tables.matrix(spark, SF)
    latest = matrix.where(F.col("time") == matrix.agg(F.max("time")).scalar())
    assert forecasts.forecast(matrix, "scad", bundle=bundle).count() == latest.count()
    ocean = forecasts.forecast(matrix, "scad", bundle=bundle, ocean_only=True).count()
    assert ocean == latest.where("depth < 0").count()


def test_report_and_importances(spark, bundle):
    report = learning.report_table(spark, [bundle]).first()
    assert report.n_train > 0 and report.species == "scad"
    weights = [r.importance for r in learning.importances(bundle, spark).collect()]
    assert weights == sorted(weights, reverse=True) and sum(weights) == pytest.approx(1.0)


def test_classifier_study(spark):
    table = learning.compare_classifiers(
        tables.matrix(spark, SF), ["scad"], ["NoSkill"], tables.catches(spark, SF), requested=REQUESTED, splits=tables.splits()
    )
    assert {r.window for r in table.collect()} == {"val", "test"}
    assert all(r.spearman is None for r in table.collect())


@pytest.mark.parametrize("learner", ["RandomForest", "Linear"])
def test_every_learner_is_reported_and_saved(spark, learner, tmp_path):
    options = {} if learner == "Linear" else SMALL
    made = learning.train_all(
        tables.matrix(spark, SF), ["scad"], str(tmp_path), tables.catches(spark, SF), requested=REQUESTED, splits=tables.splits(), learner=learner, **options
    ).first()
    assert made.fitted and sum(i.importance for i in made.feature_importance) == pytest.approx(1.0)
    again = learning.train_all(
        tables.matrix(spark, SF), ["scad"], str(tmp_path), tables.catches(spark, SF), requested=REQUESTED, splits=tables.splits(), learner=learner, **options
    ).first()
    assert not again.fitted and again.n_train == made.n_train and again.val_metrics["rmse"] == pytest.approx(made.val_metrics["rmse"])


def test_unified_study_feeds_the_ranking(spark):
    table = learning.unified_study(
        tables.matrix(spark, SF), ["scad"], ["Linear", "NoSkill"], tables.catches(spark, SF), requested=REQUESTED, splits=tables.splits()
    )
    rows = {r.algorithm: r for r in table.collect()}
    assert set(rows) == {"Linear", "NoSkill"} and all(r.threshold is not None and r.n_train > 0 and r.rmse_val >= 0 for r in rows.values())
    assert rows["NoSkill"].roc_auc_val in (0.5, None) and rows["NoSkill"].spearman_val is None
    ranked = metrics.algorithm_ranking(table.withColumnsRenamed({f"{m}_val": m for m in ("r2", "rmse", "mae")}), ["r2", "rmse", "mae"])
    assert ranked.count() == 2
