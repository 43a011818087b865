"""Staged scores, patience and truncated ensembles against scoring each stage by itself."""

import math

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.plans import boosting, learning
from registry import evaluation


@pytest.fixture(scope="module")
def noisy(spark):
    """One weak feature and many of pure noise: boosting overfits early."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(240):
        x = rng.normal(size=6)
        p = 1 / (1 + math.exp(-1.5 * x[0]))
        rows.append((i, *map(float, x), int(rng.random() < p), float(x[0] + rng.normal()), i < 120))
    return spark.createDataFrame(rows, "k long, f0 double, f1 double, f2 double, f3 double, f4 double, f5 double, y_bin int, y double, train boolean").coalesce(2).persist()


FEATURES = [f"f{i}" for i in range(6)]


def test_patience_keeps_the_first_best_stage():
    inf = float("-inf")
    assert boosting.kept_stage([0.5, 0.7, 0.7, 0.6, 0.9], 2) == 2
    assert boosting.kept_stage([0.5, 0.7, 0.7, 0.6, 0.9], 3) == 5
    assert boosting.kept_stage([inf, 0.1], 5) == 2 and boosting.kept_stage([0.3], 1) == 1


@pytest.mark.parametrize("classify", [True, False])
def test_the_kept_stage_is_that_of_scoring_every_stage(spark, noisy, classify):
    pipeline = learning.make_learner("GBT", FEATURES, classify, trees=14, depth=3, rate=0.3)
    train, val = noisy.where("train"), noisy.where("NOT train")
    fitted = pipeline.fit(train)
    measures = boosting.stage_measures(fitted, val, classify)
    assert len(measures) == 14
    for stage in (1, 2, 7, 14):
        scored = boosting.first_trees(fitted, stage).transform(val)
        if classify:
            want = metrics.roc_auc(scored.withColumn("score", vector_to_array("rawPrediction")[1])).first()[0]
        else:
            want = -metrics.regression_metrics(scored).first()["rmse"]
        assert measures[stage - 1] == pytest.approx(want, abs=1e-9)
    kept, stage, measure = boosting.fit_with_patience(pipeline, train, val, classify, 4)
    assert stage == boosting.kept_stage(measures, 4) == kept.stages[-1].getNumTrees < 14
    assert measure == pytest.approx(abs(measures[stage - 1]))
    # Cutting at the end changes nothing.
    whole = boosting.first_trees(fitted, 14).transform(val).select("k", "prediction").orderBy("k").collect()
    assert whole == fitted.transform(val).select("k", "prediction").orderBy("k").collect()


def test_one_class_or_no_validation_rows_keep_all_trees(noisy):
    pipeline = learning.make_learner("GBT", FEATURES, True, trees=3, depth=2)
    for val in (noisy.where("NOT train AND y_bin = 1"), noisy.where("false")):
        kept, stage, measure = boosting.fit_with_patience(pipeline, noisy.where("train"), val, True, 2)
        assert stage == 3 == kept.stages[-1].getNumTrees and math.isnan(measure)


def test_short_fits_first_give_the_model_of_the_whole_fit(noisy, monkeypatch):
    """up to 1000 trees are affordable because a fit whose patience ends early is not made in full."""
    assert boosting._lengths(1000, 50) == [100, 300, 1000] and boosting._lengths(20, 50) == [20]
    pipeline = learning.make_learner("GBT", FEATURES, True, trees=24, depth=3, rate=0.3)
    train, val = noisy.where("train"), noisy.where("NOT train")
    whole = pipeline.fit(train)
    want = boosting.kept_stage(boosting.stage_measures(whole, val, True), 3)
    lengths, measured = [], boosting.stage_measures
    monkeypatch.setattr(boosting, "stage_measures", lambda fitted, *a: lengths.append(fitted.stages[-1].getNumTrees) or measured(fitted, *a))
    kept, stage, _ = boosting.fit_with_patience(pipeline, train, val, True, 3)
    assert stage == want and lengths == ([6] if want <= 3 else [6, 24])
    scored = [m.transform(val).select("k", "rawPrediction").orderBy("k").collect() for m in (kept, boosting.first_trees(whole, want))]
    assert scored[0] == scored[1]


class Seen(Exception):
    """The settings with which a registered query makes its fits."""


@pytest.fixture
def small_tables(spark, monkeypatch):
    names = [n for n in evaluation.REQUESTED if n != "sst"]
    day = F.date_add(F.lit("1999-01-01").cast("date"), F.col("id").cast("int") * 8)
    table = spark.range(120).select(F.lit(0).alias("iy"), F.lit(0).alias("ix"), day.alias("time"), F.col("id").cast("double").alias("sst"), *[F.rand(3).alias(n) for n in names])
    quarters = [(s, y, q, 0, 0, float(y % 7 + q)) for s in evaluation.SPECIES for y in (1999, 2000, 2001) for q in (1, 2, 3, 4)]
    catches = spark.createDataFrame(quarters, "species string, year int, quarter int, iy int, ix int, volume_mt double")
    monkeypatch.setattr(evaluation.t, "matrix", lambda *_: table)
    monkeypatch.setattr(evaluation.t, "catches", lambda *_: catches)


def test_the_registered_classifier_is_fitted_in_full(spark, monkeypatch, small_tables):
    """1000 trees of depth 6 and a patience of 50, which 20 trees could not reach."""

    def seen(pipeline, train, validation, classify, patience):
        learner = pipeline.getStages()[-1]
        raise Seen(learner.getMaxIter(), learner.getMaxDepth(), patience, classify)

    monkeypatch.setattr(boosting, "fit_with_patience", seen)
    with pytest.raises(Seen) as found:
        evaluation.train_gbt_classifier(spark, "")
    assert found.value.args == (1000, 6, 50, True)


def test_the_registered_study_is_fitted_in_full(spark, monkeypatch, small_tables):
    """boosting of up to 1000 trees of depth 6 and forests of 200 of depth 22, not 20 trees of depth 5."""
    make, found = learning.make_learner, {}

    def small(name, features, classify=False, rows=1, **settings):
        learner = make(name, features, classify, rows, **settings).getStages()[-1]
        if name != "Linear":
            found[name] = (learner.getMaxIter() if name == "GBT" else learner.getNumTrees(), learner.getMaxDepth())
        return make(name, features, classify, rows, **settings | {"trees": 2, "depth": 2})

    monkeypatch.setattr(learning, "make_learner", small)
    monkeypatch.setattr(evaluation, "SPECIES", ["scad"])
    table = evaluation.benchmark_table(spark, "").collect()
    assert found == {"GBT": (1000, 6), "RandomForest": (200, 22)}
    assert sorted(r.algorithm for r in table) == sorted(learning.REGRESSORS)
