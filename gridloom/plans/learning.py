"""Training, scoring and comparing learners with Spark ML."""

from __future__ import annotations

import time as clock
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import partial
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridloom import config
from gridloom.functions import scores
from gridloom.operators import datasets, labels, metrics
from gridloom.plans import boosting
from gridloom.session import scratch_path

T = TypeVar("T")

REGRESSORS = ("GBT", "RandomForest", "Linear", "NoSkill")
CLASSIFIERS = REGRESSORS
CLASS_MEASURES = ("accuracy", "precision", "recall", "f1", "roc_auc", "spearman", "hit_at_k")


@dataclass(frozen=True)
class Bundle:
    """Everything needed to score new rows."""

    species: str
    label_kind: str
    transform: str | None
    features: list[str]
    medians: dict[str, float]
    model: PipelineModel
    report: dict = field(default_factory=dict)


def _stages(features: list[str], learner, scaled: bool = False) -> Pipeline:
    assembler = VectorAssembler(inputCols=features, outputCol="raw" if scaled else "inputs")
    scaler = [StandardScaler(inputCol="raw", outputCol="inputs", withMean=True, withStd=True)] if scaled else []
    return Pipeline(stages=[assembler, *scaler, learner])


def make_learner(name: str, features: list[str], classify: bool = False, rows: int = 1, **settings):
    """An unfitted pipeline. ``settings`` override tree counts and depths."""
    gbt, forest = {**config.BOOSTED_TREES, **settings}, {**config.FOREST, **settings}
    common = {"featuresCol": "inputs", "labelCol": "y_bin" if classify else "y"}
    if name == "GBT":
        kind = GBTClassifier if classify else GBTRegressor
        return _stages(features, kind(
            maxIter=gbt["trees"], maxDepth=gbt["depth"], stepSize=gbt["rate"], subsamplingRate=gbt["rows"],
            featureSubsetStrategy=str(gbt["columns"]), seed=gbt["seed"], **common,
        ))
    if name == "RandomForest":
        kind = RandomForestClassifier if classify else RandomForestRegressor
        return _stages(features, kind(
            numTrees=forest["trees"], maxDepth=forest["depth"], minInstancesPerNode=forest["min_leaf"],
            seed=forest["seed"], **common,
        ))
    if name == "Linear":
        # The penalty is averaged over rows here: alpha / n equals a summed penalty of alpha.
        penalty = settings.get("alpha", config.RIDGE_ALPHA) / max(rows, 1)
        learner = (
            LogisticRegression(maxIter=config.LOGISTIC_ITERATIONS, regParam=penalty, standardization=False, **common)
            if classify
            else LinearRegression(regParam=penalty, elasticNetParam=0.0, standardization=False, solver="normal", **common)
        )
        return _stages(features, learner, scaled=True)
    raise ValueError(f"unknown learner {name!r}")


def predict(bundle: Bundle, frame: DataFrame) -> DataFrame:
    """Adds ``prediction`` on the label's own scale; missing features take the stored medians."""
    absent = {f: F.lit(None).cast("float") for f in bundle.features if f not in frame.columns}
    ready = datasets.as_model_input(frame.withColumns(absent) if absent else frame, bundle.features)
    scored = bundle.model.transform(datasets.impute(ready, bundle.features, bundle.medians))
    return scored.withColumn("prediction", scores.from_target(F.col("prediction"), bundle.transform)).drop("inputs", "raw")


def importances(bundle: Bundle, spark: SparkSession, top: int | None = None) -> DataFrame:
    """Features that the model used, most important first (one row per feature).

    Trees weigh by impurity; for linear models it is the share of the absolute coefficient, on
    standardised inputs.
    """
    model = bundle.model.stages[-1]
    weights = model.featureImportances if hasattr(model, "featureImportances") else abs(model.coefficients.toArray())
    total = sum(weights) or 1.0
    weights = [w / total for w in weights]
    rows = [(f, float(weights[i])) for i, f in enumerate(bundle.features)]
    table = spark.createDataFrame(rows, "feature string, importance double").where(F.col("importance") > 0)
    ordered = table.orderBy(F.desc("importance"), "feature")
    return ordered if top is None else ordered.limit(top)


@dataclass(frozen=True)
class Prepared:
    rows: DataFrame
    features: list[str]
    medians: dict[str, float]
    label_kind: str
    transform: str | None


@dataclass(frozen=True)
class Inputs:
    """A feature table, its catches and the medians of its features, worked out once for all passes and species."""

    matrix: DataFrame
    catches: DataFrame | None
    features: list[str]
    medians: dict[str, float]


def inputs(matrix: DataFrame, catches: DataFrame | None = None, requested: list[str] | None = None) -> Inputs:
    """Both tables written below the shared folder and read from there, so that what made them runs once; the
    catches of a species then have a known size, by which the label join is planned. Reads back one median per feature."""
    spark = matrix.sparkSession

    def stored(df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    features = datasets.resolve_features(matrix.columns, requested)
    kept = stored(matrix, "matrix")
    medians = {r["feature"]: r["median"] for r in datasets.imputer_medians(kept, features).collect()}
    return Inputs(kept, None if catches is None else stored(catches, "catches"), features, medians)


def prepare(given: Inputs, species: str, policy: str = "prefer_catch", splits=None) -> Prepared:
    """Labelled, imputed and split rows of one species."""
    features, medians = given.features, given.medians
    # The label join neither adds nor drops rows, so medians need not run through it.
    labelled, kind = labels.attach_labels(given.matrix, species, policy, given.catches)
    transform = labels.transform_of(kind)
    return Prepared(datasets.training_set(labelled, features, transform, medians, splits=splits), features, medians, kind, transform)


def _together(spark: SparkSession, jobs: list[Callable[[], T]], at_once: int = 4) -> list[T]:
    """Results of jobs in their order; up to ``at_once`` run at a time, each in a pool of its own where jobs are scheduled fairly."""

    def pooled(i: int, job: Callable[[], T]) -> T:
        spark.sparkContext.setLocalProperty("spark.scheduler.pool", f"fit-{i % at_once}")
        return job()

    with ThreadPoolExecutor(max_workers=max(1, min(at_once, len(jobs)))) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(pooled), i, job) for i, job in enumerate(jobs)]]


def _fit_with_early_stop(name: str, features: list[str], rows: DataFrame, n_train: int, classify: bool = False, **settings):
    """Study fit on the training rows; boosting runs long and keeps the stage that the validation rows pick."""
    train = boosting.packed(rows.where("train"), n_train)
    if name == "GBT":
        options = {**config.BOOSTED_TREES_STUDY, **settings}
        patience = options.pop("patience")
        return boosting.fit_with_patience(make_learner(name, features, classify, n_train, **options), train, rows.where("val"), classify, patience)[0]
    return make_learner(name, features, classify, n_train, **settings).fit(train)


def split_metrics(scored: DataFrame, split: str) -> dict:
    """Metrics of one split as a dictionary (a one-row aggregate)."""
    row = metrics.regression_metrics(scored.where(F.col(split)))
    first = row.first()
    return {k: (None if first is None else first[k]) for k in ("rmse", "mae", "r2")}


def train(
    matrix: DataFrame, species: str, catches: DataFrame | None = None, policy: str = "prefer_catch",
    requested: list[str] | None = None, splits=None, learner: str = "GBT", **settings,
) -> Bundle:
    """Fits one species: labels, imputation, chronological split, model, metrics, importances."""
    return _train(inputs(matrix, catches, requested), species, policy, splits, learner, **settings)


def _train(given: Inputs, species: str, policy: str = "prefer_catch", splits=None, learner: str = "GBT", **settings) -> Bundle:
    ready = prepare(given, species, policy, splits)
    rows = ready.rows.select(*ready.features, "label", "y", "train", "val", "test").persist()
    try:
        sizes = rows.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("train", "val", "test")]).first()
        fitted = make_learner(learner, ready.features, rows=sizes["train"] or 1, **settings).fit(boosting.packed(rows.where("train"), sizes["train"] or 1))
        scored = fitted.transform(rows)
        report = {
            "n_train": sizes["train"], "n_val": sizes["val"], "n_holdout": sizes["test"],
            "val": split_metrics(scored, "val"), "holdout": split_metrics(scored, "test"),
        }
    finally:
        rows.unpersist()
    return Bundle(species, ready.label_kind, ready.transform, ready.features, ready.medians, fitted, report)


def _score_classes(model: PipelineModel | None, rows: DataFrame) -> DataFrame:
    if model is None:
        return metrics.no_skill(rows).withColumn("score", F.lit(0.0))
    return model.transform(rows).withColumns(
        {"score": vector_to_array("probability")[1], "predicted": F.col("prediction").cast("int")}
    )


def train_classifier(
    matrix: DataFrame, species: str, catches: DataFrame | None = None, policy: str = "prefer_catch",
    requested: list[str] | None = None, splits=None, learner: str = "GBT", positive_ratio: float = 0.5, **settings,
) -> tuple[PipelineModel | None, DataFrame]:
    """Hotspot classifier; boosting keeps the stage of the best area under the curve on the validation rows. Returns model and scored rows."""
    ready = prepare(inputs(matrix, catches, requested), species, policy, splits)
    rows = datasets.hotspot_labels(ready.rows, positive_ratio)
    if learner == "NoSkill":
        return None, _score_classes(None, rows)
    fit_rows = rows.where("train OR val").persist()
    try:
        n_train = fit_rows.where("train").count()
        model = _fit_with_early_stop(learner, ready.features, fit_rows, n_train, classify=True, **settings)
    finally:
        fit_rows.unpersist()
    return model, _score_classes(model, rows)


def fit_frame(bundle: Bundle, labelled: DataFrame) -> DataFrame:
    """Actual (raw label) against back-transformed prediction per split."""
    scored = predict(bundle, labelled.where(F.col("label").isNotNull()))
    split = F.when(F.col("train"), "train").when(F.col("val"), "val").when(F.col("test"), "holdout")
    return scored.select("iy", "ix", "time", split.alias("split"), F.col("label").alias("actual"), F.col("prediction").alias("predicted"))


def report_table(spark: SparkSession, bundles: list[Bundle]) -> DataFrame:
    """One row per trained species."""
    rows = [
        (b.species, b.label_kind, b.transform, b.report["n_train"], b.report["n_val"], b.report["n_holdout"],
         b.report["val"], b.report["holdout"], [r.asDict() for r in importances(b, spark).collect()], b.features)
        for b in bundles
    ]
    return spark.createDataFrame(
        rows,
        "species string, label_kind string, target_transform string, n_train long, n_val long, n_holdout long, "
        "val_metrics map<string,double>, holdout_metrics map<string,double>, "
        "feature_importance array<struct<feature:string,importance:double>>, features array<string>",
    )


def _saved(spark: SparkSession, path: str) -> bool:
    try:
        return bool(spark.read.parquet(f"{path}/report").columns)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return False


def save_bundle(bundle: Bundle, path: str, spark: SparkSession, force: bool = False) -> bool:
    """Model, medians and report under ``path``; skipped when present unless forced."""
    table = report_table(spark, [bundle])
    if not force and _saved(spark, path):
        return False
    bundle.model.write().overwrite().save(f"{path}/model")
    spark.createDataFrame(list(bundle.medians.items()), "feature string, median double").write.mode("overwrite").parquet(f"{path}/medians")
    table.write.mode("overwrite").parquet(f"{path}/report")
    return True


def load_bundle(spark: SparkSession, path: str) -> Bundle:
    report = spark.read.parquet(f"{path}/report").first()
    medians = {r["feature"]: r["median"] for r in spark.read.parquet(f"{path}/medians").collect()}
    summary = {"n_train": report["n_train"], "n_val": report["n_val"], "n_holdout": report["n_holdout"],
               "val": report["val_metrics"], "holdout": report["holdout_metrics"]}
    return Bundle(
        report["species"], report["label_kind"], report["target_transform"], list(report["features"]), medians,
        PipelineModel.load(f"{path}/model"), summary,
    )


def compare(
    matrix: DataFrame, species: list[str], learners: list[str], catches: DataFrame | None = None,
    policy: str = "prefer_catch", requested: list[str] | None = None, splits=None, settings: dict | None = None,
) -> DataFrame:
    """Species x learner study on the same rows and split: fit seconds and metrics per window."""
    spark, given = matrix.sparkSession, inputs(matrix, catches, requested)

    def study(code: str) -> list[tuple]:
        ready, out = prepare(given, code, policy, splits), []
        rows = ready.rows.select(*ready.features, "label", "y", "train", "val", "test").persist()
        try:
            sizes = rows.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("train", "val", "test")]).first()
            for name in learners:
                started = clock.perf_counter()
                if name == "NoSkill":
                    mean = rows.where("train").agg(F.avg("y")).first()[0]
                    scored = rows.withColumn("prediction", F.lit(mean))
                else:
                    options = (settings or {}).get(name, {})
                    fitted = _fit_with_early_stop(name, ready.features, rows, sizes["train"] or 1, **options)
                    scored = fitted.transform(rows)
                seconds = clock.perf_counter() - started
                val, hold = split_metrics(scored, "val"), split_metrics(scored, "test")
                out.append((
                    code, name, ready.label_kind, sizes["train"], sizes["val"], sizes["test"], seconds,
                    *val.values(), *hold.values(),
                ))
        finally:
            rows.unpersist()
        return out

    rows_out = [r for out in _together(spark, [partial(study, code) for code in species]) for r in out]
    measures = ", ".join(f"{m}_{w} double" for w in ("val", "hold") for m in ("rmse", "mae", "r2"))
    return spark.createDataFrame(
        rows_out, f"species string, algorithm string, label_kind string, n_train long, n_val long, n_holdout long, train_s double, {measures}"
    )


WINDOWS = {"val": "val", "test": "hold"}


def _by_window(scored: DataFrame, species: str, learner: str) -> DataFrame:
    """The scored rows of the validation and the holdout window, named by species, learner and window."""
    shown = F.filter(F.array(*[F.when(F.col(w), F.lit(w)) for w in WINDOWS]), lambda w: w.isNotNull())
    names = [F.lit(species).alias("species"), F.lit(learner).alias("algorithm"), F.explode(shown).alias("window")]
    return scored.select(*names, "iy", "ix", "time", "y", "y_bin", F.col("predicted").cast("int").alias("predicted"), F.col("score").cast("double").alias("score"))


def _class_measures(spark: SparkSession, path: str) -> DataFrame:
    """``species, algorithm, window`` and all class and ranking metrics, of all groups in one job over the scored rows below ``path``."""
    scored = spark.read.parquet(f"{path}/*")
    return metrics.ranking_metrics(scored, ["species", "algorithm", "window"], value="y", key=("iy", "ix", "time"))


def compare_classifiers(
    matrix: DataFrame, species: list[str], learners: list[str], catches: DataFrame | None = None,
    policy: str = "prefer_catch", requested: list[str] | None = None, splits=None, settings: dict | None = None,
    positive_ratio: float = 0.5,
) -> DataFrame:
    """Hotspot study: class and ranking metrics per species, learner and window.

    The fits write their scored rows below one folder; the metrics of all of them come from one pass over it.
    """
    spark, path = matrix.sparkSession, scratch_path(matrix.sparkSession, "study")
    given = inputs(matrix, catches, requested)

    def study(code: str) -> None:
        ready = prepare(given, code, policy, splits)
        rows = datasets.hotspot_labels(ready.rows, positive_ratio).persist()
        try:
            n_train = rows.where("train").count()
            for name in learners:
                options = (settings or {}).get(name, {})
                model = None if name == "NoSkill" else _fit_with_early_stop(
                    name, ready.features, rows, n_train, classify=True, **options
                )
                _by_window(_score_classes(model, rows), code, name).write.parquet(f"{path}/{code}-{name}")
        finally:
            rows.unpersist()

    _together(spark, [partial(study, code) for code in species])
    columns = [F.col(m).cast("double").alias(m) for m in CLASS_MEASURES]
    return _class_measures(spark, path).select("species", "algorithm", "window", *columns)


REGRESSION_MEASURES = ("rmse", "mae", "r2")


def unified_study(
    matrix: DataFrame, species: list[str], learners: list[str], catches: DataFrame | None = None,
    policy: str = "prefer_catch", requested: list[str] | None = None, splits=None, settings: dict | None = None,
    positive_ratio: float = 0.5,
) -> DataFrame:
    """One row per species and learner: a classifier and a regressor on the same rows and splits.

    ``threshold`` separates hot spots on the training rows; class, rank and regression measures come
    for the validation window (``_val``) and the holdout (``_hold``); ``train_s`` covers both fits.
    """
    spark, path = matrix.sparkSession, scratch_path(matrix.sparkSession, "study")
    given = inputs(matrix, catches, requested)

    def study(code: str) -> list[tuple]:
        parts = []
        ready = prepare(given, code, policy, splits)
        rows = datasets.hotspot_labels(ready.rows, positive_ratio).persist()
        try:
            facts = rows.agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in ("train", "val", "test")], F.max("threshold").alias("threshold")).first()
            n_train = facts["train"] or 1
            for name in learners:
                options, started = (settings or {}).get(name, {}), clock.perf_counter()
                if name == "NoSkill":
                    sorter, values = None, rows.withColumn("prediction", F.lit(rows.where("train").agg(F.avg("y")).first()[0]))
                else:
                    sorter = _fit_with_early_stop(name, ready.features, rows, n_train, classify=True, **options)
                    values = _fit_with_early_stop(name, ready.features, rows, n_train, **options).transform(rows)
                seconds = clock.perf_counter() - started
                _by_window(_score_classes(sorter, rows), code, name).write.parquet(f"{path}/{code}-{name}")
                found = [m for w in WINDOWS for m in split_metrics(values, w).values()]
                parts.append((code, name, ready.label_kind, facts["threshold"], facts["train"], facts["val"], facts["test"], *found, seconds))
        finally:
            rows.unpersist()
        return parts

    parts = [r for out in _together(spark, [partial(study, code) for code in species]) for r in out]
    measures = ", ".join(f"{m}_{w} double" for w in WINDOWS.values() for m in REGRESSION_MEASURES)
    fits = spark.createDataFrame(
        parts, f"species string, algorithm string, label_kind string, threshold double, n_train long, n_val long, n_holdout long, {measures}, train_s double"
    )
    wide = [
        F.max(F.when(F.col("window") == w, F.col(m))).cast("double").alias(f"{m}_{short}") for w, short in WINDOWS.items() for m in CLASS_MEASURES
    ]
    ranked = _class_measures(spark, path).groupBy("species", "algorithm").agg(*wide)
    order = ["species", "algorithm", "label_kind", "threshold", "n_train", "n_val", "n_holdout"]
    order += [f"{m}_{w}" for w in WINDOWS.values() for m in (*CLASS_MEASURES, *REGRESSION_MEASURES)]
    return fits.join(ranked, ["species", "algorithm"], "left").select(*order, "train_s")


def train_all(
    matrix: DataFrame, species: list[str], path: str, catches: DataFrame | None = None, policy: str = "prefer_catch",
    requested: list[str] | None = None, splits=None, learner: str = "GBT", force: bool = False, **settings,
) -> DataFrame:
    """Trains and saves every species under ``path/<code>``; those already there are loaded unless forced.

    The report table of all of them, with ``fitted`` telling which were trained now.
    """
    spark = matrix.sparkSession
    kept = set() if force else {code for code in species if _saved(spark, f"{path}/{code}")}
    given = inputs(matrix, catches, requested) if set(species) - kept else None

    def one(code: str) -> tuple[Bundle, bool]:
        if code in kept:
            return load_bundle(spark, f"{path}/{code}"), False
        bundle = _train(given, code, policy, splits, learner, **settings)
        save_bundle(bundle, f"{path}/{code}", spark, force=True)
        return bundle, True

    done = _together(spark, [partial(one, code) for code in species])
    bundles, fitted = [b for b, _ in done], [b.species for b, new in done if new]
    return report_table(spark, bundles).withColumn("fitted", F.col("species").isin(fitted))
