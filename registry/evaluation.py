"""Metrics and learner queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import datasets, metrics
from gridloom.plans import learning
from gridloom.session import scratch_path
from registry import tables as t
from registry.base import query
from registry.fisheries import JOINED, NUMERIC, Y, _labelled, _training
from registry.tables import sql_over

REGRESSION = """sqrt(avg((y - prediction) ** 2)) AS rmse, avg(abs(y - prediction)) AS mae, 1 - avg((y - prediction) ** 2) / var_pop(y) AS r2"""
RANKS = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@query("regression_metrics", sql_over("trials", f"SELECT species, round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2 FROM (SELECT species, {REGRESSION} FROM trials GROUP BY 1)"))
def regression_metrics(spark, sf):
    return metrics.regression_metrics(t.trials(spark, sf), by=["species"])


@query("class_metrics", sql_over("scored", """SELECT round(acc, 6) AS accuracy, round(CASE WHEN fl > 0 THEN tp / fl ELSE 0 END, 6) AS precision, round(CASE WHEN po > 0 THEN tp / po ELSE 0 END, 6) AS recall,
    round(CASE WHEN fl + po > 0 THEN 2 * tp / (fl + po) ELSE 0 END, 6) AS f1 FROM (SELECT avg(CASE WHEN y_bin = p THEN 1::DOUBLE ELSE 0::DOUBLE END) AS acc, CAST(sum(y_bin * p) AS DOUBLE) AS tp, CAST(sum(p) AS DOUBLE) AS fl, CAST(sum(y_bin) AS DOUBLE) AS po
    FROM (SELECT *, CAST(score > 48 AS INTEGER) AS p FROM scored))"""))
def class_metrics(spark, sf):
    return metrics.class_metrics(t.scored(spark, sf).withColumn("predicted", (F.col("score") > 48).cast("int")))


@query("roc_auc", sql_over("scored", f"""SELECT round((sum(CASE WHEN y_bin = 1 THEN r ELSE 0 END) - sum(y_bin) * (sum(y_bin) + 1) / 2.0::DOUBLE) / (sum(y_bin)::DOUBLE * (count(*) - sum(y_bin))), 6) AS roc_auc
    FROM (SELECT *, {RANKS.format(c='score')} AS r FROM scored)"""))
def roc_auc(spark, sf):
    return metrics.roc_auc(t.scored(spark, sf))


@query("spearman", sql_over("scored", f"SELECT round(corr(rx, ry), 6) AS spearman FROM (SELECT {RANKS.format(c='y_cont')} AS rx, {RANKS.format(c='score')} AS ry FROM scored)"))
def spearman(spark, sf):
    return metrics.spearman(t.scored(spark, sf))


@query("hit_at_k", sql_over("scored", "SELECT round(avg(y_bin), 6) AS hit_at_k FROM (SELECT *, row_number() OVER (ORDER BY score DESC, k) AS rn FROM scored) WHERE rn <= (SELECT sum(y_bin) FROM scored)"))
def hit_at_k(spark, sf):
    return metrics.hit_at_k(t.scored(spark, sf))


@query("noskill_eval", sql_over("matrix catches", f"""WITH y AS ({Y}), cut AS (SELECT quantile_cont(y, 0.7) AS threshold FROM y WHERE train),
    z AS (SELECT *, CAST(y > threshold AS INTEGER) AS b FROM y, cut), fit AS (SELECT avg(y) AS prediction, CAST(avg(b) > 0.5 AS INTEGER) AS cls FROM z WHERE train)
    SELECT round(rmse, 6) AS rmse, round(mae, 6) AS mae, round(r2, 6) AS r2, round(acc, 6) AS accuracy FROM (
      SELECT {REGRESSION}, avg(CASE WHEN b = cls THEN 1::DOUBLE ELSE 0::DOUBLE END) AS acc FROM z, fit WHERE NOT train)"""))
def noskill_eval(spark, sf):
    scored = metrics.no_skill(datasets.hotspot_labels(_training(spark, sf), 0.3)).where(~F.col("train"))
    error = F.col("y") - F.col("prediction")
    return scored.agg(
        F.sqrt(F.avg(error * error)).alias("rmse"), F.avg(F.abs(error)).alias("mae"),
        (1 - F.avg(error * error) / F.var_pop("y")).alias("r2"),
        F.avg((F.col("y_bin") == F.col("predicted")).cast("double")).alias("accuracy"),
    )


PER_PAIR = f"SELECT species, algorithm, {REGRESSION} FROM trials GROUP BY 1, 2"


@query("algo_ranking", sql_over("trials", f"SELECT algorithm, round(median(r2), 6) AS r2, round(median(rmse), 6) AS rmse, round(median(mae), 6) AS mae FROM ({PER_PAIR}) GROUP BY 1"))
def algo_ranking(spark, sf):
    results = metrics.regression_metrics(t.trials(spark, sf), by=["species", "algorithm"])
    return metrics.algorithm_ranking(results, ["r2", "rmse", "mae"])


LEARNERS = [f"learner_{i}" for i in range(1, 8)]


@query("algo_pivot", sql_over("trials", "SELECT species, " + ", ".join(f"round(max(CASE WHEN algorithm = '{a}' THEN rmse END), 6) AS {a}" for a in LEARNERS) + f" FROM ({PER_PAIR}) GROUP BY 1"))
def algo_pivot(spark, sf):
    results = metrics.regression_metrics(t.trials(spark, sf), by=["species", "algorithm"])
    return metrics.algorithm_pivot(results, "rmse", LEARNERS)


# Boosting runs jobs tree after tree (300 trees of depth 6 did not end within 150 s here), so these use this many;
# single forests and linear models, train_gbt_classifier and benchmark_table have the library's own settings.
STUDY = {"trees": 20, "depth": 5}
SMALL = {"trees": 8, "depth": 4}  # for unit tests
REQUESTED = NUMERIC
SPECIES = [s.code for s in config.SPECIES if s.code in set(config.SHEET_SPECIES.values())]


def _bundle(spark, sf, learner="GBT", species="scad", **settings):
    """A model of the whole record."""
    return learning.train(t.matrix(spark, sf), species, t.catches(spark, sf), requested=REQUESTED, splits=t.splits(), learner=learner, **settings)


def _sizes(code: str) -> str:
    labelled = JOINED.format(table="matrix", code=code)
    return f"""SELECT '{code}' AS species, 'catch' AS label_kind, count(*) FILTER (WHERE year(time) <= 1999) AS n_train, count(*) FILTER (WHERE year(time) = 2000) AS n_val,
        count(*) FILTER (WHERE year(time) >= 2001) AS n_holdout FROM ({labelled}) WHERE label IS NOT NULL"""


ALL_SIZES = " UNION ALL ".join(map(_sizes, SPECIES))


def _fit(spark, sf, learner):
    """Sizes of a fit from its report, and whether its errors and fit are possible values."""
    r = F.col("val_metrics")
    sane = (r["rmse"] >= r["mae"]) & (r["mae"] >= 0) & (r["r2"] <= 1) & (F.col("holdout_metrics")["rmse"] >= 0)
    table = learning.report_table(spark, [_bundle(spark, sf, learner, **(STUDY if learner == "GBT" else {}))])
    return table.select("species", "label_kind", "n_train", "n_val", "n_holdout", F.coalesce(sane, F.lit(False)).alias("sane"))


FIT = sql_over("matrix catches", f"SELECT *, true AS sane FROM ({_sizes('scad')})")


@query("train_gbt", FIT)
def train_gbt(spark, sf):
    return _fit(spark, sf, "GBT")


@query("train_rf", FIT)
def train_rf(spark, sf):
    return _fit(spark, sf, "RandomForest")


@query("train_linear", FIT)
def train_linear(spark, sf):
    return _fit(spark, sf, "Linear")


@query("train_gbt_classifier")
def train_gbt_classifier(spark, sf):
    """Trees kept by patience on the validation rows, and the measures on the holdout."""
    model, scored = learning.train_classifier(t.matrix(spark, sf), "scad", t.catches(spark, sf), requested=REQUESTED, splits=t.splits())
    named = scored.where("test").withColumn("stage", F.lit(model.stages[-1].getNumTrees))
    return metrics.ranking_metrics(named, ["stage"], value="y", key=("iy", "ix", "time"))


@query("predict", sql_over("matrix", "SELECT iy, ix, CAST(time AS VARCHAR) AS time, true AS scored FROM matrix"))
def predict(spark, sf):
    """Every row of the table gets a forecast that is a volume."""
    scored = learning.predict(_bundle(spark, sf, **STUDY), t.matrix(spark, sf))
    return scored.select("iy", "ix", "time", F.coalesce((F.col("prediction") >= 0) & (F.col("prediction") < 1e12), F.lit(False)).alias("scored"))


@query("importance", "SELECT 8 AS features, 1::DOUBLE AS total")
def importance(spark, sf):
    """Weights of the inputs of a forest, which uses all of them, and their sum."""
    table = learning.importances(_bundle(spark, sf, "RandomForest"), spark)
    return table.agg(F.count("feature").cast("int").alias("features"), F.sum("importance").alias("total"))


@query("train_report", sql_over("matrix catches", f"SELECT *, 'log1p' AS target_transform, true AS fitted FROM ({ALL_SIZES})"))
def train_report(spark, sf):
    """All species trained and saved in one run."""
    table = learning.train_all(
        t.matrix(spark, sf), SPECIES, scratch_path(spark, "models"), t.catches(spark, sf), requested=REQUESTED, splits=t.splits(), **STUDY
    )
    return table.select("species", "label_kind", "n_train", "n_val", "n_holdout", "target_transform", "fitted")


@query("fit_frame", sql_over("matrix catches", f"""SELECT iy, ix, CAST(time AS VARCHAR) AS time, CASE WHEN year(time) <= 1999 THEN 'train' WHEN year(time) = 2000 THEN 'val' ELSE 'holdout' END AS split,
    round(label, 6) AS actual, true AS predicted FROM ({JOINED.format(table='matrix', code='scad')}) WHERE label IS NOT NULL"""))
def fit_frame(spark, sf):
    table = learning.fit_frame(_bundle(spark, sf, **STUDY), _labelled(spark, sf).withColumns(t.splits()))
    return table.withColumn("predicted", F.coalesce(F.col("predicted") >= 0, F.lit(False)))


@query("benchmark_classifiers")
def benchmark_classifiers(spark, sf):
    return learning.compare_classifiers(
        t.matrix(spark, sf), SPECIES, list(learning.CLASSIFIERS), t.catches(spark, sf),
        requested=REQUESTED, splits=t.splits(), settings={"GBT": STUDY, "RandomForest": STUDY},
    )


STUDIED = " UNION ALL ".join(f"SELECT *, '{a}' AS algorithm FROM ({ALL_SIZES})" for a in learning.REGRESSORS)


@query("benchmark_table", sql_over("matrix catches", f"SELECT species, algorithm, label_kind, n_train, n_val, n_holdout, true AS measured FROM ({STUDIED})"))
def benchmark_table(spark, sf):
    table = learning.compare(t.matrix(spark, sf), SPECIES, list(learning.REGRESSORS), t.catches(spark, sf), requested=REQUESTED, splits=t.splits())
    measured = (F.col("rmse_val") >= F.col("mae_val")) & (F.col("mae_val") >= 0) & (F.col("rmse_hold") >= F.col("mae_hold")) & (F.col("r2_val") <= 1)
    return table.select("species", "algorithm", "label_kind", "n_train", "n_val", "n_holdout", F.coalesce(measured, F.lit(False)).alias("measured"))
