"""Boosted trees that keep the stage which did best on validation rows.

A fitted ensemble is scored at all its stages in one pass: the leaf that each tree puts a row in, looked
up in the table of leaf values and summed up along the trees. The measure of every stage comes from one
grouped job, the first stage that no later one beats within ``patience`` trees is kept, and the model is
cut after it. A fit cannot be interrupted, but the first trees of a longer fit are those of a shorter one: a
short fit is made first, and a longer one only where patience has not ended within it.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.operators import metrics
from gridloom.session import scratch_path, shared_folder

# Fits of growing length: the first has room for a best stage and the patience after it, each next one is so many times longer.
FIRST, LONGER = 2, 3
# Rows of a fit that go into one partition: a boosted fit runs a job for each level of each tree.
ROWS_PER_PARTITION = 100_000


def packed(rows: DataFrame, n: int) -> DataFrame:
    """Rows in as few partitions as their number needs."""
    return rows.coalesce(max(1, min(-(-n // ROWS_PER_PARTITION), rows.rdd.getNumPartitions())))


def leaf_values(spark: SparkSession, model) -> DataFrame:
    """``tree, leaf, value``: what each leaf adds, its tree's weight included, leaves numbered as ``leafCol`` does."""
    path = scratch_path(spark, "trees")
    model.write().save(path)
    # Columns by place: their names differ between versions.
    nodes = spark.read.parquet(f"{path}/data").toDF("tree", "node").select("tree", "node.*")
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight")
    # Node numbers run depth first, so leaves in their order are the leaves from left to right. A window is one tree.
    order = Window.partitionBy("tree").orderBy("id")
    leaves = nodes.where("leftChild < 0").select("tree", (F.row_number().over(order) - 1).alias("leaf"), "prediction")
    return leaves.join(weights, "tree").select("tree", "leaf", (F.col("prediction") * F.col("weight")).alias("value"))


def staged_outputs(fitted: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep``, ``stage`` (trees used, from 1) and ``output``, the ensemble's sum at that stage, for all rows and stages."""
    model = fitted.stages[-1]
    inputs = PipelineModel(fitted.stages[:-1]).transform(rows)
    numbered = model.copy().setLeafCol("_leaves").transform(inputs).withColumn("_row", F.monotonically_increasing_id())
    each = numbered.select(*keep, "_row", F.posexplode(vector_to_array("_leaves")).alias("_tree", "_leaf"))
    # One row per leaf of the ensemble.
    values = F.broadcast(leaf_values(rows.sparkSession, model))
    known = each.join(values, (F.col("_tree") == F.col("tree")) & (F.col("_leaf").cast("int") == F.col("leaf")))
    upto = Window.partitionBy("_row").orderBy("_tree").rowsBetween(Window.unboundedPreceding, 0)
    return known.select(*keep, (F.col("_tree") + 1).alias("stage"), F.sum("value").over(upto).alias("output"))


def stage_measures(fitted: PipelineModel, rows: DataFrame, classify: bool) -> list[float]:
    """The area under the curve (or the negative root mean square error) on ``rows`` at every stage; more is better."""
    if classify:
        # The probability rises with the output, so both order rows alike.
        table = metrics.roc_auc(staged_outputs(fitted, rows, ["y_bin"]), score="output", by=["stage"]).withColumnRenamed("roc_auc", "measure")
    else:
        measured = metrics.regression_metrics(staged_outputs(fitted, rows, ["y"]), predicted="output", by=["stage"])
        table = measured.select("stage", (-F.col("rmse")).alias("measure"))
    # One row per tree.
    found = {r["stage"]: r["measure"] for r in table.collect()}
    return [found.get(s) if found.get(s) is not None else float("-inf") for s in range(1, fitted.stages[-1].getNumTrees + 1)]


def kept_stage(measures: list[float], patience: int) -> int:
    """Trees to keep: the best stage met before ``patience`` stages in a row brought no gain, the first on a tie."""
    best, at = float("-inf"), 1
    for stage, value in enumerate(measures, 1):
        if value > best:
            best, at = value, stage
        elif stage - at >= patience:
            break
    return at


def first_trees(fitted: PipelineModel, n: int) -> PipelineModel:
    """The pipeline with only the first ``n`` trees of its ensemble."""
    model = fitted.stages[-1]
    gateway = SparkSession.active().sparkContext._gateway
    own, jvm = model._java_obj, gateway.jvm
    trees, weights = gateway.new_array(jvm.org.apache.spark.ml.regression.DecisionTreeRegressionModel, n), gateway.new_array(jvm.double, n)
    for i, (tree, weight) in enumerate(zip(own.trees()[:n], model.treeWeights[:n])):
        trees[i], weights[i] = tree, float(weight)
    if isinstance(model, GBTClassificationModel):
        cut = GBTClassificationModel(jvm.org.apache.spark.ml.classification.GBTClassificationModel(own.uid(), trees, weights, own.numFeatures(), own.numClasses()))
    else:
        cut = GBTRegressionModel(jvm.org.apache.spark.ml.regression.GBTRegressionModel(own.uid(), trees, weights, own.numFeatures()))
    return PipelineModel([*fitted.stages[:-1], model._copyValues(cut)])


def _ended(measures: list[float], patience: int) -> bool:
    """Whether patience runs out within these stages, so that trees after them would not be looked at."""
    return any(m > float("-inf") for m in measures) and len(measures) - kept_stage(measures, patience) >= patience


def _lengths(most: int, patience: int) -> list[int]:
    """Numbers of trees to fit one after the other, up to ``most``."""
    n, lengths = FIRST * patience, []
    while n * 2 <= most:  # a fit of over half the trees saves less than it costs
        lengths.append(n)
        n *= LONGER
    return [*lengths, most]


def fit_with_patience(pipeline, train: DataFrame, validation: DataFrame, classify: bool, patience: int) -> tuple[PipelineModel, int, float]:
    """The pipeline fitted on ``train`` up to the stage that ``validation`` picks; that stage and its measure.

    Without validation rows, or where no stage has a measure (one class only), all trees stay.
    """
    context, learner = train.sparkSession.sparkContext, pipeline.getStages()[-1]
    if context.getCheckpointDir() is None:  # a tree's input hangs on all trees before it, back to the last checkpoint
        context.setCheckpointDir(shared_folder(train.sparkSession))
    total = learner.getMaxIter()
    lengths = _lengths(total, patience)
    while lengths:
        fitted = pipeline.fit(train, {learner.maxIter: lengths.pop(0)})
        measures = stage_measures(fitted, validation, classify)
        if _ended(measures, patience):
            break
        if not any(m > float("-inf") for m in measures):  # nor has any later stage one
            lengths = lengths[-1:]
    if not any(m > float("-inf") for m in measures):
        return fitted, total, float("nan")
    stage = kept_stage(measures, patience)
    return first_trees(fitted, stage), stage, abs(measures[stage - 1])
