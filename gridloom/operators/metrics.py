"""Regression, classification and ranking metrics as one-row or grouped aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators.ranking import prefix_sums


def regression_metrics(df: DataFrame, y: str = "y", predicted: str = "prediction", by: list[str] | None = None) -> DataFrame:
    error = F.col(y) - F.col(predicted)
    spread = F.var_pop(y)
    return df.groupBy(*(by or [])).agg(
        F.sqrt(F.avg(error * error)).alias("rmse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(spread > 0, 1 - F.avg(error * error) / spread).alias("r2"),
    )


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def class_metrics(df: DataFrame, y: str = "y_bin", predicted: str = "predicted", by: list[str] | None = None) -> DataFrame:
    """Accuracy, precision, recall, F1; the latter three are 0 where undefined."""
    def total(condition: Column) -> Column:
        return F.sum(condition.cast("long"))

    hit = (F.col(y) == 1) & (F.col(predicted) == 1)
    counts = df.groupBy(*(by or [])).agg(
        total(hit).alias("tp"),
        total(F.col(predicted) == 1).alias("flagged"),
        total(F.col(y) == 1).alias("positive"),
        total(F.col(y) == F.col(predicted)).alias("right"),
        F.count(F.lit(1)).alias("n"),
    )
    tp = F.col("tp")
    return counts.select(
        *(by or []),
        (F.col("right") / F.col("n")).alias("accuracy"),
        _ratio(tp, F.col("flagged")).alias("precision"),
        _ratio(tp, F.col("positive")).alias("recall"),
        _ratio(2 * tp, F.col("flagged") + F.col("positive")).alias("f1"),
    )


def _within_groups(ranked: DataFrame, by: list[str], before: str) -> DataFrame:
    """Lets a prefix sum over an order that begins with ``by`` start anew in each group."""
    if not by:
        return ranked
    # One row per group.
    bases = ranked.groupBy(*[F.col(b).alias(f"_of_{b}") for b in by]).agg(F.min(before).alias("_base"))
    same = [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by]
    return ranked.join(bases, same).withColumn(before, F.col(before) - F.col("_base")).drop("_base", *[f"_of_{b}" for b in by])


def _auc_of(per_score: DataFrame, by: list[str]) -> DataFrame:
    """``by, roc_auc`` from ``n`` rows, ``p`` positives and ``before`` lower-scored rows of each score."""
    # Twice the average rank is a whole number, so the sum is exact.
    twice_rank = 2 * F.col("before") + F.col("n") + 1
    total = per_score.groupBy(*by).agg(
        F.sum((F.col("p") * twice_rank).cast("decimal(38,0)")).alias("s"), F.sum("p").alias("pos"), F.sum("n").alias("n")
    )
    pos, neg = F.col("pos").cast("double"), (F.col("n") - F.col("pos")).cast("double")
    return total.select(
        *by, F.when((pos > 0) & (neg > 0), (F.col("s").cast("double") - pos * (pos + 1)) / (2 * pos * neg)).alias("roc_auc")
    )


def roc_auc(df: DataFrame, y: str = "y_bin", score: str = "score", by: list[str] | None = None) -> DataFrame:
    """Exact area under the curve by rank sum, ties sharing their average rank; NULL for one class.

    One row per group of ``by``. Rows collapse to distinct scores, which are ordered over all groups at once.
    """
    by = by or []
    per_score = df.groupBy(*by, score).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(y).cast("long")).alias("p"))
    ranked = prefix_sums(per_score, [*map(F.col, by), F.col(score)], {"before": F.col("n")})
    return _auc_of(_within_groups(ranked, by, "before"), by)


def spearman(df: DataFrame, x: str = "y_cont", y: str = "score", by: list[str] | None = None) -> DataFrame:
    """Rank correlation, ties averaged; NULL when one side is constant. One row per group of ``by``.

    Both sides of all groups are ranked in one order of distinct values.
    """
    by = by or []
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    sides = rows.select(*by, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("_x").alias("v")), F.struct(F.lit(1).alias("side"), F.col("_y").alias("v")))).alias("e"))
    counts = sides.groupBy(*by, F.col("e.side").alias("side"), F.col("e.v").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ranked = _within_groups(prefix_sums(counts, [*map(F.col, [*by, "side", "v"])], {"before": F.col("n")}), [*by, "side"], "before")
    # Halves come out whole: twice the average rank, less what the mean of all ranks is twice.
    ranks = ranked.select(*[F.col(b).alias(f"_of_{b}") for b in by], "side", "v", (2 * F.col("before") + F.col("n") + 1).alias("twice"))
    pairs = rows.groupBy(*by, "_x", "_y").agg(F.count(F.lit(1)).alias("c"))
    for side, value, name in ((0, "_x", "dx"), (1, "_y", "dy")):
        own = ranks.where(F.col("side") == side).drop("side").withColumnsRenamed({"v": f"_v{side}", "twice": name, **{f"_of_{b}": f"_of{side}_{b}" for b in by}})
        pairs = pairs.join(own, [F.col(value) == F.col(f"_v{side}"), *[F.col(b).eqNullSafe(F.col(f"_of{side}_{b}")) for b in by]])
    dx, dy, c = F.col("dx"), F.col("dy"), F.col("c")
    exact = lambda e: F.sum(e.cast("decimal(38,0)")).cast("double")
    sums = pairs.groupBy(*by).agg(
        F.sum("c").cast("double").alias("n"), exact(c * dx).alias("x"), exact(c * dy).alias("y"),
        exact(c * dx.cast("decimal(19,0)") * dy).alias("xy"), exact(c * dx.cast("decimal(19,0)") * dx).alias("xx"), exact(c * dy.cast("decimal(19,0)") * dy).alias("yy"),
    )
    xy, xx, yy = (F.col(s) - F.col(a) * F.col(b) / F.col("n") for s, a, b in (("xy", "x", "y"), ("xx", "x", "x"), ("yy", "y", "y")))
    return sums.select(*by, F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy)).alias("spearman"))


def hit_at_k(
    df: DataFrame, y: str = "y_bin", score: str = "score", key: tuple[str, ...] = ("k",), by: list[str] | None = None
) -> DataFrame:
    """Share of positives among the k best scores, k being the number of positives. One row per group of ``by``.

    Equal scores are taken in key order. NULL without positives or with a missing score.
    """
    by = by or []
    missing = F.col(score).isNull() | F.isnan(F.col(score).cast("double"))
    facts = df.groupBy(*[F.col(b).alias(f"_of_{b}") for b in by]).agg(F.sum(F.col(y).cast("long")).alias("_k"), F.max(missing).alias("_gap"))
    ranked = _within_groups(prefix_sums(df, [*map(F.col, by), F.desc(score), *map(F.asc, key)], {"_before": F.lit(1).cast("long")}), by, "_before")
    # One row per group; the single one of all rows is a scalar.
    if by:
        known = ranked.join(facts, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by])
    else:
        known = ranked.withColumns({"_k": facts.select("_k").scalar(), "_gap": facts.select("_gap").scalar()})
    hits = F.sum(F.when(F.col("_before") < F.col("_k"), F.col(y).cast("long")).otherwise(0))
    return known.groupBy(*by).agg(F.when((F.max("_k") > 0) & ~F.max("_gap"), hits / F.max("_k")).alias("hit_at_k"))


def ranking_metrics(df: DataFrame, by: list[str], y: str = "y_bin", score: str = "score", value: str = "y_cont", key: tuple[str, ...] = ("k",)) -> DataFrame:
    """``by, accuracy, precision, recall, f1, roc_auc, spearman, hit_at_k`` of every group."""
    out = class_metrics(df, y, by=by)
    for table in (roc_auc(df, y, score, by), spearman(df, value, score, by), hit_at_k(df, y, score, key, by)):
        other = table.withColumnsRenamed({b: f"_of_{b}" for b in by})
        out = out.join(other, [F.col(b).eqNullSafe(F.col(f"_of_{b}")) for b in by], "left").drop(*[f"_of_{b}" for b in by])
    return out


def no_skill(df: DataFrame, y: str = "y", y_bin: str = "y_bin", train: str = "train") -> DataFrame:
    """Adds the training mean and the most frequent training class as predictions."""
    fitted = df.where(F.col(train)).agg(
        F.struct(F.avg(y).alias("mean"), F.when(F.avg(y_bin) > 0.5, F.lit(1)).otherwise(F.lit(0)).alias("class"))
    ).scalar()
    return df.withColumns({"prediction": fitted["mean"], "predicted": fitted["class"]})


def algorithm_ranking(results: DataFrame, metrics: list[str], by: str = "algorithm") -> DataFrame:
    """Median of each metric per algorithm over the species (one value each, so groups are tiny)."""
    return results.groupBy(by).agg(*[F.median(m).alias(m) for m in metrics])


def algorithm_pivot(results: DataFrame, metric: str, algorithms: list[str]) -> DataFrame:
    return results.groupBy("species").pivot("algorithm", algorithms).agg(F.max(metric))
