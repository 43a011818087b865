"""Quality rules whose cut-offs adapt to language and source.

Each metric of the documents of one language and source goes into a quantile sketch of logarithmic
buckets (relative error ``GAMMA``): counts per bucket, so sketches merge by adding and give the same
answer however the rows are split. Cut-offs are fences around the sketch's median.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, attach, stored, words_of

GAMMA = 1.02
SPREADS = 6
# Groups of fewer passing documents take the pooled fences of their parent group.
LEAST_DOCUMENTS = 30
# Metric: numerator, denominator, least spread, whether low values are outliers too.
METRICS = {
    "symbols": ("n_symbols", "n_words", 0.05, False),
    "dup_lines": ("n_dup_lines", "n_lines", 0.1, False),
    "repeats": ("n_repeat_words", "n_words", 0.05, False),
    "word_length": ("word_chars", "n_words", 0.3, True),
}
_ZERO = -1_000_000


def text_metrics(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and the metrics of each text; NULL texts have no words. No shuffle.

    Repeated 3-word windows are found by sorting, per text, one number per window that holds the
    window's hash above and its position below; equal hashes are neighbours then.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        *keep,
        words_of(text).alias("_w"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD)).alias("_lines"),
    )
    counted = base.select(
        *keep, "_w", "n_symbols",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_w").alias("_n"), F.length(F.bin(F.size("_w").cast("long"))).alias("_bits"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
    )
    mark = lambda i: F.call_function(
        "shiftleft", F.xxhash64(F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)), F.col("_bits")
    ).bitwiseOR(i.cast("long"))
    # With fewer than three words there is a single mark, which repeats nothing.
    windows = F.transform(F.sequence(F.lit(0), F.greatest(F.col("_n") - 3, F.lit(0))), mark)
    marked = counted.withColumn("_k", F.sort_array(windows))
    shift = lambda name, x: F.call_function(name, x, F.col("_bits"))
    near = lambda x, y: shift("shiftright", x.bitwiseXOR(y)) == 0
    at = lambda x: (x - shift("shiftleft", shift("shiftright", x))).cast("int")
    likely = F.filter("_k", lambda x, i: near(x, F.get("_k", i + 1)) | near(x, F.get("_k", i - 1)))
    thin = marked.withColumn("_k", likely)

    def same(x: Column, y: Column) -> Column:
        # Up to 16 bits of position the hash keeps 48 bits or more; beyond, words are compared too.
        return near(x, y) & ((F.col("_bits") <= 16) | (F.slice("_w", at(x) + 1, F.lit(3)) == F.slice("_w", at(y) + 1, F.lit(3))))

    twice = F.filter("_k", lambda x, i: same(x, F.get("_k", i + 1)) | same(x, F.get("_k", i - 1)))
    found = thin.withColumn("_p", F.sort_array(F.transform(twice, at))).drop("_k", "_w")
    steps = F.transform("_p", lambda p, i: F.least(F.coalesce(F.get("_p", i + 1) - p, F.lit(3)), F.lit(3)))
    return found.select(
        *keep, F.col("_n").cast("long").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", "n_lines",
        F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step).alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def sketch(metrics: DataFrame, by: list[str]) -> DataFrame:
    """``by, metric, bucket, n``: bucket counts of each group's metrics; sketches of parts add up."""
    def bucket(value: Column) -> Column:
        return F.when(value > 0, F.ceil(F.round(F.ln(value) / math.log(GAMMA), 6))).otherwise(_ZERO).cast("long")

    entries = [
        F.struct(F.lit(m).alias("metric"), bucket(F.col(a) / F.when(F.col(b) > 0, F.col(b)).otherwise(1)).alias("bucket"))
        for m, (a, b, _, _) in METRICS.items()
    ]
    return metrics.select(*by, F.inline(F.array(*entries))).groupBy(*by, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


def quartiles_of(sketches: DataFrame, by: list[str]) -> DataFrame:
    """``by, metric, q25, q50, q75, n``. Windows hold the buckets of one group, whose number is bounded."""
    order = Window.partitionBy(*by, "metric").orderBy("bucket")
    total = F.sum("n").over(Window.partitionBy(*by, "metric"))
    walked = sketches.withColumns({"upto": F.sum("n").over(order), "total": total})
    value = F.when(F.col("bucket") == _ZERO, 0.0).otherwise(F.pow(F.lit(GAMMA), F.col("bucket")) * (2 / (1 + GAMMA)))

    def at(q: float) -> Column:
        return F.min(F.when(F.col("upto") > F.floor((F.col("total") - 1) * q), F.round(value, 9)))

    return walked.groupBy(*by, "metric").agg(at(0.25).alias("q25"), at(0.5).alias("q50"), at(0.75).alias("q75"), F.max("total").alias("n"))


def fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One row per group: ``<metric>_low`` and ``<metric>_high``, median plus or minus ``SPREADS`` spreads.

    The spread above is the distance from the median to the upper quartile, below to the lower one,
    and at least the metric's own.
    """
    quartiles = quartiles_of(sketches, by)
    out = []
    for m, (_, _, least, low) in METRICS.items():
        above = F.col("q50") + SPREADS * F.greatest(F.col("q75") - F.col("q50"), F.lit(least))
        below = F.col("q50") - SPREADS * F.greatest(F.col("q50") - F.col("q25"), F.lit(least))
        out.append(F.max(F.when(F.col("metric") == m, above)).alias(f"{m}_high"))
        out.append(F.max(F.when(F.col("metric") == m, below if low else F.lit(-1.0))).alias(f"{m}_low"))
    return quartiles.groupBy(*by).agg(*out)


def pooled_fences(sketches: DataFrame, by: list[str]) -> DataFrame:
    """The columns of ``fences`` from sketches merged upward: ``by``, ``by`` without its last column, and so on to all.

    A group of fewer than ``LEAST_DOCUMENTS`` takes its parent's fences. Otherwise the half of the
    group on the far side of the median gives its norm, and its own outer quartile widens that up to
    the parent's fence only: junk of less than half of a source cannot set the source's norm, and a
    source whose usual documents differ from its parent's keeps them.
    """
    least = F.coalesce(*[F.when(F.col("metric") == m, F.lit(x)) for m, (_, _, x, _) in METRICS.items()])
    fence = lambda sign, spread: F.col("q50") + sign * SPREADS * F.greatest(spread, least)
    above, below = F.col("q75") - F.col("q50"), F.col("q50") - F.col("q25")
    upper = None
    for k in range(len(by) + 1):
        own = by[:k]
        merged = sketches.groupBy(*own, "metric", "bucket").agg(F.sum("n").alias("n"))
        level = quartiles_of(merged, own)
        if upper is None:
            upper = level.select("metric", fence(1, below).alias("high"), fence(-1, above).alias("low"))
            continue
        joined = attach(level, upper.select(*by[: k - 1], "metric", F.col("high").alias("_high"), F.col("low").alias("_low")), [*by[: k - 1], "metric"])
        high = F.greatest(fence(1, below), F.least(fence(1, above), F.col("_high")))
        low = F.least(fence(-1, above), F.greatest(fence(-1, below), F.col("_low")))
        few = F.col("n") < LEAST_DOCUMENTS
        upper = joined.select(
            *own, "metric", F.when(few, F.col("_high")).otherwise(high).alias("high"), F.when(few, F.col("_low")).otherwise(low).alias("low"),
        )
    out = []
    for m, (_, _, _, low) in METRICS.items():
        out.append(F.max(F.when(F.col("metric") == m, F.col("high"))).alias(f"{m}_high"))
        out.append(F.max(F.when(F.col("metric") == m, F.col("low") if low else F.lit(-1.0))).alias(f"{m}_low"))
    return upper.groupBy(*by).agg(*out)


def quality_rules(docs: DataFrame, by: tuple[str, ...] = ("lang", "source"), pooled: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``by``, the metrics, ``base_failed`` and ``kept``.

    Cut-offs come from the documents that pass the base rules. NULL and empty texts have no words
    and fail; ``pooled`` takes ``pooled_fences``; a NULL language or source is a group; a group without passing documents keeps none.
    Metrics are stored once (a few numbers a document) and read for the sketch and for the verdict.
    """
    by = list(by)
    metrics = stored(text_metrics(docs, ["doc_id", *by]).withColumn("base_failed", base_failed()), "quality-metrics")
    sketches = sketch(metrics.where(~F.col("base_failed")), by)
    limits = stored(pooled_fences(stored(sketches, "quality-sketches"), by) if pooled else fences(sketches, by), "quality-fences")
    judged = attach(metrics, limits, by)
    inside = F.lit(True)
    for m, (a, b, _, _) in METRICS.items():
        value = F.col(a) / F.when(F.col(b) > 0, F.col(b)).otherwise(1)
        inside &= (value <= F.col(f"{m}_high")) & (value >= F.col(f"{m}_low"))
    return judged.select(*metrics.columns, (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"))
