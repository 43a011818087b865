"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, ``-ln(u) / quality``, from a hash of its id. Sorted by key
within its source, documents are taken until their prefix-summed sizes reach the source's budget.
Complete epochs of a source come first; only the rest of its budget is selected by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import WORD, attach, stored
from gridloom.operators.ranking import prefix_sums

WEIGHTS = (5, 2, 1)
SYMBOL = r"[#*$%&|<>]"


def size_of(text: Column) -> Column:
    """Words of a text; none where it is NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A quality weight above 0 and up to 1: less for texts with many symbols to a word."""
    symbols = F.coalesce(F.regexp_count(text, F.lit(SYMBOL)), F.lit(0))
    return F.when(size > 0, size / (size + 10 * symbols)).otherwise(1.0)


def exponential_key(id: Column, quality: Column, seed: int) -> Column:
    """``-ln(u) / quality`` with ``u`` from the first 52 bits of a hash of id and seed."""
    hashed = F.md5(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(f":{seed}")))
    u = (F.conv(F.substring(hashed, 1, 13), 16, 10).cast("long") + F.lit(0.5)) / F.lit(float(1 << 52))
    return -F.ln(u) / quality


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> DataFrame:
    """Adds ``base`` (sizes of sources before it), ``target`` and ``epochs`` to ``(source, source_size)``.

    Sources by code point, NULL last, take the weights in turn. Targets share the total by weight,
    none above ``most`` times its source; the excess is shared anew by weight. In ascending order of
    ``source_size / weight`` the sources that hit the limit come first, so one pass of running sums
    finds the level where the sharing ends. One row per source, ordered without a partition.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(w) for w in weights])
    ranked = sources.select(
        "source", "source_size",
        F.get(turn, F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))).cast("long").alias("weight"),
        F.coalesce(F.sum("source_size").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"),
    )
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    cap = F.col("source_size") * most
    room = ranked.withColumns({
        "cap": cap, "left": F.sum("source_size").over(whole) - F.coalesce(F.sum(cap).over(before), F.lit(0)),
        "weights": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    })
    full = room.withColumn("full", F.col("cap") * F.col("weights") <= F.col("left") * F.col("weight"))
    rest = F.sum("source_size").over(whole) - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(whole)
    heavy = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * rest / heavy)
    return full.withColumn("target", target).select(
        "source", "source_size", "weight", "base", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    )


def mix_plan(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per source: ``source, source_size, weight, target, epochs, last_key, last_id``.

    A document of the source is taken ``epochs`` times, and once more if ``(key, id)`` is not above
    ``(last_key, last_id)``; the last one is chosen so that the taken words are nearest the target.
    Rows that share source and id are one unit. The hot source is split: keys are range-partitioned
    over all sources at once and the prefix sums run per partition.
    """
    units = stored(sized(docs, seed).groupBy("source", "key", "doc_id").agg(F.sum("size").alias("size")), "mix-units")
    targets = stored(source_targets(units.groupBy("source").agg(F.sum("size").alias("source_size")), weights), "mix-targets")
    order = [F.col("source").asc_nulls_last(), F.col("key"), F.col("doc_id")]
    ranked = attach(prefix_sums(units, order, {"before": F.col("size")}), targets, ["source"])
    inside = F.col("before") - F.col("base")
    budget = F.col("target") - F.col("epochs") * F.col("source_size")
    last = F.max(F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id")))
    ends = ranked.where(2 * inside + F.col("size") < 2 * budget).groupBy("source").agg(last.alias("last"))
    # Two tables of one row per source.
    found = targets.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    return found.select("source", "source_size", "weight", "target", "epochs", F.col("last.key").alias("last_key"), F.col("last.id").alias("last_id"))


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``doc_id, source, size, key`` of each row."""
    rows = docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.col("text").alias("_text"))
    weighed = rows.withColumn("quality", quality_of(F.col("_text"), F.col("size")))
    return weighed.select("doc_id", "source", "size", exponential_key(F.col("doc_id"), F.col("quality"), seed).alias("key"))


def copies_of() -> Column:
    """Times a row with ``key`` and the plan's columns is taken."""
    here = F.struct("key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    chosen = F.coalesce(here <= F.struct(F.col("last_key").alias("key"), F.col("last_id").alias("id")), F.lit(False))
    return F.col("epochs") + F.when(F.col("last_key").isNotNull() & chosen, 1).otherwise(0)


def mix(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    NULL and empty texts have size 0 and draw like others; a NULL source is a source. An empty table
    gives an empty result.
    """
    placed = attach(sized(docs, seed), mix_plan(docs, seed, weights), ["source"])
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", copies_of().alias("copies"), (F.col("size") * copies_of()).alias("taken")
    )


def mixed_documents(docs: DataFrame, seed: int = 42, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """The documents of the mix, each row as often as it is taken, with the columns of ``docs``.

    The plan is one row per source, so texts are filtered and repeated where they are read.
    """
    plan = mix_plan(docs, seed, weights)
    inner = {c: f"_plan_{c}" for c in plan.columns if c != "source"}
    size = size_of(F.col("text"))
    keyed = docs.withColumn("_key", exponential_key(F.col("doc_id"), quality_of(F.col("text"), size), seed))
    placed = attach(keyed, plan.withColumnsRenamed(inner), ["source"])
    here = F.struct(F.col("_key").alias("key"), F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).alias("id"))
    end = F.struct(F.col("_plan_last_key").alias("key"), F.col("_plan_last_id").alias("id"))
    copies = F.col("_plan_epochs") + F.when(F.col("_plan_last_key").isNotNull() & (here <= end), 1).otherwise(0)
    repeated = placed.withColumn("_n", F.explode(F.sequence(F.lit(0).cast("long"), copies))).where("_n > 0")
    return repeated.select(*docs.columns)
