"""What the text operators share: words, stored intermediates, size-checked look-ups."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.session import scratch_path, shared_folder

# A word of the counting rules: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, as ``--py-files`` would."""
    root, environment = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    known = environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))


def text_of(column: str = "text") -> Column:
    """The text; empty where it is NULL."""
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column, gap: str = GAP) -> Column:
    """The words of a text in order, as an array without empty entries."""
    return F.array_remove(F.split(text, gap), "")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Writes rows to the shared folder and reads them back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that ``stored`` wrote, once nothing reads it any more."""
    spark, shared = df.sparkSession, shared_folder(df.sparkSession).rstrip("/")
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if path.getParent().toUri().getPath() != spark._jvm.org.apache.hadoop.fs.Path(shared).toUri().getPath():
            raise ValueError(f"not a table of the shared folder: {folder}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


# A look-up is broadcast up to this many rows, of some hundred bytes each; beyond, it is joined with salt.
BROADCAST_ROWS = 50_000
SALTS = 32


def attach(df: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Joins a look-up with one row per key (NULL is a key) whose keys may be very uneven in ``df``.

    The size of the look-up is checked first. A large one is repeated ``SALTS`` times and joined on
    key and salt, so that no key of ``df`` lands in one task.
    """
    renamed = lookup.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in lookup.columns if c not in keys])
    condition = [df[k].eqNullSafe(renamed[f"_k_{k}"]) for k in keys]
    if renamed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return df.join(F.broadcast(renamed), condition, how).drop(*[f"_k_{k}" for k in keys])
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*[c for c in df.columns if c not in keys]), F.lit(SALTS)))
    copies = renamed.withColumn("_salted", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    condition = [salted[k].eqNullSafe(copies[f"_k_{k}"]) for k in keys] + [salted["_salt"] == copies["_salted"]]
    return salted.join(copies, condition, how).drop("_salt", "_salted", *[f"_k_{k}" for k in keys])
