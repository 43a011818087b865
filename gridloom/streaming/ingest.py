"""Incremental ingestion as Structured Streaming jobs. Batch twins use the same functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gridloom.sources.catalog import GRANULE_KEY, upsert

COMPOSITE = "8 days"


def granule_stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None, pattern: str | None = None) -> DataFrame:
    """New files of a folder (of those that match ``pattern``); the checkpoint remembers which have been read."""
    reader = spark.readStream.schema(schema)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def _watermarked(df: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need a zoned timestamp; zoneless ones are read in the session zone."""
    return df.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def first_per_key(granules: DataFrame, time: str = "start_time", late: str | None = None) -> DataFrame:
    """One row per granule key.

    The state is the manifest: one key per granule ever seen, so backfilled files are never lost.
    For sources that arrive in time order, ``late`` bounds the state; rows older than that are
    then dropped.
    """
    if late is None or not granules.isStreaming:
        return granules.dropDuplicates(GRANULE_KEY)
    return _watermarked(granules, time, late).dropDuplicatesWithinWatermark(GRANULE_KEY)


def calendar_window(time) -> Column:
    """First day of the product's 8-day window, which starts anew on 1 January."""
    first = F.trunc(time, "year")
    return F.date_add(first, F.floor(F.date_diff(F.to_date(time), first) / 8).cast("int") * 8).cast("timestamp")


def calendar_composite(observations: DataFrame, keys: list[str], value: str = "value", time: str = "ts", late: str = COMPOSITE) -> DataFrame:
    """Mean per cell and calendar window, so that windows line up with granule times.

    A stream emits a window once one that begins ``late`` after it has been seen.
    """
    placed = observations.withColumn("window_start", calendar_window(F.col(time)))
    timed = placed.withWatermark("window_start", late) if observations.isStreaming else placed
    return timed.groupBy("window_start", *keys).agg(F.avg(value).alias(value), F.count(value).alias("n"))


def composite(observations: DataFrame, keys: list[str], value: str = "value", time: str = "ts", late: str = COMPOSITE) -> DataFrame:
    """Mean per cell and 8-day window of whatever was observed; a stream waits ``late`` for stragglers.

    Partial sums per (window, cell) form before the shuffle, so a busy cell costs one row per task.
    """
    timed = _watermarked(observations, time, late) if observations.isStreaming else observations
    return (
        timed.groupBy(F.window(time, COMPOSITE), *keys)
        .agg(F.avg(value).alias(value), F.count(value).alias("n"))
        .select(F.col("window.start").alias("window_start"), *keys, value, "n")
    )


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Processes what is there, writes parquet exactly once, stops."""
    query = (
        df.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


APPLIED = "app string, batch bigint"


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Folders of the complete versions of a manifest, the oldest first."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return []
    named = [s.getPath() for s in files.listStatus(root) if s.getPath().getName().startswith("version-")]
    return sorted(p.toString() for p in named if files.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_DONE")))


def upsert_batch(batch: DataFrame, batch_id: int, path: str, app: str, sequence: str = "seq") -> bool:
    """Merges a batch into the manifest below ``path``; False where that batch of ``app`` is in it already.

    A version holds all entries, one per granule key, and the last batch of each stream that wrote to it. It
    counts once its marker exists, so a batch that broke off leaves the version before it and is done again.
    The version before stays for those who read it, older ones are deleted. One writer at a time.
    """
    spark = batch.sparkSession
    known = _versions(spark, path)
    applied = {r["app"]: r["batch"] for r in spark.read.schema(APPLIED).parquet(f"{known[-1]}/applied").collect()} if known else {}
    if applied.get(app, -1) >= batch_id:
        return False
    number = int(known[-1].rsplit("-", 1)[1]) + 1 if known else 0
    folder = f"{path.rstrip('/')}/version-{number:012d}"
    entries = spark.read.schema(batch.schema).parquet(f"{known[-1]}/entries").unionByName(batch) if known else batch
    upsert(entries, sequence).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/entries")
    rows = sorted((applied | {app: batch_id}).items())
    spark.createDataFrame(rows, APPLIED).coalesce(1).write.mode("overwrite").parquet(f"{folder}/applied")
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.create(hadoop.Path(folder, "_DONE")).close()
    for old in known[:-1]:
        files.delete(hadoop.Path(old), True)
    return True


def read_manifest(spark: SparkSession, path: str, schema) -> DataFrame:
    """Entries of the last complete version; none where there is no version yet."""
    known = _versions(spark, path)
    return spark.read.schema(schema).parquet(f"{known[-1]}/entries") if known else spark.createDataFrame([], schema)


def manifest_sink(entries: DataFrame, path: str, checkpoint: str, app: str, sequence: str = "seq") -> StreamingQuery:
    """Upserts a stream into the manifest below ``path``, processes what is there and stops.

    State is the manifest on disk: the stream itself keeps no keys. ``app`` names the stream; a repeat of one of
    its batches, as after a restart, changes nothing. A new ``checkpoint`` starts batches anew and needs a new name.
    """
    query = (
        entries.writeStream.foreachBatch(lambda batch, number: upsert_batch(batch, number, path, app, sequence) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query
