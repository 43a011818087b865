"""Pixel tables of decoded granules, bathymetry and feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from gridloom import config
from gridloom.functions import geo, names, scores


def standardize(df: DataFrame) -> DataFrame:
    """Canonical axis and variable names."""
    wanted = {**config.AXIS_ALIASES, **config.SOURCE_VARIABLES}
    return df.withColumnsRenamed({old: new for old, new in wanted.items() if old in df.columns and old != new})


def _tolerant(spark: SparkSession, path: str, options: dict[str, str] | None = None) -> DataFrame:
    """Rows of all readable files. Should the file that gives the schema be damaged, all footers are asked for it."""
    reader = spark.read.options(**(options or {})).option("ignoreCorruptFiles", "true")
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if "UNABLE_TO_INFER_SCHEMA" not in str(error):
            raise
        return reader.option("mergeSchema", "true").parquet(path)


def read_observations(
    spark: SparkSession, path: str, variable: str, years: list[int] | None = None,
    bbox: tuple[float, float, float, float] | None = config.STUDY_BBOX, pad: float = config.GRANULE_PAD,
    required: bool = False,
) -> DataFrame:
    """Pixels ``(time, lat, lon, value)`` of one variable.

    The table is partitioned by ``variable, year``: both filters prune folders, the box prunes
    row groups. Unreadable files are skipped, ``skipped_files`` names them; with ``required`` an empty
    result is an error.
    """
    df = standardize(_tolerant(spark, path))
    missing = {"variable", "time", "lat", "lon", "value"} - set(df.columns)
    if missing:
        raise ValueError(f"observation table lacks {sorted(missing)}")
    picked = df.where(F.col("variable") == variable)
    if years:
        picked = picked.where(F.col("year").isin(years))
    if bbox:
        picked = picked.where(geo.in_box(F.col("lat"), F.col("lon"), bbox, pad))
    if required and picked.isEmpty():
        raise ValueError(f"no usable pixels of {variable!r}")
    return picked.select("time", "lat", "lon", scores.nan_to_null(F.col("value").cast("double")).alias("value"))


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """``file, promised, read, checksum`` of every Parquet file below ``path``.

    ``promised`` are the rows its footer tells (NULL: no row, or no footer), ``read`` those that a tolerant
    scan of all its columns yields, ``checksum`` combines their hashes and does not depend on their order.
    """
    plain = lambda c: F.regexp_replace(F.regexp_replace(c, "%20", " "), "^file:/+", "/")
    within = {"recursiveFileLookup": "true", "pathGlobFilter": "*.parquet"}
    found = spark.read.format("binaryFile").options(**within).load(path).select(plain(F.col("path")).alias("file"))
    reader = spark.read.options(**within).option("ignoreCorruptFiles", "true")
    at = plain(F.col("_metadata.file_path")).alias("file")
    # A column that no file has: rows are taken from the footers, no page is read.
    footers = reader.schema("_none string").parquet(path).groupBy(at).agg(F.count(F.lit(1)).alias("promised"))
    rows = _tolerant(spark, path, within)
    whole = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    read = rows.select(at, whole.alias("hash")).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.bit_xor("hash").alias("checksum"))
    # Tied to the checksum, the count cannot be answered without reading the pages.
    seen = F.when(F.col("checksum").isNull(), F.lit(0)).otherwise(F.col("n")).cast("long")
    return found.join(footers, "file", "left").join(read, "file", "left").select("file", "promised", seen.alias("read"), "checksum")


# A file without rows is little more than its footer; one beyond this size that yields none is damaged.
FOOTER_BYTES = 16 << 20


def skipped_files(spark: SparkSession, path: str) -> DataFrame:
    """``file, promised, read`` of every damaged Parquet file below ``path``: without a footer, or read in part.

    Files with a sound end and no rows are not damaged. Only files that yield no row are listed on the
    driver, which looks at the end of each.
    """
    counted = file_rows(spark, path)
    rowless = [r["file"] for r in counted.where("promised IS NULL").select("file").collect()]
    partly = counted.where("read < promised").select("file", "promised", "read")
    if not rowless:
        return partly
    ends = spark.read.format("binaryFile").load(rowless).where(F.col("length") <= FOOTER_BYTES)
    # Parquet ends with its footer, the footer's length as four little-endian bytes, and a mark.
    length = F.expr("CAST(conv(concat(hex(substring(content, -5, 1)), hex(substring(content, -6, 1)), hex(substring(content, -7, 1)), hex(substring(content, -8, 1))), 16, 10) AS BIGINT)")
    marks = (F.expr("substring(content, 1, 4)") == F.lit(b"PAR1")) & (F.expr("substring(content, -4, 4)") == F.lit(b"PAR1"))
    sound = ends.where(marks & (F.col("length") > 12) & (length <= F.col("length") - 12))
    plain = F.regexp_replace(F.regexp_replace("path", "%20", " "), "^file:/+", "/")
    unsound = counted.where("promised IS NULL").join(sound.select(plain.alias("file")), "file", "left_anti")
    return partly.unionByName(unsound.select("file", "promised", "read"))


def with_granule_time(df: DataFrame, name: Column, modified: Column | None = None) -> DataFrame:
    """Composite time from the granule name, else the file's own time.

    For a table just read from files pass ``_metadata.file_name`` and
    ``_metadata.file_modification_time``.
    """
    return df.withColumn("time", names.granule_time(name, modified))


def write_observations(df: DataFrame, path: str, mode: str = "append") -> None:
    """``(variable, time, lat, lon, value)`` partitioned by variable and year.

    Files are clustered by time and place so that row-group statistics prune boxes. Rows are
    range-partitioned on the full order, so a variable with most of the rows spreads out.
    """
    laid_out = df.withColumn("year", F.year("time"))
    order = ["variable", "year", "time", "lat", "lon"]
    laid_out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("variable", "year").parquet(path)


def read_bathymetry(spark: SparkSession, path: str, bbox=config.STUDY_BBOX) -> DataFrame:
    """Depth pixels ``(lat, lon, depth)`` inside a box, from parquet or CSV."""
    reader = spark.read
    df = reader.schema("lat double, lon double, depth float").option("header", True).csv(path) if path.endswith(".csv") else standardize(reader.parquet(path))
    return df.where(geo.in_box(F.col("lat"), F.col("lon"), bbox)).select("lat", "lon", scores.nan_to_null(F.col("depth").cast("float")).alias("depth"))


def read_matrix(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_matrix(matrix: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Feature table partitioned by year, range-laid by date and cell inside it."""
    order = ["year", "date", "iy", "ix"]
    laid_out = matrix.withColumn("year", F.year("date"))
    laid_out.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).partitionBy("year").parquet(path)


def save_cube(cube: DataFrame, path: str, attributes: dict[str, str], mode: str = "overwrite") -> None:
    """Wide cube as parquet plus one side row per attribute (resolution, box, creation, years)."""
    spark = cube.sparkSession
    write_matrix(cube.withColumn("date", F.to_date("time")), f"{path}/cells", mode)
    rows = [(k, str(v)) for k, v in attributes.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode(mode).parquet(f"{path}/attributes")


def load_cube(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """The cube and its handful of attributes."""
    attributes = {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/attributes").collect()}
    return spark.read.parquet(f"{path}/cells").drop("date", "year"), attributes


def write_forecast(forecast: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``lat, lon, yield`` as CSV under ``species=.../time=...`` folders; an empty forecast is an error."""
    if forecast.isEmpty():
        raise ValueError("nothing to export")
    forecast.select("lat", "lon", "yield", "time", "species").write.mode(mode).partitionBy("species", "time").option(
        "header", True
    ).csv(path)
