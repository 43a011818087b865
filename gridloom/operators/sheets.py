"""Statistical matrix sheets, given as cells ``(file, row_no, col_no, cell)``.

A sheet has a title in its first cell, a year row (one label per four-quarter block), a quarter
row, and below them one block per place with a row per species.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom import config


def matrix_files(cells: DataFrame, title: str = config.SHEET_TITLE) -> DataFrame:
    first = (F.col("row_no") == 1) & (F.col("col_no") == 1)
    return cells.where(first & F.contains("cell", F.lit(title))).select("file")


def _year(cell):
    number = F.expr("try_cast(trim(cell) AS INT)")
    low, high = config.SHEET_YEARS
    return F.when(F.trim(cell).rlike(r"^\d+$") & number.between(low, high), number)


def _header_of_file(cells: DataFrame) -> DataFrame:
    """``(file, quarter_row, header)`` from one pass: per quarter column ``col_no, year, quarter``.

    The quarter row is the first that holds "Quarter 1", the year row the nearest dated one within
    four rows above. A column belongs to the nearest year label at or left of it. Only label cells are
    shuffled; a file has one row, as wide as its sheet.
    """
    quarter = F.when(F.startswith("cell", F.lit("Quarter")), F.element_at(F.split("cell", r"\s+"), -1).try_cast("int"))
    marks = cells.select(
        "file", "row_no", "col_no", _year(F.col("cell")).alias("year"), quarter.alias("quarter"), (F.col("cell") == "Quarter 1").alias("first")
    ).where("year IS NOT NULL OR quarter IS NOT NULL")
    rows = marks.groupBy("file", "row_no").agg(
        F.bool_or("first").alias("first"),
        F.collect_list(F.when(F.col("year").isNotNull(), F.struct("col_no", "year"))).alias("years"),
        F.collect_list(F.when(F.col("quarter").isNotNull(), F.struct("col_no", "quarter"))).alias("quarters"),
    )
    at = F.min(F.when(F.col("first"), F.col("row_no"))).over(Window.partitionBy("file"))
    head = rows.withColumn("quarter_row", at).where("row_no BETWEEN quarter_row - 4 AND quarter_row")
    above = F.when((F.size("years") > 0) & (F.col("row_no") < F.col("quarter_row")), F.col("row_no"))
    files = head.groupBy("file", "quarter_row").agg(
        F.array_sort(F.max_by("years", above)).alias("years"),
        F.max_by("quarters", F.when(F.col("row_no") == F.col("quarter_row"), F.col("row_no"))).alias("quarters"),
    )

    def labelled(column):
        left = F.filter("years", lambda y: y["col_no"] <= column["col_no"])
        return F.struct(column["col_no"].alias("col_no"), F.try_element_at(left, F.lit(-1))["year"].alias("year"), column["quarter"].alias("quarter"))

    whole = F.filter(F.transform("quarters", labelled), lambda c: c["year"].isNotNull())
    return files.select("file", "quarter_row", whole.alias("header"))


def matrix_headers(cells: DataFrame) -> DataFrame:
    """``(file, col_no, year, quarter)``: a quarter column belongs to the nearest year label at or
    left of it."""
    return _header_of_file(cells).select("file", F.inline("header"))


def _body(cells: DataFrame) -> DataFrame:
    """``(file, row_no, geo, label, numbers, header)`` below the header, the place carried down its block.

    ``numbers`` holds the row's ``col_no, volume_mt``. The window runs over the rows of one file; a
    sheet cannot have more than 1,048,576 of them, so no file outgrows a task.
    """
    number = F.when(F.col("col_no") > 2, F.expr("try_cast(cell AS DOUBLE)"))
    used = cells.withColumn("volume_mt", number).where("cell IS NOT NULL AND (col_no <= 2 OR volume_mt IS NOT NULL)")
    rows = used.groupBy("file", "row_no").agg(
        F.max(F.when(F.col("col_no") == 1, F.col("cell"))).alias("own"),
        F.max(F.when(F.col("col_no") == 2, F.col("cell"))).alias("label"),
        F.collect_list(F.when(F.col("volume_mt").isNotNull(), F.struct("col_no", "volume_mt"))).alias("numbers"),
    )
    below = rows.join(_header_of_file(cells), "file").where("row_no > quarter_row")
    downwards = Window.partitionBy("file").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    filled = below.withColumn("geo", F.last("own", ignorenulls=True).over(downwards))
    return filled.where(F.col("label").isNotNull()).select("file", "row_no", "geo", "label", "numbers", "header")


def matrix_rows(cells: DataFrame) -> DataFrame:
    """``(file, row_no, geo, label)`` below the header, the place carried down its block."""
    return _body(cells).select("file", "row_no", "geo", "label")


def is_province(geo):
    return F.coalesce(F.startswith(geo, F.lit(config.PROVINCE_PREFIX)) | (geo == config.CAPITAL_REGION), F.lit(False))


def species_of(label, names: dict[str, str]):
    """Species code of a row label through a literal map; NULL for labels that are not followed."""
    pairs = [F.lit(part) for item in names.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), label)


def matrix_values(cells: DataFrame, names: dict[str, str] = config.SHEET_SPECIES) -> DataFrame:
    """Unpivoted sheet: ``(file, geo_raw, species, year, quarter, volume_mt)``.

    Empty cells, dots and text that is no number are left out. Cells are read twice: for the headers
    and for the rows, which carry their numbers, so that nothing is joined but one header per file.
    """
    rows = _body(cells).withColumn("species", species_of(F.col("label"), names))
    rows = rows.where(is_province(F.col("geo")) & F.col("species").isNotNull())
    places = F.map_from_entries(F.transform("header", lambda c: F.struct(c["col_no"], F.struct(c["year"].alias("year"), c["quarter"].alias("quarter")))))
    each = rows.withColumn("places", places).select("file", "geo", "species", "places", F.inline("numbers"))
    placed = each.withColumn("place", F.try_element_at("places", F.col("col_no"))).where("place IS NOT NULL")
    return placed.select("file", F.col("geo").alias("geo_raw"), "species", "place.year", "place.quarter", "volume_mt")
