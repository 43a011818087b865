"""Column expressions on granule and file names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Where names carry dates.
YEAR_AFTER_DOT = r"\.(\d{4})\d{2}"
ANY_YEAR = r"(\d{4})"
DATE_RANGE = r"_MODIS\.(\d{8})_(\d{8})\."
ANY_DATE = r"(\d{8})"


def _group(name: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def granule_year(name: Column) -> Column:
    return F.coalesce(_group(name, YEAR_AFTER_DOT), _group(name, ANY_YEAR)).cast("int")


def granule_time(name: Column, modified: Column | None = None) -> Column:
    """Midpoint of the composite window in the name, else its date, else the file time."""
    def day(text: Column) -> Column:
        return F.try_to_timestamp(text, F.lit("yyyyMMdd"))

    start = F.unix_micros(day(_group(name, DATE_RANGE, 1)))
    end = F.unix_micros(day(_group(name, DATE_RANGE, 2)))
    midpoint = F.timestamp_micros((start + (end - start) / 2).cast("long"))
    choices = [midpoint, day(_group(name, ANY_DATE))]
    return F.coalesce(*choices, *([] if modified is None else [modified]))


def granule_date(name: Column) -> Column:
    """Date-only variant."""
    return F.to_date(F.try_to_timestamp(_group(name, ANY_DATE), F.lit("yyyyMMdd")))


def glob_matches(name: Column, pattern: str) -> Column:
    """Shell-style name pattern with ``*`` and ``?``."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in pattern)
    return name.rlike(f"^{body}$")


def sector_of_file(file: Column, codes: dict[str, str], otherwise: str) -> Column:
    """Sector named by exactly one known code in a file name."""
    upper = F.upper(file)
    hits = F.array_compact(
        F.array(*[F.when(F.contains(upper, F.lit(code.upper())), F.lit(s)) for code, s in codes.items()])
    )
    return F.when(F.size(hits) == 1, hits[0]).otherwise(F.lit(otherwise))
