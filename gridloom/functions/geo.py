"""Column expressions on coordinates: boxes, regions, snapping, cell areas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom import config


def in_box(lat: Column, lon: Column, bbox: tuple[float, float, float, float], pad: float = 0.0) -> Column:
    """Closed box test; plain range predicates, so a parquet scan can skip row groups."""
    lon_min, lat_min, lon_max, lat_max = bbox
    return lat.between(lat_min - pad, lat_max + pad) & lon.between(lon_min - pad, lon_max + pad)


def region_box(region: config.Region) -> tuple[float, float, float, float]:
    return (region.lon_min, region.lat_min, region.lon_max, region.lat_max)


def first_region(lat: Column, lon: Column, regions=config.REGIONS) -> Column:
    """Name of the first listed region that contains the point, else NULL."""
    choice = F.lit(None).cast("string")
    for region in reversed(regions):
        choice = F.when(in_box(lat, lon, region_box(region)), F.lit(region.name)).otherwise(choice)
    return choice


def all_regions(lat: Column, lon: Column, regions=config.REGIONS) -> Column:
    """Array of every region that contains the point; explode it for overlapping groups."""
    hits = [F.when(in_box(lat, lon, region_box(r)), F.lit(r.name)) for r in regions]
    return F.array_compact(F.array(*hits))


def snap(c: Column, digits: int = 1) -> Column:
    """Half-even rounding on the scaled value."""
    scale = float(10**digits)
    return F.rint(c * scale) / scale


def cell_index(c: Column, origin: float, res: float) -> Column:
    return F.rint((c - origin) / res).cast("int")


def cell_area_km2(lat: Column, res: float) -> Column:
    side = res * config.KM_PER_DEGREE
    return side * side * F.cos(F.radians(lat))


def is_ocean(depth: Column) -> Column:
    """Depth below zero; a cell of unknown depth counts as land."""
    return F.coalesce(depth < 0, F.lit(False))
