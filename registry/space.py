"""Grid and spatial queries."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gridloom.functions import geo
from gridloom.operators import analytics, coarsen, coast, gradients, histograms, neighbourhood, regrid, temporal
from gridloom.operators.grid import Grid
from registry import tables as t
from registry.base import query
from registry.tables import region_case, sql_over


@query("grid", sql_over("grid", "SELECT iy, ix, lat, lon FROM grid"))
def grid(spark, sf):
    return t.grid_of(spark, sf).cells(spark)


@query("cell_area", sql_over("grid", "SELECT iy, ix, round((0.5 * 111.32)::DOUBLE * (0.5 * 111.32 * cos(radians(lat))), 6) AS area_km2 FROM grid"))
def cell_area(spark, sf):
    return t.grid_of(spark, sf).cells(spark).select("iy", "ix", geo.cell_area_km2(F.col("lat"), t.RES).alias("area_km2"))


@query("disk_kernel", sql_over("geom", """SELECT CAST(km AS INTEGER) AS km, CAST(dy AS INTEGER) AS dy, CAST(dx AS INTEGER) AS dx FROM (
    SELECT km, least(km / 55.66::DOUBLE, km / (55.66::DOUBLE * cosl)) AS r FROM geom, (SELECT unnest([60, 120, 180]) AS km))
    CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx) WHERE dx * dx + dy * dy <= r * r"""))
def disk_kernel(spark, sf):
    g = t.grid_of(spark, sf)
    parts = [neighbourhood.disk_offsets(spark, g.radius_cells(km)).select(F.lit(km).alias("km"), "dy", "dx") for km in t.RADII_KM]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _gradient(value: str, keys: str) -> str:
    """One-sided at the ends, central inside; needs every cell of a slice as a row."""
    part = f"{keys}, " if keys else ""
    return f"""SELECT *, CASE WHEN ix = 0 THEN xn - v WHEN ix = nx - 1 THEN v - xp ELSE (xn - xp) / 2 END AS gx,
        CASE WHEN iy = 0 THEN yn - v WHEN iy = ny - 1 THEN v - yp ELSE (yn - yp) / 2 END AS gy
      FROM (SELECT *, {value} AS v, lag({value}) OVER (PARTITION BY {part}iy ORDER BY ix) AS xp, lead({value}) OVER (PARTITION BY {part}iy ORDER BY ix) AS xn,
        lag({value}) OVER (PARTITION BY {part}ix ORDER BY iy) AS yp, lead({value}) OVER (PARTITION BY {part}ix ORDER BY iy) AS yn FROM {{table}}), dims, geom"""


SLOPE = _gradient("depth", "").format(table="bathy")
FRONT = _gradient("sst", "time").format(table="dense")


@query("bathy_slope", sql_over("bathy geom", f"SELECT iy, ix, round(degrees(atan(sqrt((gx / (55660 * cosl)) ** 2 + (gy / 55660::DOUBLE) ** 2))), 6) AS slope FROM ({SLOPE})"))
def bathy_slope(spark, sf):
    return gradients.slope_degrees(t.bathy(spark, sf), t.grid_of(spark, sf)).select("iy", "ix", "slope")


@query("frontal_index", sql_over("dense geom", f"""SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(sqrt((gx / 0.5::DOUBLE / cosl) ** 2 + (gy / 0.5::DOUBLE) ** 2), 6) AS frontal_index
    FROM ({FRONT}) WHERE v IS NOT NULL"""))
def frontal_index(spark, sf):
    # Cells without a row read as missing neighbours, so observations need no densifying.
    return gradients.frontal_index(t.obs(spark, sf), t.grid_of(spark, sf)).select("iy", "ix", "time", "frontal_index")


@query("dist_to_coast", sql_over("bathy geom", """SELECT a.iy, a.ix, round(min(sqrt(((a.lon - b.lon) * cosl) ** 2 + (a.lat - b.lat) ** 2)) * 111.32::DOUBLE, 6) AS dist_coast
    FROM bathy a CROSS JOIN (SELECT * FROM bathy WHERE NOT depth < 0) b, geom GROUP BY 1, 2"""))
def dist_to_coast(spark, sf):
    return coast.distance_to_coast(t.bathy(spark, sf), t.grid_of(spark, sf)).select("iy", "ix", "dist_coast")


def _target(g: Grid, res: float) -> Grid:
    """A finer or coarser grid, off the source axes and reaching past them."""
    steps = lambda n: math.floor((n - 1) * t.RES / res) + 3
    return Grid(4.4, 115.8, res, steps(g.ny), steps(g.nx))


def _target_sql(res: float) -> str:
    return f"""targets AS (SELECT CAST(j AS INTEGER) AS ty, CAST(k AS INTEGER) AS tx, round(4.4::DOUBLE + j * {res}::DOUBLE, 6) AS lat, round(115.8::DOUBLE + k * {res}::DOUBLE, 6) AS lon
      FROM (SELECT unnest(range(CAST(floor(((SELECT ny FROM dims) - 1) * 0.5 / {res}) AS BIGINT) + 3)) AS j)
      CROSS JOIN (SELECT unnest(range(CAST(floor(((SELECT nx FROM dims) - 1) * 0.5 / {res}) AS BIGINT) + 3)) AS k))"""


BILINEAR = f"""WITH {_target_sql(0.2)},
    weights AS (SELECT ty, tx, lat, lon, i, j, (lat - (4.5 + i * 0.5)) / 0.5::DOUBLE AS wy, (lon - (116 + j * 0.5)) / 0.5::DOUBLE AS wx FROM
      (SELECT *, CAST(floor(round((lat - 4.5) / 0.5, 9)) AS INTEGER) AS i, CAST(floor(round((lon - 116) / 0.5, 9)) AS INTEGER) AS j FROM targets)
      WHERE lat BETWEEN 4.5 AND 4.5 + ((SELECT ny FROM dims) - 1) * 0.5 AND lon BETWEEN 116 AND 116 + ((SELECT nx FROM dims) - 1) * 0.5),
    corners AS (SELECT ty, tx, lat, lon, i + di AS iy, j + dj AS ix,
        (CASE di WHEN 0 THEN 1 - wy ELSE wy END) * (CASE dj WHEN 0 THEN 1 - wx ELSE wx END) AS w
      FROM weights CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) AS c(di, dj)
      WHERE (CASE di WHEN 0 THEN 1 - wy ELSE wy END) * (CASE dj WHEN 0 THEN 1 - wx ELSE wx END) > 1e-9),
    needed AS (SELECT ty, tx, count(*) AS n FROM corners GROUP BY 1, 2)
    SELECT CAST(o.time AS VARCHAR) AS time, c.ty AS iy, c.tx AS ix, c.lat, c.lon, round(sum(c.w * o.sst), 6) AS sst
    FROM corners c JOIN obs o ON o.iy = c.iy AND o.ix = c.ix JOIN needed n ON n.ty = c.ty AND n.tx = c.tx
    WHERE o.sst IS NOT NULL GROUP BY o.time, c.ty, c.tx, c.lat, c.lon, n.n HAVING count(*) = n.n"""


@query("regrid_bilinear", sql_over("obs dims", BILINEAR))
def regrid_bilinear(spark, sf):
    return regrid.regrid_bilinear(t.obs(spark, sf), _target(t.grid_of(spark, sf), 0.2), "sst")


NEAREST = f"""WITH {_target_sql(0.7)},
    pick AS (SELECT ty, tx, lat, lon,
      CAST(least(greatest(ceil((lat - 4.5) / 0.5 - 0.5), 0), (SELECT ny FROM dims) - 1) AS INTEGER) AS iy,
      CAST(least(greatest(ceil((lon - 116) / 0.5 - 0.5), 0), (SELECT nx FROM dims) - 1) AS INTEGER) AS ix FROM targets)
    SELECT CAST(o.time AS VARCHAR) AS time, p.ty AS iy, p.tx AS ix, p.lat, p.lon, round(o.sst, 6) AS sst FROM pick p JOIN obs o ON o.iy = p.iy AND o.ix = p.ix WHERE o.sst IS NOT NULL"""


@query("regrid_bilinear_known_raster", sql_over("obs dims", BILINEAR))
def regrid_known_raster(spark, sf):
    """The same with the source raster given, so that the axes need no pass over the data."""
    g = t.grid_of(spark, sf)
    return regrid.regrid_bilinear(t.obs(spark, sf), _target(g, 0.2), "sst", source=g)


@query("regrid_nearest", sql_over("obs dims", NEAREST))
def regrid_nearest(spark, sf):
    return regrid.regrid_nearest(t.obs(spark, sf), _target(t.grid_of(spark, sf), 0.7), "sst")


def _disk_sql(km: float, out: str) -> str:
    r2 = (km / (111.32 * 0.5)) ** 2
    return f"""{out} AS (SELECT d.time, d.iy, d.ix, sum(s.sst) / count(s.sst) AS m FROM dense d, dims
      CROSS JOIN (SELECT unnest(range(-4, 5)) AS dy) CROSS JOIN (SELECT unnest(range(-4, 5)) AS dx)
      JOIN dense s ON s.time = d.time AND s.iy = least(greatest(d.iy + dy, 0), ny - 1) AND s.ix = least(greatest(d.ix + dx, 0), nx - 1)
      WHERE dy * dy + dx * dx <= {r2!r}::DOUBLE GROUP BY 1, 2, 3)"""


@query("spatial_mean", sql_over("dense dims", f"WITH {_disk_sql(120, 'a')} SELECT CAST(time AS VARCHAR) AS time, iy, ix, round(m, 6) AS mean120 FROM a"))
def spatial_mean(spark, sf):
    g = t.grid_of(spark, sf)
    dense = temporal.densify(t.obs(spark, sf), g, ["sst"])
    wanted = {"mean120": ("sst", g.radius_cells(120))}
    return neighbourhood.neighbourhood_means(dense, g, wanted).select("time", "iy", "ix", "mean120")


@query("spatial_lag", sql_over("dense dims", f"""WITH {_disk_sql(60, 'a')}, {_disk_sql(120, 'b')}, {_disk_sql(180, 'c')}
    SELECT CAST(d.time AS VARCHAR) AS time, d.iy, d.ix, round(coalesce(d.sst, a.m), 6) AS sst_lag60km, round(coalesce(d.sst, b.m), 6) AS sst_lag120km, round(coalesce(d.sst, c.m), 6) AS sst_lag180km
    FROM dense d JOIN a ON a.time = d.time AND a.iy = d.iy AND a.ix = d.ix JOIN b ON b.time = d.time AND b.iy = d.iy AND b.ix = d.ix JOIN c ON c.time = d.time AND c.iy = d.iy AND c.ix = d.ix"""))
def spatial_lag(spark, sf):
    g = t.grid_of(spark, sf)
    dense = temporal.densify(t.obs(spark, sf), g, ["sst"])
    lagged = neighbourhood.spatial_lags(dense, g, ("sst",), t.RADII_KM)
    return lagged.select("time", "iy", "ix", *[f"sst_lag{r}km" for r in t.RADII_KM])


@query("coarsen_grid", sql_over("obs dims", """SELECT CAST(time AS VARCHAR) AS time, iy // 3 AS "by", ix // 3 AS bx,
    round(4.5::DOUBLE + ((iy // 3) * 3 + 1) * 0.5::DOUBLE, 6) AS lat, round(116::DOUBLE + ((ix // 3) * 3 + 1) * 0.5::DOUBLE, 6) AS lon, round(avg(sst), 6) AS sst
    FROM obs, dims WHERE iy < ny - ny % 3 AND ix < nx - nx % 3 GROUP BY time, iy // 3, ix // 3"""))
def coarsen_blocks(spark, sf):
    return coarsen.coarsen_grid(t.obs(spark, sf), t.grid_of(spark, sf), 3, "sst")


@query("coarsen_valid_axes", sql_over("obs", """WITH ok AS (SELECT lat, lon, chl FROM obs WHERE chl IS NOT NULL AND time = (SELECT max(time) FROM obs)),
    la AS (SELECT lat, row_number() OVER (ORDER BY lat) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT lat FROM ok)),
    lo AS (SELECT lon, row_number() OVER (ORDER BY lon) - 1 AS p, count(*) OVER () AS n FROM (SELECT DISTINCT lon FROM ok)),
    b AS (SELECT la.p // 2 AS bp, lo.p // 2 AS bq, avg(chl) AS chl FROM ok JOIN la USING (lat) JOIN lo USING (lon) WHERE la.p < la.n - la.n % 2 AND lo.p < lo.n - lo.n % 2 GROUP BY 1, 2)
    SELECT la.lat, lo.lon, round(b.chl, 6) AS chl FROM b JOIN la ON la.p = b.bp * 2 JOIN lo ON lo.p = b.bq * 2"""))
def coarsen_valid(spark, sf):
    return coarsen.coarsen_valid_axes(temporal.at_latest_time(t.obs(spark, sf)), 2, "chl")


@query("region_of", sql_over("grid", f"SELECT iy, ix, {region_case()} AS region FROM grid"))
def region_of(spark, sf):
    return analytics.with_region(t.grid_of(spark, sf).cells(spark)).select("iy", "ix", "region")


@query("snap_cells", """SELECT c_custkey, round_even(CAST(c_acctbal / 100 AS DOUBLE) * 10, 0)::DOUBLE / 10 + 0.0::DOUBLE AS snapped,
    round_even(CAST(c_custkey * 0.05::DOUBLE AS DOUBLE) * 10, 0)::DOUBLE / 10 + 0.0::DOUBLE AS halves FROM customer""")
def snap_cells(spark, sf):
    c = t.read(spark, sf, "customer")
    return c.select("c_custkey", geo.snap(F.col("c_acctbal") / 100).alias("snapped"), geo.snap(F.col("c_custkey") * F.lit(0.05)).alias("halves"))


@query("coverage_hist", sql_over("obs", """SELECT iy, ix, round(count(*) / (SELECT count(DISTINCT time) FROM obs WHERE chl IS NOT NULL)::DOUBLE, 6) AS coverage FROM obs WHERE chl IS NOT NULL GROUP BY 1, 2"""))
def coverage_hist(spark, sf):
    return histograms.coverage(t.obs(spark, sf).select("lat", "lon", "time", "chl"), t.grid_of(spark, sf), "chl")
