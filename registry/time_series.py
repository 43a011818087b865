"""Temporal, index and cube queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import scores
from gridloom.operators import analytics, coast, cube, gradients, temporal
from gridloom.operators.grid import Grid, mask_land
from gridloom.plans import features
from gridloom.session import scratch_path
from registry import tables as t
from registry.base import query
from registry.space import FRONT, _disk_sql
from registry.tables import SQL_TABLES, habitat_sql, sql_over

DAY = "CAST(time AS VARCHAR) AS time"
WIDE = ["sst", "chl", "par", "kd490"]


def _dense(spark, sf, values=WIDE):
    return temporal.densify(t.obs(spark, sf), t.grid_of(spark, sf), values)


@query("densify", sql_over("dense", f"SELECT iy, ix, {DAY}, lat, lon, round(sst, 6) + 0.0::DOUBLE AS sst, round(chl, 6) + 0.0::DOUBLE AS chl, round(par, 6) + 0.0::DOUBLE AS par, round(kd490, 6) + 0.0::DOUBLE AS kd490 FROM dense"))
def densify(spark, sf):
    return _dense(spark, sf)


@query("gap_fill", sql_over("filled", f"SELECT variable, iy, ix, {DAY}, round(value, 6) + 0.0::DOUBLE AS value, filled FROM filled"))
def gap_fill(spark, sf):
    return temporal.gap_fill(t.pixels(spark, sf), grid=t.grid_of(spark, sf))


CATALOGUE = SQL_TABLES["filled"][1].replace("(SELECT DISTINCT variable, time FROM pixels) a", "(SELECT variable, time FROM (SELECT DISTINCT variable FROM pixels) CROSS JOIN (SELECT time FROM axis)) a")


@query("gap_fill_catalogue", sql_over("pixels grid axis", f"SELECT variable, iy, ix, {DAY}, round(value, 6) + 0.0::DOUBLE AS value, filled FROM ({CATALOGUE})"))
def gap_fill_catalogue(spark, sf):
    """Steps counted on the composites of the catalogue, also those where a variable has no pixel at all."""
    composites = t.obs(spark, sf).select("time", F.explode(F.array(*[F.lit(v) for v in WIDE])).alias("variable")).distinct()
    return temporal.gap_fill(t.pixels(spark, sf), axis_from=composites, grid=t.grid_of(spark, sf))


@query("long_gap_mask", sql_over("dense", f"""SELECT iy, ix, {DAY}, chl IS NULL AND sum(CASE WHEN chl IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY iy, ix, rid) > 4 AS long_gap
    FROM (SELECT *, count(chl) OVER (PARTITION BY iy, ix ORDER BY time) AS rid FROM dense)"""))
def long_gap_mask(spark, sf):
    return temporal.long_gaps(_dense(spark, sf, ["chl"]), "chl", 4).select("iy", "ix", "time", "long_gap")


@query("climatology_fill", sql_over("dense", f"SELECT iy, ix, {DAY}, round(coalesce(chl, avg(chl) OVER (PARTITION BY iy, ix, month(time))), 6) AS chl FROM dense"))
def climatology_fill(spark, sf):
    return temporal.climatology_fill(_dense(spark, sf, ["chl"]), ["chl"]).select("iy", "ix", "time", "chl")


def _roll(v: str, n: int) -> str:
    return f"avg({v}) OVER (PARTITION BY iy, ix ORDER BY time ROWS BETWEEN {n // 2} PRECEDING AND {n - 1 - n // 2} FOLLOWING)"


@query("rolling_mean", sql_over("dense", f"SELECT iy, ix, {DAY}, " + ", ".join(f"round({_roll('chl', n)}, 6) + 0.0::DOUBLE AS chl_roll{d}d" for d, n in ((7, 1), (14, 2), (30, 4), (90, 11))) + " FROM dense"))
def rolling_mean(spark, sf):
    dense = _dense(spark, sf, ["chl"])
    out = temporal.with_rolling_means(dense, ["chl"], temporal.rolling_steps(t.obs(spark, sf)))
    return out.select("iy", "ix", "time", *[f"chl_roll{d}d" for d in config.ROLLING_DAYS])


@query("median_step", sql_over("axis", "SELECT CAST(quantile_cont(days, 0.5) AS DOUBLE) AS median_step FROM (SELECT date_diff('day', time, lead(time) OVER (ORDER BY time)) AS days FROM axis)"))
def median_step(spark, sf):
    return temporal.median_step(t.obs(spark, sf))


@query("monthly_climatology", sql_over("obs", "SELECT iy, ix, CAST(month(time) AS INTEGER) AS month, round(avg(sst), 6) + 0.0::DOUBLE AS sst, round(avg(chl), 6) + 0.0::DOUBLE AS chl FROM obs GROUP BY 1, 2, 3"))
def monthly_climatology(spark, sf):
    return temporal.monthly_climatology(t.obs(spark, sf), ["sst", "chl"])


@query("anomaly", sql_over("obs", f"SELECT iy, ix, {DAY}, round(sst - avg(sst) OVER (PARTITION BY iy, ix, month(time)), 6) + 0.0::DOUBLE AS sst_anom FROM obs"))
def anomaly(spark, sf):
    return temporal.with_anomalies(t.obs(spark, sf), ["sst"]).select("iy", "ix", "time", "sst_anom")


@query("month_sin_cos", sql_over("axis", f"SELECT {DAY}, round(sin(2 * pi() * month(time) / 12), 6) + 0.0::DOUBLE AS month_sin, round(cos(2 * pi() * month(time) / 12), 6) + 0.0::DOUBLE AS month_cos FROM axis"))
def month_sin_cos(spark, sf):
    return temporal.with_season(temporal.time_options(t.obs(spark, sf)))


TEMPORAL = ", ".join(
    [f"round({v}, 6) + 0.0::DOUBLE AS {v}" for v in WIDE]
    + [f"round({_roll(v, n)}, 6) + 0.0::DOUBLE AS {v}_roll{d}d" for v in WIDE for d, n in ((7, 1), (14, 2), (30, 4), (90, 11))]
    + [f"round({v} - avg({v}) OVER (PARTITION BY iy, ix, month(time)), 6) + 0.0::DOUBLE AS {v}_anom" for v in WIDE]
    + [f"round({f}(2 * pi() * month(time) / 12), 6) + 0.0::DOUBLE AS month_{f}" for f in ("sin", "cos")]
)


@query("temporal_features", sql_over("dense", f"SELECT iy, ix, {DAY}, lat, lon, {TEMPORAL} FROM dense"))
def temporal_features(spark, sf):
    return temporal.temporal_features(_dense(spark, sf), temporal.rolling_steps(t.obs(spark, sf)))


@query("cube_assemble", sql_over("cube", f"SELECT iy, ix, {DAY}, round(sst, 6) + 0.0::DOUBLE AS sst, round(chl, 6) + 0.0::DOUBLE AS chl, round(par, 6) + 0.0::DOUBLE AS par, round(kd490, 6) + 0.0::DOUBLE AS kd490 FROM cube"))
def cube_assemble(spark, sf):
    return cube.assemble(temporal.gap_fill(t.pixels(spark, sf), grid=t.grid_of(spark, sf)), WIDE)


@query("long_matrix", sql_over("cube bathy", """SELECT c.iy, c.ix, b.lat, b.lon, CAST(c.time AS VARCHAR) AS time, CAST(c.time AS VARCHAR) AS date,
    round(CASE WHEN depth < 0 THEN sst END, 6) + 0.0::DOUBLE AS sst, round(CASE WHEN depth < 0 THEN chl END, 6) + 0.0::DOUBLE AS chl, round(CASE WHEN depth < 0 THEN par END, 6) + 0.0::DOUBLE AS par, round(CASE WHEN depth < 0 THEN kd490 END, 6) + 0.0::DOUBLE AS kd490, depth
    FROM cube c JOIN bathy b ON b.iy = c.iy AND b.ix = c.ix"""))
def long_matrix(spark, sf):
    wide = cube.assemble(temporal.gap_fill(t.pixels(spark, sf), grid=t.grid_of(spark, sf)), WIDE)
    return cube.to_matrix(mask_land(cube.with_static(wide, t.bathy(spark, sf))))


LAGGED = [(v, km) for v in config.LAG_VARIABLES for km in t.RADII_KM]
ROLLED = [f"{v}_roll{d}d" for v in WIDE for d in config.ROLLING_DAYS]
FEATURES = "WITH " + ", ".join([
    "land AS (SELECT * FROM bathy WHERE NOT depth < 0)",
    f"sl AS (SELECT iy, ix, degrees(atan(sqrt((gx / (55660 * cosl)) ** 2 + (gy / 55660::DOUBLE) ** 2))) AS slope FROM ({FRONT.replace('sst', 'depth').replace('PARTITION BY time, ', 'PARTITION BY ').replace('dense', 'bathy')}))",
    "dc AS (SELECT a.iy, a.ix, min(sqrt(((a.lon - b.lon) * cosl) ** 2 + (a.lat - b.lat) ** 2)) * 111.32::DOUBLE AS dist_coast FROM bathy a CROSS JOIN land b, geom GROUP BY 1, 2)",
    "caxis AS (SELECT DISTINCT time FROM cube)",
    "m AS (SELECT g.iy, g.ix, g.lat, g.lon, a.time, " + ", ".join(f"CASE WHEN b.depth < 0 THEN c.{v} END AS {v}" for v in WIDE)
    + ", b.depth, sl.slope, dc.dist_coast FROM grid g CROSS JOIN caxis a JOIN bathy b ON b.iy = g.iy AND b.ix = g.ix JOIN sl ON sl.iy = g.iy AND sl.ix = g.ix JOIN dc ON dc.iy = g.iy AND dc.ix = g.ix LEFT JOIN cube c ON c.iy = g.iy AND c.ix = g.ix AND c.time = a.time)",
    "fr AS (SELECT iy, ix, time, CASE WHEN v IS NOT NULL THEN sqrt((gx / 0.5::DOUBLE / cosl) ** 2 + (gy / 0.5::DOUBLE) ** 2) END AS frontal_index FROM (" + FRONT.replace("FROM dense", "FROM m") + "))",
    "f AS (SELECT m.*, fr.frontal_index FROM m JOIN fr ON fr.iy = m.iy AND fr.ix = m.ix AND fr.time = m.time)",
    *[_disk_sql(km, f"l{km}_{v}").replace("sst", v).replace("dense", "f") for v, km in LAGGED],
    f"tf AS (SELECT iy, ix, time, {TEMPORAL} FROM m)",
]) + " SELECT f.iy, f.ix, f.lat, f.lon, CAST(f.time AS VARCHAR) AS time, CAST(f.time AS VARCHAR) AS date, f.depth, round(f.slope, 6) + 0.0::DOUBLE AS slope, round(f.dist_coast, 6) + 0.0::DOUBLE AS dist_coast, " + ", ".join(
    f"tf.{c} + 0.0::DOUBLE AS {c}" for c in [*WIDE, *ROLLED, *[f"{v}_anom" for v in WIDE], "month_sin", "month_cos"]
) + ", round(f.frontal_index, 6) + 0.0::DOUBLE AS frontal_index, CASE WHEN tf.sst_anom IS NOT NULL THEN greatest(-tf.sst_anom, 0) + 0.0::DOUBLE END AS upwelling_proxy" \
    + ", round(CASE WHEN f.chl > 0 THEN log10(greatest(f.chl, 1e-4) + 1e-4) END, 6) + 0.0::DOUBLE AS productivity_index, " + ", ".join(
    f"round(coalesce(f.{v}, l{km}_{v}.m), 6) + 0.0::DOUBLE AS {v}_lag{km}km" for v, km in LAGGED
) + " FROM f JOIN tf ON tf.iy = f.iy AND tf.ix = f.ix AND tf.time = f.time " + " ".join(
    f"JOIN l{km}_{v} ON l{km}_{v}.iy = f.iy AND l{km}_{v}.ix = f.ix AND l{km}_{v}.time = f.time" for v, km in LAGGED
)


@query("feature_matrix", sql_over("cube bathy geom", FEATURES))
def feature_matrix(spark, sf):
    g = t.grid_of(spark, sf)
    static = gradients.slope_degrees(t.bathy(spark, sf), g).select("iy", "ix", "depth", "slope")
    static = static.join(coast.distance_to_coast(t.bathy(spark, sf), g).select("iy", "ix", "dist_coast"), ["iy", "ix"])
    return features.feature_matrix(t.pixels(spark, sf), static, g, features.FeatureSettings(lag_radii_km=t.RADII_KM))


@query("feature_matrix_from_rasters", sql_over("cube bathy geom", FEATURES))
def feature_matrix_from_rasters(spark, sf):
    """The same table from a raster of half the step, off the grid: four unequal pixels around each cell, whose
    bilinear value is the cell's; depth, slope and distance come from a bathymetry raster."""
    g = t.grid_of(spark, sf)
    off = t.RES / 4
    source = Grid(g.lat_min - off, g.lon_min - off, t.RES / 2, 2 * g.ny, 2 * g.nx)
    corners = [F.struct(F.lit(y * off).alias("dy"), F.lit(x * off).alias("dx"), F.lit(1.0 - x * y).alias("k")) for y in (-1, 1) for x in (-1, 1)]
    spread = t.pixels(spark, sf).withColumn("c", F.explode(F.array(*corners)))
    raster = spread.select("variable", "time", (F.col("lat") + F.col("c.dy")).alias("lat"), (F.col("lon") + F.col("c.dx")).alias("lon"), (F.col("value") * F.col("c.k")).alias("value"))
    path = scratch_path(spark, "regridded")
    features.regridded(raster, g, source).write.parquet(path)
    static = features.static_fields(t.bathy(spark, sf).select("lat", "lon", "depth"), g, g)
    return features.feature_matrix(spark.read.parquet(path), static, g, features.FeatureSettings(lag_radii_km=t.RADII_KM))


@query("habitat_suitability", sql_over("obs", f"SELECT iy, ix, {DAY}, round({habitat_sql('sardinella')}, 6) + 0.0::DOUBLE AS suitability FROM obs"))
def habitat_suitability(spark, sf):
    return t.obs(spark, sf).select("iy", "ix", "time", scores.habitat_suitability("sardinella").alias("suitability"))


@query("suitability_all_species", sql_over("obs", f"SELECT iy, ix, {DAY}, " + ", ".join(f"round({habitat_sql(s.code)}, 6) + 0.0::DOUBLE AS suitability_{s.code}" for s in config.SPECIES) + " FROM obs"))
def suitability_all_species(spark, sf):
    return t.obs(spark, sf).select("iy", "ix", "time", *[c.alias(n) for n, c in scores.suitability_columns().items()])


@query("productivity_index", sql_over("obs", f"SELECT iy, ix, {DAY}, round(CASE WHEN chl > 0 THEN log10(greatest(chl, 1e-4) + 1e-4) END, 6) + 0.0::DOUBLE AS productivity_index FROM obs"))
def productivity_index(spark, sf):
    return t.obs(spark, sf).select("iy", "ix", "time", scores.productivity_index(F.col("chl")).alias("productivity_index"))


@query("upwelling_proxy", sql_over("obs", f"""SELECT iy, ix, {DAY}, round(CASE WHEN a > 0 THEN 0 WHEN a IS NOT NULL THEN -a END, 6) + 0.0::DOUBLE AS upwelling_proxy
    FROM (SELECT *, chl - avg(chl) OVER (PARTITION BY iy, ix, month(time)) AS a FROM obs)"""))
def upwelling_proxy(spark, sf):
    df = temporal.with_anomalies(t.obs(spark, sf), ["chl"])
    return df.select("iy", "ix", "time", scores.upwelling_proxy(F.col("chl_anom")).alias("upwelling_proxy"))


@query("annual_mean", sql_over("obs", """SELECT a.iy, a.ix, round(a.m, 6) + 0.0::DOUBLE AS chl_all, round(b.m, 6) + 0.0::DOUBLE AS chl_1998 FROM (SELECT iy, ix, avg(chl) AS m FROM obs GROUP BY 1, 2) a
    LEFT JOIN (SELECT iy, ix, avg(chl) AS m FROM obs WHERE year(time) = 1998 GROUP BY 1, 2) b ON a.iy = b.iy AND a.ix = b.ix"""))
def annual_mean(spark, sf):
    o = t.obs(spark, sf)
    whole = temporal.temporal_mean(o, ["chl"]).withColumnRenamed("chl", "chl_all")
    return whole.join(temporal.temporal_mean(o, ["chl"], 1998).withColumnRenamed("chl", "chl_1998"), ["iy", "ix"], "left")


@query("cells_recovered", sql_over("filled", f"""SELECT variable, {DAY}, count(*) FILTER (WHERE NOT filled) AS valid_before, count(*) AS valid_after, count(*) FILTER (WHERE filled) AS recovered
    FROM filled GROUP BY variable, filled.time"""))
def cells_recovered(spark, sf):
    return analytics.cells_recovered(temporal.gap_fill(t.pixels(spark, sf), grid=t.grid_of(spark, sf)), ["variable", "time"])
