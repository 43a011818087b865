"""Sources, sinks, catalogue, plain filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom.functions import geo, names
from gridloom.operators import catches as catch_ops
from gridloom.operators import ranking, temporal
from gridloom.operators.datasets import resolve_features as resolve
from gridloom.operators.grid import land_points, mask_land, with_land_mask
from gridloom.plans.forecasts import export_table, forecast
from gridloom.session import scratch_path
from gridloom.sources import catalog, catch_files, observations
from gridloom.streaming import ingest
from registry import tables as t
from registry.base import query
from registry.tables import habitat_sql, sql_over

BOX = (117.0, 5.0, 121.0, 12.0)


@query("scan_obs", sql_over("pixels", """SELECT CAST(time AS VARCHAR) AS time, lat, lon, round(value, 6) AS value FROM pixels
    WHERE variable = 'chl' AND year(time) IN (1997, 1998) AND lat BETWEEN 4.2 AND 12.8 AND lon BETWEEN 116.2 AND 121.8"""))
def scan_obs(spark, sf):
    path = scratch_path(spark, "observations")
    observations.write_observations(t.pixels(spark, sf).select("variable", "time", "lat", "lon", "value"), path)
    return observations.read_observations(spark, path, "chl", [1997, 1998], BOX)


@query("granule_year", sql_over("granules", """SELECT DISTINCT granule_name,
    CAST(coalesce(nullif(regexp_extract(granule_name, '\\.(\\d{4})\\d{2}', 1), ''), nullif(regexp_extract(granule_name, '(\\d{4})', 1), '')) AS INTEGER) AS year FROM granules"""))
def granule_year(spark, sf):
    return t.granules(spark, sf).select("granule_name").distinct().withColumn("year", names.granule_year(F.col("granule_name")))


@query("granule_time", sql_over("granules", """SELECT granule_name, strftime(a + (b - a) / 2, '%Y-%m-%d %H:%M:%S') AS time, CAST(CAST(a AS DATE) AS VARCHAR) AS day FROM (
    SELECT DISTINCT granule_name, strptime(regexp_extract(granule_name, '_MODIS\\.(\\d{8})_(\\d{8})\\.', 1), '%Y%m%d') AS a,
      strptime(regexp_extract(granule_name, '_MODIS\\.(\\d{8})_(\\d{8})\\.', 2), '%Y%m%d') AS b FROM granules)"""))
def granule_time(spark, sf):
    named = t.granules(spark, sf).select("granule_name").distinct()
    return observations.with_granule_time(named, F.col("granule_name")).select(
        "granule_name", F.col("time").cast("timestamp_ntz").alias("time"), names.granule_date(F.col("granule_name")).alias("day")
    )


@query("load_catch", sql_over("landings", """SELECT CAST(fma AS INTEGER) AS fma, species, year, CAST(least(greatest(quarter * 2 - 2, 1), 4) AS INTEGER) AS quarter,
    round(CAST(sum(cents) AS BIGINT) / 100, 6) AS volume_mt, 4.5::DOUBLE + (nk * 3 % 20) * 0.5::DOUBLE AS lat, 116::DOUBLE + (nk * 4 % 16) * 0.5::DOUBLE AS lon
    FROM landings GROUP BY fma, species, year, quarter, nk"""))
def load_catch(spark, sf):
    # Quarters are spread to 0..6 so that the clip has something to do.
    table = t.landings(spark, sf).groupBy("fma", "species", "year", "quarter", "nk").agg((F.sum("cents") / 100).alias("volume_mt"))
    table = table.select(
        "fma", "species", "year", (F.col("quarter") * 2 - 2).alias("quarter"), "volume_mt",
        (4.5 + (F.col("nk") * 3 % 20) * 0.5).alias("lat"), (116.0 + (F.col("nk") * 4 % 16) * 0.5).alias("lon"),
    )
    path = scratch_path(spark, "catches")
    catch_files.write_catches(table, path)
    return catch_files.load_catches(spark, path)


@query("write_matrix", sql_over("matrix", """SELECT iy, ix, round(lat, 6) AS lat, round(lon, 6) AS lon, CAST(time AS VARCHAR) AS time, CAST(time AS VARCHAR) AS date,
    round(sst, 6) AS sst, round(chl, 6) AS chl, depth, CAST(year(time) AS INTEGER) AS year FROM matrix"""))
def write_matrix(spark, sf):
    from gridloom.operators.cube import to_matrix

    path = scratch_path(spark, "matrix")
    observations.write_matrix(to_matrix(t.matrix(spark, sf).select("iy", "ix", "time", "lat", "lon", "sst", "chl", "depth")), path)
    return observations.read_matrix(spark, path)


@query("cube_roundtrip", sql_over("obs", """SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(sst, 6) AS sst, round(chl, 6) AS chl, '0.5' AS res FROM obs"""))
def cube_roundtrip(spark, sf):
    path = scratch_path(spark, "cube")
    observations.save_cube(t.obs(spark, sf).select("iy", "ix", "time", "sst", "chl"), path, {"res": t.RES})
    cube, attributes = observations.load_cube(spark, path)
    return cube.select("iy", "ix", "time", "sst", "chl", F.lit(attributes["res"]).alias("res"))


EXPORTED = f"""SELECT lat, lon, round({habitat_sql('scad')}, 6) AS "yield", CAST(time AS VARCHAR) AS time, 'scad' AS species
    FROM matrix WHERE time = (SELECT max(time) FROM matrix) AND sst IS NOT NULL"""


@query("export_predictions", sql_over("matrix", EXPORTED))
def export_predictions(spark, sf):
    path = scratch_path(spark, "forecast")
    observations.write_forecast(export_table(t.matrix(spark, sf), "scad"), path)
    schema = "lat double, lon double, yield double, species string, time string"
    return spark.read.schema(schema).option("header", True).csv(path).select("lat", "lon", "yield", "time", "species")


@query("forecast_habitat", sql_over("matrix", f"""SELECT iy, ix, lat, lon, round({habitat_sql('anchovy')}, 6) AS value
    FROM matrix WHERE sst IS NOT NULL AND time = (SELECT time FROM (SELECT DISTINCT time FROM matrix) ORDER BY abs(date_diff('day', DATE '1999-06-01', time)), time LIMIT 1)"""))
def forecast_habitat(spark, sf):
    return forecast(t.matrix(spark, sf), "anchovy", "1999-06-01")


@query("manifest_upsert", sql_over("granules", """SELECT short_name, granule_name, seq, size_bytes, cloud_cover FROM granules
    QUALIFY row_number() OVER (PARTITION BY short_name, granule_name ORDER BY seq DESC) = 1"""))
def manifest_upsert(spark, sf):
    return catalog.upsert(t.granules(spark, sf)).select("short_name", "granule_name", "seq", "size_bytes", "cloud_cover")


@query("manifest_missing", sql_over("granules", """SELECT DISTINCT g.short_name, g.granule_name FROM granules g WHERE g.short_name = 'MODISA_L3m_VIEW'
    AND NOT EXISTS (SELECT 1 FROM granules m WHERE m.cloud_cover < 20 AND m.short_name = g.short_name AND m.granule_name = g.granule_name)"""))
def manifest_missing(spark, sf):
    g = t.granules(spark, sf)
    fetched = g.where("cloud_cover < 20")
    return catalog.not_in_manifest(g, fetched, "MODISA_L3m_VIEW").select("short_name", "granule_name").distinct()


@query("catalog_search", sql_over("granules", """SELECT seq, granule_name, cloud_cover FROM granules WHERE short_name = 'MODISA_L3m_CLICK'
    AND start_time <= TIMESTAMP '2024-01-20' AND end_time >= TIMESTAMP '2024-01-10' AND regexp_full_match(granule_name, '.*\\.8D\\.CLICK.*') AND cloud_cover BETWEEN 5 AND 50"""))
def catalog_search(spark, sf):
    found = catalog.search(t.granules(spark, sf), "MODISA_L3m_CLICK", ("2024-01-10", "2024-01-20"), "*.8D.CLICK*", None, (5, 50))
    return found.select("seq", "granule_name", "cloud_cover")


@query("manifest_report", sql_over("granules", """SELECT short_name, count(*) AS granules, round(CAST(sum(size_bytes) AS BIGINT) / (1024.0 * 1024.0)::DOUBLE, 6) AS megabytes FROM granules GROUP BY 1"""))
def manifest_report(spark, sf):
    return catalog.volume_report(t.granules(spark, sf))


@query("granules_per_year", sql_over("granules", """SELECT p.short_name, CAST(y.year AS INTEGER) AS year, count(g.granule_name) AS granules
    FROM (SELECT DISTINCT short_name FROM granules) p CROSS JOIN (SELECT unnest(range(2015, 2026)) AS year) y
    LEFT JOIN granules g ON g.short_name = p.short_name AND CAST(substr(g.granule_name, 12, 4) AS INTEGER) = y.year GROUP BY 1, 2"""))
def granules_per_year(spark, sf):
    return catalog.granules_per_year(t.granules(spark, sf))


@query("even_sample", sql_over("granules", """SELECT short_name, granule_name FROM (
    SELECT *, row_number() OVER (PARTITION BY short_name ORDER BY granule_name) - 1 AS pos, count(*) OVER (PARTITION BY short_name) AS n
    FROM (SELECT DISTINCT short_name, granule_name FROM granules)) WHERE list_contains(list_transform(range(7), lambda i: (i * (n - 1)) // 6), pos)"""))
def even_sample(spark, sf):
    files = t.granules(spark, sf).select("short_name", "granule_name").distinct()
    return ranking.evenly_spaced(files, "granule_name", 7, ["short_name"])


@query("seeded_sample", sql_over("obs", """SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(sst, 6) AS sst FROM obs
    ORDER BY md5(concat_ws('|', iy, ix, CAST(time AS VARCHAR), '42')), iy, ix, time LIMIT 1000"""))
def seeded_sample(spark, sf):
    return ranking.seeded_sample(t.obs(spark, sf).select("iy", "ix", "time", "sst"), ["iy", "ix", "time"], 1000)


@query("missing_reports", sql_over("landings", """SELECT f.fma, s.species, CAST(y.year AS INTEGER) AS year, q.quarter FROM (SELECT DISTINCT year FROM landings) y
    CROSS JOIN (SELECT CAST(unnest(range(1, 7)) AS INTEGER) AS fma) f CROSS JOIN (SELECT unnest(['sardinella', 'anchovy', 'mackerel', 'scad', 'slipmouth']) AS species) s
    CROSS JOIN (SELECT CAST(unnest(range(1, 5)) AS INTEGER) AS quarter) q
    WHERE NOT EXISTS (SELECT 1 FROM landings l WHERE l.fma = f.fma AND l.species = s.species AND l.year = y.year AND l.quarter = q.quarter)"""))
def missing_reports(spark, sf):
    return catch_ops.missing_reports(t.landings(spark, sf))


@query("bbox_subset", sql_over("obs", "SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(sst, 6) AS sst FROM obs WHERE lat BETWEEN 4.2 AND 12.8 AND lon BETWEEN 116.2 AND 121.8"))
def bbox_subset(spark, sf):
    return t.obs(spark, sf).where(geo.in_box(F.col("lat"), F.col("lon"), BOX, 0.8)).select("iy", "ix", "time", "sst")


@query("land_mask", sql_over("bathy", "SELECT iy, ix, depth, coalesce(depth < 0, false) AS is_ocean, NOT coalesce(depth < 0, false) AS is_land FROM bathy"))
def land_mask(spark, sf):
    return with_land_mask(t.bathy(spark, sf)).select("iy", "ix", "depth", "is_ocean", "is_land")


@query("mask_land", sql_over("matrix", """SELECT iy, ix, CAST(time AS VARCHAR) AS time, depth, round(CASE WHEN depth < 0 THEN sst END, 6) AS sst, round(CASE WHEN depth < 0 THEN chl END, 6) AS chl FROM matrix"""))
def masked(spark, sf):
    return mask_land(t.matrix(spark, sf).select("iy", "ix", "time", "depth", "sst", "chl"))


@query("land_points", sql_over("bathy", "SELECT lon, lat FROM bathy WHERE NOT depth < 0"))
def land(spark, sf):
    return land_points(t.bathy(spark, sf))


@query("chrono_split", sql_over("obs", """SELECT iy, ix, CAST(time AS VARCHAR) AS time, year(time) <= 1999 AS train, year(time) = 2000 AS val, year(time) >= 2001 AS test FROM obs"""))
def chrono_split(spark, sf):
    return t.obs(spark, sf).withColumns(t.splits()).select("iy", "ix", "time", "train", "val", "test")


@query("nearest_time", sql_over("obs", """SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(chl, 6) AS chl FROM obs WHERE time =
    (SELECT time FROM (SELECT DISTINCT time FROM obs) ORDER BY abs(date_diff('day', DATE '1998-07-01', time)), time LIMIT 1)"""))
def nearest_time(spark, sf):
    return temporal.at_nearest_time(t.obs(spark, sf), "1998-07-01").select("iy", "ix", "time", "chl")


@query("snapshot", sql_over("obs", """SELECT iy, ix, lat, lon, round(sst, 6) AS sst, round(kd490, 6) AS kd490, CAST(NULL AS DOUBLE) AS slope FROM obs
    WHERE time = (SELECT max(time) FROM obs)"""))
def snapshot(spark, sf):
    return temporal.snapshot(t.obs(spark, sf), None, ["sst", "kd490", "slope"])


@query("time_options", sql_over("obs", "SELECT DISTINCT CAST(time AS VARCHAR) AS time FROM obs"))
def time_options(spark, sf):
    return temporal.time_options(t.obs(spark, sf))


@query("stream_ingest_dedupe", sql_over("granules", "SELECT DISTINCT short_name, granule_name FROM granules"))
def stream_ingest_dedupe(spark, sf):
    schema = t.read(spark, sf, "events").schema
    stream = ingest.granule_stream(spark, sf, schema, pattern="events.parquet")
    fresh = ingest.first_per_key(t.granule_columns(stream)).select("short_name", "granule_name")
    out = scratch_path(spark, "ingest")
    ingest.run_available(fresh, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema("short_name string, granule_name string").parquet(f"{out}/rows")


@query("composite_8day", """SELECT strftime(make_timestamp((epoch(ts)::BIGINT // 691200) * 691200000000), '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS cell,
    round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY 1, 2""")
def composite_8day(spark, sf):
    points = t.read(spark, sf, "events").select("ts", F.col("user_id").alias("cell"), "value")
    return ingest.composite(points, ["cell"])


_WINDOW = "date_trunc('year', ts) + to_days(CAST(8 * (date_diff('day', CAST(date_trunc('year', ts) AS DATE), CAST(ts AS DATE)) // 8) AS INTEGER))"


@query("composite_calendar", f"""SELECT strftime({_WINDOW}, '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS cell, round(avg(value), 6) AS value, count(value) AS n FROM events GROUP BY 1, 2""")
def composite_calendar(spark, sf):
    points = t.read(spark, sf, "events").select("ts", F.col("user_id").alias("cell"), "value")
    return ingest.calendar_composite(points, ["cell"])


@query("stream_composite", f"""WITH w AS (SELECT {_WINDOW} AS window_start, user_id, value FROM events)
    SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, user_id AS cell, round(avg(value), 6) AS value, count(value) AS n FROM w
    WHERE window_start <= (SELECT max(window_start) FROM w) - INTERVAL 8 DAYS GROUP BY 1, 2""")
def stream_composite(spark, sf):
    """Events, laid out as several files in time order, run as a stream to its end: the windows that have closed."""
    events = t.read(spark, sf, "events").select("ts", F.col("user_id").alias("cell"), "value")
    out = scratch_path(spark, "composites")
    events.repartitionByRange(4, "ts").write.parquet(f"{out}/source")
    stream = ingest.granule_stream(spark, f"{out}/source", events.schema, files_per_trigger=2)
    closed = ingest.calendar_composite(stream, ["cell"])
    ingest.run_available(closed, f"{out}/rows", f"{out}/checkpoint")
    return spark.read.schema(closed.schema).parquet(f"{out}/rows")


@query("scan_renamed", sql_over("obs", "SELECT lat, lon, CAST(time AS VARCHAR) AS time, round(sst, 6) AS sst, round(chl, 6) AS chl, round(par, 6) AS par, round(kd490, 6) AS kd490 FROM obs"))
def scan_renamed(spark, sf):
    path = scratch_path(spark, "renamed")
    raw = {"lat": "latitude", "lon": "longitude", "chl": "chlor_a", "kd490": "Kd_490"}
    t.obs(spark, sf).select("lat", "lon", "time", "sst", "chl", "par", "kd490").withColumnsRenamed(raw).write.parquet(path)
    return observations.standardize(spark.read.parquet(path)).select("lat", "lon", "time", "sst", "chl", "par", "kd490")


@query("area_lookup", sql_over("areas", "SELECT geo, CAST(fma AS INTEGER) AS fma FROM areas"))
def area_lookup(spark, sf):
    path = scratch_path(spark, "areas")
    province = F.struct(F.col("geo").alias("name"), F.lit(None).cast("string").alias("note"))
    areas = t.areas(spark, sf).groupBy("fma").agg(F.struct(F.concat(F.lit("area "), "fma").alias("name"), F.collect_list(province).alias("provinces")).alias("area"))
    # One nested value, as the look-up file holds it: as many entries as there are areas.
    areas.agg(F.map_from_entries(F.collect_list(F.struct(F.col("fma").cast("int"), "area"))).alias("areas")).write.json(path)
    return catch_files.load_area_map(spark, path)


@query("centroid_scan", sql_over("centroids", "SELECT geo, round(lat, 6) AS lat, round(lon, 6) AS lon FROM centroids"))
def centroid_scan(spark, sf):
    path = scratch_path(spark, "centroids")
    blank = lambda c: F.lit("").alias(c)
    t.centroids(spark, sf).select(F.col("geo").alias("psa_name"), blank("adm_name"), blank("region"), "lat", "lon", blank("source")).write.option("header", True).csv(path)
    return catch_files.load_centroids(spark, path).select("geo", "lat", "lon")


@query("manifest_append", sql_over("granules", """SELECT short_name, granule_name, size_bytes, cloud_cover FROM granules
    QUALIFY row_number() OVER (PARTITION BY short_name, granule_name ORDER BY seq % 3 = 0, CASE WHEN seq % 3 = 0 THEN seq ELSE -seq END DESC) = 1"""))
def manifest_append(spark, sf):
    """Two thirds of the entries are appended to a manifest of the others, in falling order of ``seq``."""
    columns = ["short_name", "granule_name", "size_bytes", "cloud_cover"]
    g = t.granules(spark, sf)
    manifest = catalog.upsert(g.where("seq % 3 = 0")).select(*columns)
    new = g.where("seq % 3 <> 0").select(*columns, (-F.col("seq")).alias("arrival"))
    return catalog.append_manifest(manifest, new, "arrival").select(*columns)


@query("bathy_scan", sql_over("bathy", "SELECT lat, lon, depth::FLOAT::DOUBLE AS depth FROM bathy WHERE lat BETWEEN 5 AND 12 AND lon BETWEEN 117 AND 121"))
def bathy_scan(spark, sf):
    path = scratch_path(spark, "bathymetry")
    t.bathy(spark, sf).select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"), "depth").write.parquet(path)
    return observations.read_bathymetry(spark, path, BOX)


@query("resolve_features", sql_over("matrix", "SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(sst, 6) AS sst, round(kd490, 6) AS kd490, depth FROM matrix"))
def resolve_features(spark, sf):
    matrix = t.matrix(spark, sf)
    names = resolve(matrix.columns, ["sst", "sst_anomaly", "kd490", "depth"])
    return matrix.select("iy", "ix", "time", *names)


@query("stream_manifest", sql_over("granules", """SELECT seq, short_name, granule_name, size_bytes, cloud_cover FROM granules
    QUALIFY row_number() OVER (PARTITION BY short_name, granule_name ORDER BY seq DESC) = 1"""))
def stream_manifest(spark, sf):
    """Granule entries arrive in several files, a batch each, and are merged into a manifest."""
    out = scratch_path(spark, "stream-manifest")
    columns = ["seq", "short_name", "granule_name", "size_bytes", "cloud_cover"]
    arriving = t.granules(spark, sf).select(*columns)
    arriving.repartitionByRange(4, "seq").write.parquet(f"{out}/in")
    stream = ingest.granule_stream(spark, f"{out}/in", arriving.schema, files_per_trigger=2)
    ingest.manifest_sink(stream, f"{out}/manifest", f"{out}/checkpoint", "granules")
    return ingest.read_manifest(spark, f"{out}/manifest", arriving.schema)


@query("scan_file_rows", sql_over("pixels", """SELECT variable, CAST(year(time) AS INTEGER) AS year, count(*) AS promised, count(*) AS read, 0::BIGINT AS damaged
    FROM pixels GROUP BY ALL"""))
def scan_file_rows(spark, sf):
    """Rows that footers promise and rows read from whole files, per folder of the observation table."""
    path = scratch_path(spark, "observations")
    observations.write_observations(t.pixels(spark, sf).select("variable", "time", "lat", "lon", "value"), path)
    folder = lambda name: F.regexp_extract("file", f"/{name}=([^/]+)/", 1)
    return observations.file_rows(spark, path).groupBy(folder("variable").alias("variable"), folder("year").cast("int").alias("year")).agg(
        F.sum("promised").alias("promised"), F.sum("read").alias("read"),
        F.count_if(F.col("promised").isNull() | (F.col("read") < F.col("promised"))).alias("damaged"),
    )
