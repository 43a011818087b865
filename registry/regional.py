"""Regional reports, histograms and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import scores
from gridloom.operators import analytics, histograms, ranking, temporal
from gridloom.plans.forecasts import forecast, ranking_of_latest
from registry import tables as t
from registry.base import query
from registry.tables import habitat_sql, region_case, region_rows, sql_over

LATEST = "time = (SELECT max(time) FROM matrix)"


@query("region_ranking", sql_over("matrix", f"""SELECT region, count(v) AS cells, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max
    FROM (SELECT {region_case()} AS region, {habitat_sql('scad')} AS v FROM matrix WHERE {LATEST} AND sst IS NOT NULL) WHERE region IS NOT NULL GROUP BY 1"""))
def region_ranking(spark, sf):
    return ranking_of_latest(t.matrix(spark, sf), "scad")


@query("region_ranking_record", sql_over("obs", f"""SELECT region, count(v) AS cells, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max
    FROM (SELECT {region_case()} AS region, {habitat_sql('mackerel')} AS v FROM obs) WHERE region IS NOT NULL AND v IS NOT NULL GROUP BY 1"""))
def region_ranking_record(spark, sf):
    """The same report over every composite at once."""
    scored = t.obs(spark, sf).withColumn("value", scores.habitat_suitability("mackerel"))
    return analytics.region_ranking(scored)


def _scored(spark, sf, code="scad"):
    return t.obs(spark, sf).select("iy", "ix", "lat", "lon", "time", scores.habitat_suitability(code).alias("suitability"))


@query("condition_trend", sql_over("obs", f"""SELECT CAST(time AS VARCHAR) AS time, round(avg({habitat_sql('scad')}), 6) AS suitability FROM obs
    WHERE lat BETWEEN 3.0 AND 9.5 AND lon BETWEEN 117.5 AND 122.5 GROUP BY obs.time"""))
def condition_trend(spark, sf):
    return analytics.condition_trend(_scored(spark, sf), "suitability", config.REGIONS[2])


TRENDS = f"""SELECT r.region, o.time, avg({habitat_sql('scad')}) AS m FROM obs o JOIN {region_rows()} ON o.lat BETWEEN r.lat_min AND r.lat_max AND o.lon BETWEEN r.lon_min AND r.lon_max GROUP BY 1, 2"""
TABLE = f"""SELECT region, current, baseline, CASE WHEN baseline > 0 THEN current / baseline END AS ratio FROM (
    SELECT region, max_by(m, time) AS current, max(m) AS baseline FROM ({TRENDS}) GROUP BY 1) WHERE baseline IS NOT NULL"""
FLAG = "CASE WHEN ratio <= 0.6 THEN 'sustainable' WHEN ratio <= 0.8 THEN 'caution' WHEN ratio IS NOT NULL THEN 'overfishing risk' ELSE 'n/a' END"


@query("region_trends", sql_over("obs", f"SELECT region, CAST(time AS VARCHAR) AS time, round(m, 6) AS suitability FROM ({TRENDS})"))
def region_trends(spark, sf):
    return analytics.region_trends(_scored(spark, sf), "suitability")


@query("sustainability", sql_over("obs", f"SELECT region, round(current, 6) AS current, round(baseline, 6) AS baseline, round(ratio, 6) AS ratio, {FLAG} AS flag FROM ({TABLE})"))
def sustainability(spark, sf):
    return analytics.sustainability(_scored(spark, sf), "suitability")


@query("flag_counts", sql_over("obs", f"SELECT {FLAG} AS flag, count(*) AS regions FROM ({TABLE}) GROUP BY 1"))
def flag_counts(spark, sf):
    return analytics.flag_counts(analytics.sustainability(_scored(spark, sf), "suitability"))


@query("field_summary", sql_over("matrix", f"""SELECT round(avg(v), 6) AS mean, round(quantile_cont(v, 0.9), 6) AS p90, round(max(v), 6) AS max FROM (SELECT {habitat_sql('scad')} AS v FROM matrix WHERE {LATEST})"""))
def field_summary(spark, sf):
    return analytics.field_summary(forecast(t.matrix(spark, sf), "scad"))


@query("var_ranges", sql_over("pixels", """SELECT variable, round(CASE WHEN hi > lo THEN lo ELSE mn END, 6) AS lo, round(CASE WHEN hi > lo THEN hi ELSE mx END, 6) AS hi FROM (
    SELECT variable, quantile_cont(value, 0.02) AS lo, quantile_cont(value, 0.98) AS hi, min(value) AS mn, max(value) AS mx FROM pixels GROUP BY 1)"""))
def var_ranges(spark, sf):
    return analytics.value_ranges(t.obs(spark, sf), t.VARIABLES)


@query("display_scale", sql_over("obs", """WITH q AS (SELECT quantile_cont(chl, 0.02) AS lo, quantile_cont(chl, 0.98) AS hi FROM obs),
    s AS (SELECT CASE WHEN ln(1 + greatest(hi, 0)) <= ln(1 + greatest(lo, 0)) THEN 0 ELSE ln(1 + greatest(lo, 0)) END AS a,
      CASE WHEN ln(1 + greatest(hi, 0)) <= ln(1 + greatest(lo, 0)) THEN 1 ELSE ln(1 + greatest(hi, 0)) END AS b FROM q),
    n AS (SELECT iy, ix, time, least(greatest((ln(1 + greatest(chl, 0)) - a) / (b - a), 0), 1) AS norm FROM obs, s WHERE chl IS NOT NULL)
    SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(norm, 6) AS norm, round(2.5::DOUBLE + 5.5::DOUBLE * sqrt(norm), 6) AS radius FROM n"""))
def display_scale(spark, sf):
    return analytics.display_scale(t.obs(spark, sf), "chl").select("iy", "ix", "time", "norm", "radius")


@query("null_fraction", sql_over("dense", """SELECT variable, round(avg(f), 6) AS mean_share, round(stddev_pop(f), 6) AS std_share FROM (""" + " UNION ALL ".join(
    f"SELECT '{v}' AS variable, time, avg(CASE WHEN {v} IS NULL THEN 1.0::DOUBLE ELSE 0::DOUBLE END) AS f FROM dense GROUP BY time" for v in t.VARIABLES) + ") GROUP BY 1"))
def null_fraction(spark, sf):
    dense = temporal.densify(t.obs(spark, sf), t.grid_of(spark, sf), t.VARIABLES)
    return analytics.null_fraction_spread(dense, t.VARIABLES)


@query("rows_per_year", sql_over("dense", "SELECT CAST(year(time) AS INTEGER) AS year, count(*) AS rows FROM dense GROUP BY 1"))
def rows_per_year(spark, sf):
    return analytics.rows_per_year(temporal.densify(t.obs(spark, sf), t.grid_of(spark, sf), ["sst"]))


def _hist(source: str, bins: int, by: str = "") -> str:
    key, part = (f"{by}, ", f"PARTITION BY {by}") if by else ("", "")
    return f"""SELECT {key}bin, round(lo + bin * w, 6) AS lower, count(*) AS n, round(CASE WHEN w > 0 THEN count(*) / any_value(total) / w END, 6) AS density FROM (
      SELECT *, (hi - lo) / {bins} AS w, CAST(CASE WHEN hi > lo THEN least(floor((v - lo) / ((hi - lo) / {bins})), {bins - 1}) ELSE 0 END AS INTEGER) AS bin
      FROM (SELECT *, min(v) OVER ({part}) AS lo, max(v) OVER ({part}) AS hi, (count(*) OVER ({part}))::DOUBLE AS total FROM ({source}))) GROUP BY {key}bin, lo, w"""


@query("value_histogram", sql_over("obs", _hist("SELECT log10(chl) AS v FROM obs WHERE chl > 0", 50)))
def value_histogram(spark, sf):
    return histograms.density_histogram(t.obs(spark, sf), "chl", 50, log10=True)


LABELLED = " UNION ALL ".join(f"SELECT '{c}' AS species, {habitat_sql(c)} AS v FROM obs WHERE sst IS NOT NULL AND chl IS NOT NULL" for c in config.trainable_species())


@query("label_histogram", sql_over("obs", _hist(LABELLED, 40, "species")))
def label_histogram(spark, sf):
    present = t.obs(spark, sf).where("sst IS NOT NULL AND chl IS NOT NULL")
    columns = scores.suitability_columns(config.trainable_species())
    named = [F.struct(F.lit(n.removeprefix("suitability_")).alias("species"), c.alias("v")) for n, c in columns.items()]
    return histograms.density_histogram(present.select(F.inline(F.array(*named))), "v", 40, ["species"])


@query("top_areas", sql_over("matrix", f"""SELECT lat, lon, round(v, 6) AS value FROM (SELECT iy, ix, lat, lon, {habitat_sql('sardinella')} AS v FROM matrix WHERE {LATEST}) WHERE v IS NOT NULL ORDER BY v DESC, iy, ix LIMIT 5"""))
def top_areas(spark, sf):
    return ranking.top_cells(forecast(t.matrix(spark, sf), "sardinella"), "value", 5).select("lat", "lon", "value")
