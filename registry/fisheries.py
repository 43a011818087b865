"""Catch statistics, sheets and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridloom import config
from gridloom.operators import catches, datasets, labels, sheets
from registry import tables as t
from registry.base import query
from registry.tables import habitat_sql, sql_over

PREFIX = "NATION_1"
BY_FILE = ["file", *catches.PERIOD]


@query("matrix_files", sql_over("sheet", f"SELECT file FROM sheet WHERE row_no = 1 AND col_no = 1 AND contains(cell, '{config.SHEET_TITLE}')"))
def matrix_files(spark, sf):
    return sheets.matrix_files(t.sheet_cells(spark, sf))


HEADERS = """SELECT q.file, q.col_no, CAST(max_by(y.cell, y.col_no) AS INTEGER) AS year, CAST(substr(q.cell, 9) AS INTEGER) AS quarter
    FROM sheet q JOIN sheet y ON y.file = q.file AND y.row_no = 3 AND y.col_no <= q.col_no AND y.cell BETWEEN '2000' AND '2100' WHERE q.row_no = 4 AND q.cell LIKE 'Quarter%' GROUP BY q.file, q.col_no, q.cell"""
FILLED_ROWS = """SELECT file, row_no, geo, label FROM (SELECT file, row_no, label, last_value(own IGNORE NULLS) OVER (PARTITION BY file ORDER BY row_no) AS geo FROM (
    SELECT file, row_no, max(CASE WHEN col_no = 1 THEN cell END) AS own, max(CASE WHEN col_no = 2 THEN cell END) AS label FROM sheet WHERE row_no > 4 AND col_no <= 2 GROUP BY 1, 2)) WHERE label IS NOT NULL"""
ALIAS = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in config.SHEET_SPECIES.items()) + ") AS a(label, species)"


@query("matrix_headers", sql_over("sheet", HEADERS))
def matrix_headers(spark, sf):
    return sheets.matrix_headers(t.sheet_cells(spark, sf))


@query("matrix_ffill", sql_over("sheet", FILLED_ROWS))
def matrix_ffill(spark, sf):
    return sheets.matrix_rows(t.sheet_cells(spark, sf))


@query("matrix_unpivot", sql_over("sheet", f"""SELECT s.file, r.geo AS geo_raw, a.species, h.year, h.quarter, round(try_cast(s.cell AS DOUBLE), 6) AS volume_mt
    FROM sheet s JOIN ({HEADERS}) h ON h.file = s.file AND h.col_no = s.col_no JOIN ({FILLED_ROWS}) r ON r.file = s.file AND r.row_no = s.row_no JOIN {ALIAS} ON a.label = r.label
    WHERE s.row_no > 4 AND try_cast(s.cell AS DOUBLE) IS NOT NULL AND r.geo LIKE '....%'"""))
def matrix_unpivot(spark, sf):
    return sheets.matrix_values(t.sheet_cells(spark, sf))


UNIFIED = f"""SELECT geo_raw, file, species, year, quarter, volume_mt FROM reports WHERE NOT starts_with(ltrim(geo_raw, '.'), '{PREFIX}')
    UNION ALL SELECT min(geo_raw), file, species, year, quarter, max(volume_mt) FROM reports WHERE starts_with(ltrim(geo_raw, '.'), '{PREFIX}') GROUP BY file, species, year, quarter"""
ROLLED = f"SELECT ltrim(geo_raw, '.') AS geo, file, species, year, quarter, sum(volume_mt) AS volume_mt FROM ({UNIFIED}) GROUP BY 1, 2, 3, 4, 5"
TOTALS = f"""SELECT geo, species, year, quarter, sum(v) AS volume_mt FROM (SELECT CASE WHEN contains(upper(file), '2E4GVCP0') THEN 'commercial' WHEN contains(upper(file), '2E4GVMP0') THEN 'municipal' ELSE 'extra' END AS sector,
    geo, species, year, quarter, max(volume_mt) AS v FROM ({ROLLED}) GROUP BY 1, 2, 3, 4, 5) GROUP BY 1, 2, 3, 4"""
LOCATED = f"SELECT x.*, a.fma, c.lat, c.lon FROM ({TOTALS}) x JOIN areas a ON a.geo = x.geo JOIN centroids c ON c.geo = x.geo"
CELLS = f"""SELECT max_by(fma, struct_pack(v := volume_mt, f := -fma)) AS fma, species, year, quarter, sum(volume_mt) AS volume_mt, lat, lon
    FROM (SELECT * REPLACE (round_even(lat * 10, 0)::DOUBLE / 10 AS lat, round_even(lon * 10, 0)::DOUBLE / 10 AS lon) FROM ({LOCATED})) GROUP BY species, year, quarter, lat, lon"""
PLACES = "reports areas centroids"


def _unified(spark, sf):
    return catches.unify_variants(t.reports(spark, sf), PREFIX, BY_FILE)


def _rolled(spark, sf):
    return catches.roll_up_species(_unified(spark, sf), by=BY_FILE)


def _cells(spark, sf):
    located = catches.locate(catches.sector_totals(_rolled(spark, sf)), t.areas(spark, sf), t.centroids(spark, sf))
    return catches.to_cells(located)


@query("variant_max", sql_over("reports", UNIFIED))
def variant_max(spark, sf):
    return _unified(spark, sf)


@query("species_rollup", sql_over("reports", f"SELECT * REPLACE (round(volume_mt, 6) AS volume_mt) FROM ({ROLLED})"))
def species_rollup(spark, sf):
    return _rolled(spark, sf)


@query("sector_totals", sql_over("reports", f"SELECT * REPLACE (round(volume_mt, 6) AS volume_mt) FROM ({TOTALS})"))
def sector_totals(spark, sf):
    return catches.sector_totals(_rolled(spark, sf))


@query("geo_lookup", sql_over(PLACES, f"SELECT * REPLACE (round(volume_mt, 6) AS volume_mt, round(lat, 6) AS lat, round(lon, 6) AS lon) FROM ({LOCATED})"))
def geo_lookup(spark, sf):
    return catches.locate(catches.sector_totals(_rolled(spark, sf)), t.areas(spark, sf), t.centroids(spark, sf))


@query("geo_unmapped", sql_over(PLACES, f"SELECT geo, count(*) AS rows FROM ({TOTALS}) WHERE geo NOT IN (SELECT a.geo FROM areas a JOIN centroids c ON a.geo = c.geo) GROUP BY 1"))
def geo_unmapped(spark, sf):
    return catches.unmapped(catches.sector_totals(_rolled(spark, sf)), t.areas(spark, sf), t.centroids(spark, sf))


@query("catch_cells", sql_over(PLACES, f"SELECT * REPLACE (round(volume_mt, 6) AS volume_mt) FROM ({CELLS})"))
def catch_cells(spark, sf):
    return _cells(spark, sf)


@query("catch_summary", sql_over(PLACES, f"SELECT species, count(volume_mt) AS rows, round(sum(volume_mt), 2) AS volume_mt, min(year) AS first_year, max(year) AS last_year FROM ({CELLS}) GROUP BY 1"))
def catch_summary(spark, sf):
    return catches.catch_summary(_cells(spark, sf)).withColumn("volume_mt", F.round("volume_mt", 2))


@query("catch_ingest", sql_over("sheet areas centroids", f"""WITH reports AS (SELECT s.file, r.geo AS geo_raw, a.species, h.year, h.quarter, try_cast(s.cell AS DOUBLE) AS volume_mt
    FROM sheet s JOIN ({HEADERS}) h ON h.file = s.file AND h.col_no = s.col_no JOIN ({FILLED_ROWS}) r ON r.file = s.file AND r.row_no = s.row_no JOIN {ALIAS} ON a.label = r.label
    WHERE s.row_no > 4 AND try_cast(s.cell AS DOUBLE) IS NOT NULL) SELECT * REPLACE (round(volume_mt, 6) AS volume_mt) FROM ({CELLS})"""))
def catch_ingest(spark, sf):
    """Sheets to cell table, all steps."""
    cells = t.sheet_cells(spark, sf)
    kept = cells.join(sheets.matrix_files(cells), "file", "left_semi")
    rolled = catches.roll_up_species(catches.unify_variants(sheets.matrix_values(kept), PREFIX, BY_FILE), by=BY_FILE)
    return catches.to_cells(catches.locate(catches.sector_totals(rolled), t.areas(spark, sf), t.centroids(spark, sf)))


@query("msy_proxy", sql_over("catches", "SELECT round(coalesce(max(volume_mt), 0), 6) AS msy FROM catches WHERE species = 'scad'"))
def msy_proxy(spark, sf):
    return catches.msy_proxy(t.catches(spark, sf), "scad")


JOINED = """SELECT o.*, c.volume_mt AS label FROM {table} o LEFT JOIN (SELECT * FROM catches WHERE species = '{code}') c
    ON c.iy = o.iy AND c.ix = o.ix AND c.year = year(o.time) AND c.quarter = quarter(o.time)"""


@query("catch_label", sql_over("obs catches", f"SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(label, 6) AS label FROM ({JOINED.format(table='obs', code='scad')})"))
def catch_label(spark, sf):
    own = t.catches(spark, sf).where("species = 'scad'")
    return labels.with_catch_label(t.obs(spark, sf), own).select("iy", "ix", "time", "label")


@query("m2o_violations", sql_over("reports", "SELECT geo, species, year, quarter, count(*) AS n FROM reports GROUP BY 1, 2, 3, 4 HAVING count(*) > 1"))
def m2o_violations(spark, sf):
    return labels.duplicate_keys(t.reports(spark, sf), ["geo", "species", "year", "quarter"])


POLICY = " UNION ALL ".join(
    f"SELECT '{p}' AS policy, '{code}' AS species, '{kind}' AS label_kind, count(label) AS labelled, round(max(label), 6) AS top FROM ({source})"
    for p, code, kind, source in (
        ("prefer_catch", "scad", "catch", JOINED.format(table="obs", code="scad")),
        ("prefer_catch", "all", "habitat", f"SELECT {habitat_sql('all')} AS label FROM obs"),
        ("habitat_only", "scad", "habitat", f"SELECT {habitat_sql('scad')} AS label FROM obs"),
        ("both", "scad", "habitat", f"SELECT {habitat_sql('scad')} AS label FROM obs"),
    )
)


@query("label_policy", sql_over("obs catches", POLICY))
def label_policy(spark, sf):
    out = None
    for policy, code in (("prefer_catch", "scad"), ("prefer_catch", "all"), ("habitat_only", "scad"), ("both", "scad")):
        labelled, kind = labels.attach_labels(t.obs(spark, sf), code, policy, t.catches(spark, sf))
        part = labelled.agg(F.count("label").alias("labelled"), F.max("label").alias("top")).select(
            F.lit(policy).alias("policy"), F.lit(code).alias("species"), F.lit(kind).alias("label_kind"), "labelled", "top"
        )
        out = part if out is None else out.unionByName(part)
    return out


NUMERIC = ["sst", "chl", "kd490", "par", "depth", "productivity_index", "month_sin", "month_cos"]
MEDIANS = " UNION ALL ".join(f"SELECT '{f}' AS feature, coalesce(quantile_cont(CAST({f} AS FLOAT)::DOUBLE, 0.5)::FLOAT, 0) AS m FROM matrix" for f in NUMERIC)
LABELLED = JOINED.format(table="matrix", code="scad")


@query("imputer_medians", sql_over("matrix", f"SELECT feature, round(m::DOUBLE, 6) + 0.0::DOUBLE AS median FROM ({MEDIANS})"))
def imputer_medians(spark, sf):
    return datasets.imputer_medians(t.matrix(spark, sf), NUMERIC)


def _labelled(spark, sf):
    return labels.with_catch_label(t.matrix(spark, sf), t.catches(spark, sf).where("species = 'scad'"))


def _training(spark, sf):
    medians = datasets.imputer_medians(t.matrix(spark, sf), NUMERIC)
    return datasets.training_set(_labelled(spark, sf), NUMERIC, "log1p", medians, splits=t.splits())


IMPUTED = ", ".join(f"round(coalesce(CAST({f} AS FLOAT), (SELECT m FROM med WHERE feature = '{f}'))::DOUBLE, 6) + 0.0::DOUBLE AS {f}" for f in NUMERIC)
TRAINING = f"""WITH med AS ({MEDIANS}) SELECT iy, ix, CAST(time AS VARCHAR) AS time, {IMPUTED}, round(ln(1 + greatest(label, 0)), 6) AS y,
    year(time) <= 1999 AS train, year(time) = 2000 AS val, year(time) >= 2001 AS test FROM ({LABELLED}) WHERE label IS NOT NULL"""


@query("training_set", sql_over("matrix catches", TRAINING))
def training_set(spark, sf):
    return _training(spark, sf).select("iy", "ix", "time", *NUMERIC, "y", "train", "val", "test")


Y = f"SELECT iy, ix, time, ln(1 + greatest(label, 0)) AS y, year(time) <= 1999 AS train FROM ({LABELLED}) WHERE label IS NOT NULL"


@query("hotspot_labels", sql_over("matrix catches", f"""WITH y AS ({Y}), cut AS (SELECT quantile_cont(y, 0.7) AS threshold FROM y WHERE train)
    SELECT iy, ix, CAST(time AS VARCHAR) AS time, round(y, 6) AS y, round(threshold, 6) AS threshold, CAST(y > threshold AS INTEGER) AS y_bin FROM y, cut"""))
def hotspot_labels(spark, sf):
    return datasets.hotspot_labels(_training(spark, sf), 0.3).select("iy", "ix", "time", "y", "threshold", "y_bin")
