"""Domain tables derived from the driver's tables, once for Spark and once as SQL text.

The derived grid grows with the data: one row of cells per five suppliers (folded after forty),
one column per part number modulo sixteen. Observations are line items collected per cell and
8-day step; steps without a line item are the cloud gaps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import config
from gridloom.functions import scores
from gridloom.operators.cube import to_pixels
from gridloom.operators.grid import Grid

RES = 0.5
RADII_KM = (60, 120, 180)
TRAIN_UNTIL, VALIDATION, HOLDOUT_FROM = 1999, (2000, 2000), 2001
VARIABLES = list(config.GRID_VARIABLES)
LABELS = list(config.SHEET_SPECIES)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def splits(time=None):
    return scores.split_masks(F.col("time") if time is None else time, TRAIN_UNTIL, VALIDATION, HOLDOUT_FROM)


def _cell_columns():
    band = "(l_suppkey div 5)"
    return [
        F.expr(f"CAST({band} % 40 AS INT)").alias("iy"),
        F.expr(f"CAST(l_partkey % 16 + 16 * ({band} div 40) AS INT)").alias("ix"),
    ]


def _lat_lon():
    return [(4.5 + F.col("iy") * RES).alias("lat"), (116.0 + F.col("ix") * RES).alias("lon")]


def bathy(spark, sf) -> DataFrame:
    """(iy, ix, lat, lon, depth): about a fifth of the cells is land."""
    cells = read(spark, sf, "lineitem").groupBy(*_cell_columns()).agg(F.sum(F.col("l_quantity").cast("long")).alias("q"))
    depth = ((F.col("q") + F.col("iy") * 7 + F.col("ix") * 13) % 23 - 18) * 25.0
    return cells.select("iy", "ix", *_lat_lon(), depth.alias("depth"))


def obs(spark, sf) -> DataFrame:
    """(iy, ix, lat, lon, step, time, sst, chl, par, kd490)."""
    step = F.floor(F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")) / 8).cast("int")
    whole = lambda c: F.sum(c.cast("long"))
    slots = read(spark, sf, "lineitem").groupBy(*_cell_columns(), step.alias("step")).agg(
        whole(F.col("l_quantity")).alias("q"),
        whole(F.round(F.col("l_discount") * 100)).alias("d"),
        whole(F.floor("l_extendedprice")).alias("p"),
        whole(F.round(F.col("l_tax") * 100)).alias("t"),
    )
    d, p, t = F.col("d"), F.col("p"), F.col("t")
    return slots.select(
        "iy", "ix", *_lat_lon(), "step",
        F.date_add(F.lit("1995-01-01").cast("date"), F.col("step") * 8 + 3).alias("time"),
        (24 + (F.col("q") % 51) * F.lit(0.16)).alias("sst"),
        F.when(d % 11 == 0, 0.0).when(d % 11 != 10, (d % 11) * F.lit(0.32) + 0.00512).alias("chl"),
        F.when(p % 13 != 0, 20 + (p % 41) * F.lit(0.64)).alias("par"),
        F.when(t % 10 != 9, F.lit(0.0256) * (1 + t % 9)).alias("kd490"),
    )


def pixels(spark, sf) -> DataFrame:
    """(variable, iy, ix, lat, lon, time, value), valid pixels only."""
    return to_pixels(obs(spark, sf), VARIABLES, ["iy", "ix", "lat", "lon", "time"])


def grid_of(spark, sf) -> Grid:
    """Box of all line items' cells; no grouping, so no shuffle."""
    return Grid.covering(read(spark, sf, "lineitem").select(*_cell_columns()).select(*_lat_lon()), RES)


def matrix(spark, sf) -> DataFrame:
    """Observed rows with depth, season and an index: a small feature table."""
    # Every observed cell has a depth; a left join drops out of plans that do not read it.
    df = obs(spark, sf).join(bathy(spark, sf).select("iy", "ix", "depth"), ["iy", "ix"], "left")
    return df.withColumns(
        {
            "month_sin": scores.month_sin(F.col("time")),
            "month_cos": scores.month_cos(F.col("time")),
            "productivity_index": scores.productivity_index(F.col("chl")),
        }
    )


def landings(spark, sf) -> DataFrame:
    """Orders as catch records: place, file, sector, species label and volume in hundredths."""
    joined = (
        read(spark, sf, "orders")
        .join(read(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    )
    label = F.element_at(F.array(*[F.lit(x) for x in LABELS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    species = F.element_at(F.array(*[F.lit(x) for x in config.SHEET_SPECIES.values()]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    code = F.when(F.col("o_orderstatus") == "F", "2E4GVCP0").when(F.col("o_orderstatus") == "O", "2e4gvmp0").otherwise("other")
    return joined.select(
        F.col("n_name").alias("geo"), F.col("n_nationkey").alias("nk"), (F.col("n_regionkey") + 1).alias("fma"),
        F.concat(code, F.lit("_"), F.floor(F.col("o_orderkey") / 7) % 2, F.lit(".xlsx")).alias("file"),
        (F.col("o_orderkey") % 7).cast("int").alias("li"), label.alias("label"), species.alias("species"),
        F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )


def reports(spark, sf) -> DataFrame:
    """(file, geo_raw, geo, species, year, quarter, volume_mt): one row per species label."""
    return (
        landings(spark, sf).groupBy("file", "geo", "label", "species", "year", "quarter")
        .agg((F.sum("cents") / 100).alias("volume_mt"))
        .select("file", F.concat(F.lit("...."), "geo").alias("geo_raw"), "geo", "species", "year", "quarter", "volume_mt")
    )


def catches(spark, sf) -> DataFrame:
    """(species, year, quarter, iy, ix, volume_mt): unique per species, quarter and cell."""
    place = [(F.col("nk") * 3 % 20).cast("int").alias("iy"), (F.col("nk") * 4 % 16).cast("int").alias("ix")]
    return landings(spark, sf).groupBy("species", "year", "quarter", *place).agg((F.sum("cents") / 100).alias("volume_mt"))


def areas(spark, sf) -> DataFrame:
    """(geo, fma). A look-up with gaps, so that dropping unmapped places has something to drop."""
    nation = read(spark, sf, "nation")
    return nation.where("n_nationkey % 9 <> 8").select(F.col("n_name").alias("geo"), (F.col("n_regionkey") + 1).alias("fma"))


def centroids(spark, sf) -> DataFrame:
    """(geo, lat, lon). A look-up with other gaps than ``areas``."""
    n = F.col("n_nationkey")
    return read(spark, sf, "nation").where("n_nationkey % 11 <> 10").select(
        F.col("n_name").alias("geo"), (4.5 + (n * 3 % 20) * 0.5 + 0.03).alias("lat"), (116.0 + (n * 4 % 16) * 0.5 - 0.04).alias("lon")
    )


def sheet_cells(spark, sf) -> DataFrame:
    """The landings printed as matrix sheets: (file, row_no, col_no, cell)."""
    sums = landings(spark, sf).groupBy("file", "nk", "geo", "li", "label", "year", "quarter").agg(F.sum("cents").alias("cents"))
    row = 5 + F.col("nk") * 7 + F.col("li")
    first = 3 + 4 * (F.col("year") - 1990)
    volume = (F.col("cents").cast("decimal(18,0)") / 100).cast("decimal(18,2)").cast("string")
    shown = (
        F.when(F.col("nk") % 7 == 0, F.lit("."))
        .when((F.col("nk") + F.col("li") + F.col("quarter")) % 6 == 0, F.lit(".."))
        .otherwise(volume)
    )
    def at(r, c, cell):
        return F.struct(F.lit(r).cast("int").alias("row_no") if isinstance(r, int) else r.cast("int").alias("row_no"),
                        F.lit(c).cast("int").alias("col_no") if isinstance(c, int) else c.cast("int").alias("col_no"), cell.alias("cell"))

    printed = F.array(
        at(1, 1, F.lit(config.SHEET_TITLE)),
        at(3, first, (F.col("year") + 10).cast("string")),
        at(4, first + F.col("quarter") - 1, F.concat(F.lit("Quarter "), F.col("quarter"))),
        at(5 + F.col("nk") * 7, 1, F.concat(F.lit("...."), "geo")),
        at(row, 2, F.col("label")),
        at(row, first + F.col("quarter") - 1, shown),
    )
    return sums.select("file", F.inline(printed)).distinct()


def granules(spark, sf) -> DataFrame:
    """(seq, short_name, granule_name, start_time, end_time, size_bytes, cloud_cover) with many repeated keys."""
    return granule_columns(read(spark, sf, "events"))


def granule_columns(events: DataFrame) -> DataFrame:
    day = F.col("ts").cast("date")
    stamp = lambda c: F.date_format(c, "yyyyMMdd")
    kind = F.upper("event_type")
    return events.select(
        F.col("event_id").alias("seq"), F.concat(F.lit("MODISA_L3m_"), kind).alias("short_name"),
        F.concat(F.lit("AQUA_MODIS."), stamp(day), F.lit("_"), stamp(F.date_add(day, 7)), F.lit(".L3m.8D."), kind, F.lit(".nc")).alias("granule_name"),
        F.col("ts").alias("start_time"), (F.col("ts") + F.expr("INTERVAL 7 DAYS")).alias("end_time"),
        F.floor(F.col("value") * 1000).cast("long").alias("size_bytes"), (F.col("user_id") % 100).cast("int").alias("cloud_cover"),
    )


def scored(spark, sf) -> DataFrame:
    """(k, y_bin, score, y_cont): tied scores against a binary and a continuous label."""
    return (
        read(spark, sf, "documents").join(read(spark, sf, "labels"), "doc_id")
        .select(
            F.col("doc_id").alias("k"), F.col("quality").cast("int").alias("y_bin"),
            (F.col("n_chars") % 97).cast("double").alias("score"), F.col("n_chars").cast("double").alias("y_cont"),
        )
    )


def trials(spark, sf) -> DataFrame:
    """(species, algorithm, y, prediction): line items read as scored rows of seven learners."""
    return read(spark, sf, "lineitem").select(
        F.element_at(F.array(*[F.lit(s.code) for s in config.SPECIES[:5]]), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("species"),
        F.concat(F.lit("learner_"), F.col("l_linenumber")).alias("algorithm"),
        (F.col("l_quantity") / 10).alias("y"),
        ((F.col("l_quantity") + F.round(F.col("l_tax") * 100) * (F.col("l_linenumber") % 4) - 4) / 10).alias("prediction"),
    )


# --- the same tables as SQL ----------------------------------------------------------

_BAND = "(l_suppkey // 5)"
_CELL = f"CAST({_BAND} % 40 AS INTEGER) AS iy, CAST(l_partkey % 16 + 16 * ({_BAND} // 40) AS INTEGER) AS ix"
_LL = "4.5::DOUBLE + iy * 0.5::DOUBLE AS lat, 116::DOUBLE + ix * 0.5::DOUBLE AS lon"
_LABEL_LIST = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_SPECIES_LIST = "[" + ", ".join(f"'{x}'" for x in config.SHEET_SPECIES.values()) + "]"

SQL_TABLES: dict[str, tuple[list[str], str]] = {
    "bathy": ([], f"""SELECT iy, ix, {_LL}, ((q + iy * 7 + ix * 13) % 23 - 18) * 25::DOUBLE AS depth
        FROM (SELECT {_CELL}, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q FROM lineitem GROUP BY 1, 2)"""),
    "obs": ([], f"""SELECT iy, ix, {_LL}, step, CAST(DATE '1995-01-01' + CAST(step * 8 + 3 AS INTEGER) AS DATE) AS time,
          24 + (q % 51) * 0.16::DOUBLE AS sst,
          CASE WHEN d % 11 = 0 THEN 0 WHEN d % 11 <> 10 THEN (d % 11) * 0.32::DOUBLE + 0.00512::DOUBLE END AS chl,
          CASE WHEN p % 13 <> 0 THEN 20 + (p % 41) * 0.64::DOUBLE END AS par,
          CASE WHEN t % 10 <> 9 THEN 0.0256::DOUBLE * (1 + t % 9) END AS kd490
        FROM (SELECT {_CELL}, CAST(floor(date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 8) AS INTEGER) AS step,
            CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS q, CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS d,
            CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS p, CAST(sum(CAST(round(l_tax * 100) AS BIGINT)) AS BIGINT) AS t
          FROM lineitem GROUP BY 1, 2, 3)"""),
    "dims": (["bathy"], "SELECT max(iy) + 1 AS ny, max(ix) + 1 AS nx FROM bathy"),
    "grid": (["dims"], f"""SELECT iy, ix, {_LL} FROM (SELECT CAST(unnest(range((SELECT ny FROM dims))) AS INTEGER) AS iy)
        CROSS JOIN (SELECT CAST(unnest(range((SELECT nx FROM dims))) AS INTEGER) AS ix)"""),
    "geom": (["grid"], "SELECT cos(radians(avg(lat))) AS cosl FROM (SELECT DISTINCT lat FROM grid)"),
    "axis": (["obs"], "SELECT time, row_number() OVER (ORDER BY time) AS n FROM (SELECT DISTINCT time FROM obs)"),
    "dense": (["obs", "grid", "axis"], """SELECT g.iy, g.ix, g.lat, g.lon, a.time, o.sst, o.chl, o.par, o.kd490
        FROM grid g CROSS JOIN axis a LEFT JOIN obs o ON o.iy = g.iy AND o.ix = g.ix AND o.time = a.time"""),
    "pixels": (["obs"], " UNION ALL ".join(
        f"SELECT '{v}' AS variable, iy, ix, lat, lon, time, {v} AS value FROM obs WHERE {v} IS NOT NULL" for v in VARIABLES)),
    "filled": (["pixels", "grid"], """SELECT variable, iy, ix, time, fv AS value, value IS NULL AS filled FROM (
        SELECT *, CASE WHEN value IS NOT NULL THEN value WHEN run > 4 THEN NULL
            WHEN p1 IS NOT NULL AND n1 IS NOT NULL THEN p1 + (n1 - p1) * (date_diff('day', pt1, time)::DOUBLE / date_diff('day', pt1, nt1))
            WHEN p1 IS NOT NULL AND p0 IS NOT NULL THEN p1 + (p1 - p0) * (date_diff('day', pt1, time)::DOUBLE / date_diff('day', pt0, pt1))
            WHEN n1 IS NOT NULL AND n2 IS NOT NULL THEN n1 - (n2 - n1) * (date_diff('day', time, nt1)::DOUBLE / date_diff('day', nt1, nt2)) END AS fv
        FROM (SELECT *, sum(CASE WHEN value IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY variable, iy, ix, rid) AS run FROM (
            SELECT *, count(value) OVER w AS rid,
              lag(value, 1 IGNORE NULLS) OVER w AS p1, lag(value, 2 IGNORE NULLS) OVER w AS p0,
              lead(value, 1 IGNORE NULLS) OVER w AS n1, lead(value, 2 IGNORE NULLS) OVER w AS n2,
              lag(vt, 1 IGNORE NULLS) OVER w AS pt1, lag(vt, 2 IGNORE NULLS) OVER w AS pt0,
              lead(vt, 1 IGNORE NULLS) OVER w AS nt1, lead(vt, 2 IGNORE NULLS) OVER w AS nt2
            FROM (SELECT a.variable, g.iy, g.ix, a.time, p.value, CASE WHEN p.value IS NOT NULL THEN a.time END AS vt
              FROM (SELECT DISTINCT variable, time FROM pixels) a CROSS JOIN grid g
              LEFT JOIN pixels p ON p.variable = a.variable AND p.iy = g.iy AND p.ix = g.ix AND p.time = a.time)
            WINDOW w AS (PARTITION BY variable, iy, ix ORDER BY time))))
        WHERE fv IS NOT NULL"""),
    "cube": (["filled"], "SELECT iy, ix, time, " + ", ".join(
        f"max(CASE WHEN variable = '{v}' THEN value END) AS {v}" for v in VARIABLES) + " FROM filled GROUP BY 1, 2, 3"),
    "matrix": (["obs", "bathy"], """SELECT o.*, b.depth, sin(month(time) * (2 * pi() / 12)) AS month_sin, cos(month(time) * (2 * pi() / 12)) AS month_cos,
          CASE WHEN chl > 0 THEN log10(greatest(chl, 1e-4) + 1e-4) END AS productivity_index
        FROM obs o JOIN bathy b ON o.iy = b.iy AND o.ix = b.ix"""),
    "landings": ([], f"""SELECT n_name AS geo, n_nationkey AS nk, n_regionkey + 1 AS fma,
          concat(CASE o_orderstatus WHEN 'F' THEN '2E4GVCP0' WHEN 'O' THEN '2e4gvmp0' ELSE 'other' END, '_', (o_orderkey // 7) % 2, '.xlsx') AS file,
          CAST(o_orderkey % 7 AS INTEGER) AS li, ({_LABEL_LIST})[o_orderkey % 7 + 1] AS label, ({_SPECIES_LIST})[o_orderkey % 7 + 1] AS species,
          CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(round(o_totalprice * 100) AS BIGINT) AS cents
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"""),
    "reports": (["landings"], """SELECT file, concat('....', geo) AS geo_raw, geo, species, year, quarter, CAST(sum(cents) AS BIGINT) / 100 AS volume_mt
        FROM landings GROUP BY file, geo, label, species, year, quarter"""),
    "catches": (["landings"], """SELECT species, year, quarter, CAST(nk * 3 % 20 AS INTEGER) AS iy, CAST(nk * 4 % 16 AS INTEGER) AS ix, CAST(sum(cents) AS BIGINT) / 100 AS volume_mt
        FROM landings GROUP BY 1, 2, 3, 4, 5"""),
    "areas": ([], "SELECT n_name AS geo, n_regionkey + 1 AS fma FROM nation WHERE n_nationkey % 9 <> 8"),
    "centroids": ([], """SELECT n_name AS geo, 4.5::DOUBLE + (n_nationkey * 3 % 20) * 0.5::DOUBLE + 0.03::DOUBLE AS lat,
          116::DOUBLE + (n_nationkey * 4 % 16) * 0.5::DOUBLE - 0.04::DOUBLE AS lon FROM nation WHERE n_nationkey % 11 <> 10"""),
    "sheet": (["landings"], f"""SELECT DISTINCT file, CAST(u.r AS INTEGER) AS row_no, CAST(u.c AS INTEGER) AS col_no, u.v AS cell FROM (
        SELECT file, unnest([
          {{'r': 1, 'c': 1, 'v': '{config.SHEET_TITLE}'}},
          {{'r': 3, 'c': 3 + 4 * (year - 1990), 'v': CAST(year + 10 AS VARCHAR)}},
          {{'r': 4, 'c': 3 + 4 * (year - 1990) + quarter - 1, 'v': concat('Quarter ', quarter)}},
          {{'r': 5 + nk * 7, 'c': 1, 'v': concat('....', geo)}},
          {{'r': 5 + nk * 7 + li, 'c': 2, 'v': label}},
          {{'r': 5 + nk * 7 + li, 'c': 3 + 4 * (year - 1990) + quarter - 1, 'v': CASE WHEN nk % 7 = 0 THEN '.'
              WHEN (nk + li + quarter) % 6 = 0 THEN '..' ELSE CAST(CAST(CAST(cents AS DECIMAL(18,0)) / 100 AS DECIMAL(18,2)) AS VARCHAR) END}}]) AS u
        FROM (SELECT file, nk, geo, li, label, year, quarter, CAST(sum(cents) AS BIGINT) AS cents FROM landings GROUP BY ALL))"""),
    "granules": ([], """SELECT event_id AS seq, concat('MODISA_L3m_', upper(event_type)) AS short_name,
          concat('AQUA_MODIS.', strftime(ts, '%Y%m%d'), '_', strftime(CAST(ts AS DATE) + 7, '%Y%m%d'), '.L3m.8D.', upper(event_type), '.nc') AS granule_name,
          ts AS start_time, ts + INTERVAL 7 DAYS AS end_time, CAST(floor(value * 1000) AS BIGINT) AS size_bytes, CAST(user_id % 100 AS INTEGER) AS cloud_cover
        FROM events"""),
    "scored": ([], """SELECT d.doc_id AS k, CAST(quality AS INTEGER) AS y_bin, CAST(n_chars % 97 AS DOUBLE) AS score, CAST(n_chars AS DOUBLE) AS y_cont
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""),
    "trials": ([], """SELECT (['sardinella', 'anchovy', 'mackerel', 'scad', 'slipmouth'])[l_suppkey % 5 + 1] AS species,
          concat('learner_', l_linenumber) AS algorithm, l_quantity / 10 AS y,
          (l_quantity + round(l_tax * 100) * (l_linenumber % 4) - 4) / 10 AS prediction FROM lineitem"""),
}


def sql_over(tables: str, body: str) -> str:
    """``body`` preceded by the named derived tables and whatever those need."""
    order: list[str] = []

    def need(name: str) -> None:
        for parent in SQL_TABLES[name][0]:
            need(parent)
        if name not in order:
            order.append(name)

    for name in tables.split():
        need(name)
    ctes = ", ".join(f"{name} AS ({SQL_TABLES[name][1]})" for name in order)
    if body.lstrip().upper().startswith("WITH "):
        return f"WITH {ctes}, {body.lstrip()[5:]}" if ctes else body
    return f"WITH {ctes} {body}" if ctes else body


def region_case(lat: str = "lat", lon: str = "lon") -> str:
    arms = " ".join(
        f"WHEN {lat} BETWEEN {r.lat_min} AND {r.lat_max} AND {lon} BETWEEN {r.lon_min} AND {r.lon_max} THEN '{r.name}'"
        for r in config.REGIONS
    )
    return f"CASE {arms} END"


def region_rows() -> str:
    return "(VALUES " + ", ".join(
        f"('{r.name}', {r.lon_min}, {r.lat_min}, {r.lon_max}, {r.lat_max})" for r in config.REGIONS
    ) + ") AS r(region, lon_min, lat_min, lon_max, lat_max)"


def member_sql(x: str, lo: float, hi: float) -> str:
    w = max((hi - lo) * 0.2, 0.5)
    return (f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} BETWEEN {lo} AND {hi} THEN 1::DOUBLE "
            f"WHEN {x} < {lo} THEN exp(-1 * (({x} - {lo}::DOUBLE) ** 2) / (2 * {w * w!r}::DOUBLE)) ELSE exp(-1 * (({x} - {hi}::DOUBLE) ** 2) / (2 * {w * w!r}::DOUBLE)) END)")


def habitat_sql(code: str, sst: str = "sst", chl: str = "chl") -> str:
    s = config.species_by_code(code)
    log_chl = f"(CASE WHEN {chl} > 0 THEN log10({chl}) ELSE 0::DOUBLE END)"
    return f"sqrt({member_sql(sst, s.sst_lo, s.sst_hi)} * {member_sql(log_chl, s.chl_lo, s.chl_hi)})"
