"""Study constants: grid, regions, species, features, thresholds."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values: study grid and physical constants -------------------------------
STUDY_BBOX = (116.0, 4.5, 127.0, 21.5)  # lon_min, lat_min, lon_max, lat_max
STUDY_RES = 0.1
KM_PER_DEGREE = 111.32
METRES_PER_DEGREE = 111_320.0

GRANULE_PAD = 0.8
REGRID_PAD = 0.6
MAX_GAP_STEPS = 4
ROLLING_DAYS = (7, 14, 30, 90)
LAG_RADII_KM = (20, 50, 100)
MIN_STEPS_FOR_ANOMALY = 12

CATALOG_PERIOD = ("2015-01-01", "2025-12-31")
COUNT_YEARS = (2015, 2025)


@dataclass(frozen=True)
class Region:
    """A named box; boxes may overlap and their list order breaks ties."""

    name: str
    lon_min: float
    lat_min: float
    lon_max: float
    lat_max: float


# Management areas, in the order in which they claim a point.
REGIONS = (
    Region("FMA1 - North Philippine Sea", 120.0, 15.0, 125.0, 21.5),
    Region("FMA2 - West Philippine Sea", 116.0, 8.0, 120.5, 21.5),
    Region("FMA3 - Sulu-Celebes Sea", 117.5, 3.0, 122.5, 9.5),
    Region("FMA4 - Visayan Sea", 122.5, 9.0, 125.0, 12.5),
    Region("FMA5 - West Sulu Sea", 117.0, 7.0, 121.0, 12.0),
    Region("FMA6 - East Philippine Sea", 124.0, 6.0, 127.0, 18.0),
)


@dataclass(frozen=True)
class Species:
    """Preferred surface temperature (deg C) and chlorophyll bounds of a species."""

    code: str
    sst_lo: float
    sst_hi: float
    chl_lo: float
    chl_hi: float


# Target species. "all" is a composite and is never trained on.
SPECIES = (
    Species("sardinella", 26.0, 31.0, 0.2, 3.0),
    Species("anchovy", 26.5, 30.0, 0.3, 4.0),
    Species("mackerel", 27.0, 31.0, 0.1, 2.0),
    Species("scad", 26.0, 30.0, 0.2, 3.5),
    Species("slipmouth", 25.0, 30.0, 0.3, 5.0),
    Species("all", 25.0, 31.0, 0.1, 5.0),
)
COMPOSITE_SPECIES = "all"


def species_by_code(code: str) -> Species:
    for species in SPECIES:
        if species.code == code:
            return species
    raise KeyError(f"unknown species code {code!r}")


def trainable_species() -> list[str]:
    return [s.code for s in SPECIES if s.code != COMPOSITE_SPECIES]


# Names under which the source products carry each variable.
SOURCE_VARIABLES = {"chlor_a": "chl", "sst": "sst", "par": "par", "Kd_490": "kd490"}
AXIS_ALIASES = {"latitude": "lat", "y": "lat", "longitude": "lon", "x": "lon"}
GRID_VARIABLES = ("sst", "chl", "par", "kd490")
STATIC_FIELDS = ("depth", "slope", "dist_coast")
LAG_VARIABLES = ("sst", "chl", "frontal_index")

# Configured feature name -> feature table column.
FEATURE_ALIASES = {
    "sst": "sst",
    "sst_anomaly": "sst_anom",
    "chlor_a": "chl",
    "chlor_a_rolling_30": "chl_roll30d",
    "chlor_a_anomaly": "chl_anom",
    "kd490": "kd490",
    "par": "par",
    "bathymetry_depth": "depth",
    "bathymetry_slope": "slope",
    "distance_to_coast": "dist_coast",
    "frontal_index": "frontal_index",
    "productivity_index": "productivity_index",
    "upwelling_proxy": "upwelling_proxy",
    "month_sin": "month_sin",
    "month_cos": "month_cos",
}

# Chronological split, label transforms, flag thresholds.
TRAIN_UNTIL = 2022
VALIDATION_YEARS = (2023, 2024)
HOLDOUT_FROM = 2025
TARGET_TRANSFORMS = {"habitat": None, "catch": "log1p"}
RATIO_SUSTAINABLE = 0.6
RATIO_CAUTION = 0.8

# Statistical sheet vocabulary.
SHEET_TITLE = "Volume of Production by Geolocation"
PROVINCE_PREFIX = "...."
CAPITAL_REGION = "..National Capital Region (NCR)"
SHEET_SPECIES = {
    "..Anchovies (Dilis)": "anchovy",
    "..Bali sardinella (Tamban)": "sardinella",
    "..Fimbriated sardines (Tunsoy)": "sardinella",
    "..Indian mackerel (Alumahan)": "mackerel",
    "..Indo-pacific mackerel (Hasa-hasa)": "mackerel",
    "..Roundscad (Galunggong)": "scad",
    "..Slipmouth (Sapsap)": "slipmouth",
}
VARIANT_PREFIX = "Sulu"
PROVINCE_ALIASES = {
    "Sulu a/": "Sulu",
    "Sulu a/\nStill part of BARMM prior to 2026\n": "Sulu",
}
SECTOR_CODES = {"2E4GVCP0": "commercial", "2E4GVMP0": "municipal"}
OTHER_SECTOR = "extra"
SHEET_YEARS = (2000, 2100)
CATCH_COLUMNS = ("fma", "species", "year", "quarter", "volume_mt", "lat", "lon")

# Learner settings.
BOOSTED_TREES = {"trees": 300, "depth": 6, "rate": 0.05, "rows": 0.8, "columns": 0.8, "seed": 42}
BOOSTED_TREES_STUDY = {"trees": 1000, "patience": 50}
FOREST = {"trees": 200, "depth": 22, "min_leaf": 5, "seed": 42}
RIDGE_ALPHA = 1.0
LOGISTIC_ITERATIONS = 2000
