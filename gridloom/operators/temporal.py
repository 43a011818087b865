"""Time operators per cell: axes, gap filling, densifying, rolling means, anomalies.

Every function here groups by ``(iy, ix)`` first, so a chain of them costs one exchange: later
windows and aggregates whose keys contain ``(iy, ix)`` reuse that partitioning. A group holds at
most one row per time step, so no key can outgrow the length of the record.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom import CELL, config
from gridloom.functions import scores
from gridloom.operators import tiling
from gridloom.operators.grid import Grid


def seconds(df: DataFrame, time: str = "time") -> Column:
    """Elapsed seconds of a DATE or TIMESTAMP column."""
    if isinstance(df.schema[time].dataType, T.DateType):
        return F.unix_date(F.col(time)).cast("double") * 86400.0
    return F.unix_micros(F.col(time).cast("timestamp")) / 1e6


def time_options(df: DataFrame, time: str = "time") -> DataFrame:
    return df.select(time).distinct().orderBy(time)


def time_axis(df: DataFrame, time: str = "time") -> Column:
    """Sorted distinct times as a scalar subquery: an array as long as the record has steps."""
    return df.select(time).distinct().agg(F.array_sort(F.collect_list(time))).scalar()


def time_axes(df: DataFrame, by: str, time: str = "time") -> Column:
    """Sorted distinct times per value of ``by``, as a map."""
    per = df.select(by, time).distinct().groupBy(by).agg(F.array_sort(F.collect_list(time)).alias("axis"))
    return per.agg(F.map_from_entries(F.collect_list(F.struct(by, "axis")))).scalar()


def _numbered(axis_from: DataFrame, by: list[str], time: str) -> DataFrame:
    """``by, time, _at``: the steps of each axis, counted from 1. As long as the record has steps."""
    order = Window.partitionBy(*by).orderBy(time)
    steps = axis_from.select(*by, time).where(F.col(time).isNotNull()).distinct()
    return steps.select(*[F.col(c).alias(f"_axis_{c}") for c in (*by, time)], F.row_number().over(order).cast("long").alias("_at"))


def _on_axis(df: DataFrame, axis_from: DataFrame, by: list[str], time: str) -> DataFrame:
    """Adds ``_at``, the step of each row; a row whose step is not on the axis is an error, not a loss.

    The axis is broadcast: its rows are the time steps of the record (by variable), not observations.
    """
    steps = _numbered(axis_from, by, time)
    placed = df.join(F.broadcast(steps), [F.col(c).eqNullSafe(F.col(f"_axis_{c}")) for c in (*by, time)], "left")
    where = F.concat_ws(" ", F.lit("not on the time axis:"), *[F.col(c).cast("string") for c in (*by, time)])
    checked = F.coalesce(F.col("_at"), F.raise_error(where).cast("long"))
    return placed.withColumn("_at", checked).drop(*[f"_axis_{c}" for c in (*by, time)])


def _step_days(df: DataFrame, time: str) -> DataFrame:
    """Days to the next time step, one row per step of the record."""
    following = F.lead(time).over(Window.orderBy(time))
    return df.select(time).distinct().select(F.date_diff(following, F.col(time)).alias("days"))


def median_step(df: DataFrame, time: str = "time") -> DataFrame:
    """Median number of whole days between consecutive time steps (one row)."""
    return _step_days(df, time).agg(F.median("days").alias("median_step"))


def steps_of(days: float, step: float | None) -> int:
    """Rolling window length in steps; halves round to even."""
    return max(1, round(days / max(step or 1, 1)))


def record(df: DataFrame, time: str = "time") -> tuple[int, float | None]:
    """Number of time steps and median days between them (reads back these two numbers)."""
    gaps = _step_days(df, time).agg(F.count(F.lit(1)), F.median("days")).first()
    return gaps[0], gaps[1]


def rolling_steps(df: DataFrame, days: tuple[int, ...] = config.ROLLING_DAYS) -> dict[int, int]:
    """Rolling window lengths on this record's axis."""
    _, step = record(df)
    return {d: steps_of(d, step) for d in days}


def densify(
    df: DataFrame, grid: Grid, values: list[str], time: str = "time", axis_from: DataFrame | None = None
) -> DataFrame:
    """One row per cell and time step; steps without an observation get NULL values.

    Each observation also emits the empty steps up to the next one, so the full table comes out
    of one left join on the cell instead of a join on (cell, time). ``axis_from`` names a cheaper
    table with the same time steps, such as the pixels that ``df`` was computed from. A task holds
    the series of a bounded number of cells.
    """
    steps_of_record = df if axis_from is None else axis_from
    axis = time_axis(steps_of_record, time)
    cells = grid.cells(df.sparkSession).repartition(tiling.parts(df.sparkSession, grid), *CELL)
    placed = cells.join(_on_axis(df.select(*CELL, time, *values), steps_of_record, [], time), CELL, "left")
    order = Window.partitionBy(*CELL).orderBy("_at")
    bounds = placed.withColumns(
        {
            "_from": F.when(F.lag("_at").over(order).isNull(), F.lit(1)).otherwise(F.col("_at")),
            "_to": F.coalesce(F.lead("_at").over(order) - 1, F.size(axis).cast("long")),
        }
    )
    steps = bounds.withColumn("_slot", F.explode(F.sequence(F.col("_from").cast("long"), F.col("_to"))))
    here = F.col("_slot") == F.col("_at")
    return steps.select(
        *CELL,
        F.element_at(axis, F.col("_slot").cast("int")).alias(time),
        "lat",
        "lon",
        *[F.when(here, F.col(v)).alias(v) for v in values],
    )


def gap_fill(
    pixels: DataFrame,
    max_gap: int | None = config.MAX_GAP_STEPS,
    by: str = "variable",
    value: str = "value",
    time: str = "time",
    axis_from: DataFrame | None = None,
    grid: Grid | None = None,
) -> DataFrame:
    """Fills short gaps of each cell's series; rows in and out carry values only.

    ``pixels(by, iy, ix, time, value)``: gaps are counted in steps of the variable's own axis.
    Inner gaps are interpolated in elapsed time, leading and trailing ones continue the line
    through the two nearest values, runs longer than ``max_gap`` stay empty, and so do cells
    with a single value. ``filled`` tells the new rows apart. ``axis_from(by, time)`` lists the
    composites that exist; without it they are the times of the pixels, so a composite that is
    clouded everywhere would not count as a step. A variable or time that it does not list is an error.
    ``grid`` bounds the number of cells that one task holds.
    """
    steps_of_record = pixels if axis_from is None else axis_from
    axis = F.element_at(time_axes(steps_of_record, by, time), F.col(by))
    tasks = [] if grid is None else [tiling.parts(pixels.sparkSession, grid)]
    # Steps are numbered where they are used, not sent.
    valid = _on_axis(pixels.where(F.col(value).isNotNull()).repartition(*tasks, *CELL), steps_of_record, [by], time)
    series = Window.partitionBy(by, *CELL).orderBy(time)
    here = F.struct(F.col("_at").alias("at"), seconds(pixels, time).alias("t"), F.col(value).alias("v"))
    linked = (
        valid.select(by, *CELL, time, value, here.alias("p"), F.size(axis).cast("long").alias("_last"))
        .withColumns({"_b": F.lag("p").over(series), "_n": F.lead("p").over(series)})
    )
    p, before, following = F.col("p"), F.col("_b"), F.col("_n")
    short = (lambda gap: gap > 0) if max_gap is None else (lambda gap: gap.between(1, max_gap))
    has_line = before.isNotNull() | following.isNotNull()
    leading = before.isNull() & has_line & short(p["at"] - 1)
    run = F.when(following.isNotNull(), following["at"] - p["at"] - 1).otherwise(F.col("_last") - p["at"])
    slope = F.coalesce(
        (following["v"] - p["v"]) / (following["t"] - p["t"]), (p["v"] - before["v"]) / (p["t"] - before["t"])
    )
    slots = F.sequence(
        F.when(leading, F.lit(1).cast("long")).otherwise(p["at"]),
        F.when(has_line & short(run), p["at"] + run).otherwise(p["at"]),
    )
    filled = linked.withColumns({"_slope": slope, "_slot": F.explode(slots)}).withColumn(
        time, F.element_at(axis, F.col("_slot").cast("int"))
    )
    own = F.col("_slot") == p["at"]
    return filled.select(
        by,
        *CELL,
        time,
        F.when(own, p["v"]).otherwise(p["v"] + F.col("_slope") * (seconds(filled, time) - p["t"])).alias(value),
        (~own).alias("filled"),
    )


def long_gaps(dense: DataFrame, value: str, max_gap: int, out: str = "long_gap", time: str = "time") -> DataFrame:
    """Flags steps inside runs of more than ``max_gap`` missing values (gaps and islands)."""
    series = Window.partitionBy(*CELL).orderBy(time)
    island = F.count(value).over(series.rowsBetween(Window.unboundedPreceding, 0))
    missing = F.col(value).isNull()
    run = F.sum(missing.cast("int")).over(Window.partitionBy(*CELL, "_island"))
    return dense.withColumn("_island", island).withColumn(out, missing & (run > max_gap)).drop("_island")


def monthly_climatology(df: DataFrame, values: list[str], time: str = "time") -> DataFrame:
    """Mean per cell and calendar month over all years."""
    return df.groupBy(*CELL, F.month(time).alias("month")).agg(*[F.avg(v).alias(v) for v in values])


def _month_mean(value: str, time: str) -> Column:
    return F.avg(value).over(Window.partitionBy(*CELL, F.month(time)))


def climatology_fill(df: DataFrame, values: list[str], time: str = "time") -> DataFrame:
    """Missing values take the cell's mean for that month."""
    return df.withColumns({v: F.coalesce(F.col(v), _month_mean(v, time)) for v in values})


def with_anomalies(df: DataFrame, values: list[str], time: str = "time", suffix: str = "_anom") -> DataFrame:
    return df.withColumns({f"{v}{suffix}": F.col(v) - _month_mean(v, time) for v in values})


def rolling_mean(value: str, steps: int, time: str = "time") -> Column:
    """Centred mean over ``steps`` rows that skips missing values; even windows lean back."""
    if steps == 1:
        return F.col(value)
    back = steps // 2
    window = Window.partitionBy(*CELL).orderBy(time).rowsBetween(-back, steps - 1 - back)
    return F.avg(value).over(window)


def with_rolling_means(dense: DataFrame, values: list[str], steps: dict[int, int], time: str = "time") -> DataFrame:
    return dense.withColumns(
        {f"{v}_roll{days}d": rolling_mean(v, n, time) for v in values for days, n in steps.items()}
    )


def with_season(df: DataFrame, time: str = "time") -> DataFrame:
    return df.withColumns({"month_sin": scores.month_sin(F.col(time)), "month_cos": scores.month_cos(F.col(time))})


def temporal_features(
    dense: DataFrame,
    steps: dict[int, int],
    n_steps: int | None = None,
    values: tuple[str, ...] = config.GRID_VARIABLES,
    time: str = "time",
) -> DataFrame:
    """Rolling means, anomalies and season of every variable present.

    Anomalies need a record longer than twelve steps; pass ``n_steps`` to have that checked.
    """
    present = [v for v in values if v in dense.columns]
    out = with_rolling_means(dense, present, steps, time)
    if n_steps is None or n_steps > config.MIN_STEPS_FOR_ANOMALY:
        out = with_anomalies(out, present, time)
    return with_season(out, time)


def at_nearest_time(df: DataFrame, wanted, time: str = "time") -> DataFrame:
    """Rows of the composite closest to ``wanted``; of two equally close ones the earlier.

    The chosen time is a subquery result, so it prunes partitions of a table laid out by time.
    """
    axis = df.select(time).distinct()
    target = F.lit(wanted).cast("timestamp")
    distance = F.abs(F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(target))
    nearest = axis.agg(F.min_by(time, F.struct(distance, F.col(time)))).scalar()
    return df.where(F.col(time) == nearest)


def at_latest_time(df: DataFrame, time: str = "time") -> DataFrame:
    return df.where(F.col(time) == df.agg(F.max(time)).scalar())


def in_year(df: DataFrame, year: int, time: str = "time") -> DataFrame:
    """A half-open range on the time column, which a parquet scan can push down."""
    first, after = (F.lit(f"{y:04d}-01-01").cast(df.schema[time].dataType) for y in (year, year + 1))
    return df.where((F.col(time) >= first) & (F.col(time) < after))


def temporal_mean(df: DataFrame, values: list[str], year: int | None = None, time: str = "time") -> DataFrame:
    """Mean per cell over one year or the whole record."""
    picked = df if year is None else in_year(df, year, time)
    return picked.groupBy(*CELL).agg(*[F.avg(v).alias(v) for v in values])


def snapshot(df: DataFrame, wanted, features: list[str], time: str = "time") -> DataFrame:
    """One composite with exactly the requested features; absent ones become NULL columns."""
    columns = [F.col(f) if f in df.columns else F.lit(None).cast("double").alias(f) for f in features]
    picked = at_latest_time(df, time) if wanted is None else at_nearest_time(df, wanted, time)
    return picked.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(*CELL, "lat", "lon", *columns)
