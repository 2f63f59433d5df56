"""Runs of consecutive flagged steps (gaps and islands): heatwave masks, days and events per year."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.scalar import lit_array
from thermocline.model import CELL, axis_years, time_axis, with_time_index


def _mark(df: DataFrame, flag: str, min_len: int, keys, out: str) -> DataFrame:
    """``mark_runs`` on a frame that has ``time_idx``."""
    f = F.coalesce(F.col(flag).cast("boolean"), F.lit(False)) & F.col("time_idx").isNotNull()
    d = df.withColumn("_f", f)
    w = Window.partitionBy(*keys, "_f").orderBy("time_idx")
    d = d.withColumn("_isl", F.col("time_idx") - F.row_number().over(w))
    run_len = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_f", "_isl"))
    return d.withColumn(out, F.col("_f") & (run_len >= min_len)).drop("_f", "_isl")


def mark_runs(df: DataFrame, flag: str, min_len: int, keys=CELL, out: str = "in_run", axis: DataFrame | None = None) -> DataFrame:
    """``out`` is true on every row of a run of at least ``min_len`` consecutive true ``flag`` rows.

    Consecutive means next to each other on the time axis all cells share: a step that the
    cell has no row for ends a run, as a false or missing flag does.  Within the flagged rows
    of a key, ``time_idx - row_number`` is constant on a run; all windows share one shuffle on the
    keys.  ``axis`` is the ``(t, time_idx)`` table (derived from ``df`` if absent).
    """
    has = "time_idx" in df.columns
    marked = _mark(with_time_index(df, axis), flag, min_len, keys, out)
    return marked if has else marked.drop("time_idx")


def mark_runs_calendar(df: DataFrame, flag: str, min_len: int, keys=CELL, order: str = "t", out: str = "in_run") -> DataFrame:
    """Variant where a missing date also ends a run (islands keyed by date minus rank)."""
    f = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    d = df.withColumn("_f", f)
    w = Window.partitionBy(*keys, "_f").orderBy(order)
    d = d.withColumn("_isl", F.date_sub(F.col(order).cast("date"), F.row_number().over(w).cast("int")))
    run_len = F.count(F.lit(1)).over(Window.partitionBy(*keys, "_f", "_isl"))
    return d.withColumn(out, F.col("_f") & (run_len >= min_len)).drop("_f", "_isl")


def _valid_count(df: DataFrame, value: str = "sst") -> Column:
    return (F.count(value) if value in df.columns else F.count(F.lit(1))).alias("n_valid")


def _every_year(yearly: DataFrame, cols, years, keys) -> DataFrame:
    """One row per key and year of the axis; zero where the key has no rows in a year.

    A key's years (a few) are folded into a map and expanded: no join, no further shuffle.
    """
    entry = F.struct("year", F.struct(*cols).alias("v"))
    folded = yearly.groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    rows = folded.select(*keys, "_m", F.explode(lit_array([int(y) for y in years])).alias("year"))
    zero = F.lit(0).cast("long")
    return rows.select(*keys, "year", *[F.coalesce(F.try_element_at("_m", F.col("year"))[c], zero).alias(c) for c in cols])


def yearly_runs(mask: DataFrame, col: str = "mhw", min_len: int = 5, keys=CELL, axis: DataFrame | None = None) -> DataFrame:
    """``days`` and ``events`` per cell and calendar year in one aggregate, with ``n_valid``.

    Events are runs of at least ``min_len`` flagged days, the mask being cut at year ends (a run
    over New Year counts in each year whose own piece is long enough).  Every year of the
    shared axis has a row for every cell: zero where nothing is flagged, or no row at all.
    """
    axis = axis if axis is not None else time_axis(mask)
    m = with_time_index(mask, axis).withColumn("year", F.year("t").cast("int"))
    y = _mark(m, col, min_len, [*keys, "year"], "_long")
    w = Window.partitionBy(*keys, "year", "_long").orderBy("time_idx")
    start = F.col("_long") & (F.coalesce(F.lag("time_idx").over(w), F.lit(-2)) != F.col("time_idx") - 1)
    y = y.withColumn("_start", start).where("year is not null")
    out = y.groupBy(*keys, "year").agg(
        F.coalesce(F.sum(F.col(col).cast("int")), F.lit(0)).cast("long").alias("days"),
        F.sum(F.col("_start").cast("int")).cast("long").alias("events"),
        _valid_count(mask),
    )
    return _every_year(out, ["days", "events", "n_valid"], axis_years(axis), keys)


def days_per_year(mask: DataFrame, col: str = "mhw", keys=CELL, axis: DataFrame | None = None) -> DataFrame:
    """Flagged days per cell and year of the shared axis (plus ``n_valid`` for ``null_on_land``)."""
    axis = axis if axis is not None else time_axis(mask)
    out = mask.where("t is not null").groupBy(*keys, F.year("t").cast("int").alias("year")).agg(
        F.coalesce(F.sum(F.col(col).cast("int")), F.lit(0)).cast("long").alias("days"), _valid_count(mask)
    )
    return _every_year(out, ["days", "n_valid"], axis_years(axis), keys)


def events_per_year(mask: DataFrame, col: str = "mhw", min_len: int = 5, keys=CELL, axis: DataFrame | None = None) -> DataFrame:
    """Events per cell and year of the shared axis: see ``yearly_runs``."""
    return yearly_runs(mask, col, min_len, keys, axis).drop("days")


def null_on_land(yearly: DataFrame, cols, keys=CELL) -> DataFrame:
    """NULL ``cols`` on cells without any valid value in any year (land).

    Uses the ``n_valid`` counts of the yearly table itself: a window over the cell on the
    small yearly table, no second pass over the cube.
    """
    land = F.sum("n_valid").over(Window.partitionBy(*keys)) == 0
    out = yearly.withColumn("_land", land)
    return out.withColumns({c: F.when(~F.col("_land"), F.col(c)) for c in cols}).drop("_land", "n_valid")
