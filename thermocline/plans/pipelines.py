"""End-to-end pipelines composed from the operators.

Series pipelines start with one hash repartition on the integer cell key: every later
window or aggregate keyed by (cell, ...) reuses it, so the whole pipeline shuffles the
cube once (plus small partial aggregates).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.scalar import maybe_round
from thermocline.functions.time import decimal_year
from thermocline.model import CELL, axis_frame, by_cell, cube_axes, with_time_index
from thermocline.operators import clim, extremes, grid, roll, runs, select
from thermocline.operators.common import cell_labels
from thermocline.sources.store import materialize, read_store, write_store


# Q1 ---------------------------------------------------------------------------------------------


def variability_map_pipeline(cube: DataFrame, start: str, end: str, strides=(3, 2, 2)) -> DataFrame:
    """Time range, strided subsample, monthly std averaged over months."""
    c = select.time_range(cube, start, end)
    c = select.stride_subsample(c, *strides)
    return clim.variability_map(c)


def cached_variability_map(cube: DataFrame, path: str, start: str, end: str, strides=(3, 2, 2)) -> DataFrame:
    """Q1 with the cache-aside store: read the map at ``path`` if complete, else build and write it (float32)."""
    spark = cube.sparkSession
    return materialize(
        spark, path, lambda: variability_map_pipeline(cube, start, end, strides),
        float_cols=["variability"], params=[start, end, *strides],
    )


# Q2 / Q3 ------------------------------------------------------------------------------------------


def cell_reports(cube: DataFrame, q: float = 0.95, keys=CELL, ndigits: int | None = None) -> DataFrame:
    """Per cell: trend per decade of the anomaly, the ``q`` threshold, counts of extreme steps.

    The point report of the app, for every cell at once.
    """
    c = by_cell(cube) if list(keys) == CELL else cube.repartition(*keys)
    an = clim.anomaly(c, ndigits=ndigits) if list(keys) == CELL else _anomaly_by(c, keys, ndigits)
    fl = extremes.extreme_flags(an, "anom", q, keys=keys, flag="flag", ndigits=ndigits)
    x = decimal_year("t")
    out = fl.groupBy(*keys).agg(
        *cell_labels(),
        (F.regr_slope("anom", x) * F.lit(10.0)).alias("trend_decade"),
        F.max("threshold").alias("threshold"),
        F.count("anom").alias("n_valid"),
        F.sum("flag").cast("long").alias("n_extreme"),
        F.min("year").alias("first_year"),
        F.max("year").alias("last_year"),
    )
    return out.withColumn("trend_r3", F.bround("trend_decade", 3))


def _anomaly_by(c: DataFrame, keys, ndigits):
    w = Window.partitionBy(*keys, "month")
    out = c.withColumn("month", F.month("t").cast("int"))
    return out.withColumn("anom", maybe_round(F.col("sst") - F.avg("sst").over(w), ndigits))


def point_anomalies(cube: DataFrame, points: DataFrame, ndigits: int | None = None) -> DataFrame:
    """Anomaly series of the cell nearest to each point, one copy per point."""
    near = select.nearest_point(cube, points)
    keys = ["point_id", *CELL]
    return _anomaly_by(select.point_series(cube, near).repartition(*keys), keys, ndigits)


def point_report(cube: DataFrame, points: DataFrame, q: float = 0.95, ndigits: int | None = None) -> DataFrame:
    """Q2: nearest cell per point, then the cell report of its series."""
    near = select.nearest_point(cube, points)
    series = select.point_series(cube, near)
    return cell_reports(series, q, keys=["point_id", *CELL], ndigits=ndigits)


def series_report(an: DataFrame, window: int, keys=CELL, axis: DataFrame | None = None) -> DataFrame:
    """Per step: the anomaly, its rolling mean over ``window`` steps of the axis, and the fitted line."""
    x = decimal_year("t")
    w = Window.partitionBy(*keys)
    fit = F.regr_intercept("anom", "continuous_time").over(w) + F.regr_slope("anom", "continuous_time").over(w) * F.col("continuous_time")
    out = roll.rolling_mean(an.withColumn("continuous_time", x), "anom", window, keys=keys, axis=axis)
    return out.select("t", *keys, "anom", "continuous_time", "rolled", fit.alias("pred_ols"))


def yearly_report(an: DataFrame, q: float = 0.95, keys=CELL, ndigits: int | None = None) -> DataFrame:
    """Per year: steps above the series' ``q`` quantile, zero-filled between its first and last year."""
    fl = extremes.extreme_flags(an, "anom", q, keys=keys, flag="flag", ndigits=ndigits)
    return extremes.extremes_per_year(fl, "flag", keys=keys)


def density_report(an: DataFrame, q: float = 0.95, keys=CELL, ndigits: int | None = None) -> DataFrame:
    """The app's density curve over the years of the extremes, per series."""
    return extremes.kde_years(yearly_report(an, q, keys, ndigits), keys=keys)


# Q4 -----------------------------------------------------------------------------------------------


def mhw_pipeline(cube: DataFrame, q: float = 0.9, min_days: int = 5, half_window: int = 5,
                 pre_block: tuple[int, int] | None = (2, 2), days_block=(2, 2), events_block=(4, 4),
                 ndigits: int | None = None, axes: dict | None = None) -> dict[str, DataFrame]:
    """Marine heatwaves: day-of-year threshold, exceedance, runs of ``min_days``, days and events
    per year (NULL on land), and their block-averaged maps.

    ``axes`` are the cube's ``cube_axes(..., time=True)`` (one pass over it if absent); those of
    the blocks follow from them.  Days and events come from one aggregate of the mask.
    """
    spark = cube.sparkSession
    axes = axes if axes is not None else cube_axes(cube, time=True)
    lats, lons = axes["lat"], axes["lon"]
    c0 = cube
    if pre_block:
        c0 = grid.coarsen(cube, *pre_block, boundary="exact", axes=(lats, lons))
        lats, lons = grid.block_axis(lats, pre_block[0]), grid.block_axis(lons, pre_block[1])
    ttype = cube.schema["t"].dataType.simpleString()
    steps = axis_frame(spark, list(enumerate(axes["time"])), "time_idx", "t", ttype).select("t", "time_idx")
    c = by_cell(c0)
    thr = extremes.doy_threshold(c, q, half_window, axis=sorted({t.timetuple().tm_yday for t in axes["time"]}), dense=False)
    ex = extremes.exceedance(c, thr, ndigits=ndigits)
    mask = runs.mark_runs(with_time_index(ex, steps), "exceed", min_days, out="mhw")
    yearly = runs.null_on_land(runs.yearly_runs(mask, "mhw", min_days, axis=steps), ["days", "events"])
    out = {"threshold": thr, "mask": mask.drop("time_idx"), "yearly": yearly, "days": yearly.drop("events"), "events": yearly.drop("days")}
    out |= {"lat": axis_frame(spark, lats, "lat_idx", "lat"), "lon": axis_frame(spark, lons, "lon_idx", "lon")}  # of the yearly table
    return out | block_maps(yearly, (lats, lons), days_block, events_block)


def block_maps(yearly: DataFrame, axes, days_block=(2, 2), events_block=(4, 4)) -> dict[str, DataFrame]:
    """Block means of the yearly table: ``days_ds`` and ``events_ds``."""
    blocks = {"days": days_block, "events": events_block}
    return {f"{n}_ds": grid.coarsen(yearly, *k, value=n, time="year", boundary="trim", axes=axes) for n, k in blocks.items() if k}


def store_mhw(out: dict[str, DataFrame], base: str, days_block=(2, 2), events_block=(4, 4)) -> None:
    """Write the yearly table and its block-averaged maps as year-partitioned stores (overwrite).

    The maps are made from the stored yearly table: the cube's chain runs once.
    """
    root = base.rstrip("/")
    write_store(out["yearly"], f"{root}/yearly", partition_by=("year",))
    yearly = read_store(out["yearly"].sparkSession, f"{root}/yearly")
    axes = [[(r[0], r[1]) for r in out[n].collect()] for n in ("lat", "lon")]  # local tables
    for name, table in block_maps(yearly, axes, days_block, events_block).items():
        write_store(table, f"{root}/{name}", partition_by=("year",))


# Q5 -----------------------------------------------------------------------------------------------


def masked_region(cube: DataFrame, ref: DataFrame, bounds: dict, mask_mode: str = "coord", ndigits: int | None = None) -> DataFrame:
    """Masked by a reference data set, cut to a box, monthly anomalies: what every part of the study starts from."""
    c = select.mask_reference(cube, ref, mode=mask_mode)
    c = select.region_labels(c, bounds["lat_min"], bounds["lat_max"], bounds["lon_min"], bounds["lon_max"])
    return clim.anomaly(by_cell(c), ndigits=ndigits)


def regional_study(cube: DataFrame, ref: DataFrame, bounds: dict, points: DataFrame, q: float = 0.95,
                   exclude=(), mask_mode: str = "coord", ndigits: int | None = None) -> DataFrame:
    """Mask by a reference, cut a box, monthly anomalies, the point's extremes (threshold over
    all years, then incomplete years dropped), value counts of the flag."""
    an = masked_region(cube, ref, bounds, mask_mode, ndigits)
    box = select.region_labels(cube, bounds["lat_min"], bounds["lat_max"], bounds["lon_min"], bounds["lon_max"])
    near = select.nearest_point(box, points)
    s = select.point_series(an, near)
    fl = extremes.extreme_flags(s, "anom", q, keys=["point_id", *CELL], flag="flag", ndigits=ndigits)
    fl = select.exclude_years(fl, exclude, col="year")
    return fl.groupBy("point_id", "flag").agg(F.count(F.lit(1)).alias("n"))


def regional_maps(an: DataFrame) -> DataFrame:
    """Per cell of ``masked_region``: variability (monthly std averaged over months) and trend per decade."""
    monthly = an.groupBy(*CELL, "month").agg(*cell_labels(), F.stddev_pop("sst").alias("sd"), F.count("anom").alias("n"))
    slope = an.groupBy(*CELL).agg((F.regr_slope("anom", decimal_year("t")) * 10.0).alias("trend_decade"))
    out = monthly.groupBy(*CELL).agg(*cell_labels(), F.avg("sd").alias("variability"), F.sum("n").alias("n_valid"))
    return out.join(slope, CELL)


# Q7 -----------------------------------------------------------------------------------------------


def frame_export(cube: DataFrame, every: int = 2, qs=(0.01, 0.99), ndigits: int | None = None) -> DataFrame:
    """Anomaly frames every ``every`` steps, clipped to the global 1% / 99% quantiles."""
    an = clim.anomaly(cube, ndigits=ndigits)
    lim = extremes.global_quantiles(an.where(F.col("anom").isNotNull()), "anom", qs).first()
    return grid.frames(an, "anom", every=every, lo=lim[0], hi=lim[1], axes=cube_axes(cube, time=True))
