"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` runs one operator on the test grid.

Output doubles are rounded to 6 places, and strict comparisons against quantiles use values
rounded to 9 places, so that results can be compared with another engine whose floating
sums differ in the last bit.  The SQL twins live in ``thermocline.plans.oracle``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.functions.scalar import round_arith
from thermocline.functions.time import decimal_year, time_parts
from thermocline.model import CELL, axis_values, by_cell, time_axis
from thermocline.functions.scalar import clip_scale
from thermocline.operators import clim, extremes, roll, runs, select, state, trend, udf
from thermocline.operators import grid as grid_ops
from thermocline.plans import pipelines
from thermocline.session import scratch_path
from thermocline.sources import cube as cube_io
from thermocline.sources import fixtures, store, tiles
from thermocline.streaming import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}

OUT_DIGITS = 6
CMP_DIGITS = 9

# Parameters of the reference's configuration used by the queries.
MIN_DATE, MAX_DATE = "1982-01-01", "2025-12-31"
TIME_STRIDE, LAT_STRIDE, LON_STRIDE = 3, 2, 2
EXTREME_QUANTILE = 0.95
P001, P099 = -2.0892258, 2.215498


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn

    return deco


def out_round(c):
    """Round to 9 places (absorbs last-bit noise of floating sums), then to 6, both in plain
    IEEE arithmetic (``round_arith``)."""
    return round_arith(round_arith(c, CMP_DIGITS), OUT_DIGITS)


def rounded(df: DataFrame) -> DataFrame:
    """Round every double column for output (float columns are left as they are)."""
    cols = [
        out_round(F.col(f.name)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.sst_daily(spark, sf_dir)


# --- sources ----------------------------------------------------------------------------------


def cube_files(spark, sf_dir) -> str:
    """The grid as Parquet files in the shared folder, written anew: what a loader reads."""
    path = scratch_path(spark, f"cube-files-{uuid.uuid4().hex[:12]}")
    fixtures.sst_daily_raw(spark, sf_dir).write.parquet(path)
    return path


@query("load_cube")
def q_load_cube(spark, sf_dir):
    """Files with labels only are read and indexed."""
    return rounded(cube_io.load_cube(spark, cube_files(spark, sf_dir)))


@query("cube_stats")
def q_cube_stats(spark, sf_dir):
    return rounded(cube_io.cube_stats(grid(spark, sf_dir)))


# --- climatologies and statistics -------------------------------------------------------------


@query("variability_map")
def q_variability_map(spark, sf_dir):
    """The app's initial map: time range, stride 3/2/2, monthly std averaged over months."""
    c = select.time_range(grid(spark, sf_dir), MIN_DATE, MAX_DATE)
    c = select.stride_subsample(c, TIME_STRIDE, LAT_STRIDE, LON_STRIDE)
    return rounded(clim.variability_map(c))


@query("variability_full")
def q_variability_full(spark, sf_dir):
    return rounded(clim.variability_map(grid(spark, sf_dir)))


@query("monthly_clim")
def q_monthly_clim(spark, sf_dir):
    return rounded(clim.monthly_climatology(grid(spark, sf_dir)))


@query("monthly_std")
def q_monthly_std(spark, sf_dir):
    return rounded(clim.monthly_std(grid(spark, sf_dir)))


@query("season_stats")
def q_season_stats(spark, sf_dir):
    return rounded(clim.season_stats(grid(spark, sf_dir)))


@query("yearly_stats")
def q_yearly_stats(spark, sf_dir):
    return rounded(clim.yearly_stats(grid(spark, sf_dir)))


@query("cell_stats")
def q_cell_stats(spark, sf_dir):
    return rounded(clim.cell_stats(grid(spark, sf_dir)))


@query("doy_clim")
def q_doy_clim(spark, sf_dir):
    return rounded(clim.doy_climatology(grid(spark, sf_dir)))


@query("anomaly")
def q_anomaly(spark, sf_dir):
    return rounded(clim.anomaly(grid(spark, sf_dir)))


@query("region_series")
def q_region_series(spark, sf_dir):
    return rounded(clim.region_series(grid(spark, sf_dir)))


@query("region_series_coslat")
def q_region_series_coslat(spark, sf_dir):
    return rounded(clim.region_series(grid(spark, sf_dir), weights="coslat"))


@query("region_quantiles")
def q_region_quantiles(spark, sf_dir):
    return rounded(clim.region_quantiles(clim.region_series(grid(spark, sf_dir))))


# --- selection ----------------------------------------------------------------------------------


@query("region_labels")
def q_region_labels(spark, sf_dir):
    return rounded(select.region_labels(grid(spark, sf_dir), 25.5, 40.5, 10.5, 30.5))


@query("region_index")
def q_region_index(spark, sf_dir):
    return rounded(select.region_index(grid(spark, sf_dir), (40.5, 25.5), (10.5, 30.5)))


@query("time_range")
def q_time_range(spark, sf_dir):
    return rounded(select.time_range(grid(spark, sf_dir), "1996-03-01", "1998-12-31"))


@query("year_slice")
def q_year_slice(spark, sf_dir):
    return rounded(select.year_slice(grid(spark, sf_dir), 1997))


@query("stride_subsample")
def q_stride_subsample(spark, sf_dir):
    return rounded(select.stride_subsample(grid(spark, sf_dir), TIME_STRIDE, LAT_STRIDE, LON_STRIDE))


@query("last_frame")
def q_last_frame(spark, sf_dir):
    return rounded(select.frame_at(grid(spark, sf_dir), -1))


@query("nearest_point")
def q_nearest_point(spark, sf_dir):
    return rounded(select.nearest_point(grid(spark, sf_dir), fixtures.points(spark, sf_dir)))


@query("point_series")
def q_point_series(spark, sf_dir):
    """Anomaly series of the cells nearest to each point, with year and decimal year."""
    c = grid(spark, sf_dir)
    near = select.nearest_point(c, fixtures.points(spark, sf_dir))
    s = clim.anomaly(select.point_series(c, near))
    return rounded(
        s.select(
            "point_id", "t", *CELL,
            F.col("anom").alias("anomalies"),
            F.year("t").cast("int").alias("year"),
            decimal_year("t").alias("continuous_time"),
        )
    )


@query("land_mask")
def q_land_mask(spark, sf_dir):
    return rounded(select.land_mask(grid(spark, sf_dir)))


@query("mask_apply")
def q_mask_apply(spark, sf_dir):
    c = grid(spark, sf_dir)
    per_year = c.groupBy(*CELL, F.year("t").cast("int").alias("year")).agg(F.count(F.lit(1)).alias("n_steps"))
    return rounded(select.mask_apply(per_year, select.land_mask(c), ["n_steps"]))


@query("mask_reference")
def q_mask_reference(spark, sf_dir):
    c = grid(spark, sf_dir)
    return rounded(select.mask_reference(c, c, mode="index_negate"))


@query("mask_reference_coord")
def q_mask_reference_coord(spark, sf_dir):
    c = grid(spark, sf_dir)
    return rounded(select.mask_reference(c, c, mode="coord"))


@query("drop_missing")
def q_drop_missing(spark, sf_dir):
    return rounded(select.drop_missing(grid(spark, sf_dir)))


@query("exclude_years")
def q_exclude_years(spark, sf_dir):
    return rounded(select.exclude_years(grid(spark, sf_dir), [1995, 2001]))


@query("section_lat")
def q_section_lat(spark, sf_dir):
    return rounded(select.section_lat(grid(spark, sf_dir), 2, [1996, 2000]))


# --- scalar functions ------------------------------------------------------------------------------


@query("time_parts")
def q_time_parts(spark, sf_dir):
    return rounded(time_parts(grid(spark, sf_dir)))


@query("decimal_year")
def q_decimal_year(spark, sf_dir):
    return rounded(grid(spark, sf_dir).select("t", *CELL, decimal_year("t").alias("decimal_year")))


# --- trend, rolling, resampling ---------------------------------------------------------------------

# Oracle parameters for the heatwave keys (the test grid has no season, see FIXTURES).
MHW_Q, MHW_MIN_DAYS = 0.75, 3
ROLL_ROWS = 51  # 3 * int(52 / 3)


def anom9(spark, sf_dir) -> DataFrame:
    """Monthly anomalies rounded to 9 places (the comparison convention), on the grid
    partitioned by cell once so every later per-cell step reuses that shuffle."""
    return clim.anomaly(by_cell(grid(spark, sf_dir)), ndigits=CMP_DIGITS)


@query("trend_map")
def q_trend_map(spark, sf_dir):
    return rounded(trend.trend_map(anom9(spark, sf_dir)))


@query("trend_fit")
def q_trend_fit(spark, sf_dir):
    out = trend.trend_fit(anom9(spark, sf_dir))
    return rounded(out.select("t", *CELL, "anom", "continuous_time", "pred_ols"))


@query("rolling_mean")
def q_rolling_mean(spark, sf_dir):
    out = roll.rolling_mean(anom9(spark, sf_dir), "anom", ROLL_ROWS, axis=time_axis(grid(spark, sf_dir)))
    return rounded(out.select("t", *CELL, "anom", "rolled"))


@query("resample_sme")
def q_resample_sme(spark, sf_dir):
    return rounded(roll.resample_sme(grid(spark, sf_dir), "sst"))


@query("rolling_sme")
def q_rolling_sme(spark, sf_dir):
    return rounded(roll.rolling_sme(anom9(spark, sf_dir), "anom", years=3, per_year=24))


# --- extremes ---------------------------------------------------------------------------------------------


def flags95(spark, sf_dir) -> DataFrame:
    return extremes.extreme_flags(anom9(spark, sf_dir), "anom", EXTREME_QUANTILE, ndigits=CMP_DIGITS)


@query("point_quantiles")
def q_point_quantiles(spark, sf_dir):
    return rounded(extremes.point_quantiles(anom9(spark, sf_dir), "anom"))


@query("point_extremes")
def q_point_extremes(spark, sf_dir):
    return rounded(flags95(spark, sf_dir).select("t", *CELL, "anom", "year", "threshold", "q95"))


@query("extreme_rows")
def q_extreme_rows(spark, sf_dir):
    f = flags95(spark, sf_dir).select("t", *CELL, "anom", "year", "threshold", "q95")
    return rounded(select.extreme_rows(f, "q95"))


@query("extremes_per_year")
def q_extremes_per_year(spark, sf_dir):
    return rounded(extremes.extremes_per_year(flags95(spark, sf_dir), "q95"))


@query("flag_counts")
def q_flag_counts(spark, sf_dir):
    return extremes.flag_counts(flags95(spark, sf_dir), "q95")


@query("year_histogram")
def q_year_histogram(spark, sf_dir):
    return extremes.year_histogram(flags95(spark, sf_dir), "q95")


@query("repeat_years")
def q_repeat_years(spark, sf_dir):
    return extremes.repeat_years(extremes.extremes_per_year(flags95(spark, sf_dir), "q95"))


@query("kde_years")
def q_kde_years(spark, sf_dir):
    return rounded(extremes.kde_years(extremes.extremes_per_year(flags95(spark, sf_dir), "q95")))


@query("kde_scott")
def q_kde_scott(spark, sf_dir):
    return rounded(extremes.kde_years(extremes.extremes_per_year(flags95(spark, sf_dir), "q95"), bw="scott", points=200, scale="counts"))


@query("global_quantiles")
def q_global_quantiles(spark, sf_dir):
    return rounded(extremes.global_quantiles(anom9(spark, sf_dir), "anom", (0.01, 0.99)))


@query("exceed_fraction")
def q_exceed_fraction(spark, sf_dir):
    return rounded(extremes.exceed_fraction(grid(spark, sf_dir), 0.9))


@query("clip_scale")
def q_clip_scale(spark, sf_dir):
    a = anom9(spark, sf_dir)
    return rounded(a.select("t", *CELL, "anom", clip_scale(F.col("anom"), P001, P099).alias("clipped"),
                            clip_scale(F.col("anom"), P001, P099, scale=True).alias("scaled")))


# --- heatwaves ---------------------------------------------------------------------------------------------


def mhw_parts(spark, sf_dir):
    g = grid(spark, sf_dir)
    axis = time_axis(g)  # metadata pass before the cell shuffle
    doys = axis_values(axis, d=F.dayofyear("t"))["d"]
    c = by_cell(g)
    thr = extremes.doy_threshold(c, MHW_Q, axis=doys, dense=False)  # looked up by the cube's own rows
    ex = extremes.exceedance(c, thr, ndigits=CMP_DIGITS)
    mask = runs.mark_runs(ex, "exceed", MHW_MIN_DAYS, out="mhw", axis=axis)
    return axis, ex, mask


@query("doy_threshold")
def q_doy_threshold(spark, sf_dir):
    g = grid(spark, sf_dir)
    doys = extremes.doy_axis(g)  # metadata pass before the cell shuffle
    return rounded(extremes.doy_threshold(by_cell(g), MHW_Q, axis=doys).drop("lat", "lon"))


@query("exceedance")
def q_exceedance(spark, sf_dir):
    _, ex, _ = mhw_parts(spark, sf_dir)
    return rounded(ex.select("t", *CELL, "sst", "dayofyear", "thr", "exceed"))


@query("mhw_mask")
def q_mhw_mask(spark, sf_dir):
    _, _, mask = mhw_parts(spark, sf_dir)
    return rounded(mask.select("t", *CELL, "sst", "thr", "exceed", "mhw"))


@query("apply_along_time")
def q_apply_along_time(spark, sf_dir):
    axis, ex, _ = mhw_parts(spark, sf_dir)
    ex = ex.select("t", *CELL, "sst", "thr", "exceed")
    return rounded(udf.mark_runs_along_time(ex, "exceed", MHW_MIN_DAYS, out="mhw", axis=axis))


@query("mhw_days")
def q_mhw_days(spark, sf_dir):
    axis, _, mask = mhw_parts(spark, sf_dir)
    return runs.null_on_land(runs.days_per_year(mask, "mhw", axis=axis), ["days"])


@query("mhw_events")
def q_mhw_events(spark, sf_dir):
    axis, _, mask = mhw_parts(spark, sf_dir)
    return runs.null_on_land(runs.events_per_year(mask, "mhw", MHW_MIN_DAYS, axis=axis), ["events"])


@query("mhw_pipeline")
def q_mhw_pipeline(spark, sf_dir):
    """Heatwave days per year, masked on land, block-averaged 2 x 2 with the ragged end trimmed."""
    out = pipelines.mhw_pipeline(grid(spark, sf_dir), MHW_Q, MHW_MIN_DAYS, pre_block=None, events_block=None,
                                 ndigits=CMP_DIGITS)
    return rounded(out["days_ds"])


@query("mhw_reference")
def q_mhw_reference(spark, sf_dir):
    """Q4 at the reference's parameters (2 x 2 blocks first, quantile 0.9, five days) on the grid with
    warm spells; days and events of one aggregate, written as a store and read back."""
    out = pipelines.mhw_pipeline(fixtures.sst_spells(spark, sf_dir), days_block=None, events_block=None, ndigits=CMP_DIGITS)
    path = scratch_path(spark, f"mhw-{uuid.uuid4().hex[:12]}")
    store.write_store(out["yearly"], path, partition_by=("year",))
    back = store.read_store(spark, path)
    return back.select(*CELL, F.col("year").cast("int").alias("year"), "days", "events")


@query("dedup_days")
def q_dedup_days(spark, sf_dir):
    return rounded(extremes.dedup_days(grid(spark, sf_dir)))


# --- grid reshaping ----------------------------------------------------------------------------------------


@query("coarsen_exact")
def q_coarsen_exact(spark, sf_dir):
    return rounded(grid_ops.coarsen(grid(spark, sf_dir), 2, 2, boundary="exact"))


@query("coarsen_trim")
def q_coarsen_trim(spark, sf_dir):
    return rounded(grid_ops.coarsen(grid(spark, sf_dir), 4, 4, boundary="trim"))


@query("unstack_year")
def q_unstack_year(spark, sf_dir):
    return rounded(grid_ops.unstack_year(grid(spark, sf_dir)))


@query("frames")
def q_frames(spark, sf_dir):
    """Every second anomaly frame, clipped to the global 1% / 99% quantiles, one row per cell of a frame."""
    return rounded(grid_ops.frame_cells(pipelines.frame_export(grid(spark, sf_dir), every=2, ndigits=CMP_DIGITS)))


# --- sources and sinks -------------------------------------------------------------------------------------


@query("concat_time")
def q_concat_time(spark, sf_dir):
    """Three sets of files, of which two overlap, are loaded and appended along time."""
    c = grid(spark, sf_dir)
    cuts = [F.col("t") < "1997-06-01", F.col("t").between("1997-01-01", "1998-12-31"), (F.col("t") > "1998-12-31") | F.col("t").isNull()]
    paths = [scratch_path(spark, f"cube-part-{uuid.uuid4().hex[:12]}") for _ in cuts]
    for cut, path in zip(cuts, paths):
        c.where(cut).write.parquet(path)
    return rounded(cube_io.concat_time([cube_io.load_cube(spark, p) for p in paths]))


@query("store_partitioned")
def q_store_partitioned(spark, sf_dir):
    """The cube written as a year-partitioned store and read back."""
    path = scratch_path(spark, f"store-{uuid.uuid4().hex[:12]}")
    store.write_store(grid(spark, sf_dir), path)
    return rounded(store.read_store(spark, path).withColumn("year", F.col("year").cast("int")))


@query("store_bucketed")
def q_store_bucketed(spark, sf_dir):
    """The cube saved as a table bucketed by cell; climatologies of all cells read it without a shuffle."""
    name = f"cube_bucketed_{uuid.uuid4().hex[:12]}"
    store.write_bucketed(grid(spark, sf_dir), name, 8, path=scratch_path(spark, name))
    return rounded(clim.cell_stats(spark.table(name)))


@query("tile_store")
def q_tile_store(spark, sf_dir):
    """The cube written as a chunked store of 48 x 180 x 180 tiles and read back."""
    path = scratch_path(spark, f"tiles-{uuid.uuid4().hex[:12]}")
    tiles.write_tiles(grid(spark, sf_dir), path)
    return rounded(tiles.read_tiles(spark, path))


@query("tile_box")
def q_tile_box(spark, sf_dir):
    """Warm rows of a box of positions, read from small tiles that the box and the bound choose."""
    path = scratch_path(spark, f"tiles-{uuid.uuid4().hex[:12]}")
    tiles.write_tiles(grid(spark, sf_dir), path, (30, 2, 3))
    return rounded(tiles.read_tiles(spark, path, time=(100, 1500), lat=(1, 4), lon=(2, 3), above=15.0))


#: Fixed value: where the incremental queries cut the grid's period into files.
FILE_CUTS = ["1997-06-10", "1999-11-20"]


def file_parts(spark, sf_dir) -> list[DataFrame]:
    c = grid(spark, sf_dir)
    cuts = [F.lit(x).cast("date") for x in FILE_CUTS]
    return [c.where(F.col("t") < cuts[0]), c.where((F.col("t") >= cuts[0]) & (F.col("t") < cuts[1])), c.where(F.col("t") >= cuts[1])]


def state_store(spark, sf_dir) -> DataFrame:
    """States of three files, the second of which comes twice, compacted before the third."""
    first, base = (scratch_path(spark, f"states-{uuid.uuid4().hex[:12]}") for _ in range(2))
    parts = file_parts(spark, sf_dir)
    for n in (0, 1, 1):
        state.append_states(parts[n], first, f"file {n}")
    state.compact_states(spark, first, base)
    state.append_states(parts[2], base, "file 2")
    return state.read_states(spark, base)


@query("monthly_incremental")
def q_monthly_incremental(spark, sf_dir):
    """Monthly means and deviations from the stored states of several files."""
    return rounded(state.monthly_climatology(state_store(spark, sf_dir)))


@query("variability_incremental")
def q_variability_incremental(spark, sf_dir):
    return rounded(state.variability_map(state_store(spark, sf_dir)))


@query("ingest_upsert")
def q_ingest_upsert(spark, sf_dir):
    """Files that overlap and repeat, ingested batch by batch: one row per step and cell."""
    path = scratch_path(spark, f"ingest-{uuid.uuid4().hex[:12]}")
    parts = file_parts(spark, sf_dir)
    for n, batch in enumerate([parts[0], parts[1].unionByName(parts[0].where("month(t) = 5")), parts[1], parts[2]]):
        ingest.upsert(batch, n, path)
    return rounded(ingest.read_ingested(spark, path))


@query("sort_time")
def q_sort_time(spark, sf_dir):
    return rounded(cube_io.sort_time(grid(spark, sf_dir)))


@query("decode_time")
def q_decode_time(spark, sf_dir):
    """Encode the dates as CF numbers (days since 1800-01-01), then decode them."""
    c = grid(spark, sf_dir).select("t", *CELL, F.datediff("t", F.lit("1800-01-01").cast("date")).cast("double").alias("days"))
    return rounded(cube_io.decode_cf_time(c, "days", "days since 1800-01-01", out="t_decoded"))


@query("decode_time_fraction")
def q_decode_time_fraction(spark, sf_dir):
    """Hours with fractions since the year 1: numbers that leave a double few bits for the fraction."""
    days = F.datediff("t", F.lit("0001-01-01").cast("date")).cast("double")
    c = grid(spark, sf_dir).select("t", *CELL, (days * 24 + (F.col("lat_idx") * 4 + F.col("lon_idx")).cast("double") / 10).alias("hours"))
    return rounded(cube_io.decode_cf_time(c, "hours", "hours since 1-1-1 00:00:0.0", out="t_decoded"))


@query("decode_values")
def q_decode_values(spark, sf_dir):
    """Pack the values as int16 hundredths with a fill value, then decode them."""
    c = grid(spark, sf_dir)
    raw = F.when(F.col("sst").isNull(), F.lit(-32767)).otherwise(F.floor(F.col("sst") * F.lit(100.0) + F.lit(0.5))).cast("short")
    c = c.select("t", *CELL, raw.alias("raw"))
    return rounded(c.withColumn("sst", cube_io.decode_values(F.col("raw"), scale=0.01, offset=0.0, fill=-32767)))


@query("map_float32")
def q_map_float32(spark, sf_dir):
    m = q_variability_map(spark, sf_dir)
    return store.as_float32(m, ["variability"])


@query("materialize")
def q_materialize(spark, sf_dir):
    """Q1 through the cache-aside store in the shared checkpoint folder (float32 map)."""
    return store.materialize(spark, scratch_path(spark, "variability_map"), lambda: q_variability_map(spark, sf_dir),
                             float_cols=["variability"], params=[TIME_STRIDE, LAT_STRIDE, LON_STRIDE])


# --- reports -------------------------------------------------------------------------------------------------


@query("cell_reports")
def q_cell_reports(spark, sf_dir):
    return rounded(pipelines.cell_reports(grid(spark, sf_dir), EXTREME_QUANTILE, ndigits=CMP_DIGITS))


@query("point_report")
def q_point_report(spark, sf_dir):
    return rounded(pipelines.point_report(grid(spark, sf_dir), fixtures.points(spark, sf_dir), EXTREME_QUANTILE, ndigits=CMP_DIGITS))


@query("point_report_series")
def q_point_report_series(spark, sf_dir):
    """Q2 per step: anomaly, rolling mean and fitted line of the cell nearest to each point."""
    g = grid(spark, sf_dir)
    an = pipelines.point_anomalies(g, fixtures.points(spark, sf_dir), ndigits=CMP_DIGITS)
    return rounded(pipelines.series_report(an, ROLL_ROWS, keys=["point_id", *CELL], axis=time_axis(g)))


@query("point_report_years")
def q_point_report_years(spark, sf_dir):
    """Q2 per year: zero-filled counts of extremes."""
    an = pipelines.point_anomalies(grid(spark, sf_dir), fixtures.points(spark, sf_dir), ndigits=CMP_DIGITS)
    return pipelines.yearly_report(an, EXTREME_QUANTILE, ["point_id", *CELL], CMP_DIGITS)


@query("point_report_density")
def q_point_report_density(spark, sf_dir):
    """Q2 density curve over the years of the extremes."""
    an = pipelines.point_anomalies(grid(spark, sf_dir), fixtures.points(spark, sf_dir), ndigits=CMP_DIGITS)
    return rounded(pipelines.density_report(an, EXTREME_QUANTILE, ["point_id", *CELL], CMP_DIGITS))


@query("cell_report_series")
def q_cell_report_series(spark, sf_dir):
    """Q3 per step, for all cells."""
    return rounded(pipelines.series_report(anom9(spark, sf_dir), ROLL_ROWS, axis=time_axis(grid(spark, sf_dir))))


@query("cell_report_density")
def q_cell_report_density(spark, sf_dir):
    """Q3 density curves, for all cells."""
    return rounded(pipelines.density_report(anom9(spark, sf_dir), EXTREME_QUANTILE, CELL, CMP_DIGITS))


@query("point_quantiles_propagate")
def q_point_quantiles_propagate(spark, sf_dir):
    """Quantiles per cell that a missing value makes missing, as NumPy's do."""
    return rounded(extremes.point_quantiles(anom9(spark, sf_dir), "anom", nan_policy="propagate"))


BOUNDS = {"lat_min": 20.5, "lat_max": 40.5, "lon_min": 0.5, "lon_max": 20.5}


def region9(spark, sf_dir) -> DataFrame:
    return pipelines.masked_region(grid(spark, sf_dir), fixtures.reference_grid(spark, sf_dir), BOUNDS, "coord", CMP_DIGITS)


@query("regional_study")
def q_regional_study(spark, sf_dir):
    return pipelines.regional_study(grid(spark, sf_dir), fixtures.reference_grid(spark, sf_dir), BOUNDS, fixtures.points(spark, sf_dir),
                                    EXTREME_QUANTILE, exclude=[2001], mask_mode="coord", ndigits=CMP_DIGITS)


@query("regional_maps")
def q_regional_maps(spark, sf_dir):
    """Q5 maps: variability and trend of the masked region."""
    return rounded(pipelines.regional_maps(region9(spark, sf_dir)))


@query("regional_series")
def q_regional_series(spark, sf_dir):
    """Q5 per step and cell of the masked region: anomaly, rolling mean, fitted line."""
    return rounded(pipelines.series_report(region9(spark, sf_dir), ROLL_ROWS, axis=time_axis(grid(spark, sf_dir))))


@query("region_yearly")
def q_region_yearly(spark, sf_dir):
    """Yearly mean of the region series with the first and last year."""
    y = clim.region_yearly(clim.region_series(grid(spark, sf_dir)))
    span = y.agg(F.min("year").alias("first_year"), F.max("year").alias("last_year")).first()
    return rounded(y.withColumns({"first_year": F.lit(span[0]), "last_year": F.lit(span[1])}))


@query("mhw_events_ds")
def q_mhw_events_ds(spark, sf_dir):
    """Heatwave events per year, masked on land, block-averaged 4 x 4 with the ragged end trimmed."""
    out = pipelines.mhw_pipeline(grid(spark, sf_dir), MHW_Q, MHW_MIN_DAYS, pre_block=None, days_block=None,
                                 ndigits=CMP_DIGITS)
    return rounded(out["events_ds"])


# --- weekly grid (the reference's main input is weekly) -------------------------------------------


@query("rolling_mean_long")
def q_rolling_mean_long(spark, sf_dir):
    """The region's daily mean series and its centered mean over 1,095 steps (about three years)."""
    series = clim.region_series(grid(spark, sf_dir))
    out = roll.rolling_mean(series.withColumn("region", F.lit(0)), "region_mean", 1095, keys=["region"], axis=time_axis(series))
    return rounded(out.select("t", "region_mean", "rolled"))


@query("rolling_mean_weekly")
def q_rolling_mean_weekly(spark, sf_dir):
    """Weekly anomalies and their centered 51-row (about one year) complete-window mean."""
    w = fixtures.sst_weekly(spark, sf_dir)
    a = clim.anomaly(by_cell(w), ndigits=CMP_DIGITS)
    return rounded(roll.rolling_mean(a, "anom", ROLL_ROWS, axis=time_axis(w)).select("t", *CELL, "anom", "rolled"))


@query("cell_reports_weekly")
def q_cell_reports_weekly(spark, sf_dir):
    return rounded(pipelines.cell_reports(fixtures.sst_weekly(spark, sf_dir), EXTREME_QUANTILE, ndigits=CMP_DIGITS))


# --- a grid whose cells grow with the table -----------------------------------------------------


@query("wide_variability")
def q_wide_variability(spark, sf_dir):
    """The variability map of a grid of up to 180 x 360 cells, filled as the table grows."""
    return rounded(clim.variability_map(fixtures.sst_wide(spark, sf_dir)))


@query("wide_reports")
def q_wide_reports(spark, sf_dir):
    """The cell reports of the wide grid."""
    return rounded(pipelines.cell_reports(fixtures.sst_wide(spark, sf_dir), EXTREME_QUANTILE, ndigits=CMP_DIGITS))
