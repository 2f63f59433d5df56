"""Percentile thresholds, extreme flags, yearly counts, year densities, day-of-year thresholds."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thermocline.functions.scalar import exceed_flag, lit_array
from thermocline.model import CELL, axis_values, time_axis
from thermocline.operators.common import cell_labels
from thermocline.operators.quantile import exact_quantiles


def _qname(q: float) -> str:
    return f"q{int(round(q * 100)):02d}"


def _percentiles(value: str, qs) -> Column:
    return F.percentile(F.col(value), F.array(*[F.lit(float(q)) for q in qs]))


def point_quantiles(df: DataFrame, value: str = "anom", qs=(0.05, 0.10, 0.90, 0.95), keys=CELL,
                    nan_policy: str = "skip") -> DataFrame:
    """Linear-interpolation quantiles per cell (exact; a cell's series is bounded by the time axis).

    ``nan_policy='propagate'`` gives NULL when the series has a missing value, as ``np.quantile``
    does on arrays with NaN.
    """
    p = _percentiles(value, qs)
    if nan_policy == "propagate":
        p = F.when(F.count(F.col(value)) == F.count(F.lit(1)), p)
    elif nan_policy != "skip":
        raise ValueError(nan_policy)
    labels = cell_labels() if "lat" in df.columns else []
    out = df.groupBy(*keys).agg(*labels, p.alias("_p"))
    return out.select(*keys, *[a for a in ("lat", "lon") if labels],
                      *[F.col("_p")[i].alias(_qname(q)) for i, q in enumerate(qs)])


def extreme_flags(df: DataFrame, value: str = "anom", q: float = 0.95, keys=CELL, flag: str | None = None,
                  ndigits: int | None = None, nan_policy: str = "skip") -> DataFrame:
    """Per row ``flag = (value > quantile_q of its cell)`` as 0/1, plus ``year`` and the threshold.

    The threshold is a window aggregate over the cell, sharing the cell partitioning.
    """
    flag = flag or _qname(q)
    w = Window.partitionBy(*keys)
    thr = F.percentile(F.col(value), F.lit(float(q))).over(w)
    if nan_policy == "propagate":
        thr = F.when(F.count(F.col(value)).over(w) == F.count(F.lit(1)).over(w), thr)
    out = df.withColumn("threshold", thr)
    return out.withColumns(
        {flag: exceed_flag(F.col(value), F.col("threshold"), ndigits), "year": F.year("t").cast("int")}
    )


def _yearly_map(df: DataFrame, n_col, keys) -> DataFrame:
    """Per cell: ``m`` = map year -> count, and the first / last year (one row per cell,
    bounded by the number of years)."""
    per = df.groupBy(*keys, "year").agg(n_col.alias("n"))
    return per.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("m"),
        F.min("year").alias("y0"),
        F.max("year").alias("y1"),
    )


def extremes_per_year(flags: DataFrame, flag: str = "q95", keys=CELL, fill: bool = True) -> DataFrame:
    """Flagged rows per cell and year; with ``fill`` every year between the cell's first and
    last year appears, zero when nothing was flagged.  No join: the yearly counts of a cell
    are folded into a map and expanded over the cell's year range."""
    if not fill:
        per = flags.groupBy(*keys, "year").agg(F.sum(F.col(flag)).cast("long").alias("n_extreme"))
        return per.where(F.col("n_extreme") > 0)
    ym = _yearly_map(flags, F.sum(F.col(flag)).cast("long"), keys)
    out = ym.select(*keys, "m", F.explode(F.sequence("y0", "y1")).alias("year"))
    return out.select(*keys, "year", F.coalesce(F.try_element_at("m", F.col("year")), F.lit(0).cast("long")).alias("n_extreme"))


def flag_counts(flags: DataFrame, flag: str = "q95", keys=CELL) -> DataFrame:
    """Value counts of the flag per cell."""
    return flags.groupBy(*keys, F.col(flag).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


def year_histogram(flags: DataFrame, flag: str = "q95", keys=CELL, width: int = 1) -> DataFrame:
    """Histogram of the years of flagged rows, bins of ``width`` years from the first flagged
    year, empty bins included up to the last flagged year."""
    ym = _yearly_map(flags.where(F.col(flag) == 1), F.count(F.lit(1)), keys)
    nbins = F.floor((F.col("y1") - F.col("y0")) / width).cast("int")
    out = ym.select(*keys, "m", "y0", F.explode(F.sequence(F.lit(0), nbins)).alias("bin"))
    lo = F.col("y0") + F.col("bin") * width
    in_bin = F.filter(F.map_entries("m"), lambda e: (e["key"] >= lo) & (e["key"] < lo + width))
    n = F.aggregate(in_bin, F.lit(0).cast("long"), lambda a, e: a + e["value"])
    return out.select(*keys, lo.cast("int").alias("bin_start"), n.alias("n"))


def repeat_years(per_year: DataFrame, count: str = "n_extreme", keys=CELL) -> DataFrame:
    """One row per counted event: the year repeated ``count`` times."""
    return per_year.select(*keys, F.explode(F.array_repeat(F.col("year"), F.col(count).cast("int"))).alias("year"))


def kde_years(per_year: DataFrame, count: str = "n_extreme", keys=CELL, bw: float | str = 0.35,
              points: int = 400, scale: str = "peak") -> DataFrame:
    """Gaussian density of the event years, evaluated on ``points`` grid points.

    ``scale='peak'`` (the app's curve): from the first to the last year of the series, scaled so
    that its peak equals the largest yearly count.  ``scale='counts'`` (a histogram's overlaid
    curve): from the first to the last year *with events*, scaled to density x events x
    bin width of one year.  ``bw`` is the factor on the sample std of the repeated years (0.35
    in the app; ``'scott'`` uses ``N ** -0.2``).  Cells with fewer than two events, or all events in one year, give no rows.
    The yearly counts of a cell (one entry per year) are folded with array functions, so no
    pairs of rows are formed, and the peak is the maximum of the cell's own array.
    """
    if scale not in ("peak", "counts"):
        raise ValueError(scale)
    seen = F.col("year") if scale == "peak" else F.when(F.col(count) > 0, F.col("year"))
    per = per_year.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct(F.col("year").alias("year"), F.col(count).alias("n")))).alias("yc"),
        F.min(seen).alias("y0"), F.max(seen).alias("y1"), F.max(count).alias("nmax"),
    )
    per = per.withColumn("N", F.aggregate("yc", F.lit(0.0), lambda a, s: a + s["n"].cast("double")))
    mean = F.aggregate("yc", F.lit(0.0), lambda a, s: a + s["n"].cast("double") * s["year"].cast("double")) / F.col("N")
    per = per.withColumn("mu", mean)
    ss = F.aggregate("yc", F.lit(0.0), lambda a, s: a + s["n"].cast("double") * F.pow(s["year"].cast("double") - F.col("mu"), 2))
    per = per.withColumn("sd", F.sqrt(ss / (F.col("N") - 1)))
    factor = F.pow(F.col("N"), F.lit(-0.2)) if bw == "scott" else F.lit(float(bw))
    per = per.withColumn("h", factor * F.col("sd")).where((F.col("N") >= 2) & (F.col("h") > 0))
    step = (F.col("y1") - F.col("y0")).cast("double") / F.lit(float(points - 1))
    xs = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)),
        lambda i: F.when(i == points - 1, F.col("y1").cast("double")).otherwise(F.col("y0").cast("double") + i * step),
    )
    per = per.withColumn("xs", xs)
    norm = F.col("N") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    dens = F.transform(
        "xs",
        lambda x: F.aggregate(
            "yc", F.lit(0.0),
            lambda a, s: a + s["n"].cast("double") * F.exp(F.lit(-0.5) * F.pow((x - s["year"].cast("double")) / F.col("h"), 2)),
        ) / norm,
    )
    per = per.select(*keys, "nmax", "N", "xs", dens.alias("kdes"))
    per = per.withColumn("peak", F.array_max("kdes"))
    out = per.select(*keys, "nmax", "N", "peak", F.posexplode(F.arrays_zip("xs", "kdes")).alias("i", "z"))
    factor = F.col("nmax") / F.col("peak") if scale == "peak" else F.col("N")
    return out.select(
        *keys, "i", F.col("z.xs").alias("year_x"), F.col("z.kdes").alias("kde"),
        (F.col("z.kdes") * factor).alias("kde_scaled"),
    )


def global_quantiles(df: DataFrame, value: str = "anom", qs=(0.01, 0.99)) -> DataFrame:
    """Exact quantiles over every non-missing value (distributed rank search, see ``quantile``)."""
    spark = df.sparkSession
    vals = exact_quantiles(df, value, qs)
    names = ["p" + f"{q:.2f}".replace("0.", "0").replace(".", "") for q in qs]
    return spark.createDataFrame([tuple(float(v) if v is not None else None for v in vals)],
                                 ", ".join(f"{n} double" for n in names))


def exceed_fraction(cube: DataFrame, q: float = 0.9, value: str = "sst", axis: DataFrame | None = None) -> DataFrame:
    """Share of steps per cell and year above one quantile of the whole cube.

    Missing values are never above, and the share divides by *all* steps of the year on the
    shared time axis, missing ones and those the cell has no row for included; every cell
    has a row for every year of the axis.
    """
    axis = axis if axis is not None else time_axis(cube)
    thr = exact_quantiles(cube, value, [q])[0]
    steps = {r["year"]: r["n"] for r in axis.groupBy(F.year("t").alias("year")).agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per year
    above = F.sum(exceed_flag(F.col(value), F.lit(thr))).cast("long")
    flagged = cube.groupBy(*CELL, F.year("t").cast("int").alias("year")).agg(above.alias("n"))
    folded = flagged.where("year is not null").groupBy(*CELL).agg(F.map_from_entries(F.collect_list(F.struct("year", "n"))).alias("_m"))
    years = sorted(steps)
    if not years:
        return flagged.select(*CELL, "year", F.lit(None).cast("double").alias("fraction"))
    out = folded.select(*CELL, "_m", F.posexplode(lit_array(years)).alias("_i", "year"))
    n = F.element_at(lit_array([steps[y] for y in years]), F.col("_i") + 1)
    return out.select(*CELL, "year", (F.coalesce(F.try_element_at("_m", F.col("year")), F.lit(0)) / n).alias("fraction"))


# --- day-of-year thresholds -----------------------------------------------------------------------


def dedup_days(cube: DataFrame) -> DataFrame:
    """Keep the first row per cell, year and day of year; of rows of one time, a valid value before a
    missing one, then the smallest value."""
    order = [F.col("t"), *([F.col("sst").asc_nulls_last()] if "sst" in cube.columns else [])]
    w = Window.partitionBy(*CELL, F.year("t"), F.dayofyear("t")).orderBy(*order)
    return cube.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def doy_axis(cube: DataFrame) -> list[int]:
    """Days of year present anywhere in the cube (the axis shared by all cells; <= 366)."""
    return axis_values(cube, d=F.dayofyear("t"))["d"]


def pooled_quantiles(pos: np.ndarray, values: np.ndarray, n: int, half_window: int, q: float) -> np.ndarray:
    """For each of ``n`` circular positions the ``q`` quantile (linear interpolation) of the values within
    ``half_window`` positions, NaN without any.

    Values are sorted once by position. A position's pool is its neighbours' lists, gathered from one padded table;
    in each pool only the two wanted ranks are selected, nothing is sorted again.
    """
    order = np.lexsort((values, pos))
    pos, values = pos[order], values[order]
    size = np.bincount(pos, minlength=n)
    lists = np.full((n, max(1, int(size.max(initial=0)))), np.inf)  # a pool's padding ranks last
    lists[pos, np.arange(len(pos)) - np.repeat(np.cumsum(size) - size, size)] = values
    around = np.arange(-half_window, n + half_window) % n
    pools = np.lib.stride_tricks.sliding_window_view(lists[around], 2 * half_window + 1, axis=0).reshape(n, -1)
    in_pool = np.lib.stride_tricks.sliding_window_view(size[around], 2 * half_window + 1).sum(1)
    at = q * (in_pool - 1).astype(float)
    low, high = np.floor(at).astype(int), np.ceil(at).astype(int)
    out = np.full(n, np.nan)
    for count in np.unique(in_pool[in_pool > 0]).tolist():  # pools of one size share their ranks
        some = np.flatnonzero(in_pool == count)
        i, j = int(low[some[0]]), int(high[some[0]])
        ranked = np.partition(pools[some], (i, j) if i != j else i, axis=1)
        lo, hi = ranked[:, i], ranked[:, j]
        out[some] = lo if i == j else lo + (hi - lo) * (at[some] - i)
    return out


def doy_threshold(cube: DataFrame, q: float = 0.9, half_window: int = 5, axis: list[int] | None = None,
                  dense: bool = True, cells: DataFrame | None = None) -> DataFrame:
    """Per cell and day of year: the ``q`` quantile of all years' values within ``half_window``
    positions on the circular day-of-year axis (linear interpolation, missing values skipped).

    Plan: first rows per (cell, year, day), then one NumPy call per cell (``pooled_quantiles``); both are
    keyed by the cell, so a cube partitioned by cell is not shuffled again.

    ``dense`` returns every axis position for every cell (the threshold cube); without it only
    the positions where the cell has rows, which is all a lookup by the cube's rows needs.
    ``cells`` (``lat_idx, lon_idx, lat, lon``, one row per cell) names cells to return beside those with rows.
    """
    axis = [int(d) for d in (axis if axis is not None else doy_axis(cube))]
    n = len(axis)
    if n < half_window:
        raise ValueError(f"day-of-year axis of {n} days is shorter than the window radius")
    place = np.full(367, -1)
    place[axis] = np.arange(n)
    schema = "lat_idx int, lon_idx int, lat double, lon double, dayofyear int, thr double"
    wanted = ["lat_idx", "lon_idx", "lat", "lon", "d", "sst"]

    def thresholds(table: pa.Table) -> pa.Table:
        d = table.column("d").to_numpy(zero_copy_only=False)
        pos = place[np.where(np.isnan(d), 0, d).astype(int)] if d.dtype.kind == "f" else place[d]
        v = table.column("sst").to_numpy(zero_copy_only=False).astype(float)
        on = (pos >= 0) & ~np.isnan(v)
        thr = pooled_quantiles(pos[on], v[on], n, half_window, q)
        days = np.arange(n) if dense else np.unique(pos[pos >= 0])
        same = [pa.array([next((x for x in table.column(c).to_pylist() if x is not None), None)] * len(days), t) for c, t in (("lat_idx", pa.int32()), ("lon_idx", pa.int32()), ("lat", pa.float64()), ("lon", pa.float64()))]
        return pa.table([*same, pa.array(np.array(axis)[days], pa.int32()), pa.array(thr[days], mask=np.isnan(thr[days]))], names=[*wanted[:4], "dayofyear", "thr"])

    rows = dedup_days(cube).select(*CELL, "lat", "lon", F.dayofyear("t").cast("int").alias("d"), F.col("sst").cast("double").alias("sst"))
    if cells is not None and dense:
        none = [F.lit(None).cast("int").alias("d"), F.lit(None).cast("double").alias("sst")]
        rows = rows.unionByName(cells.select(*CELL, "lat", "lon", *none))
    return rows.select(*wanted).groupBy(*CELL).applyInArrow(thresholds, schema)


def attach_by_cell_day(cube: DataFrame, thr: DataFrame) -> DataFrame:
    """Attach ``thr`` of the row's (cell, day of year).

    Written as a union followed by a window over (cell, day): when both inputs are
    partitioned by cell, Spark needs no further shuffle (a join on (cell, day) would
    re-shuffle both sides on all three keys).  The thresholds, at most 366 a cell, are brought to the cell
    partitioning; they keep the cell labels, so that where they come from ``cube`` both branches read the
    same columns and adaptive execution reuses one cell shuffle.
    """
    a = cube.withColumns({
        "dayofyear": F.dayofyear("t").cast("int"),
        "thr": F.lit(None).cast("double"),
        "_is_thr": F.lit(False),
    })
    keep = [c for c in [*CELL, "lat", "lon", "dayofyear", "thr"] if c in thr.columns]
    b = thr.select(*keep).repartition(*CELL)
    for c in a.columns:
        if c not in b.columns:
            b = b.withColumn(c, F.lit(None).cast(a.schema[c].dataType))
    b = b.withColumn("_is_thr", F.lit(True)).select(*a.columns)
    w = Window.partitionBy(*CELL, "dayofyear")
    u = a.unionByName(b).withColumn("thr", F.max("thr").over(w))
    return u.where(~F.col("_is_thr")).drop("_is_thr")


def exceedance(cube: DataFrame, thr: DataFrame, ndigits: int | None = None) -> DataFrame:
    """``exceed = sst > threshold of its day of year`` (false where either is missing)."""
    out = attach_by_cell_day(cube, thr)
    return out.withColumn("exceed", exceed_flag(F.col("sst"), F.col("thr"), ndigits).cast("boolean"))
