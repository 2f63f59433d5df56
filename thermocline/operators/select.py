"""Selection: regions, periods, strides, positions, nearest points, masks."""

from __future__ import annotations

import datetime as _dt

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.model import CELL, axis_frame, index_axes, small_or_plain, time_axis, with_time_index
from thermocline.operators.common import attach_scalars, cell_labels, scalar


def _date(x) -> _dt.date:
    return x if isinstance(x, _dt.date) else _dt.date.fromisoformat(str(x)[:10])


# --- regions -----------------------------------------------------------------------------


def region_labels(cube: DataFrame, lat_min: float, lat_max: float, lon_min: float, lon_max: float) -> DataFrame:
    """Inclusive box on the labels, independent of axis order (pushed to the Parquet scan)."""
    return cube.where(
        F.col("lat").between(float(lat_min), float(lat_max)) & F.col("lon").between(float(lon_min), float(lon_max))
    )


def _edge_positions(pairs, edges, label: str) -> tuple[int, int]:
    """Positions of two exact edge labels on an axis (fails when one is absent)."""
    found = {v: i for i, v in pairs}
    a, b = float(edges[0]), float(edges[1])
    missing = [e for e in (a, b) if e not in found]
    if missing:
        raise KeyError(f"edge label(s) {missing} not on the {label} axis")
    return min(found[a], found[b]), max(found[a], found[b])


def region_index(cube: DataFrame, lat_edges, lon_edges, axes=None) -> DataFrame:
    """Box by axis position: the indices of exact edge labels, both ends inclusive.

    ``axes`` are the ``(idx, label)`` pairs of both dimensions (derived in one pass if absent).
    """
    lat_pairs, lon_pairs = axes if axes is not None else index_axes(cube)
    i0, i1 = _edge_positions(lat_pairs, lat_edges, "lat")
    j0, j1 = _edge_positions(lon_pairs, lon_edges, "lon")
    return cube.where(F.col("lat_idx").between(i0, i1) & F.col("lon_idx").between(j0, j1))


# --- time --------------------------------------------------------------------------------


def time_range(cube: DataFrame, start, end) -> DataFrame:
    """Inclusive day-resolution range: the whole last day is kept."""
    s, e = _date(start), _date(end) + _dt.timedelta(days=1)
    t = F.col("t")
    return cube.where((t >= F.lit(s)) & (t < F.lit(e)))


def year_slice(cube: DataFrame, year: int) -> DataFrame:
    """``sel(time='YYYY')`` written as a range on the raw column so Parquet can skip row groups."""
    return cube.where((F.col("t") >= F.lit(_dt.date(year, 1, 1))) & (F.col("t") < F.lit(_dt.date(year + 1, 1, 1))))


def exclude_years(df: DataFrame, years, col: str = "t") -> DataFrame:
    y = F.year(col) if col == "t" else F.col(col)
    return df.where(~y.isin([int(v) for v in years]))


# --- strides and positions -----------------------------------------------------------------


def stride_subsample(cube: DataFrame, t_step: int = 3, lat_step: int = 2, lon_step: int = 2, axis: DataFrame | None = None) -> DataFrame:
    """``[::t_step, ::lat_step, ::lon_step]`` on axis positions (``axis``: the cube's ``(t, time_idx)``)."""
    out = cube.where((F.col("lat_idx") % lat_step == 0) & (F.col("lon_idx") % lon_step == 0))
    if t_step > 1:
        out = with_time_index(out, axis if axis is not None else time_axis(cube)).where(F.col("time_idx") % t_step == 0).drop("time_idx")
    return out


def frame_at(cube: DataFrame, k: int, axis: DataFrame | None = None) -> DataFrame:
    """Positional time selection; negative ``k`` counts from the end (-1 = last step).

    The step is looked up on the time axis (one row reaches the driver if ``axis`` is given) and
    applied as a literal filter, which reaches the Parquet scan.
    """
    axis = axis if axis is not None else time_axis(cube)
    order = F.col("time_idx").asc() if k >= 0 else F.col("time_idx").desc()
    row = axis.orderBy(order).offset(k if k >= 0 else -k - 1).limit(1).collect()
    if not row:
        raise IndexError(f"no time step {k}")
    return cube.where(F.col("t") == F.lit(row[0]["t"]))


def last_frame(cube: DataFrame) -> DataFrame:
    """The last time step of the cube (``max(t)`` as a literal filter)."""
    return cube.where(F.col("t") == F.lit(scalar(cube, F.max("t"))))


# --- nearest point -------------------------------------------------------------------------


def nearest_on_axis(points: DataFrame, col: str, pairs, idx: str, label: str) -> DataFrame:
    """Attach ``idx`` and ``label`` of the axis label nearest to ``col``: clamped to the ends, no
    wrap, a tie goes to the larger label; a missing coordinate has no neighbour.

    A label's cell reaches from the midpoint below it to the midpoint above.  The midpoints
    are the splits of a bucketizer (a binary search per point); the bucket number joins the axis table.
    """
    pairs = sorted(pairs, key=lambda p: p[1])
    mids = [(a[1] + b[1]) / 2 for a, b in zip(pairs, pairs[1:])] or [float("-1e308")]  # the only label gets both sides
    p = points.withColumn("_x", F.coalesce(F.col(col).cast("double"), F.lit(float("nan"))))
    p = Bucketizer(splits=[float("-inf"), *mids, float("inf")], inputCol="_x", outputCol="_pos", handleInvalid="keep").transform(p)
    p = p.withColumn("_pos", F.when(F.isnan("_x"), F.lit(None)).otherwise(F.col("_pos"))).drop("_x")
    table = points.sparkSession.createDataFrame([(float(n), int(i), float(v)) for n, (i, v) in enumerate(pairs)], f"_pos double, {idx} int, {label} double")
    return p.join(small_or_plain(table), "_pos", "left").drop("_pos")


def nearest_point(cube: DataFrame, points: DataFrame, axes=None) -> DataFrame:
    """Map each point ``(point_id, lat, lon)`` to its nearest grid cell, each axis independently.

    ``axes`` are the ``(idx, label)`` pairs of both dimensions (derived from the cube if absent).
    """
    lat_pairs, lon_pairs = axes if axes is not None else index_axes(cube)
    p = points.select("point_id", F.col("lat").alias("point_lat"), F.col("lon").alias("point_lon"))
    p = nearest_on_axis(p, "point_lat", lat_pairs, "lat_idx", "lat")
    p = nearest_on_axis(p, "point_lon", lon_pairs, "lon_idx", "lon")
    return p.select("point_id", "point_lat", "point_lon", "lat_idx", "lon_idx", "lat", "lon")


def point_series(cube: DataFrame, nearest: DataFrame) -> DataFrame:
    """Series of the cells picked by ``nearest_point`` (one copy per point).

    The box around the picked cells becomes a range filter, which reaches the Parquet scan (row
    groups of other cells are skipped in a cell-sorted store); the join keeps the exact cells.
    """
    sel = nearest.select("point_id", *CELL)
    box = sel.agg(*[f(c).alias(f"{c}_{n}") for c in CELL for n, f in (("lo", F.min), ("hi", F.max))]).first()
    for c in CELL:
        if box[f"{c}_lo"] is not None:
            cube = cube.where(F.col(c).between(box[f"{c}_lo"], box[f"{c}_hi"]))
    return cube.join(small_or_plain(sel), CELL)


# --- masks ---------------------------------------------------------------------------------


def land_mask(cube: DataFrame) -> DataFrame:
    """Per cell: ``land`` is true when every step is missing."""
    return cube.groupBy(*CELL).agg(*cell_labels(), (F.count("sst") == 0).alias("land"))


def mask_apply(df: DataFrame, land: DataFrame, cols) -> DataFrame:
    """Set ``cols`` to NULL on land cells.

    A left join with the per-cell mask (at most one row per grid cell).  No hint: adaptive
    execution measures the materialized mask and broadcasts it only when it is small.
    """
    m = land.where("land").select(*CELL, F.lit(True).alias("_land"))
    out = df.join(m, CELL, "left")
    for c in cols:
        out = out.withColumn(c, F.when(F.col("_land").isNull(), F.col(c)))
    return out.drop("_land")


def reference_mask(ref: DataFrame) -> DataFrame:
    """Cells missing in the reference's first time step (absent rows count as missing), in one read
    after that step is known."""
    t0 = scalar(ref, F.min("t"))
    valid = F.max(((F.col("t") == F.lit(t0)) & F.col("sst").isNotNull()).cast("int"))
    return ref.groupBy(*CELL).agg(*cell_labels(), F.coalesce(valid, F.lit(0)).alias("_ok")).where("_ok = 0").drop("_ok")


def mask_reference(target: DataFrame, ref: DataFrame, mode: str = "coord", n_lat: int | None = None, axes=None) -> DataFrame:
    """Null out the target where the reference is missing in its first step.

    ``coord`` matches cells by label; ``index_negate`` moves the mask row ``i`` to row
    ``(n - i) % n`` (row 0 stays, k -> n - k); ``flip`` to ``n - 1 - i``.  In every mode the mask is
    brought to the target's cell keys first, so that the join reuses a partitioning by cell.
    ``axes`` are the target's ``(idx, label)`` pairs (derived from it if absent and needed).
    """
    m, spark = reference_mask(ref), target.sparkSession
    if mode == "coord":
        lats, lons = axes if axes is not None else index_axes(target)
        m = m.select("lat", "lon").join(small_or_plain(axis_frame(spark, lats, "lat_idx", "lat")), "lat")
        m = m.join(small_or_plain(axis_frame(spark, lons, "lon_idx", "lon")), "lon").select(*CELL)
    else:
        if mode not in ("index_negate", "flip"):
            raise ValueError(f"unknown mode {mode!r}")
        if n_lat is None:
            n_lat = len((axes if axes is not None else index_axes(target))[0])
        i = F.col("lat_idx")
        row = (F.lit(n_lat) - i) % F.lit(n_lat) if mode == "index_negate" else F.lit(n_lat - 1) - i
        m = m.select(row.cast("int").alias("lat_idx"), "lon_idx")
    m = m.distinct().withColumn("_masked", F.lit(True))
    out = target.join(m, CELL, "left")  # adaptive execution broadcasts it when measured small
    return out.withColumn("sst", F.when(F.col("_masked").isNull(), F.col("sst"))).drop("_masked")


def drop_missing(df: DataFrame, subset=("sst",)) -> DataFrame:
    return df.dropna(subset=list(subset))


def extreme_rows(df: DataFrame, flag: str = "q95") -> DataFrame:
    return df.where(F.col(flag) == 1)


def section_lat(cube: DataFrame, lat_idx: int, years) -> DataFrame:
    """One latitude row over the given years, with the joint min / max of the values shown."""
    yrs = [int(y) for y in years]
    cond = None
    for y in yrs:
        c = (F.col("t") >= F.lit(_dt.date(y, 1, 1))) & (F.col("t") < F.lit(_dt.date(y + 1, 1, 1)))
        cond = c if cond is None else cond | c
    rows = cube.where((F.col("lat_idx") == lat_idx) & cond).select(
        "t", F.year("t").cast("int").alias("year"), "lon_idx", "lon", "sst"
    )
    stats = rows.agg(F.min("sst").alias("vmin"), F.max("sst").alias("vmax"))
    return attach_scalars(rows, stats)
