"""Grid reshaping: block means, unstacking by year, frame matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.functions.scalar import clip_scale, dense_line, lit_array
from thermocline.model import CELL, axis_frame, axis_values, by_cell, cube_axes, index_axes, small_or_plain
from thermocline.operators.extremes import dedup_days


def _block_labels(pairs, k: int, keep: int) -> list[tuple[int, float]]:
    """Mean label of each block of ``k`` consecutive axis positions below ``keep``."""
    blocks: dict[int, list[float]] = {}
    for i, v in pairs:
        if i < keep:
            blocks.setdefault(i // k, []).append(v)
    return [(b, sum(vs) / len(vs)) for b, vs in sorted(blocks.items())]


def block_axis(pairs, k: int) -> list[tuple[int, float]]:
    """The axis of blocks of ``k`` positions, a ragged end trimmed."""
    return _block_labels(pairs, k, (len(pairs) // k) * k)


def coarsen(df: DataFrame, k_lat: int, k_lon: int, value: str = "sst", time: str = "t",
            boundary: str = "exact", axes=None) -> DataFrame:
    """Block means over ``k_lat x k_lon`` cells per time step (missing values skipped).

    ``boundary='exact'`` requires the axis sizes to divide; ``'trim'`` drops the ragged end.
    Block labels are the means of the axis labels in the block.  ``axes`` are the ``(idx, label)``
    pairs of both dimensions (one pass over ``df`` if absent).  The partial aggregate runs
    before the shuffle, so the shuffle carries at most one row per block and task.
    """
    lat_pairs, lon_pairs = axes if axes is not None else index_axes(df)
    n_lat, n_lon = len(lat_pairs), len(lon_pairs)
    if boundary == "exact":
        if n_lat % k_lat or n_lon % k_lon:
            raise ValueError(f"grid {n_lat} x {n_lon} is not divisible by {k_lat} x {k_lon}")
    elif boundary != "trim":
        raise ValueError(boundary)
    keep_lat, keep_lon = (n_lat // k_lat) * k_lat, (n_lon // k_lon) * k_lon
    spark = df.sparkSession
    blat = axis_frame(spark, _block_labels(lat_pairs, k_lat, keep_lat), "lat_idx", "lat")
    blon = axis_frame(spark, _block_labels(lon_pairs, k_lon, keep_lon), "lon_idx", "lon")
    src = df.where((F.col("lat_idx") < keep_lat) & (F.col("lon_idx") < keep_lon))
    means = src.groupBy(
        time,
        (F.col("lat_idx") / k_lat).cast("int").alias("lat_idx"),
        (F.col("lon_idx") / k_lon).cast("int").alias("lon_idx"),
    ).agg(F.avg(value).alias(value))
    return means.join(small_or_plain(blat), "lat_idx").join(small_or_plain(blon), "lon_idx").select(
        time, *CELL, "lat", "lon", value
    )


def unstack_year(cube: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Dense ``(cell, dayofyear, year)`` table: every day of year and year present anywhere in the
    cube, for every cell; missing combinations have a NULL value (first row wins on duplicates).

    The cube is read and shuffled by cell once: the values of a cell and year (a few hundred at
    most) become a dense line by their places on the day axis, the lines of a cell one of years.
    ``axis`` is the ``(t, time_idx)`` table; years and days come from it without a pass over the cube.
    """
    got = axis_values(axis if axis is not None else cube, y=F.year("t"), d=F.dayofyear("t"))
    days, years = [int(x) for x in got["d"]], [int(x) for x in got["y"]]
    if not years:
        return cube.select(*CELL, F.year("t").cast("int").alias("year"), F.dayofyear("t").cast("int").alias("dayofyear"), "sst").limit(0)

    def place(axis: list[int], label: Column) -> Column:
        """Position on an integer axis: read off an array that covers its range."""
        at = {v: i for i, v in enumerate(axis)}
        return F.get(lit_array([at.get(v, -1) for v in range(axis[0], axis[-1] + 1)]), (label - axis[0]).cast("int"))

    d = dedup_days(by_cell(cube)).where("t IS NOT NULL")
    d = d.select(*CELL, place(years, F.year("t")).alias("_y"), place(days, F.dayofyear("t")).alias("_d"), "sst")
    lines = d.groupBy(*CELL, "_y").agg(F.collect_list(F.struct("_d", "sst")).alias("_e"))
    lines = lines.select(*CELL, "_y", dense_line(F.col("_e"), len(days), "_d", "sst").alias("_line"))
    blank = F.array_repeat(F.lit(None).cast(cube.schema["sst"].dataType), len(days))
    cells = lines.groupBy(*CELL).agg(F.collect_list(F.struct("_y", "_line")).alias("_e"))
    rows = cells.select(*CELL, F.posexplode(dense_line(F.col("_e"), len(years), "_y", "_line")).alias("_y", "_line"))
    rows = rows.select(*CELL, "_y", F.posexplode(F.coalesce("_line", blank)).alias("_d", "sst"))
    named = [F.element_at(lit_array(years), F.col("_y") + 1).alias("year"), F.element_at(lit_array(days), F.col("_d") + 1).alias("dayofyear")]
    return rows.select(*CELL, *named, "sst")


def frames(cube: DataFrame, value: str = "anom", every: int = 2, lo: float | None = None, hi: float | None = None,
           axes: dict | None = None) -> DataFrame:
    """One row per kept time step (every ``every``-th) and latitude: ``row`` holds the values by lon
    index, clipped to ``[lo, hi]``, NULL where the cell has no value.

    Rows of a step spread over tasks, and no row holds more than one line of the grid, put in place in
    one pass over its sorted entries (a cell must have one row a step; see ``dedupe_steps``).  Lines without
    any value come from a spine of (step, lat) pairs, not of cells.  ``axes`` are the cube's
    ``cube_axes(..., time=True)``.
    """
    spark = cube.sparkSession
    axes = axes if axes is not None else cube_axes(cube, time=True)
    n_lat, n_lon = len(axes["lat"]), len(axes["lon"])
    kept = [(t, i) for i, t in enumerate(axes["time"]) if i % every == 0]
    v = F.col(value)
    if lo is not None and hi is not None:
        v = clip_scale(v, lo, hi)
    ttype = cube.schema["t"].dataType.simpleString()
    steps = spark.createDataFrame(kept, f"t {ttype}, time_idx int")
    data = cube.join(small_or_plain(steps), "t").select("t", "time_idx", "lat_idx", F.struct("lon_idx", v.alias("v")).alias("c"))
    spine = steps.select("t", "time_idx", F.explode(F.sequence(F.lit(0), F.lit(max(n_lat - 1, 0)))).alias("lat_idx"), F.lit(None).cast(data.schema["c"].dataType).alias("c"))
    lines = data.unionByName(spine).groupBy("t", "time_idx", "lat_idx").agg(F.collect_list("c").alias("_e"))
    return lines.select("t", "time_idx", "lat_idx", dense_line(F.col("_e"), n_lon, "lon_idx", "v").alias("row"))


def frame_cells(rows: DataFrame) -> DataFrame:
    """``frames`` as one row per cell: ``t, time_idx, lat_idx, lon_idx, v``."""
    return rows.select("t", "time_idx", "lat_idx", F.posexplode("row").alias("lon_idx", "v"))
