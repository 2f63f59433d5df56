"""Data model: cube schema, missing values, cell keys and axis tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = ["lat_idx", "lon_idx"]
LABELS = ["lat", "lon"]

CUBE_SCHEMA = T.StructType(
    [
        T.StructField("t", T.DateType()),
        T.StructField("lat_idx", T.IntegerType()),
        T.StructField("lon_idx", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sst", T.DoubleType()),
    ]
)

# Largest axis table that is broadcast; longer ones are joined without a hint.
MAX_BROADCAST_AXIS = 200_000


def nan_to_null(c: Column) -> Column:
    """NaN marks missing values in gridded files; Spark must see NULL (avg/percentile skip NULL only)."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def normalize_cube(df: DataFrame, var: str = "sst", time: str = "t") -> DataFrame:
    """Rename the variable to ``sst`` / time to ``t`` and turn NaN into NULL."""
    out = df
    if time != "t":
        out = out.withColumnRenamed(time, "t")
    if var != "sst":
        out = out.withColumnRenamed(var, "sst")
    return out.withColumn("sst", nan_to_null(F.col("sst")))


def small_or_plain(df: DataFrame, max_rows: int = MAX_BROADCAST_AXIS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``max_rows`` rows, else without any.

    The check reads at most ``max_rows + 1`` rows; the join gives the same rows either way.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def axis_values(df: DataFrame, **axes: Column) -> dict[str, list]:
    """Sorted distinct non-missing values of several axis expressions, in one scan.

    One hash-partitioned distinct over (axis, value) rows: tasks send what they saw once, to as
    many reducers as there are shuffle partitions, and only the axes themselves reach the driver.
    """
    def slot(name: str) -> Column:
        own = [(c if n == name else F.lit(None)).alias(n) for n, c in axes.items()]
        return F.struct(F.lit(name).alias("_axis"), *own)

    rows = df.select(F.inline(F.array(*[slot(n) for n in axes]))).distinct().collect()
    return {n: sorted(r[n] for r in rows if r["_axis"] == n and r[n] is not None) for n in axes}


def label_axes(df: DataFrame) -> tuple[list[float], list[float]]:
    """Sorted distinct ``lat`` and ``lon`` labels."""
    got = axis_values(df, lat=F.col("lat"), lon=F.col("lon"))
    return got["lat"], got["lon"]


def _pairs(values: list) -> list[tuple[int, float]]:
    return [(r[0], r[1]) for r in values]


def _pair(idx: str, label: str) -> Column:
    return F.when(F.col(idx).isNotNull() & F.col(label).isNotNull(), F.struct(idx, label))


def index_axes(df: DataFrame) -> tuple[list[tuple[int, float]], list[tuple[int, float]]]:
    """``(lat_idx, lat)`` and ``(lon_idx, lon)`` pairs of an indexed cube."""
    got = axis_values(df, lat=_pair("lat_idx", "lat"), lon=_pair("lon_idx", "lon"))
    return _pairs(got["lat"]), _pairs(got["lon"])


def cube_axes(df: DataFrame, time: bool = False, doy: bool = False) -> dict:
    """All axes an operator needs: ``lat``/``lon`` as (idx, label) pairs, and on request the
    sorted time steps and days of year.  Run it on the cube *before* any repartition, or
    read what ``write_axes`` stored beside the cube instead."""
    wanted = {"lat": _pair("lat_idx", "lat"), "lon": _pair("lon_idx", "lon")}
    if time:
        wanted["time"] = F.col("t")
    if doy:
        wanted["doy"] = F.dayofyear("t")
    got = axis_values(df, **wanted)
    return got | {"lat": _pairs(got["lat"]), "lon": _pairs(got["lon"])}


def axis_frame(spark, pairs, idx: str, label: str, label_type: str = "double") -> DataFrame:
    """A small local DataFrame ``(idx, label)`` (cheap to broadcast; no rescan of the cube)."""
    return spark.createDataFrame([(int(i), v) for i, v in pairs], f"{idx} int, {label} {label_type}")


def _positions(df: DataFrame, axis: DataFrame, label: str, idx: str) -> DataFrame:
    """Attach ``idx`` by label; a missing or unknown label is an error, not a lost row."""
    axis = small_or_plain(axis.select(F.col(label).alias("_label"), F.col(idx)))
    out = df.join(axis, F.col(label) == F.col("_label"), "left").drop("_label")
    lost = F.raise_error(F.concat(F.lit(f"{label} not on its axis: "), F.coalesce(F.col(label).cast("string"), F.lit("NULL"))))
    return out.withColumn(idx, F.coalesce(F.col(idx), lost.cast("int")))


def with_cell_index(
    df: DataFrame,
    lat_axis: DataFrame | None = None,
    lon_axis: DataFrame | None = None,
    lat_descending: bool = False,
) -> DataFrame:
    """Attach ``lat_idx, lon_idx`` by joining the axis tables (derived from the labels if not given).

    A row whose label is NULL or off the given axes fails the job; ``off_axis_rows`` lists such rows.
    """
    spark = df.sparkSession
    if lat_axis is None or lon_axis is None:
        lats, lons = label_axes(df)
        if lat_descending:
            lats = lats[::-1]
        lat_axis = lat_axis if lat_axis is not None else axis_frame(spark, list(enumerate(lats)), "lat_idx", "lat")
        lon_axis = lon_axis if lon_axis is not None else axis_frame(spark, list(enumerate(lons)), "lon_idx", "lon")
    return _positions(_positions(df, lat_axis, "lat", "lat_idx"), lon_axis, "lon", "lon_idx")


def off_axis_rows(df: DataFrame, lat_axis: DataFrame, lon_axis: DataFrame) -> DataFrame:
    """The rows of ``df`` whose labels are NULL or not on the axes."""
    on_lat = df.join(small_or_plain(lat_axis.select("lat").distinct()), "lat", "left_anti")
    rest = df.join(small_or_plain(lat_axis.select("lat").distinct()), "lat", "left_semi")
    return on_lat.unionByName(rest.join(small_or_plain(lon_axis.select("lon").distinct()), "lon", "left_anti"))


def time_labels(cube: DataFrame) -> list:
    """Sorted distinct time steps (the axis shared by all cells)."""
    return axis_values(cube, t=F.col("t"))["t"]


def time_axis(cube: DataFrame) -> DataFrame:
    """Distinct time steps with a zero-based ``time_idx``: a local table, one row per step."""
    ts = time_labels(cube)
    ttype = cube.schema["t"].dataType.simpleString()
    return axis_frame(cube.sparkSession, list(enumerate(ts)), "time_idx", "t", ttype).select("t", "time_idx")


def with_time_index(cube: DataFrame, axis: DataFrame | None = None) -> DataFrame:
    """Attach the position on the time axis that all cells share (kept if the cube has it).

    ``axis`` is the ``(t, time_idx)`` table (derived from the cube if not given).  A row
    without a time has no position; a time that is not on a given axis is an error.
    """
    if "time_idx" in cube.columns:
        return cube
    axis = time_axis(cube) if axis is None else axis
    steps = small_or_plain(axis.select(F.col("t").alias("_t"), "time_idx"))
    out = cube.join(steps, F.col("t") == F.col("_t"), "left").drop("_t")
    lost = F.raise_error(F.concat(F.lit("time not on the axis: "), F.col("t").cast("string"))).cast("int")
    return out.withColumn("time_idx", F.when(F.col("t").isNull(), F.lit(None)).otherwise(F.coalesce("time_idx", lost)))


def axis_years(axis: DataFrame) -> list[int]:
    """Calendar years on a ``(t, time_idx)`` axis."""
    return axis_values(axis, y=F.year("t"))["y"]


def write_axes(cube: DataFrame, path: str) -> None:
    """Store the time, latitude and longitude axes beside a cube, one small table each."""
    spark, axes = cube.sparkSession, cube_axes(cube, time=True)
    ttype = cube.schema["t"].dataType.simpleString()
    tables = {
        "time": axis_frame(spark, list(enumerate(axes["time"])), "time_idx", "t", ttype),
        "lat": axis_frame(spark, axes["lat"], "lat_idx", "lat"),
        "lon": axis_frame(spark, axes["lon"], "lon_idx", "lon"),
    }
    for name, table in tables.items():
        table.coalesce(1).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{name}")


def read_axes(spark, path: str) -> dict[str, DataFrame]:
    """The axis tables that ``write_axes`` stored: ``time``, ``lat`` and ``lon``."""
    return {n: spark.read.parquet(f"{path.rstrip('/')}/{n}") for n in ("time", "lat", "lon")}


def by_cell(cube: DataFrame) -> DataFrame:
    """Hash-partition on the integer cell key once; every later (cell, ...) window reuses it."""
    return cube.repartition(*CELL)
