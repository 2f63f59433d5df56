"""Loading and decoding cubes (S1, S2, S3, S5, S9, S10, S11)."""

from __future__ import annotations

import datetime as _dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.model import CELL, axis_values, nan_to_null, normalize_cube, with_cell_index

RAW_SCHEMA = T.StructType(
    [
        T.StructField("t", T.DateType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sst", T.DoubleType()),
    ]
)


def index_cube(raw: DataFrame, var: str = "sst", time: str = "t", lat_descending: bool = False,
               lat_axis: DataFrame | None = None, lon_axis: DataFrame | None = None) -> DataFrame:
    """Normalize a ``(time, lat, lon, var)`` table into a cube with integer cell keys."""
    df = normalize_cube(raw, var=var, time=time)
    df = with_cell_index(df, lat_axis, lon_axis, lat_descending=lat_descending)
    return df.select("t", *CELL, "lat", "lon", "sst")


def readable_files(spark: SparkSession, path, glob: str | None = None) -> tuple[list[str], list[str]]:
    """(readable, unreadable) Parquet files under ``path``, in one distributed pass.

    Unreadable are files whose footer cannot be read, or that have no rows.  Use it to load what can be
    read and to report what cannot; ``load_cube`` itself never skips a file.
    """
    def names(reader) -> set[str]:
        if glob:
            reader = reader.option("pathGlobFilter", glob)
        return {r[0] for r in reader.load(path).select(F.col("_metadata.file_path")).distinct().collect()}  # names only

    listed = names(spark.read.format("binaryFile").option("recursiveFileLookup", "true"))
    footers = spark.read.format("parquet").schema("none string").option("recursiveFileLookup", "true")
    good = names(footers.option("ignoreCorruptFiles", "true"))
    return sorted(listed & good), sorted(listed - good)


def load_cube(spark: SparkSession, path, fmt: str = "parquet", var: str = "sst", time: str = "t",
              schema: T.StructType | None = None, glob: str | None = None, dedupe: bool = False,
              time_type: str = "date", **axes) -> DataFrame:
    """Read cube files (Parquet, CSV or JSON) with an explicit schema and index the cells.

    ``glob`` keeps one file extension (``*.parquet``).  A corrupt file, a CSV or JSON value that
    does not fit its type, and a label that is NULL or off a given axis fail the job; see
    ``readable_files`` and ``off_axis_rows`` for sorting out such input beforehand.  ``time_type`` is the
    type of time in CSV and JSON files (``date`` or ``timestamp_ntz``): a sub-daily time read as a date
    is an error, not a truncation.  ``dedupe`` keeps one row per (t, cell) when files overlap
    (a full shuffle; see ``dedupe_steps``); leave it off for inputs known to be unique.
    """
    reader = spark.read.format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    text = fmt in ("csv", "json") and schema is None
    if text:  # times are read as text and parsed strictly below
        reader = reader.schema(_raw_schema(var, time)).option("mode", "FAILFAST")
    elif schema is not None:
        reader = reader.schema(schema).option("mode", "FAILFAST")
    if fmt == "csv":
        reader = reader.option("header", "true")
    df = reader.load(path)
    if text:
        df = df.withColumn(time, strict_time(F.col(time), time_type))
    if "lat_idx" in df.columns and "lon_idx" in df.columns and not axes:
        out = normalize_cube(df, var=var, time=time).select("t", *CELL, "lat", "lon", "sst")
    else:
        out = index_cube(df, var=var, time=time, **axes)
    return dedupe_steps(out) if dedupe else out


def strict_time(text: Column, time_type: str) -> Column:
    """ISO text as ``date`` or ``timestamp_ntz``; text that does not fit without loss is an error."""
    t = text.cast("timestamp_ntz")  # an error for what is no time at all
    if time_type == "timestamp_ntz":
        return t
    if time_type != "date":
        raise ValueError(time_type)
    whole = t == F.date_trunc("day", t).cast("timestamp_ntz")
    lost = F.raise_error(F.concat(F.lit("time of day would be lost: "), text)).cast("date")
    return F.when(text.isNull() | whole, t.cast("date")).otherwise(lost)


def _raw_schema(var: str, time: str) -> T.StructType:
    return T.StructType(
        [
            T.StructField(time, T.StringType()),
            T.StructField("lat", T.DoubleType()),
            T.StructField("lon", T.DoubleType()),
            T.StructField(var, T.DoubleType()),
        ]
    )


def concat_time(pieces, dedupe: bool = True) -> DataFrame:
    """Append pieces along time (``unionByName``).

    With ``dedupe`` a step that arrives in several pieces (a file read twice) is kept once,
    so no cell can grow beyond the length of the time axis.
    """
    out = None
    for p in pieces:
        out = p if out is None else out.unionByName(p)
    if out is None:
        raise ValueError("no pieces to concatenate")
    return dedupe_steps(out) if dedupe else out


def dedupe_steps(cube: DataFrame) -> DataFrame:
    """One row per (t, cell): a valid value before a missing one, of several valid ones the smallest.

    ``min`` skips missing values and aggregates partially before the shuffle: copies inside a
    task collapse there.  The labels are part of the key (they depend on the cell), so filters on
    them still reach the scan.  Other columns are not kept.
    """
    keys = ["t", *CELL] + [c for c in ("lat", "lon") if c in cube.columns]
    return cube.groupBy(*keys).agg(F.min("sst").alias("sst"))


def sort_time(cube: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partition on time and sort inside partitions (time-contiguous files)."""
    out = cube.repartitionByRange(partitions, "t") if partitions else cube.repartitionByRange("t")
    return out.sortWithinPartitions("t", *CELL)


# CF time units (singular) and their microseconds.
CF_UNITS = {"day": 86_400_000_000, "hour": 3_600_000_000, "minute": 60_000_000, "second": 1_000_000, "millisecond": 1_000, "microsecond": 1}
_CF_ORIGIN = re.compile(r"(\d{1,4})-(\d{1,2})-(\d{1,2})(?:[T ]+(\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6})\d*)?)?)?\s*(?:UTC|Z|\+?0{1,2}:?0{0,2})?")


def cf_origin(text: str) -> _dt.datetime:
    """The origin of CF time units: ``Y-M-D[ h:m[:s[.f]]][ UTC]``, digits not necessarily padded."""
    m = _CF_ORIGIN.fullmatch(text.strip())
    if m is None:
        raise ValueError(f"unsupported CF origin {text!r}")
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    return _dt.datetime(year, month, day, hour, minute, second, int((m.group(7) or "").ljust(6, "0")))


def decode_cf_time(df: DataFrame, col: str, units: str, out: str = "t") -> DataFrame:
    """CF time, numbers in ``'<unit> since <origin>'``, as timestamps without time zone (proleptic Gregorian).

    Whole units and the fraction are turned into microseconds apart, the fraction rounded to the nearest: a number
    that leaves a double few bits for its fraction (an early origin) loses nothing that it has. NaN is missing.
    """
    unit, _, origin = units.partition(" since ")
    micros = CF_UNITS.get(unit.strip().lower().removesuffix("s"))
    if micros is None:
        raise ValueError(f"unsupported CF unit {unit!r}")
    number = nan_to_null(F.col(col))
    whole = F.floor(number)
    part = F.floor((number - whole) * F.lit(float(micros)) + F.lit(0.5))
    base = F.lit(cf_origin(origin).isoformat(sep=" ")).cast("timestamp_ntz")  # no time zone involved
    return df.withColumn(out, F.timestamp_add("MICROSECOND", whole * F.lit(micros).cast("long") + part, base))


def decode_values(raw: Column, scale: float = 1.0, offset: float = 0.0, fill=None) -> Column:
    """Packed values: ``raw * scale_factor + add_offset``; the fill value becomes NULL."""
    v = raw.cast("double") * F.lit(float(scale)) + F.lit(float(offset))
    if fill is not None:
        v = F.when(raw != F.lit(fill), v)
    return nan_to_null(v)


def cube_stats(cube: DataFrame) -> DataFrame:
    """Axis sizes, value range and missing count (one row).

    Axis sizes are counts over hash-partitioned distinct labels; the value statistics are partial sums.
    """
    axes = axis_values(cube, t=F.col("t"), lat=F.col("lat_idx"), lon=F.col("lon_idx"))
    return cube.agg(
        *[F.lit(len(axes[a])).cast("long").alias(n) for a, n in (("t", "n_time"), ("lat", "n_lat"), ("lon", "n_lon"))],
        F.min("sst").alias("sst_min"),
        F.max("sst").alias("sst_max"),
        F.count("sst").alias("n_valid"),
        (F.count(F.lit(1)) - F.count("sst")).alias("n_missing"),
        F.min("t").alias("t_min"),
        F.max("t").alias("t_max"),
    )
