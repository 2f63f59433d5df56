"""A chunked store: each row is a time x lat x lon tile, its values one array.

Tiles of ``chunk`` steps and cells (edge tiles are smaller) hold their values in the order time, lat, lon, with
the smallest and largest valid value and the number of valid ones beside. Folders are named by the tile's
place on the grid and files hold the tiles of a place in time order, so that a box, a point or a
period reads its tiles only, and a search for values skips tiles that cannot have any.

In the array NULL is a step and cell that the cube has no row for, NaN a row whose value is missing: reading
gives the cube back row for row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.functions.scalar import dense_line
from thermocline.model import CELL, nan_to_null, read_axes, small_or_plain, with_time_index, write_axes

#: Fixed value: steps, rows and columns of a tile (the reference's chunk).
CHUNK = (48, 180, 180)


def write_tiles(cube: DataFrame, path: str, chunk: tuple[int, int, int] = CHUNK, value: str = "sst", float32: bool = False) -> None:
    """Write the tiles, axes and chunk sizes of a cube under ``path`` (replacing what is there).

    One shuffle brings the rows of a tile together; there they become lines of one step and latitude, and the lines
    the tile. A tile is what one task holds of the cube at a time: ``chunk`` bounds it.
    A cell must have one row a step (see ``dedupe_steps``); rows without a time are an error.
    """
    spark, root = cube.sparkSession, path.rstrip("/")
    write_axes(cube, f"{root}/axes")
    axes = read_axes(spark, f"{root}/axes")
    nt, ny, nx = chunk
    size = {d: axes[d].count() for d in ("time", "lat", "lon")}
    untimed = F.raise_error(F.lit("a row has no time")).cast("int")
    d = with_time_index(cube, axes["time"]).withColumn("time_idx", F.coalesce("time_idx", untimed))
    place = [F.floor(F.col(i) / n).cast("int").alias(c) for c, i, n in (("tile_time", "time_idx", nt), ("tile_lat", "lat_idx", ny), ("tile_lon", "lon_idx", nx))]
    v = F.col(value).cast("double")
    d = d.select(*place, (F.col("time_idx") % nt).alias("a"), (F.col("lat_idx") % ny).alias("b"), (F.col("lon_idx") % nx).alias("i"), v.alias("v"))
    tile = ["tile_time", "tile_lat", "tile_lon"]
    width = F.least(F.lit(nx), F.lit(size["lon"]) - F.col("tile_lon") * nx)
    height = F.least(F.lit(ny), F.lit(size["lat"]) - F.col("tile_lat") * ny)
    steps = F.least(F.lit(nt), F.lit(size["time"]) - F.col("tile_time") * nt)
    entry = F.struct("i", F.coalesce("v", F.lit(float("nan"))).alias("v"))
    stats = [F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")]
    lines = d.repartition(*tile).groupBy(*tile, "a", "b").agg(F.collect_list(entry).alias("e"), *stats)
    lines = lines.select(*tile, "lo", "hi", "n", F.struct((F.col("a") * height + F.col("b")).alias("i"), dense_line(F.col("e"), width).alias("v")).alias("line"))
    tiles = lines.groupBy(*tile).agg(F.collect_list("line").alias("e"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n"))
    blank = F.array_repeat(F.lit(None).cast("double"), width)
    values = F.flatten(F.transform(dense_line(F.col("e"), steps * height), lambda x: F.coalesce(x, blank)))
    shape = [steps.alias("nt"), height.alias("ny"), width.alias("nx")]
    tiles = tiles.select(*tile, *shape, "lo", "hi", "n", values.cast("array<float>" if float32 else "array<double>").alias("v"))
    ordered = tiles.sortWithinPartitions("tile_lat", "tile_lon", "tile_time")
    ordered.write.mode("overwrite").partitionBy("tile_lat", "tile_lon").parquet(f"{root}/tiles")
    spark.createDataFrame([chunk], "nt int, ny int, nx int").coalesce(1).write.mode("overwrite").parquet(f"{root}/chunk")


def select_tiles(spark: SparkSession, path: str, time: tuple[int, int] | None = None, lat: tuple[int, int] | None = None,
                 lon: tuple[int, int] | None = None, above: float | None = None, below: float | None = None) -> DataFrame:
    """The tiles that meet ranges of positions (both ends inclusive) and can hold a value above or below a bound.

    Ranges of cells choose folders; steps and bounds are compared with statistics of the files.
    """
    root = path.rstrip("/")
    chunk = spark.read.parquet(f"{root}/chunk").first()
    tiles = spark.read.parquet(f"{root}/tiles")
    for name, wanted, n in (("tile_time", time, chunk["nt"]), ("tile_lat", lat, chunk["ny"]), ("tile_lon", lon, chunk["nx"])):
        if wanted is not None:
            tiles = tiles.where(F.col(name).between(wanted[0] // n, wanted[1] // n))
    if above is not None:
        tiles = tiles.where(F.col("hi") > above)
    if below is not None:
        tiles = tiles.where(F.col("lo") < below)
    begin = [(F.col(c) * chunk[n]).cast("int").alias(b) for c, n, b in (("tile_time", "nt", "t0"), ("tile_lat", "ny", "y0"), ("tile_lon", "nx", "x0"))]
    return tiles.select("*", *begin)


def read_tiles(spark: SparkSession, path: str, time: tuple[int, int] | None = None, lat: tuple[int, int] | None = None,
               lon: tuple[int, int] | None = None, above: float | None = None, below: float | None = None, value: str = "sst") -> DataFrame:
    """The cube (``t, lat_idx, lon_idx, lat, lon, value``) of a chunked store, or a part of it.

    ``time``, ``lat`` and ``lon`` are ranges of positions, both ends inclusive. ``above`` and ``below`` keep
    rows with values beyond them (a missing value is not). Of each tile only the wanted lines' pieces are unpacked.
    """
    tiles = select_tiles(spark, path, time, lat, lon, above, below)

    def ends(wanted: tuple[int, int] | None, begin: str, n: str) -> tuple[Column, Column]:
        if wanted is None:
            return F.lit(0), F.col(n) - 1
        return F.greatest(F.lit(wanted[0]) - F.col(begin), F.lit(0)), F.least(F.lit(wanted[1]) - F.col(begin), F.col(n) - 1)

    (t1, t2), (y1, y2), (x1, x2) = ends(time, "t0", "nt"), ends(lat, "y0", "ny"), ends(lon, "x0", "nx")
    met = tiles.where((t1 <= t2) & (y1 <= y2) & (x1 <= x2))

    def piece(a: Column, b: Column) -> Column:
        part = F.slice("v", (a * F.col("ny") + b) * F.col("nx") + x1 + 1, x2 - x1 + 1)
        return F.transform(part, lambda v, c: F.struct((F.col("t0") + a).alias("i"), (F.col("y0") + b).alias("j"), (F.col("x0") + x1 + c).alias("k"), v.alias("v")))

    every = F.flatten(F.transform(F.sequence(t1, t2), lambda a: F.flatten(F.transform(F.sequence(y1, y2), lambda b: piece(a, b)))))
    rows = met.select(F.inline(every)).where("v IS NOT NULL")
    rows = rows.select(F.col("i").alias("time_idx"), F.col("j").cast("int").alias("lat_idx"), F.col("k").cast("int").alias("lon_idx"), nan_to_null(F.col("v")).alias(value))
    if above is not None:
        rows = rows.where(F.col(value) > above)
    if below is not None:
        rows = rows.where(F.col(value) < below)
    axes = read_axes(spark, f"{path.rstrip('/')}/axes")
    for name, key in (("time", "time_idx"), ("lat", "lat_idx"), ("lon", "lon_idx")):
        rows = rows.join(small_or_plain(axes[name]), key)
    return rows.select("t", *CELL, "lat", "lon", value)
