"""Helpers shared by the corpus operators: reading, scratch tables, payload structs, distributed ranks."""

from __future__ import annotations

import sys
import tempfile
import types
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROW = "_row"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder.

    ``spark.checkpoint.dir`` is read from the session; only a local session that has none
    (tests) gets one of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="corpus-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/corpus-{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, survives lost executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def as_payload(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The columns (all if not named) of ``df`` as one struct, so that no internal name can clash with them."""
    names = df.columns if columns is None else columns
    quoted = [F.col(f"`{c.replace('`', '``')}`") for c in names]
    return F.struct(*quoted or [F.lit(None).alias("none")]).alias(ROW)


def unpacked(df: DataFrame, columns: list[str]) -> DataFrame:
    """The payload's columns as they were."""
    return df.select(*[F.col(ROW).getField(c).alias(c) for c in columns])  # getField takes names with dots as they are


def with_outputs(df: DataFrame, columns: list[str], outputs: dict[str, Column]) -> DataFrame:
    """The payload's columns and then ``outputs``; an input column named like an output gives way to it."""
    taken = {c.lower() for c in outputs}
    kept = [F.col(ROW).getField(c).alias(c) for c in columns if c.lower() not in taken]
    return df.select(*kept, *[c.alias(n) for n, c in outputs.items()])


def seeded_hash(seed: int, *cols: Column) -> Column:
    """A uniform 64-bit hash of the columns: the order of a seeded shuffle."""
    return F.xxhash64(F.lit(seed), *cols)


def cell_count(df: DataFrame, rows_per_cell: int) -> int:
    """Cells of ``rows_per_cell`` rows; of more rows where the table of the cells would not fit one task."""
    return max(1, min(df.count() // rows_per_cell, 100_000))


def rank_within(df: DataFrame, group: str, order: str, ties: list[str], rows_per_cell: int = 500) -> DataFrame:
    """Adds ``_rank`` (0-based rank by ``order`` in ``group``) and ``_size`` (rows of the group).

    ``order`` is a uniform 64-bit hash, so its leading bits cut every group into cells of
    bounded size: one window task sorts one cell, never a whole (possibly hot) group, and the
    cells' counts give each cell its offset. ``ties`` break equal hashes.
    """
    bits = (cell_count(df, rows_per_cell) - 1).bit_length()
    # leading bits of the hash as an unsigned number
    cell = F.shiftrightunsigned(F.col(order), 64 - bits) if bits else F.lit(0).cast("long")
    # groups by a 64-bit hash, which is never null: window and join then share one shuffle
    rows = df.withColumn("_cell", cell).withColumn("_gk", F.xxhash64(F.col(group).isNull(), F.col(group)))
    by_group = Window.partitionBy("_g")
    before = by_group.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    whole = by_group.orderBy("_c").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = rows.groupBy(F.col("_gk").alias("_g"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select("_g", "_c", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(whole).alias("_size"))
    inside = Window.partitionBy("_gk", "_cell").orderBy(order, *ties)
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    ranked = ranked.join(cells, (F.col("_gk") == F.col("_g")) & (F.col("_cell") == F.col("_c")))
    return ranked.withColumn("_rank", F.col("_before") + F.col("_rn")).drop("_g", "_c", "_gk", "_cell", "_rn", "_before")


def rank_by_fraction(df: DataFrame, fraction: str, ties: list[str], rows_per_cell: int = 500) -> DataFrame:
    """Adds ``_pos`` (0-based position in the order of ``fraction``) and ``_total``.

    ``fraction`` is spread evenly over [0, 1), so equal slices of it are cells of bounded size.
    """
    n = cell_count(df, rows_per_cell)
    rows = df.withColumn("_cell", F.least(F.floor(F.col(fraction) * n), F.lit(n - 1)))
    every = Window.orderBy("_c")  # one row per cell
    cells = rows.groupBy(F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    cells = cells.select(
        "_c",
        F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"),
    )
    inside = Window.partitionBy("_cell").orderBy(fraction, *ties)
    ranked = rows.withColumn("_rn", F.row_number().over(inside) - 1)
    return ranked.join(cells, ranked["_cell"] == cells["_c"]).withColumn("_pos", F.col("_before") + F.col("_rn")).drop("_c", "_cell", "_rn", "_before")


def worker_state() -> dict:
    """What a Python worker process keeps from task to task (loaded models, caches of bounded size)."""
    return sys.modules.setdefault("_corpus_worker_state", types.ModuleType("_corpus_worker_state")).__dict__
