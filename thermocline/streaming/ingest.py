"""Append newly arrived cube files to a store in which every (t, cell) has one row.

This is the multi-file daily concatenation run incrementally: a file source picks up only
files it has not seen (tracked in the checkpoint), and each micro-batch is an upsert by (t, cell). The store keeps
whole months: a batch merges its rows with the newest version of the months that it touches and
writes these, sorted by cell, to a folder of its own, ``batch=<id>/year=<y>/month=<m>``. The newest
complete version of a month counts, so that a row sent again, in the same batch or in a later one, stands once.

A batch that is replayed after a failure starts from the versions before it and replaces its own
folder. Versions that neither readers nor a replay need are deleted: a month has two at most. With
``trigger(availableNow=True)`` the stream processes whatever is there and stops, so it can run as a
scheduled batch job; the checkpoint makes a rerun after a failure resume where it stopped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.model import CELL, nan_to_null
from thermocline.sources.cube import dedupe_steps
from thermocline.sources.store import exists, file_system, listed

INDEXED_SCHEMA = T.StructType(
    [
        T.StructField("t", T.DateType()),
        T.StructField("lat_idx", T.IntegerType()),
        T.StructField("lon_idx", T.IntegerType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("sst", T.DoubleType()),
    ]
)

_VERSION = re.compile(r"batch=(\d+)/year=(\d+)/month=(\d+)$")


def _parts() -> dict[str, Column]:
    """The folders' columns; rows without a time are kept under year 0, month 0."""
    return {n: F.coalesce(f("t"), F.lit(0)).cast("int") for n, f in (("year", F.year), ("month", F.month))}


def _versions(spark: SparkSession, store: str, before: int | None = None) -> dict[tuple[int, int], list[tuple[int, str]]]:
    """By month: (batch, folder) of its complete versions, oldest first; of batches before ``before`` if given."""
    root = store.rstrip("/")
    done = {int(p.rsplit("batch=", 1)[1].split("/")[0]) for p in listed(spark, f"{root}/batch=*/_SUCCESS")}
    out: dict[tuple[int, int], list[tuple[int, str]]] = {}
    for p in listed(spark, f"{root}/batch=*/year=*/month=*"):
        batch, year, month = map(int, _VERSION.search(p).groups())
        if batch in done and (before is None or batch < before):
            out.setdefault((year, month), []).append((batch, p))
    return {m: sorted(v) for m, v in out.items()}


def read_ingested(spark: SparkSession, store: str, schema: T.StructType = INDEXED_SCHEMA) -> DataFrame:
    """The store's cube: the newest complete version of each month."""
    newest = [v[-1][1] for v in _versions(spark, store).values()]
    if not newest:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*newest)


def upsert(batch: DataFrame, batch_id: int, store: str, schema: T.StructType = INDEXED_SCHEMA) -> None:
    """Merge a batch into the store as batch ``batch_id``: of rows of one (t, cell), stored or new, a valid value
    counts before a missing one, and of several valid ones the smallest (in whatever order they came).

    Only months that the batch touches are read and written; they are at most as many as the batch has.
    """
    spark, root = batch.sparkSession, store.rstrip("/")
    base = _versions(spark, store, before=batch_id)
    new = batch.withColumn("sst", nan_to_null(F.col("sst"))).select(*[f.name for f in schema.fields])
    touched = [tuple(r) for r in new.select(*_parts().values()).distinct().collect()]  # months: few
    stored = [base[m][-1][1] for m in touched if m in base]
    rows = new.unionByName(spark.read.schema(schema).parquet(*stored)) if stored else new
    out = dedupe_steps(rows).withColumns(_parts())
    out = out.repartition("year", "month", CELL[0]).sortWithinPartitions("year", "month", *CELL, "t")
    out.write.mode("overwrite").partitionBy("year", "month").parquet(f"{root}/batch={batch_id}")
    _clean(spark, store, batch_id)


def _clean(spark: SparkSession, store: str, batch_id: int) -> None:
    """Delete versions of months older than the newest two (readers at work, a replay of this batch), and
    folders of batches that hold none."""
    for versions in _versions(spark, store, before=batch_id + 1).values():
        for _, folder in versions[:-2]:
            fs, p = file_system(spark, folder)
            fs.delete(p, True)
    for done in listed(spark, f"{store.rstrip('/')}/batch=*/_SUCCESS"):
        folder = done.rsplit("/", 1)[0]
        if int(folder.rsplit("batch=", 1)[1]) < batch_id and not exists(spark, f"{folder}/year=*/month=*"):
            fs, p = file_system(spark, folder)
            fs.delete(p, True)


def ingest_cube_files(spark: SparkSession, src: str, store: str, checkpoint: str,
                      schema: T.StructType = INDEXED_SCHEMA, glob: str = "*.parquet",
                      max_files_per_trigger: int | None = None):
    """Start (and, with availableNow, finish) the ingest; returns the StreamingQuery.

    Every stream has a ``checkpoint`` of its own, which belongs to ``store``: a new checkpoint over
    a store that already has batches is refused, as its batch numbers would overwrite them.  A
    corrupt file fails the stream.
    """
    if exists(spark, f"{store.rstrip('/')}/batch=*") and not exists(spark, f"{checkpoint.rstrip('/')}/offsets"):
        raise ValueError(f"{store} has batches, but {checkpoint} is not the checkpoint that wrote them")
    reader = spark.readStream.schema(schema).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return (
        reader.parquet(src)
        .writeStream.foreachBatch(lambda batch, batch_id: upsert(batch, batch_id, store, schema))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
