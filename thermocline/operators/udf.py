"""Apply user functions along time to every cell's series.

``map_along_time`` is the way for functions on arrays: whole series, many at a time, as the rows of
a matrix. ``apply_along_time`` hands over one series at a time as a pandas frame, for functions that need
one. Both are kept for user functions; the built-in operators hardly use them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from thermocline.model import CELL, time_axis, with_time_index

#: Matrix entries that a function is given at once (one series may have more).
BLOCK_ENTRIES = 4_000_000


def whole_series(batches: Iterator[pa.RecordBatch], keys: int, rows: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole series of about ``rows`` rows, with the first row of each series and the end.

    ``batches`` are sorted by their first ``keys`` columns. A series that goes on in the next batch is
    carried over to it; pieces are joined once, when a table is full.
    """
    parts: list[pa.RecordBatch] = []
    held = 0

    def starts(t: pa.Table) -> np.ndarray:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(keys):
            k = t.column(i).combine_chunks()
            k = k.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= k[1:] != k[:-1]
        return np.flatnonzero(new)

    for b in batches:
        if not b.num_rows:
            continue
        parts.append(b)
        held += b.num_rows
        if held >= rows:
            table = pa.Table.from_batches(parts)
            first = starts(table)
            if len(first) > 1:  # the last series may go on
                yield table.slice(0, int(first[-1])), first
                parts = table.slice(int(first[-1])).to_batches()
                held = table.num_rows - int(first[-1])
            else:
                rows = 2 * held  # one long series: looked at again when it has doubled
    if parts:
        table = pa.Table.from_batches(parts)
        yield table, np.append(starts(table), table.num_rows)


def map_along_time(df: DataFrame, fn: Callable[[np.ndarray], np.ndarray], value: str, out: str, out_type: str = "double", keys=CELL,
                   axis: DataFrame | None = None, partitioned: bool = False) -> DataFrame:
    """``df`` with ``out`` = ``fn`` of each series' ``value``, step by step.

    ``fn`` gets a matrix, one row per series and one column per step of the time axis (NaN where a series has no
    row or value), and returns one of the same shape; NaN becomes NULL. Series are brought together by
    ``keys`` with one shuffle (none if ``df`` is ``partitioned`` by them), sorted, and handed over many at a time.
    ``axis`` is the ``(t, time_idx)`` table. A row without a time gets NULL; of rows of one step the last counts.
    """
    axis = axis if axis is not None else time_axis(df)
    steps = axis.agg(F.coalesce(F.max("time_idx") + 1, F.lit(0)).alias("n")).first()["n"]
    has = "time_idx" in df.columns
    d = with_time_index(df, axis)
    lead = [*keys, "time_idx"]
    d = d.select(*lead, F.col(value).cast("double").alias("_v"), F.struct(*[c for c in d.columns]).alias("_row"))
    d = (d if partitioned else d.repartition(*keys)).sortWithinPartitions(*lead)
    n_keys, kind = len(keys), T.DataType.fromDDL(out_type)
    at_once = max(1, BLOCK_ENTRIES // max(1, steps))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in whole_series(batches, n_keys, BLOCK_ENTRIES):
            for k in range(0, len(first) - 1, at_once):  # sparse series: few rows, as many steps
                begin, end = int(first[k]), int(first[min(k + at_once, len(first) - 1)])
                yield from one(table.slice(begin, end - begin), first[k : k + at_once + 1] - begin)

    def one(table: pa.Table, first: np.ndarray) -> list[pa.RecordBatch]:
        at = table.column(n_keys).to_numpy()  # NaN without a time
        on = ~np.isnan(at) if at.dtype.kind == "f" else np.ones(len(at), bool)
        place = np.repeat(np.arange(len(first) - 1), np.diff(first))[on], at[on].astype(np.int64)
        matrix = np.full((len(first) - 1, steps), np.nan)
        matrix[place] = table.column(n_keys + 1).to_numpy()[on]
        result = np.full(table.num_rows, np.nan)
        result[on] = np.asarray(fn(matrix), float)[place]
        made = pa.array(result, pa.float64(), mask=np.isnan(result)).cast(out_arrow)
        return pa.Table.from_arrays([table.column(n_keys + 2), made], names=["_row", out]).to_batches()

    out_arrow = to_arrow_type(kind)
    made = d.mapInArrow(run, T.StructType([d.schema["_row"], T.StructField(out, kind)]))
    kept = [c for c in df.columns if c != out]
    return made.select(*[F.col("_row").getField(c).alias(c) for c in kept if has or c != "time_idx"], out)


def apply_along_time(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                     keys=CELL, order: str = "t") -> DataFrame:
    """``fn`` receives one cell's rows sorted by ``order`` and returns rows matching ``schema``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf.sort_values(order, kind="stable").reset_index(drop=True))

    return df.groupBy(*keys).applyInPandas(run, schema=schema)


def runs_at_least(flags: np.ndarray, min_len: int, steps: np.ndarray | None = None) -> np.ndarray:
    """Boolean array: True on elements of runs of at least ``min_len`` consecutive True values.

    ``steps`` are the elements' positions on the time axis (by default one after the other).
    """
    f = np.asarray(flags, dtype=bool)
    out = np.zeros(f.size, dtype=bool)
    if f.size == 0:
        return out
    on = np.flatnonzero(f)
    at = np.arange(f.size) if steps is None else np.asarray(steps)
    # a run ends where the next flagged element is not on the next step
    for run in np.split(on, np.flatnonzero(np.diff(at[on]) != 1) + 1):
        if run.size >= min_len:
            out[run] = True
    return out


def mark_runs_pandas(df: DataFrame, flag: str, min_len: int, keys=CELL, out: str = "in_run", axis: DataFrame | None = None) -> DataFrame:
    """The run marker as a user function (same result as ``runs.mark_runs``)."""
    d = with_time_index(df, axis)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in d.schema.fields)

    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf[flag].fillna(False).astype(bool) & pdf["time_idx"].notna()
        pdf[out] = runs_at_least(on.to_numpy(), min_len, pdf["time_idx"].fillna(-1).to_numpy())
        return pdf

    marked = apply_along_time(d, fn, f"{fields}, {out} boolean", keys=keys, order="time_idx")
    return marked if "time_idx" in df.columns else marked.drop("time_idx")


def long_runs(flags: np.ndarray, min_len: int) -> np.ndarray:
    """``runs_at_least`` of every row of a matrix: runs are told by where their rows change."""
    edge = np.zeros((flags.shape[0], flags.shape[1] + 2), np.int8)
    edge[:, 1:-1] = flags
    step = np.diff(edge, axis=1)
    row, start = np.nonzero(step == 1)
    end = np.nonzero(step == -1)[1]  # in the same order: runs of a row follow each other
    long = end - start >= min_len
    depth = np.zeros(step.shape, np.int32)
    np.add.at(depth, (row[long], start[long]), 1)
    np.add.at(depth, (row[long], end[long]), -1)
    return np.cumsum(depth, axis=1)[:, : flags.shape[1]] > 0


def mark_runs_along_time(df: DataFrame, flag: str, min_len: int, keys=CELL, out: str = "in_run", axis: DataFrame | None = None) -> DataFrame:
    """The run marker as a user function on matrices (same result as ``runs.mark_runs``)."""
    d = df.withColumn("_flag", F.col(flag).cast("double"))
    marked = map_along_time(d, lambda m: long_runs(m > 0, min_len), "_flag", out, keys=keys, axis=axis)
    return marked.withColumn(out, F.coalesce(F.col(out) > 0, F.lit(False))).drop("_flag")
