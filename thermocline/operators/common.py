"""Small shared building blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach_scalars(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach the columns of a one-row aggregate to every row of ``df`` as literals.

    The aggregate runs as its own (partial, then single-row) job; its values then travel
    inside the plan, so filters on them can reach the Parquet scan.
    """
    row = one_row.first()
    fields = one_row.schema.fields
    return df.withColumns({f.name: F.lit(row[f.name]).cast(f.dataType) for f in fields})


def scalar(df: DataFrame, expr) -> object:
    """One aggregate value of ``df`` (a single small job)."""
    return df.agg(expr.alias("v")).first()["v"]


def cell_labels() -> list:
    """Aggregates that carry the (constant per cell) labels through a groupBy."""
    return [F.first("lat", ignorenulls=True).alias("lat"), F.first("lon", ignorenulls=True).alias("lon")]
