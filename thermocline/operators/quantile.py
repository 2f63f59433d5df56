"""Exact quantiles of a whole column without sending it to one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer, which is
fine per cell (a series is bounded by the time axis) but not for a quantile over all rows.
Here the rank is located by refinement instead: approximate quantiles give bucket edges,
bucket counts (a partial aggregate) locate the bucket that holds each wanted rank, and a
window partitioned by bucket ranks the values of these buckets, in the same way at every
size.  Only bucket counts and a few scalars reach the driver.
"""

from __future__ import annotations

import math

from pyspark import StorageLevel
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 1024


def _stats(vals: DataFrame):
    return vals.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()


def rank_values(vals: DataFrame, ranks: list[int], buckets: int = BUCKETS, stats=None) -> dict[int, float]:
    """Values at zero-based ``ranks`` of the ascending non-null column ``v``.

    The rows are cut at approximate quantiles, which hold about ``1 / buckets`` of the rows each
    (a value with many rows has a bucket of its own), and ranked within the buckets wanted.
    """
    ranks = sorted(set(ranks))
    st = stats if stats is not None else _stats(vals)
    if st["lo"] == st["hi"]:
        return {k: st["lo"] for k in ranks}
    # Bucket edges from approximate quantiles (a mergeable sketch, partial per task).
    probs = ", ".join(f"{i / buckets!r}D" for i in range(1, buckets))  # one expression, not a call per number
    edges = vals.agg(F.expr(f"percentile_approx(v, array({probs}), {4 * buckets})").alias("e")).first()["e"]
    # Each edge also gets the next double above it, so a value holding many rows ends up
    # alone in its bucket (resolved at once); the midpoint guarantees an interior split.
    cand = set(edges) | {math.nextafter(e, math.inf) for e in edges} | {st["lo"] + (st["hi"] - st["lo"]) / 2}
    splits = [-math.inf] + sorted(e for e in cand if st["lo"] < e <= st["hi"]) + [math.inf]
    b = Bucketizer(splits=splits, inputCol="v", outputCol="b").transform(vals)
    found = b.groupBy("b").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    counts = sorted(tuple(r) for r in found.collect())  # at most 2 * buckets rows
    out: dict[int, float] = {}
    inside: dict[int, tuple[float, int]] = {}  # rank -> its bucket and its rank there
    before = 0
    for bid, n, lo, hi in counts:
        for k in ranks:
            if before <= k < before + n:
                if lo == hi:
                    out[k] = lo
                else:
                    inside[k] = (bid, k - before)
        before += n
    if inside:
        # a bucket holds about a thousandth of the rows: its values are ranked in a task of its own
        here = b.where(F.col("b").isin(sorted({bid for bid, _ in inside.values()})))
        w = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
        upto = here.groupBy("b", "v").agg(F.count(F.lit(1)).alias("c")).withColumn("upto", F.sum("c").over(w))
        wanted = [F.min(F.when((F.col("b") == bid) & (F.col("upto") > at), F.col("v"))).alias(f"r{k}") for k, (bid, at) in inside.items()]
        row = upto.agg(*wanted).first()
        out.update({k: row[f"r{k}"] for k in inside})
    return out


def exact_quantiles(df: DataFrame, col: str, qs, **kw) -> list[float | None]:
    """Linear-interpolation quantiles (position ``q * (n - 1)``) of the non-null values of ``col``."""
    vals = df.select(F.col(col).alias("v")).where(F.col("v").isNotNull())
    # The search reads the column several times: keep the one column (memory, spilling to
    # disk) instead of recomputing its lineage each time; lost blocks are recomputed.
    vals = vals.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return _quantiles_of(vals, qs, **kw)
    finally:
        vals.unpersist()


def _quantiles_of(vals: DataFrame, qs, **kw) -> list[float | None]:
    st = _stats(vals)  # count and range in one job
    n = st["n"]
    if n == 0:
        return [None for _ in qs]
    pos = [float(q) * (n - 1) for q in qs]
    ranks = sorted({int(math.floor(p)) for p in pos} | {int(math.ceil(p)) for p in pos})
    got = rank_values(vals, ranks, stats=st, **kw)
    res = []
    for p in pos:
        lo_i, hi_i = int(math.floor(p)), int(math.ceil(p))
        lo, hi = got[lo_i], got[hi_i]
        res.append(lo if lo_i == hi_i else lo + (hi - lo) * (p - lo_i))
    return res
