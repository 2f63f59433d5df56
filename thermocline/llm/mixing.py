"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of rows. The i-th block of a source of weight w (weights sum to
one) is released at slot floor(i / w) and due by slot ceil((i + 1) / w); each slot goes to the
released block that is due first. On one processor this meets every deadline, so after any
number t of slots each source has had between floor(w t) and ceil(w t) of them: less than one
block from its target at every point of the stream.

Weights are exact fractions, so the bound holds over a stream of any length. One task runs the schedule
and streams it out as a table with one row per block; it holds one block per source at a time.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction
from itertools import islice
from math import lcm

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import ROW, as_payload, rank_within, seeded_hash, unpacked, with_outputs

MAX_SOURCES = 4096
PLAN_ROWS = 50_000


def whole_weights(weights: dict) -> dict:
    """``weights`` as whole numbers in exactly their proportions."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    unit = lcm(*[w.denominator for w in exact.values()]) if exact else 1
    return {s: int(w * unit) for s, w in exact.items()}


def pfair_stream(sources: list[tuple]) -> Iterator[tuple]:
    """(source, index, slot, release, deadline) of each block, slot by slot, until every source of
    ``sources`` (source, whole weight, blocks) has given all its blocks once."""
    total = sum(w for _, w, _ in sources)
    later = [(0, s) for s in range(len(sources))]
    index, open_ = [0] * len(sources), len(sources)
    ready: list[tuple] = []
    t = 0
    while open_:
        while later and later[0][0] <= t:
            release, s = heapq.heappop(later)
            w = sources[s][1]
            i = index[s]
            index[s] = i + 1
            heapq.heappush(ready, (-(-(i + 1) * total // w), release, s, i))
            heapq.heappush(later, ((i + 1) * total // w, s))
        due, release, s, i = heapq.heappop(ready)
        open_ -= i == sources[s][2] - 1
        yield sources[s][0], i, t, release, due
        t += 1


def rounded_weights(weights: dict, period: int) -> dict:
    """``weights`` as slots per period: exact fractions, no longer rounded to whole slots."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    return {s: w / sum(exact.values()) * period for s, w in exact.items()}


def pfair_period(slots: dict) -> list[tuple]:
    """(source, index, slot, release, deadline) of the blocks of the first period."""
    period = int(sum(slots.values()))
    return list(islice(pfair_stream([(s, w, period + 1) for s, w in whole_weights(slots).items()]), period))


def _scheduled(docs: DataFrame, weights: dict | None, temperature: float, block_rows: int, source: str, key: str, text: str, seed: int, keep: list[str] | None) -> DataFrame:
    """Payload and each row's place in the stream."""
    spark = docs.sparkSession
    rows = docs.select(as_payload(docs, keep), F.col(source).alias("_source"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_text"))
    counts = {r["_source"]: r["n"] for r in rows.groupBy("_source").agg(F.count(F.lit(1)).alias("n")).limit(MAX_SOURCES + 1).collect()}
    if len(counts) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {s: n**temperature for s, n in counts.items()} if weights is None else {s: weights.get(s, 0) for s in counts}
    if any(w <= 0 for w in wanted.values()):
        raise ValueError(f"sources without a weight: {[s for s, w in wanted.items() if w <= 0][:10]}")
    whole = whole_weights(wanted)
    blocks = {s: -(-n // block_rows) for s, n in counts.items()}
    known = sorted(counts, key=lambda s: (s is not None, str(s)))
    plan = [(n, whole[s], blocks[s]) for n, s in enumerate(known)]

    def task(_):
        size = {n: b for n, _, b in plan}
        slots = pfair_stream(plan)
        while part := [(n, i % size[n], i // size[n], t, r, min(d, (1 << 63) - 1)) for n, i, t, r, d in islice(slots, PLAN_ROWS)]:
            yield pd.DataFrame(part, columns=["_n", "_at", "_epoch", "_t", "_release", "_due"])

    table = spark.range(0, 1, 1, 1).mapInPandas(task, "_n long, _at long, _epoch long, _t long, _release long, _due long")
    # grows with the table, which Spark's estimate of it does not see: never broadcast
    table = table.groupBy("_n", "_at").agg(F.collect_list(F.struct("_epoch", "_t", "_release", "_due")).alias("_uses")).hint("shuffle_hash")
    sources = spark.createDataFrame([(s, n) for n, s in enumerate(known)], f"_src {docs.schema[source].dataType.simpleString()}, _id long")
    rows = rows.withColumn("_hash", seeded_hash(seed, F.col("_source"), F.col("_key"), F.col("_text")))
    rows = rank_within(rows, "_source", "_hash", ["_key", "_text"])
    rows = rows.withColumn("_block", F.expr(f"_rank div {block_rows}"))
    rows = rows.join(F.broadcast(sources), rows["_source"].eqNullSafe(sources["_src"]))  # at most MAX_SOURCES rows
    rows = rows.join(table, (rows["_id"] == table["_n"]) & (rows["_block"] == table["_at"]))  # each block once, before its epochs
    rows = rows.withColumn("_use", F.explode("_uses"))
    places = {
        "epoch": F.col("_use._epoch"),
        "block": F.col("_block"),
        "slot": F.col("_use._t"),
        "release": F.col("_use._release"),
        "deadline": F.col("_use._due"),
        "offset": F.expr(f"_rank % {block_rows}"),
    }
    return rows.select(ROW, *[c.alias(n) for n, c in places.items()])


def mix(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_rows: int = 32, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 11, keep: list[str] | None = None) -> DataFrame:
    """``docs`` interleaved to target weights, with ``epoch``, ``block``, ``slot``, ``release``,
    ``deadline`` and ``offset`` (row within the block); sorting by (slot, offset) gives the stream.

    ``weights`` maps each source to its target; by default a source's row count to the power
    ``temperature``. The stream is as long as it takes to give every row once to the source
    with the most blocks for its weight; other sources start a new ``epoch`` when used up. So no
    row is dropped and the targets hold over the whole stream as over each of its prefixes.

    A null source is a source of its own. Every source of ``docs`` must have a positive weight
    and there may be ``MAX_SOURCES`` of them at most (an error otherwise: counts of sources are
    held by the driver). Null keys and texts are values like others; repeated rows are rows of
    their own; an empty table gives no rows. Input columns named like an output give way to it; others are
    kept (those of ``keep``, if given).
    """
    out = _scheduled(docs, weights, temperature, block_rows, source, key, text, seed, keep)
    return with_outputs(out, docs.columns if keep is None else keep, {n: F.col(n) for n in ("epoch", "block", "slot", "release", "deadline", "offset")})


def stream(docs: DataFrame, weights: dict | None = None, temperature: float = 0.7, block_rows: int = 32, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 11) -> DataFrame:
    """The rows of ``mix`` in the order of the stream (across and within partitions), with the columns of ``docs`` only."""
    out = _scheduled(docs, weights, temperature, block_rows, source, key, text, seed, None)
    return unpacked(out.repartitionByRange("slot", "offset").sortWithinPartitions("slot", "offset"), docs.columns)
