"""Sharding: proportional stratified interleaving.

Rows are shuffled with a seed and ranked within their source; all rows are then ordered by
fractional rank ((rank + 1/2) / rows of the source), an order in which every stretch holds the
sources in the proportions of the whole, and cut into shards whose row counts differ by one at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import as_payload, rank_by_fraction, rank_within, seeded_hash, with_outputs


def shard(docs: DataFrame, n_shards: int = 16, source: str = "source", key: str = "doc_id", text: str = "text", seed: int = 7, keep: list[str] | None = None) -> DataFrame:
    """``docs`` with ``shard`` (0 to n_shards - 1), ``slot`` (gapless from 0 in its shard), ``size``,
    ``text_crc32`` and ``law`` = "rows".

    The law: row counts of two shards differ by one at most, and each shard holds every source in
    proportion (within two rows). Neither copies nor sizes decide, as a group of copies may
    exceed a shard.

    A null source is a source of its own; a null or empty text has size 1 and checksum 0; a null
    key is hashed as such; repeated rows get slots of their own (which of them gets which is
    arbitrary); fewer rows than shards leave shards empty; an empty table gives no rows. Input
    columns named like an output are replaced by it, others are kept (those of ``keep``, if given:
    texts that nobody asks for are not shuffled).
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        as_payload(docs, keep),
        F.col(source).alias("_source"),
        F.col(key).alias("_key"),
        (F.octet_length(body) + 1).cast("long").alias("_bytes"),
        F.crc32(body.cast("binary")).alias("_crc"),
    ).withColumn("_hash", seeded_hash(seed, F.col("_source"), F.col("_key"), F.col("_crc")))
    rows = rank_within(rows, "_source", "_hash", ["_key", "_crc"])
    rows = rows.withColumn("_frac", (F.col("_rank") + 0.5) / F.col("_size")).drop("_size")
    rows = rank_by_fraction(rows, "_frac", ["_hash", "_key", "_crc"])
    # shard s holds the positions p with floor(p * n / total) = s; its first is ceil(s * total / n)
    at = F.expr(f"(_pos * {n_shards}) div _total")
    first = F.expr(f"(_shard * _total + {n_shards - 1}) div {n_shards}")
    rows = rows.withColumn("_shard", at.cast("int")).withColumn("_slot", F.col("_pos") - first)
    return with_outputs(
        rows,
        docs.columns if keep is None else keep,
        {"size": F.col("_bytes"), "text_crc32": F.col("_crc"), "law": F.lit("rows"), "shard": F.col("_shard"), "slot": F.col("_slot").cast("long")},
    )
