"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the single words, word pairs and pairs that skip one word of the whole text, hashed
to 2^20 coordinates; a feature counts once. FTRL-proximal keeps a gradient sum and a squared
gradient sum per coordinate: rates fall per coordinate, and coordinates whose sum stays below the
L1 threshold have weight zero, so that the weights are few and can be broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.llm.common import ROW, as_payload, unpacked, with_outputs

BITS = 20
#: Labelled rows that a model is fitted on at most (the first by a hash of their key).
FIT_ROWS = 20_000
#: Features of these rows that the fit holds for its epochs at most, 4 bytes each: rows from the first that exceeds it on are not learnt from.
FIT_FEATURES = 100_000_000
ALPHA, BETA, L1, L2, EPOCHS = 2.0, 1.0, 6.0, 0.0, 4

_WORD = bytes(b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def features(text: str | None) -> np.ndarray:
    """Coordinates of all n-grams and skip-grams of a text, repeats included."""
    words = text.lower().encode("utf-8", "surrogatepass").translate(_WORD).split() if text else []
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    with np.errstate(over="ignore"):
        a, b = h * np.uint64(0x9E3779B97F4A7C15), h * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1)
        grams = np.concatenate((h, a[:-1] ^ b[1:], (a[:-2] ^ b[2:]) * np.uint64(0xFF51AFD7ED558CCD)))
    return (grams >> np.uint64(64 - BITS)).astype(np.int32)


class Ftrl:
    """FTRL-proximal for binary features."""

    def __init__(self, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << BITS) + 1)  # the last one is the bias
        self.n = np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == 1 << BITS, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[at])) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, label: int) -> None:
        at = np.append(at, 1 << BITS)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] += g * g


def held_out(key: Column, folds: int = 5) -> Column:
    """Rows whose key's crc32 leaves remainder 0 are never learnt from (a null key is the text "")."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % folds == 0


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", fit_rows: int = FIT_ROWS, fit_features: int = FIT_FEATURES, seed: int = 5) -> dict[int, float]:
    """Non-zero weights by coordinate (2^20: bias), learnt from at most ``fit_rows`` labelled rows of
    ``fit_features`` distinct features in all.

    Rows held out, without key or without label are not learnt from; of labels of one key the
    largest counts, of documents of one key the one of the smallest hash; a row whose document is missing is skipped; without any row there are no weights.
    The rows go through one task in a seeded order: the fit is sequential and its size bounded.
    """
    known = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull() & ~held_out(F.col(key))).groupBy(F.col(key).alias("_k")).agg(F.max(label).cast("int").alias("y"))
    some = known.orderBy(F.xxhash64(F.lit(seed), "_k"), "_k").limit(fit_rows)
    rows = docs.select(F.col(key).alias("_d"), F.col(text).alias("t")).join(F.broadcast(some), F.col("_d") == F.col("_k"))  # fit_rows rows at most
    one = F.min(F.struct(F.xxhash64(F.lit(seed + 1), "_d", "t").alias("h"), "t", "y")).alias("one")  # of a key that is repeated
    rows = rows.groupBy("_d").agg(one).select("one.*").repartition(1).sortWithinPartitions("h", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, data, held = Ftrl(), [], 0
        for t, y in ((t, y) for b in batches for t, y in zip(b.column(1), b.column(2), strict=True)):
            x = np.unique(features(t.as_py()))
            held += len(x)
            if held > fit_features:
                break
            data.append((x, y.as_py()))
            model.learn(*data[-1])
        for _ in range(EPOCHS - 1):
            for x, y in data:
                model.learn(x, y)
        at = np.arange((1 << BITS) + 1)
        w = model.weights(at)
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], names=["at", "w"])

    return {r["at"]: r["w"] for r in rows.mapInArrow(run, "at long, w double").collect()}


def _scored(docs: DataFrame, weights: dict[int, float], text: str) -> DataFrame:
    """Payload and ``_p``."""
    spark = docs.sparkSession
    at = np.array(sorted(weights), np.int64)
    shared = spark.sparkContext.broadcast((at, np.array([weights[i] for i in at.tolist()])))  # 2^20 at most
    place = docs.columns.index(text)
    base = docs.select(as_payload(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values = shared.value
        dense = np.zeros((1 << BITS) + 1)
        dense[at] = values
        for b in batches:
            out = np.zeros(b.num_rows)
            for i, t in enumerate(b.column(0).field(place)):
                x = features(t.as_py())
                x = np.unique(x[dense[x] != 0])
                out[i] = dense[1 << BITS] + dense[x].sum()
            out = 1 / (1 + np.exp(-np.clip(out, -35, 35)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out)], names=[ROW, "_p"])

    return base.mapInArrow(run, T.StructType([*base.schema.fields, T.StructField("_p", T.DoubleType())]))


def score(docs: DataFrame, weights: dict[int, float], text: str = "text") -> DataFrame:
    """``docs`` with ``score``, the probability of toxicity of the whole text (0 to 1).

    A null or empty text has the bias alone; an input column ``score`` gives way; rows are scored
    one by one, so repeated rows score alike and an empty table gives no rows.
    """
    return with_outputs(_scored(docs, weights, text), docs.columns, {"score": F.col("_p")})


def filter_toxic(docs: DataFrame, weights: dict[int, float], text: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``limit``, with all columns as they are.

    Without weights (nothing was learnt) all rows stay. A null or empty text scores by the bias alone; repeated
    rows stay or go together; an empty table gives no rows.
    """
    if not weights:
        return docs
    return unpacked(_scored(docs, weights, text).where(F.col("_p") < limit), docs.columns)
