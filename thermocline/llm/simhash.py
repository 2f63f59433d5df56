"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit SimHash is cut into three segments (23, 23 and 18 bits; the last padded to 23). The
perfect binary Golay code of length 23 decodes a segment to the index of the one codeword within
three bits of it. A segment three bits off its codeword has five more codewords at distance four
and takes their indices as keys too: then two segments that differ in one bit at most share a key.

Two fingerprints that differ in two bits at most have, by the pigeonhole principle, a segment
without error; if the errors are (2, 0, 0) there are two such, if (1, 1, 0) both others have one
error. So one of the cyclic pairs (exact segment, next segment) agrees in the exact segment and
shares a Golay key in the next. These (exact bits, codeword index) keys are joined, and the
joined fingerprints are verified by their bit distance.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thermocline.llm.common import as_payload, unpacked, written

#: Generator polynomial of the Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 (fixed value).
GENERATOR = 0b110001110101
#: (shift, width) of the three segments.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
MAX_BITS = 2


def syndrome(x: np.ndarray) -> np.ndarray:
    """Remainder of 23-bit vectors modulo the generator polynomial (11 bits)."""
    x = x.astype(np.int64)
    for bit in range(22, 10, -1):
        x = np.where((x >> bit) & 1, x ^ (GENERATOR << (bit - 11)), x)
    return x


def golay_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By syndrome: the error of at most three bits; how many keys; the offsets to all codewords within reach."""
    ones = [1 << i for i in range(23)]
    errors = [0] + ones + [a | b for i, a in enumerate(ones) for b in ones[i + 1 :]]
    errors += [a | b | c for i, a in enumerate(ones) for j, b in enumerate(ones[i + 1 :], i + 1) for c in ones[j + 1 :]]
    errors = np.array(errors, np.int64)
    syn = syndrome(errors)
    coset = np.zeros(2048, np.int64)
    coset[syn] = errors  # the code is perfect: each syndrome is met once
    triples = errors[1 + 23 + 253 :]
    quads = {}
    by_syndrome = dict(zip(syn.tolist(), errors.tolist(), strict=True))
    offsets = np.zeros((2048, 6), np.int64)
    n = np.ones(2048, np.int64)
    offsets[syn, 0] = errors
    for e in triples.tolist():  # four bits off another codeword: a triple and one bit of another coset member
        s = int(syndrome(np.array([e]))[0])
        quads[s] = set()
    for i in range(23):  # weight four = one bit + a triple that has the rest of the syndrome
        for s in quads:
            rest = by_syndrome[int(s ^ syndrome(np.array([1 << i]))[0])]
            if bin(rest).count("1") == 3 and not rest >> i & 1:
                quads[s].add(rest | 1 << i)
    for s, q in quads.items():
        for k, e in enumerate(sorted(q)):
            offsets[s, k + 1] = e
        n[s] = 1 + len(q)
    return coset, n, offsets


def golay_keys(x: np.ndarray, tables: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest codeword, indices of all codewords within reach or -1) of 23-bit vectors."""
    coset, n, offsets = tables
    s = syndrome(x)
    near = (x ^ coset[s]) >> 11  # the code is systematic: the top 12 bits name the codeword
    every = (x[:, None] ^ offsets[s]) >> 11
    every[np.arange(6)[None, :] >= n[s][:, None]] = -1
    return near, every


_BYTE_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)


def simhash(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """Bit b is set if it is set in over half of the hashes of the text's word shingles (repeats count)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    h64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return h64(b" ".join(words), seed)
    grams = zip(*[words[i:] for i in range(shingle)], strict=False)
    h = np.array([h64(g, seed) for g in map(b" ".join, grams)], np.uint64)
    counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + np.arange(8) * 256).ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BYTE_BITS).ravel()  # little-endian bytes: bit b at b
    return int(np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(rows: DataFrame, text: str, shingle: int, seed: int) -> DataFrame:
    """``rows`` with the signed 64-bit SimHash of the whole text (0 without words) as ``_fp`` in the text's place."""
    kept = rows.select(*[c for c in rows.columns if c != text], text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py(), shingle, seed) for t in b.column(b.num_columns - 1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(fp.view(np.int64))], names=[*b.schema.names[:-1], "_fp"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(run, f"{schema}, _fp long")


def _keyed(fps: DataFrame, near_only: bool) -> DataFrame:
    """(key, fp): per cyclic pair, the exact segment with the nearest codeword or all within reach of the next."""
    tables = golay_tables()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            seg = [((fp >> np.uint64(at)) & np.uint64((1 << w) - 1)).astype(np.int64) for at, w in SEGMENTS]
            for i in range(3):
                near, every = golay_keys(seg[(i + 1) % 3], tables)
                codes = near[:, None] if near_only else every
                key = (np.int64(i) << 35) | (seg[i][:, None] << 12) | codes
                rows, cols = np.nonzero(codes >= 0)
                yield pa.RecordBatch.from_arrays([pa.array(key[rows, cols]), pa.array(fp.view(np.int64)[rows])], names=["key", "fp"])

    return fps.select("_fp").mapInArrow(run, "key long, fp long")


#: A key of more fingerprints than this is searched by flipping bits; probes of a part; keys that are broadcast.
HOT_KEY, PART_PROBES, HOT_KEYS_SENT = 5_000, 50_000, 100_000


def _flipped(rows: DataFrame) -> DataFrame:
    """Links of hot keys: (key, part, fp, member) rows, each part with some probes and all members of its key.

    A probe and a member of one key agree in a segment, so their link is one of some thousand
    ways to flip two bits at most of the other segments: each is looked up among the sorted
    members. The work grows with the members, not with their pairs.
    """

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        fp, member = table.column("fp").to_numpy(), table.column("member").to_numpy(zero_copy_only=False)
        probes, members = fp[~member], np.sort(fp[member])
        exact = key[0].as_py() >> 35
        ones = [np.uint64(1) << np.uint64(at + i) for n, (at, w) in enumerate(SEGMENTS) if n != exact for i in range(w)]
        flips = np.array(ones + [x | y for i, x in enumerate(ones) for y in ones[i + 1 :]], np.uint64).view(np.int64)
        out = [np.zeros((0, 2), np.int64)]
        for at in range(0, len(probes), 1000):
            a = probes[at : at + 1000, None]
            b = a ^ flips
            near = members[np.minimum(np.searchsorted(members, b), len(members) - 1)] == b if len(members) else np.zeros(b.shape, bool)
            r, c = np.nonzero(near & (a < b))
            out.append(np.stack((a[r, 0], b[r, c]), 1))
        pairs = np.concatenate(out)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1])})

    return rows.groupBy("key", "part").applyInArrow(run, "a long, b long")


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Pairs (a < b) of distinct fingerprints of ``fps._fp`` that differ in at most ``max_bits`` bits.

    The keys find every pair up to two bits apart; more are refused. A key's pairs are verified
    inside the join, so only true links leave it; the pairs of a key of very many fingerprints are
    not formed but looked up. A link may meet at several keys.
    """
    if not 0 < max_bits <= MAX_BITS:
        raise ValueError(f"the Golay keys cover 1 to {MAX_BITS} differing bits")
    wide = _keyed(fps, near_only=False).select("key", F.col("fp").alias("a"))
    near = _keyed(fps, near_only=True).select(F.col("key").alias("k"), F.col("fp").alias("b"))
    hot = near.groupBy(F.col("k").alias("h")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > HOT_KEY)
    hot = written(hot.select("h", F.ceil(F.col("n") / PART_PROBES).cast("int").alias("parts")), "simhash-hot")
    diff = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    few = F.broadcast(hot) if hot.count() <= HOT_KEYS_SENT else hot
    cold = wide.join(few, wide["key"] == hot["h"], "left_anti")
    pairs = cold.join(near, (cold["key"] == near["k"]) & (F.col("a") < F.col("b")) & (diff <= max_bits)).select("a", "b")
    probes = wide.join(few, wide["key"] == hot["h"]).select("key", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"), F.col("a").alias("fp"), F.lit(False).alias("member"))
    members = near.join(few, near["k"] == hot["h"]).select(F.col("k").alias("key"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("b").alias("fp"), F.lit(True).alias("member"))
    looked_up = _flipped(probes.unionByName(members)).where(diff <= max_bits)
    return pairs.unionByName(looked_up).distinct()


#: Parts that the rows of a hub are dealt to, and the share of all edges that makes a node one.
HUB_PARTS, HUB_SHARE, HUB_LEAST = 64, 10_000, 100


def _with_least(edges: DataFrame, node: str, other: str, n_edges: int) -> DataFrame:
    """``edges`` with ``m``, the smallest of the node and its ``other`` ends.

    Minima and degrees are partial aggregates. A node with more than a share of all edges (of
    which there can be ``2 * HUB_SHARE`` at most) is a hub: its rows are dealt to parts, and its
    minimum is repeated for each, so that the join has no hot key.
    """
    least = edges.groupBy(node).agg(F.least(F.min(other), F.col(node)).alias("m"), F.count(F.lit(1)).alias("_d"))
    hub = F.col("_d") > max(HUB_LEAST, n_edges // HUB_SHARE)
    hubs = F.broadcast(least.where(hub).select(node, F.lit(True).alias("_hub")))  # at most 2 * HUB_SHARE rows
    part = F.when(F.col("_hub"), F.pmod(F.xxhash64(other), F.lit(HUB_PARTS))).otherwise(F.lit(0).cast("long"))
    dealt = edges.join(hubs, node, "left").withColumn("_part", part).drop("_hub")
    every = F.when(hub, F.sequence(F.lit(0).cast("long"), F.lit(HUB_PARTS - 1).cast("long"))).otherwise(F.array(F.lit(0).cast("long")))
    return dealt.join(least.select(node, "m", F.explode(every).alias("_part")), [node, "_part"])


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating stars.

    Large star: a node's larger neighbours are linked to the smallest one it knows; small star:
    its smaller ones and itself are. Every round is written to the shared folder, and rounds grow
    with the logarithm of the largest component.
    """
    edges = written(edges.select("a", "b").distinct(), name)
    n = edges.count()
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, "a", "b", n).where("b > a").select(F.col("b").alias("x"), F.col("m").alias("y"))
        # small star over the large star's edges (x > y)
        small = _with_least(large, "x", "y", n).select(F.when(F.col("y") == F.col("m"), F.col("x")).otherwise(F.col("y")).alias("b"), F.col("m").alias("a"))
        after = written(small.where("a <> b").select("a", "b").distinct(), name)
        n_after = after.count()
        if n_after == n and after.exceptAll(edges).isEmpty():
            return after.select(F.col("b").alias("node"), F.col("a").alias("root"))
        edges, n = after, n_after


def _classified(docs: DataFrame, key: str, text: str, shingle: int, max_bits: int, seed: int, *more) -> DataFrame:
    """(``_key``, ``_fp``, ``_component``, more) of each row of ``docs``."""
    slim = docs.select(F.col(key).alias("_key"), *more, F.col(text).alias("_text"))
    rows = written(fingerprints(slim, "_text", shingle, seed), "simhash")
    # one row per distinct fingerprint: copies never meet in the joins below
    firsts = written(rows.groupBy("_fp").agg(F.min("_key").alias("_first")), "simhash-firsts")
    roots = components(links(firsts, max_bits), "simhash-links")
    rooted = firsts.join(roots, firsts["_fp"] == roots["node"], "left").withColumn("_root", F.coalesce("root", "_fp"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("_component"))
    named = rooted.join(least, "_root").select(F.col("_fp").alias("_f"), "_component")
    # copies make a fingerprint hot: slim rows, one match each, and AQE may split the join
    return rows.join(named, rows["_fp"] == named["_f"]).drop("_f")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """(key, fingerprint, component_id) per row: 16 hex digits, and the smallest key reachable over
    fingerprints that differ in ``max_bits`` bits at most.

    Equal texts have equal fingerprints and one component, as have all texts without words
    (null, empty, blank; fingerprint zero, linked like any other). Fewer words than a shingle make
    one shingle. Repeated rows are rows of their own; a component of null keys only has a null
    id; an empty table gives no rows; other columns are not read.
    """
    rows = _classified(docs, key, text, shingle, max_bits, seed)
    return rows.select(F.col("_key").alias(key), F.lpad(F.lower(F.hex("_fp")), 16, "0").alias("fingerprint"), F.col("_component").alias("component_id"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3, max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one: that of its smallest key.

    Rows that repeat this key (or have none, in a component without keys) compete by a hash of
    the whole row; of fully equal rows one stays. All columns are kept as they are.
    """
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns]))
    ident = [F.xxhash64(whole).alias("_id1"), F.hash(whole).alias("_id2")]
    rows = _classified(docs, key, text, shingle, max_bits, seed, *ident).where(F.col("_key").eqNullSafe(F.col("_component")))
    # components without keys are told apart by their fingerprints' smallest
    group = F.when(F.col("_component").isNull(), F.col("_fp"))
    best = rows.groupBy("_component", group.alias("_g")).agg(F.min(F.struct("_id1", "_id2")).alias("_best")).select("_best._id1", "_best._id2")
    tagged = docs.select(as_payload(docs), *ident)
    kept = tagged.join(best, ["_id1", "_id2"], "left_semi")
    one = kept.withColumn("_n", F.row_number().over(Window.partitionBy("_id1", "_id2").orderBy("_id1"))).where("_n = 1")
    return unpacked(one, docs.columns)
