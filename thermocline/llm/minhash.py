"""MinHash near-duplicates by an LSH forest of sorted signature orders.

A text's set of word shingles has a signature of ``HASHES`` minima. Each tree of the forest orders the
signatures by a sequence of its own, which starts with its ``DEPTH`` own minima. Texts that agree in these form a
region of the tree; two sets of similarity s meet in a given tree with probability s ** DEPTH, so that at 0.8
one of 32 trees joins them but for 5 in 10**8 pairs.

Neighbours come first: in every tree's order, each text is compared with the next one, with which it has
its longest common prefix. Of these candidates each text takes its best in another class, they are confirmed
on the full sets, and confirmed links join classes, for a few rounds. This brings together nearly all that
belongs together at a cost in proportion to the texts, however large their groups are.

Then every region that still holds several classes is searched whole for pairs of different classes, each pair
in the first tree where it meets. Pairs of short sets are confirmed where they meet, and only those that join
classes leave the task: a dense group of unlike texts gives no rows for its pairs. A region of more than
``REGION`` texts is compared block by block. One of more than ``BLOCKS`` blocks is too dense for its depth: its
texts (any pair lost by going deeper has both ends among them) are searched by a further forest of deeper and
more trees, which keeps the same probability, and so on; what is too dense even then is compared block by block.

All candidates are confirmed on the full sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import shuffle_partitions, written
from thermocline.llm.simhash import components

#: Minima of a signature, minima that a region has in common, and (depth, trees) of the forests for dense regions:
#: trees are so many that (1 - 0.8 ** depth) ** trees is under one in a million.
HASHES, DEPTH = 128, 4
DEEPER = ((8, 88), (12, 220))
#: Texts of a region that one task compares with each other, and blocks of so many of which a denser one is compared.
REGION, BLOCKS = 1_000, 16
#: Sets of so many hashes travel to their regions; pairs of larger ones are confirmed by a join.
SHORT_SET = 1_000
#: Rounds of confirming neighbours: the last one takes all that are left.
ROUNDS = 2
#: A pair is a candidate if so many standard deviations below its expected agreement at least (binomial, six: one in 10**9).
SIGMAS = 6.0


def _words(text: str | bytes) -> list[bytes]:
    raw = text.encode("utf-8", "surrogatepass") if isinstance(text, str) else text
    return raw.lower().split()  # bytes: A-Z, and white space as in ASCII


def shingles(text: str | bytes | None, size: int = 2) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles; fewer words are one shingle, none give no set."""
    words = _words(text) if text else []
    if not words:
        return np.zeros(0, np.uint64)
    h64 = xxhash.xxh64_intdigest
    if len(words) < size:
        return np.array([h64(b" ".join(words))], np.uint64)
    return np.unique(np.fromiter(map(h64, map(b" ".join, zip(*[words[i:] for i in range(size)], strict=False))), np.uint64, len(words) - size + 1))


def multipliers(n: int, seed: int) -> np.ndarray:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)


def minima(hashes: np.ndarray, odd: np.ndarray) -> np.ndarray:
    """For each odd multiplier, 32 bits that tell which hash is least after multiplication."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(hashes), 512):
            part = hashes[at : at + 512]
            mixed = part ^ (part >> np.uint64(29))
            np.minimum(least, (mixed[:, None] * odd).min(0), out=least)
        least = (least ^ (least >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (least >> np.uint64(32)).astype("<u4")


def _signed(rows: DataFrame, size: int, odd: np.ndarray) -> DataFrame:
    """``_key``, ``_h``, set size, 128-bit name of the set, its minima, a byte of each, and 32 bits of each tree's, of each row (``_key``, ``_h``, ``_text``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, names, sigs, short, trees = [], [], [], [], []
            for t in b.column(2):
                s = shingles(t.as_py(), size)
                least = minima(s, odd) if len(s) else None
                sizes.append(len(s))
                names.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                sigs.append(least.tobytes() if len(s) else None)
                short.append(least.astype("u1").tobytes() if len(s) else None)
                trees.append((least.reshape(-1, DEPTH) * mix).sum(1, dtype="u4").tobytes() if len(s) else None)
            made = [pa.array(sizes, pa.int64()), *[pa.array(x, pa.binary()) for x in (names, sigs, short, trees)]]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["_key", "_h", "_n", "_name", "_minima", "_sig", "_trees"])

    mix = multipliers(DEPTH, size).astype("u4")  # odd: minima that differ in one place never agree
    kind = rows.schema["_key"].dataType.simpleString()
    return rows.select("_key", "_h", "_text").mapInArrow(run, f"_key {kind}, _h long, _n long, _name binary, _minima binary, _sig binary, _trees binary")


# ---- the forest --------------------------------------------------------------------------------


def _planted(sets: DataFrame, depth: int, trees: int) -> DataFrame:
    """(region, node): the region of each set (node, _minima) in each tree, named by a hash of its minima with the tree in the last byte."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = np.arange(trees, dtype=np.uint64)
        for b in batches:
            if not b.num_rows:
                continue
            own = np.frombuffer(b"".join(x.as_buffer() for x in b.column(1)), "<u4").reshape(b.num_rows, -1)[:, : trees * depth].reshape(b.num_rows, trees, depth)
            h = np.broadcast_to((tree + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), (b.num_rows, trees))
            with np.errstate(over="ignore"):
                for d in range(depth):
                    h = (h ^ own[:, :, d]) * np.uint64(0xC2B2AE3D27D4EB4F)
                    h = h ^ (h >> np.uint64(29))
            h = (h & ~np.uint64(0xFF)) | tree  # 256 trees at most
            node = np.repeat(b.column(0).to_numpy(), trees)
            yield pa.RecordBatch.from_arrays([pa.array(h.ravel().view(np.int64)), pa.array(node)], names=["region", "node"])

    return sets.select("node", "_minima").mapInArrow(run, "region long, node long")


def _tree_order(region: Column, sig: Column) -> Column:
    """A tree's sequence of the signature's bytes: it starts with the tree's own minima."""
    at = F.pmod(region.bitwiseAND(0xFF) * DEPTH, F.lit(HASHES)).cast("int")
    return F.concat(F.substring(sig, at + 1, F.length(sig)), F.substring(sig, F.lit(1), at))


def _bytes(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(x.as_buffer() for x in column), "u1").reshape(len(column), -1)


def _agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(-1)


def _sizes_fit(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sizes alone do not rule a pair out."""
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def least_agreement(similarity: float, hashes: int = HASHES) -> int:
    """Minima that a pair of that similarity has in common, less ``SIGMAS`` standard deviations."""
    return max(1, int(np.floor(hashes * similarity - SIGMAS * np.sqrt(hashes * similarity * (1 - similarity)))))


def _neighbours(forest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, same): neighbours in the order of each region, with the minima that they have in common.

    Regions are ranges of one order, cut anywhere: a neighbour across a cut is left to the search of regions.
    """

    least = least_agreement(percent / 100)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: tuple | None = None
        for b in batches:
            if not b.num_rows:
                continue
            rows = (*[b.column(i).to_numpy() for i in range(3)], _bytes(b.column(3)))
            if before is not None:
                rows = tuple(np.concatenate(x) for x in zip(before, rows, strict=True))
            region, node, size, sig = rows
            same = _agreement(sig[1:], sig[:-1])
            ok = (region[1:] == region[:-1]) & (same >= least) & _sizes_fit(size[1:], size[:-1], percent)
            x, y = node[1:][ok], node[:-1][ok]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(same[ok])], names=["a", "b", "same"])
            before = tuple(x[-1:] for x in rows)

    # signatures of one region are turned alike, so that turned ones agree as often
    rows = forest.join(sets.select("node", "_n", "_sig"), "node").select("region", "node", "_n", _tree_order(F.col("region"), F.col("_sig")).alias("_order"))
    n = shuffle_partitions(sets.sparkSession)
    rows = rows.repartitionByRange(n, "region", "_order", "node").sortWithinPartitions("region", "_order", "node")
    return rows.mapInArrow(run, "a long, b long, same long").distinct()


def _first_met(region: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the region's tree is the first in which the rows ``a`` and ``b`` (``_trees``) meet."""
    return (a == b).argmax(1) == (region & 0xFF)


def _joining(left: np.ndarray, right: np.ndarray, group: np.ndarray, sets: list[np.ndarray], percent: int) -> np.ndarray:
    """(left, right, sure): of pairs of rows those that join classes (``group``) by their full sets, and as not sure all with a set that is not here."""
    size = np.array([len(x) for x in sets])
    here = (size[left] > 0) & (size[right] > 0)
    out = [np.stack((left[~here], right[~here], np.zeros((~here).sum(), np.int64)), 1)]
    left, right = left[here], right[here]
    order = np.argsort(left, kind="stable")
    left, right = left[order], right[order]
    group = group.copy()
    first = np.flatnonzero(np.diff(left, prepend=-1))
    for at, end in zip(first.tolist(), np.append(first, len(left))[1:].tolist(), strict=True):
        i, js = int(left[at]), right[at:end]
        js = js[group[js] != group[i]]
        for part in np.array_split(js, len(js) // 500 + 1):
            if not len(part):
                continue
            theirs = np.concatenate([sets[j] for j in part])
            hit = sets[i][np.minimum(np.searchsorted(sets[i], theirs), size[i] - 1)] == theirs
            common = np.add.reduceat(hit.astype(np.int64), np.cumsum(size[part]) - size[part])
            for j in part[100 * common >= percent * (size[i] + size[part] - common)].tolist():
                if group[j] != group[i]:
                    group[group == group[j]] = group[i]
                    out.append(np.array([[i, j, 1]]))
    return np.concatenate(out)


def _as_pairs(node: np.ndarray, rows: np.ndarray) -> pa.Table:
    x, y = node[rows[:, 0]], node[rows[:, 1]]
    return pa.table({"a": np.minimum(x, y), "b": np.maximum(x, y), "sure": rows[:, 2].astype(bool)})


def _sets_here(column: pa.ChunkedArray) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), np.uint64) if x.is_valid else np.zeros(0, np.uint64) for x in column]


PAIRS = "a long, b long, sure boolean"
MEMBER = ("region", "node", "group", "_n", "_sig", "_trees", "_short")


def _searched(members: DataFrame, percent: int, base: bool) -> DataFrame:
    """(a, b, sure): pairs that join classes of each bounded region of the rows ``MEMBER``.

    In the first forest (``base``) a pair counts where it meets first, and is confirmed there if its sets are short.
    """
    least = least_agreement(percent / 100)

    def search(rows: pa.Table) -> pa.Table:
        region, node, group, n = (rows.column(i).to_numpy() for i in range(4))
        sig, trees = _bytes(rows.column(4)), _bytes(rows.column(5)).view("<u4")
        first = np.flatnonzero(np.append(True, region[1:] != region[:-1]))
        size = np.diff(np.append(first, len(region)))
        after = np.repeat(first + size, size) - np.arange(len(region))  # rows of the region from this one on
        out = [np.zeros((0, 2), np.int64)]
        for lag in range(1, int(size.max())):
            left = np.flatnonzero(after > lag)
            left = left[(group[left] != group[left + lag]) & _sizes_fit(n[left], n[left + lag], percent)]
            for at in range(0, len(left), 50_000):
                i = left[at : at + 50_000]
                i = i[_agreement(sig[i], sig[i + lag]) >= least]
                if base:
                    i = i[_first_met(region[i], trees[i], trees[i + lag])]
                out.append(np.stack((i, i + lag), 1))
        pairs = np.concatenate(out)
        if not base:
            return _as_pairs(node, np.column_stack((pairs, np.zeros(len(pairs), np.int64))))
        return _as_pairs(node, _joining(pairs[:, 0], pairs[:, 1], group, _sets_here(rows.column(6)), percent))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []  # the last region may go on in the next batch
        for b in batches:
            if not b.num_rows:
                continue
            rows = pa.Table.from_batches([*kept, b])
            region = rows.column(0).to_numpy()
            cut = int(np.flatnonzero(region == region[-1])[0])
            if cut:
                yield from search(rows.slice(0, cut)).to_batches()
            kept = rows.slice(cut).to_batches()
        if kept:
            yield from search(pa.Table.from_batches(kept)).to_batches()

    n = shuffle_partitions(members.sparkSession)
    return members.select(*MEMBER).repartition(n, "region").sortWithinPartitions("region").mapInArrow(run, PAIRS)


def _block_by_block(members: DataFrame, sizes: DataFrame, region: int, percent: int, base: bool) -> DataFrame:
    """(a, b, sure): as ``_searched`` of dense regions (region, size). Members are dealt to blocks of bounded size,
    and each pair of blocks is a group of its own."""
    least = least_agreement(percent / 100)
    blocks = sizes.select(F.col("region").alias("_r"), F.ceil(F.col("size") / region).cast("int").alias("_blocks"))
    rows = members.join(blocks, members["region"] == F.col("_r")).withColumn("_mine", F.pmod(F.xxhash64("node"), F.col("_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("_other")
    rows = rows.select(*MEMBER, "_mine", other)
    rows = rows.select(*MEMBER, F.least("_mine", "_other").alias("_x"), F.greatest("_mine", "_other").alias("_y"), "_mine")

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        x, y = key[1].as_py(), key[2].as_py()
        at, block, node, group, n = (table.column(c).to_numpy() for c in ("region", "_mine", "node", "group", "_n"))
        sig, trees, out = _bytes(table.column("_sig")), _bytes(table.column("_trees")).view("<u4"), [np.zeros((0, 2), np.int64)]
        others = np.flatnonzero(block == y)
        for i in np.flatnonzero(block == x).tolist():
            k = others[(group[others] != group[i]) & ((node[others] > node[i]) | (x != y))]
            k = k[_sizes_fit(n[k], n[i], percent)]
            k = k[_agreement(sig[k], sig[i]) >= least]
            if base:
                k = k[_first_met(at[k], trees[k], trees[i])]
            out.append(np.stack((np.full(len(k), i), k), 1))
        pairs = np.concatenate(out)
        return _as_pairs(node, _joining(pairs[:, 0], pairs[:, 1], group, _sets_here(table.column("_short")), percent))

    return rows.groupBy("region", "_x", "_y").applyInArrow(run, PAIRS)


# ---- confirmation ------------------------------------------------------------------------------


def _confirmed(pairs: DataFrame, full: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, _set) have ``percent`` hundredths of their union in common."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")  # two sorted runs: merged
                common = int((both[1:] == both[:-1]).sum())
                keep[i] = 100 * common >= percent * (len(both) - common)
            yield b.select(["a", "b"]).filter(pa.array(keep))

    left = full.select(F.col("node").alias("a"), F.col("_set").alias("_x"))
    right = full.select(F.col("node").alias("b"), F.col("_set").alias("_y"))
    return pairs.select("a", "b").join(left, "a").join(right, "b").select("a", "b", "_x", "_y").mapInArrow(run, "a long, b long")


#: Links, 16 bytes each, that one task brings together; more go through rounds of joins.
LINKS_AT_ONCE = 1_000_000


def _classes(links: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """(_node, _root): the smallest node of each class of linked nodes."""
    links = written(links.select("a", "b").distinct(), "minhash-links")
    if links.count() > at_once:
        return components(links, "minhash-links").select(F.col("node").alias("_node"), F.col("root").alias("_root"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(x), find(y)
                root[max(x, y)] = min(x, y)
        if root:
            nodes = list(root)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], names=["_node", "_root"])

    return links.repartition(1).mapInArrow(run, "_node long, _root long")  # at_once links at most


def _grouped(rows: DataFrame, classes: DataFrame, node: str, name: str) -> DataFrame:
    return rows.join(classes, rows[node] == classes["_node"], "left").withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")


def _between(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs whose ends are in different classes, with these as ``ga`` and ``gb``."""
    return _grouped(_grouped(pairs, classes, "a", "ga"), classes, "b", "gb").where("ga <> gb")


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    size: int = 2,
    percent: int = 80,
    region: int = REGION,
    deeper: tuple[tuple[int, int], ...] = DEEPER,
    rounds: int = ROUNDS,
    seed: int = 20,
    blocks: int = BLOCKS,
) -> DataFrame:
    """(key, n_shingles, component_id, kept) per row: the size of the text's set of distinct ``size``-word shingles (of
    lower-cased A-Z; fewer words are one shingle), the smallest key reachable over texts whose sets
    have ``percent`` hundredths of their union in common, and whether that is the row's own key.

    Equal sets are one node, so that copies never meet. Texts without words (null, empty, blank) have no set and are
    linked with nothing, not even with each other. Repeated rows are rows of their own. A row without key takes
    its class's smallest key, if any, and is kept if there is none; rows that repeat the smallest key are all kept.
    An empty table gives no rows; other columns are not read. Shingles are told apart by 64-bit
    hashes within a pair. Links are found with the probability that the module states; none that is given is false.
    """
    body = F.col(text).cast("binary")
    raw = docs.select(F.col(key).alias("_key"), F.xxhash64(body).alias("_h"), body.alias("_text"))
    rows = written(_signed(raw, size, multipliers(HASHES, seed)), "minhash-rows")
    one = F.min(F.struct(F.col("_key").alias("_one_key"), F.col("_h").alias("_text_hash"))).alias("_one")
    sets = rows.where(F.col("_name").isNotNull()).groupBy("_name").agg(one, F.min("_key").alias("_first"), *[F.first(c).alias(c) for c in ("_n", "_minima", "_sig", "_trees")])
    sets = sets.select("_name", "_one.*", "_n", "_minima", "_sig", "_trees", "_first", F.monotonically_increasing_id().alias("node"))
    sets = written(sets, "minhash-sets")  # numbered once, as written
    # regions of several texts; the others are done with
    planted = written(_planted(sets, DEPTH, HASHES // DEPTH), "minhash-planted")
    sizes = planted.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    forest = written(planted.join(sizes.select("region"), "region", "left_semi"), "minhash-forest")
    involved = sets.join(forest.select("node").distinct(), "node", "left_semi")
    full = _full_sets(raw, involved, size)

    # neighbours: the best candidates of each class, a few rounds, then what is left of them
    candidates = written(_neighbours(forest, sets, percent), "minhash-neighbours")
    links = written(candidates.limit(0).select("a", "b"), "minhash-confirmed")
    classes = written(_classes(links), "minhash-classes")
    for turn in range(rounds):
        open_ = _between(candidates, classes)
        if turn < rounds - 1:
            ends = open_.select("a", "b", "same", F.explode(F.array("a", "b")).alias("end"))
            best = ends.groupBy("end").agg(F.max(F.struct("same", "a", "b")).alias("best")).select("best.a", "best.b").distinct()
        else:
            best = open_.select("a", "b")
        best = written(best, "minhash-best")
        if best.isEmpty():
            break
        links = written(links.unionAll(_confirmed(best, full, percent)), "minhash-confirmed")
        candidates = written(candidates.join(best, ["a", "b"], "left_anti"), "minhash-neighbours")
        classes = written(_classes(links), "minhash-classes")

    found = written(_all_regions(forest, sets, classes, full, percent, region, deeper, seed, blocks), "minhash-found")
    open_ = _confirmed(found.where("NOT sure").select("a", "b").distinct(), full, percent)
    links = written(links.unionAll(found.where("sure").select("a", "b")).unionAll(open_), "minhash-confirmed")
    classes = written(_classes(links), "minhash-classes")

    rooted = _grouped(sets.select("_name", "_first", "node"), classes, "node", "_root_node")
    smallest = rooted.groupBy("_root_node").agg(F.min("_first").alias("_component"))
    named = rooted.join(smallest, "_root_node").select(F.col("_name").alias("_set"), "_component")
    out = rows.select("_key", "_n", "_name").join(named, F.col("_name") == F.col("_set"), "left")
    component = F.when(F.col("_name").isNull(), F.col("_key")).otherwise(F.col("_component"))
    return out.select(F.col("_key").alias(key), F.col("_n").alias("n_shingles"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


def _full_sets(raw: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """(node, _set): the full sets of the nodes of ``wanted``, worked out anew from one text of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t.as_py(), size) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "_set"])

    at = wanted.select(F.col("_one_key").alias("_k"), F.col("_text_hash"), "node")
    texts = raw.join(at, raw["_key"].eqNullSafe(at["_k"]) & (raw["_h"] == at["_text_hash"])).select("node", "_text")
    return written(texts.dropDuplicates(["node"]).mapInArrow(run, "node long, _set binary"), "minhash-full")


def _all_regions(forest: DataFrame, sets: DataFrame, classes: DataFrame, full: DataFrame, percent: int, region: int, deeper: tuple[tuple[int, int], ...], seed: int, blocks: int) -> DataFrame:
    """(a, b, sure): pairs that join classes, of all regions: bounded ones whole, dense ones in blocks, denser ones by deeper forests."""
    found, base = None, True
    short = full.where(F.length("_set") <= 8 * SHORT_SET).select("node", F.col("_set").alias("_short"))
    sig = sets.select("node", "_n", "_sig", "_trees").join(full.select("node"), "node", "left_semi").join(short, "node", "left")
    levels = list(deeper)
    while True:
        grouped = _grouped(forest, classes, "node", "group")
        mixed = grouped.groupBy("region").agg(F.count(F.lit(1)).alias("size"), F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi").select("region", "size")
        mixed = written(mixed, "minhash-mixed")
        few = grouped.join(mixed.where(F.col("size") <= region).select("region"), "region", "left_semi")
        pairs = _searched(few.join(sig, "node"), percent, base)
        # blocks where all is compared once at most, that is in the first forest, or where no deeper one is left
        crowded = F.col("size") > (region * blocks if base and levels else region)
        dense = mixed.where((F.col("size") > region) & (~crowded if levels else F.lit(True)))
        if (base or not levels) and not dense.isEmpty():
            many = grouped.join(dense.select("region"), "region", "left_semi")
            pairs = pairs.unionAll(_block_by_block(many.join(sig, "node"), dense, max(1, region // 2), percent, base))
        found = pairs if found is None else found.unionAll(pairs)
        if not levels or mixed.where(crowded).isEmpty():
            return found.distinct()
        depth, trees = levels.pop(0)
        crowd = written(grouped.join(mixed.where(crowded).select("region"), "region", "left_semi").select("node").distinct(), "minhash-crowd")
        forest, base = written(_deeper(crowd, full, depth, trees, seed + depth), "minhash-forest"), False


def _deeper(crowd: DataFrame, full: DataFrame, depth: int, trees: int, seed: int) -> DataFrame:
    """Regions of several texts in a forest of ``trees`` trees of ``depth`` over the sets of ``crowd``."""
    odd = multipliers(depth * trees, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sigs = [minima(np.frombuffer(x.as_buffer(), np.uint64), odd).tobytes() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigs, pa.binary())], names=["node", "_minima"])

    signed = full.join(crowd, "node", "left_semi").select("node", "_set").mapInArrow(run, "node long, _minima binary")
    planted = written(_planted(signed, depth, trees), "minhash-planted")
    sizes = planted.groupBy("region").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return planted.join(sizes.select("region"), "region", "left_semi")
