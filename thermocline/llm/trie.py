"""Prefix trie of conversations over padded matrices of turn ids.

A conversation is the sequence of its turns' ids (128-bit hashes of role and text). Sequences are
range-partitioned, so that every prefix is one stretch of their order. A shard numbers its turn ids
densely, pads the sequences to matrices (some columns at a time, of the rows that are as long), sorts them
by ``lexsort`` and marks where a column changes from row to row; these masks, OR-accumulated from left to
right, mark where the nodes of every depth start, and ``reduceat`` aggregates their rows.

Only the nodes on the paths of a shard's first and last row can go on in another shard. These
two paths, with what the shard knows of their nodes, are rows of the next level, where the same step combines
them, until one shard holds all; on the way back each shard's paths learn their final names. Two rows a
shard go up: no node, however many conversations share it, gathers its rows anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import shuffle_partitions, written

#: Columns of a padded matrix; turns that a shard has on average, and at least; rows of the last, single shard.
COLUMNS, SHARD_TURNS, LEAST_TURNS, LAST_ROWS = 32, 1_000_000, 2_000, 8_192
NO_ENDS = hashlib.sha256(b"").hexdigest()
_LARGEST = np.iinfo(np.int64).max

_PATH = "array<struct<a:long,b:long,w:long>>"
_SLOTS = ("members", "conv", "kids", "leaves", "saved")


# ---- sequences ---------------------------------------------------------------------------------


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, path): each conversation's turns in order, as two hashes of role and text and the text's words.

    Turns are ordered by number (null first; ties by the hashes). A null role or text is empty. Rows
    without a conversation's id belong to none. Repeated rows are turns of their own. Only one
    conversation's turns, 32 bytes each, are held at once.
    """
    said = (F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    words = F.regexp_count(said[1], F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("t"), F.xxhash64(F.lit(1), *said).alias("a"), F.xxhash64(F.lit(2), *said).alias("b"), words.alias("w"))
    path = F.transform(F.sort_array(F.collect_list(F.struct("t", "a", "b", "w"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"), x["w"].alias("w")))
    return rows.groupBy("conv_id").agg(path.alias("path"))


def with_shared_heads(seqs: DataFrame, every: int = 20, longest: int = 4) -> DataFrame:
    """Each conversation c with its first h turns replaced by those of conversation c - c % ``every`` (all it has, if
    fewer; none, if it is absent); h is the crc32 of c's decimal digits modulo ``longest``."""
    base = F.col("conv_id") - F.col("conv_id") % every
    heads = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), F.slice("path", 1, longest - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % longest).cast("int")
    rows = seqs.join(heads, base == F.col("_base"), "left")
    head = F.when(h > 0, F.slice(F.coalesce("_head", F.array().cast(_PATH)), F.lit(1), h)).otherwise(F.array().cast(_PATH))
    return rows.select("conv_id", F.concat(head, F.slice("path", h + 1, F.greatest(F.size("path"), F.lit(1)))).alias("path"))


# ---- one shard ---------------------------------------------------------------------------------


class Rows:
    """Sequences of a shard, end to end, with what is known of each row's nodes (a slot per depth from 0)."""

    def __init__(self, lens: np.ndarray, turns: np.ndarray, slots: dict[str, np.ndarray]):
        self.lens, self.turns, self.slots = lens, turns, slots
        self.at = np.cumsum(lens) - lens  # a row's first turn; its first slot is one further for each row before it
        by = np.lexsort((turns[:, 1], turns[:, 0]))  # dense numbers in the order of the ids, from 1
        new = np.ones(len(by), bool)
        new[1:] = (turns[by][1:, :2] != turns[by][:-1, :2]).any(1)
        self.ids = np.empty(len(by), np.int64)
        self.ids[by] = np.cumsum(new)

    def padded(self, rows: np.ndarray, first: int) -> np.ndarray:
        """Matrix of turn ids of ``rows`` from column ``first`` on, 0 beyond a row's end."""
        column = first + np.arange(COLUMNS)
        inside = column < self.lens[rows][:, None]
        return np.where(inside, self.ids[np.where(inside, self.at[rows][:, None] + column, 0)], 0)

    def slot(self, name: str, rows: np.ndarray, depth: int) -> np.ndarray:
        return self.slots[name][self.at[rows] + rows + depth]

    def sorted(self, ties: np.ndarray) -> np.ndarray:
        """Order of the rows: by their sequences, a prefix first, then by ``ties``. Columns are taken from the
        last to the first; rows that have none of them stay in place, before the others."""
        order = np.argsort(ties, kind="stable")
        for first in range((int(self.lens.max()) - 1) // COLUMNS * COLUMNS, -1, -COLUMNS):
            long = self.lens[order] > first
            rows = order[long]
            order = np.concatenate((order[~long], rows[np.lexsort(self.padded(rows, first).T[::-1])]))
        return order


class Depth:
    """The nodes of one depth in order: rows, node of each row, parents and sums of the rows' slots."""

    def __init__(self, data: Rows, depth: int, rows: np.ndarray, starts: np.ndarray, above: np.ndarray):
        self.rows, self.node = rows, np.cumsum(starts) - 1
        first = np.flatnonzero(starts)
        self.parent = above[first]
        sums = {n: np.add.reduceat(data.slot(n, rows, depth), first) for n in _SLOTS if n != "conv"}
        self.members, self.kids, self.leaves, self.saved = (sums[n] for n in ("members", "kids", "leaves", "saved"))
        self.conv = np.minimum.reduceat(data.slot("conv", rows, depth), first)
        self.words = data.turns[data.at[rows[first]] + depth - 1, 2] if depth else np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.parent)


def depths(data: Rows, order: np.ndarray) -> list[Depth]:
    """The nodes of every depth of the sorted rows."""
    start = np.zeros(len(order), bool)
    start[0] = True
    out = [Depth(data, 0, order, start, np.zeros(len(order), np.int64))]
    rows, above = order, out[0].node
    for first in range(0, int(data.lens.max()), COLUMNS):
        long = data.lens[rows] > first
        rows, above = rows[long], above[long]
        ids = data.padded(rows, first)
        change = np.ones(ids.shape, bool)
        change[1:] = ids[1:] != ids[:-1]
        change[1:, 0] |= above[1:] != above[:-1]
        change = np.logical_or.accumulate(change, axis=1)
        for j in range(COLUMNS):
            live = ids[:, j] > 0
            if not live.any():
                break
            node = Depth(data, first + j + 1, rows[live], change[live, j], above[live])
            above = np.zeros(len(rows), np.int64)
            above[live] = node.node
            out.append(node)
        else:
            continue
        break
    return out


def _add_up(into: np.ndarray, parent: np.ndarray, values: np.ndarray) -> None:
    """Adds children's values to their parents (children of one parent stand together)."""
    if len(parent):
        first = np.flatnonzero(np.diff(parent, prepend=-1))
        into[parent[first]] += np.add.reduceat(values, first)


def _lists(counts: list[int], flat: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(flat, pa.int64()))


_OUT = pa.schema(
    [("kind", pa.int32()), ("pos", pa.int64()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(n, pa.int64()) for n in ("n_convs", "n_children", "n_leaves", "saved_tokens", "first")]
    + [("ends", pa.string()), ("from_first", pa.int32())]
    + [("path", pa.list_(pa.struct([(n, pa.int64()) for n in "abw"])))]
    + [(f"s_{n}", pa.list_(pa.int64())) for n in _SLOTS]
)
_OUT_DDL = (
    "kind int, pos long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, first long, ends string, from_first int, "
    + f"path {_PATH}, "
    + ", ".join(f"s_{n} array<long>" for n in _SLOTS)
)
NODE, PATH, NAMES, ENDS = range(4)


def _rows_out(n: int, **columns) -> pa.RecordBatch:
    arrays = [columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays([a if isinstance(a, pa.Array) else pa.array(a, f.type) for a, f in zip(arrays, _OUT, strict=True)], schema=_OUT)


def shard_nodes(data: Rows, order: np.ndarray, shard: int, last: bool, convs: np.ndarray | None, pos: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """What a shard gives: its complete nodes (``NODE``; a parent that is not complete is named by the path it is
    on), its two paths (``PATH``), the names of its rows' nodes (``NAMES``, for rows that are paths themselves, known by
    ``pos``), and the conversations that end at its paths' nodes (``ENDS``, for rows that are conversations)."""
    tree = depths(data, order)
    top, bottom = order[0], order[-1]
    on_first = [not last and d <= data.lens[top] for d in range(len(tree))]
    on_last = [not last and d <= data.lens[bottom] for d in range(len(tree))]
    side = []  # by depth: 0 or 1 for nodes on the first or (else) the last path, -1 for complete ones
    for d, level in enumerate(tree):
        s = np.full(len(level), -1)
        if on_last[d]:
            s[-1] = 1
        if on_first[d]:
            s[0] = 0
        side.append(s)
    for d in range(len(tree) - 1, -1, -1):  # children are done before their parents
        level, whole = tree[d], side[d] < 0
        if d + 1 < len(tree):
            below = tree[d + 1]
            done = side[d + 1] < 0
            _add_up(level.kids, below.parent[done], np.ones(int(done.sum()), np.int64))
            _add_up(level.leaves, below.parent[done], below.leaves[done])
            _add_up(level.saved, below.parent[done], below.saved[done])
        level.leaves += whole & (level.kids == 0)
        level.saved += np.where(whole, (level.members - 1) * level.words, 0)
    digests: dict[tuple[int, int], str] = {}
    if convs is not None:  # conversations that end at a node stand together, by number
        pieces = []
        for d, level in enumerate(tree):
            ends = data.lens[level.rows] == d
            if not ends.any():
                continue
            node, ids = level.node[ends], convs[level.rows[ends]]
            cut = np.flatnonzero(np.diff(node, prepend=-1))
            for k, part in zip(node[cut].tolist(), np.split(ids, cut[1:]), strict=True):
                said = ",".join(map(str, part.tolist()))
                if side[d][k] < 0:
                    digests[d, k] = hashlib.sha256(said.encode()).hexdigest()
                else:
                    pieces.append((2 * shard + int(side[d][k]), d, int(part[0]), said))
        if pieces:
            p, d, f, t = zip(*pieces, strict=True)
            yield _rows_out(len(p), kind=np.full(len(p), ENDS), pos=p, depth=d, first=f, ends=t)
    for d, level in enumerate(tree):
        whole = np.flatnonzero(side[d] < 0)
        if not len(whole):
            continue
        parent, known = pa.nulls(len(whole), pa.int64()), pa.nulls(len(whole), pa.int64())
        if d:
            up = level.parent[whole]
            open_ = side[d - 1][up] >= 0
            parent = pa.array(tree[d - 1].conv[up], pa.int64(), mask=open_)
            known = pa.array(2 * shard + side[d - 1][up], pa.int64(), mask=~open_)
        ends = pa.array([digests.get((d, k), NO_ENDS) for k in whole.tolist()]) if convs is not None else pa.nulls(len(whole), pa.string())
        sums = dict(n_convs=level.members[whole], n_children=level.kids[whole], n_leaves=level.leaves[whole], saved_tokens=level.saved[whole])
        yield _rows_out(len(whole), kind=np.full(len(whole), NODE), pos=known, depth=np.full(len(whole), d), conv_id=level.conv[whole], parent_conv_id=parent, ends=ends, **sums)
    if not last:
        for s, row in ((0, top), (1, bottom)):
            own = [d for d in range(int(data.lens[row]) + 1) if side[d][0 if s == 0 else -1] == s]
            if not own:
                continue  # the last path is the first
            n = int(data.lens[row]) + 1
            slots = {x: np.full(n, _LARGEST if x == "conv" else 0) for x in _SLOTS}
            for d in own:
                for x in _SLOTS:
                    slots[x][d] = getattr(tree[d], x)[0 if s == 0 else -1]
            turns = data.turns[data.at[row] : data.at[row] + n - 1]
            path = pa.ListArray.from_arrays(pa.array([0, n - 1], pa.int32()), pa.StructArray.from_arrays([pa.array(turns[:, i]) for i in range(3)], names=list("abw")))
            yield _rows_out(1, kind=[PATH], pos=[2 * shard + s], path=path.cast(_OUT.field("path").type), **{f"s_{x}": _lists([n], slots[x]) for x in _SLOTS})
    if pos is not None:  # names by row and depth; those of the shard's own paths are filled in later
        n = data.lens + 1
        start = np.cumsum(n) - n
        names, mask, first = np.zeros(int(n.sum()), np.int64), np.zeros(int(n.sum()), bool), np.zeros(len(n), np.int32)
        for d, level in enumerate(tree):
            where = start[level.rows] + d
            names[where] = level.conv[level.node]
            mask[where] = side[d][level.node] >= 0
            first[level.rows] += side[d][level.node] == 0
        named = pa.ListArray.from_arrays(pa.array(np.append(start, n.sum()), pa.int32()), pa.array(names, pa.int64(), mask=mask))
        yield _rows_out(len(n), kind=np.full(len(n), NAMES), pos=pos, first=np.full(len(n), shard), from_first=first, s_conv=named)


def _flat(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(turns of each row, all turns as rows of a, b, w)."""
    path = table.column("path").combine_chunks()
    turns = path.flatten()
    return pc.list_value_length(path).to_numpy(zero_copy_only=False).astype(np.int64), np.stack([turns.field(i).to_numpy(zero_copy_only=False) for i in range(3)], 1).astype(np.int64)


def _level(rows: DataFrame, last: bool, of_paths: bool) -> DataFrame:
    """What the shards, one per partition, give."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b for b in batches if b.num_rows]
        if not parts:
            return
        table = pa.Table.from_batches(parts)
        lens, turns = _flat(table)
        shard = TaskContext.get().partitionId()
        if of_paths:
            pos = table.column("pos").to_numpy()
            data = Rows(lens, turns, {x: table.column(f"s_{x}").combine_chunks().flatten().to_numpy(zero_copy_only=False) for x in _SLOTS})
            yield from shard_nodes(data, np.argsort(pos), shard, last, None, pos)
        else:
            convs = table.column("conv_id").to_numpy()
            zero = np.zeros(len(turns) + len(lens), np.int64)
            slots = {"members": zero + 1, "conv": np.repeat(convs, lens + 1), "kids": zero, "leaves": zero, "saved": zero}
            data = Rows(lens, turns, slots)
            yield from shard_nodes(data, data.sorted(convs), shard, last, convs, None)

    return rows.mapInArrow(run, _OUT_DDL)


# ---- the whole ---------------------------------------------------------------------------------


def _named(paths: DataFrame, shard_turns: int, last_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """((pos, conv array by depth) of all ``paths``, tables of nodes): combines paths shard by shard."""
    size = paths.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("path") + 1), F.lit(0)).alias("turns")).first()
    columns = ["pos", "path", *[f"s_{x}" for x in _SLOTS]]
    last = size["rows"] <= 8 or (size["rows"] <= last_rows and size["turns"] <= 4 * shard_turns)
    if last:
        out = written(_level(paths.select(*columns).repartition(1), True, True), "trie-level")
    else:
        # at least four paths a shard, which gives two: every level halves them
        n = min(size["rows"] // 4, max(2, size["turns"] // shard_turns, 2 * size["rows"] // last_rows))
        out = written(_level(paths.select(*columns).repartitionByRange(n, "pos"), False, True), "trie-level")
    names, nodes = out.where(F.col("kind") == NAMES), out.where(F.col("kind") == NODE)
    if last:
        return names.select("pos", F.col("s_conv").alias("names")), [nodes]
    above, more = _named(out.where(F.col("kind") == PATH), shard_turns, last_rows)
    above = written(above, "trie-names")
    one = above.select(F.col("pos").alias("_p0"), F.col("names").alias("_first"))
    two = above.select(F.col("pos").alias("_p1"), F.col("names").alias("_last"))
    both = names.join(one, F.col("first") * 2 == one["_p0"]).join(two, F.col("first") * 2 + 1 == two["_p1"], "left")
    filled = F.transform("s_conv", lambda c, d: F.coalesce(c, F.when(d < F.col("from_first"), F.get("_first", d)).otherwise(F.get("_last", d))))
    return both.select("pos", filled.alias("names")), [_with_parents(nodes, above), *more]


def _with_parents(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """Parents that were on a shard's path get their names."""
    n = names.select(F.col("pos").alias("_pos"), "names")
    parent: Column = F.coalesce("parent_conv_id", F.get("names", (F.col("depth") - 1).cast("int")))
    return nodes.join(n, nodes["pos"] == n["_pos"], "left").withColumn("parent_conv_id", parent).drop("_pos", "names")


def _digests(pieces: DataFrame, partitions: int) -> DataFrame:
    """(_c, _d, ends): SHA-256 of each node's pieces in order, joined by commas; one piece is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            out = []
            for c, d, said in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3), strict=True):
                if (c, d) != now:
                    if now is not None:
                        out.append((*now, digest.hexdigest()))
                    now, digest = (c, d), hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(said.as_buffer())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["_c", "_d", "digest"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now[0]]), pa.array([now[1]]), pa.array([digest.hexdigest()])], names=["_c", "_d", "digest"])

    ordered = pieces.repartition(partitions, "_c", "_d").sortWithinPartitions("_c", "_d", "first")
    return ordered.select("_c", "_d", "first", "ends").mapInArrow(run, "_c long, _d long, digest string")


def prefix_trie(seqs: DataFrame, shard_turns: int = SHARD_TURNS, least_turns: int = LEAST_TURNS, last_rows: int = LAST_ROWS) -> DataFrame:
    """One row per node of the trie of ``seqs`` (conv_id, path; see ``sequences``), each conversation once.

    conv_id, the smallest member; depth; parent_conv_id, the parent's conv_id (root: null); n_convs, members;
    n_children; n_leaves, childless nodes in the subtree, itself included; saved_tokens, the subtree's sum of
    (n_convs - 1) times the words of a node's last turn; ends_sha256, lower-case SHA-256 of the decimal ids of
    the conversations that end at the node, ascending, joined by commas.

    Conversations without turns are members of the root. Equal sequences share all nodes. An empty table has
    no nodes. One conversation of any length is held by one task; the digest of one node's ends is worked out by
    one task, as the hash is sequential, from pieces that shards have joined.
    """
    spark = seqs.sparkSession
    seqs = written(seqs.select("conv_id", "path"), "trie-sequences")
    turns = seqs.agg(F.coalesce(F.sum(F.size("path") + 1), F.lit(0)).alias("n")).first()["n"]
    n = max(1, turns // shard_turns, min(shuffle_partitions(spark), turns // least_turns))
    rows = seqs.repartitionByRange(n, "path", "conv_id") if n > 1 else seqs.repartition(1)  # one: shard_turns turns at most
    out = written(_level(rows, n == 1, False), "trie-level")
    nodes = out.where(F.col("kind") == NODE)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    ends = F.col("ends").alias("ends_sha256")
    if n == 1:
        return nodes.select(*columns, ends)
    names, above = _named(out.where(F.col("kind") == PATH), shard_turns, last_rows)
    names = written(names, "trie-names")
    by_pos = names.select(F.col("pos").alias("_pos"), "names")
    pieces = out.where(F.col("kind") == ENDS).join(by_pos, F.col("pos") == F.col("_pos"))
    digests = _digests(pieces.select(F.get("names", F.col("depth").cast("int")).alias("_c"), F.col("depth").alias("_d"), "first", "ends"), shuffle_partitions(spark))
    done = _with_parents(nodes, names).select(*columns, ends)
    for part in above:  # nodes on shards' paths: few
        joined = part.join(digests, (part["conv_id"] == digests["_c"]) & (part["depth"] == digests["_d"]), "left")
        done = done.unionAll(joined.select(*columns, F.coalesce("digest", F.lit(NO_ENDS)).alias("ends_sha256")))
    return done
