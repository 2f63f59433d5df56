"""Token ids in binary files: frequency-ranked ids in a byte-aligned variable-length coding.

Ids are replaced by their rank in the corpus (0: the most frequent) and written in as many bytes
(1 to 4) as the rank needs. The lengths of four ids stand in one control byte, and all control
bytes of a block before its data bytes, so that a table lookup by control byte decodes four ids
at a time. A block holds whole documents in key order; blocks are rows of a Parquet file set,
written and read by Spark only, with the rank table beside them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thermocline.llm.common import scratch, shuffle_partitions, worker_state, written

END = 0
BLOCK_IDS = 1 << 20
#: Bytes of text that are split into pieces at once.
CHUNK = 6 << 20
#: Distinct pieces whose ids a worker process keeps from chunk to chunk.
KEPT_PIECES = 2_000_000


# ---- encoding of texts -------------------------------------------------------------------------

_PIECE_START = np.zeros(256, bool)  # bytes that begin a character which is no white space
_PIECE_START[0x21:0x7F] = True
_PIECE_START[0xC3:0xE0] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_SPACE, _LINE = 32, 10


def piece_starts(data: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Offsets at which the tokenizer's own word splitting is sure to begin a new word.

    These are document starts; a blank before a visible character (it joins this character's
    word); a full stop or comma after a letter; a line end between visible characters and what
    follows it. Other boundaries are left to the library.
    """
    cut = np.zeros(len(data), bool)
    visible, blank, line = _PIECE_START[data], data == _SPACE, data == _LINE
    cut[:-1] |= blank[:-1] & visible[1:]
    cut[1:] |= _LETTER[data[:-1]] & ((data[1:] == 44) | (data[1:] == 46))
    between = line[1:-1] & _PIECE_START[data[:-2]] & visible[2:]
    cut[1:-1] |= between
    cut[2:] |= between
    cut[docs[docs < len(data)]] = True
    return np.flatnonzero(cut)


class Encoder:
    """Texts to token ids; a piece that the worker has met before is looked up, others go through the library.

    Pieces are told apart by 64-bit hashes of their bytes and length (pieces of up to eight
    bytes of one length never share one).
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        vocab = self.library.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.library.get_added_tokens_decoder().values()}
        self.width = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.width[i] = len(token.encode()) if token in added else len(token)  # byte level: a character a byte
        self._forget()

    def _forget(self) -> None:
        self.keys, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.where, self.count, self.table = np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32)

    def _forget_unused(self) -> None:
        """Keeps the pieces that were looked up again since they were learnt or last kept; none if these are most."""
        kept = np.flatnonzero(self.used)
        if 2 * len(kept) > KEPT_PIECES:
            return self._forget()
        n, at = self.count[kept], self.where[kept]
        end = np.cumsum(n, dtype=np.int32)
        self.table = self.table[np.arange(end[-1] if len(end) else 0, dtype=np.int32) + np.repeat(at - (end - n), n)]
        self.keys, self.where, self.count, self.used = self.keys[kept], end - n, n, np.zeros(len(kept), bool)

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch(texts, add_special_tokens=False)]

    def _joined(self, pieces: list[bytes], between: bytes) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of all pieces and how many each has, from calls on a few hundred at a time."""
        if not pieces:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        ids = np.concatenate(self.plain([between.join(pieces[i : i + 256]).decode() + between.decode() for i in range(0, len(pieces), 256)]))
        ends = np.cumsum(self.width[ids])
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) + len(between)
        last = np.searchsorted(ends, np.cumsum(sizes))
        if ends[-1] != sizes.sum() or not np.array_equal(ends[last], np.cumsum(sizes)):
            return None  # a token crosses two pieces
        counts = np.diff(last, prepend=-1)
        if between:  # the line end after each piece is a token of its own
            ids, counts = np.delete(ids, last), counts - 1
        return ids, counts

    def _learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Adds the pieces (of these keys) to the table."""
        led = np.array([p[0] == _SPACE and len(p) > 1 and bool(_PIECE_START[p[1]]) for p in pieces], bool)
        free = np.array([bool(_PIECE_START[p[0]]) and p[-1] > 32 and (p[-1] < 127 or p[-2:-1] >= b"\xc3") for p in pieces], bool)
        for mask, between in ((led, b""), (free, b"\n"), (~led & ~free, None)):
            chosen = np.flatnonzero(mask)
            mine = [pieces[i] for i in chosen]
            got = self._joined(mine, between) if between is not None else None
            if got is None:
                each = self.plain([p.decode() for p in mine])
                got = np.concatenate([np.zeros(0, np.uint32), *each]), np.fromiter(map(len, each), np.int64, len(each))
            ids, n = got
            place = np.searchsorted(self.keys, keys[chosen])  # both are sorted
            begin = (len(self.table) + np.cumsum(n) - n).astype(np.int32)
            self.keys, self.where = np.insert(self.keys, place, keys[chosen]), np.insert(self.where, place, begin)
            self.count, self.used = np.insert(self.count, place, n.astype(np.int32)), np.insert(self.used, place, False)
            self.table = np.concatenate((self.table, ids))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        raw = [t.encode() for t in texts]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        blob = b"".join(raw)
        data = np.frombuffer(blob, np.uint8)
        if not len(data):
            return [np.zeros(0, np.uint32) for _ in texts]
        docs = np.cumsum(sizes) - sizes
        at = piece_starts(data, docs)
        lens = np.diff(at, append=len(data))
        keys, first, which = np.unique(self._hash(data, at, lens), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > KEPT_PIECES:
            self._forget_unused()
        place = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
        known = self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)
        self.used[place[known]] = True
        new = np.flatnonzero(~known)
        if len(new):
            self._learn(keys[new], [blob[a : a + n] for a, n in zip(at[first[new]].tolist(), lens[first[new]].tolist(), strict=True)])
        at_key = np.searchsorted(self.keys, keys)
        n = self.count[at_key][which]
        end = np.cumsum(n)
        flat = self.table[np.arange(end[-1], dtype=np.int32) + np.repeat(self.where[at_key][which] - (end - n).astype(np.int32), n)]
        before = np.concatenate(([0], end))[np.searchsorted(at, docs)]  # an empty text begins where the next one does
        return np.split(flat, before[1:])

    @staticmethod
    def _hash(data: np.ndarray, at: np.ndarray, lens: np.ndarray) -> np.ndarray:
        """64-bit hash of each piece: eight bytes at a time, mixed."""
        with np.errstate(over="ignore"):
            padded = np.concatenate((data, np.zeros(8, np.uint8)))
            words = np.lib.stride_tricks.sliding_window_view(padded, 8)
            h = lens.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            left, pos, live = lens.copy(), at.copy(), np.arange(len(at))
            while len(live):
                w = words[pos[live]].copy().view(np.uint64).ravel()
                short = left[live] < 8
                w[short] &= (np.uint64(1) << (left[live][short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
                x = (h[live] ^ w) * np.uint64(0xFF51AFD7ED558CCD)
                h[live] = x ^ (x >> np.uint64(32))
                pos[live] += 8
                left[live] -= 8
                live = live[left[live] > 0]
            return h


# ---- the byte coding ---------------------------------------------------------------------------

#: By control byte: the byte lengths of its four ids.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1


def pack(ranks: np.ndarray) -> bytes:
    """count (8 bytes), control bytes, data bytes."""
    n = len(ranks)
    r = ranks.astype("<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    quads = np.zeros(-(-n // 4) * 4, np.uint8)
    quads[:n] = extra
    control = (quads.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1).astype(np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4) <= extra[:, None]]
    return np.array([n], "<u8").tobytes() + control.tobytes() + data.tobytes()


def unpack(block: bytes) -> np.ndarray:
    n = int(np.frombuffer(block, "<u8", 1)[0])
    control = np.frombuffer(block, np.uint8, -(-n // 4), 8)
    lens = LENGTHS[control].ravel()[:n]
    data = np.concatenate((np.frombuffer(block, np.uint8, offset=8 + len(control)), np.zeros(4, np.uint8)))
    at = np.cumsum(lens) - lens
    out = data[at].astype(np.uint32)
    for k in range(1, 4):
        more = np.flatnonzero(lens > k)
        out[more] |= data[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _squeeze(ids: np.ndarray) -> bytes:
    small = len(ids) == 0 or ids.max() < 65536
    return (b"\x02" if small else b"\x04") + zstandard.compress(ids.astype("<u2" if small else "<u4").tobytes(), 1)


def _expand(b: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(b[1:]), "<u2" if b[0] == 2 else "<u4").astype(np.uint32)


# ---- Spark jobs --------------------------------------------------------------------------------


def encode_texts(docs: DataFrame, tokenizer: str, key: str, text: str) -> DataFrame:
    """(key, n, ids) of every whole text, with the end id; ids are compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = worker_state().setdefault(("encoder", tokenizer), None) or Encoder(tokenizer)
        worker_state()["encoder", tokenizer] = encoder
        keys: list = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            ids = [np.append(x, np.uint32(END)) for x in encoder.encode(texts)]
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([_squeeze(x) for x in ids], pa.binary())], names=["k", "n", "ids"])

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                t = t.as_py() or ""
                keys.append(k)
                texts.append(t)
                size += len(t)
                if size >= CHUNK:
                    yield flush()
                    keys, texts, size = [], [], 0
        if keys:
            yield flush()

    return docs.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t")).mapInArrow(run, "k long, n long, ids binary")


def rank_table(tokens: DataFrame) -> np.ndarray:
    """Ids by falling frequency over all texts; as long as the vocabulary at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                c = np.bincount(np.concatenate([_expand(x.as_py()) for x in b.column(0)[at : at + 500]]))
                if len(c) > len(total):
                    total = np.concatenate((total, np.zeros(len(c) - len(total), np.int64)))
                total[: len(c)] += c
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["id", "n"])

    counts = tokens.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = sorted((-r["n"], r["id"]) for r in counts.collect())  # bounded by the vocabulary
    return np.array([i for _, i in rows], np.uint32)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, key: str = "doc_id", text: str = "text") -> None:
    """Writes ``path/ranks`` and ``path/blocks``: the token ids of every text in ascending key order.

    Null and empty texts are the end id alone; null keys come first; rows that repeat a key
    follow each other in the order of their ids' hash; an empty table gives empty files.
    """
    spark = docs.sparkSession
    tokens = written(encode_texts(docs, tokenizer, key, text), "tokens")
    ranked = rank_table(tokens)
    spark.createDataFrame(pd.DataFrame({"rank": np.arange(len(ranked)), "id": ranked.astype(np.int64)}), "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")
    to_rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
    to_rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
    shared = spark.sparkContext.broadcast(to_rank)  # one number per id of the vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        ranks_of = shared.value
        keys: list = []
        docs_ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sizes = np.fromiter(map(len, docs_ids), np.uint32, len(docs_ids))
            body = pack(ranks_of[np.concatenate(docs_ids)])
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([int(sizes.sum())], pa.int64()), pa.array([keys], pa.list_(pa.int64())), pa.array([pack(sizes)], pa.binary()), pa.array([body], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["part", "seq", "n_ids", "keys", "sizes", "block"])

        for b in batches:
            for k, x in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                keys.append(k)
                docs_ids.append(_expand(x.as_py()))
                held += len(docs_ids[-1])
                if held >= BLOCK_IDS:
                    yield flush()
                    keys, docs_ids, held, seq = [], [], 0, seq + 1
        if keys:
            yield flush()

    tie = F.xxhash64("ids")
    ordered = tokens.repartitionByRange(shuffle_partitions(spark), F.col("k").asc_nulls_first(), tie).sortWithinPartitions(F.col("k").asc_nulls_first(), tie)
    blocks = ordered.select("k", "ids").mapInArrow(run, "part int, seq int, n_ids long, keys array<long>, sizes binary, block binary")
    blocks.write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(key, start, ids) per document from the files; ``start`` counts the ids of all documents before it."""
    blocks = spark.read.parquet(f"{path}/blocks")
    ids_of = np.array([r["id"] for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    parts = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}  # one row per file
    base, total = {}, 0
    for p in sorted(parts):
        base[p], total = total, total + parts[p]
    heads = blocks.select("part", "seq", "n_ids").withColumn("before", F.expr("sum(n_ids) over (partition by part order by seq rows between unbounded preceding and 1 preceding)"))
    shared = spark.sparkContext.broadcast((ids_of, base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, offsets = shared.value
        for b in batches:
            for part, before, keys, sizes, block in zip(*(b.column(i) for i in range(5)), strict=True):
                flat = ids[unpack(block.as_py())]
                n = unpack(sizes.as_py()).astype(np.int64)
                start = offsets[part.as_py()] + (before.as_py() or 0) + np.cumsum(n) - n
                each = [x.astype("<u4").tobytes() for x in np.split(flat, np.cumsum(n)[:-1])]
                yield pa.RecordBatch.from_arrays([pa.array(keys.as_py(), pa.int64()), pa.array(start), pa.array(each, pa.binary())], names=["key", "start", "ids"])

    placed = blocks.join(heads.select("part", "seq", "before"), ["part", "seq"])
    return placed.select("part", "before", "keys", "sizes", "block").mapInArrow(run, "key long, start long, ids binary")


def token_report(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the files, reads them back: (key, start, n_tokens, ids_crc32) of each document."""
    path = scratch(docs.sparkSession, "token-files")
    write_tokens(docs, path, tokenizer, key, text)
    ids = F.col("ids")
    return read_tokens(docs.sparkSession, path).select(F.col("key").alias(key), "start", (F.octet_length(ids) / 4).cast("long").alias("n_tokens"), F.crc32(ids).alias("ids_crc32"))
