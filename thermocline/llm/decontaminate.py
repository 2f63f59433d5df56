"""Benchmark decontamination with a generalised suffix automaton of the test items.

The items' normalised words are put into one suffix automaton. Training words stream through it;
at each word the automaton knows the longest suffix of the text read so far that occurs in any
item. A length of at least ``window`` words there is a hit on these words; an item shorter than
the window is a hit as a whole. Hit words form the spans to remove; a document whose hit words
reach the coverage limit is contaminated.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thermocline.llm.common import ROW, as_payload, unpacked, with_outputs, worker_state

WINDOW = 13
#: Words of the items that one automaton may hold; more items make more automata, passed one after the other.
BLOCK_WORDS = 200_000
#: Automata that a worker holds at a time; with more blocks, the others are built anew for each batch of documents.
KEPT_AUTOMATA = 3

#: A-Z to a-z; bytes below 0x80 that are neither letters nor digits to a blank.
_NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split() if text else []


class ItemAutomaton:
    """Suffix automaton over the words of several items, which windows of them it met, and whose they are."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words]) for name, words in items]
        for _, codes in texts:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: state -> items of the window (of full length) that is in this state
        self.windows: dict[int, set[str]] = {}
        #: state -> items that are shorter than the window and end here, with their lengths
        self.shorts: dict[int, list[tuple[int, set[str]]]] = {}
        short: dict[int, dict[int, set[str]]] = {}
        for name, codes in texts:
            state, n = 0, 0
            for c in codes:
                state, n = self.next[state][c], min(n + 1, window)
                while self.length[self.link[state]] >= n:
                    state = self.link[state]
                if n == window:
                    self.windows.setdefault(state, set()).add(name)
            if 0 < len(codes) < window:
                short.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        if short:  # an item that ends in a state also ends wherever that state is a suffix
            for state in sorted(range(len(self.length)), key=self.length.__getitem__):
                own = [*short.get(state, {}).items(), *self.shorts.get(self.link[state], [])]
                if own:
                    self.shorts[state] = own

    def _clone(self, p: int, c: int, q: int) -> int:
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        self.link[q] = copy
        return copy

    def _extend(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:  # an earlier item has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, c, q)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, c, q)
        return new

    def scan(self, words: list[bytes], hit: np.ndarray) -> tuple[set[str], int]:
        """Marks the hit words in ``hit``; the items met and the longest matching length."""
        nxt, link, length, window, shorts, windows = self.next, self.link, self.length, self.window, self.shorts, self.windows
        found: set[str] = set()
        state = n = longest = 0
        for at, c in enumerate(map(self.ids.get, words)):
            if c is None:
                state = n = 0
                continue
            step = nxt[state].get(c)
            if step is None:
                while step is None and state:
                    state = link[state]
                    n = length[state]
                    step = nxt[state].get(c)
                if step is None:
                    n = 0
                    continue
            state = step
            n += 1
            if n > longest:
                longest = n
            if n >= window:
                hit[at + 1 - window : at + 1] = True
                full = state
                while length[link[full]] >= window:
                    full = link[full]
                found |= windows[full]
            if shorts and state in shorts:
                for size, names in shorts[state]:
                    if size <= n:
                        hit[at + 1 - size : at + 1] = True
                        found |= names
        return found, longest


def item_blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> list[list[tuple[str, list[bytes]]]]:
    """The items, which are the stated query set, in blocks of a bounded number of words.

    Items reach the driver one partition at a time; a benchmark that exceeds the driver's memory
    must be passed in parts by the caller.
    """
    blocks: list[list[tuple[str, list[bytes]]]] = [[]]
    room = block_words
    for r in items.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).toLocalIterator():
        words = words_of(r["t"])
        if not words:
            continue
        if len(words) > room and blocks[-1]:
            blocks.append([])
            room = block_words
        blocks[-1].append((r["i"] if r["i"] is not None else "", words))
        room -= len(words)
    return [b for b in blocks if b]


SCHEMA = T.StructType().add("n_words", "long").add("n_hit", "long").add("items", T.ArrayType(T.StringType())).add("longest", "integer")
SCHEMA = SCHEMA.add("spans", T.ArrayType(T.StructType().add("first", "integer").add("last", "integer")))


def _matched(docs: DataFrame, items: DataFrame, text: str, item_id: str, item_text: str, window: int, one_in: int, block_words: int) -> DataFrame:
    """Payload, what was found in the text, and ``contaminated``."""
    spark = docs.sparkSession
    blocks = item_blocks(items, item_id, item_text, block_words)
    shared = [spark.sparkContext.broadcast(b) for b in blocks]  # each bounded by block_words
    job = uuid.uuid4().hex
    place = docs.columns.index(text)
    base = docs.select(as_payload(docs))
    schema = T.StructType([*base.schema.fields, *SCHEMA.fields])

    def automaton(k: int) -> ItemAutomaton:
        """The k-th automaton; a worker keeps the first few from task to task, others are built when needed."""
        kept = worker_state()
        if kept.get("items_of") != job:
            kept["items_of"], kept["automata"] = job, {}
        if k not in kept["automata"]:
            made = ItemAutomaton(shared[k].value, window)
            if len(kept["automata"]) >= KEPT_AUTOMATA:
                return made
            kept["automata"][k] = made
        return kept["automata"][k]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).field(place)
            sizes = [len(words_of(t.as_py())) for t in texts]
            hits = [np.zeros(n, bool) for n in sizes]
            names: list[set[str]] = [set() for _ in sizes]
            longest = [0] * len(sizes)
            for k in range(len(shared)):
                scan = automaton(k).scan
                for i, t in enumerate(texts):
                    found, n = scan(words_of(t.as_py()), hits[i])
                    names[i] |= found
                    longest[i] = max(longest[i], n)
            edges = [np.flatnonzero(np.diff(np.concatenate(([0], h.view(np.int8), [0])))).reshape(-1, 2) for h in hits]
            cols = {
                "n_words": pa.array(sizes, pa.int64()),
                "n_hit": pa.array([int(h.sum()) for h in hits], pa.int64()),
                "items": pa.array([sorted(x) for x in names], pa.list_(pa.string())),
                "longest": pa.array(longest, pa.int32()),
                "spans": pa.array([[{"first": int(a), "last": int(b) - 1} for a, b in e] for e in edges], pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))),
            }
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols.values()], names=[ROW, *cols])

    out = base.mapInArrow(run, schema)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(one_in) * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside an occurrence of an item's window), ``items``
    (ids of the items met, as sorted strings), ``longest`` (longest match in words), ``spans``
    (first and last word of each maximal hit run) and ``contaminated`` (some hit, and one word in
    ``one_in`` or more is hit).

    A null or empty text has no words, no hit and is clean; an item without words is ignored; an
    item shorter than the window counts as one window; repeated items and rows count each; a
    null item id reads as the empty string; an empty table gives no rows, and no items no hits.
    Input columns named like an output give way to it. Texts of any length are streamed whole.
    """
    out = _matched(docs, items, text, item_id, item_text, window, one_in, block_words)
    return with_outputs(out, docs.columns, {c: F.col(c) for c in ("n_words", "n_hit", "items", "longest", "spans", "contaminated")})


def remove_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, one_in: int = 20, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with all columns as they are."""
    out = _matched(docs, items, text, item_id, item_text, window, one_in, block_words)
    return unpacked(out.where(~F.col("contaminated")), docs.columns)
