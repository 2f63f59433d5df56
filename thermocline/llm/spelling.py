"""Spelling variants grouped by asymmetric q-chunks.

Two words are near if one inserted, deleted or replaced code point turns one into the other. A
word of n code points contributes two disjoint chunks, its first and its last n // 2 code points. One
edit touches at most one of them, so the other chunk stands in the near word too: the first at
its start, the last moved by the difference of the lengths, one place at most. The near word (as long, or
longer by one) therefore contributes its positional grams at just these places, chunks and grams meet
in an equi join on (place, length, chunk), and the pairs that meet are verified.

A chunk that very many words have is not joined pair by pair: the words agree in it, so that
their other parts must be one edit apart, which holds if they agree after one deletion. These
deletions are the keys there; a key then has no more words than there are letters and places.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thermocline.llm.common import written

#: Fixed values of the contract: shortest word, least occurrences, every how many hashes lose a letter, and how
#: many times as often a form must occur as its variant.
LEAST_LENGTH, LEAST_COUNT, DROP_EVERY, FORM_TIMES = 6, 5, 199, 5
#: A chunk of more words than this is joined by deletions.
HOT_CHUNK = 1_000
#: Distinct words that a task counts before it passes them on; code points of a text that are split at once.
FLUSH_WORDS, STEP = 200_000, 1 << 20

_RUN = re.compile("[a-zÀ-ÿ]+")


def runs(text: str) -> Iterator[list[str]]:
    """The maximal runs of letters of a text whose A-Z are lower-cased already, some at a time."""
    at = 0
    while at < len(text):
        end = at + STEP
        if end < len(text) and (more := _RUN.match(text, end)):
            end = more.end()  # a run that goes on is not cut
        yield _RUN.findall(text, at, end)
        at = end


def damaged(run: str, crc: int, every: int = DROP_EVERY) -> str:
    """``run`` without one code point if ``every`` divides the hash: planted misspellings."""
    if crc % every:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT, drop_every: int = DROP_EVERY) -> DataFrame:
    """(word, n): the words of whole texts with their occurrences over all rows, rare ones left out.

    Tasks count what they read before the shuffle, so that a frequent word is one row a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], names=["word", "n"])
            counts.clear()
            return out

        for b in batches:
            for k, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                head = zlib.crc32(f"{k}:".encode())
                local: Counter = Counter()
                for part in runs(t.as_py().lower().decode("utf-8", "replace")):  # bytes: only A-Z change
                    local.update(part)
                for w, n in local.items():
                    w = damaged(w, zlib.crc32(w.encode(), head), drop_every)
                    if len(w) >= least_length:
                        counts[w] += n
                if len(counts) > FLUSH_WORDS:
                    yield flush()
        if counts:
            yield flush()

    rows = docs.where(F.length(text) > 0).select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.col(text).cast("binary").alias("t"))
    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _chunk(of: str, place: str, n: Column, word: Column) -> Column:
    """A key with what is left of the word: its first (``a``) or last (``z``) n // 2 code points."""
    q = F.floor(n / 2).cast("int")
    first = place == "a"
    part = F.substring(word, F.lit(1), q) if first else F.right(word, q)
    rest = F.substring(word, q + 1, F.length(word)) if first else F.substring(word, F.lit(1), F.length(word) - q)
    return F.struct(F.lit(place).alias("place"), n.alias("length"), part.alias("chunk"), rest.alias(f"{of}_rest"))


def _chunks(words: DataFrame) -> DataFrame:
    """Two disjoint chunks of each word."""
    keys = F.array(*[_chunk("s", p, F.length("word"), F.col("word")) for p in "az"])
    return words.select(F.col("word").alias("s"), F.col("n").alias("s_n"), F.explode(keys).alias("k")).select("s", "s_n", "k.*")


def _grams(words: DataFrame, least_length: int) -> DataFrame:
    """The grams of each word at which chunks of words as long, or shorter by one, can stand."""
    keys = F.array(*[_chunk("t", p, F.length("word") - shorter, F.col("word")) for shorter in (0, 1) for p in "az"])
    rows = words.select(F.col("word").alias("t"), F.col("n").alias("t_n"), F.explode(keys).alias("k")).select("t", "t_n", "k.*")
    return rows.where(F.col("length") >= least_length)


def _deletions(rest: str, of_place: bool) -> Column:
    """``rest`` without each of its code points; with the place that it had, if asked for."""

    def one(i: Column) -> Column:
        cut = F.concat(F.substring(F.col(rest), F.lit(1), i - 1), F.substring(F.col(rest), i + 1, F.length(rest)))
        return F.struct((i if of_place else F.lit(0)).alias("at"), cut.alias("left"))

    every = F.transform(F.sequence(F.lit(1), F.length(rest)), one)
    return every if of_place else F.array_distinct(every)


def near_pairs(words: DataFrame, least_length: int = LEAST_LENGTH, hot_chunk: int = HOT_CHUNK) -> DataFrame:
    """(s, s_n, t, t_n): all pairs of distinct words of (word, n) that are one edit apart, each once.

    Every word must have ``least_length`` code points (two at least).
    """
    key = ["place", "length", "chunk"]
    chunks, grams = _chunks(words), _grams(words, least_length)
    sizes = chunks.select(*key).unionAll(grams.select(*key)).groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    hot = written(sizes.where(F.col("size") > hot_chunk).select(*key), "spelling-hot")
    # as long: the smaller word gives the chunks; else the shorter
    ordered = (F.length("t") > F.length("s")) | (F.col("s") < F.col("t"))
    met = chunks.join(hot, key, "left_anti").join(grams, key)
    pairs = met.where(ordered & (F.levenshtein("s", "t", 1) == 1)).select("s", "s_n", "t", "t_n")

    hot_s, hot_t = chunks.join(hot, key, "left_semi"), grams.join(hot, key, "left_semi")
    whole = F.array(F.struct(F.lit(0).alias("at"), F.col("s_rest").alias("left")))
    by_s = hot_s.select(*key, "s", "s_n", F.explode(F.concat(_deletions("s_rest", True), whole)).alias("d")).select(*key, "s", "s_n", "d.*")
    longer = F.length("t") > F.col("length")
    by_t = hot_t.select(*key, "t", "t_n", F.explode(F.when(longer, _deletions("t_rest", False)).otherwise(_deletions("t_rest", True))).alias("d")).select(*key, "t", "t_n", "d.*")
    looked_up = by_s.join(by_t, [*key, "at", "left"]).where(ordered).select("s", "s_n", "t", "t_n")
    return pairs.unionAll(looked_up).distinct()


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, by pointer doubling. A form is more frequent
    than its word by a factor, so there are no circles and chains are short."""
    to = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = to.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        after = written(to.join(on, to["root"] == on["_w"], "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("_moved")), "spelling-roots")
        to = after.select("word", "root")
        if after.where("_moved").isEmpty():
            return to


def variants(words: DataFrame, least_length: int = LEAST_LENGTH, form_times: int = FORM_TIMES, hot_chunk: int = HOT_CHUNK) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of each row of (word, n), which holds each word once.

    A word's form is its near word of largest n (of equals the smallest in code-point order), if that is
    ``form_times`` the word's own at least, or null; its root is where forms lead to in the end (itself
    without one). ``n_near`` counts its near words.
    """
    words = written(words.select("word", "n"), "spelling-words")
    pairs = written(near_pairs(words, least_length, hot_chunk), "spelling-pairs")
    both = pairs.unionAll(pairs.select(F.col("t").alias("s"), F.col("t_n").alias("s_n"), F.col("s").alias("t"), F.col("s_n").alias("t_n")))
    best = both.groupBy(F.col("s").alias("_w")).agg(F.count(F.lit(1)).alias("_near"), F.min(F.struct((-F.col("t_n")).alias("less"), F.col("t").alias("word"))).alias("_best"))
    known = words.join(best, words["word"] == best["_w"], "left")
    is_form = -F.col("_best.less") >= form_times * F.col("n")
    known = known.select("word", "n", F.coalesce("_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("_best.word")).alias("form"), F.when(is_form, -F.col("_best.less")).alias("form_n"))
    known = written(known, "spelling-forms")
    roots = _roots(known.where("form IS NOT NULL")).withColumnRenamed("word", "_w")
    out = known.join(roots, known["word"] == roots["_w"], "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", hot_chunk: int = HOT_CHUNK) -> DataFrame:
    """The words of the whole texts of ``docs`` with their forms and roots (see ``variants``).

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, with A-Z lower-cased; a run whose hash with the
    key is a multiple of ``DROP_EVERY`` loses one code point (see ``damaged``); words of under ``LEAST_LENGTH``
    code points or ``LEAST_COUNT`` occurrences do not count. Null and empty texts have no words, a null key is
    hashed as an empty one, repeated rows count again, texts and runs of any length are read whole, an empty
    table gives no rows; other columns are not read.
    """
    return variants(word_counts(docs, key, text), hot_chunk=hot_chunk)
