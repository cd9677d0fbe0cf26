"""Operator 6, benchmark decontamination: CGK embedding, bit-sampling LSH and exact edit distances.

A text holds an item when a window of as many words as the item has lies within `share` of them in edit
distance, counted in words, lower case. Windows are found in three steps.

1. Of an item with k allowed edits, cut into k + 1 pieces, a close window has one piece whole, at most k
   words from its place (pigeonhole); and of the n - 1 pairs of neighbouring words it shares all but 2k (the
   q-gram lemma). Windows around the items' pieces with as many pairs as that are kept: none that is
   close is lost.
2. Each such window and each item of its length is embedded by CGK random walks: at step j the walk
   puts out the word it stands on and moves on or not, by a hash of j and the word. Close windows fall
   in step again after each edit, so their outputs agree at most steps. Sampled outputs are LSH keys;
   RUNS walks with keys of BITS outputs are repeated, and windows meet items that share any key.
3. Pairs that met are verified by their exact edit distance.

Windows of equal words are one content: they are embedded and verified once, so a passage that very many texts share costs no more
than one that two share, and no key holds more rows than there are different contents. Contents and items meet in
a join on the keys. For step 1 items go to all tasks in blocks of at most ITEMS, one pass over the texts for each block; a
block's windows are written and its broadcast freed before the next one is read, so what the driver and the tasks hold is
bounded and the benchmark may be of any size. Step 1 spares work; steps 2 and 3 decide. The number of runs follows from the recall wanted.

Defined results. Null or empty items are never found; a null text is empty. Rows with the same
doc_id and text are one document. A null doc_id or item_id is a value like any other. Of several
windows in one document the closest counts, then the first. Texts shorter than an item can't hold it.
Empty tables on either side give no rows. Texts may be of any length; further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, same, small_batches, text_of, word_hashes, written
from millrace.llm.word_table import blocks, gathered, lists
from millrace.session import table

SHARE = 0.2
RECALL = 0.99
BITS = 2
SLOT_BITS = 22
ITEMS = 20_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _slots(words: np.ndarray) -> np.ndarray:
    """The bit of each pair of neighbouring words."""
    w = words.astype(np.uint64)
    mixed = (w[:-1] * _MIX + w[1:]) * np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _grams(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m consecutive words, not negative."""
    w = words.astype(np.uint64)
    out = np.zeros(len(w) - m + 1, dtype=np.uint64)
    for i in range(m):
        out = (out ^ w[i : len(w) - m + 1 + i]) * _MIX
        out ^= out >> np.uint64(32)
    return (out >> np.uint64(1)).astype(np.int64)


def needed(n: np.ndarray, share: float = SHARE) -> np.ndarray:
    """Pairs that a window of n words must share with an item of n words to be close; under 1 means any window."""
    return n - 1 - 2 * np.floor(share * n + 1e-9).astype(np.int64)


@lru_cache
def runs_for(recall: float, share: float = SHARE, bits: int = BITS, sizes: tuple[int, ...] = (5, 10, 20, 40, 80), tries: int = 400) -> int:
    """Runs until a window with as many edits as are allowed shares a key with its item with this probability.

    The chance of one run is measured on random items of several lengths, half of whose edits replace words and half shift
    them, from a fixed seed; the length with the least chance counts.
    """
    rng, least = np.random.default_rng(17), 1.0
    for n in sizes:
        k = int(np.floor(share * n + 1e-9))
        items = rng.integers(1, 1 << 62, (tries, n))
        texts = np.concatenate([items, rng.integers(1, 1 << 62, (tries, n))], axis=1)
        for t, row in enumerate(texts):
            for e in range(k):
                at = int(rng.integers(0, n))
                if e % 2:
                    row[at] = rng.integers(1, 1 << 62)
                elif t % 2:
                    row[at + 1 :] = row[at:-1].copy()
                    row[at] = rng.integers(1, 1 << 62)
                else:
                    row[at:-1] = row[at + 1 :].copy()
        least = min(least, (walks(items, 16, bits) == walks(texts[:, :n].copy(), 16, bits)).mean())
    return int(np.ceil(np.log(1 - recall) / np.log1p(-least)))


def walks(windows: np.ndarray, runs: int, bits: int = BITS, seed: int = 7) -> np.ndarray:
    """LSH keys, one column for each run, of windows of one length (rows of word hashes)."""
    count, n = windows.shape
    rows = np.arange(count)
    keys = np.zeros((count, runs), dtype=np.uint64)
    for run in range(runs):
        rng = np.random.default_rng([seed, run, n])
        steps = max(2, n + n // 2)  # most walks are inside the window up to here
        sampled = np.sort(rng.choice(steps, size=min(bits, steps), replace=False))
        odd = rng.integers(1, 1 << 62, size=steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        at = np.zeros(count, dtype=np.int64)
        key = np.full(count, run * 1_000_003 + n, dtype=np.uint64)
        for j in range(int(sampled[-1]) + 1):
            out = np.where(at < n, windows[rows, np.minimum(at, n - 1)].astype(np.uint64), np.uint64(0))
            if j in sampled:
                key = (key ^ (out + np.uint64(j))) * _MIX
                key ^= key >> np.uint64(29)
            at += ((out * odd[j]) >> np.uint64(63)).astype(np.int64)
        keys[:, run] = key
    return keys.astype(np.int64)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Edit distances between rows of a and of b, words as symbols."""
    n = b.shape[1]
    steps = np.arange(n + 1)
    row = np.tile(steps, (len(a), 1))
    for i in range(a.shape[1]):
        new = np.empty_like(row)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(row[:, :-1] + (a[:, i : i + 1] != b), row[:, 1:] + 1)
        row = np.minimum.accumulate(new - steps, axis=1) + steps
    return row[:, -1]


def _by_size(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix of their words) for each length among the rows of a list column."""
    sizes = np.diff(offsets)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        yield rows, flat[offsets[rows][:, None] + np.arange(n)]


class _Items:
    """What step 1 needs of a block of items: the bit map of their pairs, and their pieces with where these lie."""

    def __init__(self, items: list[np.ndarray], share: float):
        bitmap = np.zeros(1 << SLOT_BITS, dtype=bool)
        pieces: dict[int, set[tuple[int, int, int, int]]] = {}
        for words in items:
            n = len(words)
            k = int(np.floor(share * n + 1e-9))
            bitmap[_slots(words)] = True
            cuts = [i * n // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(b - a, set()).add((int(_grams(words[a:b], b - a)[0]), a, n, k))
        self.bits = np.packbits(bitmap)
        self.share = share
        self.pieces = {m: np.array(sorted(rows), dtype=np.int64) for m, rows in pieces.items()}

    def windows(self, flat: np.ndarray, ends: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, sizes) of windows of words that may be close to an item; ends and begins are those of each word's text."""
        bits = np.unpackbits(self.bits).view(bool)
        hit = np.append(bits[_slots(flat)], False) & (np.arange(len(flat)) + 1 < ends)
        upto = np.concatenate([[0], np.cumsum(hit)])
        found = [np.zeros((0, 2), dtype=np.int64)]
        for m, rows in self.pieces.items():
            if len(flat) < m:
                continue
            grams = _grams(flat, m)
            mask = np.zeros(1 << 16, dtype=bool)
            mask[rows[:, 0] & 0xFFFF] = True
            at = np.flatnonzero(mask[grams & 0xFFFF])
            low, high = (np.searchsorted(rows[:, 0], grams[at], side) for side in ("left", "right"))
            at, low, high = (x[high > low] for x in (at, low, high))
            which = gathered(high - low, low)
            place = np.repeat(at, high - low) - rows[which, 1]
            n, k = rows[which, 2], rows[which, 3]
            shift = gathered(2 * k + 1, np.zeros_like(k)) - np.repeat(k, 2 * k + 1)
            start, n, of = np.repeat(place, 2 * k + 1) + shift, np.repeat(n, 2 * k + 1), np.repeat(np.repeat(at, high - low), 2 * k + 1)
            ok = (start >= begins[of]) & (start + n <= ends[of])
            start, n = start[ok], n[ok]
            ok = upto[start + n - 1] - upto[start] >= needed(n, self.share)
            found.append(np.stack([start[ok], n[ok]], axis=1))
        both = np.unique(np.concatenate(found), axis=0)
        return both[:, 0], both[:, 1]


def close_windows(docs: DataFrame, shared) -> DataFrame:
    """Step 1: (doc_id, th, start, words) of the windows that may be close to an item of their length; shared is a broadcast of _Items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, flat = lists(batch.column("words"))
            flat = flat.to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            start, size = shared.value.windows(flat, offsets[1:][row], offsets[:-1][row])
            for k in range(0, len(start), 20_000):  # bounds a batch, not the result
                s, z = start[k : k + 20_000], size[k : k + 20_000]
                out = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(z)]).astype(np.int32)), pa.array(flat[gathered(z, s)]))
                of = pa.array(row[s])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(of), batch.column("th").take(of), pa.array((s - offsets[:-1][row[s]]).astype(np.int32)), out], names=["doc_id", "th", "start", "words"])

    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), word_hashes(F.lower(text_of())).alias("words"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, start int, words array<long>")


def _keyed(rows: DataFrame, columns: list[str], runs: int) -> DataFrame:
    """Step 2: the columns and `key`, one row for each LSH key of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = lists(batch.column("words"))
            for at, windows in _by_size(flat.to_numpy(zero_copy_only=False), offsets):
                keys = walks(windows, runs)
                of = pa.array(np.repeat(at, keys.shape[1]))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in columns], pa.array(keys.ravel())], names=[*columns, "key"])

    schema = ", ".join([f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns])
    return rows.select(*columns, "words").mapInArrow(run, f"{schema}, key long")


def _verified(pairs: DataFrame, columns: list[str], share: float) -> DataFrame:
    """Step 3: the columns, n and the distance of pairs (words, item_words) that are close."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, flat = lists(batch.column("words"))
            item_offsets, item_flat = lists(batch.column("item_words"))
            item_flat = item_flat.to_numpy(zero_copy_only=False)
            for at, windows in _by_size(flat.to_numpy(zero_copy_only=False), offsets):
                at, windows = at[ok := np.diff(item_offsets)[at] == windows.shape[1]], windows[ok]
                found = distances(item_flat[item_offsets[at][:, None] + np.arange(windows.shape[1])], windows)
                close = found <= np.floor(share * windows.shape[1] + 1e-9)
                of = pa.array(at[close])
                size = pa.array(np.full(int(close.sum()), windows.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).take(of) for c in columns], size, pa.array(found[close].astype(np.int32))], names=[*columns, "n", "distance"])

    schema = ", ".join([f"`{c}` {pairs.schema[c].dataType.simpleString()}" for c in columns])
    return pairs.select(*columns, "words", "item_words").mapInArrow(run, f"{schema}, n int, distance int")


def _content(name: str) -> list[Column]:
    """128 bits that stand for the words of a row."""
    return [F.xxhash64("words").alias(f"{name}1"), F.xxhash64(F.lit(name), "words").alias(f"{name}2")]


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, recall: float = RECALL) -> DataFrame:
    """(doc_id, th, item_id, distance, start, n) of each document and item that it holds; th is the text's hash."""
    spark = docs.sparkSession
    small_batches(spark)
    scratch, runs = Scratch(spark, "leaks"), runs_for(recall, share)
    items = benchmark.select("item_id", word_hashes(F.lower(text_of())).alias("words")).filter(F.size("words") > 0).distinct()
    items = scratch.keep(items.select("item_id", "words", *_content("i")), "items")
    asked = scratch.keep(items.groupBy("i1", "i2").agg(F.first("words").alias("words")), "asked")
    blocks = max(1, -(-asked.count() // ITEMS))
    found = []
    for b in range(blocks):
        part = asked.filter(F.pmod(F.col("i1"), F.lit(blocks)) == b).select("words").toLocalIterator()
        shared = spark.sparkContext.broadcast(_Items([np.array(r[0], dtype=np.int64) for r in part], share))
        found.append(scratch.keep(close_windows(docs.select("doc_id", "text"), shared), f"found-{b}"))
        shared.unpersist()
    windows = scratch.keep(reduce(DataFrame.unionByName, found).distinct().select("doc_id", "th", "start", "words", *_content("c")), "windows")
    contents = scratch.keep(windows.groupBy("c1", "c2").agg(F.first("words").alias("words")), "contents")
    scratch.drop(*[f"found-{b}" for b in range(blocks)])
    met = _keyed(contents, ["c1", "c2"], runs).join(_keyed(asked, ["i1", "i2"], runs), "key").select("c1", "c2", "i1", "i2").distinct()
    pairs = met.join(contents, ["c1", "c2"]).join(asked.withColumnRenamed("words", "item_words"), ["i1", "i2"])
    close = scratch.keep(_verified(pairs, ["c1", "c2", "i1", "i2"], share), "close")
    places = windows.select("doc_id", "th", "start", "c1", "c2").join(close, ["c1", "c2"])
    best = places.groupBy("doc_id", "th", "i1", "i2").agg(F.min(F.struct("distance", "start", "n")).alias("best"))
    return best.join(items.select("item_id", "i1", "i2"), ["i1", "i2"]).select("doc_id", "th", "item_id", "best.*")


def op6_cgk_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and where it lies."""
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("th")


def decontamination_stage(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that hold no benchmark item, with their own columns."""
    of, at = fresh("of", docs.columns), fresh("th", docs.columns)
    found = written(leaks(docs, benchmark).select(F.col("doc_id").alias(of), F.col("th").alias(at)).distinct(), "leaks")
    return docs.join(found, same(F.col("doc_id"), F.col(of)) & (F.xxhash64(text_of()) == F.col(at)), "left_anti")
