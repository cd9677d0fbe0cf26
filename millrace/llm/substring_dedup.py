"""Operator 4, substring dedup: an FM-index for each shard of segments, searched backward.

A window is WIDTH consecutive words. Of the hashes of the M-word grams in a window the least is its
minimizer, a function of its words alone, so equal windows have equal minimizers. Consecutive windows
with the same minimizer make a segment. Minimizers found at one place only have no repeated window; the
segments of all others are dealt to shards by their minimizer, so all windows that could be equal meet
in one shard, whatever documents they are from, and no document is streamed to every shard. Each shard
is indexed and its segments are streamed through the index; a window that occurs twice is reported
with the others of its segment as an interval of words.

A minimizer at more than HOT places, such as one in a passage that a third of all documents share, is not
put into one shard: its segments are aggregated by content and its windows compared by a hash of all
their words, in aggregates and joins that split such groups. Exact copies of a text are indexed once:
all their windows repeat; and so are segments of the same words.

Words are compared by 64-bit hashes, contents and whole windows by two of them.

Defined results. A null text has no words. A text of fewer than WIDTH words keeps them all. Repeated rows
are copies of each other. Nulls in doc_id are kept. An empty table gives no rows. Texts may be of any length; columns kept may have any
names but n_words, n_removed and kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, small_batches, text_of, word_hashes, words
from millrace.llm.fm_index import FMIndex, repeated_spans
from millrace.llm.word_table import blocks, gathered, lists
from millrace.session import table

WIDTH = 35
M = 8
HOT = 1000
SHARD_WORDS = 200_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _text_key() -> Column:
    return F.unhex(F.md5(text_of()))


def _grams(words: np.ndarray, m: int) -> np.ndarray:
    """A hash of each m consecutive words."""
    w = words.astype(np.uint64)
    out = np.zeros(max(len(w) - m + 1, 0), dtype=np.uint64)
    for i in range(m):
        out = (out ^ w[i : len(w) - m + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out * np.uint64(0xBF58476D1CE4E5B9)


def segments(offsets: np.ndarray, flat: np.ndarray, width: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start in the row, number of windows, minimizer) of each segment of each row of words."""
    sizes = np.diff(offsets)
    counts = np.maximum(sizes - width + 1, 0)
    if not counts.sum():
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    grams = _grams(flat, m)
    span = width - m + 1
    best, length = np.arange(len(grams)), 1
    while length < span:  # the place of the least gram, the leftmost on ties, of ever longer stretches
        step = min(length, span - length)
        a, b = best[: len(best) - step], best[step:]
        best, length = np.where(grams[a] <= grams[b], a, b), length + step
    start = gathered(counts, offsets[:-1])
    row = np.repeat(np.arange(len(sizes)), counts)
    at = best[start]
    new = np.ones(len(start), dtype=bool)
    new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], start[begin] - offsets[:-1][row[begin]], np.diff(np.append(begin, len(start))), grams[at[begin]].astype(np.int64)


def _minimizers(docs: DataFrame, width: int, m: int) -> DataFrame:
    """(mini, tk, start, n) of each segment of each text."""
    rows = docs.select(_text_key().alias("tk"), word_hashes(text_of()).alias("words")).filter(F.size("words") >= width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, flat = lists(batch.column("words"))
            row, start, n, mini = segments(offsets, flat.to_numpy(zero_copy_only=False), width, m)
            yield pa.RecordBatch.from_arrays([pa.array(mini), batch.column("tk").take(pa.array(row)), pa.array(start.astype(np.int32)), pa.array(n.astype(np.int32))], names=["mini", "tk", "start", "n"])

    return rows.mapInArrow(run, "mini long, tk binary, start int, n int")


def _bytes(*hashes: np.ndarray) -> pa.Array:
    """64-bit hashes side by side as one binary column."""
    flat = np.stack(hashes, axis=1).astype(">u8").tobytes()
    size = 8 * len(hashes)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(size), len(flat) // size, [None, pa.py_buffer(flat)]).cast(pa.binary())


def _cut(texts: DataFrame, width: int) -> DataFrame:
    """(key, tk, start, n, hot, content, words) of the listed segments of each text; content is a hash of the words, of 128 bits."""
    powers = np.random.default_rng(9).integers(1, 1 << 62, size=(2, 2 * width), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    names = ["key", "tk", "start", "n", "hot", "content", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, flat = lists(batch.column("words"))
            flat = flat.to_numpy(zero_copy_only=False)
            ends, found = lists(batch.column("found"))
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            start, n, key, hot = (pc.struct_field(found, c).to_numpy(zero_copy_only=False) for c in ("start", "n", "mini", "hot"))
            for k in range(0, len(row), 20_000):  # bounds a batch, not the result
                of = slice(k, k + 20_000)
                size = (n[of] + width - 1).astype(np.int64)
                words = flat[gathered(size, offsets[:-1][row[of]] + start[of])]
                begin = np.cumsum(size) - size
                mixed, place = _grams(words, 1), gathered(size, np.zeros_like(size))
                hashed = _bytes(*[np.add.reduceat(mixed * p[place], begin) for p in powers])
                cut = pa.ListArray.from_arrays(pa.array(np.append(begin, len(words)).astype(np.int32)), pa.array(words))
                yield pa.RecordBatch.from_arrays([pa.array(key[of]), batch.column("tk").take(pa.array(row[of])), pa.array(start[of]), pa.array(n[of]), pa.array(hot[of]), hashed, cut], names=names)

    return texts.mapInArrow(run, "key long, tk binary, start int, n int, hot boolean, content binary, words array<long>")


def _searched(shards: DataFrame, width: int) -> DataFrame:
    """(tk, a, b): intervals of words that the index of each shard reports."""

    def run(group: pa.Table) -> pa.Table:
        # Segments of the same words are one content; more places than one make all its windows repeated.
        content = group.column("content").combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        _, some, which, places = np.unique(content, return_index=True, return_inverse=True, return_counts=True)
        n = group.column("n").to_numpy().astype(np.int64)
        offsets, flat = lists(group.column("words").take(pa.array(some)))
        symbols = np.unique(flat.to_numpy(zero_copy_only=False), return_inverse=True)[1] + 1
        # Contents one after another, a 0 after each: no window crosses it.
        sizes = np.diff(offsets)
        begins = offsets[:-1] + np.arange(len(sizes))
        text = np.zeros(int(sizes.sum()) + len(sizes), dtype=np.int64)
        text[gathered(sizes, begins)] = symbols
        first, last = np.zeros(len(some), dtype=np.int64), n[some] - 1
        single = places == 1
        first[single], last[single] = repeated_spans(FMIndex(text, width), text, begins[single], n[some][single], width)
        hit = np.flatnonzero(first[which] >= 0)
        start = group.column("start").to_numpy()[hit]
        return pa.table({"tk": group.column("tk").take(pa.array(hit)), "a": pa.array((start + first[which][hit]).astype(np.int32)), "b": pa.array((start + last[which][hit] + width).astype(np.int32))})

    return shards.groupBy("shard").applyInArrow(run, "tk binary, a int, b int")


def _hot_spans(hot: DataFrame, width: int, scratch: Scratch) -> DataFrame:
    """(tk, a, b) of segments whose minimizer is too frequent for one shard.

    Contents are aggregated first. All windows of a content with several places repeat; a window of a
    content with one place repeats if another content has it too. (Two windows of one segment differ:
    they hold their minimizer at different places.)
    """
    place = F.struct("tk", "start")
    contents = scratch.keep(hot.groupBy("key", "content").agg(F.min(place).alias("x"), F.max(place).alias("y"), F.first("n").alias("n"), F.first("words").alias("words")), "hot-contents")
    many = contents.filter("x <> y").select("key", "content").hint("merge")
    whole = hot.select("key", "content", "tk", "start", "n").join(many, ["key", "content"], "left_semi").select("tk", F.col("start").alias("a"), (F.col("start") + F.col("n") + (width - 1)).alias("b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, flat = lists(batch.column("words"))
            count = np.diff(offsets) - width + 1
            words, at = flat.to_numpy(zero_copy_only=False), gathered(count, offsets[:-1])
            hashes = _bytes(_grams(words, width)[at], _grams(~words, width)[at])
            of = pa.array(np.repeat(np.arange(batch.num_rows), count))
            yield pa.RecordBatch.from_arrays([hashes, batch.column("content").take(of), batch.column("key").take(of), pa.array(gathered(count, np.zeros_like(count)).astype(np.int32))], names=["window", "content", "key", "i"])

    def windows(of: DataFrame) -> DataFrame:
        return of.select("content", "key", "words").mapInArrow(run, "window binary, content binary, key long, i int")

    twice = windows(contents).groupBy("window").agg(F.min("content").alias("a"), F.max("content").alias("b")).filter("a <> b").select("window")
    single = contents.filter("x = y")
    some = windows(single).join(scratch.keep(twice, "hot-windows").hint("merge"), "window", "left_semi").groupBy("key", "content").agg(F.min("i").alias("first"), F.max("i").alias("last"))
    parts = single.select("key", "content", "x").join(some, ["key", "content"]).select("x.tk", (F.col("x.start") + F.col("first")).alias("a"), (F.col("x.start") + F.col("last") + width).alias("b"))
    return whole.unionByName(parts)


def _place() -> Column:
    return F.xxhash64("tk", "start")


def repeated(docs: DataFrame, width: int = WIDTH, m: int = M, hot: int = HOT) -> DataFrame:
    """(tk, spans): for each text, by the MD5 of its content, the spans of words in repeated windows."""
    scratch = Scratch(docs.sparkSession, "substrings")
    found = scratch.keep(_minimizers(docs, width, m), "minimizers")
    # A text that occurs twice has the same places both times, so places tell different ones apart.
    shared = found.groupBy("mini").agg(F.min(_place()).alias("x"), F.max(_place()).alias("y"), F.count("*").alias("places")).filter("x <> y").select("mini", (F.col("places") > hot).alias("hot"))
    near = found.join(scratch.keep(shared, "shared").hint("merge"), "mini").groupBy("tk").agg(F.collect_set(F.struct("start", "n", "mini", "hot")).alias("found"))
    near = scratch.keep(near, "near")
    scratch.drop("minimizers", "shared")
    texts = docs.select(_text_key().alias("tk"), text_of().alias("text")).groupBy("tk").agg(F.first("text").alias("text"))
    cut = scratch.keep(_cut(texts.join(near.hint("merge"), "tk").select("tk", "found", word_hashes(F.col("text")).alias("words")), width), "segments")
    scratch.drop("near")
    total = cut.filter(~F.col("hot")).agg(F.sum(F.col("n") + width - 1)).first()[0] or 0
    shards = cut.filter(~F.col("hot")).withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(1 + total // SHARD_WORDS)))
    spans = _searched(shards.select("shard", "tk", "start", "n", "content", "words"), width)
    hot_spans = _hot_spans(cut.filter("hot"), width, scratch)
    copies = docs.groupBy(_text_key().alias("tk")).agg(F.count("*").alias("c")).filter("c > 1").select("tk", F.lit(0).alias("a"), F.lit(2**31 - 1).alias("b"))
    every = spans.unionByName(hot_spans).unionByName(copies)
    out = scratch.keep(every.groupBy("tk").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")
    scratch.drop("segments", "hot-contents", "hot-windows")
    return out


def dedup_substrings(docs: DataFrame, keep: list[str], width: int = WIDTH, **settings) -> DataFrame:
    """The columns in keep, n_words, n_removed and `kept`, the words that stay joined by one space."""
    small_batches(docs.sparkSession)
    text, key, word, span = (fresh(c, keep) for c in ("text", "key", "words", "spans"))
    spans = repeated(docs.select("text"), width, **settings).select(F.col("tk").alias(key), F.col("spans").alias(span)).hint("merge")
    rows = docs.select(*keep, text_of().alias(text), _text_key().alias(key)).join(spans, key, "left")
    rows = rows.select(*keep, words(F.col(text)).alias(word), F.coalesce(span, F.array().cast("array<struct<a:int,b:int>>")).alias(span))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, word):
            offsets, flat = lists(batch.column(word))
            ends, found = lists(batch.column(span))
            size = np.diff(offsets)
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            ok = size[row] >= width
            row, a, b = row[ok], *(pc.struct_field(found, c).to_numpy(zero_copy_only=False).astype(np.int64)[ok] for c in "ab")
            edge = np.zeros(len(flat) + 1, dtype=np.int64)
            np.add.at(edge, offsets[row] + a, 1)
            np.add.at(edge, offsets[row] + np.minimum(b, size[row]), -1)
            gone = np.cumsum(edge)[:-1] > 0
            upto = np.concatenate([[0], np.cumsum(~gone)])[offsets]
            kept = pc.binary_join(pa.ListArray.from_arrays(pa.array(upto.astype(np.int32)), flat.filter(pa.array(~gone))), " ")
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(size), pa.array(size - np.diff(upto)), kept], names=[*keep, "n_words", "n_removed", "kept"])

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], "n_words long, n_removed long, kept string"])
    return rows.mapInArrow(run, schema)


def op4_fm_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the words of repeated windows of 35 words."""
    out = dedup_substrings(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


#: Every window by its words, in DuckDB: windows that start at two places or more cover their words.
OP4_SQL = r"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
    win AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 34], ' ')) AS k FROM w, unnest(range(1, len(ws) - 33)) AS u(i) WHERE len(ws) >= 35),
    rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY k) > 1),
    gone AS (SELECT DISTINCT doc_id, i + o AS p FROM rep, unnest(range(35)) AS v(o)),
    each AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
    kept AS (SELECT doc_id, count(*) AS n, count(g.p) AS r, string_agg(x, ' ' ORDER BY each.p) FILTER (g.p IS NULL) AS t FROM each LEFT JOIN gone AS g USING (doc_id, p) GROUP BY doc_id)
    SELECT doc_id, coalesce(n, 0) AS n_words, coalesce(r, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
