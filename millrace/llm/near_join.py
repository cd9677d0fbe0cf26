"""Operator 8, n-gram Jaccard join: chosen paths over sets of word shingles.

A document is the set of its shingles (N consecutive words). Documents of equal sets are a class,
handled once. A run splits the classes recursively: at each level a set x chooses each of its shingles
whose hash with the path so far is below CHOSEN / |x|, and each choice extends the path; sets on one
path share all shingles chosen on it. A path with at most SMALL sets is a bucket, compared by brute force; a
larger one is split further, unless its sets agree in most bits of their sketches or the last split
hardly shrank it: no split would part them, so it is a bucket too. A pair at the threshold keeps CHOSEN *
similarity common choices a level on average, so it is lost in one run with a known probability, and
runs are repeated until RECALL is reached.

A bucket is compared in three steps, whatever its size. Its sets are dealt to blocks of bounded size, and a
task works on two of them.

1. Sketches: 64 one-bit min-hashes and the sizes tell which sets may be similar to another one (a pair
   at the threshold is held back with a probability under 1e-4, part of the stated recall). Only these stay.
2. First meetings: a pair that shares several buckets belongs to the first of them by its path, so it is
   counted once. Sets without a pair of their own here leave the bucket.
3. Shingles: the exact Jaccard of the pairs that belong here. The bucket returns for each set the number of its links and
   the least set of its component, not pairs: so it makes as many rows as it has sets.

Defined results. A text with fewer than N words is one shingle of all its words; texts without words,
null ones too, are one class. Rows with equal doc_id and text are one document, repeated. The class of
a document is the connected component of its links; class_id is the least doc_id in it, null if a
document without doc_id is in it (nulls are least). n_links counts the other sets linked to its set.
An empty table gives no rows. Texts may be of any length, and further columns may have any names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, small_batches, text_of, word_hashes, written
from millrace.llm.word_table import blocks, gathered, lists, whole_groups
from millrace.session import table

N = 5
SIMILARITY = 0.8
RECALL = 0.999
CHOSEN = 2.0
SMALL = 4096
DEPTH = 12
#: Sets of a path that agree in this share of their sketches' bits, on average, can't be split.
ALIKE = 0.75
#: Sets in a block of a bucket, and shingles in one: what a task holds of each of its two blocks.
CROWD_SETS = 4096
CROWD_SHINGLES = 2_000_000
#: Pairs of small buckets that are looked at in one go; a bucket of more rows than FEW is looked at by itself.
PAIRS = 1_000_000
FEW = 64
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Agreeing bits that a pair at the threshold has: 57.6 on average, standard deviation 2.4.
SKETCH_BITS_APART = 16


def runs_for(recall: float, similarity: float, chosen: float = CHOSEN) -> int:
    """Runs until a pair at the threshold is found with this probability, however deep its path."""
    lost, mean = 0.0, chosen * similarity
    for _ in range(200):  # extinction of a branching process with Poisson(mean) common choices a level
        lost = float(np.exp(mean * (lost - 1)))
    return int(np.ceil(np.log(1 - recall) / np.log(lost)))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(offsets: np.ndarray, words: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct shingle hashes) of each text of a flat array of word hashes."""
    sizes = np.diff(offsets)
    counts = np.where(sizes >= n, sizes - n + 1, (sizes > 0).astype(np.int64))
    start = gathered(counts, offsets[:-1])
    row = np.repeat(np.arange(len(sizes)), counts)
    end = offsets[1:][row]
    out = np.zeros(len(start), dtype=np.uint64)
    w = words.astype(np.uint64)
    for i in range(n):
        inside = start + i < end
        out[inside] = _mixed(out[inside] * _MIX + w[start[inside] + i] + np.uint64(i + 1))
    order = np.lexsort((out, row))
    out, row = out[order], row[order]
    first = np.ones(len(out), dtype=bool)
    first[1:] = (out[1:] != out[:-1]) | (row[1:] != row[:-1])
    out, row = out[first], row[first]
    return np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(sizes)))]), out


def choices(offsets: np.ndarray, sets: np.ndarray, paths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, new paths): each set's chosen shingles, given one path for each set."""
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    hashed = _mixed(sets ^ _mixed(paths.astype(np.uint64))[row])
    below = (hashed >> np.uint64(11)).astype(np.float64) * 2.0**-53 * sizes[row] < CHOSEN
    return row[below], hashed[below]


def _sketches(offsets: np.ndarray, sets: np.ndarray) -> np.ndarray:
    """64 one-bit min-hashes of each set."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.zeros(len(offsets) - 1, dtype=np.uint64)
    rng = np.random.default_rng(11)
    for bit in range(64):
        odd, add = (rng.integers(1, 1 << 63, size=2, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
        least = np.minimum.reduceat(sets * odd + add, offsets[full]) if len(full) else sets[:0]
        out[full] |= (_mixed(least) & np.uint64(1)) << np.uint64(bit)
    return out


def signatures(docs: DataFrame, n: int, runs: int) -> DataFrame:
    """(doc_id, th, rid, size, sketch, paths) of each document: rid names its set, paths are its first choices in all runs."""
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), word_hashes(text_of()).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, sets = shingles(*_flat(batch.column("words")), n)
            sizes = np.diff(offsets)
            row = np.repeat(np.arange(len(sizes)), sizes)
            sums = [np.zeros(len(sizes), dtype=np.uint64) for _ in range(2)]
            for out, mixed in zip(sums, (_mixed(sets + _MIX), _mixed(sets * _MIX)), strict=True):
                np.add.at(out, row, mixed)
            rid = np.stack([*sums], axis=1).astype(">u8").tobytes()
            found = [choices(offsets, sets, np.full(len(sizes), r + 1, dtype=np.uint64)) for r in range(runs)]
            of, path = (np.concatenate([f[i] for f in found]) for i in range(2))
            order = np.argsort(of, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("th"),
                    pa.array([rid[i : i + 16] for i in range(0, len(rid), 16)], pa.binary()),
                    pa.array(sizes.astype(np.int32)),
                    pa.array(_sketches(offsets, sets).astype(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(path[order].astype(np.int64))),
                ],
                names=["doc_id", "th", "rid", "size", "sketch", "paths"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, th long, rid binary, size int, sketch long, paths array<long>")


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    offsets, flat = lists(column)
    return offsets, flat.to_numpy(zero_copy_only=False)


def _key(doc_id: Column, th: Column) -> Column:
    """A document by its id and its text's hash, as one plain column; a null id is a value."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), th.cast("string"))


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(rid, set) of the wanted classes, each once; wanted has rid and the doc_id and th of one document."""
    texts = docs.select(_key(F.col("doc_id"), F.xxhash64(text_of())).alias("key"), text_of().alias("text"))
    texts = texts.join(wanted.select("rid", _key(F.col("doc_id"), F.col("th")).alias("key")).hint("merge"), "key")
    texts = texts.groupBy("key", "rid").agg(F.first("text").alias("text"))  # rows that repeat; the join's partitions serve

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "words"):
            offsets, sets = shingles(*_flat(batch.column("words")), n)
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(sets.astype(np.int64)))], names=["rid", "set"])

    return texts.select("rid", word_hashes(F.col("text")).alias("words")).mapInArrow(run, "rid binary, set array<long>")


def _split(active: DataFrame, sets: DataFrame) -> DataFrame:
    """The next level of (path, rid, size, sketch, parent): each active path of a set is extended by its choices."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                offsets, flat = _flat(part.column("set"))
                of, path = choices(offsets, flat.astype(np.uint64), part.column("path").to_numpy().astype(np.uint64))
                take = pa.array(of)
                yield pa.RecordBatch.from_arrays([pa.array(path.astype(np.int64)), *[part.column(c).take(take) for c in ("rid", "size", "sketch", "n")]], names=["path", "rid", "size", "sketch", "parent"])

    joined = active.join(sets, "rid").select("path", "rid", "size", "sketch", "n", "set")
    return joined.mapInArrow(run, "path long, rid binary, size int, sketch long, parent long")


def _parted(rows: DataFrame, last: bool, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(those that no split parts, the rest) of the paths with more than SMALL sets."""
    # Of two sets of one path a bit agrees with the probability p * p + (1 - p) * (1 - p).
    ones = [F.avg(F.shiftrightunsigned("sketch", b).bitwiseAND(F.lit(1))) for b in range(64)]
    alike = sum((1 - 2 * p * (1 - p) for p in ones), F.lit(0.0)) / 64
    seen = scratch.keep(rows.groupBy("path").agg(alike.alias("alike")), f"{name}-alike")
    rows = rows.join(seen.hint("merge"), "path")
    whole = F.lit(True) if last else (F.col("alike") >= ALIKE) | F.coalesce(2 * F.col("n") > F.col("parent"), F.lit(False))
    rows = scratch.keep(rows.withColumn("whole", whole).drop("alike"), f"{name}-large")
    return rows.filter("whole").drop("whole"), rows.filter(~F.col("whole")).drop("whole")


#: A group of a task: two blocks of a bucket, or one with itself.
GROUP = ("path", "i", "j")


def _grouped(rows: DataFrame) -> DataFrame:
    """The rows dealt out and sorted by group, for whole_groups()."""
    return rows.repartition(*GROUP).sortWithinPartitions(*GROUP)


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of buckets (path, rid, size, sketch, n, total) as (path, i, j, block, rid, size, sketch), a row for each pair of blocks."""
    count = F.greatest(F.ceil(F.col("n") / CROWD_SETS), F.ceil(F.col("total") / CROWD_SHINGLES)).cast("int")
    dealt = rows.withColumn("blocks", count).withColumn("block", F.pmod(F.xxhash64("rid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.select("path", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "rid", "size", "sketch")


class _Rows:
    """The two sides of a group, equal if it has one block only."""

    def __init__(self, group: pa.RecordBatch):
        block, i, j = (group.column(c).to_numpy() for c in ("block", "i", "j"))
        self.one = bool(i[0] == j[0])
        self.at = [np.flatnonzero(block == x) for x in (i[0], j[0])]
        self.size, self.sketch = group.column("size").to_numpy(), group.column("sketch").to_numpy().view(np.uint64)

    def near(self, similarity: float) -> np.ndarray:
        """Which pairs of the sides may be similar, by their sizes and sketches."""
        a, b = self.at
        out = np.zeros((len(a), len(b)), dtype=bool)
        for k in range(0, len(a), 512):
            out[k : k + 512] = _may_link(self.size[a[k : k + 512], None], self.size[None, b], self.sketch[a[k : k + 512], None], self.sketch[None, b], similarity)
        if self.one:
            np.fill_diagonal(out, False)
        return out

    def any(self, pairs: np.ndarray) -> np.ndarray:
        """The rows of the group that are in a pair."""
        out = np.zeros(len(self.size), dtype=bool)
        out[self.at[0]] |= pairs.any(1)
        out[self.at[1]] |= pairs.any(0)
        return out

    def first_met(self, pairs: np.ndarray, path: int, lists: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """The pairs without those that share a path before this one; lists are the paths of each row."""
        offsets, flat = lists
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        row, flat = row[flat < path], flat[flat < path]
        order = np.argsort(flat, kind="stable")
        row, flat = row[order], flat[order]
        place = [np.full(len(self.size), -1, dtype=np.int64) for _ in range(2)]
        for x, at in zip(place, self.at, strict=True):
            x[at] = np.arange(len(at))
        cuts = np.flatnonzero(np.diff(flat)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(flat)], strict=True):
            if b - a > 1:
                left, right = (x[row[a:b]] for x in place)
                pairs[np.ix_(left[left >= 0], right[right >= 0])] = False
        return pairs


def _may_link(size: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, sketches: np.ndarray, similarity: float) -> np.ndarray:
    return (np.bitwise_count(sketch ^ sketches) <= SKETCH_BITS_APART) & (np.minimum(size, sizes) >= similarity * np.maximum(size, sizes))


def near_rows(rows: pa.RecordBatch, edges: np.ndarray, similarity: float) -> np.ndarray:
    """The rows of groups that may be similar to another row of their group."""
    sizes = np.diff(edges)
    size, sketch = rows.column("size").to_numpy(), rows.column("sketch").to_numpy().view(np.uint64)
    out = np.zeros(rows.num_rows, dtype=bool)
    small = (sizes <= FEW) & (rows.column("i").to_numpy() == rows.column("j").to_numpy())[edges[:-1]]
    after = np.where(np.repeat(small, sizes), np.repeat(edges[1:], sizes) - np.arange(rows.num_rows) - 1, 0)  # rows of the group that come later
    cuts = np.flatnonzero(np.diff(np.cumsum(after) // PAIRS)) + 1
    for k, end in zip([0, *cuts], [*cuts, rows.num_rows], strict=True):
        a = np.repeat(np.arange(k, end), after[k:end])
        b = gathered(after[k:end], np.arange(k, end) + 1)
        ok = _may_link(size[a], size[b], sketch[a], sketch[b], similarity)
        out[a[ok]] = out[b[ok]] = True
    for g in np.flatnonzero(~small):
        group = _Rows(rows.slice(edges[g], sizes[g]))
        out[edges[g] : edges[g + 1]] = group.any(group.near(similarity))
    return out


def _near(rows: DataFrame, similarity: float) -> DataFrame:
    """Step 1: the dealt rows that may be similar to another one of their group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in whole_groups(batches, GROUP):
            yield part.filter(pa.array(near_rows(part, edges, similarity)))

    return _grouped(_dealt(rows)).mapInArrow(run, "path long, i int, j int, block int, rid binary, size int, sketch long")


def _owned(near: DataFrame, similarity: float) -> DataFrame:
    """Step 2: the rows with a pair that meets in this bucket first, each with all the buckets of its set."""
    lists_of = near.groupBy("rid").agg(F.collect_set("path").alias("paths"))
    rows = near.join(lists_of.hint("merge"), "rid").select(*near.columns, "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in whole_groups(batches, GROUP):
            keep = [np.zeros(0, dtype=bool)]
            for a, b in zip(edges, edges[1:], strict=False):
                group = part.slice(a, b - a)
                sides = _Rows(group)
                keep.append(sides.any(sides.first_met(sides.near(similarity), group.column("path")[0].as_py(), _flat(group.column("paths")))))
            yield part.filter(pa.array(np.concatenate(keep)))

    return _grouped(rows).mapInArrow(run, "path long, i int, j int, block int, rid binary, size int, sketch long, paths array<long>")


def _linked(owned: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Step 3: (rid, root, n): for each group that a set has links in, their number and the least set that it is connected with there."""
    rows = owned.join(sets.hint("merge"), "rid").select(*owned.columns, "set")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, edges in whole_groups(batches, GROUP):
            for a, b in zip(edges, edges[1:], strict=False):
                yield _links_of(part.slice(a, b - a), similarity)

    return _grouped(rows).mapInArrow(run, "rid binary, root binary, n long")


def _links_of(group: pa.RecordBatch, similarity: float) -> pa.RecordBatch:
    sides = _Rows(group)
    linked = sides.first_met(sides.near(similarity), group.column("path")[0].as_py(), _flat(group.column("paths")))
    a, b = (_flat(group.column("set").take(pa.array(x))) for x in sides.at)
    for k in range(0, len(linked), 512):
        ends = a[0][k : k + 513]
        common = shared_shingles((ends - ends[0], a[1][ends[0] : ends[-1]]), b).astype(np.float64)
        linked[k : k + 512] &= common / np.maximum(np.diff(ends)[:, None] + np.diff(b[0])[None, :] - common, 1) >= similarity
    rids = group.column("rid").take(pa.array(sides.at[0] if sides.one else np.concatenate(sides.at)))
    rank = np.argsort(np.argsort(np.array(rids.to_pylist(), dtype=object))).astype(np.int32)
    roots = _roots(linked, rank, sides.one)
    counts = linked.sum(1) if sides.one else np.concatenate([linked.sum(1), linked.sum(0)])
    hit = np.flatnonzero(counts)
    least = np.argsort(rank)[roots[hit]]
    return pa.RecordBatch.from_arrays([rids.take(pa.array(hit)), rids.take(pa.array(least)), pa.array(counts[hit].astype(np.int64))], names=["rid", "root", "n"])


def shared_shingles(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], columns: int = 2048) -> np.ndarray:
    """How many shingles each set of a shares with each of b; a and b are (offsets, flat shingles)."""
    values = np.intersect1d(a[1], b[1])
    out = np.zeros((len(a[0]) - 1, len(b[0]) - 1), dtype=np.float32)
    sides = []
    for offsets, flat in (a, b):
        at = np.minimum(np.searchsorted(values, flat), max(len(values) - 1, 0))
        ok = values[at] == flat if len(values) else np.zeros(len(flat), dtype=bool)
        row, at = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[ok], at[ok]
        order = np.argsort(at)
        sides.append((row[order], at[order]))
    for k in range(0, len(values), columns):
        parts = []
        for (row, at), (offsets, _) in zip(sides, (a, b), strict=True):
            low, high = np.searchsorted(at, (k, k + columns))
            part = np.zeros((len(offsets) - 1, min(columns, len(values) - k)), dtype=np.float32)
            part[row[low:high], at[low:high] - k] = 1
            parts.append(part)
        out += parts[0] @ parts[1].T
    return out


def _roots(linked: np.ndarray, rank: np.ndarray, one_block: bool) -> np.ndarray:
    """The least rank in each set's component of a matrix of links."""
    far = np.int32(len(rank))
    a = len(linked)
    labels = rank.copy()
    while True:
        left, right = (labels, labels) if one_block else (labels[:a], labels[a:])
        near = np.where(linked, right[None, :], far).min(1, initial=far)
        if not one_block:
            near = np.concatenate([near, np.where(linked, left[:, None], far).min(0, initial=far)])
        new = np.minimum(labels, near)
        if (new == labels).all():
            return labels
        labels = new


def _sized(rows: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """The rows whose path has at least two sets, with n, their number, and total, that of their shingles."""
    counts = scratch.keep(rows.groupBy("path").agg(F.count("*").alias("n"), F.sum("size").alias("total")).filter("n > 1"), f"{name}-counts")
    out = scratch.keep(rows.join(counts.hint("merge"), "path"), f"{name}-paths")
    scratch.drop(f"{name}-counts")
    return out


def links(docs: DataFrame, n: int = N, similarity: float = SIMILARITY, recall: float = RECALL) -> tuple[DataFrame, DataFrame]:
    """(found, members).

    found (rid, root, n): for each group of a bucket in which a set has links, their number and the least set it is connected
    with there; each link counts once, at both its ends. members (doc_id, th, rid) has all documents.
    """
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "near-join")
    members = scratch.keep(signatures(docs, n, runs_for(recall, similarity)), "signatures")
    classes = scratch.keep(members.groupBy("rid").agg(F.min(F.struct("doc_id", "th")).alias("m"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("paths").alias("paths")).select("rid", "m.*", "size", "sketch", "paths"), "classes")
    rows = classes.select(F.explode(F.array_distinct("paths")).alias("path"), "rid", "size", "sketch").withColumn("parent", F.lit(None).cast("long"))
    sets, near, level = None, [], 0
    while level < DEPTH:
        level += 1
        sized = _sized(rows, scratch, f"level-{level}")
        whole, large = _parted(sized.filter(F.col("n") > SMALL), level == DEPTH, scratch, f"level-{level}")
        buckets = sized.filter(F.col("n") <= SMALL).select("path", "rid", "size", "sketch", "n", "total").unionByName(whole.select("path", "rid", "size", "sketch", "n", "total"))
        near.append(scratch.keep(_near(buckets, similarity), f"near-{level}"))
        if sets is None:
            wanted = near[0].select("rid").union(large.select("rid")).distinct()
            sets = scratch.keep(_sets(docs, classes.select("rid", "doc_id", "th").join(wanted, "rid"), n), "sets")
            scratch.drop("classes")
        if large.isEmpty():
            break
        scratch.drop(f"level-{level}-paths")
        rows = _split(large, sets)
    owned = scratch.keep(_owned(_union(near), similarity), "owned")
    found = scratch.keep(_linked(owned, sets, similarity), "found")
    scratch.drop("sets", "owned", *[f"{x}-{k}" for k in range(1, level + 1) for x in ("near",)], *[f"level-{k}-{x}" for k in range(1, level + 1) for x in ("paths", "large", "alike")])
    return found, members.select("doc_id", "th", "rid")


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def components(pairs: DataFrame) -> DataFrame:
    """(rid, root) of every rid in a pair: the least rid of its connected component.

    Labels fall to the least label around, then to that label's own label, so paths shorten by half in
    each round; every round is a join and an aggregate, written to the shared folder.
    """
    scratch, turn = Scratch(pairs.sparkSession, "components"), 0
    edges = scratch.keep(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct(), "edges")
    labels = scratch.keep(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("rid"), "root"), "labels-0")
    while True:
        turn += 1
        near = edges.join(labels.select(F.col("rid").alias("b"), "root"), "b").groupBy(F.col("a").alias("rid")).agg(F.min("root").alias("near"))
        lower = labels.join(near, "rid").select("rid", F.least("root", "near").alias("next"), "root")
        lower = scratch.keep(lower, f"lower-{turn}")
        jumped = lower.join(lower.select(F.col("rid").alias("next"), F.col("next").alias("jump")), "next").select("rid", F.least("next", "jump").alias("root"), (F.least("next", "jump") != F.col("root")).alias("moved"))
        jumped = scratch.keep(jumped, f"labels-{turn}")
        scratch.drop(f"lower-{turn}", f"labels-{turn - 1}")
        if jumped.filter("moved").isEmpty():
            return jumped.select("rid", "root")
        labels = jumped.select("rid", "root")


def grouped(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, th, set_doc_id, set_th, class_id, class_th, n_links) of every document, repeated rows included."""
    found, members = links(docs, **settings)
    roots = components(found.filter("rid <> root").select(F.col("rid").alias("a"), F.col("root").alias("b")))
    degree = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    sets = members.groupBy("rid").agg(F.min(F.struct("doc_id", "th")).alias("m"))
    known = sets.join(roots, "rid", "left").join(degree, "rid", "left").select("rid", "m", F.coalesce("root", "rid").alias("root"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    scratch = Scratch(docs.sparkSession, "near-classes")
    known = scratch.keep(known, "known")
    least = scratch.keep(known.groupBy("root").agg(F.min("m").alias("least")), "least")
    classes = scratch.keep(known.join(least.hint("merge"), "root").select("rid", "m", "least", "n_links"), "classes")
    scratch.drop("known", "least")
    return members.join(classes.hint("merge"), "rid").select("doc_id", "th", F.col("m.doc_id").alias("set_doc_id"), F.col("m.th").alias("set_th"), F.col("least.doc_id").alias("class_id"), F.col("least.th").alias("class_th"), "n_links")


def op8_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies, the number of sets linked to its own, and the first document of its set."""
    return grouped(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", F.col("set_doc_id").alias("set_id"))


def near_copies_stage(docs: DataFrame) -> DataFrame:
    """One document of each class, the first by doc_id and then by its text's hash, with its own columns; of rows that repeat, one."""
    key, place = fresh("__key", docs.columns), fresh("__place", docs.columns)
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("th") == F.col("class_th"))
    kept = written(grouped(docs).filter(first).select(_key(F.col("doc_id"), F.col("th")).alias(key)).distinct(), "kept")
    joined = docs.withColumn(key, _key(F.col("doc_id"), F.xxhash64(text_of()))).join(kept.hint("merge"), key, "left_semi")
    # The join has dealt out and sorted the rows by the key, so this costs no shuffle.
    numbered = joined.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(key)))
    return numbered.filter(F.col(place) == 1).select(*docs.columns)
