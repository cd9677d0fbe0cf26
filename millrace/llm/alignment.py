"""Operator 12, alignment of two tokenizers' tokens over the same bytes.

Each text is encoded by a byte-level tokenizer A (the text with a space before it) and by a sentence-piece model B (which puts that space
there itself). B's tokens are a static index of intervals in order; for each token of A two bisections give the B tokens that it overlaps; a gap
between two A tokens that no B token spans is the border of two groups. Links are all pairs of an A and a B token of one group.

No token of either kind crosses a place where a space or a line break follows a character that isn't white space (checked for the two files that are given;
else a text is worked on as a whole). So the stretches between such places are aligned one by one, each distinct one
once while a worker's table lasts, and a text's groups are those of its stretches one after another.

How many documents hold a pair of ids linked is counted over the corpus: documents are dealt into blocks of bounded words, a block
keeps its distinct pairs with their number of documents, these are summed by pair, and counts and whether they are their A id's
highest come back to the blocks. What is shuffled is one row for each block and distinct pair, never one for each token, and no group is larger than a block.
A block's lists are kept in rows of at most PART entries and files of small row groups, since Spark holds up to 100 rows when it writes such a file and a row group's rows (4,096 at most) when it reads one.

Defined results. Null and empty texts, and those whose tokens' bytes aren't a space and the text (for B: texts with U+2581), have no tokens: all
counts 0, groups_sha256 ''. Strings of special tokens are plain text. Rows that repeat count as documents each. An empty table gives no rows. Texts may
be of any length: memory holds 4 bytes for each stretch of one text. The columns kept may have any names but those returned.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, small_batches, text_of
from millrace.llm.word_table import gathered, lists
from millrace.session import table

A_PATH = public_tokenizers.path("byte_bpe_50k.json")
B_PATH = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
#: Characters of whole documents in a block; a longer document is a block of its own.
BLOCK = 2_000_000
#: Stretches looked up at once, and characters (100 more for each stretch) that a worker's table holds before it starts anew.
CHUNK, TABLE_CHARS = 100_000, 25_000_000
#: Entries of each of a block's lists in one of its rows, and bytes of a row group of these.
PART, ROW_GROUP = 8192, 4_000_000
#: Links of a group above which its pairs come by distinct ids.
LARGE = 4096
#: From one place where white space follows another character to the next such place; the first branch is the most frequent case of the second.
STRETCH = re.compile(r"[ \n]?\S+(?=[ \n])|\s*\S+(?:[^\S \n]\s*\S+)*(?:[^\S \n]\s*)?|\s+")
WHOLE = re.compile(r".+", re.DOTALL)
#: Stretches in which both libraries for A tell letters, numbers and white space alike, whichever Unicode version they know.
QUICK = re.compile("[\x09-\x0D\x20-\x7E\u00A0-\u024F]{1,500}")
COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def byte_characters() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 characters for themselves, the others from U+0100 on in order."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


def overlaps(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of A the range of B tokens whose bytes it overlaps: two bisections of the index, which is B's ends in order."""
    starts = np.concatenate([[0], a_ends[:-1]])
    return np.searchsorted(b_ends, starts, "right"), np.searchsorted(b_ends, a_ends, "left") + 1


def groups(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ends (in tokens of A, in tokens of B) of all groups, in order: the gaps between A tokens that no B token spans, and the last end."""
    low, high = overlaps(a_ends, b_ends)
    free = np.append(high[:-1] <= low[1:], True) if len(high) else np.zeros(0, dtype=bool)
    return np.flatnonzero(free) + 1, high[free]


def _sizes(ends: np.ndarray) -> np.ndarray:
    return np.diff(ends, prepend=0)


def links(a: np.ndarray, b: np.ndarray, a_cuts: np.ndarray, b_cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, pair, times) of the links of all groups, by their A token; the pair is A's id times 2^32 and B's id.

    A group of more than LARGE links comes by its distinct ids, so what is made of it isn't the square of its tokens.
    """
    a_many, b_many = _sizes(a_cuts), _sizes(b_cuts)
    large = a_many * b_many > LARGE
    many = np.repeat(np.where(large, 0, b_many), a_many)
    left = np.repeat(np.arange(len(a)), many)
    pairs = a[left] << 32 | b[gathered(many, np.repeat(b_cuts - b_many, a_many))]
    found = [(left, pairs, np.ones(len(pairs), dtype=np.int64))]
    for g in np.flatnonzero(large):
        (x, nx), (y, ny) = (np.unique(ids[end - size : end], return_counts=True) for ids, end, size in ((a, a_cuts[g], a_many[g]), (b, b_cuts[g], b_many[g])))
        found.append((np.full(len(x) * len(y), a_cuts[g] - 1), (x[:, None] << 32 | y).ravel(), (nx[:, None] * ny).ravel()))
    left, pairs, times = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(left, kind="stable") if len(found) > 1 else slice(None)
    return left[order], pairs[order], times[order]


class Lists:
    """Arrays one after another, kept as one flat array with their ends."""

    def __init__(self):
        self.parts, self.sizes, self.done = [], [], None

    def add(self, flat: np.ndarray, sizes: np.ndarray) -> None:
        self.parts.append(flat)
        self.sizes.append(sizes)
        self.done = None

    def of(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(the arrays at these places one after another, the size of each)."""
        if self.done is None:
            self.parts, self.sizes = [np.concatenate(self.parts)], [np.concatenate(self.sizes)]
            self.done = np.cumsum(self.sizes[0]) - self.sizes[0]
        sizes = self.sizes[0][places]
        return self.parts[0][gathered(sizes, self.done[places])], sizes


class Aligner:
    """Both tokenizers and a table of stretches that are aligned already."""

    def __init__(self, a_path: str, b_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        of = byte_characters()
        names = [self.a.id_to_token(i) or "" for i in range(self.a.get_vocab_size())]
        self.a_bytes = [bytes(map(of.__getitem__, t)) if all(c in of for c in t) else t.encode() for t in names]
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        splits = json.loads(self.a.to_str())
        split = splits["pre_tokenizer"] or {}
        cut_a = splits["normalizer"] is None and split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        cut_b = not any(re.search(f"[^{MARK}]{MARK}", p) or "\n" in p for p in pieces)
        self.pattern = STRETCH if cut_a and cut_b else WHOLE
        self.quick = self._quick(splits["model"]) if cut_a else None
        self.a_sizes, self.b_sizes = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # An id and what may follow it: another id of its side, the other side, the next group, nothing.
        self.many = max(len(self.a_bytes), len(self.b_bytes))
        self.shown = [f"{i}{mark}".encode() for mark in (",", "|", ";", "") for i in range(self.many)]
        self.reset()

    def _quick(self, model: dict):
        """The same tokenizer in the library that is the faster one, where the order of A's merges is that of its ids."""
        import tiktoken

        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        single, vocab = len(byte_characters()), model["vocab"]
        if all(vocab[x + y] == single + i for i, (x, y) in enumerate(merges)):
            ranks = {self.a_bytes[i]: i for i in range(single + len(merges))}
            return tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return None

    def reset(self) -> None:
        #: A stretch's place in the lists; -1: its tokens' bytes are others than its own.
        self.at: dict[str, int] = {}
        self.text: list[bytes] = []
        self.ids_a, self.ids_b, self.ends, self.pairs, self.times, self.counts = (Lists() for _ in range(6))
        self.chars = 0

    def learn(self, stretches: list[str]) -> None:
        """Aligns the stretches that the table doesn't have."""
        new = [s for s in dict.fromkeys(stretches) if s not in self.at]
        self.chars += sum(map(len, new)) + 100 * len(new)
        # One after another they are a text whose stretches they are, unless one ends in white space.
        quick, joined, alone = [], [], []
        for s in new:
            if self.pattern is WHOLE or s[-1].isspace():
                alone.append([s])
            else:
                (quick if self.quick and QUICK.fullmatch(s) else joined).append(s)
        if quick:
            self._learn(quick, self.quick.encode_ordinary)
        for part in [joined] * bool(joined) + alone:
            self._learn(part, lambda t: self.a.encode(t, add_special_tokens=False).ids)

    def _encode_b(self, part: list[str]) -> list[int]:
        """B's ids of stretches that follow each other; some at a time, as the model takes longer for long texts."""
        out = []
        for k in range(0, len(part), 100):
            text = "".join(part[k : k + 100])
            # The model puts a space before what it is given: it stands for the one that the text begins with, or is taken away again.
            out += (self.b.encode(text[1:]) or [self.mark]) if text[0] == " " else self.b.encode(text)[1:]
        return out

    def _learn(self, part: list[str], encode: Callable[[str], list[int]]) -> None:
        text = "".join(part)
        left, right = encode(text), self._encode_b(part)
        want = text.encode()
        if b"".join(map(self.b_bytes.__getitem__, right)) != want or b"".join(map(self.a_bytes.__getitem__, left)) != want:
            if len(part) == 1:
                self.at[part[0]] = -1
            else:
                self._learn(part[: len(part) // 2], encode)
                self._learn(part[len(part) // 2 :], encode)
            return
        a, b = np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)
        a_ends, b_ends = np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b])
        a_cuts, b_cuts = groups(a_ends, b_ends)
        borders = np.cumsum([len(s.encode()) for s in part])
        # Tokens and groups up to the end of each stretch.
        a_to, b_to, to = (np.searchsorted(e, borders) + 1 for e in (a_ends, b_ends, a_ends[a_cuts - 1]))
        a_many, b_many = _sizes(a_cuts), _sizes(b_cuts)
        owner, pairs, times = links(a, b, a_cuts, b_cuts)

        mark_a, mark_b = np.zeros(len(a), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
        mark_a[a_cuts - 1], mark_b[b_cuts - 1], mark_b[b_to - 1] = 1, 2, 3
        group = np.concatenate([np.repeat(np.arange(len(a_cuts)), a_many) * 2, np.repeat(np.arange(len(b_cuts)), b_many) * 2 + 1])
        codes = np.concatenate([mark_a * self.many + a, mark_b * self.many + b])[np.argsort(group, kind="stable")]
        shown = [self.shown[i] for i in codes.tolist()]
        tokens_to = a_to + b_to
        for i, (s, x, y) in enumerate(zip(part, [0, *tokens_to[:-1].tolist()], tokens_to.tolist(), strict=True), len(self.text)):
            self.at[s] = i
            self.text.append(b"".join(shown[x:y]))
        sizes_a, sizes_b, sizes = _sizes(a_to), _sizes(b_to), _sizes(to)
        self.ids_a.add(a, sizes_a)
        self.ids_b.add(b, sizes_b)
        first = np.repeat(np.stack([a_to - sizes_a, b_to - sizes_b], axis=1), sizes, axis=0)
        self.ends.add(np.stack([a_cuts, b_cuts], axis=1) - first, sizes)
        of_stretch = np.bincount(np.searchsorted(a_to, owner, "right"), minlength=len(part))
        self.pairs.add(pairs, of_stretch)
        self.times.add(times, of_stretch)
        total = np.concatenate([[0], np.cumsum(a_many * b_many)])
        self.counts.add(np.stack([sizes_a, sizes_b, sizes, total[to] - total[to - sizes]], axis=1), np.ones(len(part), dtype=np.int64))

    def places(self, texts: list[str]) -> list[np.ndarray | None]:
        """For each text the table's places of the stretches of a space and the text; none where it has no tokens."""
        sizes, parts, held = [0] * len(texts), [np.zeros(0, dtype=np.int32)], []

        def look_up(stretches: list[str]) -> None:
            self.learn(stretches)
            parts.append(np.fromiter(map(self.at.__getitem__, stretches), np.int32, len(stretches)))

        for k, text in enumerate(texts):
            if len(text) < BLOCK:
                some = self.pattern.findall(" " + text) if text else []
                sizes[k] = len(some)
                held += some
            else:
                each = (m[0] for m in self.pattern.finditer(" " + text))
                while some := list(islice(each, CHUNK)):
                    sizes[k] += len(some)
                    look_up(held + some)
                    held = []
            if len(held) >= CHUNK:
                look_up(held)
                held = []
        look_up(held)
        ends = np.cumsum(sizes)
        found = [p if len(p) and p.min() >= 0 else None for p in np.split(np.concatenate(parts), ends[:-1])]
        return found

    def digest(self, places: np.ndarray | None) -> str:
        """The SHA-256 of all groups, written `a1,a2|b1;a3|b2,b3`; '' without tokens."""
        if places is None:
            return ""
        out = hashlib.sha256()
        for k in range(0, len(places), CHUNK):
            out.update((b";" if k else b"") + b";".join([self.text[i] for i in places[k : k + CHUNK].tolist()]))
        return out.hexdigest()


_aligners: dict[tuple[str, str], Aligner] = {}


def _loaded(paths: tuple[str, str]) -> Aligner:
    if paths not in _aligners:
        _aligners[paths] = Aligner(*paths)
    return _aligners[paths]


def _blocks(batches: Iterator[pa.RecordBatch], column: str, known: Aligner) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray | None]]]:
    """Whole rows with the places of their texts' stretches, in blocks of about BLOCK characters."""
    for batch in batches:
        sizes = np.cumsum(pc.utf8_length(batch.column(column)).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // BLOCK)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                if known.chars > TABLE_CHARS:
                    known.reset()
                rows = batch.slice(a, b - a)
                yield rows, known.places(rows.column(column).to_pylist())


def _links(known: Aligner, found: list[np.ndarray | None]) -> tuple[np.ndarray, ...]:
    """(COUNTS of each document), then (document, place of the pair, links) of every distinct pair of each document, sorted, and the distinct pairs."""
    sizes = np.array([0 if p is None else len(p) for p in found], dtype=np.int64)
    places = np.concatenate([np.zeros(0, dtype=np.int32), *[p for p in found if p is not None]])
    counts = np.zeros((len(found), len(COUNTS)), dtype=np.int64)
    if not len(places):
        return counts, *(np.zeros(0, dtype=np.int64),) * 4
    many = len(known.text)
    each, n = np.unique(np.repeat(np.arange(len(found)), sizes) * many + places, return_counts=True)
    doc, place = each // many, each % many
    firsts = np.flatnonzero(np.diff(doc, prepend=-1))
    counts[doc[firsts]] = np.add.reduceat(known.counts.of(place)[0] * n[:, None], firsts, axis=0)
    # The pairs of each stretch of the block, told apart once; then those of each document.
    used, at = np.unique(place, return_inverse=True)
    pairs, number = np.unique(known.pairs.of(used)[0], return_inverse=True)
    times, of_stretch = known.times.of(used)
    rows = gathered(of_stretch[at], (np.cumsum(of_stretch) - of_stretch)[at])
    keys = np.repeat(doc, of_stretch[at]) * len(pairs) + number[rows]
    order = np.argsort(keys, kind="stable")
    keys, links = keys[order], (times[rows] * np.repeat(n, of_stretch[at]))[order]
    firsts = np.flatnonzero(np.diff(keys, prepend=-1))
    return counts, keys[firsts] // len(pairs), keys[firsts] % len(pairs), np.add.reduceat(links, firsts), pairs


def _listed(values: pa.Array, rows: int, part: int) -> pa.ListArray:
    """The values as lists of so many entries, the last ones shorter or empty."""
    return pa.ListArray.from_arrays(pa.array(np.minimum(np.arange(rows + 1) * part, len(values)), pa.int32()), values)


def linked(docs: DataFrame, keep: list[str], paths: tuple[str, str] = (A_PATH, B_PATH), part: int = PART) -> DataFrame:
    """Blocks of documents, each as rows (block, part, lists) that hold the next entries of all its lists: `rows` with the columns in keep, COUNTS and groups_sha256; `sizes`, the distinct pairs of each; `at`, which they are, and `links`, how often; `pairs`, the block's distinct pairs, and `docs`, how many of its documents hold each."""
    small_batches(docs.sparkSession)
    column = fresh("text", [*keep, *COUNTS, "groups_sha256"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first = _loaded(paths), TaskContext.get().partitionId() << 33
        for block, (batch, found) in enumerate(_blocks(batches, column, known), first):
            digests = [known.digest(p) for p in found]
            counts, doc, at, links, pairs = _links(known, found)
            rows = pa.StructArray.from_arrays([*[batch.column(c) for c in keep], *[pa.array(c) for c in counts.T], pa.array(digests, pa.string())], names=[*keep, *COUNTS, "groups_sha256"])
            values = [
                rows,
                pa.array(np.bincount(doc, minlength=len(found)), pa.int32()),
                pa.array(at, pa.int32()),
                pa.array(links, pa.int64()),
                pa.array(pairs, pa.int64()),
                pa.array(np.bincount(at, minlength=len(pairs)), pa.int64()),
            ]
            many = -(-max(map(len, values)) // part)
            numbers = [pa.array(np.full(many, block), pa.int64()), pa.array(np.arange(many), pa.int32())]
            yield pa.RecordBatch.from_arrays([*numbers, *[_listed(v, many, part) for v in values]], names=["block", "part", "rows", "sizes", "at", "links", "pairs", "docs"])

    kept = ", ".join([*[f"`{c}`: {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{c}: bigint" for c in COUNTS], "groups_sha256: string"])
    rows = docs.select(*keep, text_of().alias(column))
    return rows.mapInArrow(run, f"block bigint, part int, rows array<struct<{kept}>>, sizes array<int>, at array<int>, links array<bigint>, pairs array<bigint>, docs array<bigint>")


def link_counts(blocks: DataFrame) -> DataFrame:
    """(pair, docs, best): how many documents hold each pair of ids linked, and whether that is the most for its A id. The pair is A's id times 2^32 and B's id."""
    counts = blocks.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.docs").alias("docs"))
    # An A id has as many rows here as there are B ids that it is linked to, a vocabulary at most.
    most = F.max("docs").over(Window.partitionBy(F.shiftright("pair", 32)))
    return counts.select("pair", "docs", (F.col("docs") == most).alias("best"))


def alignment(docs: DataFrame, keep: list[str], paths: tuple[str, str] = (A_PATH, B_PATH), part: int = PART) -> DataFrame:
    """The columns in keep, COUNTS, groups_sha256, n_best and count_sum of each document."""
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.keep(linked(docs, keep, paths, part), "blocks", **{"parquet.block.size": ROW_GROUP})
    counts = scratch.keep(link_counts(blocks), "counts")
    places = blocks.select("block", "part", F.posexplode("pairs").alias("place", "pair")).withColumn("place", F.col("part") * part + F.col("place"))
    back = places.join(counts.hint("merge"), "pair").select(F.col("block").alias("of"), "place", "docs", "best")
    names = [*keep, *COUNTS, "groups_sha256", "n_best", "count_sum"]

    def run(own: pa.Table, found: pa.Table) -> pa.Table:
        own = own.sort_by("part") if own.num_rows > 1 else own
        rows, sizes, at, links = (lists(own.column(c))[1] for c in ("rows", "sizes", "at", "links"))
        sizes, at, links = (v.to_numpy(zero_copy_only=False) for v in (sizes, at, links))
        place = found.column("place").to_numpy()
        counts, best = (np.zeros(len(place), dtype=np.int64) for _ in range(2))
        counts[place], best[place] = found.column("docs").to_numpy(), found.column("best").to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        sums = [np.concatenate([[0], np.cumsum(links * v[at])]).astype(np.int64) for v in (best, counts)]
        return pa.Table.from_arrays([*rows.flatten(), *[pa.array(s[ends[1:]] - s[ends[:-1]]) for s in sums]], names=names)

    schema = ", ".join([*[f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep], *[f"{c} long" for c in COUNTS], "groups_sha256 string, n_best long, count_sum long"])
    own = blocks.select("block", "part", "rows", "sizes", "at", "links")
    return own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(run, schema)


def align(docs: DataFrame, keep: list[str], paths: tuple[str, str] = (A_PATH, B_PATH)) -> DataFrame:
    """The columns in keep and `a_ids`, `b_ids`, the tokens of both kinds, and `a_ends`, `b_ends`, where each group ends among them."""
    small_batches(docs.sparkSession)
    more = ["a_ids", "b_ids", "a_ends", "b_ends"]
    column = fresh("text", [*keep, *more])

    def whole(known: Aligner, places: np.ndarray | None) -> list[np.ndarray]:
        if places is None:
            return [np.zeros(0, dtype=np.int32)] * len(more)
        (a, a_many), (b, b_many), (ends, many) = (x.of(places) for x in (known.ids_a, known.ids_b, known.ends))
        ends = ends + np.repeat(np.stack([np.cumsum(a_many) - a_many, np.cumsum(b_many) - b_many], axis=1), many, axis=0)
        return [a, b, ends[:, 0], ends[:, 1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(paths)
        for batch, found in _blocks(batches, column, known):
            columns = list(zip(*[whole(known, p) for p in found], strict=True))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *[pa.array([v.astype(np.int32) for v in c], pa.list_(pa.int32())) for c in columns]], names=[*keep, *more])

    kept = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep]
    return docs.select(*keep, text_of().alias(column)).mapInArrow(run, ", ".join([*kept, *[f"{c} array<int>" for c in more]]))


def op12_stabbing_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignment of all documents."""
    return alignment(table(spark, sf_dir, "documents"), ["doc_id"])
