"""A table of distinct words inside a task: what costs much is done once for each distinct word of a block.

Spark splits the texts into words and deals the blocks out; here the words of a block are reduced to
the distinct ones, those not yet known are computed in one call, and the values go back to the words'
places through their indices. The table lives as long as its Python worker, so words that many
blocks share are computed once for each worker. It has two generations: at LIMIT words the younger becomes the
older one and what wasn't looked up since goes, which bounds its memory and changes no result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

LIMIT = 300_000
#: Words of whole rows that a task works on at once; a longer row is worked on alone.
BLOCK = 300_000


class WordTable:
    """Values of distinct words, each computed once while the table lasts."""

    def __init__(self, compute: Callable[[list[str]], list], limit: int = LIMIT):
        self.compute, self.limit, self.values, self.older = compute, limit, {}, {}

    def lookup(self, words: pa.Array) -> tuple[list, np.ndarray]:
        """(the values of the distinct words of this block, for each word the index of its value)."""
        if len(self.values) > self.limit:
            self.values, self.older = {}, self.values
        encoded = words.dictionary_encode()
        distinct = encoded.dictionary.to_pylist()
        values, older = self.values, self.older
        new = [w for w in distinct if w not in values]
        values.update((w, older[w]) for w in new if w in older)
        new = [w for w in new if w not in values]
        if new:
            values.update(zip(new, self.compute(new), strict=True))
        return [values[w] for w in distinct], encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)


def lists(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """(offsets, flat values) of a list column, whatever slice it is of."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], column.flatten()


def gathered(sizes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Indices that lay the stretches [start, start + size) one after another."""
    total = int(sizes.sum())
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(total)


def blocks(batches: Iterator[pa.RecordBatch], column: str, words: int = BLOCK) -> Iterator[pa.RecordBatch]:
    """Whole rows of the batches in blocks of about so many words of a list column, which bounds memory."""
    for batch in batches:
        offsets, _ = lists(batch.column(column))
        cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] // words)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """(rows, where their groups start and end) of batches that are sorted by the keys; no group is cut.

    The group at the end of a batch is held until the next one shows that it is over, so memory holds one
    batch and one group: whoever deals the rows out must bound the groups.
    """
    held: pa.RecordBatch | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        edges = _edges(rows, keys)
        if edges[-2]:
            yield rows.slice(0, int(edges[-2])), edges[:-1]
        held = rows.slice(int(edges[-2]))
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _edges(rows: pa.RecordBatch, keys: tuple[str, ...]) -> np.ndarray:
    new = np.zeros(max(rows.num_rows - 1, 0), dtype=bool)
    for k in keys:
        column = rows.column(k).to_numpy(zero_copy_only=False)
        new |= column[1:] != column[:-1]
    return np.concatenate([[0], np.flatnonzero(new) + 1, [rows.num_rows]])
