"""Operator 9, token counts: a Viterbi that carries only the best score and its number of pieces.

The vocabulary is a public one, its pieces with their scores taken as a unigram model. A word, with the
word mark before it, is one sentence of the model. An Aho-Corasick automaton gives all pieces that end
at each place; the program keeps for each place the best score up to there and the pieces on that
path. No path is stored and no text is cut up.

Tie rules, those of the tokenizers library's Unigram model: of equal scores the piece that starts
first, the longest, wins; a character that is no piece itself may be passed over at the least score
less 10, and only if that is better than any piece that ends there; it counts as many tokens as its
UTF-8 form has bytes, since the vocabulary has a piece for each byte.

Defined results. A null text is empty: no words, no tokens, score 0. Rows that repeat count alike. An
empty table gives no rows. Words may be of any length: work grows with length times the longest piece.
Null ids are kept like any others; columns kept may have any names but n_words, n_tokens and score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, small_batches, text_of, words
from millrace.llm.word_table import WordTable, blocks, lists
from millrace.session import table

PATH = public_tokenizers.path("piece_bpe_32k.model")
MARK = "▁"
UNKNOWN_PENALTY = 10.0

_tables: dict[str, WordTable] = {}


def vocabulary(path: str = PATH) -> list[tuple[str, float]]:
    """The pieces and scores of a vocabulary file, by id."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    """Counts the pieces of the best segmentation of a word."""

    def __init__(self, vocab: list[tuple[str, float]]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY

    def count(self, word: str) -> tuple[int, float]:
        """(pieces, score) of the mark and the word."""
        text = MARK + word
        scores, counts = [0.0] * (len(text) + 1), [0] * (len(text) + 1)
        done = 0  # places up to here are settled
        best = best_count = best_size = None
        single = False

        def settle(end: int) -> None:
            nonlocal best, best_count, best_size, single, done
            if not single:
                other = scores[end - 1] + self.unknown
                if best is None or other > best:
                    best, best_count = other, counts[end - 1] + len(text[end - 1].encode())
            scores[end], counts[end] = best, best_count
            best = best_count = best_size = None
            single, done = False, end

        for last, (size, score) in self.automaton.iter(text):
            while done < last:
                settle(done + 1)
            value = scores[last + 1 - size] + score
            if best is None or value > best or (value == best and size > best_size):
                best, best_count, best_size = value, counts[last + 1 - size] + 1, size
            single = single or size == 1
        while done < len(text):
            settle(done + 1)
        return counts[-1], scores[-1]


def _loaded(path: str) -> WordTable:
    if path not in _tables:
        counter = Counter(vocabulary(path))
        _tables[path] = WordTable(lambda new: [counter.count(w) for w in new])
    return _tables[path]


def count_tokens(docs: DataFrame, keep: list[str], path: str = PATH) -> DataFrame:
    """The columns in keep, n_words, n_tokens and the score of the best segmentation of all words."""
    small_batches(docs.sparkSession)
    word = fresh("words", [*keep, "n_words", "n_tokens", "score"])
    rows = docs.select(*keep, words(text_of()).alias(word))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _loaded(path)
        for batch in blocks(batches, word):
            offsets, flat = lists(batch.column(word))
            values, at = known.lookup(flat)
            counts, scores = np.array([c for c, _ in values], dtype=np.int64), np.array([s for _, s in values], dtype=np.float64)
            totals = [np.concatenate([[0], np.cumsum(x[at])]) for x in (counts, scores)]
            sums = [pa.array(t[offsets[1:]] - t[offsets[:-1]]) for t in totals]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(np.diff(offsets)), *sums], names=[*keep, "n_words", "n_tokens", "score"])

    kept = [f for f in docs.select(*keep).schema]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], "n_words long, n_tokens long, score double"])
    return rows.mapInArrow(run, schema)


def op9_viterbi_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token counts of all documents; scores of whole numbers, so their sum is exact."""
    return count_tokens(table(spark, sf_dir, "documents"), ["doc_id"])
