"""Operator 5, BPE encoding and decoding through tables of distinct words.

Spark splits each text at ASCII white space, which no token crosses and every normalizer step leaves a
border; distinct words are encoded by the tokenizer whose file is given, and their ids are joined back by position.
Decoding joins ids with the vocabulary's pieces and puts one space between pieces, which is what the
tokenizer does when its file names no decoder.

There are two forms with the same rows. encode_joined() and decode_joined() are tables and joins throughout: one table of
all distinct words, each encoded once, joined to every word's place, and a join of every id with its piece. They move each word's and each
id's place through a shuffle, which takes more disk than operator 5 may have (figures in the README).
encode() and decode() keep the tables of distinct words for each Python worker, so a word is encoded once for
each worker that meets it, and nothing is shuffled; the query uses these.

Defined results. A null text is empty: no ids, and the decoded text is empty. Rows that repeat give the
same result, each. An empty table gives no rows. Texts may be of any length and hold the strings of
special tokens, which become their ids. The columns kept may have any names but `ids` and `decoded`.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, small_batches, text_of, words
from millrace.llm.word_table import WordTable, blocks, gathered, lists
from millrace.session import table

PATH = public_tokenizers.path("word_bpe_49k.json")

_tables: dict[str, tuple[WordTable, pa.Array]] = {}


def _loaded(path: str) -> tuple[WordTable, pa.Array]:
    """The worker's word table and the pieces by id."""
    if path not in _tables:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.no_truncation()
        t.no_padding()
        pieces = [t.id_to_token(i) for i in range(t.get_vocab_size(with_added_tokens=True))]
        _tables[path] = WordTable(lambda new: [array("i", e.ids).tobytes() for e in t.encode_batch(new, add_special_tokens=False)]), pa.array(pieces, pa.string())
    return _tables[path]


def _ids(words: pa.Array, path: str) -> pa.ListArray:
    """The ids of each row of words; each distinct word is encoded once and its ids joined back by position."""
    offsets, flat = lists(words)
    values, at = _loaded(path)[0].lookup(flat)
    sizes = np.array([len(v) // 4 for v in values], dtype=np.int64)
    each = sizes[at]
    ends = np.concatenate([[0], np.cumsum(each)])
    ids = np.frombuffer(b"".join(values), dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(ends[offsets].astype(np.int32)), pa.array(ids[gathered(each, (np.cumsum(sizes) - sizes)[at])]))


def _decoded(ids: pa.Array, path: str) -> pa.Array:
    """The text of each row of ids: ids joined with pieces, one space between them."""
    offsets, flat = lists(ids)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _loaded(path)[1].take(flat)), " ")


def _schema(df: DataFrame, keep: list[str], *more: str) -> str:
    return ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep], *more])


def encode(docs: DataFrame, keep: list[str], path: str = PATH, decoded: bool = False) -> DataFrame:
    """The columns in keep and `ids`, the token ids of the whole text; if asked for, `decoded`, the text of these ids."""
    names = [*keep, "ids", *["decoded"] * decoded]
    word = fresh("words", names)
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, word):
            ids = _ids(batch.column(word), path)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], ids, *[_decoded(ids, path)] * decoded], names=names)

    rows = docs.select(*keep, words(text_of()).alias(word))
    return rows.mapInArrow(run, _schema(docs, keep, "ids array<int>", *["decoded string"] * decoded))


def decode(encoded: DataFrame, keep: list[str], path: str = PATH) -> DataFrame:
    """The columns in keep and `decoded`, the text of the column ids; null ids are none."""
    own = fresh("own_ids", [*keep, "decoded"])
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, own):
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], _decoded(batch.column(own), path)], names=[*keep, "decoded"])

    rows = encoded.select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias(own))
    return rows.mapInArrow(run, _schema(encoded, keep, "decoded string"))


def word_table(words: DataFrame, path: str = PATH) -> DataFrame:
    """(word, ids) of the distinct words of a table (word), each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, at = _loaded(path)[0].lookup(batch.column("word"))
            ids = pa.array([np.frombuffer(values[i], dtype=np.int32) for i in at], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("word"), ids], names=["word", "ids"])

    return words.select("word").distinct().mapInArrow(run, "word string, ids array<int>")


def pieces(spark: SparkSession, path: str = PATH) -> DataFrame:
    """(id, piece) of the vocabulary, whose size is that of its file."""
    found = _loaded(path)[1].to_pylist()
    return spark.createDataFrame(list(enumerate(found)), "id int, piece string")


def _in_order(rows: DataFrame, key: str, place: str, value: str) -> DataFrame:
    return rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda x: x[value]).alias(value))


def encode_joined(docs: DataFrame, keep: list[str], path: str = PATH) -> DataFrame:
    """What encode() returns, by joins: one table of distinct words, its ids joined to each word's place."""
    scratch, key = Scratch(docs.sparkSession, "bpe"), fresh("row", [*keep, "ids"])
    small_batches(docs.sparkSession)
    rows = scratch.keep(docs.select(*keep, F.monotonically_increasing_id().alias(key), words(text_of()).alias("__words")), "rows")
    places = rows.select(key, F.posexplode("__words").alias("place", "word"))
    table_of = scratch.keep(word_table(places, path), "words")
    listed = _in_order(places.join(table_of.hint("merge"), "word").select(key, "place", "ids"), key, "place", "ids").select(key, F.flatten("ids").alias("ids"))
    return rows.select(*keep, key).join(listed.hint("merge"), key, "left").select(*keep, F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))


def decode_joined(encoded: DataFrame, keep: list[str], path: str = PATH) -> DataFrame:
    """What decode() returns, by a join of each id with its piece."""
    scratch, key = Scratch(encoded.sparkSession, "bpe-ids"), fresh("row", [*keep, "decoded"])
    rows = scratch.keep(encoded.select(*keep, F.monotonically_increasing_id().alias(key), F.col("ids").alias("__ids")), "rows")
    places = rows.select(key, F.posexplode("__ids").alias("place", "id"))
    joined = places.join(F.broadcast(pieces(encoded.sparkSession, path)), "id").select(key, "place", "piece")
    listed = _in_order(joined, key, "place", "piece").select(key, F.array_join("piece", " ").alias("decoded"))
    return rows.select(*keep, key).join(listed.hint("merge"), key, "left").select(*keep, F.coalesce("decoded", F.lit("")).alias("decoded"))


def digests(docs: DataFrame, path: str = PATH) -> DataFrame:
    """doc_id, the number of ids and the hashes of the ids and of the decoded text."""
    return encode(docs, ["doc_id"], path, decoded=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op5_bpe_word_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return digests(table(spark, sf_dir, "documents"))
