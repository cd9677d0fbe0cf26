"""Operator 7, LM scoring: masked pseudo-likelihood by a bidirectional window network.

Every word of a text is predicted from the two words on each side of it; the sum of the log-probabilities is
the text's score. The network adds one embedding for each place of the window, applies tanh and ends
in a softmax over classes of words times a softmax over the words of the class, so a prediction costs
the root of the vocabulary and is a proper conditional probability.

The network tells the K most frequent words of all documents apart; all others are dealt to buckets by their hash. A word
in a bucket scores as the bucket, which the network predicts, times the word's share in it: n / (N + T) for a
word seen n times, where N and T are the words and the distinct words of the bucket, and for words that the counts lack
T / (N + T), or 1 where nothing was seen, times one in 257 for each byte and for the end. So a score is a probability of the very words, and
the counts of all words are joined to them, which grow with the corpus and stay in the cluster; only
the COMMON most frequent ones go to every task, so no key of that join holds many of the rows.
Training is data-parallel numpy: every task passes once over all words of its own documents (Adagrad,
minibatches, in an order drawn from a fixed seed), and the tasks' weights are averaged by their
numbers of words, in a shuffle that adds up single weights. So what is gathered grows with the corpus, while
the driver and the scoring tasks only ever hold one network, whose size is fixed by the settings.

Defined results. A text without words, null ones too, has no words to score: sum 0, mean null. Repeated rows count as
often in training. Equal texts get equal scores: sums are in 64-bit floats for each text, and what the shuffle adds up are whole
numbers, so neither a text's place nor the order of rows shows in the digits given. Without any words no network is needed.
The weights depend on how the input is dealt to tasks, as in any such training, but on nothing random.
Columns of the input may have any names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import fresh, small_batches, text_of, word_hashes, words, written
from millrace.llm.word_table import BLOCK as BLOCK_WORDS
from millrace.llm.word_table import blocks, gathered, lists
from millrace.session import table

SIDE = 32  # classes, and words in a class
K = 992  # words with an id of their own: 1 to K; 0 is beyond the text's ends
OTHER = SIDE * SIDE - K - 1  # buckets for all other words
DIM = 16
REACH = 2
BATCH = 8192
RATE = 0.15
BLOCK = 1024
COMMON = 250_000  # words whose shares every task has: 4 MB at most
UNIT = 2.0**20  # shares are added up as whole numbers of 1 / UNIT

Net = dict[str, np.ndarray]


def new_net(counts: np.ndarray, seed: int = 3) -> Net:
    """A network that predicts the given counts of ids, whatever is around."""
    rng = np.random.default_rng(seed)
    by = (counts + 1.0).reshape(SIDE, SIDE)
    return {
        "embed": rng.normal(0, 0.1, (2 * REACH, SIDE * SIDE, DIM)).astype(np.float32),
        "class": rng.normal(0, 0.1, (DIM, SIDE)).astype(np.float32),
        "class_bias": np.log(by.sum(1) / by.sum()).astype(np.float32),
        "word": rng.normal(0, 0.1, (SIDE, DIM, SIDE)).astype(np.float32),
        "word_bias": np.log(by / by.sum(1, keepdims=True)).astype(np.float32),
    }


def packed(net: Net) -> np.ndarray:
    return np.concatenate([v.ravel() for v in net.values()])


def unpacked(flat: np.ndarray, like: Net) -> Net:
    out, at = {}, 0
    for name, v in like.items():
        out[name], at = flat[at : at + v.size].reshape(v.shape).astype(np.float32), at + v.size
    return out


def _softmax(x: np.ndarray, at: np.ndarray, weights: np.ndarray, bias: np.ndarray, grad: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """(log-probabilities at one column of each row, the gradient of their sum by x); x, made of weights and biases, is overwritten.

    For inputs from -1 to 1 the weights bound how far the values of x lie apart; if exp() can span that, one shift serves all rows.
    """
    rows = np.arange(len(x))
    spread = 2 * np.abs(weights).sum(axis=-2).max() + bias.max() - bias.min()
    x -= x.max(axis=1, keepdims=True) if spread > 60 else bias.max()
    own = x[rows, at]
    np.exp(x, out=x)
    total = x @ np.ones(x.shape[1], dtype=x.dtype)
    if grad:
        x /= -total[:, None]
        x[rows, at] += 1
    return own - np.log(total), x if grad else None


def predict(net: Net, context: np.ndarray, target: np.ndarray, grad: Net | None = None) -> np.ndarray:
    """Log-probabilities of the targets; with grad, the gradients of their mean are put there."""
    # All work is done in the order of the classes, so that each class's words lie together.
    order = np.argsort((target // SIDE).astype(np.uint8), kind="stable")
    context, target = np.take(context, order, axis=0).T.copy(), target[order]
    kind, member = target // SIDE, target % SIDE
    ends = np.searchsorted(kind, np.arange(SIDE + 1))
    some = [(k, slice(ends[k], ends[k + 1])) for k in np.flatnonzero(np.diff(ends))]
    hidden = np.take(net["embed"][0], context[0], axis=0)
    for p in range(1, 2 * REACH):
        hidden += np.take(net["embed"][p], context[p], axis=0)
    np.tanh(hidden, out=hidden)
    scores = hidden @ net["class"]
    scores += net["class_bias"]
    of_class, d_class = _softmax(scores, kind, net["class"], net["class_bias"], grad is not None)
    scores = np.empty((len(target), SIDE), dtype=hidden.dtype)
    for k, at in some:
        np.matmul(hidden[at], net["word"][k], out=scores[at])
        scores[at] += net["word_bias"][k]
    of_word, d_word = _softmax(scores, member, net["word"], net["word_bias"], grad is not None)
    out = np.empty(len(target), dtype=hidden.dtype)
    out[order] = of_class + of_word
    if grad is not None:
        ones = np.ones(len(target), dtype=hidden.dtype)
        grad["class"][:], grad["class_bias"][:] = hidden.T @ d_class, ones @ d_class
        back = d_class @ net["class"].T
        grad["word"][:], grad["word_bias"][:] = 0, 0
        for k, at in some:
            grad["word"][k], grad["word_bias"][k] = hidden[at].T @ d_word[at], ones[at] @ d_word[at]
            back[at] += d_word[at] @ net["word"][k].T
        back *= 1 - hidden**2
        for p in range(2 * REACH):
            by = np.argsort(context[p].astype(np.uint16), kind="stable")
            ids = context[p][by]
            first = np.concatenate([[0], np.flatnonzero(np.diff(ids)) + 1]) if len(ids) else np.zeros(0, dtype=np.int64)
            grad["embed"][p][:] = 0
            grad["embed"][p][ids[first]] = np.add.reduceat(np.take(back, by, axis=0), first) if len(ids) else 0
        for g in grad.values():
            g /= len(target)
    return out


def train(net: Net, blocks: Iterator[tuple[np.ndarray, np.ndarray]], seed: int = 5) -> tuple[Net, int]:
    """One pass over blocks of (ids with REACH zeros around each text, places of words); the words seen."""
    net = {k: v.copy() for k, v in net.items()}
    grad, power = ({k: np.zeros_like(v) for k, v in net.items()} for _ in range(2))
    rng, seen = np.random.default_rng(seed), 0
    reach = np.array([i for i in range(-REACH, REACH + 1) if i])
    for ids, places in blocks:
        places = rng.permutation(places)
        seen += len(places)
        for k in range(0, len(places), BATCH):
            at = places[k : k + BATCH]
            predict(net, ids[at[:, None] + reach], ids[at], grad)
            for name, g in grad.items():
                power[name] += g * g
                net[name] += RATE * g / (np.sqrt(power[name]) + 1e-6)
    return net, seen


def framed(offsets: np.ndarray, hashes: np.ndarray, vocab: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids with REACH zeros around each text, places of the words); vocab is sorted by hash: (hash, id)."""
    at = np.minimum(np.searchsorted(vocab[:, 0], hashes), max(len(vocab) - 1, 0))
    known = vocab[at, 0] == hashes if len(vocab) else np.zeros(len(hashes), dtype=bool)
    other = K + 1 + (hashes.astype(np.uint64) % np.uint64(OTHER)).astype(np.int64)
    ids = np.where(known, vocab[at, 1] if len(vocab) else 0, other)
    sizes = np.diff(offsets)
    places = gathered(sizes, np.cumsum(sizes + 2 * REACH) - sizes - REACH)
    out = np.zeros(int((sizes + 2 * REACH).sum()), dtype=np.int64)
    out[places] = ids
    return out, places


def _blocks(batches: Iterator[pa.RecordBatch], vocab: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in blocks(batches, "h", 10 * BLOCK_WORDS):
        offsets, flat = lists(batch.column("h"))
        yield framed(offsets, flat.to_numpy(zero_copy_only=False), vocab)


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, n): how often the words of all documents occur, by their hash."""
    return written(docs.select(F.explode(word_hashes(text_of())).alias("h")).groupBy("h").agg(F.count("*").alias("n")), "word-counts")


def _sized() -> Column:
    """The words of a text as structs of their hash and their bytes."""
    return F.transform(words(text_of()), lambda w: F.struct(F.xxhash64(w).alias("h"), F.octet_length(w).alias("size")))


def vocabulary(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """((hash, id) of the K most frequent words, sorted by hash; counts of all ids)."""
    top = counts.orderBy(F.desc("n"), "h").limit(K).collect()
    total = counts.agg(F.sum("n")).first()[0] or 0
    ids = np.zeros(SIDE * SIDE)
    ids[1 : len(top) + 1] = [r["n"] for r in top]
    ids[K + 1 :] = (total - ids.sum()) / OTHER
    return np.array(sorted((r["h"], i + 1) for i, r in enumerate(top)), dtype=np.int64).reshape(-1, 2), ids


def _bucket(h: Column) -> Column:
    """The bucket of a hash, from 0; the hash counts as unsigned, as in framed()."""
    return F.pmod(F.pmod(h, F.lit(OTHER)) + F.when(h < 0, 2**64 % OTHER).otherwise(0), F.lit(OTHER)).cast("int")


def _shares(spark: SparkSession, vocab: np.ndarray, counts: DataFrame | None) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(broadcast (h) of the words with an id, (h, share) of all others that were counted, the log-share of a word that wasn't by bucket)."""
    known = F.broadcast(spark.createDataFrame([(int(h),) for h in vocab[:, 0]], "h long"))
    rare = (spark.createDataFrame([], "h long, n long") if counts is None else counts).join(known, "h", "left_anti")
    whole, new = np.zeros(OTHER), np.zeros(OTHER)  # logs of N + T and of T / (N + T)
    for r in rare.groupBy(_bucket(F.col("h")).alias("b")).agg(F.sum("n").alias("n"), F.count("*").alias("t")).collect():
        whole[r["b"]], new[r["b"]] = math.log(r["n"] + r["t"]), math.log(r["t"] / (r["n"] + r["t"]))
    of = F.get(F.lit(whole.tolist()), _bucket(F.col("h")))
    return known, rare.select("h", "n", (F.log("n") - of).alias("share")), new


def _common(shares: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, log-shares in 1 / UNIT) of the most frequent words, COMMON at most: those above a count that is found from a histogram."""
    level = F.floor(4 * F.log2("n")).cast("int")
    total, least = 0, None
    for r in sorted(shares.groupBy(level.alias("level")).agg(F.count("*").alias("words")).collect(), reverse=True):
        total += r["words"]
        if total > COMMON:
            break
        least = r["level"]
    some = shares.filter(level >= least if least is not None else F.lit(False)).select("h", "share").toArrow()
    h, share = some.column("h").to_numpy(), some.column("share").to_numpy()
    order = np.argsort(h)
    return h[order], np.round(share[order] * UNIT)


def _summed(rows: DataFrame, shares: DataFrame, new: np.ndarray, key: str) -> DataFrame:
    """(key, rare, found): the words of rows (key, h, size), their number and the sum of their log-shares in 1 / UNIT."""
    unseen = F.get(F.lit(new.tolist()), _bucket(F.col("h"))) - (F.col("size") + 1) * math.log(257)
    log = F.round(F.coalesce("share", unseen) * UNIT).cast("long")
    return rows.join(shares.select("h", "share").hint("shuffle_hash"), "h", "left").groupBy(key).agg(F.sum(log).alias("rare"), F.count("*").alias("found"))


def rare_logs(docs: DataFrame, vocab: np.ndarray, counts: DataFrame | None, key: str) -> DataFrame:
    """(key, the mean log-share in their buckets of the words without an id) of the rows in docs (key, text)."""
    known, shares, new = _shares(docs.sparkSession, vocab, counts)
    word = fresh("word", docs.columns)
    each = docs.select(key, F.explode(_sized()).alias(word)).select(key, f"{word}.h", f"{word}.size").join(known, "h", "left_anti")
    return _summed(each, shares, new, key).select(key, (F.col("rare") / F.col("found") / UNIT).alias("rare_log"))


def fit(docs: DataFrame, rounds: int = 1, counts: DataFrame | None = None) -> tuple[np.ndarray, Net]:
    """(vocabulary, network) trained on all documents; each round starts from the last round's average."""
    small_batches(docs.sparkSession)
    vocab, counts = vocabulary(word_counts(docs) if counts is None else counts)
    net = new_net(counts)
    rows = docs.select(word_hashes(text_of()).alias("h")).filter(F.size("h") > 0)
    for _ in range(rounds):
        shared = rows.sparkSession.sparkContext.broadcast((vocab, net))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, net = shared.value
            trained, seen = train(net, _blocks(batches, vocab))
            if seen:
                flat = packed(trained)
                for k in range(0, len(flat), BLOCK):
                    part = flat[k : k + BLOCK].astype(np.float64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, k + len(part), dtype=np.int32)), pa.array(part * seen), pa.array(np.full(len(part), seen, dtype=np.int64))], names=["at", "weighted", "seen"])

        sums = rows.mapInArrow(run, "at int, weighted double, seen long").groupBy("at").agg((F.sum("weighted") / F.sum("seen")).alias("v")).toArrow()
        if sums.num_rows:
            flat = np.empty(sums.num_rows)
            flat[sums.column("at").to_numpy()] = sums.column("v").to_numpy()
            net = unpacked(flat, net)
    return vocab, net


def score(docs: DataFrame, vocab: np.ndarray, net: Net, keep: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The columns in keep, n_words, log_likelihood (the sum) and mean_log_likelihood of each document.

    counts are the word_counts() of the training documents; without them all words without an id are spelled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    key, word = fresh("key", keep), fresh("word", keep)
    # Rows that agree in the key hold the same words.
    rows = docs.select(*keep, F.xxhash64(*keep, text_of()).alias(key), _sized().alias(word))
    _, shares, new = _shares(spark, vocab, counts)
    common = _common(shares)
    shared = spark.sparkContext.broadcast((vocab, {k: v.astype(np.float64) for k, v in net.items()}, common))
    reach = np.array([i for i in range(-REACH, REACH + 1) if i])
    rest = fresh("rest", keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, net, (hashes, logs) = shared.value
        for batch in blocks(batches, word):
            offsets, structs = lists(batch.column(word))
            flat, sizes = (pc.struct_field(structs, c).to_numpy(zero_copy_only=False) for c in ("h", "size"))
            ids, places = framed(offsets, flat, vocab)
            row = np.repeat(np.arange(batch.num_rows), np.diff(offsets))
            each = np.zeros(len(places))
            for k in range(0, len(places), BATCH):
                at = places[k : k + BATCH]
                each[k : k + len(at)] = predict(net, ids[at[:, None] + reach], ids[at])
            left = np.flatnonzero(ids[places] > K)
            if len(hashes):
                place = np.minimum(np.searchsorted(hashes, flat[left]), len(hashes) - 1)
                found = hashes[place] == flat[left]
                each[left[found]] += logs[place[found]] / UNIT
                left = left[~found]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[left], minlength=batch.num_rows))]).astype(np.int32)
            more = pa.StructArray.from_arrays([pa.array(flat[left]), pa.array(sizes[left].astype(np.int32))], names=["h", "size"])
            total = np.bincount(row, weights=each, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in [*keep, key]], pa.array(np.diff(offsets)), pa.array(total), pa.ListArray.from_arrays(pa.array(ends), more)], names=[*keep, key, "n_words", "sum", rest])

    schema = ", ".join([*[f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in [*keep, key]], f"n_words long, sum double, `{rest}` array<struct<h:long,size:int>>"])
    scored = written(rows.mapInArrow(run, schema), "scored")
    found = _summed(scored.select(key, F.explode(rest).alias("w")).select(key, "w.h", "w.size"), shares, new, key)
    # Rows that repeat share their key and add up as often, so their words' mean is that of each.
    out = scored.join(found.hint("merge"), key, "left")
    out = out.withColumn("sum", F.col("sum") + F.coalesce(F.size(rest) * (F.col("rare") / F.col("found")) / UNIT, F.lit(0.0)))
    mean = F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words"))
    return out.select(*keep, "n_words", F.round("sum", 4).alias("log_likelihood"), F.round(mean, 6).alias("mean_log_likelihood"))


def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by a network trained on all of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counts = word_counts(docs)
    vocab, net = fit(docs, counts=counts)
    return score(docs, vocab, net, ["doc_id"], counts)
