"""Every operator on empty tables, null ids, repeated rows, long texts and columns whose names clash with its own."""

import random
import re

import pytest

from millrace.llm import bpe, decontamination, line_dedup, lm_scoring, near_join, quality, secrets, sharding, substring_dedup, token_counts
from millrace.llm.common import shared_dir

NAMES = ["key", "key2", "th", "copies", "blob", "spans", "place", "bucket", "n", "first", "words", "h", "size", "rest", "word", "of", "counts", "measures", "__key", "__words", "__line_dedup", "start", "rid", "row", "before", "piece"]


def docs(spark, rows):
    schema = "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{n} string" for n in NAMES)
    return spark.createDataFrame([(i, t, "en", len(t or ""), *[f"{n}!" for n in NAMES]) for i, t in rows], schema)


def long_text(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    base = long_text(1, 60)
    lines = "\n".join(long_text(k, 12) for k in range(5))
    return [(None, base), (1, base), (1, base), (2, None), (3, ""), (4, " \n "), (5, lines), (5, lines), (6, "token: abcdefghijkl12"), (7, long_text(7, 30000)), (None, None)]


OPERATORS = {
    "line_dedup_stage": line_dedup.line_dedup_stage,
    "near_copies_stage": near_join.near_copies_stage,
    "quality_stage": lambda d: quality.quality_stage(d, d.sparkSession.createDataFrame([(1, 1), (None, 0), (2, None), (5, 0)], "doc_id long, quality int")),
    "decontamination_stage": lambda d: decontamination.decontamination_stage(d, d.sparkSession.createDataFrame([(1, "not in any text here"), (None, None)], "item_id long, text string")),
    "dedup_lines": lambda d: line_dedup.dedup_lines(d, counts="own_counts").drop("own_counts"),
    "numbered": lambda d: sharding.numbered(sharding.placed(d, sharding.key_text(), sharding.even_tree(1, 2, 2), "g1", "g2", "g3"), "g3", sharding.F.lit(5).cast("long"), ["doc_id"], "slot").drop("g1", "g2", "g3", "slot"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_columns_stay_whatever_their_names(spark, rows, name):
    df = docs(spark, rows)
    out = OPERATORS[name](df)
    assert out.columns == df.columns
    got = out.collect()
    assert all(r[n] == f"{n}!" for r in got for n in NAMES)
    if name in ("dedup_lines", "line_dedup_stage", "numbered", "decontamination_stage"):
        assert len(got) == len(rows)
    assert OPERATORS[name](df.limit(0)).count() == 0


KEEPING = {
    "substrings": lambda d, keep: substring_dedup.dedup_substrings(d, keep),
    "bpe": lambda d, keep: bpe.encode(d, keep, decoded=True),
    "tokens": lambda d, keep: token_counts.count_tokens(d, keep),
    "scores": lambda d, keep: lm_scoring.score(d, *lm_scoring.fit(d), keep, lm_scoring.word_counts(d)),
    "secrets": lambda d, keep: secrets.scan(d.select("text", *keep))[0],
}


@pytest.mark.parametrize("name", sorted(KEEPING))
def test_kept_columns_and_repeated_rows(spark, rows, name):
    keep = ["doc_id", *[n for n in NAMES if n not in ("words",) or name != "none"]]
    df = docs(spark, rows)
    out = KEEPING[name](df, keep)
    got = out.collect()
    assert len(got) == len(rows)
    assert all(r[n] == f"{n}!" for r in got for n in NAMES)
    more = [c for c in out.columns if c not in keep]
    alike = [tuple(str(r[c]) for c in more) for r in got if r.doc_id == 5]
    assert len(alike) == 2 and alike[0] == alike[1]  # rows that repeat have the same result
    assert sum(r.doc_id is None for r in got) == 2
    assert KEEPING[name](df.limit(0), keep).count() == 0


def test_equal_texts_score_alike(spark, rows):
    df = docs(spark, [*rows, *[(100 + i, rows[5 + 1][1]) for i in range(5)], (200, rows[0][1])])
    vocab, net = lm_scoring.fit(df)
    got = lm_scoring.score(df.repartition(3), vocab, net, ["doc_id"], lm_scoring.word_counts(df)).collect()
    assert len({(r.log_likelihood, r.mean_log_likelihood) for r in got if r.doc_id in (5, *range(100, 105))}) == 1
    assert len({r.log_likelihood for r in got if r.doc_id in (1, 200)}) == 1


def test_scores_against_brute_force(spark):
    """predict() and score() are the products of the softmaxes and of the words' shares, taken by hand."""
    import numpy as np

    df = docs(spark, [(1, "a b a c b a"), (2, "a a b zz")])
    counts = lm_scoring.word_counts(df)
    vocab, net = lm_scoring.fit(df, counts=counts)
    ids = {r.w: dict(vocab.tolist())[r.h] for r in spark.createDataFrame([(w,) for w in ("a", "b", "c", "zz")], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    row = [0, 0, *[ids[w] for w in "a b a c b a".split()], 0, 0]
    total = 0.0
    for i in range(2, len(row) - 2):
        around = [row[i - 2], row[i - 1], row[i + 1], row[i + 2]]
        hidden = np.tanh(sum(net["embed"][p][c].astype(float) for p, c in enumerate(around)))
        k, m = divmod(row[i], lm_scoring.SIDE)
        for logits, at in ((hidden @ net["class"] + net["class_bias"], k), (hidden @ net["word"][k] + net["word_bias"][k], m)):
            total += logits[at] - np.log(np.exp(logits).sum())
    got = {r.doc_id: r.log_likelihood for r in lm_scoring.score(df, vocab, net, ["doc_id"], counts).collect()}
    assert abs(got[1] - total) < 2e-3


def test_long_texts(spark):
    """One text of very many words and lines beside short ones, in operators that cut texts into windows."""
    big = long_text(3, 40000)
    lines = "\n".join(big[i : i + 40] for i in range(0, 80000, 40))
    df = docs(spark, [(1, big), (2, big), (3, lines), (4, lines + "\nend"), (5, "short")])
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).select("doc_id", "text").collect()}
    assert kept[3] == lines and kept[4] == "end"
    classes = {r.doc_id: r.class_id for r in near_join.grouped(df).collect()}
    assert classes == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    item = " ".join(big.split()[20000:20040])
    leaks = decontamination.leaks(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert {(r.doc_id, r.start, r.distance) for r in leaks} >= {(1, 20000, 0), (2, 20000, 0)}
    placed = sharding.placed(df.select("doc_id", "text"), sharding.key_text(), sharding.even_tree(1, 1, 2), "a", "b", "c")
    assert placed.count() == 5


def test_equal_rows_are_numbered_without_gaps(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 7)
    df = spark.createDataFrame([(1, "x")] * 50 + [(2, "y"), (None, None), (None, None)], "doc_id long, place string").withColumn("g", sharding.F.lit(0))
    rows = sharding.numbered(df, "g", sharding.F.coalesce("doc_id", sharding.F.lit(0)).cast("long"), ["doc_id"], "slot").collect()
    assert sorted(r.slot for r in rows) == list(range(53))
    assert sorted(r.slot for r in rows if r.doc_id == 1) == list(range(2, 52))


def test_ledger_in_a_folder(spark, tmp_path, rows):
    path = str(tmp_path / "ledger")
    assert secrets.read_ledger(spark, path) is None
    df = docs(spark, rows).select("doc_id", "text")
    first = secrets.append_ledger(df.filter("doc_id < 6"), path)
    n = secrets.read_ledger(spark, path).count()
    again = secrets.append_ledger(df, path)
    assert first.count() == 7 and again.count() == len(rows)
    assert n < secrets.read_ledger(spark, path).count() == df.selectExpr("sha2(coalesce(text, ''), 256)").distinct().count()
    assert [len(r.spans) for r in again.collect() if r.doc_id == 6] == [1]


def test_shared_folder_is_the_session_s(spark):
    assert re.search("shared", shared_dir(spark))
