"""Operators 11, 12 and 13 against brute force, and the ledger under two writers."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, filter_audit, rule_ensemble, secrets

EXTRA = ["part", "fails", "th", "first", "good", "rows", "block", "pairs", "stats", "order", "at", "links", "sizes", "text_", "bit", "step"]


def table(spark, rows):
    schema = "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in EXTRA)
    return spark.createDataFrame([(*r, *["x"] * len(EXTRA)) for r in rows], schema)


# Operator 11


def audit_brute(docs, labels):
    first = {}
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    flags = []
    for i, text, lang in docs:
        text = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        e = i is not None and i > first[text]
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), "D": bool(re.search("[#$%&*|]", text)), "E": e}
        mine = [(q, t) for j, q, t in labels if j is not None and j == i]
        flags.append((lang or "", {k for k, v in fails.items() if v}, any(q == 1 for q, _ in mine), any(t == 1 for _, t in mine)))
    out, total = {}, {}
    for part in {f[0] for f in flags}:
        for order in itertools.permutations("ABCDE"):
            for step in range(1, 6):
                c = [0] * 6
                for p, fails, good, toxic in flags:
                    if p == part:
                        hit = next((k + 1 for k, f in enumerate(order) if f in fails), 6)
                        gone, own = hit == step, order[step - 1]
                        for k, v in enumerate((hit > step, gone, own in fails and hit < step, fails == {own}, gone and good, gone and toxic)):
                            c[k] += v
                out[part, "".join(order), step] = c
                total[part, own] = total.get((part, own), 0) + c[1]
    return {k: (*c, total[k[0], k[1][k[2] - 1]]) for k, c in out.items()}


def test_filter_audit(spark):
    r = random.Random(4)
    texts = [None, "", " \n", "A B C", "a#b", " ".join(f"w{i}" for i in range(120)), " ".join(f"W{i % 40}" for i in range(120)), "é" * 9 + "A", "x " * 5000, "\x1c\x85 a|b"]
    docs = [(r.choice([None, *range(12)]), r.choice(texts), r.choice(["en", "de", None, ""])) for _ in range(150)]
    labels = [(r.choice([None, *range(12)]), r.choice([0, 1, None]), r.choice([0, 1, None])) for _ in range(14)]
    found = filter_audit.replayed(filter_audit.flagged(table(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = {(x.part, x.filter_order, x.step): (x.kept, x.removed, x.redundant, x.unique_fails, x.good_lost, x.toxic_lost, x.shapley) for x in found.collect()}
    assert got == audit_brute(docs, labels)
    assert [f.dataType.simpleString() for f in found.schema] == ["string", "string", "int", *["bigint"] * 7]


def test_filter_audit_empty(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.replayed(filter_audit.flagged(table(spark, []), labels)).isEmpty()
    some = filter_audit.replayed(filter_audit.flagged(table(spark, [(1, "a", None)]), labels)).collect()
    assert len(some) == 600 and {(x.part, x.kept) for x in some if x.step == 5} == {("", 0)}


# Operator 12

ALPHABET = [*"abcdeÉßЖ中\n\t  ..'\"0123▁<>|\x1c\x85 　😀", "é", "<|endoftext|>", "<s>", "<0x0A>", " the", " of", "'s", "  ", "====", "\r\n", "\0"]


def texts_of(n):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(0, 40))) for _ in range(n)]


def align_brute(known, text):
    """(counts, digest, pairs, groups) of a text by both libraries over the whole text."""
    nothing = (0, 0, 0, 0, ""), {}, []
    if not text:
        return nothing
    a, b = known.a.encode(" " + text, add_special_tokens=False).ids, known.b.encode(text)
    ends = [list(itertools.accumulate(len(t[i]) for i in ids)) for t, ids in ((known.a_bytes, a), (known.b_bytes, b))]
    if any(b"".join(t[i] for i in ids) != (" " + text).encode() for t, ids in ((known.a_bytes, a), (known.b_bytes, b))):
        return nothing
    groups, pairs, i, j = [], {}, 0, 0
    for end in sorted(set(ends[0]) & set(ends[1])):
        x, y = ends[0].index(end) + 1, ends[1].index(end) + 1
        groups.append((a[i:x], b[j:y]))
        for p in itertools.product(a[i:x], b[j:y]):
            pairs[p] = pairs.get(p, 0) + 1
        i, j = x, y
    shown = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
    return (len(a), len(b), len(groups), sum(pairs.values()), hashlib.sha256(shown.encode()).hexdigest()), pairs, groups


@pytest.fixture(scope="module")
def known():
    return alignment.Aligner(alignment.A_PATH, alignment.B_PATH)


@pytest.mark.parametrize("large", [4096, 2])
def test_stretches_are_texts(known, monkeypatch, large):
    monkeypatch.setattr(alignment, "LARGE", large)
    known.reset()
    texts = [*texts_of(1500), "=" * 3000 + "\n" + "-" * 999, "a" * 5000, " " * 700, "ab=" * 2000]
    found = known.places(texts)
    counts, doc, at, links, pairs = alignment._links(known, found)
    mine = [{} for _ in texts]
    for d, p, n in zip(doc, at, links, strict=True):
        mine[d][int(pairs[p]) >> 32, int(pairs[p]) & 0xFFFFFFFF] = int(n)
    for k, text in enumerate(texts):
        want, links_of, _ = align_brute(known, text)
        assert ((*counts[k].tolist(), known.digest(found[k])), mine[k]) == (want, links_of), text


def test_bisections():
    low, high = alignment.overlaps(np.array([2, 4, 7]), np.array([1, 5, 7]))
    assert (low.tolist(), high.tolist()) == ([0, 1, 1], [2, 2, 3])
    assert [x.tolist() for x in alignment.groups(np.array([2, 4, 7]), np.array([1, 5, 7]))] == [[3], [3]]
    assert [x.tolist() for x in alignment.groups(np.array([2, 5, 7]), np.array([1, 5, 7]))] == [[2, 3], [2, 3]]


def test_alignment(spark, known):
    texts = [None, "", *texts_of(120), "the cat", "the cat", "a▁b", "the end of the cat " * 4000]
    docs = table(spark, [(k if k % 7 else None, t, "en") for k, t in enumerate(texts)])
    keep = ["doc_id", *EXTRA]
    got = alignment.alignment(docs.repartition(3), [*keep]).collect()
    want = [align_brute(known, t)[:2] for t in texts]
    held = {}
    for _, pairs in want:
        for p in pairs:
            held[p] = held.get(p, 0) + 1
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    rows = [(k if k % 7 else None, *w, sum(n for p, n in pairs.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in pairs.items())) for k, (w, pairs) in enumerate(want)]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted([(x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum) for x in got], key=key) == sorted(rows, key=key)
    assert all(x[n] == "x" for x in got for n in EXTRA)
    assert alignment.alignment(docs.limit(0), keep).isEmpty()
    whole = {x.doc_id: x for x in alignment.align(docs.filter("doc_id IS NOT NULL"), ["doc_id"]).collect()}
    for k, t in enumerate(texts):
        if k % 7:
            ends = [[0, *whole[k].a_ends], [0, *whole[k].b_ends]]
            cut = [list(zip(e, e[1:], strict=False)) for e in ends]
            assert [(list(whole[k].a_ids[p:q]), list(whole[k].b_ids[r:s])) for (p, q), (r, s) in zip(*cut, strict=True)] == align_brute(known, t)[2]


def test_blocks_in_bounded_rows(spark, known):
    """A block's lists come in rows of bounded size, and their parts make the same results as one row of each."""
    r = random.Random(6)
    words = ["".join(r.choice("abcdefghiéß0123.'") for _ in range(r.randrange(1, 9))) for _ in range(900)]
    texts = [" ".join(r.choice(words) for _ in range(40)) for _ in range(300)]
    docs = table(spark, [(k, t, "en") for k, t in enumerate([*texts, "", None])]).coalesce(1)
    blocks = alignment.linked(docs, ["doc_id"])
    lists = ["rows", "sizes", "at", "links", "pairs", "docs"]
    most = blocks.agg(*[F.max(F.size(c)).alias(c) for c in lists], *[F.sum(F.size(c)).alias(f"all_{c}") for c in lists]).first()
    assert most["all_at"] > 8192 and max(most[c] for c in lists) <= 8192
    assert most["all_rows"] == most["all_sizes"] == 302 and most["all_at"] == most["all_links"] and most["all_pairs"] == most["all_docs"]
    want = [align_brute(known, t)[:2] for t in [*texts, "", None]]
    held = {}
    for _, pairs in want:
        for p in pairs:
            held[p] = held.get(p, 0) + 1
    most = {}
    for (a, _), n in held.items():
        most[a] = max(n, most.get(a, 0))
    rows = {(k, *w, sum(n for p, n in pairs.items() if held[p] == most[p[0]]), sum(n * held[p] for p, n in pairs.items())) for k, (w, pairs) in enumerate(want)}
    for part in (8192, 7):
        got = alignment.alignment(docs, ["doc_id"], part=part).collect()
        assert {(x.doc_id, x.n_a, x.n_b, x.n_groups, x.n_links, x.groups_sha256, x.n_best, x.count_sum) for x in got} == rows and len(got) == len(rows)


# Operator 13


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def scores(spark, docs, labels):
    rows = rule_ensemble.measured(docs)
    return rule_ensemble.scored(rows, rule_ensemble.fit(rows, labels))


def test_statistics(spark):
    texts = [None, "", " \n ", "Aa bb, 12!\nAa bb, 12!\n\nx ## x", "é" * 300]
    rows = table(spark, [(k, t, "en") for k, t in enumerate(texts)]).select("doc_id", rule_ensemble.statistics(F.coalesce("text", F.lit(""))).alias("s")).orderBy("doc_id").collect()
    assert all(v == 0 for r in rows[:2] for v in r.s) and all(v is not None for r in rows for v in r.s)
    s = rows[3].s
    assert (s.words, s.lines, s.longest_word, s.dup_line_share, s.symbol_runs) == (9, 3, 3, 1 / 3, 1 / 9)
    assert (s.distinct_share, s.repeat_share, s.digit_share, s.upper_share) == (5 / 9, 1 - 6 / 7, 4 / 20, 2 / 10)


def test_rules_without_labels(spark):
    docs = table(spark, [(k, f"word {k}", "en") for k in range(20)] + [(None, None, None), (3, "word 3", "en")])
    got = scores(spark, docs, labelled(spark, [(None, 1, 0), (4, None, 0), (5, 1, 0), (5, 0, 0)])).collect()
    assert len(got) == 22 and {(x.score, x.predicted) for x in got} == {(0.5, 1)}
    assert all(x.held_out == (zlib.crc32(("" if x.doc_id is None else str(x.doc_id)).encode()) % 5 == 0) for x in got)
    ids = [k for k in range(20) if zlib.crc32(str(k).encode()) % 5]
    only = scores(spark, docs.filter("doc_id <> 3"), labelled(spark, [(k, 0, 0) for k in ids if k != 3] * 2)).collect()
    n = len([k for k in ids if k != 3])
    assert all(abs(x.score - 1 / (n + 2)) < 1e-12 and x.predicted == 0 for x in only)
    assert scores(spark, docs.limit(0), labelled(spark, [(1, 1, 0)])).isEmpty()


def test_rules_from_labels(spark):
    """Held-out accuracy over the driver's documents, the same scores by the Column as in numpy, few rules, and no use of held-out labels."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = rule_ensemble.measured(docs)
    model = rule_ensemble.fit(rows, labels)
    held = rule_ensemble.scored(rows, model).filter("held_out").join(labels, "doc_id").collect()
    assert len(held) > 50 and np.mean([x.quality == x.predicted for x in held]) >= 0.97
    assert {x.predicted for x in held} == {0, 1} and all(0 < x.score < 1 for x in held)
    some = rows.select("stats.*", model.column(F.col("stats")).alias("score")).limit(200).collect()
    assert np.allclose([x.score for x in some], model.predict(np.array([x[:-1] for x in some], dtype=float)))
    assert 0 < len(model.rules) < 120 and all(w != 0 for w in model.weights) and " and " in " ".join(map(str, model.rules))
    turned = labels.withColumn("quality", F.when(rule_ensemble.fold(F.col("doc_id")) == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert rule_ensemble.fit(rows, turned) == model
    assert rule_ensemble.fit(rows, labels, sample=50) != model


def test_lasso_is_sparse_and_least():
    """Few weights, and no small step lowers the penalised loss."""
    r = np.random.default_rng(2)
    z = (r.random((400, 30)) < 0.4).astype(float)
    y = (r.random(400) < 1 / (1 + np.exp(1 - 3 * z[:, 0] + 2 * z[:, 1]))).astype(float)
    bias, w = rule_ensemble.lasso(z, y, 0.02, rounds=3000)
    assert 2 <= np.count_nonzero(w) <= 8 and w[0] > 0 > w[1]
    loss = lambda b, v: rule_ensemble._loss(y, 1 / (1 + np.exp(-(b + z @ v)))) + 0.02 * np.abs(v).sum()
    least = loss(bias, w)
    for k in range(30):
        for d in (1e-3, -1e-3):
            v = w.copy()
            v[k] += d
            assert loss(bias, v) >= least - 1e-9


# Operator 3


def test_ledger_two_writers(spark, tmp_path):
    """Two writers that both find a blob missing: its paths are returned once each."""
    path = str(tmp_path / "ledger")
    paths = spark.createDataFrame([(1, "token: abcdefghijkl12"), (2, "token: abcdefghijkl12")], "doc_id long, text string")
    rows = secrets._new_rows(paths, None, secrets.RULES, secrets.VERSION)
    for _ in range(2):
        rows.write.mode("append").parquet(path)
    assert secrets.read_ledger(spark, path).count() == 1
    assert len(secrets.append_ledger(paths, path).collect()) == 2
