"""Near copies, benchmark leaks and scores against brute force and held-out likelihood."""

import random
import re

import numpy as np

from millrace.llm import decontamination, lm_scoring, near_join

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_groups(texts):
    """(links of each set, least document of each component) by comparing all pairs."""
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = {}
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or (a or b) and len(a & b) >= 0.8 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
                if a != b:
                    linked.setdefault(a, set()).add(b)
                    linked.setdefault(b, set()).add(a)
    return [len(linked.get(s, ())) for s in sets], [find(i) for i in range(len(texts))]


def edited(text, n):
    w = text.split()
    for _ in range(n):
        w[random.randrange(len(w))] = f"new{random.randrange(10**6)}"
    return " ".join(w)


def random_text(n):
    return " ".join(f"w{random.randrange(3000)}" for _ in range(n))


def test_near_join_against_brute_force(spark):
    random.seed(6)
    texts = [None, "", "a b", "a b", " a  b ", "x " * 300]
    for _ in range(25):
        base = random_text(random.randint(40, 400))
        texts += [base, base] + [edited(base, random.randint(0, max(1, len(base.split()) // 45))) for _ in range(4)]
    one = random_text(120)
    texts += [edited(one, 1) for _ in range(80)] + [random_text(100) for _ in range(60)]
    links, roots = brute_groups(texts)
    got = {r.doc_id: r for r in near_join.grouped(docs(spark, texts)).collect()}
    assert len(got) == len(texts)
    assert sum(links) > 1000
    for i in range(len(texts)):
        assert (got[i].n_links, got[i].class_id) == (links[i], roots[i]), texts[i][:80]


def test_near_join_crowded_paths(spark, monkeypatch):
    """Groups beyond the size that is compared at once are split or compared in parts: the links are the same."""
    random.seed(8)
    one = random_text(150)
    common = " ".join(f"c{i}" for i in range(12))
    texts = [edited(one, 1) for _ in range(60)] + [random_text(20) + " " + common + " " + random_text(20) for _ in range(120)]
    links, roots = brute_groups(texts)
    monkeypatch.setattr(near_join, "SMALL", 16)
    monkeypatch.setattr(near_join, "CROWD_SETS", 20)
    got = {r.doc_id: r for r in near_join.grouped(docs(spark, texts)).collect()}
    assert all((got[i].n_links, got[i].class_id) == (links[i], roots[i]) for i in range(len(texts)))


def test_near_copies_stage(spark):
    base = random_text(60)
    df = docs(spark, [base, base, base + " end", "other text", None, None, "other text"], [4, 4, 2, None, 7, 8, 9])
    out = near_join.near_copies_stage(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or 0, r.text) for r in out.collect()) == sorted([(2, base + " end"), (0, "other text"), (7, None)], key=lambda r: r[0])
    assert near_join.near_copies_stage(docs(spark, [])).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


def test_leaks_against_brute_force(spark):
    random.seed(12)
    items = [random_text(n) for n in (3, 5, 8, 20, 20, 35, 60)]
    texts = [None, "", "w1"]
    for item in items:
        w = item.split()
        for edits in range(0, max(1, len(w) // 4) + 1):
            for kind in range(3):
                x = list(w)
                for _ in range(edits):
                    at = random.randrange(len(x))
                    if kind == 0:
                        x[at] = "changed"
                    elif kind == 1:
                        x.insert(at, "put")
                    elif len(x) > 1:
                        del x[at]
                texts.append(" ".join([random_text(random.randint(0, 9)), *x, random_text(random.randint(0, 9))]).upper())
    benchmark = spark.createDataFrame([*enumerate(items), (90, None), (91, " "), (92, items[0])], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in decontamination.leaks(docs(spark, texts), benchmark).collect()}
    want = {}
    for i, text in enumerate(texts):
        low = words((text or "").lower())
        for k, item in enumerate(items):
            n = len(item.split())
            best = min(((distance(item.split(), low[a : a + n]), a) for a in range(len(low) - n + 1)), default=None)
            if best and best[0] <= int(0.2 * n + 1e-9):
                want[i, k] = best
    want |= {(i, 92): v for (i, k), v in want.items() if k == 0}
    assert found.keys() <= want.keys()
    assert len(found) >= 0.97 * len(want) and len(want) > 60
    assert all(found[p].distance >= want[p][0] for p in found)
    exact = {p for p, (d, _) in want.items() if d == 0}
    assert exact and all(p in found and (found[p].distance, found[p].start) == want[p] for p in exact)


def test_decontamination_stage(spark):
    item = random_text(30)
    df = docs(spark, [f"a {item} b", "clean text", None, f"a {item} b"], [1, 2, None, 1])
    out = decontamination.decontamination_stage(df, spark.createDataFrame([(None, item)], "item_id long, text string"))
    assert out.columns == df.columns
    assert {r.text for r in out.collect()} == {"clean text", None}
    assert decontamination.leaks(df, spark.createDataFrame([], "item_id long, text string")).count() == 0
    assert decontamination.leaks(df.limit(0), spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 0


def test_gradients():
    rng = np.random.default_rng(1)
    net = lm_scoring.new_net(rng.integers(0, 50, lm_scoring.SIDE**2))
    context, target = rng.integers(0, 1024, (40, 2 * lm_scoring.REACH)), rng.integers(0, 1024, 40)
    net = {k: v.astype(np.float64) for k, v in net.items()}
    grad = {k: np.zeros_like(v) for k, v in net.items()}
    lm_scoring.predict(net, context, target, grad)
    for name in net:
        at = np.unravel_index(np.abs(grad[name]).argmax(), grad[name].shape)
        for step in (1e-4, -1e-4):
            net[name][at] += step
            moved = lm_scoring.predict(net, context, target).mean() if step > 0 else moved
            net[name][at] -= step
        low = {k: v.copy() for k, v in net.items()}
        low[name][at] -= 1e-4
        slope = (moved - lm_scoring.predict(low, context, target).mean()) / 2e-4
        assert abs(slope - grad[name][at]) < 1e-5 + 0.01 * abs(slope)


def test_probabilities_sum_to_one():
    net = lm_scoring.new_net(np.arange(lm_scoring.SIDE**2))
    every = np.arange(lm_scoring.SIDE**2)
    context = np.tile([5, 9, 0, 700], (len(every), 1))
    assert abs(np.exp(lm_scoring.predict(net, context, every)).sum() - 1) < 1e-4


def test_scores_prefer_held_out_language(spark):
    """Trained on sentences of a small grammar, the network likes unseen sentences of it more than their words shuffled."""
    random.seed(15)
    grammar = [["the", "a"], ["big", "small", "old"], ["cat", "dog", "bird"], ["sees", "hears"], ["no", "every"], ["man", "tree", "house"], ["."]]

    def sentence():
        return " ".join(random.choice(c) for c in grammar)

    df = docs(spark, [" ".join(sentence() for _ in range(20)) for _ in range(400)])
    vocab, net = lm_scoring.fit(df.repartition(2), rounds=2)
    held = [sentence() + " " + sentence() for _ in range(60)]
    shuffled = [" ".join(random.sample(t.split(), len(t.split()))) for t in held]
    scores = {r.doc_id: r for r in lm_scoring.score(docs(spark, held + shuffled + [None, "", "unseen words only"]), vocab, net, ["doc_id"]).collect()}
    assert sum(scores[i].log_likelihood > scores[60 + i].log_likelihood for i in range(60)) >= 57
    assert [(scores[i].n_words, scores[i].log_likelihood, scores[i].mean_log_likelihood) for i in (120, 121)] == [(0, 0.0, None)] * 2
    assert scores[122].log_likelihood < 0
    vocab, net = lm_scoring.fit(df.limit(0))
    assert lm_scoring.score(df.limit(0), vocab, net, ["doc_id"]).count() == 0


def test_rare_words_score_as_themselves(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "K", 2)
    monkeypatch.setattr(lm_scoring, "OTHER", lm_scoring.SIDE**2 - 3)
    common = ["the", "of"] * 400
    prose = [f"w{i % 60}" for i in range(1200)]
    texts = [" ".join(common[i::20] + prose[i::20]) for i in range(20)]
    junk = " ".join(f"zq{i}x" for i in range(60))
    df = docs(spark, [*texts, junk])
    counts = lm_scoring.word_counts(df)
    vocab, net = lm_scoring.fit(df, counts=counts)
    scores = {r.doc_id: r for r in lm_scoring.score(docs(spark, [texts[0], junk, texts[0], "w1", "w1", "unheard", "unheardof", "w1 unheard"]), vocab, net, ["doc_id"], counts).collect()}
    assert scores[0].mean_log_likelihood > scores[1].mean_log_likelihood + 2
    assert scores[0].log_likelihood == scores[2].log_likelihood and scores[3].log_likelihood == scores[4].log_likelihood
    assert scores[5].log_likelihood < scores[3].log_likelihood - 30  # a word that was never seen is spelled
    assert scores[7].n_words == 2
    every = [r.h for r in counts.collect() if r.h not in set(vocab[:, 0].tolist())]
    words = [w for w in {w for t in [*texts, junk] for w in t.split()} if w not in ("the", "of")]
    logs = {r.k: r.rare_log for r in lm_scoring.rare_logs(spark.createDataFrame([(w, w) for w in words], "k string, text string"), vocab, counts, "k").collect()}
    sums = {}
    hashes = {r.w: r.h for r in spark.createDataFrame([(w,) for w in words], "w string").selectExpr("w", "xxhash64(w) AS h").collect()}
    for w, log in logs.items():
        b = int(np.uint64(hashes[w] % 2**64) % np.uint64(lm_scoring.OTHER))
        sums[b] = sums.get(b, 0) + np.exp(log)
    assert len(every) == len(words) == len(logs)
    assert all(0.4 < v < 1 for v in sums.values())  # the rest of each bucket is for words not seen
