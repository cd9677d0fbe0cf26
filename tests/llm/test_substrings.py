"""The FM-index and substring dedup against brute force."""

import random
import re

import numpy as np
import pytest

from millrace.llm import substring_dedup
from millrace.llm.fm_index import FMIndex, WaveletMatrix

DOCS = "doc_id long, text string"


def test_wavelet_ranks():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 37, 500)
    w = WaveletMatrix(text, 6)
    symbol, low, high = rng.integers(0, 37, 200), rng.integers(0, 251, 200), rng.integers(251, 501, 200)
    a, b = w.rank(symbol, low, high)
    assert a.tolist() == [int((text[:x] == s).sum()) for s, x in zip(symbol, low)]
    assert b.tolist() == [int((text[:x] == s).sum()) for s, x in zip(symbol, high)]


def test_backward_search_counts():
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 4, 300), 0)
    with pytest.raises(ValueError):
        FMIndex(text[:-1], 8)
    index = FMIndex(text, 8)
    for _ in range(60):
        at = int(rng.integers(0, 292))
        pattern = text[at : at + 8]
        low, high = np.array([0]), np.array([len(text)])
        for s in pattern[::-1]:
            low, high = index.extend(np.array([s]), low, high)
        assert high[0] - low[0] == sum((text[i : i + 8] == pattern).all() for i in range(293))


def brute(texts, width):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = {}
    for d, w in enumerate(words):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in words]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d] |= set(range(i, i + width))
    return [(len(w), len(g), " ".join(x for k, x in enumerate(w) if k not in g)) for w, g in zip(words, gone)]


@pytest.mark.parametrize("hot", [1000, 3])
def test_against_brute_force(spark, hot):
    random.seed(hot)
    make = lambda n: " ".join(random.choice("abcdefghijkl") + str(random.randint(0, 40)) for _ in range(n))
    passages = [make(n) for n in (12, 20, 40)]
    texts = [None, "", "a b", "x " * 60, make(30)] + [" ".join([make(random.randint(0, 15)), random.choice(passages), make(random.randint(0, 15)), random.choice(passages)]) for _ in range(60)]
    texts += [texts[4], texts[10], "é " + texts[11], make(5000)]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    rows = substring_dedup.dedup_substrings(df, ["doc_id"], width=12, m=4, hot=hot).collect()
    want = brute(texts, 12)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in rows} == dict(enumerate(want))
    assert sum(w[1] for w in want) > 500


def test_edges(spark):
    text = " ".join(map(str, range(40)))
    df = spark.createDataFrame([(None, text), (1, text), (1, text)], DOCS)
    assert [r.n_removed for r in substring_dedup.dedup_substrings(df, ["doc_id"]).collect()] == [40, 40, 40]
    assert substring_dedup.dedup_substrings(df.limit(0), ["doc_id"]).count() == 0
