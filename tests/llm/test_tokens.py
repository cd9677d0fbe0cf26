"""BPE and token counts against the tokenizers library; quality rules against brute force."""

import hashlib
import random
import re
from collections import Counter
from itertools import groupby

import public_tokenizers
from tokenizers import Tokenizer
from tokenizers.models import Unigram

from millrace.llm import bpe, quality, token_counts

DOCS = "doc_id long, text string, lang string, ids string"
POOL = [*"ab'sS<|>09éÉİKſΣς​  　\x1c\x85漢字🙂\t\n\r\x0b\x0c .▁", "<|startoftext|>", "<|endoftext|>", "'ll", "the", "ing", "<0x41>"]


def texts():
    random.seed(4)
    return [None, "", "Hello, World's end", "the " * 20000, "a" * 3000, "Hello, World's end"] + ["".join(random.choice(POOL) for _ in range(random.randint(0, 30))) for _ in range(300)]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_bpe_contract(spark):
    all_texts = texts()
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(all_texts)], DOCS)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = bpe.digests(df).collect()
    assert len(rows) == len(all_texts)
    for r in rows:
        ids = t.encode(all_texts[r.doc_id] or "", add_special_tokens=False).ids
        want = (len(ids), sha(" ".join(map(str, ids))), sha(t.decode(ids, skip_special_tokens=False)))
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == want, repr(all_texts[r.doc_id])


def test_bpe_decode_and_edges(spark):
    df = spark.createDataFrame([(None, None, None, None), (1, "ab cd", "en", "x"), (1, "ab cd", "en", "x")], DOCS)
    encoded = bpe.encode(df.drop("ids"), ["doc_id"])
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = t.decode(t.encode("ab cd", add_special_tokens=False).ids, skip_special_tokens=False)
    assert sorted(r.decoded for r in bpe.decode(encoded, ["doc_id"]).collect()) == ["", want, want]
    assert bpe.digests(df.limit(0)).count() == 0


def test_token_counts_against_library(spark):
    vocab = token_counts.vocabulary()
    model = Unigram(vocab, unk_id=0, byte_fallback=True)
    all_texts = texts()
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(all_texts)], DOCS)
    for r in token_counts.count_tokens(df, ["doc_id"]).collect():
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", all_texts[r.doc_id] or "") if w]
        known = Counter(words)
        assert r.n_words == len(words)
        assert r.n_tokens == sum(n * len(model.tokenize("▁" + w)) for w, n in known.items())


def test_viterbi_ties():
    vocab = [("<unk>", 0.0), ("▁", -1.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("▁a", -2.0), ("abb", -3.0)]
    model = Unigram(vocab, unk_id=0, byte_fallback=False)
    counter = token_counts.Counter(vocab)
    random.seed(1)
    for _ in range(300):
        w = "".join(random.choice("ab") for _ in range(random.randint(1, 9)))
        assert counter.count(w)[0] == len(model.tokenize("▁" + w)), w


def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(zip(words, words[1:], words[2:]))
    hit = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_quality_counts(spark, tmp_path):
    random.seed(3)
    all_texts = [None, "", "a b c a b c", "x\n\nx\n \nx", "é# ü$ |<>"] + ["".join(random.choice(["a ", "b ", "c\n", "#", "É ", "long ", "\t"]) for _ in range(random.randint(1, 200))) for _ in range(80)] + [" ".join(str(i) for i in range(9000))]
    rows = [(i, t, None if i % 7 == 0 else "en", "x") for i, t in enumerate(all_texts)] + [(None, None, None, None)] * 2
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, 0), (None, 1, 0), (2, None, 1), (2, 0, 1), (2, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = quality.op10_quality_rules(spark, str(tmp_path)).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_quality(all_texts[r.doc_id] if r.doc_id is not None else None)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == want
        assert r.kept == (not r.base_failed)  # far too few labels to certify a cutoff


def test_binomial_bound():
    assert abs(quality.upper_bound(0, 100, 0.05) - (1 - 0.05 ** (1 / 100))) < 1e-9
    assert abs(quality.upper_bound(5, 50, 0.025) - 0.2181) < 2e-4  # Clopper-Pearson, tabulated
    assert quality.upper_bound(3, 3, 0.05) == 1.0


def test_certified_cutoffs_hold():
    rows = [{"stratum": "en", "rule": "symbol_share", "step": s, "good": g, "bad": b} for s, g, b in ((-1, 3000, 10), (2, 2, 1), (9, 0, 300))]
    (c,) = quality.certified(rows, 0.02, 0.05, 5.0)
    assert (c.rejected_good, c.rejected_bad, c.cutoff) == (0, 300, quality.GRID[9]) and c.bound <= 0.005
    few = [dict(r, good=r["good"] // 100) for r in rows]
    assert quality.certified(few, 0.02, 0.05, 5.0) == []
    assert sum(len(list(g)) for _, g in groupby(quality.GRID)) == 50


def test_quality_stage_rejects_junk(spark):
    clean = [(i, " ".join(f"w{i}x{k}" for k in range(80)), "en", "x") for i in range(2500)]
    junk = [(5000 + i, " ".join(f"#{i}$ {k}%" for k in range(80)), "en", "x") for i in range(300)]
    docs = spark.createDataFrame(clean + junk, DOCS)
    labels = spark.createDataFrame([(i, 1) for i in range(2000)] + [(5000 + i, 0) for i in range(150)], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.quality_stage(docs, labels).select("doc_id").collect()}
    assert kept == set(range(2500))


def test_bpe_joined_forms_agree(spark):
    df = spark.createDataFrame([(i, t, "en", "x") for i, t in enumerate(texts()[:80])] + [(5, "the the", None, None)] * 2, DOCS).drop("ids")
    plain, joined = (f(df, ["doc_id", "lang"]) for f in (bpe.encode, bpe.encode_joined))
    key = lambda r: (str(r[0]), str(r[1]), str(r[2]))
    assert sorted(map(tuple, joined.collect()), key=key) == sorted(map(tuple, plain.collect()), key=key)
    a, b = (f(plain, ["doc_id"]).collect() for f in (bpe.decode, bpe.decode_joined))
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))
    assert bpe.encode_joined(df.limit(0), ["doc_id"]).count() == 0
