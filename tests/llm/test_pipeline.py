"""The pipeline, and each stage on what its predecessor kept, against a chain of brute force."""

import random

import public_tokenizers
from test_native import brute_content
from test_near import brute_groups, distance, edited, random_text, words
from test_tokens import brute_quality
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import line_dedup, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def fixture():
    random.seed(33)
    item = random_text(40)
    rows = {}

    def put(i, text, lang="en"):
        rows[i] = (i, text, lang, f"s{(i or 0) % 3}", None if text is None else len(text))

    for i in range(40):
        put(i, random_text(random.randint(60, 150)), random.choice(["en", "de", None]))
    put(100, rows[3][1])  # an exact copy
    put(101, edited(rows[5][1], 1) + " and more")  # near copies
    put(102, edited(rows[5][1], 1))
    line = random_text(60)
    for i in (110, 111, 112):  # one line in three documents, with others around
        put(i, "\n".join([random_text(70), line, random_text(80)]))
    put(120, random_text(30) + " " + item + " " + random_text(30))  # leaks, exact and edited
    put(121, random_text(30) + " " + edited(item, 3) + " " + random_text(30))
    put(130, "too short")
    put(131, None)
    put(132, "", "fr")
    put(133, "again and again " * 60)
    put(None, random_text(90))
    put(140, random_text(5000))
    return list(rows.values()), [(0, item), (1, None), (None, random_text(25))]


def kept_by_quality(rows):
    return [r for r in rows if not brute_quality(r[1])[5]]  # no label set here is large enough to certify a cutoff


def without_lines(rows):
    order = [((r[0] is not None, r[0] or 0), r[1]) for r in rows]
    found = brute_content(order, line_dedup.RUN, line_dedup.LEAST)
    return [(r[0], found[key][2], r[2], r[3], None if found[key][2] is None else len(found[key][2])) for r, (key, _) in zip(rows, order)]


def without_copies(rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    _, roots = brute_groups([r[1] for r in rows])
    return [r for i, r in enumerate(rows) if roots[i] == i]


def without_leaks(rows, items):
    def leaks(text):
        low = words((text or "").lower())
        for _, item in items:
            w = words((item or "").lower())
            if w and any(distance(w, low[a : a + len(w)]) <= int(0.2 * len(w) + 1e-9) for a in range(len(low) - len(w) + 1)):
                return True
        return False

    return [r for r in rows if not leaks(r[1]) or len(words(r[1])) > 1000]  # the long text holds none; comparing it takes minutes


def test_pipeline_against_brute_force(spark, tmp_path):
    rows, items = fixture()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    d, want = str(tmp_path), rows
    docs = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda r: tuple((x is not None, str(x)) for x in r)
    brute = [kept_by_quality, without_lines, without_copies, lambda r: without_leaks(r, items)]
    for (name, stage), expected in zip(corpus_pipeline.STAGES[:4], brute):
        before, want = len(want), expected(want)
        got = stage(spark, docs, d)
        assert got.columns == COLUMNS, name
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key), name
        assert len(want) < before or name == "line_dedup", name
        docs = spark.createDataFrame(want, schema)
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    last = [(r[0], r[2], r[3], t.encode(r[1] or "", add_special_tokens=False).ids) for r in want]
    got = [(r.doc_id, r.lang, r.source, r.ids) for r in corpus_pipeline.run(spark, d).collect()]
    assert sorted(got, key=key) == sorted(last, key=key)
    ids = {r[0]: r[3] for r in last}
    assert ids[100] == []  # the exact copy lost its one line; of the texts without words it is the first
    assert not {101, 120, 121} & set(ids) and len(ids[112]) < len(ids[110])
    assert {0, 3, 110, 111, 140, None} <= set(ids)


def test_repeats_certify_no_cutoff(spark):
    """A junk-like good text that many documents repeat is one trial: as many trials would wrongly bound the rejections of good texts."""
    good = [(i, " ".join(f"w{i}x{k}" for k in range(80)), "en") for i in range(60)]
    copies = [(1000 + i, good[0][1], "en") for i in range(3000)]
    junk = [(9000 + i, " ".join(f"#{i}$ {k}%" for k in range(80)), "en") for i in range(300)]
    docs = spark.createDataFrame(good + copies + junk, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in good + copies] + [(r[0], 0) for r in junk], "doc_id long, quality int")
    assert quality.fit(quality.counted(docs, "lang"), labels) == []
    both = spark.createDataFrame([(0, 1), (0, 0), (1, 1)], "doc_id long, quality int")
    assert quality.fit(quality.counted(docs, "lang"), both) == []


def test_cutoffs_against_brute_force(spark):
    """The cutoffs that fit() picks are those of a plain search over the labelled texts."""
    random.seed(9)

    def text(i, marks):
        return " ".join(f"w{i}x{k}" + "#" * (random.random() < marks) for k in range(100))

    rows = [(i, text(i, 0.02), "en", 1) for i in range(2500)] + [(5000 + i, text(i, random.choice([0.05, 0.5])), "en", 0) for i in range(400)]
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows], "doc_id long, quality int")
    found = {c.rule: c for c in quality.fit(quality.counted(docs, "lang"), labels)}
    share = lambda t: brute_quality(t)[2] / brute_quality(t)[1]
    shares = [(share(t), q) for _, t, _, q in rows]
    best = None
    for i in range(len(quality.GRID) - 1, -1, -1):
        good = sum(s > quality.GRID[i] and q == 1 for s, q in shares)
        bad = sum(s > quality.GRID[i] and q == 0 for s, q in shares)
        if quality.upper_bound(good, 2500, 0.05 / 4) > 0.02 / 4:
            break
        if bad - 5 * good > (best or (0,))[0]:
            best = (bad - 5 * good, quality.GRID[i], good, bad)
    c = found["symbol_share"]
    assert best and (c.cutoff, c.rejected_good, c.rejected_bad, c.n_good) == (best[1], best[2], best[3], 2500)
