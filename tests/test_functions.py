"""Code, prompts and operators that must fail loudly, on hand-made rows."""

import textwrap

import pytest
from pyspark.sql import functions as F

from millrace.functions import code, prompts, text
from millrace.operators import agreement, extractors, funnel, lookups, results, stats, trees
from millrace.sources import datasets


def column(spark, expression, **values):
    """The values of an expression over one column of each name."""
    n = len(next(iter(values.values())))
    rows = spark.createDataFrame([tuple(v[i] for v in values.values()) + (i,) for i in range(n)], ", ".join([f"{k} string" for k in values] + ["i int"]))
    return [r.x for r in rows.select("i", expression.alias("x")).orderBy("i").collect()]


METHODS = [
    ("void m() { }", 1),
    ("int m(int a) { if (a > 0) return 1; else if (a < 0 || b) return 2; return a == 0 ? 1 : 2; }", 5),
    ("void m() { for (int i = 0; i < n; i++) { while (x) { } } do { y(); } while (z && w); }", 5),
    ("void m() { try { a(); } catch (E e) { } catch (F f) { } finally { } }", 3),
    ("int m() { switch (x) { case 1: case 2: return 1; default: return 0; } }", 3),
    ("int m() { return switch (x) { case 1, 2 -> 1; case 3 -> { if (y) { yield 2; } yield 3; } default -> 0; }; }", 4),
    ("void m() { run(() -> { if (x) { y(); } }); list.forEach(v -> v.a() && v.b()); if (z) { } }", 2),
    ("Object m() { return new Object() { boolean f() { return a && b; } }; }", 1),
    ("void m() { class Inner { void g() { if (x) { } } } if (y) { } }", 2),
    ("<T extends List<?>> void m(Map<?, ? super T> t) { String s = \"if (a && b)\"; char c = '?'; /* if */ }", 1),
    ("void m() { new ArrayList<Map<String, List<?>>>(a ? b : c); }", 2),
    ("@A({1, 2}) void m() { if (a) { } }", 2),
    ("void m( { if (a) }", None),
    ("abstract void m();", None),
]


def test_complexity_of_labelled_methods(spark):
    assert column(spark, code.cyclomatic_complexity(F.col("c")), c=[m for m, _ in METHODS]) == [n for _, n in METHODS]


def test_bodies_and_signatures(spark):
    bodies = ["void m() { throw new E(() -> { a(); b(); }); }", "void m() { throw x; y(); }", "void m() { /* throw */ }", "void m() { // none\n }", "void m();", "void m() { a(); throw x; }", 'void m() { throw new E("a;b"); }']
    assert column(spark, code.is_only_throw(F.col("c")), c=bodies) == [True, False, False, False, False, False, True]
    assert column(spark, code.has_empty_body(F.col("c")), c=bodies) == [False, False, True, True, False, False, False]
    assert column(spark, code.same_code(F.col("a"), F.col("b")), a=["a+b // x", 'f("a  b")', "ab", '"//"'], b=["a + /* y */ b", 'f("a b")', "a b", '"//" // z']) == [True, False, False, True]
    lone = ["O m() {\n    return null;\n}", "O m() { return null; }", "O m() { return x; }", "O m() { a(); return null; }"]
    assert column(spark, code.strip_lone_return_null(F.col("c")), c=lone) == ["O m() {\n}", "O m() {  }", None, None]


def test_text_forms(spark):
    texts = ["  a\n    b\n\n  c", "a\n  b", "\n\t\tx\n\t\t y\n \n", "", "   ", "\ta\n  b"]
    assert column(spark, text.dedent(F.col("c")), c=texts) == [textwrap.dedent(t) for t in texts]
    assert column(spark, text.indent(F.col("c"), "> "), c=texts) == [textwrap.indent(t, "> ") for t in texts]
    words = ["a b", " a\x1cb　c ", "", "x\ty\nz"]
    assert column(spark, text.token_count(F.col("c")), c=words) == [len(w.split()) for w in words]
    assert column(spark, text.parameter_types(F.col("c")), c=["(ILp/T;[Lq/U;Ljava/lang/X;)Lr/V;"]) == [["p/T", "q/U", "r/V"]]
    assert column(spark, text.generic_parts(F.col("c")), c=["A<B<C>>", "D"]) == [["A", "B<C>"], ["D"]]


def test_what_must_fail(spark):
    ids = spark.createDataFrame([(1,), (2,)], "id long")
    strange = spark.createDataFrame([(1,), (9,)], "id long")
    with pytest.raises(Exception, match="outside the universe"):
        agreement.checked_overlap(ids, strange, ids).collect()
    scanned = spark.createDataFrame([("k", "E", "p", "c"), ("k", "E", "q", "d")], "test_key string, exception string, pattern string, code string")
    with pytest.raises(Exception, match="scanned twice"):
        lookups.refreshed(scanned.limit(1), scanned).collect()
    rows = spark.createDataFrame([(1, []), (2, ["x"])], "id long, stack_traces array<string>")
    with pytest.raises(Exception, match="no stack trace"):
        funnel.allowed(rows, ids).collect()
    scalar = spark.createDataFrame([("m", None)], "metric string, values array<double>")
    with pytest.raises(Exception, match="only lists"):
        stats.merged(scalar, scalar).collect()
    nodes = spark.createDataFrame([("t", 0, None, 0, "Root", None, None, None), ("t", 1, 0, 0, "S", "a", 3, 4), ("t", 2, 0, 1, "S", "b", 4, 4)], "tree string, node long, parent long, place long, type string, tok string, start long, end long")
    with pytest.raises(Exception, match="several statements"):
        trees.statements(nodes, ["S"]).collect()
    assert trees.statements(nodes.filter("node < 2"), ["S"]).count() == 1
    with pytest.raises(ValueError, match="no extractor"):
        extractors.extracted(nodes, ["unknown"])
    for bad in (lambda: prompts.title(F.lit("x"), -1), lambda: prompts.section(F.lit("x"), 0, F.lit("")), lambda: prompts.one_field_messages("s", "none"), lambda: text.fill_template("~`a`~", {})):
        with pytest.raises(ValueError):
            bad()
    two, one = (spark.createDataFrame([(1, [1] * n)], "id long, result array<int>") for n in (2, 1))
    with pytest.raises(Exception, match="different lengths"):
        results.combine(two, one, lambda a, b: a).collect()


def test_data_sets_on_disk(spark, tmp_path):
    data = datasets.Dataset(spark, str(tmp_path / "d"))
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id long, x string")
    with pytest.warns(UserWarning, match="no rows"):
        assert not data.save(rows.limit(0))
    with pytest.raises(FileNotFoundError):
        data.load()
    assert data.save(rows)
    with pytest.raises(Exception, match="already exists"):
        data.save(rows)
    data.save(spark.createDataFrame([(3, "c")], rows.schema), append=True)
    data.save_columns(spark.createDataFrame([(1, "A"), (3, "C")], rows.schema), ["x"])
    assert sorted((r.id, r.x) for r in data.load().collect()) == [(1, "A"), (2, None), (3, "C")]
    assert [r.x for r in data.get(3).collect()] == ["C"] and data.ids().count() == 3
    data.save(rows, exist_ok=True)
    assert data.ids().count() == 2
    (tmp_path / "r.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "r.jsonl").write_text('{"a": 1}\n{"a": 2}\n')
    assert [sum(r.a for r in datasets.read_records(spark, str(tmp_path / f"r.{f}"), f).collect()) for f in ("json", "jsonl")] == [3, 3]
    assert datasets.read_records(spark, str(tmp_path / "r.jsonl"), "txt").count() == 2
    with pytest.raises(ValueError):
        datasets.read_records(spark, "x", "pkl")


def test_raters_and_bins_without_rows(spark):
    scored = spark.createDataFrame([("a", 1, True, True, True), ("b", 1, True, True, True)], "rater string, id long, match boolean, labelled boolean, judged boolean")
    (r,) = agreement.agreement(scored).collect()
    assert (r.total, r.agree, r.kappa) == (1, 1, None)
    assert agreement.kappa_range(agreement.agreement(scored)).collect()[0].n == 0
    empty = agreement.summary(spark.createDataFrame([], "match boolean, categories array<string>, pos long"), "pos").collect()
    assert {r.name: (r.n, r.pct) for r in empty} == {n: (0, None) for n in ("total", "yes", "no", "unknown")}


def test_comments_keep_the_block_without_any(spark):
    none = F.array().cast("array<struct<line:int,text:string>>")
    assert column(spark, prompts.commented(F.col("c"), none, "D"), c=["```java\nx\n```"]) == ["```java\nx\n```"]
    assert column(spark, prompts.shifted(F.col("c"), -1), c=["## a\ntext # b\n### c"]) == ["# a\ntext # b\n## c"]


def test_tokens_are_found_once(spark):
    """Each function names its token expression once; throws whose brackets or last token differ are told apart."""
    df = spark.createDataFrame([("void m() { throw e; }",)], "c string")
    for found in (code.is_only_throw, code.has_empty_body, code.strip_lone_return_null, code.test_pattern):
        assert df.select(found(F.col("c")).alias("x"))._jdf.queryExecution().analyzed().toString().count("regexp_extract_all(c") == 1, found.__name__
    bodies = ["void m() { throw x }", "void m() { throw x; ; }", "void m() { throw f(); ) }", "void m() { throw (x; }", "void m() { throw f(() -> { a(); }); }", "}", "", None]
    assert column(spark, code.is_only_throw(F.col("c")), c=bodies) == [False, False, False, False, True, False, False, False]
    assert column(spark, code.has_empty_body(F.col("c")), c=["}", "", None, "{}"]) == [False, False, False, True]
