"""Text functions, prompts, code and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import code, prompts, text
from millrace.operators import graph, lookups, results
from millrace.session import table


def _s(c: str | Column) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _joined(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def key_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of inner classes."""
    key = _joined("p/q.C", _s("p_size"), "$I", _s(F.col("p_partkey") % 3), "#m", _s("p_partkey"), "#(Lp/T;)V")
    row = table(spark, sf_dir, "part").select("p_partkey", key.alias("k"), _joined("/a/b", _s("p_size"), "/c", _s("p_partkey"), ".jsonl/").alias("path"))
    k = F.col("k")
    return row.select("p_partkey", text.class_of(k).alias("class"), text.method_of(k).alias("method"), text.outer_class_of(k).alias("outer"), text.dotted(k).alias("dotted"), text.slashed(k).alias("slashed"), text.slug(F.rtrim(F.replace("path", F.lit(".jsonl/"), F.lit(".jsonl")))).alias("slug"))


def thinking_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of assistants think first; users have no end token."""
    token = F.when(F.col("role") == "assistant", F.lit("</think>")).when(F.col("role") == "system", F.lit("<end>"))
    reply = F.concat(F.lit("hm "), F.when(F.col("turn") % 2 == 1, F.lit("</think>  ")).otherwise(F.lit("")), F.col("text"), F.lit(" </think> x"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.strip_thinking(reply, token)).alias("digest"))


def covered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' lines as logs of line numbers."""
    log = F.concat_ws(" ", F.collect_list(F.concat(F.lit("x LineNum:["), _s(F.col("l_partkey") % 40), F.lit("]"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(log.alias("log"))
    return rows.select("l_orderkey", F.array_join(text.covered_lines(F.col("log"), (F.col("l_orderkey") % 10).cast("int"), F.lit(20)).cast("array<string>"), ",").alias("lines"))


def unreported_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = F.concat_ws("\n", F.collect_list(F.concat(F.lit("A.java:["), _s(F.col("l_partkey") % 30), F.lit(",7] unreported exception p.E"), _s("l_linenumber"), F.lit("; must be caught"))))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(out.alias("out"))
    found = text.reported_exceptions(F.col("out"), F.lit(5))
    return rows.select("l_orderkey", F.array_join(F.transform(found, lambda x: F.concat(_s(x["line"]), x["exc"])), ",").alias("found"))


def thrown_exceptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs with a foreign frame and, but for every fifth, one of the class: of the method itself or of another that its code names."""
    p = F.col("p_partkey")
    own = F.when(p % 5 == 0, F.lit("")).otherwise(_joined("ExceptionST:[C;", F.when(p % 2 == 0, "m").otherwise("help"), ";", _s(p % 20), "]\n"))
    log = F.concat(F.when(p % 7 == 0, F.lit("")).otherwise(F.lit("ExceptionType:[p.E]\n")), F.lit("ExceptionST:[D;m;4]\n"), own, F.lit("ExceptionST:[C;m;19]\n"))
    at = text.thrown_at(F.col("log"), F.lit("C#m#()V"), F.lit("void m() {\n  a();\n  help();\n}\n"), F.lit(3))
    return table(spark, sf_dir, "part").select("p_partkey", log.alias("log")).select("p_partkey", at["line"].alias("line"), at["exception"].alias("exception"))


def type_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of three parameters, by the part's size and number."""
    p, s = F.col("p_partkey"), F.col("p_size")
    a, b = F.when(p % 2 == 0, "I").otherwise("[[J"), F.when(p % 3 == 0, "Ljava/lang/String;").otherwise(_joined("[Lp/q/T", _s(s), ";"))
    desc = F.concat(F.lit("("), a, b, F.lit("Lr/U;)V"))
    inside = F.concat(a, b, F.lit("Lr/U;"))
    types = text.split_types(inside)
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        F.array_join(text.parameter_types(desc), ",").alias("parameters"),
        F.array_join(types, " ").alias("types"),
        F.array_join(F.transform(types, text.simple_type_name), " ").alias("names"),
        text.class_descriptor(F.concat(F.when(p % 2 == 0, "int").otherwise(_joined("p.T", _s(s))), F.repeat(F.lit("[]"), (p % 3).cast("int")))).alias("descriptor"),
    )


def generic_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("List<"), "p_brand", F.lit("<X>>"))).otherwise(F.col("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.generic_parts(name), "|").alias("parts"))


def class_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source files, of which some have no package or no public class, and their imports."""
    p = F.col("p_partkey")
    source = F.concat(F.when(p % 3 == 0, F.lit("")).otherwise(F.lit("// x\npackage p.q;\n")), F.lit("import a.B;\nimport static c.D.*;\n"), F.when(p % 2 == 0, _joined("public class T", _s("p_size"), " {}")).otherwise(F.lit("class Hidden {}")))
    return table(spark, sf_dir, "part").select("p_partkey", text.qualified_class(source, F.lit("Other")).alias("fqcn"), F.array_join(text.imports(source), ",").alias("imports"))


def subtoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.subtokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("digest"))


def comment_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments that name a test go, others and addresses stay."""
    p = F.col("p_partkey")
    line = F.concat("p_name", F.when(p % 2 == 0, F.lit(" //  EBT #1")).otherwise(F.lit(" // note http://x")), F.lit("\nnext; // EBT #22 end"))
    return table(spark, sf_dir, "part").select("p_partkey", text.remove_comment(line, r"EBT #\d+").alias("code"))


def splice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = (F.col("doc_id") % 4 + 1).cast("int")
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.splice_lines(F.concat("text", F.lit("\na\nb\nc\nd\ne")), n, n + 1, F.col("source"))).alias("digest"))


def indented_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text set in, and set back again, is the text where its lines share no margin."""
    t = F.concat(F.lit("x\n"), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", t.alias("t"))
    set_in = text.indent(F.col("t"), "  ")
    return rows.select("doc_id", F.md5(F.regexp_replace(set_in, r"(?m)^[ \t]+$", "")).alias("digest"))


def test_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of one test each, and what their tests are marked to expect."""
    p = F.col("p_partkey")
    frame = F.lit("class adhoc_T { /*TEST PLACEHOLDER*/ adhoc_T x; }")
    body = F.when(p % 2 == 0, F.lit("@Test(expected = Old.class) void t() {}")).otherwise(F.lit("@Test void t() {} @Test void u() {}"))
    method = F.concat(F.lit("t"), _s("p_size"))
    marked = text.expect_exception(body, F.when(p % 3 == 0, F.lit("p.Outer$Inner")).otherwise(F.concat(F.lit("q.E"), _s("p_size"))))
    return table(spark, sf_dir, "part").select("p_partkey", text.test_class(F.lit("p.q.T"), method).alias("name"), text.test_file(frame, F.lit("p.q.T"), method, marked).alias("file"))


def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.number_text(F.col("o_custkey") * 1000, True).alias("whole"), text.number_text(F.floor(F.col("o_totalprice")) / 4, False).alias("decimal"))


def throw_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    body = F.concat(F.lit("void m() {\n"), F.when(p % 2 == 0, F.lit("  throw new Other();\n")).otherwise(F.lit("  x();\n")), F.lit("  throw "), F.when(p % 3 == 0, F.lit("new E1()")).otherwise(F.lit("rethrow(e)")), F.lit(";\n}"))
    exception = F.when(p % 5 == 0, F.lit("java.lang.RuntimeException")).otherwise(F.lit("p.E1"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.throw_lines(body, exception, F.lit(1)).cast("array<string>"), ",").alias("lines"))


def tool_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines, some without a frame, some with too few fields."""
    p = F.col("p_partkey")
    line = F.concat(F.lit("p.T"), _s("p_size"), F.when(p % 4 == 0, F.lit("#t")).otherwise(F.lit("#t#p.E")), F.when(p % 3 == 0, F.lit("")).otherwise(F.lit("## q.C#m#7 ##q.D#n#8")))
    e = text.log_entry(line)
    return table(spark, sf_dir, "part").select("p_partkey", *[e[c].alias(c) for c in ("etest_method", "exception", "mut_key", "stack_trace")])


def code_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands for a reply without code, by variant."""
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("```\n"), F.col("role"), F.lit("```"))).otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_code(reply).alias("comment"), text.extract_code(reply, "").alias("empty"), text.extract_code(reply, None).alias("nothing"))


_ARRAY = lambda *x: F.array(*[F.lit(i) if isinstance(i, str) else i for i in x])


def markdown_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of each region as a nested list under headings."""
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_name")).alias("names"))
    listed = prompts.nested_bullets(F.array(F.struct(F.lit("Nations").alias("name"), F.transform("names", prompts.inline_code).alias("items")), F.struct(F.lit("Empty").alias("name"), F.array().cast("array<string>").alias("items"))))
    below = prompts.section(F.lit("All"), 2, listed)
    page = prompts.section(F.concat(F.lit("Region "), _s("n_regionkey")), 1, prompts.code_block(F.lit("x"), "java"), F.array(below, prompts.section(F.lit("More"), 2, F.lit(""))))
    return rows.select("n_regionkey", page.alias("page"), prompts.shifted(page, 1).alias("demoted"))


def base_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods with two tests: the filled chat."""
    p = F.col("p_partkey")
    tests = F.array(F.struct(F.concat(F.lit("E"), _s(p % 3)).alias("exception"), F.lit("t();").alias("raw_code")), F.struct(F.lit("E1").alias("exception"), F.col("p_name").alias("raw_code")))
    args = prompts.base_arguments(_joined("C", _s("p_size"), "#m#()V"), F.lit("\n    void m() {\n      x();\n    }\n"), tests)
    chat = prompts.messages("Be brief.", "~`class_name`~.~`mut_name`~\n~`mut_no_throw`~\n~`exceptions`~\n~`etests`~", args)
    return table(spark, sf_dir, "part").select("p_partkey", F.get(chat, F.lit(0))["content"].alias("system"), F.get(chat, F.lit(1))["content"].alias("user"))


def one_field_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    chat = prompts.one_field_messages("sys", "Name: ~`p_name`~!")
    return table(spark, sf_dir, "part").select("p_partkey", F.get(chat, F.lit(1))["content"].alias("user"))


def add_on_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Add-ons that append, and an editor that marks covered lines of the method; and how many had something to say."""
    p = F.col("p_partkey")
    none = F.array().cast("array<string>")
    key = F.lit("p.C#m")
    appended = {
        "class-info": lambda a: prompts.class_info("Class {}:\n", key, F.when(p % 2 == 0, _ARRAY("int a = 1", "b=c=d")).otherwise(none), F.when(p % 3 == 0, _ARRAY("f()")).otherwise(none)),
        "import-info": lambda a: prompts.import_info("Imports:", _ARRAY("x.Y")),
        "nebt": lambda a: prompts.normal_tests("Tests:\n", F.when(p % 5 == 0, _ARRAY("n();")).otherwise(none)),
    }
    covered = F.when(p % 4 == 0, F.array(F.array(F.lit(0)), F.array(F.lit(1), F.lit(0)))).otherwise(F.array().cast("array<array<int>>"))
    editors = {"coverage": lambda a: prompts.commented(a["mut_no_throw"], prompts.coverage_comments(covered), "(covered)")}
    template = "~`class-info`~~`import-info`~~`nebt`~~`editor@mut_no_throw:coverage`~"
    args, share = prompts.with_add_ons(template, {"mut_no_throw": F.lit("```java\na;\nb;\n```")}, appended, editors)
    return table(spark, sf_dir, "part").select("p_partkey", text.fill_template(template, args).alias("user"), F.round(share, 6).alias("share"))


def exception_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments of two editors on a method of three lines: exceptions to be caught and exceptions seen."""
    p = F.col("p_partkey")
    imports = F.when(p % 2 == 0, _ARRAY("q.E1")).otherwise(F.array().cast("array<string>"))
    unreported = F.array(F.struct((p % 3).alias("line"), F.lit("q.E1").alias("exception")), F.struct(F.lit(0).cast("long").alias("line"), F.lit("q.E2").alias("exception")))
    seen = F.array(F.when(p % 5 == 0, F.struct((p % 9).alias("line"), F.lit("q.E1").alias("exception"))))
    block = F.lit("```java\na;\nb;\nc;\n```")
    one = prompts.commented(block, prompts.unreported_comments(unreported, imports), "U")
    return table(spark, sf_dir, "part").select("p_partkey", one.alias("unreported"), prompts.commented(block, prompts.thrown_comments(seen, imports, F.lit(3)), "T").alias("thrown"))


def throw_and_type_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    made = F.when(p % 2 == 0, F.map_from_arrays(_ARRAY("z.E", "a.E", "b.E"), F.array(_ARRAY("E()", "E(int)"), _ARRAY("E()"), F.array().cast("array<string>")))).otherwise(F.create_map().cast("map<string,array<string>>"))
    types = F.filter(F.array(F.struct(F.lit("T").alias("name"), _ARRAY("f()", "g()").alias("methods")), F.struct(F.lit("U").alias("name"), F.array().cast("array<string>").alias("methods"))), lambda t: (p % 3 == 0) | (t["name"] == "U"))
    return table(spark, sf_dir, "part").select("p_partkey", prompts.throw_info("Throws:\n", made).alias("throws"), prompts.types_info("Types:\n", types, "\n").alias("types"))


def repair_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    test = lambda ok: F.struct(ok.alias("passed"), F.lit("boom").alias("stdout"))
    normal = F.when(p % 7 == 0, F.lit(None)).otherwise(F.array(test(p % 4 == 0), test(F.lit(False))))
    out = prompts.repair_errors(p % 5 != 0, F.lit("log"), F.array(test(p % 2 == 0), test(p % 3 == 0)), normal, _ARRAY("n();"))
    return table(spark, sf_dir, "part").select("p_partkey", out.alias("errors"))


def _method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods written in one of four ways."""
    p = F.col("p_partkey")
    bodies = [
        "int m(int a) { if (a > 0 && b) { return 1; } return 2; }",
        "int m(int a) {\n  // if (x)\n  if (a>0&&b) { return 1; }\n  return 2; /* && */\n}",
        "void m() { throw new E(\"a; b\"); }",
        "Object m() {\n  return null;\n}",
    ]
    return table(spark, sf_dir, "part").select("p_partkey", F.get(F.array(*map(F.lit, bodies)), (p % 4).cast("int")).alias("code"))


def token_signature_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method(spark, sf_dir).groupBy(code.token_signature(F.col("code")).alias("signature")).agg(F.count("*").alias("n"))


def method_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("code")
    stripped = code.strip_lone_return_null(c)
    return _method(spark, sf_dir).select("p_partkey", code.is_only_throw(c).alias("only_throw"), code.has_empty_body(c).alias("empty"), code.has_empty_body(stripped).alias("empty_after"), stripped.alias("stripped"))


def complexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method(spark, sf_dir).groupBy(code.cyclomatic_complexity(F.col("code")).alias("complexity")).agg(F.count("*").alias("n"))


def test_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tests in five ways; some of those with a try have two catches."""
    p, size = F.col("p_partkey"), F.concat(F.lit("q.E"), _s("p_size"))
    ways = F.array(
        F.concat(F.lit("@Test(timeout = 1, expected = "), size, F.lit(".class) void t() { assertThrows(); }")),
        F.concat(F.lit("@Test void t() { assertThrows(A.class, () -> f()); assertThrows("), size, F.lit(".class, () -> g()); }")),
        F.concat(F.lit("@Test void t() { rule.expect("), size, F.lit(".class); f(); }")),
        F.concat(F.lit('@Test void t() { try { f(); fail("x"); } catch (final '), size, F.lit(" e) { }"), F.when(p % 2 == 0, F.lit(" catch (B b) { }")).otherwise(F.lit("")), F.lit(" }")),
        F.lit("@Test void t() { f(); }"),
    )
    found = code.test_pattern(F.get(ways, (p % 5).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", found["pattern"].alias("pattern"), found["exception"].alias("exception"))


def tried_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of six types and one without a body."""
    p = F.col("p_partkey")
    kinds = F.array(*map(F.lit, ["public void", "static int", "boolean", "Map<String, int[]>", "private final double", "char"]))
    method = F.when(p % 7 == 6, F.lit("abstract int m();")).otherwise(F.concat(F.get(kinds, (p % 7).cast("int")), F.lit(" m(int a) throws E { if (a) { f("), _s("p_size"), F.lit("); } }")))
    return table(spark, sf_dir, "part").select("p_partkey", code.with_try_catch(method).alias("code"))


def _graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as methods that call the ones of half and a third of their number and override the one before."""
    s = F.col("s_suppkey")
    each = F.array(F.struct(F.floor(s / 2).alias("dst"), F.lit("C").alias("label")), F.struct(F.floor(s / 3).alias("dst"), F.lit("C").alias("label")), F.struct((s - 1).alias("dst"), F.lit("O").alias("label")))
    return table(spark, sf_dir, "supplier").select(s.alias("src"), F.inline(each)).filter("dst > 0")


def edge_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from suppliers of nation 3, to them, and from what overrides them."""
    nodes = table(spark, sf_dir, "supplier").filter("s_nationkey = 3").select(F.col("s_suppkey").alias("id"))
    e = _graph(spark, sf_dir)
    each = {"from": graph.edges_from(e, nodes).withColumnRenamed("dst", "other"), "to": graph.edges_to(e, nodes).withColumnRenamed("src", "other"), "over": graph.edges_to(e, nodes, "O").withColumnRenamed("src", "other")}
    out = [d.select(F.lit(k).alias("kind"), "id", "other", "label") for k, d in each.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def throwing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From suppliers down to those that throw: every fourth throws E0, every sixth E1; all declare E0, odd ones E1."""
    s = F.col("s_suppkey")
    e0, e1 = F.when(F.lit(True), "E0"), F.when(s % 2 == 1, "E1")
    known = lambda *x: F.filter(F.array(*x), lambda v: v.isNotNull())
    methods = table(spark, sf_dir, "supplier").select(s.alias("id"), known(e0, e1).alias("declared"), known(F.when(s % 4 == 0, "E0"), F.when(s % 6 == 1, "E1")).alias("thrown"))
    calls = _graph(spark, sf_dir).filter("label = 'C'")
    return graph.throwing_paths(calls, methods, methods).select("start", "exception", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def built_call_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as classes below the one of half their number; their methods' signatures go by nation."""
    s = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier")
    parents = base.select(s.alias("node"), F.when(s > 0, F.floor(s / 2)).alias("parent")).filter("parent IS NOT NULL")
    methods = base.select((s * 10).alias("id"), s.alias("class"), (F.col("s_nationkey") % 4).alias("signature"), (s % 5 == 0).alias("private"), (s % 7 == 0).alias("static"))
    calls = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 10).alias("src"), F.col("l_suppkey").alias("owner"), (F.col("l_linenumber") % 5).alias("signature"))
    return graph.call_graph(calls, methods, parents)


def dependency_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    line = F.when(p % 3 == 0, F.lit("digraph {")).otherwise(F.concat(F.lit('  "p.C'), _s("p_size"), F.when(p % 5 == 0, F.lit(".jar")).otherwise(F.lit("")), F.lit(' (x)" -> "y";')))
    return graph.dependencies(table(spark, sf_dir, "part").select(line.alias("value")))


def own_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as methods, each with a tree of a throw, a new object and its type, odd ones without the throw."""
    s = F.col("s_suppkey")
    node = lambda n, of, kind, code: F.struct(F.lit(n).alias("node"), F.lit(of).alias("parent"), kind.alias("type"), code.alias("code"))
    kinds = F.array(node(1, 0, F.when(s % 2 == 0, "ThrowStmt").otherwise("ExpressionStmt"), F.lit("")), node(2, 1, F.lit("ObjectCreationExpr"), F.lit("")), node(3, 2, F.lit("ClassOrInterfaceType"), F.concat(F.lit("E"), _s(s % 3))))
    nodes = table(spark, sf_dir, "supplier").select(s.alias("method"), F.inline(kinds))
    wanted = table(spark, sf_dir, "supplier").select(s.alias("method"), F.concat(F.lit("p.E"), _s(F.col("s_nationkey") % 3)).alias("exception"))
    return graph.throws_itself(nodes, wanted)


def _trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' types as keys of words, each with its least part."""
    return table(spark, sf_dir, "part").groupBy(F.split("p_type", " ").alias("key")).agg(F.min("p_partkey").alias("value"))


def _sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, value, odd): the kinds of an order's lines, in order, as keys, each with its least order, apart for odd and even ones."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.min("l_partkey") % 12).cast("string").alias("kind"))
    keys = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "kind")))["kind"].alias("key"))
    return keys.groupBy("key", (F.col("l_orderkey") % 2 == 1).alias("odd")).agg(F.min("l_orderkey").alias("value"))


def trie_all_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each supplier, the orders' sequences made of no other kinds than its own four."""
    k = F.col("s_suppkey")
    sets = table(spark, sf_dir, "supplier").select(k.alias("id"), F.transform(F.array(k, k + 1, F.floor(k / 5), 7 * k), lambda x: (x % 12).cast("string")).alias("elements"))
    entries = _sequences(spark, sf_dir).groupBy("key").agg(F.min("value").alias("value"))
    return graph.all_in(entries, sets).select("id", F.array_join("key", " ").alias("key"), "value")


def trie_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The beginnings that odd orders' sequences have in common with even ones', where one of the latter ends there."""
    both = _sequences(spark, sf_dir)
    return graph.overlaps(both.filter("odd"), both.filter("NOT odd"), right_has_value=True).select(F.array_join("prefix", " ").alias("prefix"), "left_value", "right_value")


def trie_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "part").filter("p_size = 1").select(F.slice(F.split("p_type", " "), 1, 1).alias("prefix"))
    return graph.with_prefix(_trie(spark, sf_dir), wanted).select(F.array_join("prefix", " ").alias("prefix"), F.array_join("key", " ").alias("key"), "value")


def trie_prefixes_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat(F.split("p_type", " "), F.array(F.lit("more"))).alias("sequence"))
    return graph.prefixes_of(_trie(spark, sf_dir), words).select("id", F.array_join("key", " ").alias("key"), "value")


def repair_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a sample of each of two runs, matched by place: what a round of repair is given."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.filter(c).groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))).alias("result")) for c in ("l_returnflag = 'A'", "l_returnflag = 'N'"))
    both = results.combine(a, b, lambda x, y: F.coalesce(y, x), strict=False)
    each = both.join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id").select("id", "o_orderstatus", F.posexplode("result").alias("sample", "r"))
    return each.select("id", F.col("sample").cast("long").alias("sample"), "o_orderstatus", F.col("r.l_quantity").alias("quantity"))


def drawn_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines are drawn for each supplier: five, or all that there are."""
    return lookups.sampled(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_orderkey", 5).groupBy("l_suppkey").agg(F.count("*").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (
        key_parts, thinking_stripped, covered_lines, unreported_exceptions, thrown_exceptions, type_names, generic_parts, class_names, subtoken_counts,
        comment_removal, splice_lines, indented_text, test_files, number_texts, throw_lines, tool_log, code_variants, markdown_parts, base_prompt,
        one_field_prompt, add_on_prompt, exception_comments, throw_and_type_info, repair_errors, token_signature_groups, method_bodies, complexity, test_patterns, tried_methods,
        edge_lookups, throwing_paths, built_call_graph, dependency_names, own_throws, trie_all_in, trie_overlaps, trie_prefix, trie_prefixes_of, repair_tasks, drawn_tests,
    )
}

_N = "chr(10)"
_GRAPH = "e AS (SELECT s_suppkey src, s_suppkey // 2 AS dst, 'C' AS label FROM supplier WHERE s_suppkey >= 2 UNION ALL SELECT s_suppkey, s_suppkey // 3, 'C' FROM supplier WHERE s_suppkey >= 3 UNION ALL SELECT s_suppkey, s_suppkey - 1, 'O' FROM supplier WHERE s_suppkey >= 2)"
_FENCE = "'```java' || chr(10) || {} || chr(10) || '```'"
_SEQUENCES = "l AS (SELECT l_orderkey, l_linenumber, (min(l_partkey) % 12)::VARCHAR AS kind FROM lineitem GROUP BY 1, 2), k AS (SELECT l_orderkey, list(kind ORDER BY l_linenumber) AS key FROM l GROUP BY 1), q AS (SELECT key, l_orderkey % 2 = 1 AS odd, min(l_orderkey) AS value FROM k GROUP BY 1, 2)"
ORACLES = {
    "key_parts": "SELECT p_partkey, 'p/q.C' || p_size || '$I' || (p_partkey % 3) AS class, 'm' || p_partkey AS method, 'p/q.C' || p_size AS outer, 'p.q.C' || p_size || '$I' || (p_partkey % 3) || '#m' || p_partkey || '#(Lp.T;)V' AS dotted, 'p/q/C' || p_size || '$I' || (p_partkey % 3) || '#m' || p_partkey || '#(Lp/T;)V' AS slashed, 'a__b' || p_size || '__c' || p_partkey AS slug FROM part",
    "thinking_stripped": "WITH r AS (SELECT *, 'hm ' || CASE WHEN turn % 2 = 1 THEN '</think>  ' ELSE '' END || text || ' </think> x' AS reply FROM conversations) SELECT conv_id, turn, md5(CASE WHEN role = 'assistant' THEN trim(substr(reply, position('</think>' IN reply) + 8)) ELSE reply END) AS digest FROM r",
    "covered_lines": "WITH l AS (SELECT DISTINCT l_orderkey, l_partkey % 40 - l_orderkey % 10 - 3 AS n FROM lineitem) SELECT l_orderkey, coalesce(string_agg(n::VARCHAR, ',' ORDER BY n) FILTER (n BETWEEN 0 AND 19), '') AS lines FROM l GROUP BY 1",
    "unreported_exceptions": "SELECT l_orderkey, string_agg(n || 'p.E' || l, ',' ORDER BY n, l) AS found FROM (SELECT DISTINCT l_orderkey, l_partkey % 30 - 7 AS n, l_linenumber AS l FROM lineitem) GROUP BY 1",
    "thrown_exceptions": "WITH a AS (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN 13 WHEN p_partkey % 2 = 0 THEN p_partkey % 20 - 6 ELSE 2 END AS n FROM part) SELECT p_partkey, CASE WHEN n > 0 THEN n END::INT AS line, CASE WHEN n > 0 THEN 'p.E' END AS exception FROM a",
    "type_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'p/q/T' || p_size || ',' END || 'r/U' AS parameters, CASE WHEN p_partkey % 2 = 0 THEN 'I' ELSE '[[J' END || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'Ljava/lang/String;' ELSE '[Lp/q/T' || p_size || ';' END || ' Lr/U;' AS types, CASE WHEN p_partkey % 2 = 0 THEN 'int' ELSE 'long[][]' END || ' ' || CASE WHEN p_partkey % 3 = 0 THEN 'String' ELSE 'T' || p_size || '[]' END || ' U' AS names, repeat('[', (p_partkey % 3)::INT) || CASE WHEN p_partkey % 2 = 0 THEN 'I' ELSE 'Lp/T' || p_size || ';' END AS descriptor FROM part",
    "generic_parts": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'List|' || p_brand || '<X>' ELSE p_type END AS parts FROM part",
    "class_names": "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'p.q.' END || CASE WHEN p_partkey % 2 = 0 THEN 'T' || p_size ELSE 'Other' END AS fqcn, 'a.B,static c.D.*' AS imports FROM part",
    "subtoken_counts": r"WITH t AS (SELECT doc_id, regexp_extract_all(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '[a-zA-Z0-9]+|[^\sa-zA-Z0-9\x0B]') AS x FROM documents) SELECT doc_id, len(x) AS n, md5(array_to_string(x, ' ')) AS digest FROM t",
    "comment_removal": f"SELECT p_partkey, p_name || CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE ' // note http://x' END || {_N} || 'next;  end' AS code FROM part",
    "splice_lines": f"WITH d AS (SELECT doc_id, source, string_split(text || {_N} || array_to_string(['a', 'b', 'c', 'd', 'e'], {_N}), {_N}) AS x, doc_id % 4 + 1 AS n FROM documents) SELECT doc_id, md5(array_to_string(list_concat(list_concat(x[1:n - 1], [source]), x[n + 2:]), {_N})) AS digest FROM d",
    "indented_text": r"WITH d AS (SELECT doc_id, string_split('x' || chr(10) || text, chr(10)) AS x FROM documents) SELECT doc_id, md5(array_to_string(list_transform(x, lambda l: CASE WHEN regexp_full_match(l, '[ \t]*') THEN '' ELSE '  ' || l END), chr(10))) AS digest FROM d",
    "test_files": "WITH m AS (SELECT p_partkey, 't' || p_size AS t, CASE WHEN p_partkey % 2 = 0 THEN '@Test(expected = Old.class) void t() {}' ELSE replace('@Test void t() {} @Test void u() {}', '@Test', '@Test(expected = ' || CASE WHEN p_partkey % 3 = 0 THEN 'Inner' ELSE 'E' || p_size END || '.class)') END AS b FROM part) SELECT p_partkey, 'p.q.adhoc_T' || t AS name, 'class adhoc_T' || t || ' { ' || b || ' adhoc_T' || t || ' x; }' AS file FROM m",
    "number_texts": "SELECT o_orderkey, format('{:,}', o_custkey * 1000) AS whole, format('{:,}', floor(o_totalprice)::BIGINT // 4) || CASE floor(o_totalprice)::BIGINT % 4 WHEN 0 THEN '.00' WHEN 1 THEN '.25' WHEN 2 THEN '.50' ELSE '.75' END AS decimal FROM orders",
    "throw_lines": "WITH x AS (SELECT p_partkey, p_partkey % 2 = 0 two, p_partkey % 3 = 0 e1, p_partkey % 5 = 0 rt FROM part) SELECT p_partkey, CASE WHEN NOT two THEN '2' WHEN rt AND e1 THEN '2' WHEN rt THEN '2,2' WHEN e1 THEN '2,2' ELSE '2' END AS lines FROM x",
    "tool_log": f"SELECT p_partkey, CASE WHEN ok THEN 'p.T' || p_size || '#t' END AS etest_method, CASE WHEN ok THEN 'p.E' END AS exception, CASE WHEN ok THEN 'q.C#m#7' END AS mut_key, CASE WHEN ok THEN ' q.C#m#7 ' || {_N} || 'q.D#n#8' END AS stack_trace FROM (SELECT *, p_partkey % 4 <> 0 AND p_partkey % 3 <> 0 AS ok FROM part)",
    "code_variants": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN role ELSE '// No match' END AS comment, CASE WHEN turn % 2 = 0 THEN role ELSE '' END AS empty, CASE WHEN turn % 2 = 0 THEN role END AS nothing FROM conversations",
    "markdown_parts": f"""WITH n AS (SELECT n_regionkey, '- Nations' || {_N} || string_agg('  - `' || n_name || '`' || {_N}, '' ORDER BY n_name) || '- Empty' || {_N} AS l FROM nation GROUP BY 1),
        p AS (SELECT n_regionkey, l, '```java' || {_N} || 'x' || {_N} || '```' || {_N} || {_N} || {_N} AS b, {_N} || {_N} AS g FROM n)
        SELECT n_regionkey, '# Region ' || n_regionkey || g || b || '## All' || g || l || g || g || '## More' || g || g AS page, '## Region ' || n_regionkey || g || b || '### All' || g || l || g || g || '### More' || g || g AS demoted FROM p""",
    "base_prompt": f"SELECT p_partkey, 'Be brief.' AS system, 'C' || p_size || '.m' || {_N} || {_FENCE.format(f"'void m() {{' || {_N} || '  x();' || {_N} || '}}'")} || {_N} || CASE WHEN p_partkey % 3 = 0 THEN 'E0, E1' WHEN p_partkey % 3 = 1 THEN 'E1' ELSE 'E1, E2' END || {_N} || '- EBT #0' || {_N} || {_FENCE.format("'t();'")} || repeat({_N}, 3) || '- EBT #1' || {_N} || {_FENCE.format('p_name')} || repeat({_N}, 3) AS user FROM part",
    "one_field_prompt": "SELECT p_partkey, 'Name: ' || p_name || '!' AS user FROM part",
    "add_on_prompt": f"""WITH x AS (SELECT p_partkey, p_partkey % 2 = 0 v, p_partkey % 3 = 0 f, p_partkey % 5 = 0 n, p_partkey % 4 = 0 c FROM part)
        SELECT p_partkey, CASE WHEN v OR f THEN 'Class p.C:' || {_N} || CASE WHEN v THEN '- Variables' || {_N} || '  - `int a `' || {_N} || '  - `b=c`' || {_N} ELSE '' END || CASE WHEN f THEN '- Methods' || {_N} || '  - `f()`' || {_N} ELSE '' END || {_N} ELSE '' END || 'Imports:' || {_N} || '- `x.Y`' || {_N}
            || CASE WHEN n THEN 'Tests:' || {_N} || '- NEBT #0' || {_N} || {_FENCE.format("'n();'")} || repeat({_N}, 3) ELSE '' END
            || CASE WHEN c THEN {_FENCE.format(f"'a; // EBT #0 // EBT #1' || {_N} || 'b; // EBT #1'")} || {_N} || '(covered)' || {_N} ELSE {_FENCE.format(f"'a;' || {_N} || 'b;'")} END AS user, round(((v OR f)::INT + 1 + n::INT + c::INT) / 4, 6) AS share FROM x""",
    "exception_comments": f"""WITH x AS (SELECT p_partkey, p_partkey % 3 AS l, CASE WHEN p_partkey % 2 = 0 THEN ' // unreported q.E1 here, it needs to be catched' ELSE ' // unreported exception here but class not imported, so catch it as `Exception`' END AS u, ' // unreported exception here but class not imported, so catch it as `Exception`' AS w,
            CASE WHEN p_partkey % 5 = 0 THEN least(p_partkey % 9, 1) END AS t, CASE WHEN p_partkey % 2 = 0 THEN ' // q.E1 thrown here when running EBT #0' ELSE ' // Exception thrown here when running EBT #0 you can handle it with `Exception`' END AS s FROM part)
        SELECT p_partkey, {_FENCE.format(f"'a;' || CASE WHEN l = 0 THEN u || w ELSE w END || {_N} || 'b;' || CASE WHEN l = 1 THEN u ELSE '' END || {_N} || 'c;' || CASE WHEN l = 2 THEN u ELSE '' END")} || {_N} || 'U' || {_N} AS unreported,
            CASE WHEN t IS NULL THEN {_FENCE.format(f"'a;' || {_N} || 'b;' || {_N} || 'c;'")} ELSE {_FENCE.format(f"'a;' || CASE WHEN t = 0 THEN s ELSE '' END || {_N} || 'b;' || CASE WHEN t = 1 THEN s ELSE '' END || {_N} || 'c;'")} || {_N} || 'T' || {_N} END AS thrown FROM x""",
    "throw_and_type_info": f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN array_to_string(['Throws:', '- `a.E`', '  - `E()`', '- `z.E`', '  - `E()`', '  - `E(int)`', ''], {_N}) ELSE '' END AS throws, CASE WHEN p_partkey % 3 = 0 THEN array_to_string(['Types:', '- T', '  - Methods', '    - `f()`', '    - `g()`', '', ''], {_N}) ELSE '' END AS types FROM part",
    "repair_errors": f"""WITH x AS (SELECT p_partkey p, {_N} || {_N} AS g FROM part), y AS (SELECT p, g, list_filter([CASE WHEN p % 5 = 0 THEN 'Compilation of maven module failed:' || {_N} || 'log' END, CASE WHEN p % 2 <> 0 THEN 'EBT #0 (shown above) failed:' || {_N} || 'boom' END, CASE WHEN p % 3 <> 0 THEN 'EBT #1 (shown above) failed:' || {_N} || 'boom' END,
            CASE WHEN p % 7 <> 0 AND p % 4 <> 0 THEN 'Non-EBT Test #0 failed:' || {_N} || 'Code:' || {_N} || 'n();' || g || 'Error:' || {_N} || 'boom' END], lambda e: e IS NOT NULL) AS l FROM x) SELECT p AS p_partkey, CASE WHEN len(l) = 0 THEN 'No errors found' ELSE list_reduce(l, lambda a, b: a || g || b) END AS errors FROM y""",
    "token_signature_groups": """SELECT CASE WHEN p_partkey % 4 < 2 THEN 'int m ( int a ) { if ( a > 0 && b ) { return 1 ; } return 2 ; }' WHEN p_partkey % 4 = 2 THEN 'void m ( ) { throw new E ( "a; b" ) ; }' ELSE 'Object m ( ) { return null ; }' END AS signature, count(*) n FROM part GROUP BY 1""",
    "method_bodies": f"SELECT p_partkey, p_partkey % 4 = 2 AS only_throw, false AS empty, p_partkey % 4 = 3 AS empty_after, CASE WHEN p_partkey % 4 = 3 THEN 'Object m() {{' || {_N} || '}}' END AS stripped FROM part",
    "complexity": "SELECT CASE WHEN p_partkey % 4 < 2 THEN 3 ELSE 1 END::BIGINT AS complexity, count(*) n FROM part GROUP BY 1",
    "test_patterns": "SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@Test(expected)' WHEN 1 THEN 'assertThrows' WHEN 2 THEN 'expectedException.expect()' WHEN 3 THEN CASE WHEN p_partkey % 2 = 1 THEN 'try{fail}catch' END END AS pattern, CASE WHEN p_partkey % 5 < 3 OR (p_partkey % 5 = 3 AND p_partkey % 2 = 1) THEN 'q.E' || p_size END AS exception FROM part",
    "tried_methods": r"SELECT p_partkey, CASE WHEN p_partkey % 7 = 6 THEN 'abstract int m();' ELSE ['public void', 'static int', 'boolean', 'Map<String, int[]>', 'private final double', 'char'][p_partkey % 7 + 1] || ' m(int a) throws E { try { if (a) { f(' || p_size || '); } } catch (Exception e) { ' || ['return;', 'return 0;', 'return false;', 'return null;', 'return 0.0;', 'return ''\0'';'][p_partkey % 7 + 1] || ' } }' END AS code FROM part",
    "edge_lookups": f"WITH {_GRAPH}, n AS (SELECT s_suppkey id FROM supplier WHERE s_nationkey = 3) SELECT DISTINCT 'from' AS kind, id, dst AS other, label FROM e JOIN n ON src = id UNION ALL SELECT DISTINCT 'to', id, src, label FROM e JOIN n ON dst = id UNION ALL SELECT DISTINCT 'over', id, src, label FROM e JOIN n ON dst = id WHERE label = 'O'",
    "throwing_paths": f"""WITH RECURSIVE {_GRAPH}, c AS (SELECT DISTINCT src, dst FROM e WHERE label = 'C'), x AS (SELECT 'E0' AS e UNION ALL SELECT 'E1'),
        p AS (SELECT s_suppkey AS start, e AS exception, [s_suppkey] AS path, s_suppkey AS node FROM supplier, x WHERE e = 'E0' OR s_suppkey % 2 = 1
              UNION ALL SELECT start, exception, list_append(path, dst), dst FROM p JOIN c ON src = node WHERE NOT CASE exception WHEN 'E0' THEN node % 4 = 0 ELSE node % 6 = 1 END AND (exception = 'E0' OR dst % 2 = 1) AND NOT list_contains(path, dst))
        SELECT start, exception, array_to_string(path, ',') AS path FROM p WHERE CASE exception WHEN 'E0' THEN node % 4 = 0 ELSE node % 6 = 1 END""",
    "built_call_graph": """WITH RECURSIVE a AS (SELECT s_suppkey node, s_suppkey x, 0 d FROM supplier UNION ALL SELECT node, x // 2, d + 1 FROM a WHERE x > 0), m AS (SELECT s_suppkey * 10 AS id, s_suppkey c, s_nationkey % 4 AS sig, s_suppkey % 5 = 0 OR s_suppkey % 7 = 0 AS tied FROM supplier),
        k AS (SELECT DISTINCT l_suppkey s, l_linenumber % 5 AS sig FROM lineitem) SELECT s * 10 AS src, arg_min(id, d) AS dst, 'C' AS label FROM k JOIN a ON node = s JOIN m ON c = x AND m.sig = k.sig GROUP BY s, k.sig
        UNION SELECT f.id, m.id, 'O' FROM m f JOIN a ON node = f.c AND d > 0 JOIN m ON m.c = x AND m.sig = f.sig WHERE NOT f.tied""",
    "dependency_names": "SELECT DISTINCT 'p.C' || p_size AS name FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0",
    "own_throws": "SELECT s_suppkey AS method, 'p.E' || (s_nationkey % 3) AS exception FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 = s_nationkey % 3",
    "trie_prefix": "WITH t AS (SELECT p_type AS key, min(p_partkey) AS value FROM part GROUP BY 1), w AS (SELECT DISTINCT string_split(p_type, ' ')[1] AS prefix FROM part WHERE p_size = 1) SELECT prefix, key, value FROM t JOIN w ON string_split(key, ' ')[1] = prefix",
    "trie_all_in": f"WITH {_SEQUENCES}, e AS (SELECT key, min(value) AS value FROM q GROUP BY 1), s AS (SELECT s_suppkey AS id, list_transform([s_suppkey, s_suppkey + 1, s_suppkey // 5, 7 * s_suppkey], lambda x: (x % 12)::VARCHAR) AS w FROM supplier) SELECT id, array_to_string(key, ' ') AS key, value FROM s JOIN e ON list_has_all(w, key)",
    "trie_overlaps": f"WITH {_SEQUENCES}, a AS (SELECT * FROM q WHERE odd), b AS (SELECT * FROM q WHERE NOT odd), p AS (SELECT DISTINCT list_slice(key, 1, i) AS prefix FROM (SELECT key, unnest(range(1, len(key) + 1)) AS i FROM a)) SELECT array_to_string(b.key, ' ') AS prefix, a.value AS left_value, b.value AS right_value FROM b JOIN p ON p.prefix = b.key LEFT JOIN a ON a.key = b.key",
    "trie_prefixes_of": "WITH t AS (SELECT p_type AS key, min(p_partkey) AS value FROM part GROUP BY 1) SELECT p_partkey AS id, key, value FROM part JOIN t ON list_slice(list_append(string_split(p_type, ' '), 'more'), 1, len(string_split(key, ' '))) = string_split(key, ' ')",
    "repair_tasks": """WITH r AS (SELECT l_orderkey id, l_returnflag f, l_quantity q, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) - 1 AS s FROM lineitem WHERE l_returnflag IN ('A', 'N')),
        a AS (SELECT * FROM r WHERE f = 'A'), b AS (SELECT * FROM r WHERE f = 'N' AND id IN (SELECT id FROM a)) SELECT id, s AS sample, o_orderstatus, coalesce(b.q, a.q) AS quantity FROM a FULL JOIN b USING (id, s) JOIN orders ON o_orderkey = id""",
    "drawn_tests": "SELECT l_suppkey, least(count(*), 5) AS n FROM lineitem GROUP BY 1",
}
