"""Filters of the funnel, lookups of tests and traces, and coverage over the driver's tables.

Stand-ins: an order is a method, its customer a project, a line a test or trace; a part or supplier number is a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import coverage, funnel, lookups, traces
from millrace.session import table


def _text(c: str, prefix: str = ""):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def method_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as methods whose lines' flags are exceptions: which of the filters that need no runs toss each of them."""
    kinds = F.create_map(*[F.lit(x) for x in ("A", "java.lang.Exception", "N", "java.io.IOException", "R", "p.UserException")])
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(kinds[F.col("l_returnflag")])).alias("e"))
    rows = table(spark, sf_dir, "orders").join(lines, "o_orderkey", "left").select(
        F.col("o_orderkey").alias("id"),
        F.transform(F.coalesce("e", F.array().cast("array<string>")), lambda x: F.struct(x.alias("exception"))).alias("ebts"),
        F.map_from_entries(F.transform(F.array_distinct(F.coalesce("e", F.array().cast("array<string>"))), lambda x: F.struct(x, F.array(x)))).alias("throw_info"),
        F.when(F.col("o_orderstatus") == "P", "void m() {\n  throw new E();\n}").otherwise("void m() { x(); throw y; }").alias("mut"),
    )
    names = ("generic_exception", "one_throw", "only_system_exception", "only_user_exception", "single_ebt")
    return rows.select("id", *[F.coalesce(funnel.tossed([n]), F.lit(False)).alias(n) for n in names])


def project_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers by nation: those of listed nations, without two that are skipped."""
    rows = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("project"))
    listed = table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.col("n_name").alias("project"))
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").filter("n_nationkey IN (1, 4)").collect()]
    return funnel.target_projects(funnel.no_project(rows, listed), None, names)


def module_skips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as modules."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_size") < 10, "pom").otherwise("jar").alias("packaging"), (F.col("p_size") % 2 == 0).alias("has_src"), (F.col("p_partkey") % 3).alias("n_etests"))
    kept, skipped = funnel.kept_modules(rows)
    return skipped.groupBy("skipped").agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).withColumn("skipped", F.lit("kept")))


def _pattern(i):
    return F.when(i % 3 == 0, F.lit("expected"))


def test_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", _pattern(F.col("l_linenumber")).alias("pattern"))
    each = [funnel.tests_of_kind(tests, e).agg(F.count("*").alias("n"), F.sum("l_linenumber").alias("lines")).withColumn("exceptional", F.lit(e)) for e in (True, False)]
    return each[0].unionByName(each[1])


def public_throwing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(
        F.col("p_brand").alias("project"),
        F.col("p_size").alias("module"),
        F.col("p_partkey").alias("method"),
        F.when(F.col("p_partkey") % 2 == 0, F.array(F.lit("static"), F.lit("public"))).otherwise(F.array(F.lit("private"))).alias("modifiers"),
        F.slice(F.array(F.concat(F.lit("E1@@"), (F.col("p_size") + 4).cast("string")), F.concat(F.lit("E2@@"), (F.col("p_size") + 9).cast("string"))), F.lit(1), (F.col("p_partkey") % 3).cast("int")).alias("exceptions"),
        F.col("p_size").alias("start_line"),
    )
    return funnel.public_throwing(rows)


def tool_gold_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines as tests of classes by supplier; a class fails where its line was returned."""
    lines = table(spark, sf_dir, "lineitem").withColumn("fqcn", F.concat(F.lit("C"), (F.col("l_suppkey") % 5).cast("string")))
    rows = lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.concat("fqcn", F.lit("#t"), F.col("l_linenumber").cast("string")).alias("etest_method")))).alias("tests"))
    ran = lines.filter("l_quantity > 20").select(F.col("l_orderkey").alias("id"), "fqcn", (F.col("l_returnflag") != "R").alias("passed"))
    out = funnel.drop_failing_tests(rows, ran, "tests")
    return out.select("id", F.array_join(F.transform("tests", lambda t: t["etest_method"]), ",").alias("tests"))


def allowed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size", F.array("p_name").alias("stack_traces"))
    return funnel.allowed(rows, table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))).select("id", "p_size")


def sequential_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open orders numbered from 0."""
    return funnel.numbered(table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select("o_orderkey"), "o_orderkey").select("o_orderkey", F.col("number").cast("long").alias("number"))


def price_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests that cost their priority's number, until 5,000 are spent."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).cast("long").alias("cost"))
    return funnel.within_budget(rows, "o_orderkey", "cost", 5000).select("o_orderkey", "spent", "sent")


def head_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three of an order's lines of two kinds."""
    kinds = {c: F.array_sort(F.collect_list(F.when(F.col("l_returnflag") == f, F.col("l_partkey")))) for c, f in (("a", "A"), ("b", "N"))}
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(*[v.alias(k) for k, v in kinds.items()])
    return rows.select("l_orderkey", F.array_join(funnel.head(rows, "a", "b", 3).cast("array<string>"), ",").alias("parts"))


def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], [F.desc("event_id")])


def direct_throws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as records of methods, which are the orders: traces grow with the line's number."""
    lines = table(spark, sf_dir, "lineitem")
    records = lines.select(F.col("l_orderkey").alias("mut_key"), (F.col("l_partkey") * 1000000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("pos"), F.col("l_partkey").alias("id"), F.col("l_partkey").cast("string").alias("test"), (F.col("l_linenumber") % 5).alias("trace_len"))
    return funnel.direct_throws(records).select("mut_key", "id", F.array_join("ebts", ",").alias("ebts"))


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers' lines as tests of the module of their supplier's number, each covering its part and the next."""
    p = F.col("l_partkey")
    name = lambda n: F.concat(F.lit("p.C#m"), (n % 40).cast("string"))
    rows = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), (F.col("l_suppkey") % 7).alias("module"), (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("test"), _pattern(F.col("l_linenumber")).alias("pattern"), F.array(name(p), name(p + 1), name(p)).alias("methods"))
    return rows.groupBy("project", "module", "test").agg(F.min("pattern").alias("pattern"), F.flatten(F.collect_list("methods")).alias("methods"))


def covering_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("p").alias("project"), (F.col("p_partkey") % 8).alias("module"), F.concat(F.lit("p.C#m"), (F.col("p_partkey") % 50).cast("string")).alias("mut_key"))
    made = lambda tests: {"n": F.size(tests).cast("long"), "digest": F.md5(F.array_join(tests.cast("array<string>"), ","))}
    return lookups.covering_tests(methods, _coverage(spark, sf_dir), derive=made).select("id", "n", "digest")


def nebt_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with the coverage's keys dotted: methods whose key has a slash are missed."""
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("p").alias("project"), (F.col("p_partkey") % 8).alias("module"), F.concat(F.when(F.col("p_partkey") % 3 == 0, F.lit("p/C#m")).otherwise(F.lit("p.C#m")), (F.col("p_partkey") % 50).cast("string")).alias("mut_key"))
    out = lookups.covering_tests(methods, _coverage(spark, sf_dir), slashes=False, derive=lambda tests: {"n": F.size(tests).cast("long")})
    return out.select("id", "n")


def tool_test_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of classes by size; lines as entries, of which a tenth has no file and a ninth no method."""
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("p").alias("project"), F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("#m#()V")).alias("mut_key"))
    pos = F.col("l_orderkey") * 100 + F.col("l_linenumber")
    entries = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), F.concat(F.lit("C"), (F.col("l_partkey") % 60).cast("string"), F.when(F.col("l_orderkey") % 9 == 0, F.lit("")).otherwise(F.lit("#m#I"))).alias("mut_key"), F.concat(F.lit("T#"), (F.col("l_orderkey") % 30).cast("string")).alias("etest_method"), F.when(F.col("l_orderkey") % 10 == 0, F.lit("")).otherwise(F.lit("f")).alias("rel_path"), pos.alias("pos"))
    out = lookups.tool_tests(methods, entries)
    return out.select("id", F.array_join(F.transform("tests", lambda t: t["etest_method"]), ",").alias("tests"))


def fallback_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods; lines as tests of classes by quantity, half of which cover a part of their module. Drawn sets are counted only."""
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("p").alias("project"), (F.col("p_partkey") % 40).alias("module"), F.col("p_partkey").alias("mut_key"), (F.col("p_size") * 2).cast("double").alias("test_class"))
    n = F.col("l_orderkey")
    tests = table(spark, sf_dir, "lineitem").select(F.lit("p").alias("project"), (n % 41).alias("module"), (n * 100 + F.col("l_linenumber")).alias("test"), F.col("l_quantity").alias("class"), _pattern(F.col("l_linenumber")).alias("pattern"), F.when((n % 2 == 0) & (n % 41 != 7), n % 41 + 40 * (n % 23)).alias("mut"))
    tests = tests.groupBy("project", "module", "test").agg(F.min("class").alias("class"), F.min("pattern").alias("pattern"), F.min("mut").alias("mut"))
    return lookups.tests_or_others(methods, tests).select("id", "source", F.size("tests").cast("long").alias("n"))


def test_class_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods of inner and outer classes; suppliers as test classes."""
    key = F.concat(F.lit("C"), (F.col("p_partkey") % 60).cast("string"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("$I"), (F.col("p_size") % 3).cast("string"))).otherwise(F.lit("")), F.lit("#m"))
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lit("p").alias("project"), F.lit(0).alias("module"), key.alias("mut_key"))
    s = F.col("s_suppkey")
    name = F.concat(F.lit("C"), (s % 50).cast("string"), F.when(s % 4 == 0, F.lit("$I1")).otherwise(F.lit("")), F.lit("Test"))
    tests = table(spark, sf_dir, "supplier").select(F.lit("p").alias("project"), F.lit(0).alias("module"), name.alias("class"), F.col("s_name").alias("context"), s.alias("test"), s.alias("pos"))
    return lookups.test_context(methods, tests).select("id", "test_class", "context", "first_test")


def _stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as call stacks: the parts of their lines in order."""
    frame = F.concat(F.lit("p.C#m"), (F.col("l_partkey") % 90).cast("string"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", frame.alias("f")))), lambda x: x["f"])
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(listed.alias("call_stack"))
    return rows.select(F.col("l_orderkey").alias("pos"), (F.col("l_orderkey") % 5).alias("project"), F.concat(F.lit("E"), (F.col("l_orderkey") % 3).cast("string")).alias("etype"), "call_stack")


def call_stack_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 6).alias("project"), F.concat(F.lit("E"), (F.col("p_partkey") % 4).cast("string")).alias("etype"), F.concat(F.lit("p/C#m"), (F.col("p_partkey") % 100).cast("string")).alias("mut_key"))
    made = lambda stacks: {"n": F.size(stacks).cast("long"), "frames": F.aggregate(stacks, F.lit(0).cast("long"), lambda a, s: a + F.size(s))}
    return lookups.call_suffixes(methods, _stacks(spark, sf_dir), made).select("id", "n", "frames")


def normal_exceptional_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of one part: kept ones beside returned ones."""
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("mut"), F.col("l_orderkey").alias("test"), "l_returnflag")
    return lookups.ne_e_pairs(lines.filter("l_returnflag = 'N'"), lines.filter("l_returnflag = 'R'"))


def real_stack_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    methods = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 5).alias("project"), F.lit(0).alias("module"), F.concat(F.lit("p.C#m"), (F.col("p_partkey") % 100).cast("string")).alias("mut_key"), F.concat(F.lit("E"), (F.col("p_partkey") % 3).cast("string")).alias("etype"))
    logged = _stacks(spark, sf_dir).select("project", F.lit(0).alias("module"), "pos", F.array("etype").alias("etypes"), F.col("call_stack").alias("frames"))
    s = F.col("s_suppkey")
    lines = table(spark, sf_dir, "supplier").select(F.concat(F.lit("p.C#m"), (s % 70).cast("string")).alias("method"), F.concat(F.lit("E"), (s % 4).cast("string")).alias("etype"), F.col("s_nationkey").alias("line"))
    out = lookups.first_possible_trace(methods, logged, lines)
    return out.select("id", F.array_join("frames", ",").alias("frames"), "line")


def paired_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.filter(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("id")).agg(F.sum("l_quantity").alias("value")) for f in "AN")
    return lookups.paired(a, b, table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("id")))


def refreshed_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as tests; parts with their numbers as a new scan, which has them all once."""
    s = F.col("s_suppkey")
    tests = table(spark, sf_dir, "supplier").select(_text("s_suppkey", "t").alias("test_key"), F.concat(F.lit("E"), (s % 3).cast("string")).alias("exception"), F.col("s_name").alias("pattern"), F.lit("old").alias("code"))
    p = F.col("p_partkey")
    scanned = table(spark, sf_dir, "part").select(_text("p_partkey", "t").alias("test_key"), F.concat(F.lit("E"), (p % 2).cast("string")).alias("exception"), F.col("p_brand").alias("pattern"), F.col("p_name").alias("code"))
    return lookups.refreshed(tests, scanned)


def stack_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(p % 3 == 0, F.array("p_name")).otherwise(F.array().cast("array<string>")).alias("stack_traces"), F.slice(F.array(F.when(p % 4 == 0, "m#()V").otherwise("n#()V"), F.lit("x")), F.lit(1), (p % 2 + 1).cast("int")).alias("call_stacks"), F.lit("p.C#m#()V").alias("mut_key"))
    a, b = lookups.stack_availability(rows)
    return a.select("p_partkey", F.lit(True).alias("available")).union(b.select("p_partkey", F.lit(False)))


def _resolved(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Lines as tests of parts; suppliers' nations as declared exceptions of parts, some on a condition."""
    n = F.col("l_orderkey")
    tests = table(spark, sf_dir, "lineitem").select((n * 100 + F.col("l_linenumber")).alias("test"), F.when(n % 6 != 0, F.col("l_partkey") % 500).alias("mut"), F.concat(F.lit("E"), (n % 4).cast("string")).alias("exception"), (n % 5 != 0).alias("throws")).groupBy("test").agg(*[F.min(c).alias(c) for c in ("mut", "exception", "throws")])
    s = F.col("s_suppkey")
    clauses = table(spark, sf_dir, "supplier").select(s.alias("clause"), (s % 300).alias("method"), F.concat(F.lit("E"), (F.col("s_nationkey") % 5).cast("string")).alias("exception"), (s % 2 == 0).alias("has_condition"))
    return coverage.resolved(tests, clauses), clauses


def coverage_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.coverage_rate(*_resolved(spark, sf_dir))
    return out.withColumn("rate", F.round("rate", 6))


def clause_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = coverage.clause_report(*_resolved(spark, sf_dir), 3)
    return out.select("clause", "covered", "n", F.array_join(F.col("tests").cast("array<string>"), ",").alias("tests"), "more")


def coverage_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderstatus") == "P").alias("failed"), (n % 2 == 0).alias("declared_log"), (n % 3).alias("logged_methods"), (n % 5 == 0).alias("throw_log"))
    return coverage.classified(rows).groupBy("coverage").agg(F.count("*").alias("n"))


def module_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' orders by priority as modules' tests: finished ones are exceptional, dear ones failed."""
    tests = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project"), F.col("o_orderpriority").alias("module"), F.when(F.col("o_orderstatus") == "F", "x").alias("pattern"), (F.col("o_totalprice") > 200000).alias("failed"))
    kept, dropped = coverage.module_report(tests, 0.45)
    out = kept.withColumn("dropped", F.lit(False)).unionByName(dropped.withColumn("dropped", F.lit(True)))
    return out.select("project", "module", "n_tests", "n_etests", "n_errors", "dropped")


def project_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    tests = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("project"), F.col("o_orderpriority").alias("module"), F.when(F.col("o_orderstatus") == "F", "x").alias("pattern"), (F.col("o_totalprice") > 200000).alias("failed"))
    return coverage.project_report(coverage.module_report(tests, 0.45)[0])


def merged_stacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as normal tests of a part's size with a stack of two frames."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("id"), (F.col("l_orderkey") * 1000000 + F.col("l_linenumber") * 100000 + F.col("l_suppkey")).alias("pos"), (F.col("l_partkey") % 30).alias("mut"), F.col("l_returnflag").alias("etype"), F.array(F.col("l_linestatus"), (F.col("l_suppkey") % 2).cast("string")).alias("call_stack"), (F.col("l_orderkey") % 200).alias("test_ne")
    )
    out = coverage.merged_stacks(rows)
    return out.select("id", "mut", "etype", "stack", F.md5(F.array_join(F.col("tests").cast("array<string>"), ",")).alias("digest"))


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as traces of users' tests: as many frames as the event's number tells, the first one in the test."""
    e = F.col("event_id")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("test"), e.alias("pos"), F.col("event_type").alias("logged"), F.concat(F.array(F.lit("p.adhoc_T")), F.array_repeat(F.lit("p.C"), (e % 5).cast("int"))).alias("frames"))


def shallowest_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage.shallowest_method(_logs(spark, sf_dir))


def directly_called(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.directly_called(_logs(spark, sf_dir)).select("test", F.array_join("methods", ",").alias("methods"))


def min_depth_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    logs = _logs(spark, sf_dir).select("test", "pos", "logged", F.size("frames").alias("depth"))
    return traces.shallowest(logs, ["test"], "pos").select("test", "pos", F.col("depth").cast("long").alias("depth"))


def cleaned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stacks of their lines' flags, returned ones without a line number."""
    frame = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.col("l_linestatus").alias("method"), F.when(F.col("l_returnflag") == "R", -1).otherwise(F.col("l_linenumber")).alias("line"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(frame)).alias("x"))
    out = traces.cleaned(F.transform("x", lambda f: F.struct(f["method"].alias("method"), f["line"].alias("line"))))
    return rows.select("l_orderkey", F.array_join(F.transform(out, lambda f: F.concat(f["method"], f["line"].cast("string"))), ",").alias("frames"))


def running_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as statements that each set a variable by the turn's number: all values, and the last user's turn."""
    turns = table(spark, sf_dir, "conversations").withColumn("delta", F.create_map(F.concat(F.lit("v"), (F.col("turn") % 2).cast("string")), F.col("turn")))
    values = traces.running_values(turns.select("conv_id", "turn", "delta"), ["conv_id"], "turn")
    called = traces.last_called(turns.select("conv_id", "turn", F.when(F.col("role") == "user", F.col("turn")).alias("called")), ["conv_id"], "turn")
    both = values.join(called, ["conv_id", "turn"])
    return both.select("conv_id", "turn", F.col("values")["v0"].alias("v0"), F.col("values")["v1"].alias("v1"), "last_called")


QUERIES = {
    f.__name__: f
    for f in (
        method_filters, project_lists, module_skips, test_kinds, public_throwing, tool_gold_filter, allowed_ids, sequential_ids, price_limit, head_limit,
        dedup_last, direct_throws, covering_tests, nebt_lookup, tool_test_lookup, fallback_tests, test_class_context, call_stack_suffixes,
        normal_exceptional_pairs, real_stack_traces, paired_results, refreshed_tests, stack_availability, coverage_resolution, clause_report, coverage_classes,
        module_reports, project_reports, merged_stacks, shallowest_method, directly_called, min_depth_trace, cleaned_frames, running_state,
    )
}

_COVERAGE = """t AS (SELECT l_suppkey % 7 AS module, l_orderkey * 100 + l_linenumber AS test, max(l_linenumber % 3 = 0) AS exc, list(l_partkey) ps FROM lineitem GROUP BY 1, 2),
    m AS (SELECT DISTINCT module, test, unnest(list_concat(list_transform(ps, lambda p: p % 40), list_transform(ps, lambda p: (p + 1) % 40))) AS k FROM t WHERE NOT exc)"""
_STACK = "st AS (SELECT l_orderkey pos, l_orderkey % 5 AS project, 'E' || (l_orderkey % 3) AS etype, list('p.C#m' || (l_partkey % 90) ORDER BY l_linenumber, l_partkey, l_suppkey) AS fs FROM lineitem GROUP BY 1)"
_RESOLVED = """t AS (SELECT l_orderkey * 100 + l_linenumber AS test, min(CASE WHEN l_orderkey % 6 <> 0 THEN l_partkey % 500 END) mut, 'E' || min(l_orderkey % 4) AS exception, min(l_orderkey % 5 <> 0) throws FROM lineitem GROUP BY 1),
    c AS (SELECT s_suppkey clause, s_suppkey % 300 AS method, 'E' || (s_nationkey % 5) AS exception, s_suppkey % 2 = 0 AS cond FROM supplier),
    f AS (SELECT t.*, (SELECT arg_min(clause, (cond::INT, clause)) FROM c WHERE c.method = t.mut AND c.exception = t.exception) AS clause FROM t),
    r AS (SELECT *, CASE WHEN clause IS NOT NULL THEN 'declared' WHEN throws THEN 'undeclared' ELSE 'no_mut' END kind FROM f)"""
_MODULES = "m AS (SELECT o_custkey % 50 AS project, o_orderpriority AS module, count(*) n_tests, count(*) FILTER (o_orderstatus = 'F') n_etests, count(*) FILTER (o_totalprice > 200000) n_errors FROM orders GROUP BY 1, 2), d AS (SELECT *, n_etests > 0 AND n_errors / n_tests > 0.45::DOUBLE AS dropped FROM m)"
_LOG = "e AS (SELECT user_id AS test, event_id pos, event_type logged, event_id % 5 AS depth FROM events)"

ORACLES = {
    "method_filters": "SELECT o_orderkey AS id, count(*) FILTER (l_returnflag = 'A') > 0 AS generic_exception, o_orderstatus = 'P' AS one_throw, count(*) FILTER (l_returnflag IN ('A', 'N')) = 0 AS only_system_exception, count(*) FILTER (l_returnflag IN ('A', 'N')) > 0 AS only_user_exception, count(l_orderkey) = 1 AS single_ebt FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderstatus",
    "project_lists": "SELECT s_suppkey, n_name AS project FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 AND n_nationkey NOT IN (1, 4)",
    "module_skips": "SELECT CASE WHEN p_size < 10 THEN 'pom' WHEN p_size % 2 <> 0 THEN 'no_src' WHEN p_partkey % 3 = 0 THEN 'no_etest' ELSE 'kept' END AS skipped, count(*) n FROM part GROUP BY 1",
    "test_kinds": "SELECT count(*) n, sum(l_linenumber)::BIGINT AS lines, l_linenumber % 3 = 0 AS exceptional FROM lineitem GROUP BY 3",
    "public_throwing": "SELECT p_brand AS project, p_size AS module, p_partkey AS mut_key, 'E' || k AS etype, CASE k WHEN 1 THEN 4 ELSE 9 END::INT AS line FROM part, range(1, 3) t(k) WHERE p_partkey % 2 = 0 AND k <= p_partkey % 3",
    "tool_gold_filter": "WITH l AS (SELECT l_orderkey id, 'C' || (l_suppkey % 5) c, 'C' || (l_suppkey % 5) || '#t' || l_linenumber t, l_quantity > 20 AND l_returnflag = 'R' bad FROM lineitem), b AS (SELECT DISTINCT id, c FROM l WHERE bad) SELECT l.id, coalesce(string_agg(t, ',' ORDER BY t) FILTER (b.id IS NULL), '') AS tests FROM l LEFT JOIN b ON b.id = l.id AND b.c = l.c GROUP BY 1",
    "allowed_ids": "SELECT p_partkey AS id, p_size FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
    "sequential_ids": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS number FROM orders WHERE o_orderstatus = 'O'",
    "price_limit": "WITH s AS (SELECT o_orderkey, (coalesce(sum(o_orderpriority[1]::INT) OVER (ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS spent FROM orders) SELECT *, spent < 5000 AS sent FROM s",
    "head_limit": "WITH r AS (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_returnflag, l_partkey) k FROM lineitem WHERE l_returnflag IN ('A', 'N')) SELECT o.l_orderkey, coalesce(string_agg(l_partkey::VARCHAR, ',' ORDER BY k) FILTER (k <= 3), '') AS parts FROM (SELECT DISTINCT l_orderkey FROM lineitem) o LEFT JOIN r USING (l_orderkey) GROUP BY 1",
    "dedup_last": "SELECT user_id, event_type, max(event_id) event_id FROM events GROUP BY 1, 2",
    "direct_throws": "WITH r AS (SELECT l_orderkey AS mut_key, l_partkey id, l_partkey * 1000000 + l_suppkey * 100 + l_linenumber pos, l_linenumber % 5 AS n FROM lineitem) SELECT mut_key, arg_min(id, pos) AS id, string_agg(id::VARCHAR, ',' ORDER BY pos, id::VARCHAR) AS ebts FROM r GROUP BY 1 HAVING max(n) <= 1",
    "covering_tests": f"WITH {_COVERAGE}, p AS (SELECT p_partkey id, p_partkey % 8 AS module, p_partkey % 50 AS k FROM part) SELECT id, count(test) n, md5(coalesce(string_agg(test::VARCHAR, ',' ORDER BY test), '')) AS digest FROM p LEFT JOIN m USING (module, k) GROUP BY 1",
    "nebt_lookup": f"WITH {_COVERAGE}, p AS (SELECT p_partkey id, p_partkey % 8 AS module, CASE WHEN p_partkey % 3 <> 0 THEN p_partkey % 50 END AS k FROM part) SELECT id, count(test) n FROM p LEFT JOIN m USING (module, k) GROUP BY 1",
    "tool_test_lookup": "WITH e AS (SELECT 'C' || (l_partkey % 60) c, 'T#' || (l_orderkey % 30) t, min(l_orderkey * 100 + l_linenumber) pos FROM lineitem WHERE l_orderkey % 9 <> 0 AND l_orderkey % 10 <> 0 GROUP BY 1, 2) SELECT p_partkey AS id, coalesce(string_agg(t, ',' ORDER BY pos, t), '') AS tests FROM part LEFT JOIN e ON c = 'C' || p_size GROUP BY 1",
    "fallback_tests": """WITH t AS (SELECT l_orderkey % 41 AS module, l_orderkey * 100 + l_linenumber AS test, min(l_quantity) c, max(l_linenumber % 3 = 0) exc, min(CASE WHEN l_orderkey % 2 = 0 AND l_orderkey % 41 <> 7 THEN l_orderkey % 41 + 40 * (l_orderkey % 23) END) mut FROM lineitem GROUP BY 1, 2),
        k AS (SELECT module, bool_or(mut IS NOT NULL) known, count(*) FILTER (NOT exc) plain FROM t GROUP BY 1), a AS (SELECT module, mut, count(*) n, count(*) FILTER (NOT exc) plain FROM t WHERE mut IS NOT NULL GROUP BY 1, 2), b AS (SELECT module, c, count(*) n FROM t WHERE NOT exc GROUP BY 1, 2),
        p AS (SELECT p_partkey id, p_partkey % 40 AS module, p_size * 2.0::DOUBLE AS c FROM part)
        SELECT id, CASE WHEN a.plain > 0 THEN 'mut' WHEN a.n IS NULL AND coalesce(known, false) AND b.n > 0 THEN 'class' WHEN k.plain > 0 THEN 'module' ELSE 'none' END AS source,
            CASE WHEN a.plain > 0 THEN a.plain WHEN a.n IS NULL AND coalesce(known, false) AND b.n > 0 THEN b.n ELSE least(coalesce(k.plain, 0), 5) END::BIGINT AS n
        FROM p LEFT JOIN a ON a.module = p.module AND mut = id LEFT JOIN b ON b.module = p.module AND b.c = p.c LEFT JOIN k ON k.module = p.module""",
    "test_class_context": "WITH t AS (SELECT 'C' || (s_suppkey % 50) || CASE WHEN s_suppkey % 4 = 0 THEN '$I1' ELSE '' END || 'Test' AS c, arg_max(s_name, s_suppkey) ctx, min(s_suppkey) f FROM supplier GROUP BY 1), p AS (SELECT p_partkey id, 'C' || (p_partkey % 60) || CASE WHEN p_partkey % 2 = 0 THEN '$I' || (p_size % 3) ELSE '' END AS k, 'C' || (p_partkey % 60) AS o FROM part) SELECT id, coalesce(x.c, y.c) AS test_class, CASE WHEN x.c IS NOT NULL THEN x.ctx ELSE y.ctx END AS context, CASE WHEN x.c IS NOT NULL THEN x.f ELSE y.f END AS first_test FROM p LEFT JOIN t x ON x.c = k || 'Test' LEFT JOIN t y ON y.c = o || 'Test'",
    "call_stack_suffixes": f"WITH {_STACK}, s AS (SELECT DISTINCT project, etype, fs[i] AS f, fs[i:] AS part FROM st, unnest(range(1, len(fs) + 1)) AS u(i)), p AS (SELECT p_partkey id, p_partkey % 6 AS project, 'E' || (p_partkey % 4) AS etype, 'p.C#m' || (p_partkey % 100) AS f FROM part WHERE p_partkey % 6 < 5) SELECT id, count(part) n, coalesce(sum(len(part)), 0)::BIGINT AS frames FROM p LEFT JOIN s USING (project, etype, f) GROUP BY 1",
    "normal_exceptional_pairs": "SELECT DISTINCT a.l_partkey AS mut, a.l_orderkey AS ne, b.l_orderkey AS e FROM lineitem a JOIN lineitem b ON a.l_partkey = b.l_partkey WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R'",
    "real_stack_traces": f"""WITH {_STACK}, l AS (SELECT 'p.C#m' || (s_suppkey % 70) AS m, 'E' || (s_suppkey % 4) AS etype, min(s_nationkey) AS line FROM supplier GROUP BY 1, 2), p AS (SELECT p_partkey id, p_partkey % 5 AS project, 'p.C#m' || (p_partkey % 100) AS k, 'E' || (p_partkey % 3) AS etype FROM part),
        c AS (SELECT id, -1 AS pos, 0 AS i, [k] AS fs, line FROM p JOIN l ON m = k AND l.etype = p.etype UNION ALL SELECT id, pos, i, st.fs[i:], line FROM p JOIN (SELECT *, unnest(range(1, len(fs) + 1)) AS i FROM st) st ON st.project = p.project AND st.etype = p.etype AND st.fs[i] = k JOIN l ON m = st.fs[-1] AND l.etype = p.etype),
        b AS (SELECT id, arg_min(fs, (pos, i)) fs, arg_min(line, (pos, i)) AS line FROM c GROUP BY 1) SELECT p.id, array_to_string(fs, ',') AS frames, line FROM p LEFT JOIN b USING (id)""",
    "paired_results": "SELECT l_orderkey AS id, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'N') AS b FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O') GROUP BY 1 HAVING count(*) FILTER (l_returnflag = 'A') > 0 AND count(*) FILTER (l_returnflag = 'N') > 0",
    "refreshed_tests": "SELECT 't' || s_suppkey AS test_key, 'E' || (s_suppkey % 3) AS exception, coalesce(p_brand, s_name) AS pattern, coalesce(p_name, 'old') AS code FROM supplier LEFT JOIN part ON p_partkey = s_suppkey AND p_partkey % 2 = s_suppkey % 3",
    "stack_availability": "SELECT p_partkey, p_partkey % 3 = 0 OR (p_partkey % 2 = 0 AND p_partkey % 4 = 0) AS available FROM part",
    "coverage_resolution": f"WITH {_RESOLVED} SELECT count(DISTINCT clause) covered, (SELECT count(*) FROM c) clauses, round(count(DISTINCT clause) / (SELECT count(*) FROM c), 6) AS rate, count(DISTINCT exception) FILTER (kind = 'declared') types, count(DISTINCT exception) FILTER (kind = 'undeclared') undeclared_types FROM r",
    "clause_report": f"WITH {_RESOLVED} SELECT c.clause, count(test) > 0 AS covered, count(DISTINCT test) n, coalesce(array_to_string(list_slice(list_sort(list(test) FILTER (test IS NOT NULL)), 1, 3), ','), '') AS tests, greatest(count(DISTINCT test) - 3, 0) AS more FROM c LEFT JOIN r USING (clause) GROUP BY 1",
    "coverage_classes": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'error' WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 > 0 THEN 'covered' WHEN o_orderkey % 2 = 0 OR o_orderkey % 5 = 0 THEN 'unchecked' ELSE 'no_coverage' END AS coverage, count(*) n FROM orders GROUP BY 1",
    "module_reports": f"WITH {_MODULES} SELECT * FROM d",
    "project_reports": f"WITH {_MODULES} SELECT project, count(*) n_modules, sum(n_tests)::BIGINT n_tests, sum(n_etests)::BIGINT n_etests FROM d WHERE NOT dropped GROUP BY 1",
    "merged_stacks": "WITH r AS (SELECT l_partkey % 30 AS mut, l_returnflag etype, l_linestatus || '-' || (l_suppkey % 2) AS stack, l_orderkey % 200 AS t, min((l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey, l_orderkey)) AS f FROM lineitem GROUP BY 1, 2, 3, 4) SELECT min(f)[2] AS id, mut, etype, stack, md5(string_agg(t::VARCHAR, ',' ORDER BY f, t)) AS digest FROM r GROUP BY mut, etype, stack",
    "shallowest_method": f"WITH {_LOG} SELECT test, arg_min(logged, (depth, -pos)) AS mut FROM e WHERE depth > 0 GROUP BY 1",
    "directly_called": f"WITH {_LOG} SELECT test, string_agg(DISTINCT logged, ',' ORDER BY logged) AS methods FROM (SELECT * FROM e WHERE depth > 0 QUALIFY depth = min(depth) OVER (PARTITION BY test)) GROUP BY 1",
    "min_depth_trace": f"WITH {_LOG} SELECT test, pos, depth + 1 AS depth FROM e QUALIFY row_number() OVER (PARTITION BY test ORDER BY depth, pos DESC) = 1",
    "cleaned_frames": "WITH f AS (SELECT l_orderkey, l_linestatus m, CASE WHEN l_returnflag = 'R' THEN -1 ELSE l_linenumber END n, row_number() OVER w k, lead(l_linestatus) OVER w nx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus)) SELECT l_orderkey, string_agg(m || n, ',' ORDER BY k) AS frames FROM f WHERE NOT (n < 0 AND coalesce(nx = m, false)) GROUP BY 1",
    "running_state": "SELECT conv_id, turn, max(CASE WHEN turn % 2 = 0 THEN turn END) OVER w AS v0, max(CASE WHEN turn % 2 = 1 THEN turn END) OVER w AS v1, max(CASE WHEN role = 'user' THEN turn END) OVER w AS last_called FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
}
