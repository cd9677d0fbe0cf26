"""Lookups whose keys have very many methods and very many tests or traces."""

from pyspark.sql import functions as F

from millrace.operators import lookups


def test_lists_are_read_once_for_each_key(spark):
    """What is wanted of a list is derived before methods meet it, so a list of n tests isn't copied to m methods."""
    coverage = spark.range(3000).select(F.lit("p").alias("project"), F.lit(0).alias("module"), F.col("id").alias("test"), F.when(F.col("id") % 3 == 0, "x").alias("pattern"), F.array(F.lit("C#m")).alias("methods"))
    methods = spark.range(2000).select("id", F.lit("p").alias("project"), F.lit(0).alias("module"), F.when(F.col("id") % 2 == 0, "C#m").otherwise("C#n").alias("mut_key"))
    made = lambda tests: {"n": F.size(tests), "total": F.aggregate(tests, F.lit(0).cast("long"), lambda a, x: a + x)}
    got = lookups.covering_tests(methods, coverage, derive=made)
    assert got.columns == ["id", "project", "module", "mut_key", "n", "total"]
    assert {(r.id % 2, r.n, r.total) for r in got.collect()} == {(0, 2000, sum(i for i in range(3000) if i % 3)), (1, 0, 0)}
    whole = lookups.covering_tests(methods, coverage)
    assert whole.filter("size(tests) <> IF(id % 2 = 0, 2000, 0)").isEmpty() and whole.count() == 2000


def test_first_trace_of_each_key(spark):
    """Traces are reduced to the first of each key before methods meet them: no row is written for a pair of a method and a trace."""
    traces = spark.range(500).select(F.lit(0).alias("project"), F.lit(0).alias("module"), (500 - F.col("id")).alias("pos"), F.array(F.lit("E")).alias("etypes"), F.array(F.lit("a"), F.lit("b"), F.lit("a"), F.when(F.col("id") == 499, "none").otherwise("c")).alias("frames"))
    methods = spark.range(800).select("id", F.lit(0).alias("project"), F.lit(0).alias("module"), F.get(F.array(*map(F.lit, "abcd")), (F.col("id") % 4).cast("int")).alias("mut_key"), F.lit("E").alias("etype"))
    lines = spark.createDataFrame([("c", "E", 7), ("c", "E", 5), ("d", "F", 1)], "method string, etype string, line int")
    got = lookups.first_possible_trace(methods, traces, lines)
    assert {(r.mut_key, tuple(r.frames or ()), r.line) for r in got.collect()} == {("a", ("a", "b", "a", "c"), 5), ("b", ("b", "a", "c"), 5), ("c", ("c",), 5), ("d", (), None)}
    assert got.count() == 800
    assert "Aggregate [id#" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_stacks_are_read_once_for_each_key(spark):
    traces = spark.range(1000).select(F.lit("p").alias("project"), F.lit("E").alias("etype"), F.array(F.lit("C#m"), (F.col("id") % 400).cast("string")).alias("call_stack"))
    methods = spark.range(900).select("id", F.when(F.col("id") % 3 == 0, "q").otherwise("p").alias("project"), F.lit("E").alias("etype"), F.when(F.col("id") % 2 == 0, "C#m").otherwise("C#n").alias("mut_key"))
    got = lookups.call_suffixes(methods, traces, lambda stacks: {"n": F.size(stacks)})
    assert got.columns[-1] == "n" and {(r.project, r.id % 2, r.n) for r in got.collect()} == {("p", 0, 400), ("p", 1, 0)} and got.count() == 600
    assert lookups.call_suffixes(methods, traces).filter("size(stack_traces) <> IF(id % 2 = 0, 400, 0)").isEmpty()
