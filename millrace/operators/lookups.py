"""Lookups of tests, contexts and stack traces for methods, as joins on keys; what is no equality is a residual of such a join."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import class_of, dotted, method_of, outer_class_of, slashed


def _listed(order: list[str], *columns: str) -> Column:
    """The rows of a group as an array of structs, in order."""
    return F.transform(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("x")))), lambda r: r["x"])


def _derived(methods: DataFrame, listed: DataFrame, on: list[str], name: str, derive: Callable[[Column], dict[str, Column]] | None) -> DataFrame:
    """The methods with the list of their key, an empty one where there is none, or with what is derived from it: that is worked out once for each key, so no list is copied to the methods."""
    derive = derive or (lambda c: {name: c})
    made = listed.select(*on, *[v.alias(f"__{k}") for k, v in derive(F.col(name)).items()])
    none = derive(F.array().cast(listed.schema[name].dataType))
    return methods.join(made.withColumn("__found", F.lit(True)), on, "left").select(*methods.columns, *[F.when(F.col("__found"), F.col(f"__{k}")).otherwise(v).alias(k) for k, v in none.items()])


def covering_tests(methods: DataFrame, coverage: DataFrame, slashes: bool = True, derive: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """The methods with `tests`, those (test, pattern) of their module that cover them and expect no exception, in order.

    methods: id, project, module, mut_key; coverage: project, module, test, pattern, methods (array). Keys are compared
    with slashes throughout, or, with slashes false, the coverage's keys are dotted and compared with mut_key as it stands, which
    misses methods whose descriptor has slashes. A method without tests keeps an empty array. With derive (from `tests` to columns by name)
    methods get these columns in place of `tests`.
    """
    form = slashed if slashes else dotted
    each = coverage.filter(F.col("pattern").isNull()).select("project", "module", "test", F.explode(F.array_distinct("methods")).alias("m"))
    found = each.groupBy("project", "module", form(F.col("m")).alias("key")).agg(F.array_sort(F.collect_list("test")).alias("tests"))
    keyed = methods.withColumn("key", slashed(F.col("mut_key")) if slashes else F.col("mut_key"))
    return _derived(keyed, found, ["project", "module", "key"], "tests", derive).drop("key")


def tool_tests(methods: DataFrame, entries: DataFrame) -> DataFrame:
    """The methods with `tests`, the tools' tests (etest_method, rel_path) of their project, class and method, each once, the first by pos.

    entries: project, mut_key, etest_method, rel_path, pos. Entries without a file or without a method in their key don't count.
    """
    good = entries.filter((F.col("rel_path") != "") & (F.size(F.split("mut_key", "#")) > 1))
    keys = {"class": class_of(F.col("mut_key")), "method": method_of(F.col("mut_key"))}
    first = good.select("project", *[v.alias(k) for k, v in keys.items()], "etest_method", "rel_path", "pos").groupBy("project", "class", "method", "etest_method").agg(F.min(F.struct("pos", "rel_path")).alias("x"))
    listed = first.select("project", "class", "method", "etest_method", "x.*").groupBy("project", "class", "method").agg(_listed(["pos"], "etest_method", "rel_path").alias("tests"))
    joined = methods.withColumns(keys).join(listed, ["project", "class", "method"], "left")
    return joined.select(*methods.columns, F.coalesce("tests", F.array().cast(listed.schema["tests"].dataType)).alias("tests"))


def sampled(rows: DataFrame, group: list[str], id: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each group, in the order of a hash of the id, which is the same in every run."""
    w = Window.partitionBy(*group).orderBy(F.xxhash64(F.lit(seed), id), id)
    return rows.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r")


def tests_or_others(methods: DataFrame, tests: DataFrame, n: int = 5) -> DataFrame:
    """(id, source, tests): the tests that cover a method, else those of its own test's class, else n drawn from its module.

    methods: id, project, module, mut_key, test_class; tests: project, module, test, class, pattern, mut (null if unknown). Tests that expect an
    exception don't count; a covering set that has only such tests counts as none. source is mut, class, module or none.
    """
    plain = tests.filter(F.col("pattern").isNull())
    at = ["project", "module"]
    listed = F.array_sort(F.collect_set("test"))
    by_mut = plain.filter(F.col("mut").isNotNull()).groupBy(*at, F.col("mut").alias("mut_key")).agg(listed.alias("a"))
    by_class = plain.groupBy(*at, F.col("class").alias("test_class")).agg(listed.alias("b"))
    by_module = sampled(plain, at, "test", n).groupBy(*at).agg(listed.alias("c"))
    # A module whose tests are known to cover nothing at all goes straight to the drawn ones.
    known = tests.groupBy(*at).agg(F.bool_or(F.col("mut").isNotNull()).alias("known"))
    covered = tests.filter(F.col("mut").isNotNull()).select(*at, F.col("mut").alias("mut_key")).distinct().withColumn("covered", F.lit(True))
    joined = methods
    for more, on in ((by_mut, [*at, "mut_key"]), (covered, [*at, "mut_key"]), (by_class, [*at, "test_class"]), (by_module, at), (known, at)):
        joined = joined.join(more, on, "left")
    in_class = F.col("covered").isNull() & F.coalesce("known", F.lit(False)) & F.col("b").isNotNull()
    source = F.when(F.col("a").isNotNull(), "mut").when(in_class, "class").when(F.col("c").isNotNull(), "module").otherwise("none")
    found = F.when(F.col("a").isNotNull(), F.col("a")).when(in_class, F.col("b")).otherwise(F.coalesce("c", F.array().cast(by_module.schema["c"].dataType)))
    return joined.select("id", source.alias("source"), found.alias("tests"))


def test_context(methods: DataFrame, tests: DataFrame) -> DataFrame:
    """The methods with the context and first test of their class's test class, by its name: ClassTest, else that of the outer class.

    methods: id, project, module, mut_key; tests: project, module, class, context, test, pos. No such class: nulls.
    """
    first = tests.groupBy("project", "module", F.col("class").alias("test_class")).agg(F.max_by("context", "pos").alias("context"), F.min_by("test", "pos").alias("first_test"))
    out = methods
    for side, name in (("x", class_of(F.col("mut_key"))), ("y", outer_class_of(F.col("mut_key")))):
        named = first.select("project", "module", F.col("test_class").alias(f"key_{side}"), F.struct("test_class", "context", "first_test").alias(side))
        out = out.withColumn(f"key_{side}", F.concat(name, F.lit("Test"))).join(named, ["project", "module", f"key_{side}"], "left")
    return out.withColumn("found", F.coalesce("x", "y")).select(*methods.columns, "found.test_class", "found.context", "found.first_test")


def call_suffixes(methods: DataFrame, traces: DataFrame, derive: Callable[[Column], dict[str, Column]] | None = None) -> DataFrame:
    """The methods with `stack_traces`: of each call stack of their project and exception, the part from where they are called, each once.

    methods: id, project, etype, mut_key; traces: project, etype, call_stack (array of keys). Methods of projects without traces are left out.
    Stacks are looked up by each frame, so no method is compared with a stack that lacks it. With derive (from `stack_traces` to columns by name)
    methods get these columns in place of `stack_traces`.
    """
    frames = traces.select("project", "etype", "call_stack", F.posexplode("call_stack").alias("at", "frame"))
    suffixes = frames.select("project", "etype", slashed(F.col("frame")).alias("mut_key"), F.slice("call_stack", F.col("at") + 1, F.size("call_stack") - F.col("at")).alias("part"))
    listed = suffixes.distinct().groupBy("project", "etype", "mut_key").agg(F.array_sort(F.collect_list("part")).alias("stack_traces"))
    kept = methods.join(traces.select("project").distinct(), "project", "left_semi")
    return _derived(kept, listed, ["project", "etype", "mut_key"], "stack_traces", derive)


def throws_clause(tests: DataFrame, clauses: DataFrame) -> DataFrame:
    """The tests (test, mut, exception) with `clause`, that of their method and exception, one without a condition first; null if there is none.

    clauses: clause, method, exception, has_condition.
    """
    best = clauses.groupBy(F.col("method").alias("mut"), "exception").agg(F.min_by("clause", F.struct("has_condition", "clause")).alias("clause"))
    return tests.join(best, ["mut", "exception"], "left")


def ne_e_pairs(normal: DataFrame, exceptional: DataFrame) -> DataFrame:
    """(mut, ne, e): every normal test of a method with every exceptional one of it, each pair once; both tables have mut and test."""
    return normal.select("mut", F.col("test").alias("ne")).distinct().join(exceptional.select("mut", F.col("test").alias("e")).distinct(), "mut")


def first_possible_trace(methods: DataFrame, traces: DataFrame, throw_lines: DataFrame) -> DataFrame:
    """The methods with `frames` and `line`, their first possible trace: their own throw of the exception, else the first logged one that reaches it.

    methods: id, project, module, mut_key, etype; traces: project, module, pos, etypes (array of class names), frames (array of keys); throw_lines:
    method, etype, line. A logged trace counts from the method on and ends at its last frame's throw lines. None: nulls.
    """
    lines = throw_lines.groupBy(F.col("method").alias("last"), "etype").agg(F.min("line").alias("line"))
    own = lines.select(F.col("last").alias("mut_key"), "etype", F.struct(F.array("last").alias("frames"), "line").alias("own"))
    each = traces.select("project", "module", "pos", F.explode(F.array_distinct("etypes")).alias("etype"), "frames").withColumn("last", F.element_at("frames", -1))
    frames = each.join(lines, ["last", "etype"]).select("project", "module", "pos", "etype", "frames", "line", F.posexplode("frames").alias("at", "mut_key"))
    # The first trace of each key is found before methods meet it: a key may have very many of both. Its place is found first, so that traces aren't sorted.
    on = ["project", "module", "mut_key", "etype"]
    least = frames.groupBy(*on).agg(F.min("pos").alias("pos"))
    logged = frames.join(least, [*on, "pos"]).groupBy(*on).agg(F.min_by(F.struct("frames", "at", "line"), "at").alias("x"))
    part = F.slice("x.frames", F.col("x.at") + 1, F.size("x.frames") - F.col("x.at"))
    logged = logged.select(*on, F.struct(part.alias("frames"), F.col("x.line").alias("line")).alias("logged"))
    found = methods.join(own, ["mut_key", "etype"], "left").join(logged, on, "left").withColumn("x", F.coalesce("own", "logged"))
    return found.select(*methods.columns, "x.frames", "x.line")


def paired(a: DataFrame, b: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, a, b): the values of two runs for the ids of a data set that both have."""
    return a.select("id", F.col("value").alias("a")).join(b.select("id", F.col("value").alias("b")), "id").join(ids.select("id"), "id", "left_semi")


def refreshed(tests: DataFrame, scanned: DataFrame) -> DataFrame:
    """The tests (test_key, exception, pattern, code) with the pattern and code of a new scan, where it has them; a key that it has twice is an error."""
    checked = scanned.groupBy("test_key", "exception").agg(F.count("*").alias("n"), F.first(F.struct("pattern", "code")).alias("x"))
    new = checked.select("test_key", "exception", F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("scanned twice: "), F.col("test_key")))).otherwise(F.lit("")).alias("ok"), "x")
    joined = tests.join(new, ["test_key", "exception"], "left").filter(F.coalesce("ok", F.lit("")) == "")
    return joined.select(*[F.coalesce(f"x.{c}", c).alias(c) if c in ("pattern", "code") else F.col(c) for c in tests.columns])


def stack_availability(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows with a stack trace, the rest): one with traces, or one whose only call is the method itself (namedesc as in mut_key after the class)."""
    desc = F.regexp_extract("mut_key", r"^[^#]*#(.*)$", 1)
    has = (F.size("stack_traces") > 0) | ((F.size("call_stacks") == 1) & (F.get("call_stacks", F.lit(0)) == desc))
    has = F.coalesce(has, F.lit(False))
    return rows.filter(has), rows.filter(~has)


def shortest(rows: DataFrame, group: list[str], length: Column, order: str, n: int) -> DataFrame:
    """The n shortest rows of each group; of equal lengths, the first in order."""
    w = Window.partitionBy(*group).orderBy("__length", order)
    return rows.withColumn("__length", length).withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n).drop("__r", "__length")
