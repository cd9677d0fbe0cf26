"""Which declared throws tests cover, and reports on modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.lookups import throws_clause


def resolved(tests: DataFrame, clauses: DataFrame) -> DataFrame:
    """The tests with `clause` and `kind`: declared, undeclared (the method throws but doesn't say so) or no_mut.

    tests: test, mut (null or empty if none was traced), exception, throws (whether a throw was logged).
    """
    out = throws_clause(tests, clauses)
    kind = F.when(F.col("clause").isNotNull(), "declared").when(F.coalesce("throws", F.lit(False)), "undeclared").otherwise("no_mut")
    return out.withColumn("kind", kind)


def coverage_rate(found: DataFrame, clauses: DataFrame) -> DataFrame:
    """(covered, clauses, rate, types, undeclared_types): clauses that a test covers, of all, and the exception types; without a covered one the rate is 0."""
    one = found.agg(
        F.count_distinct("clause").alias("covered"),
        F.count_distinct(F.when(F.col("kind") == "declared", F.col("exception"))).alias("types"),
        F.count_distinct(F.when(F.col("kind") == "undeclared", F.col("exception"))).alias("undeclared_types"),
    )
    all_of = clauses.agg(F.count("*").alias("clauses"))
    rate = F.when(F.col("covered") > 0, F.col("covered") / F.col("clauses")).otherwise(0.0)
    return one.crossJoin(F.broadcast(all_of)).select("covered", "clauses", rate.alias("rate"), "types", "undeclared_types")


def clause_report(found: DataFrame, clauses: DataFrame, limit: int) -> DataFrame:
    """(clause, covered, n, tests, more): each clause with the number of its tests, the first ones by id, and how many are left out."""
    by = found.filter(F.col("clause").isNotNull()).groupBy("clause").agg(F.count_distinct("test").alias("n"), _first_items("test", limit).alias("tests"))
    out = clauses.select("clause").join(by, "clause", "left")
    n = F.coalesce("n", F.lit(0)).cast("long")
    return out.select("clause", (n > 0).alias("covered"), n.alias("n"), F.coalesce("tests", F.array().cast(by.schema["tests"].dataType)).alias("tests"), F.greatest(n - limit, F.lit(0)).cast("long").alias("more"))


def _first_items(column: str, limit: int) -> Column:
    return F.slice(F.array_sort(F.collect_set(column)), 1, limit)


def classified(rows: DataFrame) -> DataFrame:
    """The rows of exceptional tests with `coverage`: error, covered (declared methods were logged), unchecked (a log, but no such method) or no_coverage.

    rows: failed, declared_log (whether there is a log of declared throws), logged_methods (methods in it), throw_log (whether there is a log of throws).
    """
    kind = F.when(F.col("failed"), "error").when(F.col("declared_log") & (F.col("logged_methods") > 0), "covered")
    return rows.withColumn("coverage", kind.when(F.col("declared_log") | F.col("throw_log"), "unchecked").otherwise("no_coverage"))


def module_report(tests: DataFrame, most_errors: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """(reports, dropped): for each (project, module) the numbers of tests, exceptional tests and errors; dropped has modules where too many tests failed.

    tests: project, module, pattern (null for a normal test), failed. Only modules with exceptional tests are dropped.
    """
    each = tests.groupBy("project", "module").agg(F.count("*").alias("n_tests"), F.count("pattern").alias("n_etests"), F.count_if("failed").alias("n_errors"))
    bad = (F.col("n_etests") > 0) & (F.col("n_errors") / F.col("n_tests") > most_errors)
    return each.filter(~bad), each.filter(bad)


def project_report(modules: DataFrame) -> DataFrame:
    """(project, n_modules, n_tests, n_etests) of module reports."""
    return modules.groupBy("project").agg(F.count("*").alias("n_modules"), F.sum("n_tests").alias("n_tests"), F.sum("n_etests").alias("n_etests"))


def merged_stacks(rows: DataFrame) -> DataFrame:
    """One row for each (mut, etype, call stack): the first row's id, and the normal tests of all, each once, in order.

    rows: id, pos, mut, etype, call_stack (array), test_ne.
    """
    key = F.array_join("call_stack", "-")
    first_seen = rows.groupBy("mut", "etype", key.alias("stack"), "test_ne").agg(F.min(F.struct("pos", "id")).alias("first"))
    tests = F.transform(F.array_sort(F.collect_list(F.struct("first", "test_ne"))), lambda x: x["test_ne"])
    return first_seen.groupBy("mut", "etype", "stack").agg(F.min("first").alias("first"), tests.alias("tests")).select("first.id", "mut", "etype", "stack", "tests")


def shallowest_method(traces: DataFrame) -> DataFrame:
    """(test, mut): the method under test is the last logged one of least depth, frames of test classes aside.

    traces: test, pos, logged, frames (array of class names). A trace of test frames only doesn't count.
    """
    depth = F.size(F.filter("frames", lambda f: ~f.contains("adhoc_")))
    rows = traces.withColumn("depth", depth).filter("depth > 0")
    return rows.groupBy("test").agg(F.min_by("logged", F.struct("depth", -F.col("pos"))).alias("mut"))
