"""The filter funnel: a registry of predicates that toss rows, and what each stage leaves.

A row goes if any chosen filter tosses it. Predicates are Columns over the method table (ebts, throw_info, mut, project, pos)
and, where joined by with_results(), `gold` and `no_throw`, the arrays of dummy runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.text import is_one_throw
from millrace.operators.graph import stored

#: Exceptions that say nothing, and the number of projects kept.
GENERIC = ("java.lang.Exception", "java.lang.Throwable")
KEEP_PROJECTS = 161


def _only_user() -> Column:
    """No exception type starts with java; an empty map counts as such."""
    return F.forall(F.map_keys("throw_info"), lambda k: ~k.startswith("java"))


FILTERS: dict[str, Callable[[], Column]] = {
    "generic_exception": lambda: F.exists("ebts", lambda e: e["exception"].isin(*GENERIC)),
    "no_gold": lambda: F.col("gold").isNull() | ~F.forall("gold", lambda r: F.coalesce(r["summary"]["all_pass"] == 1, F.lit(False))),
    "auto_pass": lambda: F.col("no_throw").isNull() | F.coalesce(F.get("no_throw", F.lit(0))["summary"]["all_pass"] == 1, F.lit(False)),
    "one_throw": lambda: is_one_throw(F.col("mut")),
    "only_system_exception": _only_user,
    "only_user_exception": lambda: ~_only_user(),
    "single_ebt": lambda: F.size("ebts") == 1,
}


def tossed(names: list[str]) -> Column:
    """True where any of the named filters tosses the row; unknown names are ignored."""
    out = F.lit(False)
    for name, predicate in FILTERS.items():
        if name in names:
            out = out | predicate()
    return out


def apply_filters(rows: DataFrame, names: list[str]) -> DataFrame:
    return rows.filter(~tossed(names))


def with_results(rows: DataFrame, gold: DataFrame, no_throw: DataFrame) -> DataFrame:
    """The rows with the results of both dummy runs."""
    return rows.join(gold.select("id", F.col("result").alias("gold")), "id", "left").join(no_throw.select("id", F.col("result").alias("no_throw")), "id", "left")


def compile_failures(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows kept, failures): a sample that did not compile goes unless its output has a known message.

    failures has one row (id, kind) for each known message that a row has, kept or not.
    """
    known = {"missing_return": "missing return statement", "incompatible_types": "incompatible types"}
    has = {k: F.col("stdout").contains(v) for k, v in known.items()}
    kept = rows.filter((F.col("compiled") != 0) | has["missing_return"] | has["incompatible_types"])
    kinds = F.filter(F.array(*[F.when((F.col("compiled") == 0) & c, F.lit(k)) for k, c in has.items()]), lambda x: x.isNotNull())
    return kept, rows.select("id", F.explode(kinds).alias("kind"))


def first_projects(rows: DataFrame, held_out: DataFrame | None = None, keep: int = KEEP_PROJECTS) -> DataFrame:
    """The rows of the first projects in the order of pos; projects held out take a place, but are dropped."""
    seen = rows.groupBy("project").agg(F.min("pos").alias("first")).orderBy("first", "project").limit(keep)
    if held_out is not None:
        seen = seen.join(held_out.select("project"), "project", "left_anti")
    return rows.join(seen.select("project"), "project", "left_semi")


def direct_throws(records: DataFrame) -> DataFrame:
    """One row for each mut_key all of whose records have a trace of one frame: the first record's columns and all tests in order."""
    first = F.struct(*[c for c in records.columns if c not in ("mut_key", "test", "trace_len")])
    grouped = records.groupBy("mut_key").agg(F.min_by(first, "pos").alias("x"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "test"))), lambda t: t["test"]).alias("ebts"), F.max("trace_len").alias("longest"))
    return grouped.filter("longest <= 1").select("mut_key", "x.*", "ebts")


def funnel(rows: DataFrame, stages: list[tuple[str, Column]]) -> DataFrame:
    """(stage, name, n, pct): rows left after each stage in turn, and their percentage of the stage before."""
    left, aggs = F.lit(True), [F.count("*").alias("n0")]
    for i, (_, toss) in enumerate(stages, 1):
        left = left & ~toss
        aggs.append(F.count_if(left).alias(f"n{i}"))
    one = rows.agg(*aggs)
    table = F.array(*[F.struct(F.lit(i).alias("stage"), F.lit(name).alias("name"), F.col(f"n{i}").alias("n"), F.when(F.col(f"n{max(i - 1, 0)}") > 0, 100.0 * F.col(f"n{i}") / F.col(f"n{max(i - 1, 0)}")).alias("pct")) for i, (name, _) in enumerate([("all", None), *stages])])
    return one.select(F.inline(table))


def keep_first(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; the last is that of descending order."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def no_project(rows: DataFrame, projects: DataFrame) -> DataFrame:
    """The rows whose project is on the list."""
    return rows.join(projects.select("project"), "project", "left_semi")


def target_projects(rows: DataFrame, names: list[str] | None = None, skipped: list[str] | None = None) -> DataFrame:
    """The rows of the named projects, or of all, without those of the skipped ones."""
    out = rows if names is None else rows.filter(F.col("project").isin(names))
    return out if not skipped else out.filter(~F.col("project").isin(skipped))


def kept_modules(modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules that can be run, the others with `skipped`, the reason): packaging pom, no sources, or no exceptional test."""
    reason = F.when(F.col("packaging") == "pom", "pom").when(~F.coalesce("has_src", F.lit(False)), "no_src").when(F.coalesce("n_etests", F.lit(0)) == 0, "no_etest")
    named = modules.withColumn("skipped", reason)
    return named.filter("skipped IS NULL").drop("skipped"), named.filter("skipped IS NOT NULL")


def tests_of_kind(tests: DataFrame, exceptional: bool) -> DataFrame:
    """The tests that expect an exception (pattern is set), or those that don't."""
    return tests.filter(F.col("pattern").isNotNull() if exceptional else F.col("pattern").isNull())


def public_throwing(methods: DataFrame) -> DataFrame:
    """(project, module, mut_key, etype, line): a row for each exception of each public method; line counts from the method's start.

    methods: project, module, method, modifiers (array), exceptions (array of name@@line), start_line.
    """
    rows = methods.filter(F.array_contains("modifiers", "public")).select("project", "module", F.col("method").alias("mut_key"), "start_line", F.explode("exceptions").alias("e"))
    return rows.select("project", "module", "mut_key", F.split_part("e", F.lit("@@"), F.lit(1)).alias("etype"), (F.split_part("e", F.lit("@@"), F.lit(2)).cast("int") - F.col("start_line")).alias("line"))


def drop_failing_tests(rows: DataFrame, results: DataFrame, field: str) -> DataFrame:
    """The rows with the tests (structs with etest_method) of a field whose class didn't fail for that id; classes that never ran stay.

    results: id, fqcn, passed (null counts as failed).
    """
    bad = results.filter(~F.coalesce("passed", F.lit(False))).groupBy("id").agg(F.collect_set("fqcn").alias("__bad"))
    kept = F.filter(field, lambda t: ~F.array_contains("__bad", F.split_part(t["etest_method"], F.lit("#"), F.lit(1))))
    return rows.join(bad, "id", "left").withColumn(field, F.when(F.col("__bad").isNull(), F.col(field)).otherwise(kept)).drop("__bad")


def allowed(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is listed; one of them without a stack trace is an error when the result is read."""
    listed = rows.join(ids.select("id"), "id", "left_semi")
    ok = F.when(F.coalesce(F.size("stack_traces"), F.lit(0)) > 0, F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("no stack trace: "), F.col("id").cast("string"))).cast("boolean"))
    return listed.filter(ok)


def numbered(rows: DataFrame, order: str, name: str = "number", parts: int | None = None) -> DataFrame:
    """The rows with numbers from 0 in the order of a column, without a gap."""
    return running(rows.withColumn("__one", F.lit(1)), order, "__one", name, parts).withColumn(name, F.col(name) - 1).drop("__one")


def running(rows: DataFrame, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """The rows with the sum of a value up to and with each of them, in the order of a column of any sortable type; nulls come first, and equal ones in no certain order.

    Two passes: rows are dealt out by ranges of the column whose borders are drawn from the data, so sparse or clustered values fill them evenly, and written with their range;
    sums are taken inside each range, and those of the ranges before are added. All that is ordered in one task is one row for each range.
    """
    n = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    at = stored(rows.repartitionByRange(n, order).withColumn("__block", F.spark_partition_id()))
    before = F.coalesce(F.sum("__sum").over(Window.orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = at.groupBy("__block").agg(F.sum(value).alias("__sum")).select("__block", before.alias("__before"))
    inside = F.sum(value).over(Window.partitionBy("__block").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return at.withColumn("__inside", inside).join(starts, "__block").withColumn(name, F.col("__before") + F.col("__inside")).drop("__block", "__inside", "__before")


def within_budget(requests: DataFrame, order: str, cost: str, limit: float, parts: int | None = None) -> DataFrame:
    """The requests with `spent`, what was spent before them, and `sent`: once that has reached the limit, only filler is given out.

    A request that takes the sum over the limit is still sent.
    """
    out = running(requests, order, cost, "spent", parts).withColumn("spent", F.col("spent") - F.col(cost))
    return out.withColumn("sent", F.col("spent") < limit)


def head(rows: DataFrame, a: str, b: str, n: int) -> Column:
    """The first n items of two arrays, one after the other."""
    return F.slice(F.concat(a, b), 1, n)
