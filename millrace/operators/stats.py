"""Tallies and statistics of data sets, as long tables (name, value), and metrics of runs as (metric, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Markers of removed throws, and how many tests of tools count for a method.
THROW_MARK = r"!\[(\w+-throw)\]!"
TOOL_CAP = 400


def throw_tally(logs: DataFrame, out: str = "out") -> DataFrame:
    """(kind, n): in how many logs each kind of marker occurs, and their sum as total-throw."""
    kinds = F.array_distinct(F.regexp_extract_all(out, F.lit(THROW_MARK), F.lit(1)))
    each = logs.select(F.explode(kinds).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return each.unionByName(each.agg(F.lit("total-throw").alias("kind"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")))


def failure_tally(failures: DataFrame) -> DataFrame:
    """(kind, n) of records (failure, error_message): each failure, all of them, those with an unreported exception, and the rest."""
    kind = F.replace(F.col("failure"), F.lit(" "), F.lit("-"))
    each = failures.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
    unreported = F.coalesce(F.contains("error_message", F.lit("unreported exception")), F.lit(False))
    totals = failures.agg(F.count("*").alias("all"), F.count_if(unreported).alias("unreported"))
    named = {"total-rm-comp-fail": F.col("all"), "unreported-exception": F.col("unreported"), "missing-return-only": F.col("all") - F.col("unreported")}
    return each.unionByName(totals.select(F.inline(F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("n")) for k, v in named.items()]))))


def long_metrics(rows: DataFrame, metrics: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """(keep, metric, value): one row for each metric of each row; null values are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("metric"), v.cast("double").alias("value")) for k, v in metrics.items()])
    return rows.select(*(keep or []), F.inline(pairs)).filter(F.col("value").isNotNull())


def aggregated(metrics: DataFrame, order: str) -> DataFrame:
    """(metric, values): the values of each metric in the order given.

    A value is an array: of a first one that is a list, the list itself is the first element; lists that follow are
    appended. Rows are (order, metric, value, values), one of value and values set; values is then an array of arrays.
    """
    first = F.min_by(F.struct("value", "values"), order)
    items = F.array_sort(F.collect_list(F.struct(order, "value", "values")))
    grouped = metrics.groupBy("metric").agg(first.alias("first"), items.alias("items"))
    one = F.array(F.coalesce(F.col("first.values"), F.array("first.value")))
    more = F.flatten(F.transform(F.slice("items", 2, F.size("items")), lambda x: F.when(x["values"].isNull(), F.array(F.array(x["value"]))).otherwise(F.transform(x["values"], lambda v: F.array(v)))))
    return grouped.select("metric", F.concat(one, more).alias("values"))


def metric_means(metrics: DataFrame) -> DataFrame:
    """(metric, mean) of rows (metric, value), without the metrics that are lists of samples."""
    return metrics.filter(~F.contains("metric", F.lit("topk"))).groupBy("metric").agg(F.avg("value").alias("mean"))


def merged(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two tables (metric, values) as one; lists of one metric are put together, a metric without a list in both is an error."""
    right = b.select(F.col("metric").alias("of"), F.col("values").alias("more"))
    joined = a.join(right, F.col("metric") == F.col("of"), "full")
    both = F.when(F.col("values").isNull() | F.col("more").isNull(), F.raise_error(F.lit("only lists can be put together"))).otherwise(F.concat("values", "more"))
    values = F.when(F.col("of").isNull(), F.col("values")).when(F.col("metric").isNull(), F.col("more")).otherwise(both)
    return joined.select(F.coalesce("metric", "of").alias("metric"), values.alias("values"))


def distinct_count(items: Column) -> Column:
    """An aggregate: how many different items there are; of arrays, explode them first."""
    return F.count_distinct(items).cast("double")


def spread(name: str, value: Column, *wanted: str) -> dict[str, Column]:
    """Aggregates of one number for each row: avg, sum, percentile, non-zero-avg and larger-than-20, as names tell."""
    known = {
        "avg": {"avg": F.avg(value)},
        "sum": {"sum": F.sum(value).cast("double")},
        "percentile": {f"p{25 * i}": F.percentile(value, F.lit(i / 4)) for i in range(5)},
        "non-zero-avg": {"non-zero-avg": F.avg(F.when(value > 0, value))},
        "larger-than-20": {"larger-than-20": 100.0 * F.count_if(value > 20) / F.count(value)},
    }
    return {f"{name}-{k}": v for w in wanted for k, v in known[w].items()}


def tool_counts(first: Column, second: Column, cap: int = TOOL_CAP) -> tuple[Column, Column]:
    """How many of two tools' tests count under one cap, the first tool's before the second's."""
    a = F.least(first, F.lit(cap))
    return a, F.least(second, F.lit(cap) - a)


def dataset_bundle(rows: DataFrame) -> DataFrame:
    """(name, value): all numbers of a data set in one pass, and one for the exception types.

    rows: mut_key, project, mut, exceptions (array; null ones don't count), only_throw, empty_no_throw, randoop, evosuite.
    """
    throws = F.regexp_count("mut", F.lit("throw ")).cast("double")
    lines = F.size(F.split("mut", "\n", -1)).cast("double")
    tests = F.size("exceptions").cast("double")
    randoop, evosuite = (x.cast("double") for x in tool_counts(F.col("randoop"), F.col("evosuite")))
    aggs = {
        "num-class": distinct_count(F.split_part("mut_key", F.lit("#"), F.lit(1))),
        "num-methods": distinct_count(F.col("mut_key")),
        "num-projects": distinct_count(F.col("project")),
        "only-throw-mut": F.count_if("only_throw").cast("double"),
        "empty-no-throw": F.count_if("empty_no_throw").cast("double"),
        **spread("throw-statements", throws, "avg", "sum", "percentile"),
        **spread("method-lines", lines, "avg", "percentile", "larger-than-20"),
        **spread("etest", tests, "avg", "percentile", "sum"),
        **spread("randoop-tests", randoop, "avg", "sum", "percentile"),
        **spread("evosuite-tests", evosuite, "avg", "sum", "percentile"),
        **spread("tool-tests", randoop + evosuite, "sum", "avg"),
    }
    one = rows.agg(*[v.alias(k) for k, v in aggs.items()])
    long = one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(f"`{k}`").alias("value")) for k in aggs])))
    types = rows.select(F.explode("exceptions").alias("e")).agg(F.lit("exception-type").alias("name"), distinct_count(F.col("e")).alias("value"))
    return long.unionByName(types)


def reasons(rows: DataFrame, conditions: list[tuple[str, Column]], kept: str = "kept") -> tuple[DataFrame, DataFrame]:
    """(rows that no condition rejects, (reason, n)): the first condition that holds is a row's reason."""
    reason = F.lit(None).cast("string")
    for name, condition in reversed(conditions):
        reason = F.when(F.coalesce(condition, F.lit(False)), F.lit(name)).otherwise(reason)
    named = rows.withColumn("reason", reason)
    return named.filter("reason IS NULL").drop("reason"), named.groupBy(F.coalesce("reason", F.lit(kept)).alias("reason")).agg(F.count("*").alias("n"))
