"""Results of runs: zipped combination, padding, subsets, unions and summaries.

A result table has a row for each task id and an array `result` with a struct for each sample.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def test_summary(tests: Column) -> Column:
    """compiled, pass_ratio and all_pass of an array of structs with compiled and passed; no tests pass none."""
    n, passed = F.size(tests), F.size(F.filter(tests, lambda t: t["passed"]))
    ratio = F.when(n > 0, passed / n).otherwise(F.lit(0.0))
    return F.struct(F.exists(tests, lambda t: t["compiled"]).cast("int").alias("compiled"), ratio.alias("pass_ratio"), ((n > 0) & (passed == n)).cast("int").alias("all_pass"))


def merge_tests(a: Column, b: Column, guarded: bool = True) -> Column:
    """A sample (success, tests) with the tests of another added, as (summary, success, tests); one that failed to build keeps its own.

    Without tests the ratio is 0 and nothing passes if guarded, as for tests of tools; else that is an error, as it is for tests of one kind.
    """
    tests = F.concat(a["tests"], F.coalesce(b["tests"], F.slice(a["tests"], 1, 0)))
    n, passed = F.size(tests), F.size(F.filter(tests, lambda t: t["passed"]))
    empty = F.lit(0.0) if guarded else F.raise_error(F.lit("a sample without tests")).cast("double")
    summary = F.struct(F.lit(1).alias("compiled"), F.when(n > 0, passed / n).otherwise(empty).alias("pass_ratio"), (passed == n).cast("int").alias("all_pass"))
    return F.when(a["success"], F.struct(summary.alias("summary"), a["success"].alias("success"), tests.alias("tests"))).otherwise(a)


def combined_means(rows: DataFrame, count_failed: bool) -> DataFrame:
    """(metric, mean): the means over tasks of the max, min and mean over each task's samples.

    A sample that failed to build counts only if count_failed is set, as it is when tests of tools are added; in a task whose
    results nothing was added to (`matched` false), all count. A task without any counted sample has no values.
    """
    counted = F.filter("result", lambda r: F.lit(count_failed) | ~F.col("matched") | r["success"])
    out = []
    for metric in ("compiled", "pass_ratio", "all_pass"):
        values = F.transform(counted, _field(metric))
        top = topk_summary(values)
        out += [F.struct(F.lit(f"{metric}-{k}").alias("metric"), top[k].alias("value")) for k in ("max", "min", "avg")]
    return rows.select(F.inline(F.array(*out))).filter("value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("mean"))


def _field(name: str):
    return lambda r: r["summary"][name].cast("double")


def predictions_by_id(data: DataFrame, predictions: DataFrame) -> DataFrame:
    """(id, predictions): predictions (pos, prediction) put with the rows of data (pos, id) of their places, listed for each id in that order."""
    pairs = data.select("pos", "id").join(predictions.select("pos", "prediction"), "pos")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("pos", "prediction"))), lambda x: x["prediction"])
    return pairs.groupBy("id").agg(listed.alias("predictions"))


def with_cache(tasks: DataFrame, cache: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks with `result` and `hit`: the cached result if there is one, else the new one, null if it hasn't run."""
    joined = tasks.join(cache.select(*keys, F.struct(F.col("result").alias("r")).alias("__old")), keys, "left").join(new.select(*keys, F.col("result").alias("__new")), keys, "left")
    hit = F.col("__old").isNotNull()
    return joined.select(*tasks.columns, F.when(hit, F.col("__old.r")).otherwise(F.col("__new")).alias("result"), hit.alias("hit"))


def combine(left: DataFrame, right: DataFrame, combined, strict: bool = True) -> DataFrame:
    """The left results, each sample combined(left, right) with the right one of its place.

    An id that right lacks keeps its results. Samples must be as many on both sides, else it is an error.
    """
    joined = left.withColumnRenamed("result", "__a").join(right.select("id", F.col("result").alias("__b")), "id", "left")
    zipped = F.zip_with("__a", "__b", combined)
    if strict:
        zipped = F.when(F.size("__a") == F.size("__b"), zipped).otherwise(F.raise_error(F.lit("results of different lengths")).cast(left.schema["result"].dataType))
    return joined.withColumn("result", F.when(F.col("__b").isNull(), F.col("__a")).otherwise(zipped)).drop("__a", "__b")


def pad_missing(ids: DataFrame, rows: DataFrame, failed: Column, n: int | None = None) -> DataFrame:
    """A row for each id; ids without results get as many failed samples as the others have, which must agree."""
    if n is None:
        sizes = rows.agg(F.min(F.size("result")).alias("a"), F.max(F.size("result")).alias("b")).first()
        if sizes["a"] != sizes["b"]:
            raise ValueError(f"tasks have {sizes['a']} to {sizes['b']} samples")
        n = sizes["a"] or 0
    return ids.select("id").join(rows, "id", "left").withColumn("result", F.coalesce("result", F.array_repeat(failed, n)))


def subset(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose id is listed."""
    return rows.join(ids.select("id"), "id", "left_semi")


def separate(a: DataFrame, b: DataFrame) -> DataFrame:
    """The rows of a whose id b lacks."""
    return a.join(b.select("id"), "id", "left_anti")


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union; an id of both has b's row twice."""
    twice = b.join(a.select("id"), "id", "left_semi")
    return separate(a, b).unionByName(b).unionByName(twice)


def first_wins(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """The union of two sources; of a key in both, a's row."""
    return a.unionByName(b.join(a.select(key), key, "left_anti"))


def rich_summary(rows: DataFrame, group: list[str], value: str) -> DataFrame:
    """avg, sum, max, min, median, population deviation, least mode and count of a value for each group; without values all but the count are null."""
    v = F.col(value)
    return rows.groupBy(*group).agg(
        F.avg(v).alias("avg"),
        F.sum(v).alias("sum"),
        F.max(v).alias("max"),
        F.min(v).alias("min"),
        F.median(v).alias("median"),
        F.stddev_pop(v).alias("stdev"),
        F.mode(v, True).alias("mode"),
        F.count(v).alias("cnt"),
    )


def topk_summary(values: Column) -> Column:
    """max, min and mean over a task's samples."""
    total = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)
    return F.struct(F.array_max(values).alias("max"), F.array_min(values).alias("min"), F.when(F.size(values) > 0, total / F.size(values)).alias("avg"))


def work_list(tasks: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """The tasks that no cached result answers."""
    return tasks.join(cache.select(*keys), keys, "left_anti")


def completed(parts: DataFrame, expected: DataFrame) -> DataFrame:
    """(id, results): the results of tasks all of whose parts (id, idx, results) are there, in the order of idx.

    A part that repeats counts once; of different results for one part the least stands.
    """
    first = parts.groupBy("id", "idx").agg(F.min("results").alias("results"))
    done = first.groupBy("id").agg(F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "results"))), lambda x: x["results"])).alias("results"))
    return done.join(expected.select("id", "expected"), "id").filter("n = expected").select("id", "results")


def upserted(edits: DataFrame, key: list[str], order: list[str], deleted: Column) -> DataFrame:
    """The last edit of each key by order, without keys whose last edit deletes; created is the first edit's place."""
    last = edits.withColumn("__gone", deleted).groupBy(*key).agg(F.max_by(F.struct(*[c for c in edits.columns if c not in key], "__gone"), F.struct(*order)).alias("x"), F.min(order[0]).alias("created"))
    return last.filter(~F.col("x.__gone")).select(*key, "x.*", "created").drop("__gone")
