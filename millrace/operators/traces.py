"""Trace logs: depth@@logged#method@@class#method#line##class#method#line, and frames to methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frames of the logger itself, and the frame of the test.
LOGGER = ("java.lang.Thread#getStackTrace", "org.etestgen.rt.LogHelper#log")
TEST = "adhoc_test"


def frames(line: Column) -> Column:
    """The frames of a log line up to the test's, the logger's left out; null if the test's frame is missing."""
    parsed = F.transform(F.split(F.split_part(line, F.lit("@@"), F.lit(3)), "##"), lambda f: F.split(f, "#"))
    each = F.transform(F.filter(parsed, lambda p: F.size(p) == 3), lambda p: F.struct(p[0].alias("class"), p[1].alias("method"), p[2].cast("int").alias("line")))
    own = F.filter(each, lambda f: ~F.concat_ws("#", f["class"], f["method"]).isin(*LOGGER))
    at = F.array_position(F.transform(own, lambda f: f["method"]), F.lit(TEST))
    return F.when(at > 0, F.slice(own, F.lit(1), (at - 1).cast("int")))


def parse(lines: DataFrame) -> DataFrame:
    """depth, logged and frames of log lines that hold the test's frame."""
    out = lines.select("*", F.split_part("line", F.lit("@@"), F.lit(1)).cast("int").alias("depth"), F.split_part("line", F.lit("@@"), F.lit(2)).alias("logged"), frames(F.col("line")).alias("frames"))
    return out.filter(F.col("frames").isNotNull())


def shallowest(traces: DataFrame, key: list[str], order: str) -> DataFrame:
    """The trace of least depth of each key, the last on ties."""
    w = Window.partitionBy(*key).orderBy("depth", F.desc(order))
    return traces.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def resolve(rows: DataFrame, methods: DataFrame, key: list[str]) -> DataFrame:
    """Each frame (class, method, line) with its method record; of overloads, the first whose lines hold the frame's.

    A name with one record is that record, whatever its lines. The equal names deal the work out; lines are a residual. An overload is taken for the lines
    after the last end of those before it only, so a frame meets one record, however many overloads hold its line.
    """
    name = Window.partitionBy("class", "method")
    before = name.orderBy("start_line", "end_line").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.max(F.when(F.col("start_line").isNotNull(), F.col("end_line"))).over(before)
    own = methods.withColumn("__ended", ended).withColumn("__n", F.count("*").over(name)).filter("__n = 1 OR __ended IS NULL OR __ended < end_line")
    holds = F.col("line").between(F.col("start_line"), F.col("end_line")) & (F.col("__ended").isNull() | (F.col("line") > F.col("__ended")))
    joined = rows.join(own, ["class", "method"]).filter((F.col("__n") == 1) | holds)
    w = Window.partitionBy(*key).orderBy("start_line", "end_line")
    return joined.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r", "__n", "__ended")


def directly_called(traces: DataFrame) -> DataFrame:
    """(test, methods): all methods logged at the least depth, each once, sorted; frames of test classes don't count towards the depth.

    traces: test, logged, frames (array of class names). A trace of test frames only is left out.
    """
    depth = F.size(F.filter("frames", lambda f: ~f.contains("adhoc_")))
    rows = traces.withColumn("depth", depth).filter("depth > 0")
    least = F.min("depth").over(Window.partitionBy("test"))
    return rows.withColumn("least", least).filter("depth = least").groupBy("test").agg(F.array_sort(F.collect_set("logged")).alias("methods"))


def cleaned(frames: Column) -> Column:
    """Frames (method, line) without those whose line is negative and whose method is the next frame's too."""
    following = F.transform(frames, lambda f, i: F.get(frames, i + 1)["method"])
    zipped = F.zip_with(frames, following, lambda f, n: F.struct(f.alias("f"), n.alias("n")))
    return F.transform(F.filter(zipped, lambda z: ~((z["f"]["line"] < 0) & F.coalesce(z["n"] == z["f"]["method"], F.lit(False)))), lambda z: z["f"])


def running_values(deltas: DataFrame, key: list[str], order: str) -> DataFrame:
    """(key, order, values): all variables at each statement, from deltas (map) of the changed ones; the last value of a name stands, a null one too.

    Each statement meets each name of its key once, and a name's last value is carried on in the order of statements: what is written follows the result's own
    size, statements times names, not the square of the statements.
    """
    in_order = Window.partitionBy(*key).orderBy(order)
    each = deltas.select(*key, F.col(order).alias("__at"), "delta", F.row_number().over(in_order).alias("__seq"))
    names = each.select(*[F.col(k).alias(f"__{k}") for k in key], F.explode(F.map_keys("delta")).alias("n")).groupBy(*[f"__{k}" for k in key]).agg(F.collect_set("n").alias("__names"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in key]
    held = each.join(names, same, "left").select(*key, "__at", "__seq", "delta", F.explode_outer("__names").alias("__name"))
    upto = Window.partitionBy(*key, "__name").orderBy("__seq").rowsBetween(Window.unboundedPreceding, 0)
    value = F.last(F.when(F.map_contains_key("delta", F.col("__name")), F.struct(F.col("delta")[F.col("__name")].alias("v"))), ignorenulls=True).over(upto)
    entry = F.when(F.col("__value").isNotNull(), F.struct("__name", F.col("__value.v")))
    found = held.withColumn("__value", value).groupBy(*key, "__seq").agg(F.first("__at").alias(order), F.map_from_entries(F.collect_list(entry)).alias("values"))
    return found.select(*key, order, "values")


def last_called(statements: DataFrame, key: list[str], order: str) -> DataFrame:
    """The statements with `last_called`, the last method called up to each of them; a statement that calls none has null in `called`."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return statements.withColumn("last_called", F.last("called", ignorenulls=True).over(w))
