"""Scans over an order: prefix sums with sparse keys, and running state in a long key."""

import itertools
import random

from pyspark.sql import functions as F

from millrace.operators import funnel, traces


def test_prefix_sums_over_any_order(spark):
    r = random.Random(1)
    for keys, kind in (([10**12 * k + r.randrange(9) for k in range(2000)], "long"), ([k / 7 - 100 for k in range(500)], "double"), ([f"{k:x}" for k in r.sample(range(10**9), 800)], "string"), ([], "long"), ([None, 3, 1], "long")):
        rows = [(k, r.randrange(-5, 9)) for k in keys]
        shuffled = r.sample(rows, len(rows))
        df = spark.createDataFrame(shuffled, f"k {kind}, v long")
        order = sorted(rows, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0))
        want = dict(zip([k for k, _ in order], itertools.accumulate(v for _, v in order), strict=True))
        assert {x.k: x.s for x in funnel.running(df, "k", "v", "s", 7).collect()} == want
        assert {x.k: x.number for x in funnel.numbered(df, "k").collect()} == {k: i for i, (k, _) in enumerate(order)}


def test_one_task_orders_ranges_only(spark):
    """Keys 10^12 apart: the window without a partition gets a row for each range."""
    df = spark.range(5000).select((F.col("id") * 10**12).alias("k"))
    out = funnel.running(df.withColumn("v", F.lit(1)), "k", "v", "s", 8)
    assert out.filter("s <> k / 1000000000000 + 1").isEmpty()
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Window [sum(__sum") == 1
    assert spark.createDataFrame(out.select("k", "s").limit(0).collect(), "k long, s long").isEmpty()


def test_running_state(spark):
    r = random.Random(2)
    rows = [(k, i, {r.choice("abc"): r.choice([None, r.randrange(9)]) for _ in range(r.randrange(0, 3))}) for k in ("x", "y", None) for i in range(60)] + [("none", 0, {})]
    got = traces.running_values(spark.createDataFrame(rows, "k string, i int, delta map<string,int>"), ["k"], "i")
    want, state = {}, {}
    for k, i, d in rows:
        state[k] = {**state.get(k, {}), **d}
        want[k, i] = state[k]
    assert {(x.k, x.i): x["values"] for x in got.collect()} == want


def test_running_state_of_a_long_key(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("one").alias("k"), "id", F.create_map(F.concat(F.lit("v"), (F.col("id") % 3).cast("string")), F.col("id")).alias("delta"))
    out = traces.running_values(rows, ["k"], "id")
    assert out.filter("id >= 3").filter(F.aggregate(F.map_values("values"), F.lit(0).cast("long"), lambda a, b: a + b) != 3 * F.col("id") - 3).isEmpty()
    assert out.count() == n


def test_frames_meet_one_overload_each(spark):
    """Random overloads, some without a line or turned round, against the rule; a frame in very many of them is one row before any is chosen."""
    r = random.Random(3)
    methods = sorted({("c", r.choice("mno"), r.randrange(40), r.randrange(45)) for _ in range(60)}) + [("c", "m", None, 30), ("c", "m", 3, None), ("c", "n", 5, 2**31 - 1), ("c", "one", 7, 8), ("c", "none", None, None)]
    rows = [(i, "c", r.choice(["m", "n", "o", "one", "none", "gone"]), r.choice([None, *range(50)])) for i in range(400)]
    want = {}
    for i, c, m, line in rows:
        own = [x for x in methods if x[:2] == (c, m)]
        held = own if len(own) == 1 else [x for x in own if None not in (line, *x) and x[2] <= line <= x[3]]
        want |= {i: min(held, key=lambda x: (x[2] or 0, x[3] or 0))[2:]} if held else {}
    frames = spark.createDataFrame(rows, "i int, class string, method string, line int")
    records = spark.createDataFrame(methods, "class string, method string, start_line int, end_line int")
    got = traces.resolve(frames, records, ["i"])
    assert got.columns == ["class", "method", "i", "line", "start_line", "end_line"]
    assert {x.i: (x.start_line, x.end_line) for x in got.collect()} == want
    deep = spark.range(50).selectExpr("'c' AS class", "'m' AS method", "int(id) AS start_line", "100 AS end_line")
    out = traces.resolve(spark.range(200).selectExpr("id AS i", "'c' AS class", "'m' AS method", "60 AS line"), deep, ["i"])
    out.collect()
    plan, joined = [out._jdf.queryExecution().executedPlan()], []
    while plan:
        node = plan.pop()
        below = [node.children().apply(k) for k in range(node.children().size())]
        below += [node.executedPlan()] if node.nodeName() == "AdaptiveSparkPlan" else [node.plan()] if "QueryStage" in node.nodeName() else []
        joined += [node.metrics().apply("numOutputRows").value()] if "Join" in node.nodeName() else []
        plan += below
    assert joined == [200]
