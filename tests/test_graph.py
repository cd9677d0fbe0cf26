"""Call paths and ancestors against brute force on small graphs."""

import random

import pyarrow.parquet as pq

from millrace.operators import graph
from millrace.queries import analysis


def brute_paths(edges, starts, depth):
    inner, out = {s for s, _, k in edges if k == "C"}, set()

    def walk(path):
        if path[-1] not in inner or len(path) == depth:
            out.add((path[0], tuple(path)))
        if len(path) == depth:
            return
        nexts = {d for s, d, k in edges if k == "C" and s == path[-1]}
        if len(path) > 1:
            nexts |= {s for s, d, k in edges if k == "O" and d == path[-1]}
        for x in nexts - set(path):
            walk([*path, x])

    for s in starts:
        walk([s])
    return out | {(s, (s,)) for s in starts if s not in {p[0] for p in out}}


def test_call_paths_with_overriders_and_cycles(spark):
    random.seed(8)
    edges = {(random.randint(1, 9), random.randint(1, 12), random.choice("CCO")) for _ in range(20)} | {(1, 2, "C"), (2, 1, "C"), (11, 2, "O")}
    chain = {(i, i + 1, "C") for i in range(100, 114)}
    df = spark.createDataFrame(sorted(edges | chain), "src long, dst long, label string")
    starts = [*range(1, 14), 100]
    for depth in (4, None):
        got = [(r.start, tuple(r.path)) for r in graph.call_paths(df, spark.createDataFrame([(s,) for s in starts], "id long"), depth).collect()]
        assert len(got) == len(set(got)) and set(got) == brute_paths(edges | chain, starts, depth)


def test_ancestors_of_deep_chains_and_cycles(spark):
    parents = spark.createDataFrame([(i, i - 1 if i > 1 else None) for i in range(1, 61)] + [(101, 102), (102, 101)], "node long, parent long")
    got = [(r.node, r.ancestor, r.distance) for r in graph.ancestors(parents).filter("node IN (60, 101)").collect()]
    assert sorted(got) == [(60, 60 - d, d) for d in range(59, -1, -1)] + [(101, 101, 0), (101, 102, 1)]


def test_call_paths_lineitem_is_whole(spark):
    d = "/root/testdata/sf0.001"
    pairs = {(s, p) for s, p in zip(*[pq.read_table(f"{d}/lineitem.parquet")[c].to_pylist() for c in ("l_suppkey", "l_partkey")])}
    parts = set(pq.read_table(f"{d}/part.parquet")["p_partkey"].to_pylist())
    suppliers = set(pq.read_table(f"{d}/supplier.parquet")["s_suppkey"].to_pylist())
    want = {f"{s},{-1 - p}" for s, p in pairs if s in suppliers} | {f"{s},{-1 - p},{-2 - p}" for s, p in pairs if s in suppliers and p % 2 == 0 and p + 1 in parts} | {str(s) for s in suppliers - {s for s, _ in pairs}}
    got = [r.path for r in analysis.call_paths_lineitem(spark, d).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_call_paths_come_once_each_without_being_compared(spark):
    """Repeated edges and starts, an edge of both kinds, a ring without a leaf and a start without a value; paths are in no aggregate's keys."""
    edges = spark.createDataFrame([(1, 2, "C"), (2, 1, "C"), (1, 2, "C"), (3, 4, "C"), (3, 4, "C"), (4, 3, "O"), (5, 4, "O"), (5, 4, "O")], "src long, dst long, label string")
    out = graph.call_paths(edges, spark.createDataFrame([(1,), (1,), (3,), (3,), (None,)], "id long"), None)
    got = [(r.start, tuple(r.path)) for r in out.collect()]
    assert sorted(got, key=str) == [(1, (1,)), (3, (3, 4)), (3, (3, 4, 5)), (None, (None,))]
    plan = out._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [line for line in plan if "Aggregate" in line and "path" in line]


def test_spread_follows_the_rows(spark):
    df = graph.stored(spark.range(1000))
    assert graph.spread(df, "id", rows=10).rdd.getNumPartitions() == 100 and graph.spread(df, "id", rows=500) is df
