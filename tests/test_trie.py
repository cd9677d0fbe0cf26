"""Entries inside of sets and common beginnings, against brute force."""

import random

import pytest

from millrace.operators import graph

SCHEMA = "key array<string>, value int"


def random_entries(r, n):
    keys = {tuple(r.choice("aaabcdefg") for _ in range(r.randrange(0, 5))) for _ in range(n)} | {()}
    return {k: i for i, k in enumerate(sorted(keys))}


@pytest.mark.parametrize("empty", [False, True])
def test_all_in(spark, empty):
    r = random.Random(3)
    entries = random_entries(r, 150)
    sets = [(i, [r.choice("aabcdefgz") for _ in range(r.randrange(0, 6))]) for i in range(80)] + [(99, ["a", "a"])]
    got = graph.all_in(spark.createDataFrame([(list(k), v) for k, v in entries.items()], SCHEMA), spark.createDataFrame(sets, "id int, elements array<string>"), empty)
    want = sorted((i, v) for i, s in sets for k, v in entries.items() if set(k) <= set(s) and (k or empty))
    assert sorted((x.id, x.value) for x in got.collect()) == want
    assert graph.all_in(spark.createDataFrame([], SCHEMA), spark.createDataFrame(sets, "id int, elements array<string>"), empty).isEmpty()


@pytest.mark.parametrize("flags", [(False, False), (True, False), (False, True), (True, True)])
def test_overlaps(spark, flags):
    r = random.Random(5)
    sides = [random_entries(r, 40) for _ in range(2)]
    tables = [spark.createDataFrame([(list(k), v) for k, v in s.items()], SCHEMA) for s in sides]
    begins = [{k[:n] for k in s for n in range(1, len(k) + 1)} for s in sides]
    want = {(p, sides[0].get(p), sides[1].get(p)) for p in begins[0] & begins[1] if all(p in s or not f for s, f in zip(sides, flags, strict=True))}
    got = graph.overlaps(*tables, *flags).collect()
    assert {(tuple(x.prefix), x.left_value, x.right_value) for x in got} == want and len(got) == len(want)


def test_equal_sets_are_looked_up_once(spark, monkeypatch):
    """Many ids of one set: the set meets the entries once, and what it holds goes to all its ids."""
    written, write = [], graph.stored
    monkeypatch.setattr(graph, "stored", lambda df: written.append(out := write(df)) or out)
    sets = spark.range(2500).selectExpr("id", "IF(id % 2 = 0, array('a', 'b'), array('b', 'a', 'a')) AS elements")
    got = graph.all_in(spark.createDataFrame([(["a"], 1), (["a", "b", "a"], 2), (["c"], 3), ([], 4)], SCHEMA), sets)
    assert [d.count() for d in written] == [1]
    assert got.distinct().count() == got.count() == 5000 and {x.value for x in got.select("value").distinct().collect()} == {1, 2}
