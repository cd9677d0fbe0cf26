"""Ids, ancestors by doubled paths and the resolution of names, on small inputs."""

import random

from millrace.operators import classes, graph


def test_ancestors_of_chains_rings_and_many_parents(spark):
    r = random.Random(9)
    edges = [(i, i - 1) for i in range(1, 200)] + [(1000, 1001), (1001, 1002), (1002, 1000)] + [(r.randrange(2000, 2030), r.randrange(2000, 2030)) for _ in range(60)] + [(5, 5), (0, None)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).update([] if b is None else [b])
    want = {}
    for n in up:
        level, seen, d = {n}, {n: 0}, 0
        while level:
            d += 1
            level = {p for x in level for p in up.get(x, ())} - set(seen)
            seen.update((p, d) for p in level)
        want.update({(n, a): x for a, x in seen.items()})
    got = graph.ancestors(spark.createDataFrame(edges, "node int, parent int")).collect()
    assert {(x.node, x.ancestor): x.distance for x in got} == want and len(got) == len(want)


def test_ids_follow_each_other(spark):
    one, two = spark.createDataFrame([("b",), ("a",), ("b",)], "k string"), spark.createDataFrame([(10**12,), (-3,)], "k long")
    got = classes.offset_ids([("x", one, "k"), ("none", one.limit(0), "k"), ("y", two, "k")]).collect()
    assert sorted((x.id, x.kind, x.key) for x in got) == [(0, "x", "a"), (1, "x", "b"), (2, "y", "-3"), (3, "y", str(10**12))]


def test_names_by_rank(spark):
    uses = [("f", "p", n) for n in ("A", "B", "C", "D", "String", "x.y.Z", "Outer.In", "None")] + [("g", "", "A"), ("g", "", "C"), (None, "p", "A")]
    imports = [("f", "q.A", False), ("f", "q.Outer", False), ("f", "r", True), ("f", "s", True), ("g", "r", True)]
    known = ["p.A", "p.B", "r.B", "r.C", "s.C", "s.D", "A", "java.lang.String", "java.lang.C", "x.y.Z", "r.String"]
    got = classes.resolved_types(spark.createDataFrame(uses, "file string, package string, name string"), spark.createDataFrame(imports, "file string, path string, wildcard boolean"), spark.createDataFrame([(k,) for k in known], "full string"))
    assert {(x.file, x.name): (x.full, x.rank, x.ambiguous) for x in got.collect()} == {
        ("f", "A"): ("q.A", 1, None),
        ("f", "B"): ("p.B", 2, None),
        ("f", "C"): (None, 3, ["r.C", "s.C"]),
        ("f", "D"): ("s.D", 3, None),
        ("f", "String"): ("r.String", 3, None),
        ("f", "x.y.Z"): ("x.y.Z", 0, None),
        ("f", "Outer.In"): ("q.Outer.In", 1, None),
        ("f", "None"): (None, None, None),
        ("g", "A"): ("A", 2, None),
        ("g", "C"): ("r.C", 3, None),
        (None, "A"): ("p.A", 2, None),
    }


def test_uses_are_read_once_and_dealt_by_files(spark, monkeypatch):
    """Random names against the rule, as Spark deals them and by files; the plan has one source of uses."""
    r = random.Random(5)
    uses = [(r.choice(["f", "g", "h", None]), r.choice(["p", "q", "", None]), r.choice(["A", "B", "C", "D.E", "p.A", "x.y.Z"])) for _ in range(80)]
    imports = [(r.choice(["f", "g", None]), r.choice(["p", "q", "r", "s.A", "t.A", "s.D", None]), r.choice([True, False, None])) for _ in range(25)]
    known = [f"{p}.{n}" for p in ("p", "q", "r", "java.lang") for n in "ABC" if r.random() < 0.5] + ["p.D.E", "A", "x.y.Z", None]
    want = {}
    for file, package, name in uses:
        own = [(p, w) for f, p, w in imports if f == file and file is not None and p is not None]
        first = name.split(".")[0]
        ranks = [
            {name} & set(known) if "." in name else set(),
            {p + name[len(first) :] for p, w in own if w is False and p.split(".")[-1] == first},
            {f"{package}.{name}" if package else name} & set(known),
            {f"{p}.{name}" for p, w in own if w} & set(known),
            {f"java.lang.{name}"} & set(known),
        ]
        rank = next((i for i, found in enumerate(ranks) if found), None)
        found = sorted(ranks[rank]) if rank is not None else []
        want[file, package, name] = (found[0] if len(found) == 1 else None, rank, found if len(found) > 1 else None)
    tables = [spark.createDataFrame(uses, "file string, package string, name string"), spark.createDataFrame(imports, "file string, path string, wildcard boolean"), spark.createDataFrame([(k,) for k in known], "full string")]
    for n in (None, 9):
        monkeypatch.setattr(classes, "parts", lambda _, n=n: n, raising=False)
        out = classes.resolved_types(*tables)
        got = out.collect()
        assert {(x.file, x.package, x.name): (x.full, x.rank, x.ambiguous) for x in got} == want and len(got) == len(want)
        leaves = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "package#" in line and ("Relation" in line or "LogicalRDD" in line)]
        assert len(leaves) == 1
