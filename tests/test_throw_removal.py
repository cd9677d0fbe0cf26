"""Numbered trees and the removal of throws, against a recursive version on random trees."""

import random

import pytest

from millrace.operators import intervals, throw_removal

SCHEMA = "tree string, node long, parent long, place int, type string, tok string"
BODIES = {"ForStmt", "ForEachStmt", "WhileStmt", "DoStmt", "LabeledStmt", "LambdaExpr"}
TAKES = BODIES | {"IfStmt", "BlockStmt", "SwitchEntry"}


class Node:
    def __init__(self, type_, *children, tok=None):
        self.type, self.children, self.tok = type_, list(children), tok

    def statements(self):
        return [c for c in self.children if c.type.endswith("Stmt")]


def leaf(tok):
    return Node("Token", tok=tok)


def block(*statements):
    return Node("BlockStmt", leaf("{"), *statements, leaf("}"))


def method(*statements):
    return Node("MethodDeclaration", leaf("m"), block(*statements))


def random_statement(r, depth, counter):
    def name():
        counter[0] += 1
        return leaf(f"e{counter[0]}")

    def body():
        return block(*[statement(depth - 1) for _ in range(r.randrange(0, 3))]) if r.random() < 0.7 else statement(depth - 1)

    def statement(depth):
        return random_statement(r, depth, counter)

    kind = r.choice(["expr", "throw", "throw", "return"] if depth <= 0 else ["expr", "throw", "if", "if", "ifelse", "ifelse", "chain", "for", "try", "try", "switch", "switch", "block", "lambda"])
    if kind == "expr":
        return Node("ExpressionStmt", name())
    if kind == "throw":
        return Node("ThrowStmt", leaf("throw"), name())
    if kind == "return":
        return Node("ReturnStmt", leaf("return"))
    if kind == "if":
        return Node("IfStmt", leaf("if"), Node("Name", name()), body())
    if kind == "ifelse":
        return Node("IfStmt", leaf("if"), Node("Name", name()), body(), leaf("else"), body())
    if kind == "chain":
        return Node("IfStmt", leaf("if"), Node("Name", name()), Node("ThrowStmt", leaf("throw"), name()), leaf("else"), Node("IfStmt", leaf("if"), name(), body(), leaf("else"), body()))
    if kind == "for":
        return Node(r.choice(["ForStmt", "WhileStmt"]), leaf("for"), name(), body())
    if kind == "block":
        return block(*[statement(depth - 1) for _ in range(r.randrange(0, 3))])
    if kind == "lambda":
        return Node("ExpressionStmt", Node("MethodCallExpr", name(), Node("LambdaExpr", leaf("->"), body())))
    if kind == "try":
        catches = [Node("CatchClause", leaf("catch"), name(), block(*[statement(depth - 1) for _ in range(r.randrange(0, 3))])) for _ in range(r.randrange(0, 3))]
        last = [leaf("finally"), block(statement(depth - 1))] if r.random() < 0.4 or not catches else []
        return Node("TryStmt", leaf("try"), block(*[statement(depth - 1) for _ in range(r.randrange(1, 3))]), *catches, *last)
    entries = [Node("SwitchEntry", leaf("case"), name(), *[statement(depth - 1) for _ in range(r.randrange(0, 3))], *[Node("BreakStmt", leaf("break"))] * (r.random() < 0.5)) for _ in range(r.randrange(1, 4))]
    return Node("SwitchStmt", leaf("switch"), name(), *entries)


def visited(n, visit):
    """A node whose children are replaced by what visit makes of them: none, one, or several."""
    pairs = [(c, visit(c, n)) for c in n.children]
    if any(new == "entry" for _, new in pairs):
        return None
    lost = [c for c, new in pairs if new is None and c.type.endswith("Stmt")]
    if n.type in BODIES and lost or n.type == "IfStmt" and n.statements()[0] in lost:
        return None
    out = []
    for c, new in pairs:
        out += new if isinstance(new, list) else [] if new is None else [new]
    if n.type == "IfStmt" and lost:
        out = [c for c in out if c.tok != "else"]
    n.children = out
    return n


def brute(root):
    """(text, markers) of a method; changes it."""
    markers = []

    def one(n, parent):
        if n.type == "BlockStmt" and len(n.statements()) == 1 and parent.type in TAKES:
            return n.statements()[0]
        return visited(n, one)

    def two(n, parent):
        if n.type != "IfStmt":
            return visited(n, two)
        then, has_else = n.statements()[0], len(n.statements()) > 1
        out = visited(n, two)
        if out is None:
            markers.extend(["if-throw"] * has_else)
            return None
        other = n.statements()[1] if len(n.statements()) > 1 else None
        if then.type == "ThrowStmt":
            markers.append("if-throw")
            if parent.type == "SwitchEntry":
                return "entry"
            if other and other.type != "ThrowStmt":
                return other.statements() if other.type == "BlockStmt" and parent.type == "BlockStmt" else other
            return None
        if other:
            markers.append("if-throw")
            if other.type == "ThrowStmt":
                n.children = [c for c in n.children if c is not other and c.tok != "else"]
        return n

    def three(n, parent):
        if n.type == "CatchClause" and any(s.type == "ThrowStmt" for s in n.statements()[0].statements()):
            markers.append("catch-throw")
            return None
        out = visited(n, three)
        if n.type == "TryStmt" and not any(c.type == "CatchClause" for c in n.children):
            blocks = n.statements()
            if parent.type == "BlockStmt":
                return [s for b in blocks for s in b.statements()]
            blocks[0].children[-1:-1] = [s for b in blocks[1:] for s in b.statements()]
            return blocks[0]
        return out

    def four(n, parent):
        out = visited(n, four)
        if n.type != "SwitchStmt":
            return out
        entries, empty, left = [c for c in n.children if c.type == "SwitchEntry"], [], []
        for e in entries:
            s = e.statements()
            if not s:
                empty.append(e)
            elif s[0].type == "ThrowStmt":
                markers.append("switch-throw")
                empty = []
            else:
                left += [*empty, e]
                empty = []
        left += empty
        if len(left) == 1:
            s = left[0].statements()
            s = s[:-1] if s and s[-1].type == "BreakStmt" else s
            return s if parent.type == "BlockStmt" else Node("BlockStmt", *s)
        n.children = [c for c in n.children if c.type != "SwitchEntry" or c in left]
        return n if left else None

    def five(n, parent):
        if n.type == "ThrowStmt":
            markers.append("rest-throw")
            return None
        return visited(n, five)

    for p in (one, two, three, four, five):
        root = visited(root, p)

    def text(n):
        return [n.tok] if n.tok is not None else [t for c in n.children for t in text(c)]

    return " ".join(text(root)), sorted(markers)


def rows(tree, root):
    out, ids = [], iter(range(1, 10**6))

    def add(n, parent, place):
        me = next(ids)
        out.append((tree, me, parent, place, n.type, n.tok))
        for i, c in enumerate(n.children):
            add(c, me, i)

    add(root, None, 0)
    return out


def removed(spark, methods):
    table = spark.createDataFrame([x for t, m in methods.items() for x in rows(t, m)], SCHEMA)
    left, markers = throw_removal.removed(table)
    found = {r.tree: r.text for r in intervals.texts(left).collect()}
    marks = {}
    for r in markers.collect():
        marks.setdefault(r.tree, []).append(r.marker)
    return {t: (found.get(t, ""), sorted(marks.get(t, []))) for t in methods}


def test_random_methods(spark):
    r = random.Random(7)
    methods = {f"t{i}": method(*[random_statement(r, 3, [0]) for _ in range(r.randrange(0, 4))]) for i in range(200)}
    got = removed(spark, methods)
    want = {t: brute(m) for t, m in methods.items()}
    wrong = [t for t in want if got[t] != want[t]]
    assert not wrong, (len(wrong), [(got[t], want[t]) for t in wrong[:2]])
    kinds = {k for _, marks in want.values() for k in marks}
    assert kinds == {"if-throw", "catch-throw", "switch-throw", "rest-throw"}


def test_known_methods(spark):
    throw, e = lambda: Node("ThrowStmt", leaf("throw"), leaf("x")), lambda t: Node("ExpressionStmt", leaf(t))
    got = removed(
        spark,
        {
            "if": method(Node("IfStmt", leaf("if"), leaf("c"), block(throw())), e("a")),
            "else": method(Node("IfStmt", leaf("if"), leaf("c"), block(throw()), leaf("else"), block(e("a"), e("b")))),
            "catch": method(Node("TryStmt", leaf("try"), block(e("a")), Node("CatchClause", leaf("catch"), block(e("l"), throw())), leaf("finally"), block(e("z")))),
            "switch": method(Node("SwitchStmt", leaf("switch"), leaf("s"), Node("SwitchEntry", leaf("1")), Node("SwitchEntry", leaf("2"), throw()), Node("SwitchEntry", leaf("3"), e("a"), Node("BreakStmt", leaf("break"))))),
            "none": method(),
        },
    )
    assert got == {
        "if": ("m { a }", ["if-throw"]),
        "else": ("m { a b }", ["if-throw"]),
        "catch": ("m { a z }", ["catch-throw"]),
        "switch": ("m { a }", ["switch-throw"]),
        "none": ("m { }", []),
    }


def test_empty_table(spark):
    left, markers = throw_removal.removed(spark.createDataFrame([], SCHEMA))
    assert left.isEmpty() and markers.isEmpty()


def numbers(root):
    """node number: (enter, leave, depth, leaves before, leaves) in a tree whose nodes are numbered in order."""
    out, clock, ids, leaves = {}, [0], iter(range(1, 10**6)), [0]

    def walk(n, depth):
        me, enter, before = next(ids), clock[0], leaves[0]
        clock[0] += 1
        leaves[0] += n.tok is not None
        for c in n.children:
            walk(c, depth + 1)
        out[me] = (enter, clock[0], depth, before, leaves[0] - before)
        clock[0] += 1

    walk(root, 0)
    return out


def test_numbering(spark):
    r = random.Random(3)
    methods = {f"t{i}": method(*[random_statement(r, 3, [0]) for _ in range(3)]) for i in range(20)}
    table = spark.createDataFrame([x for t, m in methods.items() for x in rows(t, m)] + [("lost", 1, 9, 0, "X", None), ("ring", 1, 2, 0, "X", None), ("ring", 2, 1, 0, "X", None)], SCHEMA)
    found = intervals.numbered(table).collect()
    assert {(x.tree, x.node): (x.enter, x.leave, x.depth, x.first_leaf, x.leaves) for x in found} == {(t, k): v for t, m in methods.items() for k, v in numbers(m).items()}
    assert all(x.step == x.node - 1 for x in found)


@pytest.mark.parametrize("n", [10_000])
def test_deep_chain(spark, n):
    """A chain of 10,000 nodes: rounds follow the logarithm of its length, and no row is written for a pair of nodes."""
    table = spark.range(1, n + 1).selectExpr("'c' AS tree", "id AS node", "IF(id > 1, id - 1, NULL) AS parent", "0 AS place", "'X' AS type", f"IF(id = {n}, 'x', NULL) AS tok", "id AS start", "id AS end")
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = intervals.numbered(table)
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("chain")) < 20 * 15
    assert got.filter("depth <> node - 1 OR step <> node - 1 OR leave - enter <> 2 * (10000 - node) + 1 OR leaves <> 1").isEmpty() and got.count() == n
    ends = intervals.extremes(got, "start", "end")
    assert ends.count() == n and ends.filter(f"start <> node OR end <> {n}").isEmpty()


def test_innermost(spark):
    """The innermost of nested spans around a place, in its key only."""
    r, spans, points = random.Random(1), [], []
    for k in range(3):
        def nest(low, high, k=k):
            if high - low > 2 and r.random() < 0.9:
                spans.append((k, low, high, f"{k}:{low}-{high}"))
                mid = r.randrange(low + 1, high)
                nest(low + 1, mid)
                nest(mid, high - 1)
        nest(0, 200)
        points += [(k, p, 1000 * k + p) for p in range(-3, 205)]
    got = intervals.innermost(["k"], spark.createDataFrame(points, "k int, at long, id int"), spark.createDataFrame(spans, "k int, enter long, leave long, name string"), "name")
    want = {}
    for k, p, i in points:
        around = [(h - lo, n) for kk, lo, h, n in spans if kk == k and lo <= p < h]
        want[i] = min(around)[1] if around else None
    assert {x.id: x.name for x in got.collect()} == want


@pytest.mark.parametrize("batch", ["3", "10000"])
def test_numbering_over_batches(spark, batch):
    """Trees with ids in no order, roots side by side, a missing parent and a cycle, in small batches and in one: the same places."""
    r, rows_, want = random.Random(4), [], {}
    for t in ("a", "b"):
        ids = r.sample(range(2**60), 150)
        above = {n: (ids[r.randrange(i)] if i > 1 and r.random() < 0.97 else None) for i, n in enumerate(ids)}
        below = {p: sorted(n for n in ids if above[n] == p) for p in [None, *ids]}
        clock, step = [0], [0]

        def walk(n, depth, t=t, below=below, clock=clock, step=step):
            enter, me = clock[0], step[0]
            clock[0], step[0] = clock[0] + 1, step[0] + 1
            for c in below[n]:
                walk(c, depth + 1)
            want[t, n] = (enter, clock[0], me, depth)
            clock[0] += 1

        for root in below[None]:
            walk(root, 0)
        rows_ += [(t, n, above[n], 0, "X", None if below[n] else "x") for n in ids]
    lost = [("a", 1, 2, 0, "X", None), ("a", 3, 4, 0, "X", None), ("a", 4, 3, 0, "X", "x"), ("a", 5, 4, 0, "X", "x")]
    table = spark.createDataFrame(rows_ + lost, "tree string, node long, parent long, place int, type string, tok string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = intervals.numbered(table).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    assert {(x.tree, x.node): (x.enter, x.leave, x.step, x.depth) for x in found} == want and len(found) == len(want)


def test_numbering_goes_over_all_nodes_once(spark, monkeypatch):
    """Of a wide tree in the order of its ids few elements are left after the first pass, and only those are written again in each round."""
    sizes, write = [], intervals.stored
    monkeypatch.setattr(intervals, "stored", lambda df: sizes.append((out := write(df)).count()) or out)
    table = spark.range(1, 40_001).selectExpr("'t' AS tree", "id AS node", "IF(id > 1, IF(id % 4 = 2, 1, id - 1), NULL) AS parent", "0 AS place", "'X' AS type", "CAST(NULL AS string) AS tok")
    assert intervals.numbered(table).filter("leave <= enter").isEmpty()
    assert sum(n > 1000 for n in sizes) <= 2
