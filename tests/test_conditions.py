"""Path conditions against a recursive version on random methods and traces."""

import random
import time
import tracemalloc

import pandas as pd
import pyarrow as pa

from millrace.operators import conditions, graph, intervals

SCHEMA = "tree string, node long, parent long, place int, type string, role string, tok string, start long, end long"


class Node:
    def __init__(self, type_, *children, role=None, tok=None):
        self.type, self.children, self.role, self.tok = type_, list(children), role, tok
        self.parent = self.line = None
        for c in children:
            c.parent = self

    def of(self, role):
        return next((c for c in self.children if c.role == role), None)

    def statements(self):
        return [c for c in self.children if c.type.endswith("Stmt")]

    def walk(self):
        yield self
        for c in self.children:
            yield from c.walk()

    def tokens(self):
        return [(n.tok, n.type == "NameExpr") for n in self.walk() if n.tok is not None]


def made(r, name, calls):
    """A random method whose statements have a line each."""
    lines = iter(range(1, 10_000))

    def expr(role):
        kind = r.randrange(4)
        if kind == 0:
            return Node("NameExpr", role=role, tok=r.choice("abcp"))
        if kind == 1:
            return Node("LiteralExpr", role=role, tok=str(r.randrange(9)))
        return Node("BinaryExpr", Node("NameExpr", tok=r.choice("abcp")), Node("Token", tok=r.choice("<+")), Node("NameExpr", tok=r.choice("abcq")), role=role)

    def call():
        return Node("MethodCallExpr", Node("Token", role="name", tok=r.choice(calls)), *[expr("argument") for _ in range(r.randrange(1, 3))], role="expression")

    def block(depth, role=None):
        return Node("BlockStmt", *[statement(depth - 1) for _ in range(r.randrange(0, 4))], role=role)

    def body(depth, role):
        out = block(depth, role) if r.random() < 0.8 else statement(depth - 1)
        out.role = role
        return out

    def statement(depth):
        line = next(lines)
        kind = r.choice(["set", "let", "call", "return", "throw"] if depth <= 0 else ["set", "let", "call", "return", "if", "if", "ifelse", "ifelse", "chain", "for", "each", "while", "switch", "block"])
        if kind == "set":
            out = Node("ExpressionStmt", Node("AssignExpr", Node("NameExpr", role="target", tok=r.choice("abc")), expr("value"), role="expression"))
        elif kind == "let":
            out = Node("ExpressionStmt", Node("VariableDeclarationExpr", *[Node("VariableDeclarator", Node("Token", role="name", tok=v), *[expr("initializer")] * (r.random() < 0.8)) for v in r.sample("abc", r.randrange(1, 3))], role="expression"))
        elif kind == "call":
            out = Node("ExpressionStmt", call())
        elif kind in ("return", "throw"):
            out = Node("ReturnStmt" if kind == "return" else "ThrowStmt", expr("expression"))
        elif kind == "if":
            out = Node("IfStmt", expr("condition"), body(depth, "then"))
        elif kind == "ifelse":
            out = Node("IfStmt", expr("condition"), body(depth, "then"), body(depth, "else"))
        elif kind == "chain":
            out = Node("IfStmt", expr("condition"), body(depth, "then"), Node("IfStmt", expr("condition"), body(depth, "then"), *[body(depth, "else")] * (r.random() < 0.6), role="else"))
        elif kind == "for":
            out = Node("ForStmt", *[expr("compare")] * (r.random() < 0.8), body(depth, "body"))
        elif kind == "each":
            out = Node("ForEachStmt", Node("Token", role="variable", tok=r.choice("abc")), expr("iterable"), body(depth, "body"))
        elif kind == "while":
            out = Node("WhileStmt", expr("condition"), body(depth, "body"))
        elif kind == "block":
            out = block(depth)
        else:
            entries = [Node("SwitchEntry", *[expr("label") for _ in range(r.randrange(1, 3))], *[statement(depth - 1) for _ in range(r.randrange(0, 3))]) for _ in range(r.randrange(1, 3))]
            last = [Node("SwitchEntry", statement(depth - 1))] * (r.random() < 0.6)
            out = Node("SwitchStmt", expr("selector"), *entries, *last)
        for n in out.walk():
            n.line = n.line or line
        return out

    params = [Node("Parameter", Node("Token", role="name", tok=v), role="parameter") for v in "pq"[: r.randrange(1, 3)]]
    kind = "ConstructorDeclaration" if r.random() < 0.2 else "MethodDeclaration"
    out = Node(kind, Node("Token", role="name", tok=name), *params, block(4, "body"))
    for n in out.walk():
        n.line = n.line or 0
    return out


def brute(frames):
    """The condition of frames (method, line), the root cause first."""
    found = [(m, next((n for n in m.walk() if n.line == line), None)) for m, line in frames]
    found = [(m, b) for m, b in found if b is not None]
    items = []

    def assigned(s):
        e = s.of("expression")
        if e.type == "VariableDeclarationExpr":
            got = {d.of("name").tok: d.of("initializer").tokens() for d in e.children if d.of("initializer")}
        elif e.type == "AssignExpr":
            got = {e.of("target").tok: e.of("value").tokens()}
        else:
            return
        items.append(("set", got))

    def exit_(s):
        return s.type in ("ThrowStmt", "ReturnStmt") or s.type == "ExpressionStmt" and s.of("expression").type == "MethodCallExpr"

    def traverse(s, stack):
        stack.append(("not", s.of("condition")))
        branch(s.of("then"), stack)
        if stack:
            stack.pop()
        other = s.of("else")
        if other:
            if other.type == "IfStmt":
                traverse(other, stack)
            else:
                stack.append(("is", s.of("condition")))
                branch(other, stack)
        if stack:
            stack.pop()

    def branch(s, stack):
        if exit_(s):
            items.extend((k, c.tokens()) for k, c in stack)
        elif s.type == "IfStmt":
            pass
        elif s.type == "BlockStmt":
            for x in s.statements():
                if x.type == "IfStmt":
                    traverse(x, stack)
                elif exit_(x):
                    items.extend((k, c.tokens()) for k, c in stack)

    def process(s):
        if s.type == "ExpressionStmt":
            assigned(s)
        elif s.type in ("BlockStmt", "ForStmt"):
            for x in s.statements():
                process(x)
        elif s.type == "IfStmt":
            traverse(s, [])

    for k, (m, b) in enumerate(found):
        if b.type == "ExpressionStmt":
            if k:
                assigned(b)
            else:
                items.append(("is", b.of("expression").tokens()))
        child, p, negate = b, b.parent, False
        while p is not None and p.parent is not None:
            negate = negate and p.type == "IfStmt"
            if p.type == "ForStmt" and p.of("compare"):
                items.append(("is", p.of("compare").tokens()))
            if p.type == "ForEachStmt":
                items.append(("set", {p.of("variable").tok: p.of("iterable").tokens()}))
            if p.type == "WhileStmt":
                items.append(("is", p.of("condition").tokens()))
            if p.type == "BlockStmt":
                earlier = p.statements()[: p.statements().index(child)]
                for s in earlier if m.type == "ConstructorDeclaration" else reversed(earlier):
                    process(s)
            if p.type == "IfStmt":
                other = p.of("else")
                if other is child and other.type != "IfStmt":
                    negate = True
                if negate:
                    items.append(("not", p.of("condition").tokens()))
                elif other is None or p.of("then") is child:
                    items.append(("is", p.of("condition").tokens()))
            if p.type == "SwitchStmt" and child.type == "SwitchEntry":
                labels = [c for c in child.children if c.role == "label"]
                s = p.of("selector").tokens()
                if labels:
                    items.extend(("is", [*s, ("==", False), *x.tokens()]) for x in labels)
                else:
                    items.extend(("is", [*s, ("!=", False), *e.of("label").tokens()]) for e in p.children if e.type == "SwitchEntry" and e is not child and e.of("label"))
            child, p = p, p.parent
        if k + 1 < len(found):
            names = [c.of("name").tok for c in m.children if c.role == "parameter"]
            for c in found[k + 1][1].walk():
                given = [a for a in c.children if a.role == "argument"]
                if c.type == "MethodCallExpr" and c.of("name").tok == m.of("name").tok and (m.type == "ConstructorDeclaration" or len(given) == len(names)):
                    items.append(("set", {n: a.tokens() for n, a in zip(names, given, strict=False)}))
                    break
    held = []
    for kind, value in items:
        if kind == "set":
            held = [(k, t if k == "is" and len(t) == 1 else [y for x in t for y in (value.get(x[0], [x]) if x[1] else [x])]) for k, t in held]
        else:
            held.append((kind, value))
    return " && ".join(("!" if k == "not" else "") + " ".join(x for x, _ in t) for k, t in reversed(held))


def rows(tree, root):
    out, ids = [], iter(range(1, 10**6))

    def add(n, parent, place):
        me = next(ids)
        out.append((tree, me, parent, place, n.type, n.role, n.tok, n.line, n.line))
        for i, c in enumerate(n.children):
            add(c, me, i)

    add(root, None, 0)
    return out


def test_random_traces(spark):
    r = random.Random(11)
    names = ["f", "g", "h"]
    methods = {f"m{i}": made(r, names[i % 3], names) for i in range(40)}
    by_call = {k: [(t, n.line) for t, m in methods.items() for n in m.walk() if n.type == "MethodCallExpr" and n.of("name").tok == k] for k in names}
    traces = {}
    for i in range(150):
        t = r.choice(list(methods))
        lines = sorted({n.line for n in methods[t].walk() if n.line})
        frames = [(t, r.choice(lines or [1]))]
        while len(frames) < r.randrange(1, 4) and by_call[methods[frames[-1][0]].of("name").tok]:
            frames.append(r.choice(by_call[methods[frames[-1][0]].of("name").tok]))
        traces[i] = frames
    traces[999] = [("m0", 9_999)]
    nodes = graph.stored(intervals.numbered(spark.createDataFrame([x for t, m in methods.items() for x in rows(t, m)], SCHEMA)))
    table = spark.createDataFrame([(i, k, t, line) for i, f in traces.items() for k, (t, line) in enumerate(f)], "trace int, pos int, tree string, line long")
    got = {x.trace: x.condition for x in conditions.path_conditions(nodes, table).collect()}
    want = {i: brute([(methods[t], line) for t, line in f]) for i, f in traces.items()}
    wrong = [i for i in want if got[i] != want[i]]
    assert not wrong, (len(wrong), [(traces[i], got[i], want[i]) for i in wrong[:3]])
    assert sum(" && " in v for v in want.values()) > 40 and got[999] == ""


def test_fold_reads_each_item_once():
    """A long trace: work grows with its items, not with their square, and assignments after a condition are put in, through each other."""
    token = lambda w, name=True: {"tok": w, "name": name}
    n = 20_000
    items = [x for i in range(n) for x in ({"kind": "not" if i % 2 else "is", "tokens": [token("x"), token("<", False), token(str(i), False)], "names": None}, {"kind": "set", "tokens": None, "names": [{"name": "x", "value": [token(f"y{i}")]}, {"name": f"y{i - 1}", "value": [token("z")]}]})]
    began = time.process_time()
    got = conditions.folded.func(pd.Series([items, None, [items[0]]], dtype=object)).tolist()
    assert time.process_time() - began < 20
    assert got[1:] == ["", "x < 0"]
    want = [("!" if i % 2 else "") + (f"y{i}" if i == n - 1 else "z") + f" < {i}" for i in range(n)]
    assert got[0] == " && ".join(reversed(want))


def test_traces_are_folded_as_rows(spark):
    """A trace's items are never one value: the plan gathers no list by trace, and a stream of many batches takes no more memory than its text."""
    nodes = graph.stored(intervals.numbered(spark.createDataFrame([x for x in rows("m0", made(random.Random(3), "f", ["f"]))], SCHEMA)))
    frames = spark.createDataFrame([(1, 0, "m0", 1)], "trace int, pos int, tree string, line long")
    assert "collect_list" not in conditions.path_conditions(nodes, frames)._jdf.queryExecution().executedPlan().toString()
    token = pa.list_(pa.struct([("tok", pa.string()), ("name", pa.bool_())]))
    shape = pa.schema([("trace", pa.int32()), ("kind", pa.string()), ("tokens", token), ("names", pa.list_(pa.struct([("name", pa.string()), ("value", token)])))])
    item = lambda t, k: {"trace": t, "kind": "not", "tokens": [{"tok": "x", "name": True}, {"tok": str(k), "name": False}], "names": None} if k % 2 else {"trace": t, "kind": "set", "tokens": None, "names": [{"name": "x", "value": [{"tok": f"y{k}", "name": True}]}]}
    each = [[item(t, k) for k in range(2_000)] for t in (None, 4, 7)]
    batches = pa.Table.from_pylist([x for trace in each for x in trace], schema=shape).to_batches(max_chunksize=700)
    got = [(x["trace"], x["condition"]) for b in conditions.folded_rows(iter(batches)) for x in b.to_pylist()]
    want = conditions.folded.func(pd.Series([trace[::-1] for trace in each], dtype=object)).tolist()
    assert got == list(zip((None, 4, 7), want, strict=True)) and want[0].startswith("!y0 1 && !y2 3 && ")
    assert list(conditions.folded_rows(iter([]))) == []
    many = pa.RecordBatch.from_pylist(each[1], schema=shape)
    tracemalloc.start()
    out = [b for b in conditions.folded_rows(many for _ in range(60))]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(out) == 1 and len(out[0]["condition"][0].as_py()) > 600_000 and most < 30_000_000
