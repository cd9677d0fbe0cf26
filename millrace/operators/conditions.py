"""Path conditions: what must hold on the way to a stack trace's root cause, from the trees of its methods.

Trees are numbered tables of nodes with roles (condition, compare, variable, iterable, selector, label, then, else, body, name, initializer, target, value, argument,
parameter, expression). Steps, each over all traces at once: the node at each frame's line; what encloses it, from the inside out; the statements before it in the blocks
that do; the conditions under which those leave the method early; and last, for each trace, one pass over its items, which gathers conditions and puts in what names stand for.

An item is a condition, or an assignment (names and the expressions that they get), which is put into the conditions gathered before it. The early exits of an if keep a stack of conditions: its
condition negated while its then is read, its condition itself while an else is read that is no if; each exit (a throw, a return, a statement that is a call) adds the stack. As in the tool, an if without an else, or with an else if,
takes one more condition off the stack when it ends, if there is one. The stack is read from running sums and minima of its pushes and pops.

Defined differences: conditions are texts of tokens with one space between, `!` right before a negated one; each is a value of its own, so putting in a name in one never changes another. A condition
that is a single name stays as it is (negated ones don't). A frame whose line is at no node gives nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from millrace.operators import intervals, members
from millrace.operators.graph import stored

GUARDS = ["IfStmt", "ForStmt", "ForEachStmt", "WhileStmt", "BlockStmt", "SwitchStmt"]
FRAME = ["trace", "pos", "tree"]
TOKEN = "array<struct<tok:string,name:boolean>>"


def _role(nodes: DataFrame, role: str, value: str, of: str) -> DataFrame:
    """(tree, of, value): the child of a role of each node."""
    return nodes.filter(F.col("role") == role).select("tree", F.col("parent").alias(of), F.col("node").alias(value))


def _texts(nodes: DataFrame, roles: list[str]) -> DataFrame:
    """(tree, node, tokens) of the nodes of these roles."""
    marked = nodes.filter(F.col("role").isin(roles))
    leaves = nodes.filter("tok IS NOT NULL").select("tree", F.col("enter").alias("at"), "enter", F.struct("tok", (F.col("type") == "NameExpr").alias("name")).alias("token"))
    found = members.enclosing(nodes, leaves, marked).groupBy("tree", "around").agg(F.array_sort(F.collect_list(F.struct("enter", "token"))).alias("all"))
    return found.select("tree", F.col("around").alias("node"), F.col("all.token").cast(TOKEN).alias("tokens"))


def begins(nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames (trace, pos, tree, line) with the first node of their line, as `begin`, `begin_type` and `at`."""
    first = frames.join(nodes.select("tree", F.col("start").alias("line"), "enter", "node", "type"), ["tree", "line"])
    return first.groupBy(*FRAME).agg(F.min_by(F.struct("node", "type", "enter"), "enter").alias("b")).select(*FRAME, F.col("b.node").alias("begin"), F.col("b.type").alias("begin_type"), F.col("b.enter").alias("at"))


def guards(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(trace, pos, tree, node, type, enter, child, child_type, child_enter): the statements around each frame's node up to its method, and the child of each that it is in."""
    callables = nodes.filter(F.col("type").isin(members.CALLABLES)).select("tree", "enter", "leave", F.struct("node", "type", "enter").alias("method"))
    points = found.select(*FRAME, (F.col("at") - 1).alias("at"))
    inside = intervals.innermost(["tree"], points, callables, "method").filter("method IS NOT NULL")
    around = members.enclosing(nodes, inside, nodes.filter(F.col("type").isin(GUARDS)))
    own = nodes.select("tree", F.col("node").alias("around"), "type", "enter")
    within = around.join(own, ["tree", "around"]).filter("enter > method.enter")
    children = nodes.select("tree", F.col("parent").alias("around"), F.col("node").alias("child"), F.col("type").alias("child_type"), F.col("enter").alias("child_enter"), F.col("leave").alias("child_leave"), F.col("role").alias("child_role"))
    placed = within.join(children, ["tree", "around"]).filter("child_enter <= at + 1 AND at + 1 < child_leave")
    return placed.select(*FRAME, F.col("around").alias("node"), "type", "enter", "child", "child_type", "child_enter", "child_role", "method")


def own_items(nodes: DataFrame, around: DataFrame, texts: DataFrame) -> DataFrame:
    """The items of the guards themselves: (frame, enter, sub, kind, tokens, other): conditions, negated ones, equalities of a switch, and what a for-each assigns."""
    has_else = _role(nodes, "else", "other_part", "node")
    linked = (F.col("type") == "IfStmt") & (F.col("child_type") == "IfStmt")
    upwards = Window.partitionBy(*FRAME).orderBy(F.desc("enter"))
    runs = around.join(has_else, ["tree", "node"], "left").withColumn("run", F.sum(F.when(linked, 0).otherwise(1)).over(upwards))
    turned = (F.col("type") == "IfStmt") & (F.col("child_role") == "else") & (F.col("child_type") != "IfStmt")
    runs = runs.withColumn("negated", F.max(turned.cast("int")).over(Window.partitionBy(*FRAME, "run").orderBy(F.desc("enter")).rowsBetween(Window.unboundedPreceding, 0)) == 1)
    said = F.col("negated") | F.col("other_part").isNull() | (F.col("child_role") == "then")
    text = lambda role, name: _role(nodes, role, "part", "node").join(texts.withColumnRenamed("node", "part"), ["tree", "part"]).select("tree", "node", F.col("tokens").alias(name))
    none = F.lit(None).cast(TOKEN)
    row = lambda rows, kind, tokens, other, sub=F.lit(0): rows.select(*FRAME, "enter", sub.cast("long").alias("sub"), kind.alias("kind"), tokens.alias("tokens"), other.alias("other"))
    ifs = row(runs.filter(F.col("type") == "IfStmt").filter(said).join(text("condition", "t"), ["tree", "node"]), F.when(F.col("negated"), "not").otherwise("is"), F.col("t"), none)
    loops = row(around.filter("type = 'WhileStmt'").join(text("condition", "t"), ["tree", "node"]), F.lit("is"), F.col("t"), none)
    counted = row(around.filter("type = 'ForStmt'").join(text("compare", "t"), ["tree", "node"]), F.lit("is"), F.col("t"), none)
    each = row(around.filter("type = 'ForEachStmt'").join(text("variable", "v"), ["tree", "node"]).join(text("iterable", "t"), ["tree", "node"]), F.lit("set"), F.col("t"), F.col("v"))
    entries = nodes.filter("type = 'SwitchEntry'").select("tree", F.col("parent").alias("switch"), F.col("node").alias("entry"), F.col("enter").alias("entry_enter"))
    labels = nodes.filter("role = 'label'").select("tree", F.col("parent").alias("entry"), F.col("node").alias("part"), F.col("enter").alias("label_enter")).join(texts.withColumnRenamed("node", "part").withColumnRenamed("tokens", "label"), ["tree", "part"])
    chosen = around.filter("type = 'SwitchStmt' AND child_type = 'SwitchEntry'").join(text("selector", "s"), ["tree", "node"])
    own = labels.withColumnRenamed("entry", "child")
    equal = row(chosen.join(own, ["tree", "child"]), F.lit("equal"), F.col("s"), F.col("label"), F.col("label_enter"))
    first = labels.groupBy("tree", "entry").agg(F.min_by(F.struct("label", "label_enter"), "label_enter").alias("l"))
    others = chosen.join(own.select("tree", "child"), ["tree", "child"], "left_anti").join(entries.join(first, ["tree", "entry"]).withColumnRenamed("switch", "node"), ["tree", "node"]).filter("entry <> child")
    unequal = row(others, F.lit("unequal"), F.col("s"), F.col("l.label"), F.col("l.label_enter"))
    out = ifs
    for more in (loops, counted, each, equal, unequal):
        out = out.unionByName(more)
    return out


def before(nodes: DataFrame, around: DataFrame) -> DataFrame:
    """(frame, enter, first, node, type, place, method_type): the expression statements and ifs before a frame's place in the blocks around it, those inside of blocks and for loops among them too; `first` is where the block's own statement begins, `enter` the block."""
    blocks = around.filter("type = 'BlockStmt'").select(*FRAME, "enter", F.col("node").alias("parent"), "child_enter", F.col("method.type").alias("method_type"))
    statements = stored(nodes.filter(F.col("type").endswith("Stmt")).select("tree", "parent", "node", "type", F.col("enter").alias("place")))
    now = stored(blocks.join(statements, ["tree", "parent"]).filter("place < child_enter").select(*FRAME, "enter", F.col("place").alias("first"), "node", "type", "place", "method_type"))
    rounds = [now]
    while not rounds[-1].filter(F.col("type").isin("BlockStmt", "ForStmt")).isEmpty():
        outer = rounds[-1].filter(F.col("type").isin("BlockStmt", "ForStmt")).select(*FRAME, "enter", "first", F.col("node").alias("parent"), "method_type")
        rounds.append(stored(outer.join(statements, ["tree", "parent"]).select(*now.columns)))
    out = rounds[0]
    for more in rounds[1:]:
        out = out.unionByName(more)
    return out.filter(F.col("type").isin("ExpressionStmt", "IfStmt"))


def early_exits(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, root, place, level, part, negated): for each if in roots (tree, node), the conditions that its early exits add, in order of place and level."""
    parts = nodes.filter("type = 'IfStmt'").select("tree", "node", "enter", "leave")
    for role in ("then", "else"):
        p = nodes.filter(F.col("role") == role).select("tree", F.col("parent").alias("node"), F.struct("node", "type", "enter", "leave").alias(role))
        parts = parts.join(p, ["tree", "node"], "left")
    parts = stored(parts)
    statements = nodes.filter(F.col("type").endswith("Stmt")).select("tree", F.col("node").alias("inner"), F.col("parent").alias("block"), "type", F.col("enter").alias("inner_enter"))
    branches = parts.select("tree", "node", F.explode(F.array("then", "else")).alias("b")).filter("b.type = 'BlockStmt'").select("tree", "node", F.col("b.node").alias("block"))
    direct = branches.join(statements, ["tree", "block"]).select("tree", "node", "inner", "type", F.col("inner_enter").alias("place"))
    bare = parts.select("tree", "node", F.explode(F.array("then", "else")).alias("b")).filter("b.node IS NOT NULL").select("tree", "node", F.col("b.node").alias("inner"), F.col("b.type").alias("type"), F.col("b.enter").alias("place"))
    nested = stored(direct.filter("type = 'IfStmt'").select("tree", "node", "inner").unionByName(parts.filter("`else`.type = 'IfStmt'").select("tree", "node", F.col("else.node").alias("inner"))))
    rounds = [stored(roots.select("tree", F.col("node").alias("root"), "node").distinct())]
    while not rounds[-1].isEmpty():
        rounds.append(stored(rounds[-1].join(nested, ["tree", "node"]).select("tree", "root", F.col("inner").alias("node"))))
    all_of = rounds[0]
    for more in rounds[1:]:
        all_of = all_of.unionByName(more)
    all_of = stored(all_of.join(parts, ["tree", "node"]))
    called = nodes.filter("type = 'MethodCallExpr' AND role = 'expression'").select("tree", F.col("parent").alias("inner"), F.lit(True).alias("call"))
    exits = direct.unionByName(bare).join(called, ["tree", "inner"], "left").filter("type IN ('ThrowStmt', 'ReturnStmt') OR type = 'ExpressionStmt' AND call")
    event = lambda rows, at, turn, change, part, negated: rows.select("tree", "root", at.alias("at"), F.lit(turn).alias("turn"), F.lit(change).alias("change"), part.alias("part"), F.lit(negated).alias("negated"))
    none = F.lit(None).cast(nodes.schema["node"].dataType)
    plain_else = all_of.filter("`else`.node IS NOT NULL AND `else`.type <> 'IfStmt'")
    events = (
        event(all_of, F.col("enter"), 1, 1, F.col("node"), True)
        .unionByName(event(all_of, F.col("then.leave"), 0, -1, none, False))
        .unionByName(event(plain_else, F.col("else.enter"), 1, 1, F.col("node"), False))
        .unionByName(event(all_of, F.col("leave"), 0, -1, none, False))
        .unionByName(event(all_of.select("tree", "root", "node").join(exits.select("tree", "node", F.col("place").alias("at")), ["tree", "node"]), F.col("at"), 2, 0, none, False))
    )
    # The height of a stack that an empty one's pop leaves alone: the running sum over its least value so far.
    by = Window.partitionBy("tree", "root").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    high = events.withColumn("sum", F.sum("change").over(by)).withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(by)))
    pushes = high.filter("change = 1").select("tree", "root", "at", "turn", F.col("height").alias("level"), F.struct("part", "negated").alias("pushed"))
    asks = high.filter("turn = 2 AND height > 0").select("tree", "root", "at", "turn", F.explode(F.sequence(F.lit(1).cast("long"), "height")).alias("level"), F.lit(None).cast(pushes.schema["pushed"].dataType).alias("pushed"))
    at_level = Window.partitionBy("tree", "root", "level").orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    found = pushes.unionByName(asks).withColumn("on", F.last("pushed", ignorenulls=True).over(at_level)).filter("turn = 2")
    return found.select("tree", "root", F.col("at").alias("place"), "level", F.col("on.part").alias("part"), F.col("on.negated").alias("negated"))


def assignments(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """(tree, node, names): for expression statements that declare or assign, the names and what each gets, as a map."""
    text = lambda role, of, name: _role(nodes, role, "part", of).join(texts.withColumnRenamed("node", "part"), ["tree", "part"]).select("tree", of, F.col("tokens").alias(name))
    words = lambda role, of, name: nodes.filter((F.col("role") == role) & F.col("tok").isNotNull()).select("tree", F.col("parent").alias(of), F.col("tok").alias(name))
    whole = nodes.filter("role = 'expression'").select("tree", F.col("node").alias("expression"), F.col("parent").alias("node"), "type")
    declared = nodes.filter("type = 'VariableDeclarator'").select("tree", F.col("node").alias("declarator"), F.col("parent").alias("expression"))
    values = declared.join(words("name", "declarator", "name"), ["tree", "declarator"]).join(text("initializer", "declarator", "value"), ["tree", "declarator"]).select("tree", "expression", "name", "value")
    target = nodes.filter("role = 'target' AND type = 'NameExpr'").select("tree", F.col("parent").alias("expression"), F.col("tok").alias("name"))
    given = target.join(text("value", "expression", "value"), ["tree", "expression"])
    both = whole.filter("type = 'VariableDeclarationExpr'").join(values, ["tree", "expression"]).unionByName(whole.filter("type = 'AssignExpr'").join(given, ["tree", "expression"]))
    return both.groupBy("tree", "node").agg(F.collect_list(F.struct("name", "value")).alias("names"))


def arguments(nodes: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """(trace, pos, tree, names): for each frame but the last, the parameters of its method and the arguments of the first call of it at the next frame's node."""
    callables = nodes.filter(F.col("type").isin(members.CALLABLES)).select("tree", "enter", "leave", F.struct("node", "type").alias("method"))
    inside = intervals.innermost(["tree"], found.select(*FRAME, (F.col("at") - 1).alias("at")), callables, "method").filter("method IS NOT NULL").select(*FRAME, "method")
    name = nodes.filter("role = 'name' AND tok IS NOT NULL").select("tree", F.col("parent").alias("of"), F.col("tok").alias("called"))
    names = nodes.filter("role = 'parameter'").select("tree", F.col("node").alias("of"), F.col("parent").alias("method_node"), "enter").join(name, ["tree", "of"])
    listed = names.groupBy("tree", "method_node").agg(F.array_sort(F.collect_list(F.struct("enter", F.col("called").alias("name")))).alias("p")).select("tree", "method_node", F.col("p.name").alias("parameters"))
    own = inside.withColumn("method_node", F.col("method.node")).join(name.withColumnRenamed("of", "method_node"), ["tree", "method_node"]).join(listed, ["tree", "method_node"], "left")
    own = own.select(*FRAME, "called", F.col("method.type").alias("method_type"), F.coalesce("parameters", F.array().cast("array<string>")).alias("parameters"))
    given = nodes.filter("role = 'argument'").select("tree", F.col("parent").alias("of"), F.col("node"), "enter").join(texts, ["tree", "node"])
    listed = given.groupBy("tree", "of").agg(F.array_sort(F.collect_list(F.struct("enter", "tokens"))).alias("g")).select("tree", "of", F.col("g.tokens").alias("given"))
    calls = nodes.filter("type = 'MethodCallExpr'").select("tree", F.col("node").alias("of"), F.col("enter").alias("call_enter")).join(name, ["tree", "of"]).join(listed, ["tree", "of"], "left")
    calls = calls.select(F.col("tree").alias("next_tree"), "call_enter", "called", F.coalesce("given", F.array().cast(f"array<{TOKEN}>")).alias("given"))
    ends = nodes.select(F.col("tree").alias("next_tree"), F.col("node").alias("next_begin"), F.col("leave").alias("next_leave"))
    nexts = found.select("trace", F.col("pos").alias("next_pos"), F.col("tree").alias("next_tree"), F.col("begin").alias("next_begin"), F.col("at").alias("next_at")).join(ends, ["next_tree", "next_begin"])
    following = found.select("trace", "pos", F.lead("pos").over(Window.partitionBy("trace").orderBy("pos")).alias("next_pos")).filter("next_pos IS NOT NULL")
    pairs = own.join(following, ["trace", "pos"]).join(nexts, ["trace", "next_pos"]).join(calls, ["next_tree", "called"]).filter("call_enter BETWEEN next_at AND next_leave")
    fits = pairs.filter((F.col("method_type") == "ConstructorDeclaration") | (F.size("given") == F.size("parameters")))
    first = fits.groupBy(*FRAME).agg(F.min_by(F.struct("parameters", "given"), "call_enter").alias("c"))
    zipped = F.zip_with("c.parameters", "c.given", lambda n, v: F.struct(n.alias("name"), v.alias("value")))
    return first.select(*FRAME, F.filter(zipped, lambda x: x["name"].isNotNull() & x["value"].isNotNull()).alias("names"))


class _Fold:
    """The text of a trace's items, given from the last one back, with what each name stands for from there on: each is read once and not again for each condition before it."""

    def __init__(self):
        self.stands, self.out = {}, []

    def _resolved(self, tokens) -> list:
        return [w for t in tokens for w in (self.stands[t["tok"]] if t["name"] and t["tok"] in self.stands else (t["tok"],))]

    def add(self, kind: str, tokens, names) -> None:
        if kind == "set":
            first = {}
            for n in [] if names is None else names:
                first.setdefault(n["name"], n["value"])
            self.stands |= {k: self._resolved(v) for k, v in first.items() if k is not None and v is not None}
        else:
            bare = kind != "not" and len(tokens) == 1
            words = [t["tok"] for t in tokens] if bare else self._resolved(tokens)
            self.out.append(("!" if kind == "not" else "") + " ".join(w for w in words if w is not None))

    def text(self) -> str:
        return " && ".join(self.out)


@F.pandas_udf(StringType())
def folded(items: pd.Series) -> pd.Series:
    """The text of a trace's items (kind, tokens, names) in order: conditions, the last one first, with what was assigned after them put in; one that is a single name stays. For traces that are values already; `folded_rows` is for rows."""

    def text(trace) -> str:
        fold = _Fold()
        for x in reversed([] if trace is None else trace):
            fold.add(x["kind"], x["tokens"], x["names"])
        return fold.text()

    return items.map(text)


def folded_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(trace, condition) of items as rows (trace, kind, tokens, names), a trace's together and its last item first. Memory holds a batch, and of a trace its text and what names stand for, never its items."""
    trace, fold, kind = None, None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([trace], kind), pa.array([fold.text()], pa.string())], names=["trace", "condition"])

    for batch in batches:
        kind = batch.schema.field("trace").type
        for k in range(0, batch.num_rows, 1000):
            for x in batch.slice(k, 1000).to_pylist():
                if fold is None or x["trace"] != trace:
                    if fold is not None:
                        yield row()
                    trace, fold = x["trace"], _Fold()
                fold.add(x["kind"], x["tokens"], x["names"])
    if fold is not None:
        yield row()


def path_conditions(nodes: DataFrame, frames: DataFrame) -> DataFrame:
    """(trace, condition) of traces given as frames (trace, pos, tree, line), pos 0 the root cause; trees must be numbered. A trace without conditions has ''."""
    texts = stored(_texts(nodes, ["condition", "compare", "iterable", "selector", "label", "initializer", "value", "argument", "expression"]).unionByName(_texts(nodes, ["variable"])))
    found = stored(begins(nodes, frames))
    around = stored(guards(nodes, found))
    earlier = stored(before(nodes, around))
    exits = stored(early_exits(nodes, earlier.filter("type = 'IfStmt'").select("tree", "node")))
    sets = stored(assignments(nodes, texts))
    none_names = F.lit(None).cast(sets.schema["names"].dataType)
    none = F.lit(None).cast(TOKEN)

    def item(rows: DataFrame, group: Column, enter: Column, first: Column, place: Column, level: Column, kind: Column, tokens: Column, names: Column) -> DataFrame:
        order = F.struct("pos", group.cast("int").alias("group"), (-enter).cast("long").alias("enter"), first.cast("long").alias("first"), place.cast("long").alias("place"), level.cast("long").alias("level"))
        return rows.select("trace", order.alias("order"), kind.alias("kind"), tokens.alias("tokens"), names.alias("names"))

    zero, sign = F.lit(0), F.lit("==")
    token = lambda t: F.array(F.struct(t.alias("tok"), F.lit(False).alias("name"))).cast(TOKEN)
    own = stored(own_items(nodes, around, texts))
    both = F.concat("tokens", token(F.when(F.col("kind") == "equal", sign).otherwise(F.lit("!="))), "other")
    assigned = F.array(F.struct(F.get("other", F.lit(0))["tok"].alias("name"), F.col("tokens").alias("value"))).cast(sets.schema["names"].dataType)
    compared = F.col("kind").isin("equal", "unequal")
    rows = [item(own, F.lit(1), F.col("enter"), F.lit(0), F.col("sub"), zero, F.when(compared, F.lit("is")).otherwise(F.col("kind")), F.when(compared, both).otherwise(F.col("tokens")), F.when(F.col("kind") == "set", assigned))]
    # Before a place in a method the nearest statement comes first; in a constructor the farthest.
    first = F.when(F.col("method_type") == "MethodDeclaration", -F.col("first")).otherwise(F.col("first"))
    rows.append(item(earlier.join(sets, ["tree", "node"]), F.lit(1), F.col("enter"), first, F.col("place"), zero, F.lit("set"), none, F.col("names")))
    conditions = _role(nodes, "condition", "cond", "part").join(texts.withColumnRenamed("node", "cond"), ["tree", "cond"]).select("tree", "part", "tokens")
    left = earlier.filter("type = 'IfStmt'").select(*FRAME, "enter", "first", F.col("node").alias("root"), "method_type").join(exits, ["tree", "root"]).join(conditions, ["tree", "part"])
    rows.append(item(left, F.lit(1), F.col("enter"), first, F.col("place"), F.col("level"), F.when(F.col("negated"), "not").otherwise("is"), F.col("tokens"), none_names))
    at_begin = found.withColumnRenamed("begin", "node")
    lowest = found.groupBy("trace").agg(F.min("pos").alias("pos"))
    whole = _role(nodes, "expression", "part", "node").join(texts.withColumnRenamed("node", "part"), ["tree", "part"]).select("tree", "node", "tokens")
    rows.append(item(at_begin.filter("begin_type = 'ExpressionStmt'").join(lowest, ["trace", "pos"], "left_semi").join(whole, ["tree", "node"]), zero, zero, zero, zero, zero, F.lit("is"), F.col("tokens"), none_names))
    rows.append(item(at_begin.join(lowest, ["trace", "pos"], "left_anti").join(sets, ["tree", "node"]), zero, zero, zero, zero, zero, F.lit("set"), none, F.col("names")))
    rows.append(item(stored(arguments(nodes, found, texts)), F.lit(2), zero, zero, zero, zero, F.lit("set"), none, F.col("names")))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    # Spark's sort brings a trace's items together, which can spill; a list of them would be one value in memory, in Java and in Python.
    last = out.repartition("trace").sortWithinPartitions("trace", F.desc("order")).select("trace", "kind", "tokens", "names")
    texts_of = last.mapInArrow(folded_rows, StructType([out.schema["trace"], StructField("condition", StringType())]))
    return frames.select("trace").distinct().join(texts_of, "trace", "left").select("trace", F.coalesce("condition", F.lit("")).alias("condition"))
