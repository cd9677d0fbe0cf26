"""Removing throws from methods given as tables of nodes (tree, node, parent, place, type, tok): five passes, each over all trees at once.

A statement is a node whose type ends in Stmt; leaves that carry a tok are the source's tokens. A pass finds the nodes that go with their
subtrees and those that are taken out and leave their children where they were; numbers given once by a walk stay right, as nothing changes its order. How far a
removal goes up is one lookup of an interval, what an if becomes is found by doubling pointers, and only switches in switches take a round for each depth.

Passes: blocks of one statement, if-throw, catch-throw, switch-throw, rest-throw. Each of the last four writes a marker row for what it meets. A body that is removed takes its
statement along: that of an if's then, of a loop, of a label and of a lambda; an else that is removed goes alone, with its keyword.

Defined results where the method's source would stop the tool: an if whose then goes away goes too, whatever its else is; a switch inside a switch's entry is handled as any other
outside a block; a last entry without statements leaves nothing. An entry that comes to stand for its switch outside a block has no braces among its tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.operators.graph import stored

LOOPS = ["ForStmt", "ForEachStmt", "WhileStmt", "DoStmt", "LabeledStmt"]
#: What takes any statement where it has a block.
TAKES_STATEMENT = ["IfStmt", *LOOPS, "LambdaExpr", "BlockStmt", "SwitchEntry"]
IF, CATCH, SWITCH, REST = "if-throw", "catch-throw", "switch-throw", "rest-throw"
KEY = ["tree", "node"]


def _is_statement() -> Column:
    return F.col("type").endswith("Stmt")


def _placed(nodes: DataFrame) -> DataFrame:
    """The statements below other nodes with their parent's type, their number among its statements from 1, and how many it has."""
    within = Window.partitionBy("tree", "parent")
    own = nodes.filter(_is_statement() & F.col("parent").isNotNull()).select(*KEY, "parent", "type", "enter", "leave")
    own = own.withColumn("nth", F.row_number().over(within.orderBy("enter"))).withColumn("many", F.count("*").over(within))
    return own.join(nodes.select("tree", F.col("node").alias("parent"), F.col("type").alias("parent_type")), ["tree", "parent"])


#: What goes inside of some nodes, by `how`: all children but `keep`, all that are no statements, or the keyword of an else.
INSIDE = ["tree", "parent", "how", "keep"]


def _gone_inside() -> Column:
    return F.expr("how = 'all' AND (keep IS NULL OR node <> keep) OR how = 'rest' AND NOT type LIKE '%Stmt' OR how = 'else' AND tok = 'else'")


def _inside(rows: DataFrame, how: str, keep: Column | None = None) -> DataFrame:
    """Rows (tree, node) as what goes inside of these nodes."""
    return rows.select("tree", F.col("node").alias("parent"), F.lit(how).alias("how"), (F.lit(None).cast("long") if keep is None else keep).alias("keep"))


def _innermost(rows: DataFrame) -> DataFrame:
    """The rows (tree, enter, leave, ...) with no other one inside."""
    after = F.lead("enter").over(Window.partitionBy("tree").orderBy("enter"))
    return rows.withColumn("__next", after).filter("__next IS NULL OR __next > leave").drop("__next")


def _chains(nodes: DataFrame, placed: DataFrame) -> DataFrame:
    """(tree, node, chain): each statement with the outermost one that can't be without it: itself, or what it is the then or the body of, and so on."""
    falls = (F.col("parent_type") == "IfStmt") & (F.col("nth") == 1) | F.col("parent_type").isin([*LOOPS, "LambdaExpr"])
    stands = placed.filter(~falls).select("tree", "enter", "leave", F.col("node").alias("chain"))
    stands = stands.unionByName(nodes.filter("type = 'LambdaExpr'").select("tree", "enter", "leave", F.col("node").alias("chain")))
    return intervals.innermost(["tree"], placed.select(*KEY, F.col("enter").alias("at")), stands, "chain").select(*KEY, "chain")


def _elses(placed: DataFrame, gone: DataFrame) -> DataFrame:
    """(tree, node): the ifs whose else is in gone."""
    return placed.filter("parent_type = 'IfStmt' AND nth = 2").join(gone.select(*KEY), KEY, "left_semi").select("tree", F.col("parent").alias("node"))


def _tops(chains: DataFrame, gone: DataFrame) -> DataFrame:
    """(tree, node): the outermost statements that can't be without those in gone."""
    return stored(chains.join(gone.select(*KEY), KEY, "left_semi").select("tree", F.col("chain").alias("node")).distinct())


def unwrapped(nodes: DataFrame) -> DataFrame:
    """Blocks of one statement give way to it where any statement may stand; what is below such a block is left as it is."""
    one = _placed(nodes).filter("many = 1").select("tree", F.col("parent").alias("node"), F.col("node").alias("only"))
    takes = nodes.filter(F.col("type").isin(TAKES_STATEMENT)).select("tree", F.col("node").alias("parent"))
    fits = nodes.filter("type = 'BlockStmt'").select(*KEY, "parent").join(one, KEY).join(takes, ["tree", "parent"], "left_semi").select(*KEY, "only")
    marked = nodes.join(stored(fits), KEY, "left").withColumn("__below", intervals.enclosed(F.col("only").isNotNull()))
    outer = stored(marked.filter("only IS NOT NULL AND NOT __below").select(*KEY, "only"))
    return intervals.without(nodes, outer.limit(0), outer, _inside(outer, "all", F.col("only")), _gone_inside())


def _ifs(placed: DataFrame) -> DataFrame:
    """Every if (tree, node, parent, parent_type, enter, leave) with its then and else: node and type."""
    parts = placed.filter("parent_type = 'IfStmt'").groupBy("tree", F.col("parent").alias("node"))
    part = lambda c, n: F.max(F.when(F.col("nth") == n, F.col(c)))
    found = parts.agg(part("node", 1).alias("then"), part("type", 1).alias("then_type"), part("node", 2).alias("else"), part("type", 2).alias("else_type"))
    return placed.filter("type = 'IfStmt'").select(*KEY, "parent", "parent_type", "enter", "leave").join(found, KEY)


def _resolved(links: DataFrame) -> DataFrame:
    """(tree, node, value) of a table (tree, node, next, value): the value at the end of each list, by doubling its pointers."""
    now = stored(links)
    while not now.filter("next IS NOT NULL").isEmpty():
        ahead = now.select("tree", F.col("node").alias("next"), F.col("next").alias("__next"), F.col("value").alias("__value"), F.lit(True).alias("__hit"))
        now = stored(now.join(ahead, ["tree", "next"], "left").select("tree", "node", F.col("__next").alias("next"), F.when(F.col("__hit"), F.col("__value")).otherwise(F.col("value")).alias("value")))
    return now.select("tree", "node", "value")


def if_throws(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, markers): an if that throws gives way to its else; an else that throws goes.

    An if with a throw as its then goes with its parent where that is a switch's entry; else its else, if it has one that isn't a throw and stays, takes its place, a block's statements one by one in a block. An if is marked
    when it throws so, and also whenever it has an else, as the tool does.
    """
    placed = stored(_placed(nodes))
    ifs = stored(_ifs(placed))
    chains = stored(_chains(nodes, placed))
    throws = ifs.filter("then_type = 'ThrowStmt'")
    # An else goes if the if at the end of its chain throws and goes; a chain has one such if at most.
    end = chains.join(throws.select(*KEY), KEY, "left_semi").select("tree", F.col("node").alias("next"), F.col("chain").alias("else"))
    no_else = F.col("else").isNull() | (F.col("else_type") == "ThrowStmt")
    links = throws.join(end, ["tree", "else"], "left").withColumn("next", F.when(~no_else, F.col("next")))
    gone_of = _resolved(links.select("tree", "node", "next", no_else.alias("value"))).withColumnRenamed("value", "goes")
    throws = stored(throws.join(gone_of, KEY).withColumn("fate", F.when(F.col("parent_type") == "SwitchEntry", "entry").when(F.col("goes"), "goes").otherwise("else")))
    swapped = throws.filter("fate = 'else'")
    # What takes the place of an if whose else is another that gives way is the last one's else.
    last = swapped.select("tree", F.col("node").alias("next"), F.lit(True).alias("hit"))
    into = _resolved(swapped.withColumn("next", F.col("else")).join(last, ["tree", "next"], "left").select("tree", "node", F.when(F.col("hit"), F.col("next")).alias("next"), F.struct("else", "else_type").alias("value")))
    spread = stored(swapped.filter("parent_type = 'BlockStmt'").join(into, KEY).filter("value.else_type = 'BlockStmt'").select("tree", F.col("value.else").alias("node")))
    goes = throws.filter("fate = 'goes'")
    ends = ifs.filter("then_type <> 'ThrowStmt' AND else_type = 'ThrowStmt'").select("tree", F.col("else").alias("node"))
    tops = _tops(chains, goes)
    kill = tops.unionByName(throws.filter("fate = 'entry'").select("tree", F.col("parent").alias("node"))).unionByName(ends)
    inside = _inside(swapped, "all", F.col("else")).unionByName(_inside(spread, "rest")).unionByName(_inside(_elses(placed, tops.unionByName(ends)), "else"))
    # Nulls: what is at or above an if that goes, on its chain.
    low = chains.join(goes.select(*KEY, "enter"), KEY).select("tree", "chain", F.col("enter").alias("low"))
    nulls = stored(chains.join(placed.select(*KEY, "enter"), KEY).join(low, ["tree", "chain"]).filter("enter <= low").select(*KEY, F.lit(True).alias("null")).distinct())
    seen = ifs
    for part in ("then", "else"):
        seen = seen.join(nulls.select("tree", F.col("node").alias(part), F.col("null").alias(f"no_{part}")), ["tree", part], "left")
    marked = stored(seen.filter("then_type = 'ThrowStmt' OR `else` IS NOT NULL AND (no_else IS NULL OR no_then IS NOT NULL)").select("tree", F.lit(IF).alias("marker")))
    return intervals.without(nodes, stored(kill), stored(swapped.select(*KEY).unionByName(spread)), stored(inside), _gone_inside()), marked


def catch_throws(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, markers): catches with a throw among their statements go; a try without catches gives way to its statements and those of its finally, as a block where it isn't in one."""
    throwing = _placed(nodes).filter("type = 'ThrowStmt' AND parent_type = 'BlockStmt'").select("tree", F.col("parent").alias("block"))
    blocks = nodes.filter("type = 'BlockStmt'").select("tree", F.col("node").alias("block"), F.col("parent").alias("node")).join(throwing, ["tree", "block"], "left_semi")
    hit = nodes.filter("type = 'CatchClause'").select(*KEY).join(blocks.select(*KEY), KEY, "left_semi").withColumn("__hit", F.lit(True))
    marked = nodes.join(hit, KEY, "left").withColumn("__hit", F.coalesce("__hit", F.lit(False)))
    outer = stored(marked.withColumn("__below", intervals.enclosed(F.col("__hit"))).filter("__hit AND NOT __below").select(*KEY))
    nodes = intervals.without(nodes, outer)
    placed = stored(_placed(nodes))
    bare = placed.filter("type = 'TryStmt'").select(*KEY, F.col("parent_type").alias("outside"), F.col("leave").alias("edge"))
    bare = stored(bare.join(nodes.filter("type = 'CatchClause'").select("tree", F.col("parent").alias("node")), KEY, "left_anti"))
    own = placed.filter("parent_type = 'TryStmt' AND type = 'BlockStmt'").select("tree", F.col("node").alias("block"), F.col("parent").alias("node"), "nth")
    own = stored(own.join(bare, KEY).withColumn("stays", F.expr("nth = 1 AND outside <> 'BlockStmt'")))
    # Outside a block the try's own block stays, up to the try's end: its closing brace moves there, behind the statements of the finally.
    stays = stored(own.filter("stays").select("tree", "block", "edge"))
    opened = own.filter("NOT stays").select("tree", F.col("block").alias("node"))
    wide = nodes.join(stays.select("tree", F.col("block").alias("node"), F.col("edge").alias("__to")), KEY, "left")
    wide = wide.join(stays.select("tree", F.col("block").alias("parent"), F.col("edge").alias("__edge")), ["tree", "parent"], "left")
    closes = (F.col("tok") == "}") & F.col("__edge").isNotNull()
    enter, leave = F.when(closes, F.col("__edge") - 2).otherwise(F.col("enter")), F.when(closes, F.col("__edge") - 1).otherwise(F.coalesce("__to", "leave"))
    wide = stored(wide.select(*[c for c in nodes.columns if c not in ("enter", "leave")], enter.alias("enter"), leave.alias("leave")).select(*nodes.columns))
    drop = stored(bare.select(*KEY).unionByName(opened))
    return intervals.without(wide, drop.limit(0), drop, _inside(drop, "rest"), _gone_inside()), outer.select("tree", F.lit(CATCH).alias("marker"))


def switch_throws(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, markers): entries whose first statement is a throw go, with the empty ones that fall through to them; a switch of one entry gives way to its statements without a last break, one of none goes."""
    done, markers = nodes.select(*KEY).limit(0), nodes.select("tree", F.lit(SWITCH).alias("marker")).limit(0)
    order = Window.partitionBy("tree", "switch").orderBy("enter")
    while True:
        now = stored(_innermost(nodes.filter("type = 'SwitchStmt' AND parent IS NOT NULL").join(done, KEY, "left_anti").select(*KEY, "parent", "enter", "leave")))
        if now.isEmpty():
            return nodes, markers
        all_placed = stored(_placed(nodes))
        placed = all_placed.filter("parent_type = 'SwitchEntry'").select("tree", F.col("parent").alias("entry"), "node", "type", "nth", "many")
        firsts = placed.filter("nth = 1").select("tree", "entry", F.col("type").alias("first"))
        entries = nodes.filter("type = 'SwitchEntry'").join(now.select("tree", F.col("node").alias("parent")), ["tree", "parent"], "left_semi").select("tree", F.col("node").alias("entry"), F.col("parent").alias("switch"), "enter").join(firsts, ["tree", "entry"], "left")
        # An empty entry falls through to the next one that isn't.
        follows = F.first("first", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing))
        entries = stored(entries.withColumn("goes", F.coalesce(follows == "ThrowStmt", F.lit(False))))
        markers = stored(markers.unionByName(entries.filter("first = 'ThrowStmt'").select("tree", F.lit(SWITCH).alias("marker"))))
        left = entries.groupBy("tree", "switch").agg(F.count_if(~F.col("goes")).alias("many"), F.max(F.when(~F.col("goes"), F.col("entry"))).alias("entry"))
        left = now.select("tree", F.col("node").alias("switch"), "parent").join(left, ["tree", "switch"], "left").withColumn("many", F.coalesce("many", F.lit(0)))
        left = stored(left.join(nodes.select("tree", F.col("node").alias("parent"), F.col("type").alias("parent_type")), ["tree", "parent"]))
        one = left.filter("many = 1")
        tops = _tops(stored(_chains(nodes, all_placed)), left.filter("many = 0").select("tree", F.col("switch").alias("node")))
        breaks = placed.filter("nth = many AND type = 'BreakStmt'").join(one.select("tree", "entry"), ["tree", "entry"], "left_semi").select(*KEY)
        kill = stored(tops.unionByName(breaks).unionByName(entries.filter("goes").select("tree", F.col("entry").alias("node"))))
        within = _inside(one.withColumnRenamed("switch", "node"), "all", F.col("entry")).unionByName(_inside(one.withColumnRenamed("entry", "node"), "rest")).unionByName(_inside(_elses(all_placed, tops), "else"))
        inside = one.filter("parent_type = 'BlockStmt'").select("tree", F.col("entry").alias("node"))
        outside = one.filter("parent_type <> 'BlockStmt'").select("tree", F.col("entry").alias("node"), F.lit("BlockStmt").alias("__type"))
        typed = nodes.join(outside, KEY, "left").withColumn("type", F.coalesce("__type", "type")).select(*nodes.columns)
        done = stored(done.unionByName(now.select(*KEY)))
        nodes = intervals.without(stored(typed), kill, stored(one.select("tree", F.col("switch").alias("node")).unionByName(inside)), stored(within), _gone_inside())


def rest_throws(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, markers): every throw that is left goes."""
    throws = stored(nodes.filter("type = 'ThrowStmt'").select(*KEY))
    placed = stored(_placed(nodes))
    tops = _tops(stored(_chains(nodes, placed)), throws)
    return intervals.without(nodes, tops, None, stored(_inside(_elses(placed, tops), "else")), _gone_inside()), throws.select("tree", F.lit(REST).alias("marker"))


def removed(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the nodes that are left, numbered; (tree, marker) for every removal), by all five passes in their order."""
    nodes = stored(unwrapped(stored(intervals.numbered(nodes))))
    markers = []
    for one_pass in (if_throws, catch_throws, switch_throws, rest_throws):
        nodes, found = one_pass(nodes)
        markers.append(stored(found))
    out = markers[0]
    for more in markers[1:]:
        out = out.unionByName(more)
    return nodes, out
