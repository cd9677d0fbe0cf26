"""Syntax trees as tables of nodes (tree, node, parent, place, type, tok, start, end): place orders a parent's children, tok is null but for leaves."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators import intervals
from millrace.operators.graph import kept, stored


def placed(nodes: DataFrame, stop: Column | None = None) -> DataFrame:
    """The nodes that a walk from the roots (parent null) meets, with `path`, the places down to them; below a node for which stop holds it doesn't go.

    Paths sort in the order of a depth-first walk, their lengths first in that of a breadth-first one. Each round of joins goes down
    one level and is written.
    """
    marked = kept(nodes.withColumn("__stop", F.coalesce(stop, F.lit(False)) if stop is not None else F.lit(False)))
    rounds = [kept(marked.filter("parent IS NULL").withColumn("path", F.array("place")))]
    while not rounds[-1].isEmpty():
        above = rounds[-1].filter("NOT __stop").select("tree", F.col("node").alias("parent"), F.col("path").alias("__above"))
        rounds.append(kept(marked.join(above, ["tree", "parent"]).withColumn("path", F.concat("__above", F.array("place"))).select(*rounds[0].columns)))
    return reduce(DataFrame.unionByName, rounds).drop("__stop")


def walked(nodes: DataFrame, stop: Column | None = None, breadth_first: bool = False) -> DataFrame:
    """(tree, node, type, step): the nodes in the order of a walk, steps from 0 in each tree."""
    order = [F.size("path"), F.col("path")] if breadth_first else [F.col("path")]
    w = Window.partitionBy("tree").orderBy(*order)
    return placed(nodes, stop).select("tree", "node", "type", (F.row_number().over(w) - 1).cast("long").alias("step"))


def found(nodes: DataFrame, types: list[str], first: bool = False, below_root: bool = False) -> DataFrame:
    """(tree, node, path) of the nodes of these types: all, the first of each tree in a depth-first walk, or only the roots' own children."""
    some = placed(nodes).filter(F.col("type").isin(types)).select("tree", "node", "path")
    if below_root:
        some = some.filter(F.size("path") == 2)
    if first:
        some = some.groupBy("tree").agg(F.min(F.struct("path", "node")).alias("x")).select("tree", "x.node", "x.path")
    return some


def spans(nodes: DataFrame) -> DataFrame:
    """(tree, node, size, first_line, last_line, first_leaf, leaves) of each node's subtree: its nodes, its lines, and its leaves as a range of the tree's.

    Subtrees are intervals of a walk (`intervals.numbered`), so no row is written for a node and what is above it, however deep a tree is.
    """
    down = stored(intervals.numbered(nodes))
    lines = intervals.extremes(down, "start", "end").select("tree", "node", F.col("start").alias("first_line"), F.col("end").alias("last_line"))
    return down.select("tree", "node", intervals.size().alias("size"), "first_leaf", "leaves").join(lines, ["tree", "node"])


def statements(nodes: DataFrame, terminal: list[str]) -> DataFrame:
    """(tree, node, number, first_line, last_line) of the terminal statements in order; a tree with two of them on one line is an error when read.

    The walk doesn't go below a terminal statement; the lines are those of its subtree.
    """
    kinds = F.col("type").isin(terminal)
    own = placed(nodes, kinds).filter(kinds).select("tree", "node", "path").join(spans(nodes).select("tree", "node", "first_line", "last_line"), ["tree", "node"])
    w = Window.partitionBy("tree").orderBy("path")
    out = own.withColumn("number", (F.row_number().over(w) - 1).cast("long")).withColumn("before", F.lag("last_line").over(w))
    clash = F.when(F.col("first_line") <= F.col("before"), F.raise_error(F.lit("several statements on one line")).cast("boolean")).otherwise(F.lit(True))
    return out.filter(F.coalesce(clash, F.lit(True))).select("tree", "node", "number", "first_line", "last_line")
