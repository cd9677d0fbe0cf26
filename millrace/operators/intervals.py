"""Trees as nested intervals: every node of a table (tree, node, parent, place, ...) gets the places at which a walk enters and leaves it.

With them a subtree, an ancestor and the innermost thing around a place are range comparisons, and nothing is written for each pair of a node and an
ancestor. Numbering takes as many rounds of joins as the longest walk has doublings, however deep a tree is, and only the first pass is over all nodes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators.graph import stored


SUMS = ("length", "nodes", "rise", "leaves")


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes with both of their elements moved on, within their batch, to the last one before the walk leaves it: where it goes from there, and the weights up to there.

    Any batches are right; the more of a subtree one holds, the fewer elements are left to go to. What runs into a cycle has no end.
    """
    for batch in batches:
        n = batch.num_rows
        names = batch.schema.names[:-7]
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        frame = lambda node: pd.DataFrame({"tree": column("tree").to_pandas(), "node": column(node).to_pandas()})
        place = frame("node").assign(at=np.arange(n)).drop_duplicates(["tree", "node"])
        nexts = []
        for side in ("into", "out"):
            more, low = column(f"{side}_more").to_numpy(zero_copy_only=False), column(f"{side}_side").to_numpy(zero_copy_only=False)
            at = frame(f"{side}_to").merge(place, "left", ["tree", "node"])["at"].fillna(-1).to_numpy(np.int64)
            nexts.append(np.where(more & (at >= 0), at + low * n, -1))
        to, last, leaf = np.concatenate(nexts), np.arange(2 * n), column("__leaf").to_numpy(zero_copy_only=False)
        one, zero = np.ones(n, np.int64), np.zeros(n, np.int64)
        sums = np.stack([np.concatenate(x) for x in ((one, one), (one, zero), (one, -one), (leaf.astype(np.int64), zero))])
        reach = 1
        while (on := np.flatnonzero(to >= 0)).size and reach <= 4 * n:
            ahead = to[on]
            sums[:, on] = sums[:, on] + sums[:, ahead]
            last[on], to[on] = last[ahead], to[ahead]
            reach *= 2
        both = lambda c: pa.concat_arrays([column(f"into_{c}"), column(f"out_{c}")]).take(pa.array(last))
        lost, more = to >= 0, both("more").to_numpy(zero_copy_only=False)
        found = {"to": both("to"), "side": both("side"), "more": pa.array(more & ~lost), "whole": pa.array(~more & ~lost)} | {k: pa.array(v) for k, v in zip(SUMS, sums, strict=True)}
        cells = {c: column(c) for c in names} | {f"{side}_{k}": v.slice(i * n, n) for i, side in enumerate(("into", "out")) for k, v in found.items()}
        yield pa.RecordBatch.from_pydict(cells)


def numbered(nodes: DataFrame) -> DataFrame:
    """The nodes that a walk from the roots (parent null) meets, with `enter` and `leave`, their places in the walk in and out of all nodes; `step`, their
    place among nodes in depth-first order; `depth`; `first_leaf` and `leaves`, their subtree's leaves (tok not null) as a range of the tree's.

    The walk is a linked list of 2 elements for each node. Nodes are dealt by ranges of their ids and the list is first shortened within batches of them; pointers are doubled
    only among the elements that other batches go to, until all reach the end, each round written. Siblings go by place, then
    node; several roots of a tree are siblings. Nodes under a missing parent or on a cycle of parents aren't met and not returned.
    """
    own = stored(nodes.filter("tree IS NOT NULL AND node IS NOT NULL"))
    siblings = Window.partitionBy("tree", "parent").orderBy("place", "node")
    nexts = own.withColumn("__next", F.lead("node").over(siblings))
    firsts = own.filter("parent IS NOT NULL").groupBy("tree", F.col("parent").alias("node")).agg(F.min_by("node", F.struct("place", "node")).alias("__first"))
    rest = ["tree", "node", *[c for c in own.columns if c not in ("tree", "node")]]
    to = F.coalesce("__next", "parent", "node")
    linked = nexts.join(firsts, ["tree", "node"], "left").select(
        *rest, F.col("tok").isNotNull().alias("__leaf"), F.coalesce("__first", "node").alias("into_to"), F.col("__first").isNull().cast("int").alias("into_side"), F.lit(True).alias("into_more"),
        to.alias("out_to"), F.col("__next").isNull().cast("int").alias("out_side"), F.coalesce("__next", "parent").isNotNull().alias("out_more"),
    )
    sides = ", ".join(f"{s}_to {own.schema['node'].dataType.simpleString()}, {s}_side int, {s}_more boolean, {s}_whole boolean, {', '.join(f'{s}_{k} long' for k in SUMS)}" for s in ("into", "out"))
    shape = StructType([*own.select(*rest).schema.fields, *StructType.fromDDL(sides).fields])
    near = stored(linked.repartitionByRange("tree", "node").sortWithinPartitions("tree", "node").mapInArrow(_contracted, shape))
    side = lambda s, i: F.struct(F.lit(i).alias("side"), *[F.col(f"{s}_{k}").alias(k) for k in ("to", "more", "whole", *SUMS)], F.col(f"{s}_side").alias("to_side"))
    elements = near.select("tree", "node", F.explode(F.array(side("into", 0), side("out", 1))).alias("e")).select("tree", "node", "e.*")
    goals = stored(elements.filter("more").select("tree", F.col("to").alias("node"), F.col("to_side").alias("side")).distinct())
    walk = stored(elements.join(goals, ["tree", "node", "side"], "left_semi"))
    most, reach = walk.count(), 1
    while not walk.filter("more").isEmpty() and reach <= 2 * most:
        ahead = walk.select("tree", F.col("node").alias("to"), F.col("side").alias("to_side"), F.col("to").alias("__to"), F.col("to_side").alias("__to_side"), F.col("more").alias("__more"), F.col("whole").alias("__whole"), *[F.col(c).alias(f"__{c}") for c in SUMS])
        moved = walk.filter("more").join(ahead, ["tree", "to", "to_side"])
        moved = moved.select("tree", "node", "side", F.col("__to").alias("to"), F.col("__to_side").alias("to_side"), F.col("__more").alias("more"), F.col("__whole").alias("whole"), *[(F.col(c) + F.col(f"__{c}")).alias(c) for c in SUMS])
        walk, reach = stored(walk.filter("NOT more").unionByName(moved)), 2 * reach
    ends = stored(walk.filter("NOT more AND whole").select("tree", "node", "side", *SUMS))
    whole = near
    for s in ("into", "out"):
        end = ends.select("tree", F.col("node").alias(f"{s}_to"), F.col("side").alias(f"{s}_side"), F.lit(True).alias("__met"), *[F.col(c).alias(f"__{c}") for c in SUMS])
        joined = whole.join(end, ["tree", f"{s}_to", f"{s}_side"], "left").filter(f"{s}_whole OR {s}_more AND __met")
        whole = joined.withColumns({f"{s}_{c}": F.col(f"{s}_{c}") + F.when(F.col(f"{s}_more"), F.col(f"__{c}")).otherwise(0) for c in SUMS}).drop("__met", *[f"__{c}" for c in SUMS])
    total = stored(whole.filter("parent IS NULL").groupBy("tree").agg(*[F.max(f"into_{c}").alias(f"all_{c}") for c in ("length", "nodes", "leaves")]))
    return whole.join(total, "tree").select(
        *rest, (F.col("all_length") - F.col("into_length")).alias("enter"), (F.col("all_length") - F.col("out_length")).alias("leave"), (F.col("all_nodes") - F.col("into_nodes")).alias("step"),
        (-F.col("into_rise")).alias("depth"), (F.col("all_leaves") - F.col("into_leaves")).alias("first_leaf"), (F.col("into_leaves") - F.col("out_leaves")).alias("leaves"),
    )


def size() -> Column:
    """The nodes of a subtree, itself included."""
    return ((F.col("leave") - F.col("enter") + 1) / 2).cast("long")


def extremes(numbered: DataFrame, low: str, high: str) -> DataFrame:
    """(tree, node, low, high): the least `low` and the greatest `high` in each node's subtree; nulls count for nothing.

    A subtree is a range of steps. Extremes of ranges of 1, 2, 4, ... steps come from those of half the length, and any range is two of them that overlap.
    """
    ask = stored(numbered.select("tree", "node", "step", size().alias("size"), F.floor(F.log2(size() + 0.5)).cast("int").alias("power")))
    level = stored(numbered.select("tree", "step", F.col(low).alias("low"), F.col(high).alias("high")))
    found, power = [], 0
    while True:
        now, long = ask.filter(F.col("power") == power), 1 << power
        other = level.select("tree", F.col("step").alias("last"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        joined = now.withColumn("last", F.col("step") + F.col("size") - long).join(level, ["tree", "step"]).join(other, ["tree", "last"])
        found.append(joined.select("tree", "node", F.least("low", "low2").alias(low), F.greatest("high", "high2").alias(high)))
        if ask.filter(F.col("power") > power).isEmpty():
            break
        after = level.select("tree", (F.col("step") - long).alias("step"), F.col("low").alias("low2"), F.col("high").alias("high2"))
        level = stored(level.join(after, ["tree", "step"]).select("tree", "step", F.least("low", "low2").alias("low"), F.greatest("high", "high2").alias("high")))
        power += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def innermost(keys: list[str], points: DataFrame, spans: DataFrame, value: str) -> DataFrame:
    """The points (keys, at, ...) with `value` of the innermost span (keys, enter, leave, value) around them; null where there is none.

    Spans must be nested or apart. Places where they open and close raise and lower a level; the innermost span around a point is the last that
    opened at the point's level. So two sorts by place find it, as an as-of join does, and no point meets all spans. A point lies in the spans that open at or before it and close after it.
    """
    kind, columns = spans.schema[value].dataType, [c for c in points.columns if c not in keys]
    none = F.lit(None)
    own = points.select(*keys, F.col("at").alias("__at"), F.lit(2).alias("__turn"), F.lit(0).alias("__change"), none.cast(kind).alias("__value"), F.struct(*columns).alias("__point"))
    blank = none.cast(own.schema["__point"].dataType).alias("__point")
    opens = spans.select(*keys, F.col("enter").alias("__at"), F.lit(1).alias("__turn"), F.lit(1).alias("__change"), F.col(value).alias("__value"), blank)
    ends = spans.select(*keys, F.col("leave").alias("__at"), F.lit(0).alias("__turn"), F.lit(-1).alias("__change"), none.cast(kind).alias("__value"), blank)
    by = Window.partitionBy(*keys).orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    level = own.unionByName(opens).unionByName(ends).withColumn("__level", F.sum("__change").over(by)).filter("__change >= 0")
    last = Window.partitionBy(*keys, "__level").orderBy("__at", "__turn").rowsBetween(Window.unboundedPreceding, 0)
    got = F.when(F.col("__level") > 0, F.last(F.when(F.col("__change") == 1, F.struct("__value")), ignorenulls=True).over(last)["__value"])
    return level.withColumn(value, got).filter("__point IS NOT NULL").select(*keys, "__point.*", value)


def enclosed(mark: Column) -> Column:
    """Whether a node of a numbered table lies below a marked one; a column of a window over its tree."""
    before = Window.partitionBy("tree").orderBy("enter").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.max(F.when(mark, F.col("leave"))).over(before) > F.col("leave"), F.lit(False))


def without(nodes: DataFrame, kill: DataFrame, drop: DataFrame | None = None, inside: DataFrame | None = None, part: Column | None = None) -> DataFrame:
    """A numbered table without the subtrees of kill (tree, node) and without the single nodes of drop, whose children go to the nearest ancestor that is left.

    With inside (tree, parent, and other columns), subtrees of children of these parents go too, those for which `part` holds.
    """
    kill = kill.select("tree", "node").distinct().withColumn("__kill", F.lit(True))
    marked, gone = nodes.join(kill, ["tree", "node"], "left"), F.coalesce("__kill", F.lit(False))
    if inside is not None:
        marked = marked.join(inside.withColumn("__in", F.lit(True)), ["tree", "parent"], "left")
        gone = gone | F.coalesce(F.col("__in") & part, F.lit(False))
    marked = marked.select(*nodes.columns, gone.alias("__gone"))
    left = marked.withColumn("__below", enclosed(F.col("__gone"))).filter("NOT __gone AND NOT __below").select(*nodes.columns)
    if drop is None:
        return stored(left)
    left = stored(left.join(drop.select("tree", "node").distinct(), ["tree", "node"], "left_anti"))
    points = left.drop("parent").withColumn("at", F.col("enter") - 1)
    return stored(innermost(["tree"], points, left.select("tree", "enter", "leave", F.col("node").alias("parent")), "parent").select(*nodes.columns))


def texts(nodes: DataFrame) -> DataFrame:
    """(tree, text): the leaves of each tree of a numbered table in order, one space between them."""
    leaves = nodes.filter("tok IS NOT NULL").groupBy("tree").agg(F.array_sort(F.collect_list(F.struct("enter", "tok"))).alias("leaves"))
    return leaves.select("tree", F.array_join("leaves.tok", " ").alias("text"))
