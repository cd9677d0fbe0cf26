"""Call graphs as edge tables (src, dst, label): neighbours, simple paths, ancestors."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The session's checkpoint folder, which all executors share; on one machine a temporary one serves where none is named."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="millrace-"))
    return context.getCheckpointDir()


def kept(df: DataFrame) -> DataFrame:
    """The rows, written once to the checkpoint folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """The rows, written once as Parquet to the checkpoint folder, where they stay until the application ends.

    Unlike those of a checkpoint their size is known, so small sides of joins are broadcast; a checkpoint keeps the estimate of its plan, which many rounds of joins multiply
    until computing it takes longer than the joins.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


def parts(df: DataFrame, rows: int = 1_000_000) -> int | None:
    """A partition for each million rows of a stored table, so a task's memory doesn't grow with it; none where a shuffle makes as many anyway, which is left to Spark."""
    n = -(-df.count() // rows)
    return n if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def spread(df: DataFrame, *keys: str, rows: int = 1_000_000) -> DataFrame:
    """A stored table dealt by the keys to as many partitions."""
    n = parts(df, rows)
    return df.repartition(n, *keys) if n else df


def call_paths(edges: DataFrame, start: DataFrame, depth: int | None = 10) -> DataFrame:
    """(start, path) of all simple call paths from each start to a leaf, cut at depth nodes, or whole if depth is None.

    C edges are calls; an O edge (overrider, overridden) is followed backwards, except at the start. A start without calls is a path.
    Each round of joins adds a node and is written. Edges and starts are made distinct, not the paths, which then come once each; an edge knows whether its end
    calls or is overridden, so only paths that can go on meet the edges.
    """
    calls = edges.filter("label = 'C'").select("src", "dst", F.lit(False).alias("over"))
    each = stored(calls.unionByName(edges.filter("label = 'O'").select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("over"))))
    ends = stored(each.groupBy(F.col("src").alias("dst")).agg(F.bool_or(~F.col("over")).alias("calls"), F.bool_or("over").alias("overridden")))
    no = F.lit(False)
    e = spread(each, "src", "dst").groupBy("src", "dst").agg(F.bool_and("over").alias("over")).join(ends, "dst", "left")
    e = stored(e.select("src", "dst", "over", *[F.coalesce(c, no).alias(c) for c in ("calls", "overridden")]))
    first = start.select(F.col("id").alias("dst")).distinct().join(ends, "dst", "left")
    rounds = [stored(first.select(F.col("dst").alias("start"), F.col("dst").alias("node"), F.array("dst").alias("path"), F.coalesce("calls", no).alias("calls"), no.alias("overridden")))]
    while (depth is None or len(rounds) < depth) and not rounds[-1].filter("calls OR overridden").isEmpty():
        on = [rounds[-1].filter(kind).select("start", "node", "path").join(e.filter(edge), F.col("src") == F.col("node")) for kind, edge in (("calls", "NOT over"), ("overridden", "over"))]
        grown = on[0].unionByName(on[1]).filter(~F.array_contains("path", F.col("dst")))
        rounds.append(stored(grown.select("start", F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"), "calls", "overridden")))
    found = reduce(DataFrame.unionByName, rounds).filter("NOT calls" if depth is None else f"NOT calls OR size(path) = {depth}").select("start", "path")
    rest = rounds[0].filter("calls").join(found.select("start").distinct(), "start", "left_anti")
    return found.unionByName(rest.select("start", "path"))


def ancestors(parents: DataFrame) -> DataFrame:
    """(node, ancestor, distance) along a table (node, parent), at any distance, the least where there are several; a node is its own at 0.

    Paths are doubled: what is reached in fewer than 2^k steps, and from there what is exactly 2^k steps further. So rounds follow the logarithm of the longest
    shortest path; they end when nothing new is reached, on cycles too.
    """
    up = stored(parents.select("node", "parent").distinct())
    reached = stored(up.select("node", F.col("node").alias("ancestor")).distinct().withColumn("distance", F.lit(0)))
    jump, steps, n = up.filter("parent IS NOT NULL").select(F.col("node").alias("ancestor"), F.col("parent").alias("far")), 1, reached.count()
    while True:
        further = reached.join(jump, "ancestor").select("node", F.col("far").alias("ancestor"), (F.col("distance") + steps).alias("distance"))
        reached = stored(reached.unionByName(further).groupBy("node", "ancestor").agg(F.min("distance").alias("distance")))
        if (now := reached.count()) == n:
            return reached
        n, steps = now, 2 * steps
        jump = stored(jump.join(jump.select(F.col("ancestor").alias("far"), F.col("far").alias("next")), "far").select("ancestor", F.col("next").alias("far")).distinct())


def members(parents: DataFrame, own: DataFrame) -> DataFrame:
    """(node, signature, owner): a class's members and those it inherits; the nearest of one signature, private ones of its own only."""
    joined = ancestors(parents).join(own.select(F.col("node").alias("ancestor"), "signature", "private"), "ancestor").filter("distance = 0 OR NOT private")
    return joined.groupBy("node", "signature").agg(F.min_by("ancestor", "distance").alias("owner"))


def edges_from(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, dst, label): the edges that start at the nodes listed."""
    return nodes.select("id").distinct().join(edges.withColumnRenamed("src", "id"), "id").distinct()


def edges_to(edges: DataFrame, nodes: DataFrame, label: str | None = None) -> DataFrame:
    """(id, src, label): the edges that end at the nodes listed; with a label only those, so O gives what overrides them."""
    some = edges if label is None else edges.filter(F.col("label") == label)
    return nodes.select("id").distinct().join(some.withColumnRenamed("dst", "id"), "id").distinct()


def throwing_paths(edges: DataFrame, methods: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, exception, path): for each declared exception of a start, the calls that lead to a method which throws it.

    methods: id, declared (array), thrown (array). A path ends at the first method that throws and goes on through methods that
    declare the exception only. No method is twice on a path, so cycles end.
    """
    thrown = methods.select("id", F.explode(F.array_distinct("thrown")).alias("exception")).withColumn("throws", F.lit(True))
    declared = kept(methods.select("id", F.explode(F.array_distinct("declared")).alias("exception")).join(thrown, ["id", "exception"], "left").withColumn("throws", F.coalesce("throws", F.lit(False))))
    calls = kept(edges.select("src", "dst").distinct())
    first = starts.select("id").distinct().join(declared, "id").select(F.col("id").alias("start"), "exception", F.array("id").alias("path"), F.col("id").alias("node"), "throws")
    rounds = [kept(first)]
    while not rounds[-1].isEmpty():
        grown = rounds[-1].filter("NOT throws").join(calls, F.col("src") == F.col("node")).filter(~F.array_contains("path", F.col("dst")))
        next_of = declared.select(F.col("id").alias("dst"), "exception", F.col("throws").alias("next_throws"))
        grown = grown.join(next_of, ["dst", "exception"]).select("start", "exception", F.concat("path", F.array("dst")).alias("path"), F.col("dst").alias("node"), F.col("next_throws").alias("throws"))
        rounds.append(kept(grown))
    return reduce(DataFrame.unionByName, rounds).filter("throws").select("start", "exception", "path")


def call_graph(calls: DataFrame, methods: DataFrame, parents: DataFrame) -> DataFrame:
    """(src, dst, label): C edges of calls to the nearest class that has the method, O edges to every ancestor's method of the same signature.

    calls: src, owner, signature; methods: id, class, signature, private, static; parents: node, parent (classes and interfaces). Private and static
    methods override nothing. A call that no class answers has no edge.
    """
    up = kept(ancestors(parents.select("node", "parent").unionByName(parents.select(F.col("parent").alias("node"), F.lit(None).cast(parents.schema["parent"].dataType).alias("parent")).filter("node IS NOT NULL"))))
    own = methods.select(F.col("id").alias("dst"), F.col("class").alias("ancestor"), "signature")
    found = calls.select("src", F.col("owner").alias("node"), "signature").distinct().join(up, "node").join(own, ["ancestor", "signature"])
    nearest = found.groupBy("src", "node", "signature").agg(F.min_by("dst", F.struct("distance", "dst")).alias("dst")).select("src", "dst", F.lit("C").alias("label"))
    free = methods.filter("NOT private AND NOT static").select(F.col("id").alias("src"), F.col("class").alias("node"), "signature")
    over = free.join(up.filter("distance > 0"), "node").join(own, ["ancestor", "signature"]).select("src", "dst", F.lit("O").alias("label"))
    return nearest.unionByName(over).distinct()


def dependencies(lines: DataFrame) -> DataFrame:
    """(name): the left sides of a dependency listing's arrows, up to a bracket and without quotes, each once; files and downloads are left out."""
    left = F.trim(F.replace(F.split_part(F.split_part("value", F.lit("->"), F.lit(1)), F.lit("("), F.lit(1)), F.lit('"'), F.lit("")))
    names = lines.filter(F.contains("value", F.lit("->"))).select(left.alias("name"))
    return names.filter(~(F.col("name").contains("_downloads/") | F.col("name").endswith(".jar") | F.col("name").endswith(".class"))).distinct()


def throws_itself(nodes: DataFrame, exceptions: DataFrame) -> DataFrame:
    """(method, exception) whose code creates and throws the exception: in a throw statement, a new object of its short name.

    nodes: method, node, parent, type, code: the syntax tree as a table; exceptions: method, exception.
    """
    n = {k: nodes.filter(F.col("type") == t).select("method", F.col("node").alias(k), F.col("parent").alias(f"{k}_of"), F.col("code").alias(f"{k}_code")) for k, t in (("throw", "ThrowStmt"), ("new", "ObjectCreationExpr"), ("name", "ClassOrInterfaceType"))}
    thrown = n["throw"].join(n["new"].withColumnRenamed("new_of", "throw"), ["method", "throw"]).join(n["name"].withColumnRenamed("name_of", "new"), ["method", "new"])
    short = F.substring_index("exception", ".", -1)
    return exceptions.select("method", "exception", short.alias("name_code")).join(thrown.select("method", "name_code"), ["method", "name_code"], "left_semi").select("method", "exception").distinct()


def prefixes(key: Column) -> Column:
    """All beginnings of an array, the empty one too: what a trie holds on the way to a key."""
    return F.transform(F.sequence(F.lit(0), F.size(key)), lambda n: F.slice(key, F.lit(1), n))


def with_prefix(entries: DataFrame, wanted: DataFrame) -> DataFrame:
    """(prefix, key, value): the entries (key array, value) under each prefix wanted. Keys are looked up by their beginnings, not compared."""
    return entries.select("key", "value", F.explode(prefixes(F.col("key"))).alias("prefix")).join(wanted.select("prefix").distinct(), "prefix").select("prefix", "key", "value")


def prefixes_of(entries: DataFrame, sequences: DataFrame) -> DataFrame:
    """(id, key, value): the entries whose key begins a sequence (id, sequence)."""
    return sequences.select("id", F.explode(prefixes(F.col("sequence"))).alias("key")).join(entries.select("key", "value"), "key").select("id", "key", "value")


def all_in(entries: DataFrame, sets: DataFrame, with_empty: bool = False) -> DataFrame:
    """(id, key, value): the entries (key array, value) whose key has no element outside of a set (id, elements); the empty key only if asked for.

    Equal sets are looked up once, by their elements; what they hold goes to all ids of them in the end, in parts of a thousand ids, so a set that very many ids have is no hot key.
    An entry meets the sets through its element that the fewest of them hold, so an element that is in very many sets brings an entry to them only if all its others are too.
    """
    listed = sets.select("id", F.array_sort(F.array_distinct("elements")).alias("elements"))
    distinct = stored(listed.groupBy("elements").agg(F.ceil(F.count("*") / 1000).cast("long").alias("parts")).filter("elements IS NOT NULL"))
    members = distinct.select("elements", F.explode("elements").alias("e"))
    held = members.groupBy("e").agg(F.count("*").alias("n"))
    keys = entries.filter(F.size("key") > 0).select("key", F.explode(F.array_distinct("key")).alias("e")).distinct()
    # An element that no set holds keeps its entry from all of them.
    anchors = keys.join(held, "e", "left").groupBy("key").agg(F.min_by("e", F.struct(F.coalesce("n", F.lit(0)), "e")).alias("e"))
    fits = entries.join(anchors, "key").join(members, "e").filter(F.size(F.array_except("key", "elements")) == 0).select("elements", "key", "value")
    dealt = listed.join(distinct, "elements").select("id", "elements", F.pmod(F.xxhash64("id"), "parts").alias("part"))
    found = fits.join(distinct, "elements").select("elements", "key", "value", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).join(dealt, ["elements", "part"]).select("id", "key", "value")
    if not with_empty:
        return found
    # The empty key is one entry, which every set has.
    return found.unionByName(sets.select("id").crossJoin(F.broadcast(entries.filter(F.size("key") == 0).limit(1))).select("id", "key", "value"))


def overlaps(left: DataFrame, right: DataFrame, left_has_value: bool = False, right_has_value: bool = False) -> DataFrame:
    """(prefix, left_value, right_value): the beginnings, not empty, that keys of both tables (key array, value) have, with the values of the keys that are just these, null where there is none; only those with a value on a side, if asked for.

    What is below a beginning on either side is with_prefix() of it. Each side's beginnings are made distinct before they meet, so a frequent first element is one row.
    """
    sides = []
    for entries, name in ((left, "left_value"), (right, "right_value")):
        each = entries.filter(F.size("key") > 0).select(F.explode(F.filter(prefixes(F.col("key")), lambda p: F.size(p) > 0)).alias("prefix"), "key", "value")
        own = F.col("prefix") == F.col("key")
        sides.append(each.groupBy("prefix").agg(F.max(F.when(own, F.col("value"))).alias(name), F.bool_or(own).alias(f"has_{name}")))
    both = sides[0].join(sides[1], "prefix")
    return both.filter((F.col("has_left_value") | F.lit(not left_has_value)) & (F.col("has_right_value") | F.lit(not right_has_value))).select("prefix", "left_value", "right_value")
