"""Classes: dense ids over several tables, relations between them, and which class a name means."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.funnel import numbered
from millrace.operators.graph import ancestors, parts, stored


def offset_ids(tables: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """(kind, key, id): ids from 0 without a gap over several tables (kind, rows, key column), one table after another, each in the order of its keys.

    Each table is numbered in two passes over ranges of its keys (`funnel.numbered`); only their sizes come to the driver. Keys are compared within their
    table and come back as text.
    """
    out, first = None, 0
    for kind, rows, key in tables:
        own = stored(rows.select(F.col(key).alias("key")).distinct())
        ids = numbered(own, "key", "id").select(F.lit(kind).alias("kind"), F.col("key").cast("string").alias("key"), (F.col("id") + first).alias("id"))
        out, first = ids if out is None else out.unionByName(ids), first + own.count()
    return out


def class_relations(parents: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ids, relations): ids (kind, key, id) of classes, then methods, and (src, dst, label) between ids: E to each direct parent, A to every other ancestor with its distance in `steps`, M from a class to its methods.

    parents: node, parent (null or a class); methods: id, class. Classes named as a parent only have ids too.
    """
    classes = parents.select(F.col("node").alias("key")).unionByName(parents.select(F.col("parent").alias("key"))).filter("key IS NOT NULL")
    ids = stored(offset_ids([("class", classes, "key"), ("method", methods, "id")]))
    of = lambda kind, name: ids.filter(F.col("kind") == kind).select(F.col("key").alias(name), F.col("id").alias(f"{name}_id"))
    text = lambda c: F.col(c).cast("string").alias(c)
    up = ancestors(parents).filter("distance > 0").select(text("node"), text("ancestor"), "distance").join(of("class", "node"), "node").join(of("class", "ancestor"), "ancestor")
    inherits = up.select(F.col("node_id").alias("src"), F.col("ancestor_id").alias("dst"), F.when(F.col("distance") == 1, "E").otherwise("A").alias("label"), F.col("distance").alias("steps"))
    own = methods.select(text("id"), text("class")).distinct().join(of("method", "id"), "id").join(of("class", "class"), "class")
    return ids, inherits.unionByName(own.select(F.col("class_id").alias("src"), F.col("id_id").alias("dst"), F.lit("M").alias("label"), F.lit(1).alias("steps")))


def resolved_types(uses: DataFrame, imports: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, package, name, full, rank, ambiguous) for each name of a type that a file uses: the class that it means, by the first dictionary that knows it.

    uses: file, package, name; imports: file, path, wildcard; classes: full, all that are known. Dictionaries by rank: 0 the name is whole; 1 an import of its first part; 2 the file's own package; 3 packages imported with a
    wildcard; 4 java.lang. Of several classes of one rank none is taken: `ambiguous` lists them, in order. Imported names need not be known. A name that no dictionary has keeps nulls.

    All lookups go by the whole name of a candidate, so a package with very many classes or files is no hot key. A name meets its file's imports once, all of them together; what
    wildcards may mean is looked up only for names that nothing before them knows.
    """
    known = stored(classes.select("full").filter("full IS NOT NULL").distinct())
    uses = stored(uses.select("file", "package", "name"))
    if n := parts(uses):
        uses, imports = (t.repartition(n, "file") for t in (uses, imports))
    names = uses.distinct()
    listed = imports.groupBy("file").agg(F.collect_set(F.struct("wildcard", "path")).alias("__imports"))
    name, first = F.col("name"), F.substring_index("name", ".", 1)
    single = F.filter("__imports", lambda i: ~i["wildcard"] & (F.substring_index(i["path"], ".", -1) == first))
    some = F.filter("__imports", lambda i: i["wildcard"] & i["path"].isNotNull())
    out = names.join(listed, "file", "left").select(
        "file",
        "package",
        "name",
        F.array_sort(F.transform(single, lambda i: F.concat(i["path"], F.substr(name, F.length(first) + 1)))).alias("__single"),
        F.transform(some, lambda i: F.concat(i["path"], F.lit("."), name)).alias("__some"),
        F.concat_ws(".", F.nullif("package", F.lit("")), "name").alias("__own"),
        F.concat(F.lit("java.lang."), "name").alias("__lang"),
    )
    for column, hit in (("name", "__0"), ("__own", "__2"), ("__lang", "__4")):
        out = _looked_up(out, column, known, hit)
    best = lambda rank, full: F.struct(F.lit(rank).alias("rank"), full.alias("all"))
    before = F.when(F.col("__0") & F.contains("name", F.lit(".")), best(0, F.array("name"))).when(F.size("__single") > 0, best(1, F.col("__single"))).when(F.col("__2"), best(2, F.array("__own")))
    out = out.withColumn("b", before).withColumn("__guess", F.explode_outer(F.when(F.col("b").isNull(), F.col("__some"))))
    # A name without a guess is looked up as itself, so no task gets all of them; what comes of it isn't used.
    out = _looked_up(out.withColumn("__key", F.coalesce("__guess", "__own")), "__key", known, "__3")
    out = out.groupBy("file", "package", "name").agg(F.first("b").alias("b"), F.first("__4").alias("__4"), F.array_sort(F.collect_set(F.when(F.col("__3"), F.col("__guess")))).alias("__some"))
    after = F.when(F.size("__some") > 0, best(3, F.col("__some"))).when(F.col("__4"), best(4, F.array(F.concat(F.lit("java.lang."), "name"))))
    out = out.withColumn("b", F.coalesce("b", after))
    one = F.size("b.all") == 1
    return out.select("file", "package", "name", F.when(one, F.get("b.all", F.lit(0))).alias("full"), F.col("b.rank").alias("rank"), F.when(~one, F.col("b.all")).alias("ambiguous"))


def _looked_up(rows: DataFrame, column: str, known: DataFrame, hit: str) -> DataFrame:
    """The rows with whether the column's value is a known name."""
    key = f"{hit}_full"
    found = rows.join(known.select(F.col("full").alias(key)), F.col(column) == F.col(key), "left")
    return found.withColumn(hit, F.col(key).isNotNull()).drop(key)
