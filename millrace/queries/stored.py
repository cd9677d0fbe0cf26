"""Data sets that are written and read again, extractors, trees and tags over the driver's tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.operators import agreement, extractors, stats, trees
from millrace.session import table
from millrace.sources import column_files, datasets
from millrace.streaming import completion


def _folder(spark: SparkSession) -> str:
    """A new folder below the one that the session's executors share; on one machine a temporary one serves."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='millrace-')}/data-{uuid.uuid4().hex}"


def dataset_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts saved, more appended, one column replaced and one added; read for the ids that suppliers have."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_size")
    data = datasets.Dataset(spark, _folder(spark))
    data.save(parts.filter("id % 2 = 0"))
    data.save(parts.filter("id % 2 = 1"), append=True)
    data.save_columns(parts.select("id", (-F.col("p_size")).alias("p_size"), F.upper("p_name").alias("title")), ["p_size", "title"])
    return data.load(["id", "p_name", "p_size", "title"], table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id")))


def dataset_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts saved and given a column, saved anew in their place with another, and appended to with values of that column: the last version, and the first one beside it."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("v"))
    data = datasets.Dataset(spark, _folder(spark))
    data.save(parts)
    data.save_columns(parts.select("id", (-F.col("v")).alias("v")), ["v"])
    data.save(parts.filter("id % 2 = 0").select("id", (F.col("v") * 100).alias("v")), exist_ok=True)
    data.save_columns(parts.filter("id % 4 = 0").select("id", (F.col("v") + 1).alias("w")), ["w"])
    data.save(parts.filter("id % 2 = 1").select("id", "v", F.col("v").alias("w")), append=True)
    first = data.load(version=data.versions()[0]).select("id", F.col("v").alias("first_v"))
    return data.load(["id", "v", "w"]).join(first, "id")


def dataset_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of a saved data set, and one row of it."""
    data = datasets.Dataset(spark, _folder(spark))
    data.save(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name"))
    one = data.get(3).select("id", F.col("c_name").alias("name"))
    return data.ids().select("id", F.lit(None).cast("string").alias("name")).unionByName(one)


def column_files_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts written as a file for each field and put together again by line, those of listed ids only."""
    p = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(p.alias("id"), F.when(p % 7 != 0, F.concat("p_name", F.lit('"\n\\'))).alias("note"), F.array_repeat(F.col("p_size"), (p % 3).cast("int")).alias("sizes"))
    folder = _folder(spark)
    column_files.write_column_files(rows, folder, ["id", "note", "sizes"], "id")
    ids = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    out = column_files.read_column_files(spark, folder, {"id": "long", "note": "string", "sizes": "array<int>"}, ids)
    return out.select("pos", "id", "note", F.array_join(F.col("sizes").cast("array<string>"), ",").alias("sizes"))


def metrics_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines' quantities as samples of runs by flag, written with their means; a second run's folder joins the first's."""
    path, lines = _folder(spark), table(spark, sf_dir, "lineitem")
    for flags in ("'A', 'N'", "'R'"):
        run = lines.filter(f"l_returnflag IN ({flags})").select(F.col("l_returnflag").alias("config"), F.col("l_orderkey").alias("id"), "l_quantity")
        datasets.write_metrics(run, run.groupBy("config").agg(F.avg("l_quantity").alias("mean")), path, ["config"])
    read = [datasets.read_records(spark, f"{path}/{n}", "parquet") for n in ("each-sample", "summary")]
    return read[0].groupBy("config").agg(F.count("*").alias("n")).join(read[1], "config").select(F.col("config").cast("string").alias("config"), "n", F.round("mean", 6).alias("mean"))


def completed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks with ids `order-N`, their lines as parts that a stream of files brings: those whose lines are all there, with the parts in order."""
    folder = _folder(spark)
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").cast("string").alias("part"))
    # An order whose key is divisible by 3 waits for one more part, which never comes.
    wanted = F.count("*").over(Window.partitionBy("l_orderkey")) + F.when(F.col("l_orderkey") % 3 == 0, 1).otherwise(0)
    parts = lines.select(F.concat(F.lit("order-"), F.col("l_orderkey").cast("string")).alias("id"), F.col("l_linenumber").cast("int").alias("idx"), F.array("part").alias("results"), wanted.cast("int").alias("expected"))
    parts.write.parquet(f"{folder}/in")
    stream = completion.completed_stream(spark.readStream.schema(parts.schema).parquet(f"{folder}/in"))
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/mark").outputMode("append").trigger(availableNow=True).start()
    out.awaitTermination()
    return spark.read.schema("id string, results array<string>").parquet(f"{folder}/out").select("id", F.array_join("results", ",").alias("results"))


def annotation_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as lines of JSON, some broken, with single tags and lists."""
    s = F.col("s_suppkey")
    value = F.when(s % 2 == 0, F.concat(F.lit('" t'), (s % 7).cast("string"), F.lit(' "'))).otherwise(F.concat(F.lit('["u'), (s % 5).cast("string"), F.lit('", "", "w"]')))
    line = F.when(s % 3 == 0, F.lit("{broken")).otherwise(F.concat(F.lit('{"entries": [{"values": {"category": '), value, F.lit(', "note": "x"}}]}')))
    return datasets.tags(table(spark, sf_dir, "supplier").select(line.alias("value")), "category")


def latex_macros(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.lower(F.substring("o_orderstatus", 1, 1)).alias("name")).agg((F.count("*") * 1000).cast("double").alias("value")).withColumn("whole", F.lit(True))
    halves = table(spark, sf_dir, "region").select(F.lower("r_name").alias("name"), (F.col("r_regionkey") * 1000 + 0.5).alias("value"), F.lit(False).alias("whole"))
    return datasets.macros(counts.unionByName(halves), "stat", "test")


def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first parts whose method has no throw, and the first one with enough to say."""
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), F.when(F.col("p_size") % 3 == 0, F.lit("throw x;")).otherwise(F.col("p_name")).alias("mut"), (F.col("p_size") / 50).alias("share"))
    a = datasets.without_throw(rows, 5).select("pos", F.lit("plain").alias("view"))
    return a.unionByName(datasets.first_available(rows, F.col("share")).select("pos", F.lit("available").alias("view")))


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as methods with a source, logs of two tests and a compiler's output: fields by the registry, the last one from an earlier one."""
    p = F.col("p_partkey")
    line = lambda n: F.concat(F.lit("LineNum:["), n.cast("string"), F.lit("]"))
    rows = table(spark, sf_dir, "part").select(
        p.alias("id"),
        F.lit("p.C#m#(Lq/T;Ljava/lang/String;)V").alias("mut_key"),
        F.concat(F.lit("package p.q;\nimport a.B"), (p % 3).cast("string"), F.lit(";\npublic class T {}")).alias("source"),
        F.lit("void m() {\n  a();\n}").alias("mut"),
        F.lit(2).alias("start_line"),
        F.array(line(p % 9), F.concat(line(F.lit(5)), F.lit(" "), line(p % 7), F.lit(" ExceptionType:[p.E] ExceptionST:[p.C;m;"), (p % 8).cast("string"), F.lit("]"))).alias("logs"),
        F.concat(F.lit("x.java:["), (p % 6).cast("string"), F.lit(",1] unreported exception p.F;")).alias("stdout"),
    )
    out = extractors.extracted(rows, ["covered_count", "thrown_exception", "coverage", "fqcn", "import_info", "parameter_types", "unreported_exception"])
    thrown = F.get("thrown_exception", F.lit(1))
    return out.select("id", "fqcn", F.get("import_info", F.lit(0)).alias("import_name"), F.array_join("parameter_types", ",").alias("types"), F.col("covered_count").cast("long").alias("covered"), F.get("unreported_exception", F.lit(0))["line"].alias("unreported"), thrown["line"].alias("thrown"))


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as nodes of one tree for each nation of their root: a node's parent has half its number, and nodes without children are leaves with their names."""
    s = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier").filter("s_suppkey >= 1")
    most = base.agg(F.max("s_suppkey").alias("most"))
    kind = F.when(s % 5 == 0, "Stmt").when(s % 3 == 0, "Expr").otherwise("Block")
    leaf = s * 2 > F.col("most")
    return base.crossJoin(F.broadcast(most)).select(F.lit("t").alias("tree"), s.alias("node"), F.when(s > 1, F.floor(s / 2)).alias("parent"), (s % 2).alias("place"), kind.alias("type"), F.when(leaf, F.col("s_name")).alias("tok"), s.alias("start"), s.alias("end"))


def tree_walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A breadth-first walk that doesn't go below statements."""
    return trees.walked(_nodes(spark, sf_dir), F.col("type") == "Stmt", True)


def tree_find(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All statements, the first expression, and blocks right below the root."""
    nodes = _nodes(spark, sf_dir)
    each = {"all": trees.found(nodes, ["Stmt"]), "first": trees.found(nodes, ["Expr"], first=True), "below": trees.found(nodes, ["Block", "Expr"], below_root=True)}
    out = [d.select(F.lit(k).alias("kind"), "node", (F.size("path") - 1).cast("long").alias("depth")) for k, d in each.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


def tree_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = trees.spans(_nodes(spark, sf_dir))
    return out.select("node", "size", "first_line", "last_line", F.col("leaves").alias("tokens"))


def tree_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as trees of a root and their lines, each a statement on lines of its own."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    n = F.col("l_linenumber").cast("long")
    below = lines.select(F.col("l_orderkey").alias("tree"), n.alias("node"), F.lit(0).cast("long").alias("parent"), n.alias("place"), F.when(F.col("p") % 4 == 0, "Empty").otherwise("Stmt").alias("type"), F.lit("x").alias("tok"), (n * 10).alias("start"), (n * 10 + F.col("p") % 5).alias("end"))
    roots = lines.select("l_orderkey").distinct().select(F.col("l_orderkey").alias("tree"), F.lit(0).cast("long").alias("node"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("place"), F.lit("Root").alias("type"), F.lit(None).cast("string").alias("tok"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("long").alias("end"))
    return trees.statements(below.unionByName(roots), ["Stmt"])


def capped_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of two kinds as two tools' tests under one cap of three."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("a"), F.count_if(F.col("l_returnflag") != "A").alias("b"))
    a, b = stats.tool_counts(F.col("a"), F.col("b"), 3)
    return lines.select("l_orderkey", a.alias("first"), b.alias("second"))


def judged_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of labels beside each other: which ids only one of them has."""
    d = table(spark, sf_dir, "labels")
    return agreement.unlike(d.filter("quality = 1").select(F.col("doc_id").alias("id")), d.filter("toxic = 0").select(F.col("doc_id").alias("id")))


QUERIES = {f.__name__: f for f in (completed_tasks, dataset_roundtrip, dataset_versions, dataset_ids, column_files_roundtrip, metrics_sink, annotation_tags, latex_macros, viewers, extracted_fields, tree_walk, tree_find, tree_spans, tree_statements, capped_tools, judged_overlap)}
_NODES = "n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey % 5 = 0 THEN 'Stmt' WHEN s_suppkey % 3 = 0 THEN 'Expr' ELSE 'Block' END AS type FROM supplier WHERE s_suppkey >= 1)"
ORACLES = {
    "completed_tasks": "WITH l AS (SELECT l_orderkey AS k, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT 'order-' || k AS id, string_agg(p, ',' ORDER BY n) AS results FROM l WHERE k % 3 <> 0 GROUP BY k",
    "dataset_roundtrip": "SELECT p_partkey AS id, p_name, -p_size AS p_size, upper(p_name) AS title FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)",
    "dataset_versions": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_size * 100 ELSE p_size END AS v, CASE WHEN p_partkey % 2 = 1 THEN p_size WHEN p_partkey % 4 = 0 THEN p_size + 1 END AS w, p_size AS first_v FROM part",
    "dataset_ids": "SELECT c_custkey AS id, NULL::VARCHAR AS name FROM customer UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey = 3",
    "column_files_roundtrip": r"""SELECT row_number() OVER (ORDER BY p_partkey) - 1 + (SELECT count(*) FROM part WHERE p_partkey < (SELECT min(s_suppkey) FROM supplier)) AS pos, p_partkey AS id, CASE WHEN p_partkey % 7 <> 0 THEN p_name || '"' || chr(10) || '\' END AS note, array_to_string(list_transform(range(p_partkey % 3), lambda i: p_size), ',') AS sizes FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier)""",
    "metrics_sink": "SELECT l_returnflag AS config, count(*) n, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 1",
    "annotation_tags": "SELECT DISTINCT unnest(CASE WHEN s_suppkey % 2 = 0 THEN ['t' || (s_suppkey % 7)] ELSE ['u' || (s_suppkey % 5), 'w'] END) AS tag FROM supplier WHERE s_suppkey % 3 <> 0",
    "latex_macros": r"SELECT '\DefMacro{stat-' || lower(o_orderstatus) || '-test}{' || format('{:,}', count(*) * 1000) || '}' AS line FROM orders GROUP BY o_orderstatus UNION ALL SELECT '\DefMacro{stat-' || lower(r_name) || '-test}{' || format('{:,}', r_regionkey::BIGINT * 1000) || '.50}' FROM region",
    "viewers": "SELECT * FROM (SELECT p_partkey AS pos, 'plain' AS view FROM part WHERE p_size % 3 <> 0 AND p_name NOT LIKE '%throw%' ORDER BY 1 LIMIT 5) UNION ALL SELECT * FROM (SELECT p_partkey, 'available' FROM part WHERE p_size / 50 > 0.79::DOUBLE ORDER BY 1 LIMIT 1)",
    "extracted_fields": "WITH p AS (SELECT p_partkey AS id, list_distinct(list_filter([p_partkey % 9 - 5, 0, p_partkey % 7 - 5], lambda x: x BETWEEN 0 AND 2)) AS c, p_partkey % 8 - 5 AS t FROM part) SELECT id, 'p.q.T' AS fqcn, 'a.B' || (id % 3) AS import_name, 'q/T' AS types, len(c) AS covered, (id % 6 - 4)::INT AS unreported, CASE WHEN t > 0 THEN t END::INT AS thrown FROM p",
    "tree_walk": f"WITH RECURSIVE {_NODES}, w AS (SELECT node, type, 1 AS d, 0::BIGINT AS k FROM n WHERE node = 1 UNION ALL SELECT n.node, n.type, d + 1, 2 * k + n.node % 2 FROM w JOIN n ON n.node // 2 = w.node WHERE w.type <> 'Stmt') SELECT 't' AS tree, node, type, row_number() OVER (ORDER BY d, k) - 1 AS step FROM w",
    "tree_find": f"WITH {_NODES}, d AS (SELECT *, floor(log2(node) + 1e-9)::BIGINT AS depth FROM n), x AS (SELECT *, (node - (1 << depth)) * (1 << (20 - depth)) AS k FROM d WHERE type = 'Expr') SELECT 'all' AS kind, node, depth FROM d WHERE type = 'Stmt' UNION ALL SELECT * FROM (SELECT 'first', node, depth FROM x ORDER BY k, depth LIMIT 1) UNION ALL SELECT 'below', node, depth FROM d WHERE depth = 1 AND type <> 'Stmt'",
    "tree_spans": "WITH RECURSIVE m AS (SELECT max(s_suppkey) AS most FROM supplier), a AS (SELECT s_suppkey AS leaf, s_suppkey AS node FROM supplier WHERE s_suppkey >= 1 UNION ALL SELECT leaf, node // 2 FROM a WHERE node > 1) SELECT node, count(*) AS size, min(leaf) AS first_line, max(leaf) AS last_line, count(*) FILTER (leaf * 2 > most) AS tokens FROM a, m GROUP BY 1",
    "tree_statements": "WITH l AS (SELECT l_orderkey AS tree, l_linenumber::BIGINT AS node, min(l_partkey) p FROM lineitem GROUP BY 1, 2) SELECT tree, node, row_number() OVER (PARTITION BY tree ORDER BY node) - 1 AS number, node * 10 AS first_line, node * 10 + p % 5 AS last_line FROM l WHERE p % 4 <> 0",
    "capped_tools": "WITH c AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') a, count(*) FILTER (l_returnflag <> 'A') b FROM lineitem GROUP BY 1) SELECT l_orderkey, least(a, 3) AS first, least(b, 3 - least(a, 3)) AS second FROM c",
    "judged_overlap": "SELECT doc_id AS id, CASE WHEN bool_or(quality = 1) THEN 'missing' ELSE 'extra' END AS side FROM labels GROUP BY 1 HAVING bool_or(quality = 1) <> bool_or(toxic = 0)",
}
