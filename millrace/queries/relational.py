"""Combination, padding, subsets, the funnel, deduplication and incremental work over the driver's tables.

Stand-ins: an order is a task, a line a sample or test (passed: not returned; compiled: status F), a customer a project.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import token_count
from millrace.operators import funnel, lookups, repair, results, stats
from millrace.session import table

_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")


def _samples(spark: SparkSession, sf_dir: str, where: str = "true", ordered: bool = True) -> DataFrame:
    """(id, result): each task's samples, in order if that is asked for, as structs with a summary."""
    passed, compiled = F.col("l_returnflag") != "R", F.col("l_linestatus") == "F"
    summary = F.struct(compiled.cast("int").alias("compiled"), passed.cast("int").alias("all_pass"))
    if not ordered:
        return table(spark, sf_dir, "lineitem").filter(where).groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(summary.alias("summary"))).alias("result"))
    one = F.struct(*_ORDER, summary.alias("summary"))
    lines = table(spark, sf_dir, "lineitem").filter(where)
    return lines.groupBy(F.col("l_orderkey").alias("id")).agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.struct(x["summary"].alias("summary"))).alias("result"))


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("project"), F.col("o_orderkey").alias("pos"), "o_orderpriority", "o_orderstatus", "o_totalprice")


def pad_missing_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = F.struct(F.struct(F.lit(0).alias("compiled"), F.lit(0).alias("all_pass")).alias("summary"))
    rows = results.pad_missing(_tasks(spark, sf_dir), _samples(spark, sf_dir, ordered=False), failed, 10)
    return rows.select("id", F.size("result").cast("long").alias("n"), F.size(F.filter("result", lambda r: r["summary"]["all_pass"] == 1)).cast("long").alias("c"))


def combine_results_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples of priced lines, each combined with the one of its place among all samples of the task."""
    low, high = _samples(spark, sf_dir, "l_quantity <= 25"), _samples(spark, sf_dir, "l_quantity > 25")
    both = results.combine(low, high, lambda a, b: F.when(b.isNull() | a.isNull(), F.coalesce(a, b)).otherwise(F.struct(F.struct(F.least(a["summary"]["compiled"], b["summary"]["compiled"]).alias("compiled"), F.least(a["summary"]["all_pass"], b["summary"]["all_pass"]).alias("all_pass")).alias("summary"))), strict=False)
    return both.select("id", F.size("result").cast("long").alias("n"), F.size(F.filter("result", lambda r: r["summary"]["all_pass"] == 1)).cast("long").alias("c"), F.size(F.filter("result", lambda r: r["summary"]["compiled"] == 1)).cast("long").alias("compiled"))


def _status(spark: SparkSession, sf_dir: str, *status: str) -> DataFrame:
    return _tasks(spark, sf_dir).filter(F.col("o_orderstatus").isin(*status)).select("id", "o_orderstatus", "o_totalprice")


def subset_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.subset(_tasks(spark, sf_dir).select("id", "o_totalprice"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id")))


def separate_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.separate(_tasks(spark, sf_dir).select("id", "o_totalprice"), table(spark, sf_dir, "lineitem").filter("l_returnflag = 'A'").select(F.col("l_orderkey").alias("id")))


def merge_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = _status(spark, sf_dir, "F", "P").withColumn("o_totalprice", -F.col("o_totalprice"))
    return results.merge(_status(spark, sf_dir, "O", "P"), other)


def project_rank_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = spark.createDataFrame([(1,), (2,), (3,)], "project long")
    return funnel.first_projects(_tasks(spark, sf_dir), held).select("id", "project")


def any_all_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks that the gold and automatic-pass filters leave."""
    rows = funnel.with_results(_tasks(spark, sf_dir), _samples(spark, sf_dir, "l_discount > 0.08"), _samples(spark, sf_dir, "l_linenumber <= 4"))
    return funnel.apply_filters(rows, ["no_gold", "auto_pass"]).select("id")


def compile_filter_side_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.when(F.col("l_returnflag").isin("R", "A"), F.lit("error: missing return statement. ")).otherwise(F.lit("")), F.when(F.col("l_linenumber") > 4, F.lit("incompatible types: x")).otherwise(F.lit("")))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), (F.col("l_linestatus") == "F").cast("int").alias("compiled"), text.alias("stdout"))
    kept, failures = funnel.compile_failures(rows)
    return failures.groupBy("kind").agg(F.count("*").alias("n")).unionByName(kept.agg(F.count("*").alias("n")).withColumn("kind", F.lit("kept")))


def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tasks(spark, sf_dir)
    stages = [("status", F.col("o_orderstatus") == "P"), ("price", F.col("o_totalprice") < 50000), ("priority", F.col("o_orderpriority") == "5-LOW")]
    return funnel.funnel(rows, stages).select(F.col("stage").cast("long").alias("stage"), "name", "n", F.round("pct", 6).alias("pct"))


def dataset_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    n = stats.spread("n", F.col("n"), "avg", "sum", "percentile")
    one = t.agg(F.count("*").alias("tasks"), *[v.alias(k) for k, v in n.items()], (100.0 * F.count_if(F.col("n") > 6) / F.count("*")).alias("over"), F.sum(stats.tool_counts(F.col("n"), F.lit(0), 4)[0]).alias("capped"))
    return one.select("tasks", F.col("n-sum").cast("long").alias("total"), F.round("n-avg", 9).alias("mean"), *[F.col(f"n-p{25 * i}").alias(f"p{25 * i}") for i in range(5)], F.round("over", 9).alias("over_6_pct"), "capped")


def rich_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = results.rich_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_quantity")
    return out.select("l_returnflag", F.round("avg", 6).alias("avg"), "sum", "max", "min", "median", F.round("stdev", 6).alias("stdev"), "mode", "cnt")


def topk_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(results.topk_summary(F.collect_list("l_quantity")).alias("s"))
    return rows.select("l_orderkey", "s.max", "s.min", F.round("s.avg", 6).alias("avg"))


def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return funnel.keep_first(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], [*_ORDER]).select("l_orderkey", "l_linenumber", "l_partkey")


def shortest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", token_count(F.col("text")).cast("long").alias("n"))
    return lookups.shortest(rows, ["conv_id"], F.col("n"), "turn", 2)


def annotation_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    edits = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return results.upserted(edits, ["user_id"], ["event_id"], F.col("event_type") == "click").select("user_id", "event_id", "event_type", "value", "created")


def resume_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit("F").alias("kind"))
    cache = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("kind")).distinct()
    return results.work_list(tasks, cache, ["id", "kind"])


def completion_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.col("turn").alias("idx"), F.array("role").alias("results"))
    expected = parts.select("id").distinct().withColumn("expected", F.lit(4))
    return results.completed(parts, expected).select("id", F.array_join("results", ",").alias("results"))


def repair_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples: finished ones passed, dear ones are tried again and pass when they are urgent."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("sample"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    old = orders.withColumns({"output": F.col("o_orderstatus"), "passed": F.col("o_orderstatus") == "F"})
    tried = orders.filter("o_totalprice > 100000").withColumns({"output": F.col("o_orderpriority"), "passed": F.col("o_orderpriority") == "1-URGENT"})
    return repair.next_round(old, tried).select("id", "output", "passed", "carried")


def repair_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as samples, finished ones passed: in round k those are tried whose number leaves k or less when divided by six, and pass if it leaves k."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.lit(0).alias("sample"), F.col("o_orderstatus").alias("output"), (F.col("o_orderstatus") == "F").alias("passed"))
    attempt = lambda left, k: left.filter(F.col("id") % 6 <= k).select("id", "sample", F.concat(F.lit(f"r{k}-"), (F.col("id") % 6).cast("string")).alias("output"), (F.col("id") % 6 == k).alias("passed"))
    return repair.rounds(orders, attempt).select("id", "output", "passed", "round")


_S = "(l_returnflag <> 'R')::INT AS ok, (l_linestatus = 'F')::INT AS comp"
_W = "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)"
_A = "SELECT DISTINCT l_orderkey FROM lineitem WHERE l_returnflag = 'A'"
QUERIES = {f.__name__: f for f in (pad_missing_tasks, combine_results_zip, subset_semi, separate_anti, merge_union, project_rank_filter, any_all_filters, compile_filter_side_output, funnel_counts, dataset_stats, rich_summary, topk_summary, dedup_first, shortest_k, annotation_upsert, resume_worklist, completion_accumulate, repair_round, repair_rounds)}
ORACLES = {
    "pad_missing_tasks": f"WITH s AS (SELECT l_orderkey, count(*) n, sum(ok) c FROM (SELECT l_orderkey, {_S} FROM lineitem) GROUP BY 1) SELECT o_orderkey AS id, coalesce(n, 10)::BIGINT n, coalesce(c, 0)::BIGINT c FROM orders LEFT JOIN s ON l_orderkey = o_orderkey",
    "combine_results_zip": f"""WITH a AS (SELECT l_orderkey, {_S}, {_W} r FROM lineitem WHERE l_quantity <= 25), b AS (SELECT l_orderkey, {_S}, {_W} r FROM lineitem WHERE l_quantity > 25),
        z AS (SELECT a.l_orderkey, a.r, least(a.ok, coalesce(b.ok, 1)) ok, least(a.comp, coalesce(b.comp, 1)) comp FROM a LEFT JOIN b USING (l_orderkey, r)
              UNION ALL SELECT b.l_orderkey, b.r, b.ok, b.comp FROM b ANTI JOIN a USING (l_orderkey, r) WHERE b.l_orderkey IN (SELECT l_orderkey FROM a))
        SELECT l_orderkey AS id, count(*) n, sum(ok)::BIGINT c, sum(comp)::BIGINT compiled FROM z GROUP BY 1""",
    "subset_semi": f"SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey IN ({_A})",
    "separate_anti": f"SELECT o_orderkey AS id, o_totalprice FROM orders WHERE o_orderkey NOT IN ({_A})",
    "merge_union": "WITH a AS (SELECT o_orderkey id, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'P')), b AS (SELECT o_orderkey id, o_orderstatus, -o_totalprice o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'P')) SELECT coalesce(b.id, a.id) id, coalesce(b.o_orderstatus, a.o_orderstatus) o_orderstatus, coalesce(b.o_totalprice, a.o_totalprice) o_totalprice FROM a LEFT JOIN b USING (id) UNION ALL SELECT * FROM b",
    "project_rank_filter": "WITH p AS (SELECT o_custkey, row_number() OVER (ORDER BY min(o_orderkey), o_custkey) r FROM orders GROUP BY 1) SELECT o_orderkey id, o_custkey project FROM orders JOIN p USING (o_custkey) WHERE r <= 161 AND o_custkey NOT IN (1, 2, 3)",
    "any_all_filters": f"""WITH g AS (SELECT l_orderkey, min((l_returnflag <> 'R')::INT) ok FROM lineitem WHERE l_discount > 0.08 GROUP BY 1), t AS (SELECT l_orderkey, {_S}, {_W} r FROM lineitem WHERE l_linenumber <= 4)
        SELECT o_orderkey AS id FROM orders JOIN g ON g.l_orderkey = o_orderkey JOIN t ON t.l_orderkey = o_orderkey WHERE g.ok = 1 AND t.r = 1 AND t.ok = 0""",
    "compile_filter_side_output": "WITH x AS (SELECT l_linestatus = 'F' c, l_returnflag IN ('R', 'A') m, l_linenumber > 4 t FROM lineitem) SELECT 'missing_return' kind, count(*) n FROM x WHERE NOT c AND m UNION ALL SELECT 'incompatible_types', count(*) FROM x WHERE NOT c AND t UNION ALL SELECT 'kept', count(*) FROM x WHERE c OR m OR t",
    "funnel_counts": "WITH c AS (SELECT count(*) a, count(*) FILTER (o_orderstatus <> 'P') b, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 50000) c, count(*) FILTER (o_orderstatus <> 'P' AND o_totalprice >= 50000 AND o_orderpriority <> '5-LOW') d FROM orders) SELECT 0::BIGINT stage, 'all' AS name, a n, 100.0::DOUBLE pct FROM c UNION ALL SELECT 1, 'status', b, round(100.0::DOUBLE * b / a, 6) FROM c UNION ALL SELECT 2, 'price', c, round(100.0::DOUBLE * c / b, 6) FROM c UNION ALL SELECT 3, 'priority', d, round(100.0::DOUBLE * d / c, 6) FROM c",
    "dataset_stats": "WITH t AS (SELECT count(*) n FROM lineitem GROUP BY l_orderkey) SELECT count(*) tasks, sum(n)::BIGINT total, round(avg(n), 9) mean, " + ", ".join(f"quantile_cont(n, {q})::DOUBLE p{int(q * 100)}" for q in (0, 0.25, 0.5, 0.75, 1)) + ", round(100.0::DOUBLE * count(*) FILTER (n > 6) / count(*), 9) over_6_pct, sum(least(n, 4))::BIGINT capped FROM t",
    "rich_summary": "SELECT l_returnflag, round(avg(l_quantity), 6) AS avg, sum(l_quantity) AS sum, max(l_quantity) AS max, min(l_quantity) AS min, median(l_quantity) AS median, round(stddev_pop(l_quantity), 6) stdev, (SELECT q FROM (SELECT l_quantity q, count(*) c FROM lineitem b WHERE b.l_returnflag = a.l_returnflag GROUP BY 1) ORDER BY c DESC, q LIMIT 1) AS mode, count(*) cnt FROM lineitem a GROUP BY 1",
    "topk_summary": "SELECT l_orderkey, max(l_quantity) AS max, min(l_quantity) AS min, round(avg(l_quantity), 6) AS avg FROM lineitem GROUP BY 1",
    "dedup_first": "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice) = 1",
    "shortest_k": r"WITH t AS (SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\s+'), lambda x: x <> ''))::BIGINT n FROM conversations) SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n, turn) <= 2",
    "annotation_upsert": "WITH e AS (SELECT user_id, event_id, event_type, value, min(event_id) OVER (PARTITION BY user_id) created, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) r FROM events) SELECT user_id, event_id, event_type, value, created FROM e WHERE r = 1 AND event_type <> 'click'",
    "resume_worklist": "SELECT o_orderkey AS id, 'F' AS kind FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'F')",
    "completion_accumulate": "SELECT conv_id AS id, string_agg(role, ',' ORDER BY turn) AS results FROM conversations GROUP BY 1 HAVING count(*) = 4",
    "repair_round": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus <> 'F' AND o_totalprice > 100000 THEN o_orderpriority ELSE o_orderstatus END AS output, o_orderstatus = 'F' OR (o_totalprice > 100000 AND o_orderpriority = '1-URGENT') AS passed, o_orderstatus = 'F' AS carried FROM orders",
    "repair_rounds": "SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'F' WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN 'r' || (o_orderkey % 6) || '-' || (o_orderkey % 6) WHEN o_orderkey % 6 = 0 THEN 'r4-0' ELSE o_orderstatus END AS output, o_orderstatus = 'F' OR o_orderkey % 6 BETWEEN 1 AND 4 AS passed, CASE WHEN o_orderstatus = 'F' THEN 0 WHEN o_orderkey % 6 BETWEEN 1 AND 4 THEN o_orderkey % 6 END::INT AS round FROM orders",
}
