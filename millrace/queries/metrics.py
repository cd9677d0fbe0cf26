"""Result metrics: pass@k, combination of result runs, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.estimators import pass_at_k
from millrace.session import table


def pass_at_k_by_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean pass@k by label; a task that no run evaluated counts as one with no success."""
    tasks = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    samples = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") != "R").alias("c"))
    )
    padded = tasks.join(samples, tasks.o_orderkey == samples.l_orderkey, "left").select(
        "o_orderpriority", F.coalesce("n", F.lit(10)).alias("n"), F.coalesce("c", F.lit(0)).alias("c")
    )
    return (
        padded.filter("n >= 5")
        .groupBy("o_orderpriority")
        .agg(
            F.count("*").alias("n_tasks"),
            F.round(F.avg(pass_at_k(F.col("n"), F.col("c"), 1)), 9).alias("pass_at_1"),
            F.round(F.avg(pass_at_k(F.col("n"), F.col("c"), 5)), 9).alias("pass_at_5"),
        )
    )


QUERIES = {"pass_at_k_by_priority": pass_at_k_by_priority}
ORACLES = {
    "pass_at_k_by_priority": """
        WITH s AS (SELECT l_orderkey, count(*) n, count(*) FILTER (l_returnflag <> 'R') c FROM lineitem GROUP BY 1),
        p AS (SELECT o_orderpriority, coalesce(n, 10) n, coalesce(c, 0) c FROM orders LEFT JOIN s ON l_orderkey = o_orderkey),
        e AS (SELECT o_orderpriority, n, c, c::DOUBLE / n AS p1,
              CASE WHEN c = 0 THEN 0.0::DOUBLE WHEN n - c < 5 THEN 1.0::DOUBLE
                   ELSE 1.0::DOUBLE - list_product(list_transform(range(n - c + 1, n + 1), lambda i: (i - 5)::DOUBLE / i)) END AS p5
              FROM p WHERE n >= 5)
        SELECT o_orderpriority, count(*) n_tasks, round(avg(p1), 9) pass_at_1, round(avg(p5), 9) pass_at_5 FROM e GROUP BY 1
    """,
}
