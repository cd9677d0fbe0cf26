"""Tallies, statistics, combined runs and raters over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import occurrences
from millrace.operators import agreement, results, stats
from millrace.session import table


def _mark(condition: Column, text: str) -> Column:
    return F.when(condition, F.lit(text)).otherwise(F.lit(""))


def throw_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as logs of removed throws."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    out = F.concat(_mark(i % 2 == 0, "![if-throw]! then ![if-throw]! "), _mark(i % 3 == 0, "![rest-throw]! "), _mark(F.col("lang") == "en", "![catch-throw]!"))
    return stats.throw_tally(d.select(out.alias("out")))


def failure_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as failed builds: their priority is the failure, finished ones have an unreported exception, pending ones no message."""
    status = F.col("o_orderstatus")
    text = F.when(status == "F", "x unreported exception y").when(status == "O", "other")
    return stats.failure_tally(table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("failure"), text.alias("error_message")))


def metric_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = {"quantity": F.col("l_quantity"), "discount": F.col("l_discount"), "late-only": F.when(F.col("l_linestatus") == "O", F.col("l_tax")), "tax-topk": F.col("l_tax")}
    return stats.metric_means(stats.long_metrics(table(spark, sf_dir, "lineitem"), named)).select("metric", F.round("mean", 6).alias("mean"))


def aggregated_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as rows of metrics named by their region; those of odd regions are lists."""
    key, region = F.col("n_nationkey").cast("double"), F.col("n_regionkey")
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("pos"), region.cast("string").alias("metric"), F.when(region % 2 == 0, key).alias("value"), F.when(region % 2 == 1, F.array(key, key + 1)).alias("values"))
    out = stats.aggregated(rows, "pos")
    return out.select("metric", F.size("values").cast("long").alias("n"), F.size(F.get("values", F.lit(0))).cast("long").alias("first_n"), F.aggregate(F.flatten("values"), F.lit(0.0), lambda a, x: a + x).alias("total"))


def merged_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities by flag of finished lines, put together with those of open ones; not every flag has both."""
    lines = table(spark, sf_dir, "lineitem")
    a, b = (lines.filter(F.col("l_linestatus") == s).filter(c).groupBy(F.col("l_returnflag").alias("metric")).agg(F.collect_list("l_quantity").alias("values")) for s, c in (("F", "l_returnflag <> 'N'"), ("O", "l_returnflag <> 'A'")))
    return stats.merged(a, b).select("metric", F.size("values").cast("long").alias("n"), F.aggregate("values", F.lit(0.0), lambda acc, x: acc + x).alias("total"))


def dataset_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as methods: twenty to a class, sources as projects; counts of tests and of tools' tests from their numbers."""
    i = F.col("doc_id")
    kind = F.when(i % 5 == 0, F.lit(None)).otherwise(F.concat(F.lit("E"), (i % 7).cast("string")))
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("p.C"), (i % 20).cast("string"), F.lit("#m"), i.cast("string")).alias("mut_key"),
        F.col("source").alias("project"),
        F.replace("text", F.lit("the "), F.lit("throw ")).alias("mut"),
        F.slice(F.array(kind, F.lit("E0"), F.lit("E9")), F.lit(1), (i % 3 + 1).cast("int")).alias("exceptions"),
        (i % 11 == 0).alias("only_throw"),
        (i % 4 == 0).alias("empty_no_throw"),
        (F.col("n_chars") % 600).cast("int").alias("randoop"),
        (i % 250).cast("int").alias("evosuite"),
    )
    return stats.dataset_bundle(rows).select("name", F.round("value", 6).alias("value"))


def rejection_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    conditions = [("no_mut", F.col("o_totalprice") < 20000), ("no_etest", F.col("o_orderstatus") == "P"), ("time_out", F.col("o_orderpriority") == "5-LOW")]
    return stats.reasons(table(spark, sf_dir, "orders"), conditions)[1]


def _runs(spark: SparkSession, sf_dir: str, where: str) -> DataFrame:
    """(id, result): three samples for each order that has such lines; sample s is built unless s = 2 and the order is finished, and has the lines with number % 3 = s as tests."""
    lines = table(spark, sf_dir, "lineitem").filter(where).select(F.col("l_orderkey").alias("id"), (F.col("l_linenumber") % 3).alias("s"), (F.col("l_returnflag") != "R").alias("passed"))
    tests = lines.groupBy("id").agg(F.collect_list(F.struct("s", "passed")).alias("x")).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus"), "id")

    def sample(s: int) -> Column:
        own = F.transform(F.filter("x", lambda t: t["s"] == s), lambda t: F.struct(t["passed"].alias("passed")))
        n, passed = F.size(own), F.size(F.filter(own, lambda t: t["passed"]))
        success = F.lit(s != 2) | (F.col("o_orderstatus") != "F")
        summary = F.struct(success.cast("int").alias("compiled"), F.when(success & (n > 0), passed / n).otherwise(0.0).alias("pass_ratio"), (success & (passed == n)).cast("int").alias("all_pass"))
        return F.struct(summary.alias("summary"), success.alias("success"), own.alias("tests"))

    return tests.select("id", F.array(*[sample(s) for s in range(3)]).alias("result"))


def _joined_runs(spark: SparkSession, sf_dir: str, right: DataFrame | None = None) -> DataFrame:
    a, b = _runs(spark, sf_dir, "l_quantity <= 25"), _runs(spark, sf_dir, "l_quantity > 25") if right is None else right
    both = results.combine(a, b, lambda x, y: results.merge_tests(x, y))
    return both.join(b.select("id").withColumn("matched", F.lit(True)), "id", "left").withColumn("matched", F.coalesce("matched", F.lit(False)))


def combine_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of two kinds of tests as one: each sample's summary after the tests are put together."""
    rows = _joined_runs(spark, sf_dir).select("id", F.posexplode("result").alias("s", "r"))
    return rows.select("id", F.col("s").cast("long").alias("s"), F.size("r.tests").cast("long").alias("n"), F.col("r.summary.compiled").alias("compiled"), F.round("r.summary.pass_ratio", 6).alias("pass_ratio"), F.col("r.summary.all_pass").alias("all_pass"))


def combined_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.combined_means(_joined_runs(spark, sf_dir), False).select("metric", F.round("mean", 6).alias("mean"))


def combined_means_with_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.combined_means(_joined_runs(spark, sf_dir), True).select("metric", F.round("mean", 6).alias("mean"))


def combine_results_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without any run to add, the results stay as they are."""
    rows = _joined_runs(spark, sf_dir, _runs(spark, sf_dir, "false"))
    return rows.select("id", "matched", F.aggregate("result", F.lit(0), lambda acc, r: acc + F.size(r["tests"])).cast("long").alias("tests"))


def sample_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as the tests of one sample."""
    tests = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.collect_list(F.when(F.col("l_orderkey").isNotNull(), F.struct((F.col("l_linestatus") == "F").alias("compiled"), (F.col("l_returnflag") != "R").alias("passed")))).alias("t"))
    s = results.test_summary(F.col("t"))
    return tests.select("o_orderkey", s["compiled"].alias("compiled"), F.round(s["pass_ratio"], 6).alias("pass_ratio"), s["all_pass"].alias("all_pass"))


def predictions_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumn("pos", F.col("conv_id") * 1000 + F.col("turn"))
    out = results.predictions_by_id(turns.select("pos", F.col("conv_id").alias("id")), turns.select("pos", F.md5("text").alias("prediction")))
    return out.select("id", F.md5(F.array_join("predictions", ",")).alias("digest"), F.size("predictions").cast("long").alias("n"))


def cache_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as tasks: results of orders before a date are cached, results of dear ones are new."""
    tasks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sample"))
    orders = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("sample")), "o_custkey")
    cache, new = (orders.filter(c).groupBy(F.col("o_custkey").alias("id"), "sample").agg(F.max("o_orderkey").alias("result")) for c in ("o_orderpriority = '1-URGENT'", "o_totalprice > 100000"))
    return results.with_cache(tasks, cache, new, ["id", "sample"])


def load_all_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and, where these lack a key, customers."""
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("full_name"), F.col("s_name").alias("url"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("full_name"), F.col("c_name").alias("url"))
    return results.first_wins(a, b, "full_name")


def _records(spark: SparkSession, sf_dir: str, rater: int) -> DataFrame:
    """Labels as a rater's records of one or two entries; odd ids have notes of a rule now and then."""
    i = F.col("doc_id")
    said = F.when(F.col("quality") == 1, " Yes").when((i + rater) % 5 == 0, "").otherwise("no")
    note = F.when((i + rater) % 4 == 0, "by rule [auto] ").otherwise("seen")
    one = F.struct(said.alias("match"), F.array(F.col("source"), F.col("lang")).alias("category"), note.alias("note"))
    two = F.struct(F.when((i + rater) % 3 == 0, "NO").otherwise("yes").alias("match"), F.array(F.col("lang"), F.lit("twice")).alias("category"), F.lit("").alias("note"))
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return rows.filter((i + rater) % 6 != 0).select(i.alias("pos"), F.concat(F.lit("d-"), i.cast("string")).alias("data_id"), F.when(i % 2 == 0, F.array(one, two)).otherwise(F.array(one)).alias("entries"))


def annotation_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.collapsed(_records(spark, sf_dir, 0)).select("data_id", "match", F.array_join("categories", ",").alias("categories"), "auto")


def _samples(spark: SparkSession, sf_dir: str, rater: int) -> DataFrame:
    out = agreement.collapsed(_records(spark, sf_dir, rater))
    return out.withColumn("pos", agreement.id_number(F.col("data_id"))).withColumnRenamed("data_id", "id")


def compute_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.summary(_samples(spark, sf_dir, 0), "pos").select("name", "place", "n", F.round("pct", 6).alias("pct"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    passing = table(spark, sf_dir, "labels").filter("toxic = 0").select(F.concat(F.lit("d-"), F.col("doc_id").cast("string")).alias("id"))
    rows = [agreement.verdicts(passing, _samples(spark, sf_dir, r), "pos").withColumn("rater", F.lit(f"r{r}")) for r in range(3)]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


def rater_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.agreement(_scored(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("agreement_pct", "kappa")})


def kappa_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.kappa_range(agreement.agreement(_scored(spark, sf_dir))).select(F.round("least", 6).alias("least"), F.round("greatest", 6).alias("greatest"), "n")


def pairwise_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement over every id that two raters have, whoever decided."""
    out = agreement.pairwise(_scored(spark, sf_dir).select("rater", "id", "match"))
    return out.withColumn("kappa", F.round("kappa", 6))


def summary_with_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passing ids with their judgement or the default; judgements of other ids are dropped."""
    passing = table(spark, sf_dir, "documents").filter("lang = 'en'").select(F.col("doc_id").alias("id"))
    judged = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("match"), F.col("toxic").cast("string").alias("category"))
    return agreement.with_default(passing, judged)


def improvement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many points the share of late lines of one year is above another's, for each flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", F.year("l_shipdate").alias("year"), (F.col("l_linestatus") == "O").cast("double").alias("v"))
    # Whole thousandths, so that every engine rounds the points alike.
    means = lines.groupBy("l_returnflag", "year").agg((F.floor(1000 * F.avg("v")) / 1000).alias("value"))
    years = means.agg(F.min("year").alias("a"), F.max("year").alias("b"))
    marked = means.crossJoin(F.broadcast(years)).withColumn("name", F.when(F.col("year") == F.col("a"), "first").when(F.col("year") == F.col("b"), "last"))
    return agreement.improvement(marked, ["l_returnflag"], "name", "first", "last").select("l_returnflag", F.round("gain", 6).alias("gain"))


def qualitative_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters' summaries, side by side."""
    out = agreement.comparison(*[agreement.summary(_samples(spark, sf_dir, r), "pos") for r in (0, 1)])
    return out.select("no_difference", F.round("rate_difference", 6).alias("rate_difference"), F.round("category_difference", 6).alias("category_difference"))


def _flagged(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("id"))


def passing_in_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.in_all(*[_flagged(spark, sf_dir, f) for f in "ANR"])


def missing_extra_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.unlike(_flagged(spark, sf_dir, "A"), _flagged(spark, sf_dir, "R"))


def overlap_of_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The universe is one run's own ids, passed or not."""
    ran = table(spark, sf_dir, "lineitem").filter("l_linenumber <= 2").select(F.col("l_orderkey").alias("id"))
    return agreement.overlap(ran, _flagged(spark, sf_dir, "A"), _flagged(spark, sf_dir, "N"))


def checked_venn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.checked_overlap(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")), _flagged(spark, sf_dir, "A"), _flagged(spark, sf_dir, "R"))


def category_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.by_category(_samples(spark, sf_dir, 0), _samples(spark, sf_dir, 1))


def most_common_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.most_common(table(spark, sf_dir, "part"), "p_type", "p_partkey")


def numeric_id_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts' ids as text, ranked by their number and as text."""
    from pyspark.sql import Window

    ids = table(spark, sf_dir, "part").select("p_brand", F.concat(F.lit("id-"), F.col("p_partkey").cast("string")).alias("id"))
    by = lambda c: (F.row_number().over(Window.partitionBy("p_brand").orderBy(c))).cast("long")
    return ids.select("id", by(agreement.id_number(F.col("id"))).alias("by_number"), by("id").alias("by_text"))


def substring_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Occurrences of plain strings, by language."""
    d = table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.sum(occurrences(F.col("text"), "a")).cast("long").alias("a"), F.sum(occurrences(F.col("text"), "ee")).cast("long").alias("ee"))


QUERIES = {
    f.__name__: f
    for f in (
        throw_tally, failure_tally, metric_means, aggregated_metrics, merged_metrics, dataset_bundle, rejection_reasons, combine_tests, combined_means,
        combined_means_with_tools, combine_results_left, sample_summaries, predictions_by_id, cache_reuse, load_all_projects, annotation_collapse,
        compute_summary, rater_agreement, kappa_range, pairwise_kappa, summary_with_default, improvement, qualitative_comparison, passing_in_all,
        missing_extra_ids, overlap_of_results, checked_venn, category_differences, most_common_types, numeric_id_sort, substring_totals,
    )
}

_PERCENTILES = lambda name, value: " UNION ALL ".join(f"SELECT '{name}-p{25 * i}', round(quantile_cont({value}, {i / 4}), 6) FROM d" for i in range(5))
_BUNDLE = [
    "SELECT 'num-class' AS name, count(DISTINCT doc_id % 20)::DOUBLE AS value FROM d",
    "SELECT 'num-methods', count(DISTINCT doc_id)::DOUBLE FROM d",
    "SELECT 'num-projects', count(DISTINCT source)::DOUBLE FROM d",
    "SELECT 'only-throw-mut', (count(*) FILTER (doc_id % 11 = 0))::DOUBLE FROM d",
    "SELECT 'empty-no-throw', (count(*) FILTER (doc_id % 4 = 0))::DOUBLE FROM d",
    *[f"SELECT '{n}-{k}', round({f}({v}), 6)::DOUBLE FROM d" for n, v in (("throw-statements", "throws"), ("etest", "tests"), ("randoop-tests", "r"), ("evosuite-tests", "e"), ("tool-tests", "r + e")) for k, f in (("avg", "avg"), ("sum", "sum"))],
    "SELECT 'method-lines-avg', round(avg(lines), 6) FROM d",
    "SELECT 'method-lines-larger-than-20', round(100.0::DOUBLE * count(*) FILTER (lines > 20) / count(*), 6) FROM d",
    *[_PERCENTILES(n, v) for n, v in (("throw-statements", "throws"), ("method-lines", "lines"), ("etest", "tests"), ("randoop-tests", "r"), ("evosuite-tests", "e"))],
    "SELECT 'exception-type', (count(DISTINCT x))::DOUBLE FROM (SELECT unnest(list_slice([CASE WHEN doc_id % 5 <> 0 THEN 'E' || (doc_id % 7) END, 'E0', 'E9'], 1, (doc_id % 3 + 1)::INT)) AS x FROM d)",
]
_RUN = """r AS (SELECT o_orderkey id, s, o_orderstatus <> 'F' OR s <> 2 AS ok, l_quantity <= 25 AS low, count(l_orderkey) n, count(l_orderkey) FILTER (l_returnflag <> 'R') p FROM orders, range(3) t(s)
          LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber % 3 = s GROUP BY ALL),
     a AS (SELECT o_orderkey id FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity <= 25)),
     b AS (SELECT DISTINCT l_orderkey id FROM lineitem WHERE l_quantity > 25),
     z AS (SELECT a.id, s, any_value(ok) ok, a.id IN (SELECT id FROM b) AS matched, coalesce(sum(n) FILTER (low OR (ok AND a.id IN (SELECT id FROM b))), 0) n, coalesce(sum(p) FILTER (low OR (ok AND a.id IN (SELECT id FROM b))), 0) p FROM a JOIN r USING (id) GROUP BY a.id, s),
     q AS (SELECT id, s, matched, ok, n, ok::INT compiled, CASE WHEN ok AND n > 0 THEN p / n ELSE 0 END::DOUBLE pass_ratio, (ok AND p = n)::INT all_pass FROM z)"""


def _means(where: str) -> str:
    tops = " UNION ALL ".join(f"SELECT '{m}-{k}' AS metric, {k}({m})::DOUBLE AS v FROM q WHERE {where} GROUP BY id" for m in ("compiled", "pass_ratio", "all_pass") for k in ("max", "min", "avg"))
    return f"WITH {_RUN} SELECT metric, round(avg(v), 6) AS mean FROM ({tops}) GROUP BY 1"


def _rater(r: int) -> str:
    return f"""e{r} AS (SELECT doc_id, quality, source, lang, CASE WHEN quality = 1 THEN 'yes' WHEN (doc_id + {r}) % 5 = 0 THEN NULL ELSE 'no' END m1, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN (doc_id + {r}) % 3 = 0 THEN 'no' ELSE 'yes' END END m2,
            (doc_id + {r}) % 4 = 0 AS auto FROM documents JOIN labels USING (doc_id) WHERE (doc_id + {r}) % 6 <> 0),
        s{r} AS (SELECT doc_id, 'd-' || doc_id AS id, CASE WHEN m1 IS NULL AND m2 IS NULL THEN NULL ELSE coalesce(m1, 'yes') = 'yes' AND coalesce(m2, 'yes') = 'yes' END AS match, auto,
            CASE WHEN doc_id % 2 = 0 THEN [source, lang, 'twice'] ELSE [source, lang] END cats FROM e{r}),
        v{r} AS (SELECT 'r{r}' rater, 'd-' || l.doc_id AS id, coalesce(match, true) AS match, match IS NOT NULL AS labelled, match IS NOT NULL AND NOT coalesce(auto, false) AS judged FROM labels l LEFT JOIN s{r} USING (doc_id) WHERE toxic = 0)"""


_KAPPA = "CASE WHEN n > 0 AND a1 > 0 AND a1 < n AND b1 > 0 AND b1 < n THEN round(((yes_yes + no_no) / n - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)) / (1 - (a1 * b1 + (n - a1) * (n - b1)) / (n * n)), 6) END"
_AGREEMENT = f"""WITH {_rater(0)}, {_rater(1)}, {_rater(2)}, v AS (SELECT * FROM v0 UNION ALL SELECT * FROM v1 UNION ALL SELECT * FROM v2),
    p AS (SELECT x.rater a, y.rater b, x.judged AND y.judged j, x.match mx, y.match my, x.labelled AND y.labelled AS lab FROM v x JOIN v y USING (id) WHERE x.rater < y.rater),
    c AS (SELECT a, b, count(*) FILTER (j) total, count(*) FILTER (j AND mx = my) agree, count(*) FILTER (j AND mx <> my) disagree, count(*) FILTER (j AND mx AND my) yes_yes, count(*) FILTER (j AND mx AND NOT my) yes_no,
        count(*) FILTER (j AND NOT mx AND my) no_yes, count(*) FILTER (j AND NOT mx AND NOT my) no_no, count(*) FILTER (mx <> my AND lab) disagree_both_labelled, count(*) FILTER (mx <> my AND NOT lab) disagree_from_default FROM p GROUP BY 1, 2),
    k AS (SELECT *, total::DOUBLE n, (yes_yes + yes_no)::DOUBLE a1, (yes_yes + no_yes)::DOUBLE b1 FROM c)"""
_SUMMARY = lambda r: f"""t{r} AS (SELECT 'total' AS name, NULL::BIGINT AS place, count(*) n, 100.0::DOUBLE pct FROM s{r} UNION ALL SELECT 'yes', NULL, count(*) FILTER (match), 100.0::DOUBLE * count(*) FILTER (match) / count(*) FROM s{r}
        UNION ALL SELECT 'no', NULL, count(*) FILTER (NOT match), CASE WHEN count(*) FILTER (NOT match) > 0 THEN 100.0::DOUBLE END FROM s{r} UNION ALL SELECT 'unknown', NULL, count(*) FILTER (match IS NULL), 100.0::DOUBLE * count(*) FILTER (match IS NULL) / count(*) FROM s{r}
        UNION ALL SELECT name, row_number() OVER (ORDER BY n DESC, first) - 1, n, 100.0::DOUBLE * n / (SELECT count(*) FROM s{r} WHERE NOT match) FROM (SELECT name, count(*) n, min(doc_id * 10 + i) AS first FROM (SELECT doc_id, unnest(cats) AS name, unnest(range(len(cats))) i FROM s{r} WHERE NOT match) GROUP BY 1))"""  # noqa: E731

ORACLES = {
    "throw_tally": "WITH t AS (SELECT 'if-throw' kind, count(*) FILTER (doc_id % 2 = 0) n FROM documents UNION ALL SELECT 'rest-throw', count(*) FILTER (doc_id % 3 = 0) FROM documents UNION ALL SELECT 'catch-throw', count(*) FILTER (lang = 'en') FROM documents) SELECT * FROM t UNION ALL SELECT 'total-throw', sum(n)::BIGINT FROM t",
    "failure_tally": "WITH t AS (SELECT replace(o_orderpriority, ' ', '-') kind, count(*) n FROM orders GROUP BY 1), u AS (SELECT count(*) a, count(*) FILTER (o_orderstatus = 'F') f FROM orders) SELECT * FROM t UNION ALL SELECT 'total-rm-comp-fail', a FROM u UNION ALL SELECT 'unreported-exception', f FROM u UNION ALL SELECT 'missing-return-only', a - f FROM u",
    "metric_means": "SELECT 'quantity' AS metric, round(avg(l_quantity), 6) AS mean FROM lineitem UNION ALL SELECT 'discount', round(avg(l_discount), 6) FROM lineitem UNION ALL SELECT 'late-only', round(avg(l_tax), 6) FROM lineitem WHERE l_linestatus = 'O'",
    "aggregated_metrics": "SELECT n_regionkey::VARCHAR AS metric, CASE WHEN n_regionkey % 2 = 0 THEN count(*) ELSE 2 * count(*) - 1 END n, CASE WHEN n_regionkey % 2 = 0 THEN 1 ELSE 2 END::BIGINT first_n, sum(CASE WHEN n_regionkey % 2 = 0 THEN n_nationkey ELSE 2 * n_nationkey + 1 END)::DOUBLE total FROM nation GROUP BY n_regionkey",
    "merged_metrics": "SELECT l_returnflag AS metric, count(*) n, sum(l_quantity) total FROM lineitem WHERE (l_linestatus = 'F' AND l_returnflag <> 'N') OR (l_linestatus = 'O' AND l_returnflag <> 'A') GROUP BY 1",
    "dataset_bundle": "WITH d AS (SELECT *, ((length(text) - length(replace(text, 'the ', ''))) // 4 + (length(text) - length(replace(text, 'throw ', ''))) // 6)::DOUBLE throws, len(string_split(text, chr(10)))::DOUBLE AS lines, (doc_id % 3 + 1)::DOUBLE tests, least(n_chars % 600, 400)::DOUBLE r, least(doc_id % 250, 400 - least(n_chars % 600, 400))::DOUBLE e FROM documents) " + " UNION ALL ".join(_BUNDLE),
    "rejection_reasons": "SELECT CASE WHEN o_totalprice < 20000 THEN 'no_mut' WHEN o_orderstatus = 'P' THEN 'no_etest' WHEN o_orderpriority = '5-LOW' THEN 'time_out' ELSE 'kept' END AS reason, count(*) n FROM orders GROUP BY 1",
    "combine_tests": f"WITH {_RUN} SELECT id, s, n::BIGINT n, compiled, round(pass_ratio, 6) pass_ratio, all_pass FROM q",
    "combined_means": _means("ok OR NOT matched"),
    "combined_means_with_tools": _means("true"),
    "combine_results_left": "SELECT l_orderkey AS id, false AS matched, count(*) tests FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity <= 25 GROUP BY 1",
    "sample_summaries": "SELECT o_orderkey, coalesce(max((l_linestatus = 'F')::INT), 0) AS compiled, round(CASE WHEN count(l_orderkey) > 0 THEN (count(*) FILTER (l_returnflag <> 'R'))::DOUBLE / count(l_orderkey) ELSE 0 END, 6) AS pass_ratio, (count(l_orderkey) > 0 AND count(l_orderkey) = count(*) FILTER (l_returnflag <> 'R'))::INT AS all_pass FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "predictions_by_id": "SELECT conv_id AS id, md5(string_agg(md5(text), ',' ORDER BY turn)) AS digest, count(*) n FROM conversations GROUP BY 1",
    "cache_reuse": "WITH c AS (SELECT o_custkey k, max(o_orderkey) FILTER (o_orderpriority = '1-URGENT') o, max(o_orderkey) FILTER (o_totalprice > 100000) w FROM orders GROUP BY 1) SELECT c_custkey AS id, c_nationkey AS sample, coalesce(o, w) AS result, o IS NOT NULL AS hit FROM customer LEFT JOIN c ON k = c_custkey",
    "load_all_projects": "SELECT s_suppkey AS full_name, s_name AS url FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "annotation_collapse": f"WITH {_rater(0)} SELECT id AS data_id, match, array_to_string(cats, ',') AS categories, auto FROM s0",
    "compute_summary": f"WITH {_rater(0)}, {_SUMMARY(0)} SELECT name, place, n, round(pct, 6) pct FROM t0",
    "rater_agreement": f"{_AGREEMENT} SELECT a, b, total, agree, disagree, yes_yes, yes_no, no_yes, no_no, disagree_both_labelled, disagree_from_default, round(CASE WHEN total > 0 THEN 100.0::DOUBLE * agree / total ELSE 0 END, 6) AS agreement_pct, {_KAPPA} AS kappa FROM k",
    "kappa_range": f"{_AGREEMENT}, z AS (SELECT {_KAPPA} AS kappa FROM k) SELECT min(kappa) least, max(kappa) greatest, count(kappa) n FROM z",
    "pairwise_kappa": f"{_AGREEMENT}, f AS (SELECT a, b, count(*) FILTER (mx AND my) yes_yes, count(*) FILTER (mx AND NOT my) yes_no, count(*) FILTER (NOT mx AND my) no_yes, count(*) FILTER (NOT mx AND NOT my) no_no FROM p GROUP BY 1, 2), g AS (SELECT *, (yes_yes + yes_no + no_yes + no_no)::DOUBLE n, (yes_yes + yes_no)::DOUBLE a1, (yes_yes + no_yes)::DOUBLE b1 FROM f) SELECT a, b, yes_yes, yes_no, no_yes, no_no, {_KAPPA} AS kappa FROM g",
    "summary_with_default": "SELECT d.doc_id AS id, coalesce(quality = 1, true) AS match, toxic::VARCHAR AS category FROM documents d LEFT JOIN labels USING (doc_id) WHERE lang = 'en'",
    "improvement": "WITH m AS (SELECT l_returnflag, year(l_shipdate) y, floor(1000 * avg((l_linestatus = 'O')::INT::DOUBLE)) / 1000 v FROM lineitem GROUP BY 1, 2) SELECT a.l_returnflag, round(round(100 * b.v, 2) - round(100 * a.v, 2), 6) AS gain FROM m a JOIN m b USING (l_returnflag) WHERE a.y = (SELECT min(y) FROM m) AND b.y = (SELECT max(y) FROM m)",
    "qualitative_comparison": f"WITH {_rater(0)}, {_rater(1)}, {_SUMMARY(0)}, {_SUMMARY(1)}, n AS (SELECT (SELECT n FROM t0 WHERE name = 'no' AND place IS NULL) a, (SELECT n FROM t1 WHERE name = 'no' AND place IS NULL) b, (SELECT n FROM t0 WHERE name = 'total') ta, (SELECT n FROM t1 WHERE name = 'total') tb) SELECT abs(a - b) no_difference, round(abs(100.0::DOUBLE * a / ta - 100.0::DOUBLE * b / tb), 6) rate_difference, (SELECT round(max(abs(coalesce(x.pct, 0) - coalesce(y.pct, 0))), 6) FROM (SELECT * FROM t0 WHERE place IS NOT NULL) x FULL JOIN (SELECT * FROM t1 WHERE place IS NOT NULL) y USING (name)) category_difference FROM n",
    "passing_in_all": "SELECT l_orderkey AS id FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 3",
    "missing_extra_ids": "SELECT l_orderkey AS id, CASE WHEN bool_or(l_returnflag = 'A') THEN 'missing' ELSE 'extra' END AS side FROM lineitem WHERE l_returnflag IN ('A', 'R') GROUP BY 1 HAVING count(DISTINCT l_returnflag) = 1",
    "overlap_of_results": "WITH f AS (SELECT l_orderkey, bool_or(l_linenumber <= 2) u, bool_or(l_returnflag = 'A') a, bool_or(l_returnflag = 'N') b FROM lineitem GROUP BY 1) SELECT count(*) FILTER (a AND NOT b) only_a, count(*) FILTER (b AND NOT a) only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) neither FROM f WHERE u",
    "checked_venn": "WITH f AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') a, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') b FROM orders) SELECT count(*) FILTER (a AND NOT b) only_a, count(*) FILTER (b AND NOT a) only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) neither FROM f",
    "category_differences": f"WITH {_rater(0)}, {_rater(1)}, c0 AS (SELECT DISTINCT id, unnest(cats) category FROM s0 WHERE NOT match AND id IN (SELECT id FROM s1)), c1 AS (SELECT DISTINCT id, unnest(cats) category FROM s1 WHERE NOT match AND id IN (SELECT id FROM s0)) SELECT category, count(*) FILTER (c1.id IS NULL) only_a, count(*) FILTER (c0.id IS NULL) only_b, count(*) FILTER (c0.id IS NOT NULL AND c1.id IS NOT NULL) AS both FROM c0 FULL JOIN c1 USING (id, category) GROUP BY 1",
    "most_common_types": "SELECT p_type, n, row_number() OVER (ORDER BY n DESC, f) - 1 AS place FROM (SELECT p_type, count(*) n, min(p_partkey) f FROM part GROUP BY 1)",
    "numeric_id_sort": "SELECT 'id-' || p_partkey AS id, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS by_number, row_number() OVER (PARTITION BY p_brand ORDER BY 'id-' || p_partkey) AS by_text FROM part",
    "substring_totals": "SELECT lang, sum(length(text) - length(replace(text, 'a', '')))::BIGINT AS a, sum((length(text) - length(replace(text, 'ee', ''))) // 2)::BIGINT AS ee FROM documents GROUP BY 1",
}
