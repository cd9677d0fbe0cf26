"""Agreement, overlaps, bins, text, traces and graphs over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text
from millrace.operators import agreement, graph, traces
from millrace.session import table


def cohen_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two raters: quality and toxicity labels, by language."""
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    judged = rows.select("lang", (F.col("quality") == 1).alias("x"), (F.col("toxic") == 1).alias("y"))
    return agreement.cells(judged, ["lang"], "x", "y").withColumn("kappa", F.round(agreement.kappa(), 9))


def _with_flag(spark: SparkSession, sf_dir: str, flag: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).select(F.col("l_orderkey").alias("id"))


def venn_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return agreement.overlap(ids, _with_flag(spark, sf_dir, "A"), _with_flag(spark, sf_dir, "N"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_quantity", (F.col("l_returnflag") != "R").cast("double").alias("a"), (F.col("l_linestatus") == "F").cast("double").alias("b"))
    return agreement.binned(spark, rows, "l_quantity", "a", "b", 5, 40, 2)


def binned_success(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bins(spark, sf_dir).select(F.col("bin").cast("long").alias("bin"), "label", "n", F.round("mean_a", 9).alias("mean_a"), F.round("mean_b", 9).alias("mean_b"))


def bin_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.bin_gaps(_bins(spark, sf_dir))


def best_config_per_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ship year with the largest mean of each metric."""
    lines = table(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("year"), "l_returnflag", "l_quantity", "l_discount")
    means = lines.groupBy("year").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("l_quantity", "l_discount")])
    long = means.select("year", F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("l_quantity", "l_discount")])))
    return agreement.best_per_metric(long, ["metric"], "year", "year")


def text_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.split_lines(t).cast("long").alias("parts"), text.counted_lines(t).cast("long").alias("lines"), text.token_count(t).cast("long").alias("tokens"), text.occurrences(t, "the ").cast("long").alias("the"))


def code_block_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second reply is fenced; the others have no block."""
    reply = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("So:\n```java\n"), F.col("text"), F.lit("\n```\nand\n```\nno\n```"))).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.extract_code(reply).alias("code"))


def regex_extract_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.matches(F.col("html"), 'href="([^"]*)"'), " ").alias("links"))


def prompt_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = text.fill_template("Method ~`name`~ of ~`brand`~.\n~`name`~ throws.", {"name": F.col("p_name"), "brand": F.col("p_brand")})
    return table(spark, sf_dir, "part").select("p_partkey", filled.alias("prompt"))


def line_comment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.add_comment(F.col("text"), F.lit(1), F.col("source"))).alias("digest"))


def trace_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs of events by user and day: the frames before each user's purchases, which stand in for the test."""
    frame = F.concat_ws("#", F.concat(F.lit("p.C"), F.col("user_id") % 5), F.when(F.col("event_type") == "purchase", F.lit(traces.TEST)).otherwise(F.col("event_type")), "event_id")
    lines = table(spark, sf_dir, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.array_sort(F.collect_list(F.struct("event_id", frame.alias("f")))).alias("x"))
    line = F.concat(F.size("x").cast("string"), F.lit("@@p.C#m@@"), F.array_join(F.transform("x", lambda e: e["f"]), "##"))
    parsed = traces.parse(lines.select("user_id", "day", line.alias("line")))
    return parsed.select("user_id", F.col("day").cast("string").alias("day"), F.col("depth").cast("long").alias("depth"), F.size("frames").cast("long").alias("n"), F.array_join(F.transform("frames", lambda f: f["line"].cast("string")), ",").alias("lines"))


def frame_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as frames in overloads made of parts: the method holds ten sizes from its own on."""
    methods = table(spark, sf_dir, "part").select(F.col("p_brand").alias("class"), F.col("p_type").alias("method"), F.col("p_size").alias("start_line"), (F.col("p_size") + 10).alias("end_line")).distinct()
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_brand").alias("class"), F.col("p_type").alias("method"), ((F.col("p_partkey") * 7) % 60).cast("int").alias("line"))
    return traces.resolve(rows, methods, ["p_partkey"]).select("p_partkey", "line", "start_line")


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("src"))
    return pairs.select("src", F.inline(F.array(F.struct((F.col("src") * 2).alias("dst"), F.lit("C").alias("label")), F.struct((F.col("src") * 2 + 1).alias("dst"), F.lit("C").alias("label")), F.struct((F.col("src") - 3).alias("dst"), F.lit("O").alias("label"))))).filter("dst > 0")


def call_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.call_paths(_edges(spark, sf_dir).filter("label = 'C'"), start, 8).select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def call_paths_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths from all suppliers over all supplier-part pairs; a part is -1 - p_partkey, and the odd ones override the part before."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (-1 - F.col("l_partkey")).alias("dst"), F.lit("C").alias("label"))
    over = table(spark, sf_dir, "part").filter("p_partkey % 2 = 1").select((-1 - F.col("p_partkey")).alias("src"), (-F.col("p_partkey")).alias("dst"), F.lit("O").alias("label"))
    start = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"))
    return graph.call_paths(pairs.unionByName(over), start, None).select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def call_paths_overridden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All paths from all suppliers at any depth: each calls the one of half its number, and odd ones are overridden by one of the negative number."""
    s = F.col("s_suppkey")
    base = table(spark, sf_dir, "supplier")
    calls = base.filter(s > 1).select(s.alias("src"), F.floor(s / 2).alias("dst"), F.lit("C").alias("label"))
    over = base.filter(s % 2 == 1).select((-s).alias("src"), s.alias("dst"), F.lit("O").alias("label"))
    return graph.call_paths(calls.unionByName(over), base.select(s.alias("id")), None).select("start", F.array_join(F.col("path").cast("array<string>"), ",").alias("path"))


def ancestor_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    parents = s.select(F.col("s_suppkey").alias("node"), F.when(F.col("s_suppkey") > 1, F.floor(F.col("s_suppkey") / 2)).alias("parent"))
    own = s.select(F.col("s_suppkey").alias("node"), (F.col("s_nationkey") % 7).cast("long").alias("signature"), (F.col("s_suppkey") % 3 == 0).alias("private"))
    return graph.members(parents, own)


QUERIES = {f.__name__: f for f in (cohen_kappa, venn_overlap, binned_success, bin_gap, best_config_per_metric, text_counts, code_block_extract, regex_extract_all, prompt_fill, line_comment, trace_parse, frame_interval_join, call_paths, call_paths_lineitem, call_paths_overridden, ancestor_members)}
_BIN = "WITH r AS (SELECT least(greatest(ceil(l_quantity / 5) - 1, 0), 8)::BIGINT AS bin, (l_returnflag <> 'R')::INT a, (l_linestatus = 'F')::INT b FROM lineitem), m AS (SELECT bin, count(*) n, avg(a) ma, avg(b) mb FROM r GROUP BY 1), g AS (SELECT i::BIGINT bin, CASE WHEN i = 8 THEN '40+' ELSE (i * 5) || '-' || (i * 5 + 5) END AS label, coalesce(n, 0)::BIGINT n, ma, mb FROM range(9) t(i) LEFT JOIN m ON m.bin = i)"
ORACLES = {
    "cohen_kappa": """WITH c AS (SELECT lang, count(*) FILTER (quality = 1 AND toxic = 1) yes_yes, count(*) FILTER (quality = 1 AND toxic <> 1) yes_no, count(*) FILTER (quality <> 1 AND toxic = 1) no_yes, count(*) FILTER (quality <> 1 AND toxic <> 1) no_no FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1),
        n AS (SELECT *, (yes_yes + yes_no + no_yes + no_no)::DOUBLE n, (yes_yes + yes_no)::DOUBLE a, (yes_yes + no_yes)::DOUBLE b FROM c), e AS (SELECT *, (a * b + (n - a) * (n - b)) / (n * n) pe FROM n)
        SELECT lang, yes_yes, yes_no, no_yes, no_no, round(CASE WHEN a > 0 AND a < n AND b > 0 AND b < n THEN ((yes_yes + no_no) / n - pe) / (1 - pe) END, 9) AS kappa FROM e""",
    "venn_overlap": "WITH f AS (SELECT o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A') a, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'N') b FROM orders) SELECT count(*) FILTER (a AND NOT b) only_a, count(*) FILTER (b AND NOT a) only_b, count(*) FILTER (a AND b) AS both, count(*) FILTER (NOT a AND NOT b) neither FROM f",
    "binned_success": f"{_BIN} SELECT bin, label, n, round(ma, 9) mean_a, round(mb, 9) mean_b FROM g",
    "bin_gap": f"{_BIN}, d AS (SELECT *, mb - ma gap FROM g WHERE n > 0) SELECT (SELECT label FROM d ORDER BY gap DESC, bin LIMIT 1) best, (SELECT label FROM d ORDER BY gap, bin LIMIT 1) worst, count(*) FILTER (gap = 0) tied, count(*) FILTER (gap < 0) behind FROM d",
    "best_config_per_metric": "WITH m AS (SELECT year(l_shipdate) y, round(avg(l_quantity), 6) q, round(avg(l_discount), 6) d FROM lineitem GROUP BY 1), u AS (SELECT 'l_quantity' metric, y, q v FROM m UNION ALL SELECT 'l_discount', y, d FROM m) SELECT metric, y AS best, v AS value FROM u QUALIFY row_number() OVER (PARTITION BY metric ORDER BY v DESC, y) = 1",
    "text_counts": r"SELECT doc_id, len(string_split(text, chr(10)))::BIGINT parts, (CASE WHEN text = '' THEN 0 ELSE len(string_split(regexp_replace(text, '\n\z', ''), chr(10))) END)::BIGINT AS lines, len(list_filter(string_split_regex(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> ''))::BIGINT tokens, ((length(text) - length(replace(text, 'the ', ''))) // 4)::BIGINT AS the FROM documents",
    "code_block_extract": "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN text || chr(10) ELSE '// No match' END AS code FROM conversations",
    "regex_extract_all": """SELECT page_id, coalesce(array_to_string(list_sort(list_distinct(regexp_extract_all(html, 'href="([^"]*)"', 1))), ' '), '') AS links FROM pages""",
    "prompt_fill": "SELECT p_partkey, 'Method ' || p_name || ' of ' || p_brand || '.' || chr(10) || p_name || ' throws.' AS prompt FROM part",
    "line_comment": "WITH l AS (SELECT doc_id, source, string_split(text, chr(10)) x FROM documents) SELECT doc_id, md5(array_to_string(list_transform(x, lambda v, i: CASE WHEN i = 2 THEN v || ' // ' || source ELSE v END), chr(10))) AS digest FROM l",
    "trace_parse": "WITH e AS (SELECT user_id, ts::DATE::VARCHAR AS day, event_id, event_type FROM events), f AS (SELECT user_id, day, count(*) depth, min(event_id) FILTER (event_type = 'purchase') p FROM e GROUP BY 1, 2) SELECT user_id, day, depth, count(event_id) n, coalesce(string_agg(event_id::VARCHAR, ',' ORDER BY event_id), '') AS lines FROM f LEFT JOIN e ON e.user_id = f.user_id AND e.day = f.day AND e.event_id < f.p WHERE f.p IS NOT NULL GROUP BY f.user_id, f.day, f.depth".replace("SELECT user_id, day, depth, count", "SELECT f.user_id, f.day, f.depth, count"),
    "frame_interval_join": "WITH m AS (SELECT *, count(*) OVER (PARTITION BY c, t) k FROM (SELECT DISTINCT p_brand c, p_type t, p_size s FROM part)) SELECT p_partkey, ((p_partkey * 7) % 60)::INT AS line, s AS start_line FROM part JOIN m ON c = p_brand AND t = p_type WHERE k = 1 OR (p_partkey * 7) % 60 BETWEEN s AND s + 10 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY s) = 1",
    "call_paths": "WITH RECURSIVE e AS (SELECT s_suppkey src, s_suppkey * 2 + k dst FROM supplier, range(2) t(k) WHERE s_suppkey * 2 + k > 0), p AS (SELECT s_suppkey AS start, s_suppkey node, [s_suppkey] path FROM supplier UNION ALL SELECT p.start, e.dst, list_append(path, e.dst) FROM p JOIN e ON src = node WHERE len(path) < 8 AND NOT list_contains(path, e.dst)) SELECT start, array_to_string(path, ',') AS path FROM p WHERE len(path) = 8 OR node NOT IN (SELECT src FROM e)",
    "call_paths_overridden": "WITH RECURSIVE p AS (SELECT s_suppkey AS start, s_suppkey node, [s_suppkey] path FROM supplier UNION ALL SELECT start, nx, list_append(path, nx) FROM (SELECT *, unnest(CASE WHEN node > 1 AND node % 2 = 1 AND len(path) > 1 THEN [node // 2, -node] WHEN node > 1 THEN [node // 2] WHEN node = 1 AND len(path) > 1 THEN [-1] ELSE [] END) AS nx FROM p)) SELECT start, array_to_string(path, ',') AS path FROM p WHERE node <= 1",
    "ancestor_members": "WITH RECURSIVE a AS (SELECT s_suppkey node, s_suppkey x, 0 d FROM supplier UNION ALL SELECT node, x // 2, d + 1 FROM a WHERE x > 1) SELECT node, (s_nationkey % 7)::BIGINT AS signature, arg_min(x, d) AS owner FROM a JOIN supplier ON s_suppkey = x WHERE d = 0 OR s_suppkey % 3 <> 0 GROUP BY 1, 2",
}
