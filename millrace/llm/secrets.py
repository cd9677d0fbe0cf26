"""Operator 3, secret scans: an incremental ledger of blobs.

A blob is a distinct text, addressed by the SHA-256 of its content. The ledger has a row for each blob
and rule version that was scanned, with the spans found. A scan hashes every version of every path,
keeps the blobs that the ledger lacks at the rules' version, scans each of these once and joins
the findings, old and new, back to all paths. A hot group of copies is one blob.

Spans come from Spark's own regular expressions: the text is split by the rule and the matches are
extracted; the lengths of the pieces, summed in order, give each match its place in code points.

A ledger is kept as a folder of Parquet: append_ledger() adds the rows of a scan, read_ledger() reads what is there, in the
next run or by another job.

Defined results. A null text is empty and has no spans. Rows that repeat get the same spans, each. An
empty table gives no rows. Spans of one kind do not overlap; spans of different kinds may. Texts may be of any length. Columns of paths may
have any names; the two that are added give way to them by a `_` behind their own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from millrace.llm.common import fresh, text_of, written
from millrace.session import table


@dataclass(frozen=True)
class Rule:
    """Matches of the pattern whose group has at least so many characters."""

    kind: str
    pattern: str
    group: int
    least: int


VERSION = "1"
#: The rules of this version, in the order in which spans of one start are listed.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", "AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", "[0-9a-f]{16,}", 0, 16),  # a shorter run can't match, and can't hide a longer one
)
#: Columns of the ledger: blob string, version string, spans array<struct<start:int,rank:int,kind:string,end:int>>.
LEDGER = ("blob", "version", "spans")


def blob_of(text: Column) -> Column:
    """The address of a text."""
    return F.sha2(text, 256)


def _matches(text: Column, rule: Rule, rank: int) -> Column:
    """For each match in order: the length of the text before it since the last match, its own, and whether it counts."""
    lengths = F.transform(F.split(text, rule.pattern), lambda x: F.length(x))
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    group = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    zipped = F.zip_with(whole, group, lambda a, b: F.struct(F.length(a).alias("n"), (F.length(b) >= rule.least).alias("ok")))
    each = F.zip_with(zipped, lengths, lambda m, gap: F.struct(F.lit(rank).alias("rank"), gap.alias("gap"), m["n"].alias("n"), m["ok"].alias("ok")))
    found = F.filter(each, lambda x: x["n"].isNotNull())  # the text after the last match has none
    return F.transform(found, lambda x, i: F.struct(x["rank"], i.alias("i"), x["gap"], x["n"], x["ok"]))


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Ledger rows of blobs (blob, text). Each blob must occur once."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    matches = blobs.select("blob", F.concat(*[_matches(F.col("text"), r, k) for k, r in enumerate(rules)]).alias("m"))
    # One row for each match, and for a blob without any a row without a match: it is scanned all the same.
    rows = matches.select("blob", F.explode_outer("m").alias("m")).select("blob", "m.*").repartition("blob")
    upto = Window.partitionBy("blob", "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("n")).over(upto).cast("int")
    placed = rows.withColumn("end", end)
    span = F.struct((F.col("end") - F.col("n")).alias("start"), "rank", F.get(kinds, F.col("rank")).alias("kind"), "end")
    spans = F.array_sort(F.collect_list(F.when(F.col("ok"), span)))
    return placed.groupBy("blob").agg(F.lit(version).alias("version"), spans.alias("spans")).select(*LEDGER)


def scan(paths: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> tuple[DataFrame, DataFrame]:
    """(spans for each row of paths, the ledger's new rows after its old ones).

    paths has a text column and any others. The first result has every row of paths, without its text, with its blob and
    spans as its last columns; the second has all old rows of the ledger and one for each blob that was not yet scanned.
    """
    new = _new_rows(paths, ledger, rules, version)
    after = new if ledger is None else ledger.select(*LEDGER).unionByName(new)
    kept = [c for c in paths.columns if c != "text"]
    blob, spans = fresh("blob", kept), fresh("spans", kept)
    found = after.filter(F.col("version") == version).select(F.col("blob").alias(blob), F.col("spans").alias(spans))
    return paths.select(*kept, blob_of(text_of()).alias(blob)).join(found, blob, "left").select(*kept, blob, spans), after


def _new_rows(paths: DataFrame, ledger: DataFrame | None, rules: tuple[Rule, ...], version: str) -> DataFrame:
    blobs = paths.select(blob_of(text_of()).alias("blob"), text_of().alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is not None:
        blobs = blobs.join(ledger.filter(F.col("version") == version).select("blob"), "blob", "left_anti")
    return written(scan_blobs(blobs, rules, version), "ledger")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """The ledger in a folder, or none if nothing was written there yet.

    Two writers that both missed a blob both wrote it; their rows are alike, and one of each blob and version is read.
    """
    try:
        return spark.read.parquet(path).groupBy("blob", "version").agg(F.first("spans").alias("spans")).select(*LEDGER)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e):
            return None
        raise


def append_ledger(paths: DataFrame, path: str, rules: tuple[Rule, ...] = RULES, version: str = VERSION) -> DataFrame:
    """Scans what the ledger in a folder lacks, adds its rows there, and returns the spans of all rows of paths."""
    spark = paths.sparkSession
    _new_rows(paths, read_ledger(spark, path), rules, version).write.mode("append").parquet(path)
    # All blobs are in the ledger now, so nothing is scanned here.
    return scan(paths, read_ledger(spark, path), rules, version)[0]


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents, from an empty ledger."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found, _ = scan(docs)

    def n(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id",
        *[n(r.kind).alias(f"n_{r.kind}") for r in RULES],
        F.sha2(_joined(F.col("spans")), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        "blob",
    )


def _sql_kind(rule: Rule, rank: int) -> str:
    pattern = rule.pattern.replace("'", "''")
    return f"""SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, unnest(range(len(m))) AS i, unnest(m) AS m, unnest(g) AS g, unnest(p[1:len(m)]) AS gap
        FROM (SELECT doc_id, regexp_extract_all(x, '{pattern}', 0) AS m, regexp_extract_all(x, '{pattern}', {rule.group}) AS g, string_split_regex(x, '{pattern}') AS p FROM d)"""


OP3_SQL = f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
    m AS ({" UNION ALL ".join(_sql_kind(r, k) for k, r in enumerate(RULES))}),
    e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM m),
    s AS (SELECT doc_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
          string_agg(kind || ':' || (stop - length(m))::BIGINT || ':' || stop::BIGINT, ',' ORDER BY stop - length(m), rank) AS spans
          FROM e WHERE length(g) >= CASE rank WHEN 0 THEN {RULES[0].least} WHEN 1 THEN {RULES[1].least} ELSE {RULES[2].least} END GROUP BY doc_id)
    SELECT d.doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex,
        sha256(coalesce(spans, '')) base_sha256, coalesce(spans, '') spans, sha256(x) AS blob
    FROM d LEFT JOIN s USING (doc_id)
"""
