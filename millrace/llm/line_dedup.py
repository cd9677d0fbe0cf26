"""Operator 1, line dedup: winnowing over line hashes.

The minimum of each window of `run` consecutive line hashes (the rightmost, on ties) is a fingerprint,
so any run of that many lines that two places share has its fingerprint in both: none is missed, and
only fingerprints, which are fewer than lines, are compared over the whole corpus. Fingerprints found at one place only
are dropped. The positions of the others are extended both ways over the lines around them, as far as a window of `run` lines
still has its minimum there; a position is joined with the first position from which the same lines
follow and precede, in the order of doc_id, then of the text's hash, then of the line; and every window
that comes later is a repeated run. A longer match is the union of its windows, so runs grow to their full length without
comparing pairs. Lines in a later repeated run are deleted.

With `least`, a run is measured by its content too: a line of `least` words or more and the whole of a text of one
line that isn't blank are windows of their own, whatever their neighbours are, and their own fingerprints. The pipeline's stage and op1_content_line_dedup have this
rule; op1_winnow_line_dedup keeps the rule of its SQL, runs of RUN lines only.

Lines are told apart by two 64-bit hashes with different seeds.

Defined results. Lines are what lies between \\n. A null text stays null and is treated as empty. A text
of fewer lines than `run` is kept whole, without `least`. Rows with the same doc_id and text are one document: each
gets the same result. A null doc_id comes first in the order. Runs that repeat in one document, also
where they overlap, are later runs too. A document may lose all its lines: its text is then empty.
An empty table gives no rows. Columns of the input are kept and may have any names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import Scratch, fresh, let, same, text_of, words
from millrace.session import table

RUN = 2
LEAST = 10  # words of a line that is a window of its own


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def fingerprints(docs: DataFrame, run: int, least: int | None = None) -> DataFrame:
    """One row for each position of a fingerprint: fp, doc_id, th, pos, and the lines `around` it, up to run - 1 before (the first is line `low`) and after.

    A line is (h, back, g): its hash, minus its number, and another hash. Windows have `size` lines.
    """
    each = let(
        F.transform(_lines(text_of()), lambda x, i: F.struct(F.xxhash64(x).alias("h"), (-i).alias("back"), F.xxhash64(F.lit("line"), x).alias("g"))),
        lambda z: F.when(
            F.size(z) >= run,
            F.transform(
                # A window's least (hash, -number) is its minimum, the rightmost on ties.
                F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(z) - run), lambda a: -F.array_min(F.slice(z, a + 1, run))["back"])),
                lambda p: F.struct(F.get(z, p)["h"].alias("fp"), p.alias("pos"), F.slice(z, F.greatest(p - run + 2, F.lit(1)), F.least(p + 1, F.lit(run)) + run - 1).alias("around")),
            ),
        ),
    )
    rows = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), F.explode(each).alias("w"))
    found = rows.select("doc_id", "th", "w.fp", "w.pos", "w.around", F.lit(run).alias("size"))
    if least is None:
        return found
    # A window of one line is its own fingerprint, salted so that no line of a longer window has it.
    alone = docs.select("doc_id", F.xxhash64(text_of()).alias("th"), F.posexplode(_lines(text_of())).alias("pos", "line"), (~F.contains(text_of(), F.lit("\n"))).alias("whole"))
    alone = alone.filter(F.size(words(F.col("line"))) >= F.when(F.col("whole"), 1).otherwise(least))
    h, g = F.xxhash64(F.lit("alone"), "line"), F.xxhash64(F.lit("line"), "line")
    around = F.array(F.struct(h.alias("h"), (-F.col("pos")).alias("back"), g.alias("g")))
    return found.unionByName(alone.select("doc_id", "th", h.alias("fp"), "pos", around.alias("around"), F.lit(1).alias("size")))


def extended(found: DataFrame) -> DataFrame:
    """(doc_id, th, start, end, key, key2): the windows around each fingerprint whose minimum it is; two windows have equal keys if their lines are equal."""

    def window(a: Column) -> Column:
        part = F.slice("around", a + 1, F.col("size"))
        start = -F.get("around", a)["back"]
        keys = F.xxhash64("size", F.transform(part, lambda x: x["h"])).alias("key"), F.xxhash64("size", F.transform(part, lambda x: x["g"])).alias("key2")
        return F.struct(start.alias("start"), (start + F.col("size") - 1).alias("end"), (-F.array_min(part)["back"] == F.col("pos")).alias("own"), *keys)

    each = found.select("doc_id", "th", F.explode(F.transform(F.sequence(F.lit(0), F.size("around") - F.col("size")), window)).alias("w"))
    return each.filter("w.own").select("doc_id", "th", "w.start", "w.end", "w.key", "w.key2")


def later_runs(docs: DataFrame, run: int = RUN, least: int | None = None) -> DataFrame:
    """(doc_id, th, spans): the first and last lines of the later repeated windows of a document."""
    found = fingerprints(docs, run, least)
    at = F.struct("doc_id", "th", "pos")
    shared = found.groupBy("fp").agg(F.min(at).alias("a"), F.max(at).alias("b")).filter("a <> b").select("fp")
    scratch = Scratch(docs.sparkSession, "line-dedup")
    near = scratch.keep(extended(found.join(scratch.keep(shared, "fingerprints").hint("merge"), "fp", "left_semi")), "windows")
    place = F.struct("doc_id", "th", "start")
    first = near.groupBy("key", "key2").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last").select("key", "key2", "first")
    later = near.join(scratch.keep(first, "first-runs").hint("merge"), ["key", "key2"]).filter(place > F.col("first"))
    spans = scratch.keep(later.groupBy("doc_id", "th").agg(F.collect_set(F.struct("start", "end")).alias("spans")), "later-runs")
    scratch.drop("fingerprints", "windows", "first-runs")
    return spans


def dedup_lines(docs: DataFrame, run: int = RUN, least: int | None = None, counts: str = "__line_dedup") -> DataFrame:
    """The documents, text without later repeated runs, and a struct column `counts` of n_lines and n_removed."""
    gone, at, spans = later_runs(docs.select("doc_id", "text"), run, least), fresh("th", docs.columns), fresh("spans", docs.columns)
    of = fresh("of", docs.columns)
    gone = gone.select(F.col("doc_id").alias(of), F.col("th").alias(at), F.col("spans").alias(spans))
    # A sort-merge join at every size: a broadcast that fits small inputs only would change the plan as they grow.
    joined = docs.join(gone.hint("merge"), same(F.col("doc_id"), F.col(of)) & (F.xxhash64(text_of()) == F.col(at)), "left")
    lost = F.flatten(F.transform(spans, lambda s: F.sequence(s["start"], s["end"])))
    kept = let(
        _lines(F.col("text")),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), lost), lambda p: F.get(ls, p)), "\n"),
    )
    n_lines, n_removed = F.size(_lines(text_of())), F.coalesce(F.size(F.array_distinct(lost)), F.lit(0))
    # size() of null is -1 unless ANSI rules say null.
    removed = F.when(F.col(spans).isNull(), F.lit(0)).otherwise(n_removed)
    numbers = F.struct(n_lines.cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(kept)
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], numbers.alias(counts))


def op1_winnow_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of two lines or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "__line_dedup.n_lines", "__line_dedup.n_removed", "text")


def op1_content_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later repeated runs of two lines or more, lines of LEAST words or more and texts of one line."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, least=LEAST).select("doc_id", "__line_dedup.n_lines", "__line_dedup.n_removed", "text")


def line_dedup_stage(docs: DataFrame) -> DataFrame:
    """The documents with their own columns; n_chars, where there is one, follows the text."""
    out = dedup_lines(docs, least=LEAST, counts=fresh("counts", docs.columns))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def dedup_sql(source: str, run: int = RUN) -> str:
    """DuckDB SQL: (doc_id, n_lines, n_removed, text) of a relation with unique ids."""
    shift = " || chr(10) || ".join(["l"] + [f"lead(l, {k}) OVER w" for k in range(1, run)])
    return f"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i FROM {source}),
    win AS (SELECT doc_id, i, {shift} AS key FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
    ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY key ORDER BY doc_id, i) AS r FROM win WHERE key IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, unnest(range({run})) AS u(k) WHERE r > 1),
    kept AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS text
             FROM lines LEFT JOIN gone AS g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text AS text FROM {source} LEFT JOIN kept USING (doc_id)
    """


OP1_SQL = dedup_sql("documents")


def content_sql(source: str, run: int = RUN, least: int = LEAST) -> str:
    """DuckDB SQL of dedup_lines() with least: (doc_id, n_lines, n_removed, text) of a relation with unique ids."""
    shift = " || chr(10) || ".join(["l"] + [f"lead(l, {k}) OVER w" for k in range(1, run)])
    return rf"""
    WITH lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(len(string_split(text, chr(10))))) AS i, len(string_split(text, chr(10))) AS n FROM {source}),
    win AS (SELECT doc_id, i, {run} AS size, {shift} AS key FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY i)
            UNION ALL SELECT doc_id, i, 1, l FROM lines WHERE len(regexp_extract_all(l, '[^ 	-
]+')) >= CASE WHEN n = 1 THEN 1 ELSE {least} END),
    ranked AS (SELECT doc_id, i, size, row_number() OVER (PARTITION BY size, key ORDER BY doc_id, i) AS r FROM win WHERE key IS NOT NULL),
    gone AS (SELECT DISTINCT doc_id, i + k AS i FROM ranked, unnest(range({run})) AS u(k) WHERE r > 1 AND k < size),
    kept AS (SELECT doc_id, count(*) AS n_lines, count(g.i) AS n_removed, coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (g.i IS NULL), '') AS text
             FROM lines LEFT JOIN gone AS g USING (doc_id, i) GROUP BY doc_id)
    SELECT doc_id, coalesce(n_lines, 1) AS n_lines, coalesce(n_removed, 0) AS n_removed, kept.text AS text FROM {source} LEFT JOIN kept USING (doc_id)
    """


OP1_CONTENT_SQL = content_sql("documents")
