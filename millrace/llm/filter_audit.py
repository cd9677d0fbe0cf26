"""Operator 11, filter interaction audit: every order of the filters is replayed over every document.

A document's flags, one bit for each filter that it fails, are crossed with the broadcast orders (120 for five
filters; their number depends on the filters alone). In each order the document's first failure is found, the steps are exploded, and all counts are
conditional sums by part, order and step, which each task combines before anything is shuffled.

A filter's own test is a condition on the text, but for E, exact copies: the least doc_id of each text, found by an
aggregate that combines the copies in each task, comes back by a join on (text's hash, doc_id), so a text with very many copies is no hot
key. Texts are told apart by their 128-bit MD5.

Defined results. A null text is empty: it fails A, and E where a smaller doc_id has an empty or null text. A null lang is the part ''. A
null doc_id is compared with none: such a row passes E, has no label, and makes no other row fail. Rows that repeat count each; rows that
share the least doc_id of a text all pass E. Of several label rows of a document one with quality 1 makes it good, one with toxic 1
toxic; a document without labels is neither. An empty table has no parts, so no rows. Other columns are not read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import let, text_of, words, written
from millrace.session import table

FILTERS = "ABCDE"
MIN_WORDS = 100
COPIES = FILTERS.index("E")


def text_failures(text: Column) -> Column:
    """The bits of the filters A to D that a text fails."""
    counts = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("words"), F.size(F.array_distinct(w)).cast("long").alias("distinct")))
    upper, size = F.regexp_count(text, F.lit("[A-Z]")).cast("long"), F.length(text)

    def bits(c: Column) -> Column:
        failed = [c["words"] < MIN_WORDS, 100 * c["distinct"] < 80 * c["words"], 100 * upper > 10 * size, text.rlike("[#$%&*|]")]
        return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))

    return let(counts, bits)


def flagged(docs: DataFrame, labels: DataFrame, part: str = "lang") -> DataFrame:
    """(part, fails, good, toxic), one row for each document; fails holds the bits of all filters."""
    text = text_of()
    rows = written(docs.select("doc_id", F.unhex(F.md5(text)).alias("th"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), text_failures(text).alias("fails")), "audit-flags")
    first = rows.groupBy("th").agg(F.min("doc_id").alias("doc_id")).filter("doc_id IS NOT NULL").withColumn("first", F.lit(True))
    marks = labels.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(*[F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False)).alias(to) for c, to in (("quality", "good"), ("toxic", "toxic"))])
    known = rows.filter("doc_id IS NOT NULL").join(first, ["th", "doc_id"], "left").join(marks, "doc_id", "left")
    later = F.when(F.col("first").isNull(), 1 << COPIES).otherwise(0)
    known = known.select("part", (F.col("fails") + later).alias("fails"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])
    unknown = rows.filter("doc_id IS NULL").select("part", "fails", F.lit(False).alias("good"), F.lit(False).alias("toxic"))
    return known.unionByName(unknown)


def orders(spark: SparkSession, filters: str = FILTERS) -> DataFrame:
    """(place, b1, b2, ...): every order of the filters as the bits of its steps."""
    rows = [(i, *[1 << filters.index(f) for f in p]) for i, p in enumerate(permutations(filters))]
    return spark.createDataFrame(rows, ", ".join(["place int", *[f"b{k + 1} int" for k in range(len(filters))]]))


def replayed(flags: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The counts of each part, order and step from rows (part, fails, good, toxic)."""
    steps, fails = [F.col(f"b{k + 1}") for k in range(len(filters))], F.col("fails")
    first = F.coalesce(*[F.when(fails.bitwiseAND(b) != 0, k + 1) for k, b in enumerate(steps)], F.lit(len(filters) + 1))
    each = (
        flags.crossJoin(F.broadcast(orders(flags.sparkSession, filters)))
        .select("part", "place", "fails", "good", "toxic", first.alias("first"), F.posexplode(F.array(*steps)).alias("before", "bit"))
        .withColumn("step", F.col("before") + 1)
    )
    removed = F.col("first") == F.col("step")
    counts = {
        "kept": F.col("first") > F.col("step"),
        "removed": removed,
        "redundant": (fails.bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step")),
        "unique_fails": fails == F.col("bit"),
        "good_lost": removed & F.col("good"),
        "toxic_lost": removed & F.col("toxic"),
    }
    sums = each.groupBy("part", "place", "step", "bit").agg(*[F.count_if(c).alias(name) for name, c in counts.items()])
    # Once aggregated, a part has one row for each order and step.
    total = F.sum("removed").over(Window.partitionBy("part", "bit"))
    names = F.lit(["".join(p) for p in permutations(filters)])
    return sums.select("part", F.get(names, F.col("place")).alias("filter_order"), "step", *counts, total.alias("shapley"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders of the five filters over all documents, by language."""
    return replayed(written(flagged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")), "audit-rows"))


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT doc_id, part, len(w) < 100 AS fa, 100 * len(list_distinct(w)) < 80 * len(w) AS fb,
             100 * len(regexp_extract_all(text, '[A-Z]')) > 10 * length(text) AS fc, regexp_matches(text, '[#$%&*|]') AS fd,
             coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS fe FROM d),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
m AS (SELECT part, [fa, fb, fc, fd, fe] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l USING (doc_id)),
i AS (SELECT unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT [a.i, b.i, c.i, d.i, e.i] AS p FROM i a, i b, i c, i d, i e WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5),
r AS (SELECT part, p, fails, good, toxic, coalesce(list_position(list_transform(p, lambda x: fails[x]), true), 6) AS hit FROM m, o),
s AS (SELECT part, p, i.i AS step, p[i.i] AS filter, count(*) FILTER (hit > i.i) AS kept, count(*) FILTER (hit = i.i) AS removed,
             count(*) FILTER (fails[p[i.i]] AND hit < i.i) AS redundant,
             count(*) FILTER (fails[p[i.i]] AND len(list_filter(fails, lambda x: x)) = 1) AS unique_fails,
             count(*) FILTER (hit = i.i AND good) AS good_lost, count(*) FILTER (hit = i.i AND toxic) AS toxic_lost
      FROM r, i GROUP BY ALL)
SELECT part, array_to_string(list_transform(p, lambda x: chr(64 + x)), '') AS filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley
FROM s
"""
