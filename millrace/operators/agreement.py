"""Raters and prompts: kappa, agreement, overlaps, binned success, best configurations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cells(rows: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """yes_yes, yes_no, no_yes and no_no of two boolean columns; rows that a rater left out don't count."""
    x, y = F.col(a), F.col(b)
    both = rows.filter(x.isNotNull() & y.isNotNull())
    return both.groupBy(*group).agg(F.count_if(x & y).alias("yes_yes"), F.count_if(x & ~y).alias("yes_no"), F.count_if(~x & y).alias("no_yes"), F.count_if(~x & ~y).alias("no_no"))


def kappa() -> Column:
    """Cohen's kappa of the four cells; null without rows or where a rater is constant."""
    yy, yn, ny, nn = (F.col(c).cast("double") for c in ("yes_yes", "yes_no", "no_yes", "no_no"))
    n = yy + yn + ny + nn
    a, b = yy + yn, yy + ny
    chance = (a * b + (n - a) * (n - b)) / (n * n)
    constant = (n == 0) | (a == 0) | (a == n) | (b == 0) | (b == n)
    return F.when(~constant, ((yy + nn) / n - chance) / (1 - chance))


def pairwise(judged: DataFrame) -> DataFrame:
    """Cells and kappa of each pair of raters; judged has rater, id and match."""
    a = judged.select(F.col("rater").alias("a"), "id", F.col("match").alias("x"))
    b = judged.select(F.col("rater").alias("b"), "id", F.col("match").alias("y"))
    return cells(a.join(b, "id").filter("a < b"), ["a", "b"], "x", "y").withColumn("kappa", kappa())


def overlap(universe: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """only_a, only_b, both and neither of two id sets in a universe of ids."""
    flags = [d.select("id").distinct().withColumn(f"in_{n}", F.lit(True)) for n, d in (("a", a), ("b", b))]
    rows = universe.select("id").distinct().join(flags[0], "id", "left").join(flags[1], "id", "left").select(F.coalesce("in_a", F.lit(False)).alias("a"), F.coalesce("in_b", F.lit(False)).alias("b"))
    x, y = F.col("a"), F.col("b")
    return rows.agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y).alias("both"), F.count_if(~x & ~y).alias("neither"))


def binned(spark, rows: DataFrame, value: str, a: str, b: str, width: int, cap: int, least: int) -> DataFrame:
    """(bin, label, n, mean_a, mean_b) over bins of one width up to cap, and an open one beyond; empty bins stay, with null means.

    Bins end at cap and reach down to least: a bin is (low, high], the first one has all that is lower.
    """
    n = -(-(cap - least) // width)
    start = cap - n * width
    bins = spark.range(n + 1).select(F.col("id").cast("int").alias("bin"))
    label = F.when(F.col("bin") == n, F.lit(f"{cap}+")).otherwise(F.concat((F.col("bin") * width + start).cast("string"), F.lit("-"), ((F.col("bin") + 1) * width + start).cast("string")))
    at = F.least(F.greatest(F.ceil((F.col(value) - start) / width) - 1, F.lit(0)), F.lit(n)).cast("int")
    means = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return bins.join(F.broadcast(means), "bin", "left").select("bin", label.alias("label"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_a", "mean_b")


def bin_gaps(bins: DataFrame) -> DataFrame:
    """The bins where b gains most and least on a, the first on ties, and how many are tied or behind."""
    gap = F.col("mean_b") - F.col("mean_a")
    full = bins.filter("n > 0").withColumn("gap", gap)
    return full.agg(
        F.max_by("label", F.struct("gap", -F.col("bin"))).alias("best"),
        F.min_by("label", F.struct("gap", "bin")).alias("worst"),
        F.count_if(F.col("gap") == 0).alias("tied"),
        F.count_if(F.col("gap") < 0).alias("behind"),
    )


def best_per_metric(results: DataFrame, group: list[str], name: str, order: str) -> DataFrame:
    """The name with the greatest value in each group, the first in order on ties."""
    return results.groupBy(*group).agg(F.max_by(name, F.struct("value", -F.col(order))).alias("best"), F.max("value").alias("value"))


def with_default(passing: DataFrame, annotations: DataFrame) -> DataFrame:
    """Passing ids with their judgement; one without counts as a match. Judgements of other ids are dropped."""
    return passing.join(annotations.select("id", "match", "category"), "id", "left").withColumn("match", F.coalesce("match", F.lit(True)))


def collapsed(records: DataFrame) -> DataFrame:
    """(data_id, match, categories, auto) of records (data_id, entries); entries hold match, category (array) and note.

    A record matches if all its entries that say yes or no say yes, and is null if none does. Categories keep the order in which
    they come first. auto: a note ends with [auto]. Records without a data_id are left out.
    """
    said = F.filter(F.transform("entries", lambda e: F.lower(F.trim(e["match"]))), lambda m: m.isin("yes", "no"))
    match = F.when(F.size(said) > 0, F.forall(said, lambda m: m == "yes"))
    categories = F.array_distinct(F.flatten(F.transform("entries", lambda e: F.coalesce(e["category"], F.array().cast("array<string>")))))
    auto = F.exists("entries", lambda e: F.coalesce(F.trim(e["note"]).endswith("[auto]"), F.lit(False)))
    return records.filter(F.coalesce(F.col("data_id") != "", F.lit(False))).select("data_id", match.alias("match"), categories.alias("categories"), auto.alias("auto"))


def summary(samples: DataFrame, order: str) -> DataFrame:
    """(name, place, n, pct) of samples (match, categories, order): yes, no and unknown of all, each category of the samples that don't match.

    Categories come by their count, then as first seen in the order given; place numbers them from 0. Percentages are not rounded; without
    a sample to divide by they are null.
    """
    counts = samples.agg(F.count("*").alias("n"), F.count_if("match").alias("yes"), F.count_if(~F.col("match")).alias("no"))
    rows = {"total": ("n", "n"), "yes": ("yes", "n"), "no": ("no", "no"), "unknown": (None, "n")}
    value = {k: F.col(a) if a else F.col("n") - F.col("yes") - F.col("no") for k, (a, _) in rows.items()}
    fixed = counts.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(None).cast("long").alias("place"), value[k].alias("n"), F.when(F.col(b) > 0, 100.0 * value[k] / F.col(b)).alias("pct")) for k, (_, b) in rows.items()])))
    each = samples.filter(~F.col("match")).select(order, F.posexplode("categories").alias("at", "name"))
    tally = each.groupBy("name").agg(F.count("*").alias("n"), F.min(F.struct(order, "at")).alias("first"))
    placed = tally.withColumn("place", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long"))  # one row for each category
    wrong = samples.agg(F.count_if(~F.col("match")).alias("no"))
    return fixed.unionByName(placed.crossJoin(F.broadcast(wrong)).select("name", "place", "n", F.when(F.col("no") > 0, 100.0 * F.col("n") / F.col("no")).alias("pct")))


def verdicts(passing: DataFrame, samples: DataFrame, order: str) -> DataFrame:
    """(id, match, labelled, judged) of each passing id by one rater's samples (id, match, auto, order).

    The last sample of an id counts; one without a match is none. An id without a sample matches by default.
    Labelled ids have a sample, judged ones a sample that no rule decided.
    """
    last = samples.filter(F.col("match").isNotNull()).groupBy("id").agg(F.max_by(F.struct("match", "auto"), order).alias("x"))
    joined = passing.select("id").join(last, "id", "left")
    has = F.col("x").isNotNull()
    return joined.select("id", F.coalesce("x.match", F.lit(True)).alias("match"), has.alias("labelled"), (has & ~F.coalesce("x.auto", F.lit(False))).alias("judged"))


def agreement(scored: DataFrame) -> DataFrame:
    """For each pair of raters a < b the cells, agreement and kappa over the ids that both judged, and their differences over all ids.

    scored (rater, id, match, labelled, judged), as verdicts() gives it for each rater. A difference is between two labels or from a default.
    """
    sides = [scored.select(F.col("rater").alias(r), "id", *[F.col(c).alias(f"{c}_{r}") for c in ("match", "labelled", "judged")]) for r in "ab"]
    both = sides[0].join(sides[1], "id").filter("a < b")
    x, y = F.col("match_a"), F.col("match_b")
    j, labelled, differ = F.col("judged_a") & F.col("judged_b"), F.col("labelled_a") & F.col("labelled_b"), F.col("match_a") != F.col("match_b")
    out = both.groupBy("a", "b").agg(
        F.count_if(j).alias("total"),
        F.count_if(j & ~differ).alias("agree"),
        F.count_if(j & differ).alias("disagree"),
        F.count_if(j & x & y).alias("yes_yes"),
        F.count_if(j & x & ~y).alias("yes_no"),
        F.count_if(j & ~x & y).alias("no_yes"),
        F.count_if(j & ~x & ~y).alias("no_no"),
        F.count_if(differ & labelled).alias("disagree_both_labelled"),
        F.count_if(differ & ~labelled).alias("disagree_from_default"),
    )
    return out.withColumn("agreement_pct", F.when(F.col("total") > 0, 100.0 * F.col("agree") / F.col("total")).otherwise(0.0)).withColumn("kappa", kappa())


def kappa_range(pairs: DataFrame) -> DataFrame:
    """The least and greatest kappa of the pairs that have one, and how many do."""
    return pairs.agg(F.min("kappa").alias("least"), F.max("kappa").alias("greatest"), F.count("kappa").alias("n"))


def improvement(results: DataFrame, keys: list[str], name: str, base: str, other: str) -> DataFrame:
    """(keys, gain): how many points, of percentages at two places, one configuration is above another; both must be there."""
    sides = [results.filter(F.col(name) == n).select(*keys, F.bround(100 * F.col("value"), 2).alias(c)) for n, c in ((base, "before"), (other, "after"))]
    return sides[0].join(sides[1], keys).select(*keys, (F.col("after") - F.col("before")).alias("gain"))


def comparison(a: DataFrame, b: DataFrame) -> DataFrame:
    """(no_difference, rate_difference, category_difference) of two summaries (name, place, n, pct).

    The differences of the counts and of the shares of samples that don't match, and the largest of a category's percentages.
    """
    left, right = (x.select("name", F.col("place").isNotNull().alias("category"), F.col("n").alias(f"n_{s}"), F.col("pct").alias(f"pct_{s}")) for x, s in ((a, "a"), (b, "b")))
    both = left.join(right, ["name", "category"], "full")
    no, total = (F.max(F.when((F.col("name") == n) & ~F.col("category"), F.struct("n_a", "n_b"))) for n in ("no", "total"))
    gap = F.max(F.when(F.col("category"), F.abs(F.coalesce("pct_a", F.lit(0.0)) - F.coalesce("pct_b", F.lit(0.0)))))
    one = both.agg(no.alias("no"), total.alias("total"), gap.alias("category_difference"))
    rate = F.abs(100.0 * F.col("no.n_a") / F.col("total.n_a") - 100.0 * F.col("no.n_b") / F.col("total.n_b"))
    return one.select(F.abs(F.col("no.n_a") - F.col("no.n_b")).alias("no_difference"), rate.alias("rate_difference"), "category_difference")


def in_all(*ids: DataFrame) -> DataFrame:
    """The ids that are in every set."""
    out = ids[0].select("id")
    for more in ids[1:]:
        out = out.intersect(more.select("id"))
    return out


def unlike(a: DataFrame, b: DataFrame) -> DataFrame:
    """(id, side): ids of one set only, `missing` from b or `extra` in it."""
    left, right = (x.select("id").distinct() for x in (a, b))
    return left.join(right, "id", "left_anti").withColumn("side", F.lit("missing")).unionByName(right.join(left, "id", "left_anti").withColumn("side", F.lit("extra")))


def checked_overlap(universe: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """overlap(), but an id outside the universe is an error when the result is read."""
    known = universe.select("id").distinct().withColumn("known", F.lit(True))
    every = a.select("id").union(b.select("id")).distinct().join(known, "id", "left")
    strange = every.agg(F.count_if(F.col("known").isNull()).alias("strange"))
    out = overlap(universe, a, b).crossJoin(F.broadcast(strange))
    return out.filter(F.when(F.col("strange") > 0, F.raise_error(F.lit("ids outside the universe")).cast("boolean")).otherwise(F.lit(True))).drop("strange")


def by_category(a: DataFrame, b: DataFrame) -> DataFrame:
    """(category, only_a, only_b, both) of the samples (id, match, categories) that are in both sets and don't match there."""
    flags = []
    for rows, mine, others in ((a, "in_a", b), (b, "in_b", a)):
        shared = rows.join(others.select("id"), "id", "left_semi").filter(~F.col("match"))
        flags.append(shared.select("id", F.explode("categories").alias("category")).distinct().withColumn(mine, F.lit(True)))
    both = flags[0].join(flags[1], ["id", "category"], "full")
    x, y = (F.coalesce(c, F.lit(False)) for c in ("in_a", "in_b"))
    return both.groupBy("category").agg(F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(x & y).alias("both"))


def id_number(id: Column) -> Column:
    """The number of an id prefix-N, by which ids are sorted."""
    return F.split_part(id, F.lit("-"), F.lit(2)).cast("long")


def most_common(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, n, place): keys by their count, then as first seen; place from 0. One row for each key is ordered."""
    tally = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return tally.select(key, "n", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("place"))
