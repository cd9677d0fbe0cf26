"""Operator 10, quality rules: cutoffs whose false rejections are bounded by exact binomial tests.

Each rule rejects a text whose ratio lies above a cutoff. Cutoffs are chosen for each stratum (the
language) from labelled holdout rows: over a fixed grid, from the loosest cutoff to the strictest, a
cutoff is certified while the Clopper-Pearson upper bound of the share of good texts that it rejects
stays at or under that rule's part of the risk. The grid is a fixed sequence, so it costs no further
correction; strata times rules are corrected by Bonferroni. Of the certified cutoffs the one that
rejects the most bad texts, each good one weighed against several bad ones, is used; a rule that gains
nothing stays off. So with probability 1 - delta, in every stratum all rules together reject at most
the share `risk` of good texts.

The binomial bound needs independent trials, so a labelled text counts once in its stratum however many documents or rows
have it, and a text with labels of both kinds counts not at all. Rules and grid are fixed in advance and nothing else is learned from the labels, so all of
them are holdout rows.

Defined results. A null text is empty: no words, all counts 0, base_failed. Nulls in the stratum form a
stratum of their own. A stratum with no certified cutoff keeps all that passes the base rule. Rows that
repeat are judged alike, each on its own. Labels with a null id or null quality are not used; repeated
label rows count once. An empty table gives no rows, whatever the labels. Columns of the input are kept and may have any names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import fresh, let, small_batches, text_of, word_hashes, words, written
from millrace.session import table

SYMBOLS = "#*$%&|<>"
NOT_SPACE = r"[^\x20\x09-\x0D]"
MIN_WORDS = 50
BLOCK = 500_000
#: Rules: a ratio of a text, high values of which are bad. The grid of cutoffs is the same for all rules.
RULES = ("symbol_share", "upper_share", "dup_line_share", "repeat_share")
GRID = tuple(i / 50 for i in range(50))


@dataclass(frozen=True)
class Cutoff:
    """One certified rule: reject in this stratum when the ratio is above the cutoff."""

    stratum: str | None
    rule: str
    cutoff: float
    n_good: int
    rejected_good: int
    rejected_bad: int
    bound: float


def repeated_words(hashes: pd.Series) -> pd.Series:
    """Words that lie in a 3-word window found twice or more in the same text, for each row."""
    sizes = np.array([len(h) for h in hashes], dtype=np.int64)
    # Whole rows in blocks of about BLOCK words, which bounds the memory of the sort.
    cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // BLOCK)) + 1
    return pd.Series(np.concatenate([_repeated(list(hashes[a:b]), sizes[a:b]) for a, b in zip([0, *cuts], [*cuts, len(sizes)], strict=True)]))


def _repeated(hashes: list[np.ndarray], sizes: np.ndarray) -> np.ndarray:
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *hashes])
    row = np.repeat(np.arange(len(sizes)), sizes)
    if len(flat) < 3:
        return np.zeros(len(sizes), dtype=np.int64)
    inside = np.flatnonzero(row[:-2] == row[2:])
    order = inside[np.lexsort((flat[inside + 2], flat[inside + 1], flat[inside], row[inside]))]
    alike = np.ones(max(len(order) - 1, 0), dtype=bool)
    for k in range(3):
        alike &= flat[order[1:] + k] == flat[order[:-1] + k]
    alike &= row[order[1:]] == row[order[:-1]]
    twice = np.zeros(len(order), dtype=bool)
    twice[1:] |= alike
    twice[:-1] |= alike
    covered = np.zeros(len(flat) + 2, dtype=bool)
    for k in range(3):
        covered[order[twice] + k] = True
    return np.bincount(row, weights=covered[: len(flat)], minlength=len(sizes)).astype(np.int64)


def features(text: Column) -> Column:
    """The counts of a text as one struct: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and more."""
    count = F.pandas_udf(repeated_words, T.LongType())
    sizes = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.length(F.array_join(w, "")).cast("long").alias("chars")))
    lines = let(F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE)), lambda x: F.struct(F.size(x).alias("n"), F.size(F.array_distinct(x)).alias("distinct")))
    return let(
        F.struct(sizes.alias("words"), lines.alias("lines"), count(word_hashes(text)).alias("repeated")),
        lambda c: F.struct(
            c["words"]["n"].alias("n_words"),
            c["words"]["chars"].alias("word_chars"),
            F.regexp_count(text, F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
            (c["lines"]["n"] - c["lines"]["distinct"]).cast("long").alias("n_dup_lines"),
            c["repeated"].alias("n_repeat_words"),
            c["lines"]["n"].cast("long").alias("n_lines"),
            F.regexp_count(text, F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        ),
    )


def ratios(f: Column) -> dict[str, Column]:
    """Each rule's ratio; a text without words has none above 0."""

    def share(a: str, b: str) -> Column:
        return F.when(f[b] > 0, f[a] / f[b].cast("double")).otherwise(F.lit(0.0))

    return {
        "symbol_share": share("n_symbols", "word_chars"),
        "upper_share": share("n_upper", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
    }


def base_failed(f: Column) -> Column:
    """The base rule: too few words, or more than half of them in repeated windows."""
    return (f["n_words"] < MIN_WORDS) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def upper_bound(k: int, n: int, alpha: float) -> float:
    """The exact (Clopper-Pearson) upper bound of a rate of which k of n were seen, at level 1 - alpha."""
    if n == 0 or k >= n:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) for i in range(k + 1)]

    def below(p: float) -> float:
        return sum(math.exp(c + i * math.log(p) + (n - i) * math.log1p(-p)) for i, c in enumerate(logs))

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if 0 < mid < 1 and below(mid) > alpha else (low, mid)
    return high


def certified(counts: list, risk: float, delta: float, weight: float) -> list[Cutoff]:
    """Cutoffs from rows (stratum, rule, step, good, bad): the labelled texts whose ratio is in each step of the grid."""
    by: dict[tuple, dict[int, tuple[int, int]]] = {}
    for r in counts:
        by.setdefault((r["stratum"], r["rule"]), {})[r["step"]] = (r["good"], r["bad"])
    out = []
    alpha = delta / max(1, len(by))
    for (stratum, rule), steps in sorted(by.items(), key=str):
        n_good = sum(g for g, _ in steps.values())
        good = bad = 0
        best = None
        for i in range(len(GRID) - 1, -1, -1):
            g, b = steps.get(i, (0, 0))
            good, bad = good + g, bad + b
            bound = upper_bound(good, n_good, alpha)
            if bound > risk / len(RULES):
                break
            gain = bad - weight * good
            if gain > 0 and (best is None or gain > best[0]):
                best = (gain, Cutoff(stratum, rule, GRID[i], n_good, good, bad, bound))
        if best:
            out.append(best[1])
    return out


def fit(counts: DataFrame, labels: DataFrame, risk: float = 0.02, delta: float = 0.05, weight: float = 5.0) -> list[Cutoff]:
    """Certified cutoffs from all labelled texts that pass the base rule; counts has doc_id, th (the text's hash), stratum and counts.

    Only one row for each stratum, rule and step of the grid comes to the driver, however many rows are
    labelled. A ratio falls in step i when it is above GRID[i] and not above GRID[i + 1].
    """
    good = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).select("doc_id", (F.col("quality") > 0).alias("good")).distinct()
    f = F.col("counts")
    steps = F.array(*[F.struct(F.lit(k).alias("rule"), _step(v).alias("step")) for k, v in ratios(f).items()])
    rows = counts.filter(~base_failed(f)).select("doc_id", "th", "stratum", steps.alias("steps")).join(good, "doc_id")
    trials = rows.groupBy("th", "stratum").agg(F.bool_and("good").alias("good"), F.bool_or("good").alias("any_good"), F.first("steps").alias("steps")).filter("good = any_good")
    found = (
        trials.select("stratum", "good", F.explode("steps").alias("r"))
        .select("stratum", "good", "r.*")
        .groupBy("stratum", "rule", "step")
        .agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    )
    return certified(found.collect(), risk, delta, weight)


def _step(ratio: Column) -> Column:
    return (F.ceil(F.least(ratio, F.lit(1.0)) * len(GRID)) - 1).cast("int")


def verdict(f: Column, stratum: Column, cutoffs: list[Cutoff]) -> Column:
    """True for a text that passes the base rule and every certified cutoff of its stratum."""
    by = ratios(f)
    reject = F.lit(False)
    for c in cutoffs:
        reject = reject | (stratum.eqNullSafe(F.lit(c.stratum).cast("string")) & (_step(by[c.rule]) >= F.lit(GRID.index(c.cutoff))))
    return ~base_failed(f) & ~reject


def _measures(stratum: str) -> list[Column]:
    """doc_id, th, the stratum and the counts of a document, as fit() reads them."""
    return [F.col("doc_id"), F.xxhash64(text_of()).alias("th"), F.col(stratum).cast("string").alias("stratum"), features(text_of()).alias("counts")]


def counted(docs: DataFrame, stratum: str) -> DataFrame:
    """The measures of every document, written once: both the fit and the verdict read them."""
    small_batches(docs.sparkSession)
    return written(docs.select(*_measures(stratum)), "quality-counts")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their counts, the base rule and the verdict."""
    counts = counted(table(spark, sf_dir, "documents"), "lang")
    cutoffs = fit(counts, table(spark, sf_dir, "labels"))
    f = F.col("counts")
    return counts.select(
        "doc_id",
        *[f[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        base_failed(f).alias("base_failed"),
        verdict(f, F.col("stratum"), cutoffs).alias("kept"),
        "stratum",
    )


def quality_stage(docs: DataFrame, labels: DataFrame, stratum: str = "lang", **settings) -> DataFrame:
    """The documents that are kept, with their own columns.

    They are written once with their measures: the fit reads these only, and no text is counted twice.
    """
    small_batches(docs.sparkSession)
    name = fresh("measures", docs.columns)
    rows = written(docs.withColumn(name, F.struct(*_measures(stratum))), "quality-documents")
    cutoffs = fit(rows.select(f"{name}.*"), labels, **settings)
    return rows.filter(verdict(F.col(name)["counts"], F.col(name)["stratum"], cutoffs)).select(*docs.columns)
