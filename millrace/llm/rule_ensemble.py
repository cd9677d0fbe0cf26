"""Operator 13, quality classifier: a sparse ensemble of rules over a text's statistics.

Statistics of each text are columns of built-in functions. From a bounded sample of labelled rows, boosted trees of small depth are
grown; every path from a root to a node is a conjunctive rule; a logistic model of the rules with a lasso penalty keeps few of
them, and these are compiled into one Column expression, so all documents are scored without Python.

The sample: the SAMPLE labelled training rows with the least hashes of doc_id. Training rows are those whose crc32(doc_id as
text) isn't divisible by FOLDS; the penalty is the one of PENALTIES that does best on the training rows with remainder FOLDS - 1 when
fitted to the others, and the model is then fitted to all of them. Labels, language, source and ids are inputs of no score.

Defined results. A null text is empty, and an empty text is scored by its statistics, which are all 0. A null doc_id counts as the text '', which is held out. Labels with a null id or
null quality aren't used, nor are those of a document that has labels of both kinds; repeated label rows count once. Rows that repeat are scored
alike. Without usable labels every score is 0.5; where all are of one kind it is (good + 1) / (labels + 2). An empty table gives no rows. The
columns of the input aren't kept.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm.common import let, text_of, words, written
from millrace.session import table

#: Labelled rows that a fit reads at most, so the driver holds SAMPLE times the number of statistics.
SAMPLE = 20_000
FOLDS = 5
CUTOFF = 0.3
TREES, DEPTH, RATE, LEAST, BINS = 30, 3, 0.3, 10, 32
PENALTIES = (0.03, 0.01, 0.003, 0.001, 0.0003)
CLASSES = {
    "upper": r"\p{Lu}",
    "others": r"[^\p{L}\x20\x09-\x0D]",
    "digits": r"\p{N}",
    "symbols": r"[#*$%&|<>@^~_=+\\{}\[\]]",
    "stops": r"[.!?;:,]",
    "spaces": r"[\x20\x09-\x0D]",
    "runs": r"[^\p{L}\p{N}\x20\x09-\x0D]{2,}",
}
#: The statistics of a text, in order.
STATISTICS = (
    "words mean_word longest_word distinct_share single_share repeat_share symbol_runs upper_share letter_share digit_share symbol_share stop_share space_share "
    "lines words_a_line dup_line_share short_line_share stopped_line_share"
).split()


@dataclass(frozen=True)
class Rule:
    """A conjunction over statistics: (place in STATISTICS, True for >, threshold), all of which must hold."""

    parts: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for k, above, cut in self.parts:
            out &= (x[:, k] > cut) == above
        return out

    def column(self, stats: Column) -> Column:
        out = F.lit(True)
        for k, above, cut in self.parts:
            value = stats[STATISTICS[k]]
            out = out & (value > F.lit(cut) if above else value <= F.lit(cut))
        return out

    def __str__(self) -> str:
        return " and ".join(f"{STATISTICS[k]} {'>' if above else '<='} {cut:.6g}" for k, above, cut in self.parts)


@dataclass(frozen=True)
class Ensemble:
    """The probability of a good text: the logistic function of the bias and of the weights of all rules that hold."""

    bias: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def column(self, stats: Column) -> Column:
        total = sum((F.when(r.column(stats), F.lit(w)).otherwise(F.lit(0.0)) for r, w in zip(self.rules, self.weights, strict=True)), F.lit(self.bias))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            total += w * r.holds(x)
        return 1 / (1 + np.exp(-total))


def statistics(text: Column) -> Column:
    """A struct of STATISTICS, all doubles; shares of nothing are 0."""

    def share(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b.cast("double")).otherwise(F.lit(0.0))

    def threes(w: Column) -> Column:
        return F.when(
            F.size(w) >= 3,
            let(F.transform(w, lambda x: F.xxhash64(x)), lambda h: F.size(F.array_distinct(F.transform(F.sequence(F.lit(0), F.size(h) - 3), lambda i: F.xxhash64(F.get(h, i), F.get(h, i + 1), F.get(h, i + 2)))))),
        ).otherwise(0)

    of_words = let(
        words(text),
        lambda w: F.struct(
            F.size(w).alias("n"),
            F.coalesce(F.array_max(F.transform(w, F.length)), F.lit(0)).alias("longest"),
            F.size(F.array_distinct(w)).alias("distinct"),
            F.size(F.filter(w, lambda x: F.length(x) == 1)).alias("single"),
            threes(w).alias("threes"),
        ),
    )
    of_lines = let(
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")),
        lambda x: F.struct(
            F.size(x).alias("n"),
            F.size(F.array_distinct(x)).alias("distinct"),
            F.size(F.filter(x, lambda y: F.length(y) < 20)).alias("short"),
            F.size(F.filter(x, lambda y: y.rlike(r"[.!?]\s*$"))).alias("stopped"),
        ),
    )
    found = F.struct(of_words.alias("w"), of_lines.alias("l"), F.length(text).alias("n"), *[F.regexp_count(text, F.lit(c)).alias(k) for k, c in CLASSES.items()])

    def all_of(c: Column) -> Column:
        w, line, n = c["w"], c["l"], c["n"]
        chars = n - c["spaces"]
        letters = chars - c["others"]
        values = {
            "words": w["n"],
            "mean_word": share(chars, w["n"]),
            "longest_word": w["longest"],
            "distinct_share": share(w["distinct"], w["n"]),
            "single_share": share(w["single"], w["n"]),
            "repeat_share": F.when(w["n"] >= 3, 1 - w["threes"] / (w["n"] - 2)).otherwise(F.lit(0.0)),
            "symbol_runs": share(c["runs"], w["n"]),
            "upper_share": share(c["upper"], letters),
            "letter_share": share(letters, chars),
            **{f"{k}_share": share(c[f"{k}s"], chars) for k in ("digit", "symbol", "stop")},
            "space_share": share(c["spaces"], n),
            "lines": line["n"],
            "words_a_line": share(w["n"], line["n"]),
            "dup_line_share": share(line["n"] - line["distinct"], line["n"]),
            "short_line_share": share(line["short"], line["n"]),
            "stopped_line_share": share(line["stopped"], line["n"]),
        }
        return F.struct(*[values[k].cast("double").alias(k) for k in STATISTICS])

    return let(found, all_of)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo FOLDS; 0 is held out."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS).cast("int")


def grown(x: np.ndarray, y: np.ndarray) -> list[Rule]:
    """The paths of boosted regression trees for the logistic loss, as distinct rules."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[:-1])) for c in x.T]
    bins = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T, strict=True)], axis=1)
    rules: dict[Rule, None] = {}
    mean = y.mean()
    total = np.full(len(y), math.log(mean / (1 - mean)))

    def split(rows: np.ndarray, path: tuple, depth: int, gradient: np.ndarray, hessian: np.ndarray) -> None:
        if path:
            rules[Rule(_short(path))] = None
        g, h = gradient[rows].sum(), hessian[rows].sum()
        best = None
        for k in range(x.shape[1]) if depth < DEPTH else ():
            size = len(cuts[k])
            left_n, left_g, left_h = (np.cumsum(np.bincount(bins[rows, k], weights=v, minlength=size + 1))[:size] for v in (np.ones(len(rows)), gradient[rows], hessian[rows]))
            gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
            gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = 0
            at = int(np.argmax(gain)) if size else 0
            if size and gain[at] > 1e-6 and (best is None or gain[at] > best[0]):
                best = (gain[at], k, at)
        if best is None:
            total[rows] += RATE * g / (h + 1)
            return
        _, k, at = best
        low = bins[rows, k] <= at
        for side, above in ((rows[low], False), (rows[~low], True)):
            split(side, (*path, (k, above, float(cuts[k][at]))), depth + 1, gradient, hessian)

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-total))
        split(np.arange(len(y)), (), 0, y - p, p * (1 - p))
    return list(rules)


def _short(path: tuple) -> tuple[tuple[int, bool, float], ...]:
    """The path's conditions, one for each statistic and side."""
    tight: dict[tuple[int, bool], float] = {}
    for k, above, cut in path:
        tight[k, above] = (max if above else min)(cut, tight.get((k, above), cut))
    return tuple(sorted((k, above, cut) for (k, above), cut in tight.items()))


def lasso(z: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 600) -> tuple[float, np.ndarray]:
    """(bias, weights) of the least logistic loss plus penalty times the weights' absolute sum, by accelerated proximal gradient."""
    n, m = z.shape
    mean = y.mean()
    w = v = np.concatenate([[math.log(mean / (1 - mean))], np.zeros(m)])
    full = np.concatenate([np.ones((n, 1)), z], axis=1)
    # The largest eigenvalue of the Gram matrix bounds the curvature, by power iteration.
    u = np.ones(m + 1)
    for _ in range(30):
        u = full.T @ (full @ u)
        u /= np.linalg.norm(u)
    step = 4 * n / (1.05 * float(np.linalg.norm(full @ u)) ** 2)
    t = 1.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-(full @ v)))
        new = v - step * (full.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t, before = (1 + math.sqrt(1 + 4 * t * t)) / 2, t
        v = new + (before - 1) / t * (new - w)
        w = new
    return float(w[0]), w[1:]


def _loss(y: np.ndarray, p: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit_sample(x: np.ndarray, y: np.ndarray, part: np.ndarray) -> Ensemble:
    """The ensemble of labelled rows; part is their fold, of which FOLDS - 1 chooses the penalty."""
    if len(y) == 0:
        return Ensemble(0.0)
    if y.min() == y.max():
        p = (y.sum() + 1) / (len(y) + 2)
        return Ensemble(math.log(p / (1 - p)))

    def fitted(x: np.ndarray, y: np.ndarray, penalties: tuple[float, ...]) -> list[Ensemble]:
        rules = [r for r in grown(x, y) if 0 < r.holds(x).mean() < 1]
        held = [r.holds(x) for r in rules]
        first = {h.tobytes(): r for h, r in zip(reversed(held), reversed(rules), strict=True)}
        rules = [r for h, r in zip(held, rules, strict=True) if first[h.tobytes()] is r]
        z = np.stack([r.holds(x) for r in rules], axis=1).astype(float) if rules else np.zeros((len(y), 0))
        out = []
        for penalty in penalties:
            bias, w = lasso(z, y, penalty)
            some = np.flatnonzero(w)
            out.append(Ensemble(bias, tuple(rules[i] for i in some), tuple(float(w[i]) for i in some)))
        return out

    check = part == FOLDS - 1
    penalty = PENALTIES[2]
    if 0 < check.sum() < len(y) and y[~check].min() < y[~check].max():
        losses = [_loss(y[check], e.predict(x[check])) for e in fitted(x[~check], y[~check], PENALTIES)]
        penalty = PENALTIES[int(np.argmin(losses))]
    return fitted(x, y, (penalty,))[0]


def fit(rows: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Ensemble:
    """The ensemble learned from the labelled training rows of (doc_id, stats), of which at most `sample` are read."""
    good = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min(F.col("quality") > 0).alias("good"), F.max(F.col("quality") > 0).alias("any")).filter("good = any")
    part = fold(F.col("doc_id"))
    known = rows.filter(part != 0).join(good.select("doc_id", "good"), "doc_id").select(F.xxhash64("doc_id").alias("order"), "doc_id", part.alias("part"), "good", "stats.*")
    found = known.orderBy("order", "doc_id", *STATISTICS).limit(sample).toArrow()
    x = np.stack([found.column(k).to_numpy() for k in STATISTICS], axis=1).astype(float)
    return fit_sample(x, found.column("good").to_numpy().astype(float), found.column("part").to_numpy())


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of every document, written once: both the fit and the scores read them."""
    return written(docs.select("doc_id", statistics(text_of()).alias("stats")), "statistics")


def scored(rows: DataFrame, ensemble: Ensemble) -> DataFrame:
    """doc_id, held_out, score and predicted of the rows (doc_id, stats)."""
    score = ensemble.column(F.col("stats"))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= CUTOFF).cast("int"))


def op13_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, scored by the rules that the labels of four fifths of them teach."""
    rows = measured(table(spark, sf_dir, "documents"))
    return scored(rows, fit(rows, table(spark, sf_dir, "labels")))
