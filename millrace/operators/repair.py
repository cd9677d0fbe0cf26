"""Rounds of repair: each round tries again what failed before and keeps what passed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.operators.graph import kept


def open_samples(samples: DataFrame) -> DataFrame:
    """The samples that a round has to try again; `passed` null counts as failed."""
    return samples.filter(~F.coalesce("passed", F.lit(False)))


def next_round(samples: DataFrame, tried: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, sample, output, passed, carried, keep) after a round; keep names columns of the samples.

    A sample that passed is carried over as it was, whatever `tried` holds for it; of the others, one that was
    tried has its new output, and one that wasn't stays failed. (id, sample) is unique in both inputs; a null key
    matches nothing. Attempts for unknown samples are dropped. Other columns of both are dropped.
    """
    new = tried.select("id", "sample", F.struct("output", "passed").alias("new"))
    old = samples.select("id", "sample", "output", F.coalesce("passed", F.lit(False)).alias("passed"), *keep)
    use = ~F.col("passed") & F.col("new").isNotNull()
    return old.join(new, ["id", "sample"], "left").select(
        "id",
        "sample",
        F.when(use, F.col("new.output")).otherwise(F.col("output")).alias("output"),
        F.when(use, F.coalesce("new.passed", F.lit(False))).otherwise(F.col("passed")).alias("passed"),
        F.col("passed").alias("carried"),
        *keep,
    )


def rounds(samples: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], n: int = 4) -> DataFrame:
    """(id, sample, output, passed, round) after n rounds, (id, sample) unique and not null: round is the one in which a sample passed, 0 if it had before, null if it never did.

    attempt gets the open samples and the round's number, from 1, and returns what was tried, as next_round() takes it. What a round begins
    with is written first.
    """
    out = samples.select("id", "sample", "output", F.coalesce("passed", F.lit(False)).alias("passed"))
    out = out.withColumn("round", F.when(F.col("passed"), F.lit(0)))
    for k in range(1, n + 1):
        out = kept(out)
        done = next_round(out, attempt(open_samples(out), k), ("round",))
        out = done.select("id", "sample", "output", "passed", F.when(~F.col("carried") & F.col("passed"), F.lit(k)).otherwise(F.col("round")).alias("round"))
    return out
