"""Scalar estimators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pass_at_k(n: Column, c: Column, k: int) -> Column:
    """Unbiased pass@k of c successes among n samples.

    Fails (raise_error) when k > n, c > n or a count is not positive where it must be; it is never silently null.
    """
    bad = (F.lit(k) > n) | (c > n) | (F.lit(k) <= 0) | (n <= 0) | (c < 0)
    tail = F.aggregate(
        F.sequence(n - c + 1, n),
        F.lit(0.0),
        lambda acc, i: acc + F.log((i - F.lit(k)).cast("double")) - F.log(i.cast("double")),
    )
    value = (
        F.when(c == 0, F.lit(0.0))
        .when(n - c < k, F.lit(1.0))
        .when(F.lit(k == 1), c.cast("double") / n.cast("double"))
        .otherwise(F.lit(1.0) - F.exp(tail))
    )
    return F.when(bad, F.raise_error(F.lit("pass@k needs 0 < k <= n and 0 <= c <= n")).cast("double")).otherwise(value)
