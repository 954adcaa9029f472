"""Statistics as column expressions: rates, unbiased pass@k, exact paired tests, stable log sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MIN_DISCORDANT = 8  # fewer discordant pairs can't reach significance, whatever they say


def rate(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double; null for an empty denominator."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def pass_at_k(n: Column, c: Column, k: Column | int) -> Column:
    """Unbiased chance that k of n rollouts, c of which passed, hold a pass; null for n or k below 1 or k above n."""
    k = F.lit(k) if isinstance(k, int) else k
    misses = n - c
    none = F.aggregate(
        F.sequence(F.lit(0), F.greatest(k.cast("int") - 1, F.lit(0))),
        F.lit(1.0).cast("double"),
        lambda acc, i: acc * (misses - i).cast("double") / (n - i).cast("double"),
    )
    return (
        F.when((n <= 0) | (k <= 0) | (k > n) | n.isNull() | k.isNull(), F.lit(None).cast("double"))
        .when((c < 0) | (c > n), F.raise_error(F.lit("passes outside 0..n")).cast("double"))
        .when(misses < k, F.lit(1.0))
        .otherwise(1.0 - none)
    )


def mcnemar_exact_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of a paired test with b and c discordant pairs; null without any.

    The largest term of the tail is taken by logarithms and the others relative to it, so that
    thousands of pairs neither overflow nor vanish.
    """
    n, m = (b + c).cast("double"), F.least(b, c).cast("int")
    steps = F.when(m >= 1, F.sequence(F.lit(1), F.greatest(m, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    log_top = F.aggregate(steps, F.lit(0.0).cast("double"), lambda acc, i: acc + F.log((n - m + i) / i)) - n * F.log(F.lit(2.0))
    tail = F.aggregate(
        F.reverse(steps),
        F.struct(F.lit(1.0).cast("double").alias("term"), F.lit(1.0).cast("double").alias("sum")),
        lambda acc, i: F.struct((acc["term"] * i / (n - i + 1)).alias("term"), (acc["sum"] + acc["term"] * i / (n - i + 1)).alias("sum")),
        lambda acc: acc["sum"],
    )
    return F.when(n > 0, F.least(F.lit(1.0), 2.0 * F.exp(log_top) * tail))


def log_sum_exp(values: Column) -> Column:
    """Logarithm of the summed exponentials of an array, shifted by its maximum; null for an empty one."""
    top = F.array_max(values)
    return F.when(F.size(values) > 0, top + F.log(F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + F.exp(x - top))))


def entropy(log_probs: Column) -> Column:
    """Shannon entropy in nats of an array of log probabilities; impossible outcomes add nothing."""
    return -F.aggregate(log_probs, F.lit(0.0).cast("double"), lambda acc, x: acc + F.when(F.exp(x) > 0, F.exp(x) * x).otherwise(0.0))


def nearest_rank(values: Column, share: float) -> Column:
    """``sorted[int(share * (n - 1))]`` of an array."""
    return F.element_at(F.array_sort(values), (F.floor(F.lit(share) * (F.size(values) - 1)) + 1).cast("int"))


def majority(passed: Column, n: Column) -> Column:
    """A strict majority of rollouts passed; a tie fails."""
    return passed * 2 > n
