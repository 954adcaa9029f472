import math

import pytest
from pyspark.sql import functions as F

from spanwright.functions import stats as S


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("n,c,k", [(8, 0, 1), (8, 3, 4), (8, 8, 8), (32, 1, 16), (16, 7, 8), (32, 1, 32), (40, 10, 1)])
def test_pass_at_k_is_the_binomial_ratio(spark, n, c, k):
    expected = 1 - math.comb(n - c, k) / math.comb(n, k)
    assert value(spark, S.pass_at_k(F.lit(n), F.lit(c), k)) == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize("n,c,k", [(4, 1, 5), (0, 0, 1), (4, 1, 0)])
def test_pass_at_k_is_null_outside(spark, n, c, k):
    assert value(spark, S.pass_at_k(F.lit(n), F.lit(c), k)) is None


def test_pass_at_k_fails_on_impossible_counts(spark):
    with pytest.raises(Exception, match="outside"):
        value(spark, S.pass_at_k(F.lit(3), F.lit(4), 1))


@pytest.mark.parametrize("b,c,p", [(8, 0, 2 / 256), (9, 1, 22 / 1024), (3, 3, 1.0), (0, 1, 1.0), (700, 600, None)])
def test_mcnemar(spark, b, c, p):
    if p is None:
        p = 2 * sum(math.comb(b + c, i) for i in range(min(b, c) + 1)) / 2 ** (b + c)
    assert value(spark, S.mcnemar_exact_p(F.lit(b), F.lit(c))) == pytest.approx(p, rel=1e-9)


def test_mcnemar_without_pairs(spark):
    assert value(spark, S.mcnemar_exact_p(F.lit(0), F.lit(0))) is None


def test_rates_and_ranks(spark):
    assert value(spark, S.rate(F.lit(1), F.lit(0))) is None
    assert value(spark, S.nearest_rank(F.array(*(F.lit(i) for i in (5, 1, 4, 2, 3))), 0.9)) == 4
    assert value(spark, S.log_sum_exp(F.array(F.lit(-1000.0), F.lit(-1000.0)))) == pytest.approx(-1000 + math.log(2))
    assert value(spark, S.majority(F.lit(2), F.lit(4))) is False
