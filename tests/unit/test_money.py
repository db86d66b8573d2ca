import math

import pytest

from quotaflow.functions.numeric import exact_money_sum
from pyspark.sql import functions as F


@pytest.mark.parametrize("amounts, total", [
    ([0.00004, 0.00003], 0.00007),
    ([1e16, 0.5], 1e16 + 0.5),
    ([9e19] * 3, 2.7e20),            # the total is too large for the decimal
    ([1e30, 2.0], 1e30),             # an amount is
    ([1e300, -1e300], 0.0),
    ([0.1] * 10, 1.0),               # a double sum gives 0.9999999999999999
    ([None, math.nan, math.inf, 2.5], 2.5),
    ([None], 0.0),
])
def test_money_sum(spark, amounts, total):
    df = spark.createDataFrame([(x,) for x in amounts], "x double").repartition(3)
    assert df.agg(exact_money_sum(F.col("x")).alias("s")).first().s == total


def test_money_sum_of_no_rows(spark):
    assert spark.createDataFrame([], "x double").agg(exact_money_sum(F.col("x")).alias("s")).first().s == 0.0
