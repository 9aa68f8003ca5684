"""Means that lie on a half, which a sum of doubles may miss in its last bit."""

import random

from pyspark.sql import functions as F

from tests.test_ties import tables
from tidemark import plans
from tidemark.functions.rounding import mean_rounded

plans.load()

def test_mean_of_calibration_is_rounded_up_at_the_half(spark, tmp_path):
    """The mean is 48.29775; most orders of summing doubles end just below it."""
    path, _ = tables(spark, tmp_path, list(range(4000)), random.Random(573).sample(range(1000), 400))
    got = plans.QUERIES["calibration_summary"](spark, path).first()
    assert (got["n_spots"], got["mean_score"]) == (400, 48.2978)


def test_exact_means(spark):
    rows = [(k % 997 / 10,) for k in range(60_000)]
    total = sum(k % 997 for k in range(60_000))
    df = spark.createDataFrame([*rows, (None,)], "v double").repartition(7)
    got = df.agg(mean_rounded("v", 1, 4).alias("m")).first()["m"]
    tenths, rest = divmod(total * 1000, 60_000)
    assert got == (tenths + (2 * rest >= 60_000)) / 10_000
    assert df.where(F.col("v") < 0).agg(mean_rounded("v", 1, 4).alias("m")).first()["m"] is None
