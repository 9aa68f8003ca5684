"""Checks of single rows: a bad row is set aside with its reason and the run goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def checked(df: DataFrame, rules: dict[str, Column], name: str = "error") -> DataFrame:
    """``df`` with the name of the first rule that a row fails (null counts as failing), null for good rows."""
    reason = F.lit(None).cast("string")
    for rule, holds in reversed(rules.items()):
        reason = F.when(~F.coalesce(holds, F.lit(False)), F.lit(rule)).otherwise(reason)
    return df.withColumn(name, reason)


def isolate(df: DataFrame, rules: dict[str, Column], path: str, name: str = "error") -> dict[str, int]:
    """Write good rows to ``path``/good and the others, with their reason, to ``path``/rejected.

    One pass over ``df`` writes both, as partitions of one table; its counts are observed on
    the way, so that no second scan counts them. Returns rows, good and the failures of each rule."""
    seen = Observation(f"checks of {path.rsplit('/', 1)[-1]}")
    failed = {rule: F.count(F.when(F.col(name) == rule, 1)).alias(rule) for rule in rules}
    marked = checked(df, rules, name).observe(seen, F.count("*").alias("rows"), F.count(F.when(F.col(name).isNull(), 1)).alias("good"), *failed.values())
    side = F.when(F.col(name).isNull(), "good").otherwise("rejected")
    marked.withColumn("__side", side).write.partitionBy("__side").mode("overwrite").parquet(path)
    return seen.get


def good(spark, path: str, name: str = "error") -> DataFrame:
    return spark.read.parquet(path).where("__side = 'good'").drop("__side", name)


def rejected(spark, path: str) -> DataFrame:
    return spark.read.parquet(path).where("__side = 'rejected'").drop("__side")
