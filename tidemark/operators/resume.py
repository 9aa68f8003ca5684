"""Runs that carry on where an earlier one stopped: only keys that are not done are made."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.sources.scratch import written


def done(spark: SparkSession, path: str, key: str, kind: str) -> DataFrame:
    """Keys that runs to ``path`` have finished, with their run."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/done")
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return sinks.empty_view(spark, f"{key} {kind}, run string")
    return spark.read.schema(f"{key} {kind}, run string").parquet(f"{path}/done")


def run_missing(wanted: DataFrame, key: str, make: Callable[[DataFrame], DataFrame], path: str, run: str) -> DataFrame:
    """``make`` the rows of those keys of ``wanted`` that are not done yet; returns these keys.

    Rows go to ``path``/data, a folder for each key that a repeated run replaces, and only after that the
    keys to ``path``/done, also those that gave no rows. A run that ends in between leaves
    its keys undone, and the next one writes them again, once."""
    spark = wanted.sparkSession
    kind = wanted.schema[key].dataType.simpleString()
    todo = written(wanted.select(key).where(F.col(key).isNotNull()).distinct().join(done(spark, path, key, kind).select(key), key, "left_anti"), "todo")
    rows = make(todo).withColumn("run", F.lit(run))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(f"{path}/data")
    todo.withColumn("run", F.lit(run)).write.mode("append").parquet(f"{path}/done")
    return todo


def made(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """All rows of finished and unfinished runs, one set for each key."""
    return spark.read.schema(schema).parquet(f"{path}/data")
